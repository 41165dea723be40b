"""Embeddings of long texts and of many: chunk by chunk, with the same result."""

import numpy as np

from loglantern.functions import embedding


def _plain(text, dims):
    out, word, position = np.zeros(dims), "", 0
    for c in (text or "").lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789._/-":
            word += c
        elif word:
            h = 0
            for x in word:
                h = (h * 31 + ord(x)) & 0xFFFFFFFF
            out[((h ^ (position * 31)) & 0x7FFFFFFF) % dims] += 1 + min(len(word), 16) / 24
            word, position = "", position + 1
    size = np.sqrt((out * out).sum())
    return out / size if size else out


def test_chunks_stay_small(monkeypatch):
    """A text of many chunks is cut between tokens, its positions go on; no chunk holds more than its size and a token."""
    rng = np.random.default_rng(4)
    words = ["Error", "a/b-c", "x", "slow.query", "é", "0", "-"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 900, 3, 2, 400, 1)] + [None, "a" * 500, "b" * 400 + " c", " " * 300]
    held = []
    add = embedding._add_chunk

    def counting(blobs, *rest):
        held.append(sum(map(len, blobs)))
        return add(blobs, *rest)

    want = embedding.embed_texts(texts, 64)
    monkeypatch.setattr(embedding, "_CHUNK_BYTES", 100)
    monkeypatch.setattr(embedding, "_add_chunk", counting)
    got = embedding.embed_texts(texts, 64)
    assert (got == want).all()
    assert np.allclose(got, [_plain(t, 64) for t in texts], atol=1e-12)
    assert max(n for n in held if n not in (500, 400)) <= 100 + len("slow.query")
