"""New words of many texts are looked up and tokenised together; what is held is compact."""

import numpy as np
import pyarrow as pa

from loglantern.llm import packing
from loglantern.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_texts_of_a_batch_share_their_calls(monkeypatch):
    tokens, calls = packing.Tokens(PATH), []
    whole = packing.Tokens(PATH).whole if hasattr(tokens, "whole") else packing.Tokens(PATH).tokenizer

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(inner, name)

    inner, tokens.tokenizer = tokens.tokenizer, Counted()
    monkeypatch.setattr(packing, "_tokens", lambda path: tokens)
    texts = [f"{a}{b}ing É{b}{a}, {a}ß{b}***\n{b}5 don't" for a in "abcdefgh" for b in "klmnop"] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = pa.Table.from_batches(packing._pieces(PATH, 1, 2048)(iter([batch]))).to_pylist()
    want = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    assert [(r["doc_id"], r["length"], r["ids_crc32"]) for r in got] == [(i, len(x) // 4, packing.zlib.crc32(x)) for i, x in enumerate(want)]
    assert len(calls) <= 2


def test_a_batch_is_cut_by_bytes_and_not_inside_a_text():
    texts = ["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [p.column("text").to_pylist() for p in packing._chunks(batch, 12)] == [texts[:2], texts[2:3], texts[3:]]
