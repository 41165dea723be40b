"""The packer's token cache against the tokenizer on whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loglantern.llm.packing import Tokens
from loglantern.llm.queries import vocabulary

PIECES = ["a", "B", "naïve", "É", "ß", "İ", "word", ",", ".", "..", "!", "?", ";", ":", "'s", "don't", "5", "x1", "-", " ", "  ", "\n", "\t", "\x00", "ﬁ", "中", "<|endoftext|>", "ª", "ÿ", "Ÿ"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_texts(whole):
    big, tiny = (Tokens(vocabulary("word_bpe_49k.json"), most) for most in (1 << 20, 200))

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
    def equal(text):
        assert big(text) == tiny(text) == whole(text)

    equal()


def test_generations_stay_bounded(spark, sf, whole):
    tokens = Tokens(vocabulary("word_bpe_49k.json"), 20_000)
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = row.text or ""
        assert tokens(text) == whole(text)
        most = 20_000 + 5 * len(text.encode()) + 4000
        assert sum(len(p) + len(ids) for p, ids in [*tokens.young.items(), *tokens.old.items()]) <= 2 * (most + 200_000)
