"""A text with many new words asks the tokenizer once, without the offsets that packing does not use."""

from loglantern.llm.packing import Tokens
from loglantern.llm.queries import vocabulary


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.tokenizer, name)


def test_new_words_are_one_call_without_offsets():
    tokens = Tokens(vocabulary("word_bpe_49k.json"))
    text = " ".join(f"{a}{b}ing" for a in "abcdefgh" for b in "klmnop")
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    tokens.tokenizer = counted = Counted(tokens.tokenizer)
    assert tokens(text) == b"".join(i.to_bytes(4, "little") for i in want)
    assert tokens(text) == tokens(text) and counted.calls == ["encode_batch_fast"]
