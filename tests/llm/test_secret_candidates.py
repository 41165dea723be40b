"""Secrets directly after '=', and of one letter case."""

import random

import pytest

from loglantern.llm import secret_scan
from loglantern.llm.queries import vocabulary

KEY = "aB3xK9mQ2vLp7Zt5Rw8Nc4Jd6Hf1Gs0Y"


def found(text):
    _, every = secret_scan.spans(text, vocabulary("byte_bpe_50k.tiktoken"), 2.2)
    return [text[a:b] for a, b, k in every if k == "random"]


@pytest.mark.parametrize("text", [f"SIGNING_KEY={KEY}", f"https://host.example/?sig={KEY}&b=1", f"x {KEY} y", f"CUSTOMER_SIGNING_CONFIGURATION_VALUE={KEY}", f"k=={KEY}"])
def test_values_after_equals(text):
    assert found(text) == [KEY]


def test_padding_belongs_to_the_value():
    assert found(f"a={KEY}== b") == [KEY + "=="]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
def test_random_strings_of_one_letter_case(letters):
    rng = random.Random(2)
    keys = ["".join(rng.choices(letters, k=24)) for _ in range(300)]
    assert sum(found(f"key {k} end") == [k] for k in keys) >= 297


def test_names_stay():
    assert found("snake_case_identifier_name CUSTOMER_CONFIGURATION_VALUE getInternationalizationSettings src/main/resources/application") == []
