"""The rejection limit stays low where labels are wrong."""

import numpy as np
import pytest

from loglantern.llm import language


@pytest.mark.parametrize("noise", [0.0, 0.01, 0.02, 0.05])
def test_clean_texts_stay_when_labels_are_swapped(noise):
    rng = np.random.default_rng(5)
    n, langs, buckets = 3000, 3, 300
    y = rng.integers(0, langs, n)
    x = y[:, None] * 100 + rng.integers(0, 100, (n, 30))
    swapped = np.where(rng.random(n) < noise, (y + 1 + rng.integers(0, langs - 1, n)) % langs, y)
    model = language.train(x, swapped, ["a", "b", "c"], buckets)
    z = (model.table[x].mean(1) + model.bias) / model.temperature
    p = language._softmax(z)
    assert (p.argmax(1) == y).mean() > 0.99
    assert (p.max(1) >= model.least).mean() > 0.97 and model.rejected < 0.03


def test_limit_rejects_where_answers_are_mostly_wrong():
    score = np.concatenate([np.linspace(0.5, 0.6, 50), np.linspace(0.61, 1, 950)])
    assert language.limit(score, score > 0.6, 0.995) == pytest.approx(0.6, abs=0.02)
    assert language.limit(score, np.arange(1000) % 20 != 7, 0.995) < 0.51
