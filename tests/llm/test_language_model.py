"""The language model's sums and softmax against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import language_model as lm


@pytest.mark.parametrize(("classes", "width"), [(300, 4), (300, 5), (1 << 17, 4)])
def test_sums_take_values_once_for_each_run_of_rows(classes, width):
    rng = np.random.default_rng(1)
    values = rng.integers(-9, 9, (50, width)).astype(np.float32)
    rows = rng.integers(0, classes, 150)  # three runs of rows: the values go to each
    want = np.zeros((classes, width), np.float32)
    np.add.at(want, rows, np.tile(values, (3, 1)))
    np.testing.assert_array_equal(lm._sums(rows, values, classes), want)
    np.testing.assert_array_equal(lm._sums(rows[:50], values, classes).sum(0), values.sum(0))


@pytest.mark.parametrize("scale", [0.1, 1, 40])
def test_softmax_of_small_and_of_large_scores(scale):
    rng = np.random.default_rng(2)
    hidden, target = rng.normal(0, scale, (1500, 17)).astype(np.float32), rng.normal(0, 1, (17, 30)).astype(np.float32)
    own, scores = rng.integers(0, 30, 1500), hidden.astype(float) @ target
    top = scores.max(1)
    want = (scores[np.arange(1500), own] - top - np.log(np.exp(scores - top[:, None]).sum(1))) / np.log(10)
    np.testing.assert_allclose(lm._normalised(hidden, target, own), want, rtol=1e-4, atol=1e-4)
