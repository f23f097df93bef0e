"""A text's score is the sum of the weights of all its features that the model keeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexloom.llm import ordinal
from lexloom.llm import textkit as tk

TEXTS = ["spam egg spam ham", "spam egg ham", "", "ham ham egg egg egg", " ".join(["spam", "spam", *[f"w{i}" for i in range(300)]])]


def by_definition(model, buf, off):
    doc, key = ordinal.described(buf, off)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    out = np.zeros(len(off) - 1)
    for d, k in zip(doc.tolist(), key.tolist(), strict=True):
        out[d] += weight.get(k, 0.0)
    return out


def model_of(keys):
    keys = np.unique(np.array(keys, np.uint64))
    return ordinal.OrdinalModel(keys, np.arange(1, len(keys) + 1) / 7, np.zeros(1), np.arange(2))


def test_a_dense_feature_counts_without_its_plain_one():
    buf, off = tk.column(pa.array(TEXTS))
    plain = np.unique(ordinal.features(buf, off)[1])
    only_dense = model_of(tk.mix(plain ^ ordinal.DENSE))
    got = only_dense.scores(buf, off)
    assert got[0] > 0 and got[1] == 0 and got[2] == 0 and got[3] > 0
    assert np.allclose(got, by_definition(only_dense, buf, off))


def test_scores_are_those_of_the_fit_for_any_kept_features():
    buf, off = tk.column(pa.array(TEXTS))
    plain = np.unique(ordinal.features(buf, off)[1])
    rng = np.random.default_rng(5)
    both = np.concatenate([plain, tk.mix(plain ^ ordinal.DENSE)])
    for _ in range(20):
        model = model_of(both[rng.random(len(both)) < 0.4])
        assert np.allclose(model.scores(buf, off), by_definition(model, buf, off))
