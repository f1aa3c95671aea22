"""Hard negatives: packed products, and whole results against brute force."""

import math

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import hard_negatives as hn

FIELDS = "vec_id long, embedding array<double>, label int, codes int, g string"


@given(st.integers(1, 9), st.integers(0, 5), st.integers(0, 40), st.sampled_from([3, 300, 1 << 20, 1 << 26]), st.integers(0, 999))
def test_products_are_exact(dims, n_anchors, n_rows, size, seed):
    rng = np.random.default_rng(seed)
    a, c = rng.integers(-size, size, (n_anchors, dims)), rng.integers(-size, size, (n_rows, dims))
    both = np.concatenate([a, c]) if n_anchors + n_rows else np.zeros((1, dims), np.int64)
    bias, bits = hn.field_bits(int(both.min()), int(both.max()), dims)
    assert hn.scores(a, c, bias, bits).tolist() == (a.astype(object) @ c.T.astype(object)).tolist()


def test_fields_share_a_word():
    bias, bits = hn.field_bits(-256, 256, 64)
    assert hn.fields_of(bits) == 2 and hn.packed(np.ones((5, 64), np.int64), bias, bits).shape == (64, 3)


def brute(rows, anchors):
    usable = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and abs(256 * x) < hn.LARGEST for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, lab, v in usable:
        if i % anchors:
            continue
        by = sorted((-dot(v, w), j, m != lab) for j, m, w in usable if j != i or m != lab)
        for s, j, _ in [x for x in by if not x[2] and x[1] != i][:5]:
            near = [x for x in by if x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, anchors):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], FIELDS)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % anchors == 0).collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    made = [(i, rng.normal(0, 0.2, 6).round(3).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    made += [(200 + i, [0.25] * 6, i % 2) for i in range(12)]  # ties
    made += [made[3], made[4], (10, [0.5] * 6, 1)]  # repeated rows, and one id with other contents
    odd = [(None, [1.0] * 6, 1), (300, None, 1), (301, [1.0] * 6, None), (302, [1.0, None] * 3, 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 2), (310, [], 1), (320, [0.3], 2), (330, [1e300] * 6, 1)]
    want = brute(made + odd, 10)
    assert want and mined(spark, made + odd, 10) == want
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "CANDIDATES", 16)
    assert mined(spark, made + odd, 10) == want


def test_wide_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 9e4, 5)).tolist(), int(i % 2)) for i in range(60)]
    want = brute(rows, 10)
    assert want and mined(spark, rows, 10) == want


def test_empty_and_alone(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], 10) == []
