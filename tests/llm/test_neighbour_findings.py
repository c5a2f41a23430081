"""Neighbours among repeated ids, and recall with many lists."""

import numpy as np
from pyspark.sql import functions as F

from perilscope.llm import ann
from tests.llm.test_pairs import exact, vectors


def answers(spark, data):
    out = {}
    for x in ann.nearest(vectors(spark, data), F.col("vec_id") % 20 == 0).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_an_id_repeated_fifty_times_pushes_nobody_out(spark):
    r = np.random.default_rng(6)
    near = np.ones(8)
    data = [(i, near * 0.5 + 0.05 * r.standard_normal(8)) for i in range(200)]
    data += [(7, near * 2) for _ in range(50)]  # the same row
    data += [(9, near * 2 + 0.01 * r.standard_normal(8)) for _ in range(50)]  # other vectors of one id
    out, want = answers(spark, data), exact(data)
    assert set(out) == set(want)
    for q, best in want.items():
        assert [i for _, i, _ in out[q]] == [i for i, _ in best]
        assert np.allclose([s for _, _, s in out[q]], [s for _, s in best])


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 10)
    r = np.random.default_rng(3)
    data = [(i, x / np.linalg.norm(x)) for i, x in enumerate(r.standard_normal((5000, 24)))]
    out, want = answers(spark, data), exact(data)
    hit = sum(len({i for _, i, _ in out[q]} & {i for i, _ in best}) for q, best in want.items())
    print("recall", hit / (20 * len(want)))
    assert hit >= 0.9 * 20 * len(want)
