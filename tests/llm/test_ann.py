import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import ann


def brute(rows, k=20, every=20):
    """Nearest rows by plain comparison, ties to smaller ids."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(list(v), good.get(i, list(v)))
    ids = np.array(sorted(good))
    m = np.array([good[i] for i in ids], dtype=float)
    out = {}
    for i in ids[ids % every == 0]:
        s = ann.inner_products(np.array(good[i], dtype=float), m.T)
        out[int(i)] = [(int(j), x) for x, j in sorted((-x, j) for x, j in zip(s, ids) if j != i)[:k]]
    return {q: [(j, -x) for j, x in found] for q, found in out.items()}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_when_small(spark, sf001):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf001}/embeddings.parquet").collect()]
    assert by_query(ann.op7_query(spark, sf001)) == brute(rows)


def test_recall_of_the_forest(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = spark.read.parquet(path)
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = by_query(ann.nearest(table, F.col("vec_id") % 20 == 0, leaves=16, least_rows=100))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hit >= 0.9
    scores = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(scores.get((q, i), s) == pytest.approx(s, abs=1e-12) for q, found in got.items() for i, s in found)


def test_recall_of_the_shipped_parameters(spark):
    """20,000 vectors in blurred families, with ties and repeated vectors; hot leaves dealt to several tasks."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    points = (centres[rng.integers(0, 40, 20_000)] + 0.4 * rng.normal(size=(20_000, 24))).astype(np.float32)
    points[5_000:5_300] = points[5_000]
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, every=200)
    for options in ({}, {"part_rows": 500, "least_rows": 0}):
        got = by_query(ann.nearest(df, F.col("vec_id") % 200 == 0, **options))
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_double_components(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert by_query(ann.nearest(df, F.col("vec_id") % 20 == 0)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (40, [0.0, 0.0]), (9, [])]
    schema = "vec_id long, embedding array<float>, rank string, score string, v int"
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    assert by_query(ann.nearest(df, F.col("vec_id") % 20 == 0)) == brute(rows)
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<float>")
    assert by_query(ann.nearest(many, F.col("vec_id") % 20 == 0)) == brute([(i, [1.0, 2.0]) for i in range(100)])
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
