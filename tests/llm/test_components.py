import random

from pyspark.sql import functions as F

from pageflow.llm.common import running_total
from pageflow.llm.components import connected_components, joined_components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_random_chains_and_stars(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(random.randint(0, 90), random.randint(0, 90)) for _ in range(50)] + [(7000, 7000)]
    random.shuffle(edges)
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == plain(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_further_links(spark):
    random.seed(4)
    first = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(40)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    for more in ([], [(5000, 5000)], first[:3], [(random.randint(0, 120), random.randint(0, 120)) for _ in range(40)]):
        got = joined_components(connected_components(frame(first)), frame(more))
        assert sorted(map(tuple, got.select("id", "component").collect())) == sorted(plain(first + more).items())


def test_running_total_in_levels(spark):
    rows = spark.range(700).select(F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("k"), "id", (F.col("id") % 7).alias("n"))
    for most in (1_000_000, 8):
        got = {}
        for r in running_total(rows, ["k"], ["id"], "n", "start", rows_a_bucket=5, most_buckets=most).collect():
            got.setdefault(r["k"], []).append((r["start"], r["n"]))
        assert sum(map(len, got.values())) == 700
        for places in got.values():
            total = 0
            for start, n in sorted(places):
                assert start == total
                total += n
