import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import mix


def test_targets_reach_caps_and_total():
    assert mix.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mix.targets([10, 1000], [1, 1], 1515, 2) == [20.0, 1495.0]
    assert mix.targets([0, 5], [1, 1], 7.5, 2) == [0.0, 7.5] and mix.targets([], [], 0, 2) == []


def test_draws_deal_all_slots():
    slots = np.array([70, 1, 0, 29])
    got = [mix.draw(slots, 7, s, 3) for s in range(7)]
    assert sum(g[0] for g in got).tolist() == slots.tolist()
    for (counts, before), (_, after) in zip(got, got[1:]):
        assert (before + counts == after).all() and (counts >= 0).all()
    assert {int(g[0].sum()) for g in got} <= {14, 15}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mix.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def test_whole_table(spark, sf01):
    first = mix.op2_query(spark, sf01).collect()
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    again = mix.Mix(docs.select("doc_id", "source", "text").repartition(7)).taken().drop("source").collect()
    assert sorted(first) == sorted(again) and len(first) == docs.count()
    words = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in first:
        source, n = words[r["doc_id"]]
        assert r["size"] == n and r["taken"] <= 2 * n
        taken[source] += r["taken"]
        size[source] += n
        target[source] = r["target"], r["source_size"]
    names = sorted(size)
    want = mix.targets([size[s] for s in names], [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)
    for s, t in zip(names, want):
        assert target[s] == (t, size[s]) and abs(taken[s] - t) <= 192


def test_pieces_are_the_words_taken(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    m = mix.Mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in m.taken().collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out, words = m.documents(), Counter()
    assert out.schema == docs.schema
    for r in out.collect():
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(mix.word_starts(r["text"]))
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, size long, target int"
    rows = [(1, None, "a", 0, 0), (2, "", None, 0, 0), (None, "one two", None, 0, 0), (3, "x " * 500, "b", 0, 0), (3, "x " * 500, "b", 0, 0), (4, "y", "", 0, 0)]
    got = mix.Mix(spark.createDataFrame(rows, schema)).taken()
    assert got.count() == 6
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("n")).collect()}
    assert by["a"]["t"] == 0 and by["b"]["n"] == 1000 and abs(by["b"]["t"] - by["b"]["target"]) <= 192
    assert mix.Mix(spark.createDataFrame([], schema)).taken().count() == 0
    assert mix.Mix(spark.createDataFrame([], schema)).documents().count() == 0


def test_pieces_of_a_very_long_text(spark):
    """4 MB of text in more than three thousand pieces: no piece takes the whole text along."""
    text = " ".join(f"word{i}" for i in range(400_000))
    docs = spark.createDataFrame([(1, text, "a", 5), (2, "one two", "b", 6)], "doc_id long, text string, source string, n_chars int")
    out = mix.Mix(docs).documents()
    sizes = {r["doc_id"]: (r["n"], r["words"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("words")).collect()}
    taken = {r["doc_id"]: r["taken"] for r in mix.Mix(docs).taken().collect()}
    assert sizes[1][0] > 3_000 and {k: v for k, (_, v) in sizes.items()} == {k: v for k, v in taken.items() if v}


def test_slots_are_a_plain_draw(spark):
    """Every slot of a source takes the block that its place in the permutation of its epoch says, and words are counted from blocks."""
    docs = spark.createDataFrame([(i, "w " * (1 + i * 37 % 90), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    m = mix.Mix(docs, block=16, shard_blocks=8)
    slots = {}
    for r in m.slot_table().collect():
        slots.setdefault(r["source_no"], {})[r["slot"]] = r["block"]
    for s, n in enumerate(m.slots):
        assert sorted(slots[s]) == list(range(n))
        for epoch in range(-(-n // m.blocks[s])):
            own = [slots[s][x] for x in range(epoch * m.blocks[s], min(n, (epoch + 1) * m.blocks[s]))]
            assert own == mix.permuted(np.arange(len(own)), int(m.blocks[s]), m.seed * 1_000_003 + s * 1009 + epoch).tolist()
    taken = Counter()
    for r in m.placed.collect():
        for block in slots[r["source_no"]].values():
            taken[r["doc_id"]] += max(0, min((block + 1) * 16, r["start"] + r["size"]) - max(block * 16, r["start"]))
    assert {r["doc_id"]: r["taken"] for r in m.taken().collect()} == {d: taken[d] for d in range(60)}
