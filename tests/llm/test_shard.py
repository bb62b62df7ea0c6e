import zlib
from collections import Counter, defaultdict

import pytest

from pageflow.llm import shard


def test_whole_table(spark, sf01):
    rows = shard.op8_query(spark, sf01).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    weight, slots, largest = Counter(), defaultdict(list), max(map(len, texts.values()))
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "bytes"
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(weight) == list(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(weight.values()) / 24
    assert all(abs(w - mean) <= 2 * largest for w in weight.values())


def test_one_hot_source(spark):
    docs = spark.createDataFrame([(i, "copy", "hot", "en", 4) for i in range(3000)] + [(i, "x" * (i % 50), "s%d" % (i % 7), None, None) for i in range(1000)], "doc_id long, text string, source string, lang string, n_chars long")
    weight = Counter()
    for r in shard.kd_tree(docs, shards=7).collect():
        weight[r["shard"]] += r["size"]
    assert max(weight.values()) - min(weight.values()) < 0.05 * sum(weight.values()) / 7
    by_bytes = shard.kd_tree(docs, target_bytes=sum(weight.values()) // 5 + 1)
    assert by_bytes.select("shard").distinct().count() == 5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1, None), (2, "", 1, float("nan")), (2, "a", 1, 1.0), (2, "a", 1, 1.0)], "doc_id long, text string, shard int, n_chars double")
    out = shard.numbered(shard.kd_tree(docs, shards=3)).collect()
    assert len(out) == 4 and sorted(r["size"] for r in out) == [8, 8, 9, 9]
    assert shard.kd_tree(docs.limit(0), shards=3).count() == 0
    assert shard.kd_tree(docs.select("doc_id", "text"), target_bytes=10**9).select("shard").distinct().count() == 1
    with pytest.raises(ValueError):
        shard.kd_tree(docs)


def plain_tree(rows, k, first=0):
    """Shard of each (keys, size) by splitting at weighted medians, one node after another."""
    if k == 1 or not rows:
        return {row: first for row in rows}
    dims = range(len(rows[0][0]))
    width = lambda i: max(r[0][i] for r in rows) >> shard.TIE_BITS, lambda i: min(r[0][i] for r in rows) >> shard.TIE_BITS
    dim = max(dims, key=lambda i: (width[0](i) - width[1](i), -i))
    want = sum(r[1] for r in rows) * (k // 2) / k
    weight, upto, cut = Counter(), 0, None
    for keys, size, _ in rows:
        weight[keys[dim]] += size
    for key in sorted(weight):
        upto += weight[key]
        if upto >= want:
            cut = key if upto - want <= want - (upto - weight[key]) else key - 1
            break
    left = [r for r in rows if r[0][dim] <= cut]
    right = [r for r in rows if r[0][dim] > cut]
    return plain_tree(left, k // 2, first) | plain_tree(right, k - k // 2, first + k // 2)


def test_tree_equals_a_plain_one(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    dims = ["source", "lang", "n_chars", "doc_id"]
    keyed = shard._keys(docs, dims).withColumn("size", shard.document_size(docs["text"]))
    rows = [(tuple(r["_keys"]), r["size"], r["doc_id"]) for r in keyed.select("_keys", "size", "doc_id").collect()]
    for k in (5, 24):
        want = {row[2]: n for row, n in plain_tree(rows, k).items()}
        assert {r["doc_id"]: r["shard"] for r in shard.kd_tree(docs, shards=k).collect()} == want


def test_very_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "y" * (2_000_000 if i == 7 else 10), "own", "own") for i in range(40)], "doc_id long, text string, size string, node string")
    out = shard.kd_tree(docs, shards=4).collect()
    assert len(out) == 40 and {r["shard"] for r in out if r["doc_id"] != 7} <= set(range(4)) and sum(r["size"] for r in out) == 2_000_000 + 390 + 320


def test_a_row_that_is_there_very_often(spark):
    """960 equal rows and 480 others in 24 shards: each within a row of the others."""
    docs = spark.createDataFrame([(None, "z" * 12, "s", "en")] * 960 + [(i, "z" * 12, f"s{i % 5}", "en") for i in range(480)], "doc_id long, text string, source string, lang string").repartition(5)
    weight = Counter()
    for r in shard.kd_tree(docs, shards=24).collect():
        weight[r["shard"]] += r["size"]
    assert sum(weight.values()) == 1440 * 20 and set(weight) == set(range(24))
    assert max(weight.values()) - min(weight.values()) <= 3 * 20
