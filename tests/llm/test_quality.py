import re

import numpy as np
from pyspark.sql import functions as F

from pageflow.llm import quality

BLANK = " \t\n\v\f\r"


def base(text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def tokens(text):
    found = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|[^0-9A-Za-z\x20\x09-\x0D\x80-\U0010ffff]+", text or "")
    return found + list(zip(found[:-1], found[1:], strict=True))


def test_rules_and_verdicts_of_the_whole_table(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] != 1 for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    reader = quality.Reader(18)
    bucket = {}
    for r in rows:  # tokens are cut as the plain pattern does; where a token goes is the operator's own
        found = reader.buckets(r["text"])
        want = tokens(r["text"])
        assert len(found) == len(want)
        for t, b in zip(want, found.tolist(), strict=True):
            assert bucket.setdefault(t, b) == b
    n, t = np.zeros(1 << 18), np.zeros(1 << 18)
    for r in rows:
        for x in tokens(r["text"]):
            n[bucket[x]] += 1
            t[bucket[x]] += labels.get(r["doc_id"], False)
    share = t.sum() / n.sum()
    weights = np.rint(np.log((t / share + 20) / (n + 20)) * (1 << 20))
    want = {}
    for r in rows:
        *counts, failed = base(r["text"])
        x = tokens(r["text"])
        score = sum(int(weights[bucket[g]]) for g in x) / (len(x) << 20) if x else 0.0
        want[r["doc_id"]] = (*counts, failed, score, not failed and score >= -0.1)
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.op11_query(spark, sf001).collect()}
    assert got == want


def test_clean_documents_stay_and_junk_goes(spark, sf01):
    judged = quality.op11_query(spark, sf01).join(spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    found = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert set(found) == {(1, True), (0, False)}


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a b c d a b", "x\n \nx\n\nx\ny", "##  $ <é> |", "日本 語\v文", "w " * 49, "w " * 50, " ".join(f"w{i}" for i in range(200_000)), "a b c " * 2 + "z " * 3]
    docs = spark.createDataFrame([(i, t, "own", 0.5) for i, t in enumerate(texts)] + [(None, texts[4], None, None)], "doc_id long, text string, kept string, score double")
    weights = np.zeros(1 << 18, np.int32)
    got = quality.judge(docs, weights)
    assert got.columns == ["doc_id", "text", *quality.COUNTS, "base_failed", "score", "kept"]
    for r in got.collect():
        *counts, failed = base(r["text"])
        assert [r[c] for c in quality.COUNTS] == counts and r["base_failed"] == failed and r["kept"] == (not failed) and r["score"] == 0
    assert quality.judge(docs.limit(0), weights).count() == 0


def test_weights(spark):
    schema = "text string, trusted boolean"
    assert not quality.fit_ratio(spark.createDataFrame([], schema)).any()
    assert not quality.fit_ratio(spark.createDataFrame([("a b", False), (None, None)], schema)).any()
    w = quality.fit_ratio(spark.createDataFrame([("good words", True), (None, True)] * 50 + [("bad words", False)] * 50, schema))
    reader = quality.Reader(18)
    good, bad = (int(w[reader.buckets(x)[0]]) for x in ("good", "bad"))
    assert good > 0 > bad and w[reader.buckets("never seen")].tolist() == [0, 0, 0]


def test_trusted_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["text"]: bool(r["trusted"]) for r in quality.trusted_rows(docs, labels).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True}
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert 800 < quality.trusted_rows(texts, many, most=1_000).where("trusted").count() < 1_200
