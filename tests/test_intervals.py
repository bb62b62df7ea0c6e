"""Ranges, spans and long logs against plain forms."""

import random
import time

from pyspark.sql import functions as F

from pageflow.operators import batch, intervals, pages, split
from pageflow.plans import queries
from pageflow.sources import fixtures as fx

FAR = 2_000_000_000


def test_cover_holds_each_number_once(spark):
    random.seed(3)
    rows = [(s, s + random.choice([0, 1, 3, 60, 64, 70, 5_000, 300_000])) for s in [*(random.randint(0, 9_000) for _ in range(150)), 0, 63, 64, 4095, 4096]] + [(5, 4), (None, 3), (1, None), (1, FAR), (0, 2**31 - 1), (-70, 200)]
    df = spark.createDataFrame(rows, "s int, e int").withColumn("c", intervals.cover(F.col("s"), F.col("e")))
    for r in df.collect():
        blocks = sorted((b["block"] << 6 * (b["level"] + 1), (b["block"] + 1) << 6 * (b["level"] + 1)) for b in r["c"])
        if r["s"] is None or r["e"] is None or r["s"] > r["e"]:
            assert not blocks
            continue
        assert blocks[0][0] <= r["s"] < blocks[0][0] + 64 and blocks[-1][1] - 64 <= r["e"] < blocks[-1][1]
        assert all(a[1] == b[0] for a, b in zip(blocks[:-1], blocks[1:], strict=True)) and len(blocks) <= 126 * 5 + 64


def test_top_level_is_that_of_the_cover(spark):
    r = random.Random(4)
    rows = [(a, a + r.choice([-1, 0, 5, 63, 64, 4096, 300_000, 20_000_000, 2_000_000_000])) for a in (r.randint(-100_000, 100_000) for _ in range(300))]
    rows += [(None, 3), (3, None), (0, 63), (0, 64), (0, 4095), (64, 127), (3, 2_000_000_000)]
    s, e = F.col("s"), F.col("e")
    df = spark.createDataFrame(rows, "s int, e int").withColumn("c", F.array_max(F.transform(intervals.cover(s, e), lambda b: b["level"])))
    assert df.where(~intervals.top_level(s, e).eqNullSafe(F.col("c"))).count() == 0


def test_far_split_parses_its_documents_once(spark, sf001, tmp_path, monkeypatch):
    def seen(batches):
        for batch_ in batches:
            for doc in batch_.column(0).to_pylist():
                (tmp_path / f"{doc}-{time.time_ns()}").touch()
            yield batch_

    parsed = queries.parsed
    monkeypatch.setattr(queries, "parsed", lambda *a: parsed(*a).where("page_num = 1").mapInArrow(seen, "doc_id long, pos int, page_num int, content string"))
    rows = queries.split_far(spark, sf001).collect()
    assert len(rows) == len(list(tmp_path.iterdir())) == queries.documents(spark, sf001).where("text IS NOT NULL").count()


def test_split_of_random_ranges(spark):
    random.seed(4)
    rows = [(d, i + 1, random.randint(0, 400), f"c{i}") for d in range(4) for i in range(150)] + [(9, 1, None, "x")]
    p = spark.createDataFrame(rows, "doc_id long, pos int, page_num int, content string")
    for far in (False, True):
        ranges = [(d, e, f"f{e}", s := random.randint(0, 390), s + random.randint(-2, 40)) for d in range(4) for e in range(40)]
        ranges += [(0, 99, "all", 0, FAR), (1, 99, "rest", 300, FAR)] if far else []
        defs = spark.createDataFrame(ranges, "doc_id long, entry_no int, filename string, start_page int, end_page int")
        got = sorted((r["doc_id"], r["entry_no"], r["filename"], r["pos"], r["old_page"], r["content"]) for r in split.split_docs(p, defs).collect())
        assert got == sorted((d, e, f, i, n, c) for d, i, n, c in rows if n is not None for b, e, f, lo, hi in ranges if b == d and lo <= n <= hi)
        free = sorted({(d, n) for d, _, n, _ in rows if n is None or not any(b == d and lo <= n <= hi for b, _, _, lo, hi in ranges)}, key=str)
        assert sorted(map(tuple, split.split_uncovered(p, defs).collect()), key=str) == free
        held = {}
        for b, _, _, lo, hi in ranges:
            if hi < FAR:
                held.setdefault(b, set()).update(range(lo, hi + 1))
        want = {d: len(x) for d, x in held.items()}
        if far:
            want[0], want[1] = FAR + 1, FAR - 299 + len({x for x in held[1] if x < 300})
        assert {r["doc_id"]: r["covered"] for r in split.coverage(defs).collect()} == want


def test_one_document_of_very_many_pages_and_entries(spark):
    """100,000 pages and 50,000 entries: five thousand million comparisons, if each page met each entry."""
    p = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("pos"), (F.col("id") + 1).cast("int").alias("page_num"), F.lit("### -- Begin Page 1 --\nx").alias("content"))
    e = F.col("id").cast("int")
    defs = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), e.alias("entry_no"), F.lit("f").alias("filename"), (e * 2 + 1).alias("start_page"), F.when(e == 7, FAR).otherwise(e * 2 + 3).alias("end_page"))
    start = time.perf_counter()
    out = split.split_docs(p, defs)
    assert out.count() == 49_999 * 3 - 1 + 100_000 - 14
    assert split.split_uncovered(p, defs).count() == 0 and split.coverage(defs).first()["covered"] == FAR
    assert time.perf_counter() - start < 60
    counts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 1


def test_nested_and_unclosed_blocks(spark):
    body = ["### --右", "a", "### --左", "b", "### -- ", "### --", "### --", "### -- 別紙 --", "### --中", "### --下", "### --", "### ---x", "end"]
    text = ["### -- Begin Page 1 --\n" + "\n".join(body) + "\n### -- End --", "### -- Begin Page 2 --\n### --\n### --外\nx\n### --\n### -- End --", "### -- Begin Page 2 --\nplain\n### -- End --"]
    rows = spark.createDataFrame([(1, "\n\n".join(text))], "doc_id long, content string")
    got = sorted((r["page_num"], r["open_line"], r["kind"], r["close_line"], r["depth"]) for r in pages.block_spans(pages.parse_pages(rows)).collect())
    assert got == [(1, 0, "右", 5, 1), (1, 2, "左", 4, 2), (1, 8, "中", None, 1), (1, 9, "下", 10, 2), (2, 1, "外", 3, 1)]


def test_parents_of_headings(spark):
    one = "第1 争点\n1 争点1\n(1) 主張\nア 面談\n(ア) 証拠\nx\n(2) 次"
    two = "a 時刻\n第2 結語\n(1) y"
    text = "\n".join(f"### -- Begin Page {n} --\n{b}\n### -- End --" for n, b in ((1, one), (2, two)))
    rows = spark.createDataFrame([(1, text), (2, "### -- Begin Page 1 --\nア z\n### -- End --")], "doc_id long, content string")
    got = {(r["doc_id"], r["heading"]): (r["parent_page"], r["parent_line"]) for r in pages.heading_parents(pages.parse_pages(rows)).collect()}
    assert got == {(1, "第1 争点"): (None, None), (1, "1 争点1"): (1, 0), (1, "(1) 主張"): (1, 1), (1, "ア 面談"): (1, 2), (1, "(ア) 証拠"): (1, 3), (1, "(2) 次"): (1, 1), (1, "a 時刻"): (1, 6), (1, "第2 結語"): (None, None), (1, "(1) y"): (2, 1), (2, "ア z"): (None, None)}


def plain_stalled(rows, state_counts):
    rows, last, first, state, longest = sorted(rows), None, None, None, 0
    for i, (s, _, now, ok) in enumerate(rows):
        first = s if i == 0 else first
        longest = max(longest, s - (first if last is None else last))
        if ok or state_counts and (i == 0 or now is None or state is None or now != state):
            last = s
        state = now
    return rows[-1][0] - first, longest


def test_long_logs_by_ranges(spark):
    random.seed(6)
    rows = [(i, random.choice([1, 1, 1, 2, 3]), random.randint(0, 50_000), random.choice(["a", "b", None]), random.random() < 0.02) for i in range(6_000)] + [(9_999, None, 5, "a", True)]
    log = spark.createDataFrame(rows, "event_id long, job_id long, s long, state string, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jobs = {}
        for i, j, s, state, ok in rows:
            jobs.setdefault(j, []).append((s, i, state, ok))
        for counts in (False, True):
            got = {r["job_id"]: (r["waited_s"], r["longest_idle_s"]) for r in batch.stalled(log, 1, 1, state_counts=counts).collect()}
            assert got == {j: plain_stalled(x, counts) for j, x in jobs.items()}
        done = {r["event_id"]: (r["done"], r["total"], r["elapsed_s"]) for r in batch.progress(log).collect()}
        want = {i: (n + 1, len(x), s - min(x)[0]) for x in jobs.values() for n, (s, i, _, _) in enumerate(sorted(x))}
        assert done == want
        dealt = batch._by_range(log)
        ranges = {(r["job_id"], r["_range"]): r["count"] for r in dealt.groupBy("job_id", "_range").count().collect()}
        assert sum(j == 1 for j, _ in ranges) >= 8 and max(ranges.values()) < 1_200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_page_ranges_of_the_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    assert split.coverage(fx.split_defs(docs)).count() == docs.where("text is not null").count()


def test_blocks_of_ranges_are_not_broadcast(spark, tmp_path):
    """Ranges that are small as files have many blocks: they don't go through the driver."""
    ranges = spark.range(50).selectExpr("id % 5 AS doc_id", "cast(id AS int) AS entry_no", "3 AS start_page", "2000000000 - cast(id AS int) AS end_page")
    ranges.write.parquet(f"{tmp_path}/ranges")
    points = spark.range(200).selectExpr("id % 5 AS doc_id", "cast(id AS int) AS page_num")
    found = intervals.in_ranges(points, spark.read.parquet(f"{tmp_path}/ranges"), "doc_id", "page_num", "start_page", "end_page", ["page_num"])
    assert found.count() == sum(10 for i in range(200) if i >= 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
