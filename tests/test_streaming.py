import os
from datetime import datetime

from pyspark.sql import functions as F

from pageflow.operators import batch
from pageflow.operators.pages import remove_blank
from pageflow.sources import fixtures as fx
from pageflow.sources.table import Table
from pageflow.streaming import streams


def drain(df, path, mode="append"):
    name = "out_" + str(abs(hash(str(path))))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_results_once_a_key_and_last_wins(spark, tmp_path):
    good = lambda key, text: '{"key":"%s","response":{"candidates":[{"content":{"parts":[{"text":"%s"}]}}]}}' % (key, text)
    files = {"one": [good("a", "one"), '{"key":"b","error":{"message":"no"}}', good("a", "two"), "  ", "{oops", "{worse", "{oops"], "two": [good("a", "three")]}
    (tmp_path / "in").mkdir()
    for name, lines in files.items():
        (tmp_path / "in" / name).write_text("\n".join(lines))
    out = drain(streams.stream_results(spark, f"{tmp_path}/in"), tmp_path)
    assert sorted((r["key"] or "-", r["text"] or r["line"]) for r in out.collect()) == [("-", "{oops"), ("-", "{worse"), ("a", "one"), ("a", "three"), ("b", files["one"][1])]
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, "a", 2), (4, "b", 1)], "n int, key string, at int")
    rows.repartition(4, "n").write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    streams.upsert(stream, f"{tmp_path}/table", ["key"], "at", f"{tmp_path}/ck2").awaitTermination(120)
    assert {r["key"]: r["n"] for r in Table(spark, f"{tmp_path}/table", ["key"]).read().collect()} == {"a": 2, "b": 4}
    more = spark.createDataFrame([(5, "b", 9)], rows.schema)
    more.write.parquet(f"{tmp_path}/more")
    again = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/more")
    for checkpoint in ("ck3", "ck4"):  # the second run meets what the first has staged under the same number
        streams.upsert(again, f"{tmp_path}/table", ["key"], "at", f"{tmp_path}/{checkpoint}").awaitTermination(120)
    assert Table(spark, f"{tmp_path}/table", ["key"]).read().count() == 2


def test_progress_and_silence(spark, sf001, tmp_path):
    log = fx.progress_log(spark.read.parquet(f"{sf001}/events.parquet")).orderBy("ts")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = lambda: spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    out = drain(streams.stream_progress(stream(), late="0 seconds"), tmp_path / "p", "complete")
    want = log.groupBy(F.window("ts", "1 hour"), "job_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.select(*out.columns).collect()))
    sliding = drain(streams.stream_progress(stream(), late="0 seconds", slide="30 minutes"), tmp_path / "w", "complete")
    wide = log.groupBy(F.window("ts", "1 hour", "30 minutes"), "job_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    assert sorted(map(str, sliding.collect())) == sorted(map(str, wide.select(*sliding.columns).collect()))
    bursts = drain(streams.stream_bursts(stream(), "12 hours", "0 seconds"), tmp_path / "b")
    assert 0 < bursts.count() <= log.count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        quiet = drain(streams.stream_stalled(stream(), 6 * 3600 * 1000, "0 seconds"), tmp_path / "s").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {r["job_id"]: r["t"] for r in log.groupBy("job_id").agg(F.max("ts").alias("t")).collect()}
    newest = max(last.values())
    assert {r["job_id"] for r in quiet} == {j for j, x in last.items() if (newest - x).total_seconds() >= 6 * 3600}


def test_documents_by_micro_batch(spark, sf001, tmp_path):
    docs = fx.paged_docs(spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text"))
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    streams.stream_documents(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    docs.limit(20).write.mode("append").parquet(f"{tmp_path}/docs")  # repeats in a later micro-batch
    streams.stream_documents(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    got, want = spark.read.parquet(f"{tmp_path}/out").drop("batch"), remove_blank(docs)
    key = ["doc_id", "page_num", "content"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answer(key, text=None, error=None):
    import json

    return json.dumps({"key": key} | ({"error": {"message": error}} if error else {"response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}}))


def test_last_lines_equal_the_batch_table(spark, tmp_path):
    """Three files of a job that come one after the other; later lines correct earlier ones."""
    files = [
        [answer("request-1", "one"), answer("request-2", error="quota"), answer("request-1", "one again"), "{broken"],
        [answer("request-2", "two"), answer("request-3", "three"), answer("request-9", "of no request")],
        [answer("request-3", error="late"), answer("request-1", "one at last"), answer("request-1", "last of all")],
    ]
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # what forgets by the clock has no last batch otherwise
    rows = []
    try:
        for n, lines in enumerate(files):
            path = tmp_path / "in" / f"7.{n}.jsonl"
            path.write_text("\n".join(lines))
            os.utime(path, (1_700_000_000 + 100 * n,) * 2)
            stream = streams.stream_last_results(spark, f"{tmp_path}/in")
            found = []
            query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _, found=found: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            assert query.awaitTermination(60)
            rows.append(sorted((r["job"], r["key"], r["text"], r["error"], r["revision"]) for r in found))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert rows == [
        [("7", "request-1", "one again", None, 1), ("7", "request-2", None, "quota", 1)],
        [("7", "request-2", "two", None, 2), ("7", "request-3", "three", None, 1), ("7", "request-9", "of no request", None, 1)],
        [("7", "request-1", "last of all", None, 2), ("7", "request-3", None, "late", 2)],
    ]
    last = {r[1]: r for batch_rows in rows for r in batch_rows}
    table = spark.createDataFrame([(7, k, r[2], r[3], 1) for k, r in last.items()], "doc_id long, key string, text string, error string, line_no int")
    requests = spark.createDataFrame([(7, n) for n in (1, 2, 3, 4)], "doc_id long, request_no int")
    lines = spark.createDataFrame([(7, n, x) for n, x in enumerate(x for f in files for x in f)], "doc_id long, line_no int, line string")
    want = batch.align_results(batch.normalize_results(lines), requests)
    assert sorted(map(str, batch.align_results(table, requests).collect())) == sorted(map(str, want.collect()))


def test_windows_are_given_once_and_late_rows_dropped(spark, tmp_path):
    """The watermark is ten minutes behind the newest entry of earlier files."""
    at = lambda h, m: datetime(2024, 5, 1, h, m)
    files = [
        [(1, at(10, 5), True), (1, at(10, 50), True), (2, at(10, 59), False), (1, at(11, 20), False)],  # then the watermark is 11:10
        [(1, at(10, 30), True), (2, at(10, 59), True), (1, at(11, 5), True)],  # 10:30 and 10:59: their window has ended; 11:05: it hasn't
        [(1, at(13, 0), True)],  # 12:50
        [(1, at(12, 10), True), (1, at(12, 55), True), (3, at(11, 59), True)],  # 11:59 is late, the window of 12:10 hasn't ended
        [(9, at(20, 0), True)],
        [(9, at(20, 1), True)],
    ]
    (tmp_path / "in").mkdir()
    schema = "job_id long, ts timestamp, ok boolean"
    query, dropped = None, []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        rates = streams.stream_rates(stream, "10 minutes", "1 hour")
        query = rates.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(240)
        dropped.append(streams.late_rows(query))
    assert sum(dropped[:3]) == 2 and dropped[3] == 1 and sum(dropped) == 3
    out = spark.read.parquet(f"{tmp_path}/out").select("job_id", F.hour("window.start").alias("h"), "done", "failed", F.round("per_minute", 4).alias("r"))
    assert sorted(map(tuple, out.collect())) == [(1, 10, 2, 0, 0.0333), (1, 11, 1, 1, 0.0333), (1, 12, 2, 0, 0.0333), (1, 13, 1, 0, 0.0167), (2, 10, 0, 1, 0.0167)]


def test_reading_of_ids_does_not_grow(spark, tmp_path):
    seen = streams.SeenIds(spark, f"{tmp_path}/seen", expected=20_000, buckets=32)
    read, filters = [], []
    for n in range(8):
        ids = spark.range(n * 1_000, (n + 1) * 1_000).select(F.col("id").alias("doc_id"))
        read.append(len(seen.candidates(ids)))
        assert seen.fresh(ids).count() == 1_000
        seen.add(ids, "s", n)
        filters.append(sum(len(x) for x in seen.filters.manifest()["buckets"].values()))
    assert max(read) <= 12 and filters == filters[:1] * 8 and seen.done("s") == 7
    again = spark.createDataFrame([(5,), (999_999,), (7_999,)], "doc_id long")
    assert [r[0] for r in seen.fresh(again).collect()] == [999_999]
    assert len(seen.candidates(again)) <= 3
    none = spark.createDataFrame([(None,), (3,)], "doc_id long")
    assert [r[0] for r in seen.fresh(none).collect()] == [None]
    seen.add(none.where("doc_id is null"), "s", 8)
    assert seen.fresh(none).count() == 0


def test_a_batch_that_was_kept_is_not_applied_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"### -- Begin Page 1 --\nbody of document {i}\n### -- End --") for i in range(6)], "doc_id long, content string")
    docs.write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")
    streams.stream_documents(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    want = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    commits = tmp_path / "ck/commits"
    for f in commits.iterdir():  # as if the driver had died before it could note the batch
        f.unlink()
    streams.stream_documents(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == want and len(want) == 6


def test_appended_buckets_are_put_together(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", ["k"], 2)
    for n in range(7):
        t.append(spark.createDataFrame([(n, "a"), (n + 100, "b")], "k long, v string"), {"n": n}, most=3)
    assert t.read().count() == 14 and max(len(x) for x in t.manifest()["buckets"].values()) <= 3
