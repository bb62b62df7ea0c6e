"""Inference that goes on after a failure, request sets, and commits of whole tables."""

import time

import pytest
from pyspark.sql import functions as F

from pageflow.operators import batch
from pageflow.sources import io as files
from pageflow.sources import table as tables
from pageflow.sources.ledger import Ledger


def requests(spark, n, payload="p"):
    return spark.createDataFrame([(i, 1, f"{payload}{i}") for i in range(n)], "doc_id long, batch_no int, payload string")


def counted(folder):
    """A service that keeps a file for each call."""

    def fn(doc, no, payload, attempt):
        (folder / f"{payload}-{time.time_ns()}").touch()
        if (folder / "down").exists() and doc >= 10:
            raise RuntimeError("down")
        return payload.upper()

    return fn


def calls(folder):
    return sorted(p.name.split("-")[0] for p in folder.iterdir() if p.name != "down")


def test_infer_goes_on_where_it_was_killed(spark, tmp_path, monkeypatch):
    seen, folder = tmp_path / "seen", f"{tmp_path}/rounds"
    seen.mkdir()
    (seen / "down").touch()
    df, fn = requests(spark, 20), counted(seen)
    put = Ledger.put

    def die_in_round_2(self, name, value):
        if value.get("round") == 2:
            raise KeyboardInterrupt
        return put(self, name, value)

    monkeypatch.setattr(Ledger, "put", die_in_round_2)
    with pytest.raises(KeyboardInterrupt):
        batch.infer(df, fn, folder, rounds=3, attempts=1, delay=0)
    monkeypatch.setattr(Ledger, "put", put)
    assert calls(seen) == sorted([f"p{i}" for i in range(20)] + [f"p{i}" for i in range(10, 20)])  # round 1, and round 2 of the failed ones
    (seen / "down").unlink()
    before = len(calls(seen))
    out = batch.infer(df, fn, folder, rounds=3, attempts=1, delay=0).collect()
    assert sorted((r["doc_id"], r["text"], r["round"]) for r in out) == [(i, f"P{i}", 1 if i < 10 else 2) for i in range(20)]
    assert len(calls(seen)) == before + 10  # round 2 had no mark, so its ten are asked again; none of round 1
    assert sorted(map(str, batch.infer(df, fn, folder, rounds=3, attempts=1, delay=0).collect())) == sorted(map(str, out))
    assert len(calls(seen)) == before + 10


def test_infer_asks_only_new_and_changed_requests(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    fn, folder = counted(seen), f"{tmp_path}/rounds"
    batch.infer(requests(spark, 6), fn, folder, rounds=1, delay=0).collect()
    changed = requests(spark, 8).withColumn("payload", F.when(F.col("doc_id") == 2, "other").otherwise(F.col("payload"))).where("doc_id <> 0")
    out = batch.infer(changed, fn, folder, rounds=1, delay=0)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "P1", 2: "OTHER", 3: "P3", 4: "P4", 5: "P5", 6: "P6", 7: "P7"}
    assert calls(seen) == sorted([f"p{i}" for i in range(8)] + ["other"])


def test_infer_makes_its_requests_once(spark, tmp_path):
    made, seen = tmp_path / "made", tmp_path / "seen"
    made.mkdir(), seen.mkdir()

    def make(batches):
        for batch_ in batches:
            for x in batch_.column(0).to_pylist():
                (made / f"{x}-{time.time_ns()}").touch()
            yield batch_

    fn = counted(seen)
    (seen / "down").touch()
    df = requests(spark, 20).mapInArrow(make, "doc_id long, batch_no int, payload string")
    judged = lambda answers: answers.withColumn("error_code", F.when(F.col("doc_id") == 3, "BAD"))
    out = batch.infer(df.unionByName(requests(spark, 5)), fn, f"{tmp_path}/rounds", rounds=3, attempts=1, delay=0, validate=judged).collect()
    assert {r["doc_id"]: (r["error"], r["round"]) for r in out} == {i: ("BAD" if i == 3 else "down" if i >= 10 else None, 3 if i == 3 or i >= 10 else 1) for i in range(20)}
    assert len(list(made.iterdir())) == 20
    assert calls(seen) == sorted([f"p{i}" for i in range(20)] + 2 * [f"p{i}" for i in [3, *range(10, 20)]])  # equal requests are asked once


def test_infer_keeps_the_waves_that_ended(spark, tmp_path, monkeypatch):
    seen, folder, put = tmp_path / "seen", f"{tmp_path}/rounds", Ledger.put
    seen.mkdir()

    def die_in_the_third(self, name, value):
        if value.get("wave") == 2:
            raise KeyboardInterrupt
        return put(self, name, value)

    monkeypatch.setattr(Ledger, "put", die_in_the_third)
    df, fn = requests(spark, 40), counted(seen)
    with pytest.raises(KeyboardInterrupt):
        batch.infer(df, fn, folder, delay=0, waves=4)
    monkeypatch.setattr(Ledger, "put", put)
    first = calls(seen)
    out = batch.infer(df, fn, folder, delay=0, waves=4)
    assert out.count() == 40 and len(set(calls(seen))) == 40 and 40 < len(calls(seen)) < 40 + len(first)


def test_infer_has_several_requests_in_flight(spark, tmp_path):
    df = requests(spark, 48).coalesce(1)

    def slow(doc, no, payload, attempt):
        time.sleep(0.25)
        if doc == 5:
            raise RuntimeError("no")
        return payload.upper()

    took = {}
    for n in (1, 12):
        start = time.perf_counter()
        out = batch.infer(df, slow, f"{tmp_path}/{n}", rounds=1, attempts=1, delay=0, concurrency=n, tasks=1)
        took[n] = time.perf_counter() - start
        assert {r["doc_id"]: (r["text"], r["error"]) for r in out.collect()} == {i: (None, "no") if i == 5 else (f"P{i}", None) for i in range(48)}
    assert took[12] < took[1] / 3


def test_calls_wait_for_their_reader():
    started = []

    def call(i):
        def run():
            started.append(i)
            time.sleep(0.05 if i % 5 == 0 else 0)
            return i

        return run

    results = batch.in_flight((call(i) for i in range(1000)), 4)
    assert [next(results) for _ in range(10)] == list(range(10))
    time.sleep(0.2)
    assert len(started) <= 10 + 16
    results.close()
    assert len(started) <= 10 + 16
    assert list(batch.in_flight((call(i) for i in range(50)), 4)) == list(range(50))


def test_request_sets(spark):
    schema = "doc_id long, batch_no int, pages array<int>, payload string"
    saved = spark.createDataFrame([(1, 1, [1, 2], "a"), (1, 2, [3], "b"), (2, 1, [1], "x"), (2, 2, [2], "x"), (3, 1, [1], "y"), (4, 1, [1], None), (5, 1, [1], "z"), (5, 2, [1], "z"), (6, 1, [1], "q")], schema)
    now = spark.createDataFrame([(1, 1, [3], "b"), (1, 2, [1, 2], "a"), (2, 1, [1], "x"), (2, 2, [3], "x"), (3, 1, [1], "Y"), (4, 1, [1], ""), (5, 1, [1], "z"), (5, 2, [2], "z")], schema)
    log = spark.createDataFrame([(1, 1, 5, "running"), (2, 2, 5, "running"), (3, 6, 5, "failed")], "event_id long, job_id long, ts long, state string")
    got = {r["job_id"]: (r["count_matches"], r["set_matches"], r["resumable"]) for r in batch.resume(saved, now, log).collect()}
    assert got == {1: (True, True, True), 2: (True, False, False), 3: (True, False, False), 4: (True, False, False), 5: (True, False, False), 6: (False, False, False)}
    assert batch.resume(saved, saved, log).where("job_id = 6").first()["resumable"] is False
    many = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.array(F.col("id")).alias("pages"), F.lit("p").alias("payload"))
    assert batch.request_sets(many).collect() == batch.request_sets(many.repartition(7)).collect()


def status_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, content string, status string")


def test_commits_are_whole_or_nothing(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/out"
    assert files.read_written(spark, folder) is None
    first = status_of(spark, [(i, f"old{i}", "error") for i in range(50)] + [(None, "null", "error")])
    assert files.write_paged(first, first, folder, buckets=8) == 1
    before = files.read_written(spark, folder)
    new = status_of(spark, [(i, f"new{i}", "complete") for i in range(0, 50, 2)] + [(99, "added", "complete")])
    put = Ledger.put
    monkeypatch.setattr(Ledger, "put", lambda *a: (_ for _ in ()).throw(OSError("the driver dies here")))
    with pytest.raises(OSError, match="dies"):
        files.write_paged(new, new, folder)
    monkeypatch.setattr(Ledger, "put", put)
    content = lambda df: {r["doc_id"]: (r["content"], r["status"]) for r in df.collect()}
    assert content(files.read_written(spark, folder)) == content(first)
    assert files.write_paged(new, new, folder) == 2
    want = content(first) | content(new)
    assert content(files.read_written(spark, folder)) == want and content(before) == content(first)  # who has begun to read goes on
    files.write_paged(status_of(spark, [(None, "again", "complete")]), status_of(spark, [(None, "again", "complete")]), folder)
    assert files.read_written(spark, folder).where("doc_id is null").count() == 1
    assert files.paged_table(spark, folder).vacuum(keep=1) >= 1
    assert content(files.read_written(spark, folder)).keys() == want.keys()


def test_documents_without_a_status_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, content string")
    files.write_paged(docs.where("doc_id = 1").withColumn("status", F.lit("complete")), docs, f"{tmp_path}/out")
    assert {(r["doc_id"], r["status"]) for r in files.read_written(spark, f"{tmp_path}/out").collect()} == {(1, "complete"), (2, "error")}


def test_of_two_writers_both_count(spark, tmp_path, monkeypatch):
    folder, put, others = f"{tmp_path}/out", Ledger.put, []
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    mine, theirs = (tables.Table(spark, folder, ["k"], 2) for _ in range(2))
    mine.commit(rows((1, "a"), (2, "b")))

    def outrun(self, name, value):
        if not others:
            others.append(1)
            theirs.commit(rows((2, "theirs"), (3, "theirs")))
        return put(self, name, value)

    monkeypatch.setattr(Ledger, "put", outrun)
    assert mine.commit(rows((1, "mine"), (4, "mine"))) == 3
    assert {r["k"]: r["v"] for r in mine.read().collect()} == {1: "mine", 2: "theirs", 3: "theirs", 4: "mine"}
    monkeypatch.setattr(Ledger, "put", lambda *a: False)
    with pytest.raises(tables.Conflict):
        mine.commit(rows((9, "x")))


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = tables.Table(spark, f"{tmp_path}/out", ["k"], 16)
    t.commit(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    old = t.manifest()["buckets"]
    t.commit(spark.createDataFrame([(7, "b")], "k long, v string"), tags={"source": "s"})
    new = t.manifest()
    assert sum(old[b] != new["buckets"][b] for b in old) == 1 and new["tags"] == {"source": "s"}
    assert t.read().count() == 200
    t.commit(spark.createDataFrame([], "k long, v string"))
    assert t.read().count() == 200 and t.manifest()["tags"] == {"source": "s"}


def test_rows_that_differ_from_run_to_run_are_kept_whole(spark, tmp_path):
    """Buckets and rows of a commit come from one computation."""
    t = tables.Table(spark, f"{tmp_path}/out", ["k"], 64)
    t.commit(spark.range(100).select((F.rand() * 1_000_000).cast("long").alias("k"), F.lit("a").alias("v")))
    assert t.read().count() == 100 and not [p for p in (tmp_path / "out/staged").iterdir() if not p.name.startswith(".")]


def test_result_lines_are_whole_json(spark):
    lines = spark.createDataFrame([('{"key":"1","error":"e"}',), ('{"key":"2","error":"e"} more',), (' {"key":"3","error":"e"} ',), ("4 more",)], "line string")
    got = sorted((r["key"] or "", r["error"]) for r in batch.normalize_results(lines).collect())
    assert got == [("", "JSON parse failed"), ("", "JSON parse failed"), ("1", "e"), ("3", "e")]
