"""Streaming forms: results and documents that arrive as files, and the progress of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageflow.operators.batch import normalize_results
from pageflow.operators.merge import merge_pages
from pageflow.operators.pages import parse_pages, remove_blank
from pageflow.sources.table import Table


def stream_results(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Result lines as they arrive, one for each file and key within ``late`` of arrival: the first. For the last, see ``upsert``.

    Keys are unique in a file only, so ``file`` is a part of the identity. Lines without a key, as those that can't be read, are told
    apart by their text.
    """
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.current_timestamp().alias("arrived"))
    read = normalize_results(lines).withColumn("_id", F.coalesce(F.concat(F.lit("k"), "key"), F.concat(F.lit("l"), F.sha2("line", 256))))
    return read.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["file", "_id"]).drop("_id")


_LAST = "job string, key string, text string, error string, revision int"


class LastLine(StatefulProcessor):
    """Keeps the last line of a key and gives it out when it is a new one."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "place string, revision int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            row = frame.loc[frame["place"].idxmax()]
            if best is None or row["place"] > best["place"]:
                best = row
        place, revision = self.last.get() if self.last.exists() else ("", 0)
        if best is not None and best["place"] > place:
            self.last.update((best["place"], revision + 1))
            yield pd.DataFrame({"job": [key[0]], "key": [key[1]], "text": [best["text"]], "error": [best["error"]], "revision": [revision + 1]})

    def close(self) -> None:
        pass


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the number of a line in its task behind its place: a task has a block's lines in their order."""
    n = 0
    for batch in batches:
        places = [f"{at}|{n + i:019}" for i, at in enumerate(batch.column(2).to_pylist())]
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.string())], ["line", "job", "place"])


def stream_last_results(spark: SparkSession, folder: str, job: str = r"([^/]+?)(?:\.[^./]*)*$", ttl: str = "7 days", files: int = 1_000) -> DataFrame:
    """(job, key, text, error, revision) in update mode: the last line of each key, and a row of the next revision whenever a later one comes.

    ``job`` is a pattern that takes a job's name from a file's path, so that files of one job, as the pieces of an answer that was fetched
    again, correct each other. Lines are ordered by their files' times of change, then names, then places in the file. A key that nothing has come for within ``ttl`` is forgotten: a
    line that comes then begins with revision 1. Lines without a key are left out: ``stream_results`` has them. Needs the RocksDB state store, and to end by
    itself (``availableNow``) ``spark.sql.streaming.noDataMicroBatches.enabled`` off, as what forgets by the clock is never done.
    """
    meta = F.col("_metadata")
    stream = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    at = F.concat_ws("|", F.date_format(meta["file_modification_time"], "yyyyMMddHHmmssSSSSSS"), meta["file_path"], F.lpad(meta["file_block_start"].cast("string"), 19, "0"))
    lines = stream.select(F.col("value").alias("line"), F.regexp_extract(meta["file_path"], job, 1).alias("job"), at.alias("at")).mapInArrow(_numbered, "line string, job string, place string")
    read = normalize_results(lines).where(F.col("key").isNotNull()).select("job", "key", "text", "error", "place")
    seconds = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{ttl}')").first()[0]
    return read.groupBy("job", "key").transformWithStateInPandas(LastLine(seconds), _LAST, "Update", "ProcessingTime")


def upsert(stream: DataFrame, folder: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64, output: str = "append"):
    """Start a query that keeps the last row of each key, by ``order``, in a ``Table`` in ``folder``.

    A micro-batch reads and writes only the buckets that its keys fall into, and readers see all of it or nothing. The table knows the
    last batch of each ``checkpoint``: one that is run again after a failure isn't applied twice. Keys that are null are one key.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, folder, keys, buckets)
        if table.manifest()["tags"].get(checkpoint, -1) >= number:
            return
        rest = [c for c in batch.columns if c not in keys]
        last = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
        table.commit(last(batch), lambda old, new: last(old.unionByName(new)), {checkpoint: number})

    return stream.writeStream.foreachBatch(merge).outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(log: DataFrame, late: str = "1 day", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(job_id, window, done, failed) of a streamed log (job_id, ts, ok) in tumbling or sliding windows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return log.withWatermark("ts", late).groupBy(window, "job_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))


def stream_rates(log: DataFrame, late: str = "1 day", length: str = "1 hour") -> DataFrame:
    """(job_id, window, done, failed, per_minute) in append mode: each window once, when the watermark has passed its end.

    The watermark is ``late`` behind the newest entry of the micro-batches before. An entry whose window has ended by then is dropped, and
    ``late_rows`` tells how many were; one that is older than the watermark in a window that hasn't ended counts. The rate is of all entries.
    """
    counted = stream_progress(log, late, length)
    minutes = (F.unix_micros("window.end") - F.unix_micros("window.start")) / 60_000_000
    return counted.withColumn("per_minute", (F.col("done") + F.col("failed")) / minutes)


def late_rows(query) -> int:
    """Rows that a query has dropped for being late, by the progress that it remembers."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def stream_bursts(log: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(job_id, window, n): closed runs of entries with no silence longer than ``gap``."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "job_id").agg(F.count("*").alias("n"))


class Silence(StatefulProcessor):
    """Emits a job when event time passes its last entry by the limit."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(r["ts"].max().value // 1_000_000) for r in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.limit_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.limit_ms)
        yield pd.DataFrame({"job_id": pd.Series(dtype="int64"), "silent_since": pd.Series(dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "silent_since": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def stream_stalled(log: DataFrame, limit_ms: int, late: str = "1 hour") -> DataFrame:
    """(job_id, silent_since) as soon as the watermark shows a job silent for ``limit_ms``. Needs the RocksDB state store."""
    keyed = log.withWatermark("ts", late).select("job_id", "ts").groupBy("job_id")
    return keyed.transformWithStateInPandas(Silence(limit_ms), "job_id long, silent_since timestamp", "Append", "EventTime")


class SeenIds:
    """Ids that were seen, in buckets by hash, with a Bloom filter for each bucket.

    A look-up reads the filters of the buckets that its ids fall into, whose size is set by ``expected`` ids and doesn't grow, and of the ids themselves only
    the buckets that may hold one of them. Ids are appended; nothing that is there is read for that.
    """

    PROBES = 5

    def __init__(self, spark: SparkSession, folder: str, expected: int = 10_000_000, buckets: int = 256):
        self.ids = Table(spark, f"{folder}/ids", ["doc_id"], buckets)
        self.filters = Table(spark, f"{folder}/filters", ["bucket"], buckets)
        self.bits = 64 << max(0, (10 * expected // (64 * self.ids.buckets)).bit_length())

    def _probes(self, ids: DataFrame) -> DataFrame:
        """(doc_id, bucket, word, bit) of each probe; ids that are null are one id."""
        place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(self.bits))
        probe = F.explode(F.array(*[place(i) for i in range(1, self.PROBES + 1)]))
        rows = ids.select("doc_id", self.ids.bucket().alias("bucket"), probe.alias("p"))
        return rows.select("doc_id", "bucket", (F.col("p") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("bit"))

    def candidates(self, ids: DataFrame) -> set[int]:
        """Buckets that may hold one of ``ids``."""
        probes = self._probes(ids)
        filters = self.filters.read(self.filters.touched(probes))
        if filters is None:
            return set()
        met = probes.join(filters.select("bucket", "word", "bits"), ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        hit = met.groupBy("bucket", F.struct("doc_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") == self.PROBES)
        return {r[0] for r in hit.select("bucket").distinct().collect()}

    def fresh(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose doc_id wasn't seen."""
        may = self.candidates(rows.select("doc_id").distinct())
        if not may:
            return rows
        known = self.ids.read(may).select(F.col("doc_id").alias("_seen")).distinct()
        return rows.join(known, F.col("doc_id").eqNullSafe(F.col("_seen")), "left_anti")

    def done(self, source: str) -> int:
        """The last number that ``add`` was given for a source, -1 if none."""
        return self.ids.manifest()["tags"].get(source, -1)

    def add(self, ids: DataFrame, source: str, number: int) -> None:
        """Remember ids. Filters come first: what only they know is looked up in vain, and nothing else."""
        words = lambda rows: rows.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        new = words(self._probes(ids).withColumnRenamed("bit", "bits")).select("bucket", "word", "bits")
        self.filters.commit(new, lambda old, rows: words(old.unionByName(rows)).select("bucket", "word", "bits"))
        self.ids.append(ids.select("doc_id"), {source: number})


def stream_documents(docs: DataFrame, folder: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame] = remove_blank, expected: int = 10_000_000):
    """Start a query that applies an operator on documents (doc_id, content) to each micro-batch and appends the rows.

    Windows in document order aren't allowed on streams; inside a micro-batch they are. A document is taken
    once, by doc_id: the first file that brings it counts, later ones are left out (see ``SeenIds``; ``expected`` is how many documents are). A batch that is
    run again overwrites its own folder, or does nothing if its ids were kept already.
    """

    def apply(batch: DataFrame, number: int) -> None:
        seen = SeenIds(batch.sparkSession, f"{folder}_seen", expected)
        if seen.done(checkpoint) >= number:
            return
        new = seen.fresh(batch.dropDuplicates(["doc_id"])).persist()
        try:
            operator(new).write.mode("overwrite").parquet(f"{folder}/batch={number}")
            seen.add(new, checkpoint, number)
        finally:
            new.unpersist()

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_documents(docs: DataFrame) -> DataFrame:
    """For ``stream_documents``: flowing text of each document."""
    return merge_pages(parse_pages(docs))
