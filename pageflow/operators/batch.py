"""Book-keeping of batch inference: pack pages into requests, read results, check, align, retry, follow progress."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.functions import text as t
from pageflow.operators.pages import marker_counts, parse_pages
from pageflow.sources.folders import new_folder
from pageflow.sources.ledger import Ledger

MIB = 1024 * 1024
NO_RESULT = "no result for this request"


def pack_pages(pages: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, batch_no, pages, num_pages): a document's pages in chunks of ``n``, batches from 1."""
    order = Window.partitionBy("doc_id").orderBy("page_num")
    numbered = pages.select("doc_id", "page_num", (F.floor((F.row_number().over(order) - 1) / n) + 1).cast("int").alias("batch_no"))
    return numbered.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list("page_num")).alias("pages"), F.count("*").cast("int").alias("num_pages"))


def request_text(batches: DataFrame, texts: DataFrame) -> DataFrame:
    """Add payload: the batch's page texts under numbers relative to the batch; a page without text gets a mark."""
    every = batches.select("doc_id", "batch_no", F.posexplode("pages").alias("i", "page_num"))
    named = every.join(texts.select("doc_id", "page_num", "text"), ["doc_id", "page_num"], "left")
    piece = F.concat(F.lit("\n### -- Begin Page "), (F.col("i") + 1).cast("string"), F.lit(" --\n"), F.coalesce(F.nullif("text", F.lit("")), F.lit(t.NOT_FOUND)), F.lit("\n### -- End --\n"))
    joined = named.groupBy("doc_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("t")))), lambda x: x["t"]), "").alias("payload"))
    return batches.join(joined, ["doc_id", "batch_no"])


def request_parts(requests: DataFrame, instruction: str, service: str = "parts") -> DataFrame:
    """Add body: the request as JSON in a service's shape: ``parts``, ``blocks`` or ``messages``.

    ``payload`` is the text; a column ``data`` (binary) with ``mime_type`` adds a file, if there.
    """
    has_file = "data" in requests.columns
    encoded = F.base64("data") if has_file else None
    if service == "parts":
        text = lambda c: F.struct(c.alias("text"))
        items = [F.to_json(text(F.lit(instruction))), F.to_json(text(F.col("payload")))]
        if has_file:
            items.append(F.when(encoded.isNotNull(), F.to_json(F.struct(F.struct(F.col("mime_type").alias("mimeType"), encoded.alias("data")).alias("inlineData")))))
        body = F.concat(F.lit('{"contents":[{"role":"user","parts":['), F.concat_ws(",", *items), F.lit("]}]}"))
    elif service in ("blocks", "messages"):
        text = lambda c: F.to_json(F.struct(F.lit("text").alias("type"), c.alias("text")))
        items = [text(F.lit(instruction)), text(F.col("payload"))]
        if has_file and service == "blocks":
            source = F.struct(F.lit("base64").alias("type"), F.col("mime_type").alias("media_type"), encoded.alias("data"))
            kind = F.when(F.col("mime_type") == "application/pdf", "document").otherwise("image")
            items.append(F.when(encoded.isNotNull(), F.to_json(F.struct(kind.alias("type"), source.alias("source")))))
        elif has_file:
            url = F.struct(F.concat(F.lit("data:"), F.col("mime_type"), F.lit(";base64,"), encoded).alias("url"))
            items.append(F.when(encoded.isNotNull(), F.to_json(F.struct(F.lit("image_url").alias("type"), url.alias("image_url")))))
        body = F.concat(F.lit('{"messages":[{"role":"user","content":['), F.concat_ws(",", *items), F.lit("]}]}"))
    else:
        raise ValueError(f"unknown service {service}")
    return requests.withColumn("body", body)


def route_by_size(requests: DataFrame, switch: int = 15 * MIB, limit: int = 19 * MIB) -> DataFrame:
    """(doc_id, job_bytes, route, inline_refused): a document's requests as one job, separators counted."""
    size = requests.groupBy("doc_id").agg((F.sum(F.octet_length("body")) + F.count("*") - 1).alias("job_bytes"))
    return size.withColumn("route", F.when(F.col("job_bytes") < switch, "inline").otherwise("file")).withColumn("inline_refused", F.col("job_bytes") > limit)


def workers(cpus: int, wanted: int | None = None) -> int:
    """How many workers to use: 1 to 8 by processors, 16 at most if asked for."""
    return max(1, min(8, cpus - 1)) if wanted is None else max(1, min(16, wanted))


def assign_workers(items: DataFrame, n: int, key: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add worker, dealt in turn within ``by`` in the order of ``key``; where a turn starts is told by a hash of ``by``.

    So the first items of all documents go to different workers.
    """
    start = F.conv(F.left(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in by])), F.lit(8)), 16, 10).cast("long")
    return items.withColumn("worker", F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1 + start, F.lit(n)).cast("int"))


def normalize_results(lines: DataFrame, column: str = "line") -> DataFrame:
    """Read result lines: adds key, text and error; blank lines are left out.

    Three shapes are read: a wrapper (``key`` or ``metadata.key``, or ``custom_id`` with an HTTP status), a bare
    response and a bare status object. A line that isn't JSON becomes an error without a key.
    """
    v = F.col("_v")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    parts = lambda path: F.array_join(F.transform(get(path, "array<struct<text:string>>"), lambda p: p["text"]), "")
    status = get("$.response.status_code", "int")
    composed = F.when(status.isNotNull() & (status != 200), F.concat(F.lit("HTTP "), status.cast("string")))
    error = F.coalesce(get("$.error.message"), F.when(get("$.error").isNotNull(), get("$.error")), composed, F.when(get("$.code").isNotNull() & get("$.message").isNotNull(), get("$.message")))
    text = F.coalesce(parts("$.response.candidates[0].content.parts"), parts("$.candidates[0].content.parts"), F.when(status == 200, get("$.response.body.choices[0].message.content")))
    rows = lines.where(t.trim(F.col(column)) != "").withColumn("_v", F.when(t.is_json(t.trim(F.col(column))), F.try_parse_json(column)))
    return (
        rows.withColumn("key", F.coalesce(get("$.key"), get("$.metadata.key"), get("$.custom_id")))
        .withColumn("error", F.when(v.isNull(), "JSON parse failed").otherwise(error))
        .withColumn("text", F.when(F.col("error").isNull(), text))
        .withColumn("error", F.when(F.col("error").isNull() & F.col("text").isNull(), "empty response").otherwise(F.col("error")))
        .drop("_v")
    )


def align_results(results: DataFrame, requests: DataFrame, order: str = "line_no") -> DataFrame:
    """(doc_id, request_no, text, error): exactly one row a request.

    ``results`` have (doc_id, key, text, error) and an order; keys are ``request-N`` or N. Keys of no request are
    left out, the last line of a key wins, and a request without a line is an error.
    """
    numbered = results.withColumn("request_no", F.regexp_extract("key", r"^(?:request-)?(\d+)\z", 1).try_cast("int"))
    last = Window.partitionBy("doc_id", "request_no").orderBy(F.desc(order))
    one = numbered.where(F.col("request_no").isNotNull()).withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1)
    joined = requests.select("doc_id", "request_no").join(one.select("doc_id", "request_no", "text", "error", F.lit(True).alias("_hit")), ["doc_id", "request_no"], "left")
    return joined.select("doc_id", "request_no", "text", F.when(F.col("_hit").isNull(), NO_RESULT).otherwise(F.col("error")).alias("error"))


def validate_batch(aligned: DataFrame, batches: DataFrame) -> DataFrame:
    """Add error_code: null for a good answer, else ERROR, BEGIN_COUNT, END_COUNT or REL_OUT_OF_RANGE."""
    joined = marker_counts(aligned.join(batches.withColumnRenamed("batch_no", "request_no"), ["doc_id", "request_no"]), "text")
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"### -- Begin Page (\d+)"), F.lit(1)), lambda n: n.try_cast("int"))
    outside = F.exists(numbers, lambda n: n.isNull() | (n < 1) | (n > F.col("num_pages")))
    code = (
        F.when(F.col("error").isNotNull() | F.col("text").isNull(), "ERROR")
        .when(F.col("n_begin") != F.col("num_pages"), "BEGIN_COUNT")
        .when(F.col("n_end") != F.col("num_pages"), "END_COUNT")
        .when(outside, "REL_OUT_OF_RANGE")
    )
    return joined.withColumn("error_code", code).drop("n_begin", "n_end")


def to_absolute(validated: DataFrame) -> DataFrame:
    """(doc_id, pos, page_num, content): pages of the good answers under the numbers that the batch had."""
    good = validated.where(F.col("error_code").isNull()).select(F.struct("doc_id", "request_no", "pages").alias("doc_id"), F.col("text").alias("content"))
    pages = parse_pages(good, strict=False, drop_errors=True)
    number = F.get(F.col("doc_id.pages"), F.col("page_num") - 1)
    return pages.select(
        "doc_id.doc_id", F.col("doc_id.request_no").alias("request_no"), "pos", number.alias("page_num"),
        F.regexp_replace("content", F.lit(r"^### -- Begin Page \d+"), F.concat(F.lit("### -- Begin Page "), number.cast("string"))).alias("content"),
    )


def in_flight(calls: Iterator[Callable], most: int) -> Iterator:
    """Results of ``calls`` in their order, ``most`` of them running at a time.

    Calls are taken from the iterator as results are taken from this one: beside those that run, at most three times as many have ended or wait
    behind a slow one. Where the reader stops, no further call starts.
    """
    if most <= 1:
        yield from (call() for call in calls)
        return
    with ThreadPoolExecutor(most) as pool:
        waiting: deque = deque()
        try:
            for call in calls:
                waiting.append(pool.submit(call))
                while len(waiting) >= 4 * most or waiting and waiting[0].done():
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for future in waiting:
                future.cancel()


def _with(rows: DataFrame, others: DataFrame, key: list[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join by ``key``; null equals null."""
    named = others.select(*[F.col(k).alias(f"_{k}") for k in key])
    return rows.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), how)


#: Answers as they are kept: what a request was is told by a hash of its payload.
ANSWERS = "doc_id long, batch_no int, request_hash long, text string, error string"


def infer(
    requests: DataFrame, fn: Callable[[int, int, str, int], str], folder: str, rounds: int = 3, attempts: int = 3, delay: float = 2.0,
    validate: Callable[[DataFrame], DataFrame] | None = None, concurrency: int = 1, tasks: int | None = None, waves: int = 1,
) -> DataFrame:
    """Run ``fn(doc_id, batch_no, payload, attempt)`` over requests: (doc_id, batch_no, text, error, round).

    A request is tried up to ``attempts`` times, waiting ``delay`` times the number of the attempt; what then
    still fails goes to the next round. ``validate`` gets a round's answers (doc_id, batch_no, text, error) and returns them with
    ``error_code``, as ``validator`` does: an answer with a code isn't good and goes to the next round, too; in the last round the code
    becomes its error. Filter ``requests`` first: every row is inferred; rows equal in all three columns are one request.

    A task has ``concurrency`` requests in flight, in threads: ``fn`` must bear that. With ``tasks`` given, so many tasks at most run, so
    that tasks times concurrency is what a service sees at once.

    Answers are written to ``folder`` and a mark then says that they are whole. Run again with the same folder, after a failure or with more
    or changed requests, this asks only what has no answer under a mark: no request of equal payload is inferred twice in a round.
    A round may be dealt to ``waves``, each with its own mark, so that less is lost in the middle of a long one.

    The requests are made once a run and kept in ``folder``, too, as are the answers that a round ends with: what is still to be asked is
    told by keys, and texts are moved only where they are asked or validated.
    """
    spark = requests.sparkSession
    key = ["doc_id", "batch_no", "request_hash"]

    def kept(rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    hashed = requests.select("doc_id", "batch_no", "payload").withColumn("request_hash", F.xxhash64(F.coalesce("payload", F.lit("")), F.col("payload").isNull()))
    whole = kept(hashed.dropDuplicates(key), f"{folder}/requests-{uuid.uuid4().hex}")
    left = whole.select(*key)

    def answered(doc: int, no: int, payload: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(1, attempts + 1):
            try:
                return fn(doc, no, payload, attempt), None
            except Exception as failed:  # the user's function may fail in any way
                error = str(failed) or type(failed).__name__
                if attempt < attempts and delay:
                    time.sleep(delay * attempt)
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calls = (partial(answered, *row) for row in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            texts, errors = zip(*in_flight(calls, concurrency), strict=True) if batch.num_rows else ((), ())
            columns = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), batch.column(3), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "batch_no", "request_hash", "text", "error"])

    def asked(number: int) -> tuple[DataFrame, bool]:
        """Answers to ``left``, those that marks of this round know and new ones for the rest, and whether there are known ones."""
        marks = Ledger(spark, f"{folder}/round-{number}/marks")
        known = [marks.get(name)["part"] for name in marks.names()]
        new: list[str] = []
        rows = lambda parts: spark.read.schema(ANSWERS).parquet(*[f"{folder}/round-{number}/{p}" for p in parts])

        for wave in range(waves):
            todo = left.where(F.pmod(F.xxhash64("doc_id", "batch_no", F.lit(number)), F.lit(waves)) == wave) if waves > 1 else left
            if known:
                todo = _with(todo, rows(known), key, "left_anti")
            if (known or new) and todo.isEmpty():
                continue
            part = f"part-{uuid.uuid4().hex}"
            texts = _with(whole, todo, key, "left_semi").select("doc_id", "batch_no", "payload", "request_hash") if known or waves > 1 or number > 1 else whole
            (texts.coalesce(tasks) if tasks else texts).mapInArrow(run, ANSWERS).write.parquet(f"{folder}/round-{number}/{part}")
            new.append(part)
            marks.put(f"{len(known) + len(new):06}-{part}.json", {"part": part, "round": number, "wave": wave, "waves": waves})
        # A new part answers just what was asked, each request once; earlier ones may know more than is asked now, and some of it twice.
        answers = [rows(new)] if new else []
        if known:
            one = _with(rows(known), left, key, "left_semi").groupBy(*key).agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "text", "error")).alias("a"))
            answers.append(one.select(*key, "a.text", "a.error"))
        return reduce(DataFrame.unionByName, answers), bool(known)

    done = None
    for number in range(1, rounds + 1):
        answers, resumed = asked(number)
        answers = answers.drop("request_hash")
        if validate:
            answers = validate(answers).withColumn("error", F.coalesce("error", "error_code")).select("doc_id", "batch_no", "text", "error")
        if validate or resumed:
            answers = kept(answers, f"{folder}/round-{number}/answers-{uuid.uuid4().hex}")
        answers = answers.withColumn("round", F.lit(number))
        good = answers.where(F.col("error").isNull())
        last = number == rounds or answers.where(F.col("error").isNotNull()).isEmpty()
        now = answers if last else good
        done = now if done is None else done.unionByName(now)
        if last:
            break
        left = _with(left, good, ["doc_id", "batch_no"], "left_anti")
    return done


def validator(batches: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``validate_batch`` in the form that ``infer`` takes: an answer needs the markers of its batch's pages."""

    def judged(answers: DataFrame) -> DataFrame:
        return validate_batch(answers.withColumnRenamed("batch_no", "request_no"), batches).withColumnRenamed("request_no", "batch_no")

    return judged


def doc_status(pages: DataFrame) -> DataFrame:
    """(doc_id, status, failed_pages): complete if no page is missing or failed. ``pages`` are all target pages."""
    failed = t.is_error(F.col("content"))
    out = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(failed, F.col("page_num")))).alias("failed_pages"))
    return out.select("doc_id", F.when(F.size("failed_pages") == 0, "complete").otherwise("error").alias("status"), "failed_pages")


def batch_counts(log: DataFrame) -> DataFrame:
    """(job_id, succeeded, failed, total)."""
    return log.groupBy("job_id").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def _by_range(log: DataFrame) -> DataFrame:
    """The log written by ranges of job and time, ``_range`` telling which: a job of very many entries has several."""
    path = new_folder(log.sparkSession, "log")
    log.repartitionByRange("job_id", "ts", "event_id").withColumn("_range", F.spark_partition_id()).write.parquet(path)  # ranges are drawn once
    return log.sparkSession.read.parquet(path)


def _carried(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``sums``, one row for each job and range."""
    named = sums.withColumnsRenamed({"job_id": "_job", "_range": "_r"})
    return rows.join(named, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("_range") == F.col("_r"))).drop("_job", "_r")


def _windows() -> tuple:
    """Of a job's ranges in order, of those before one, and of the entries within a range."""
    ranges = Window.partitionBy("job_id").orderBy("_range")
    return ranges, ranges.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("job_id", "_range").orderBy("ts", "event_id")


def progress(log: DataFrame) -> DataFrame:
    """Add done, total, elapsed_s, mean_s (whole seconds), remaining, eta_s and eta (HH:MM:SS) to a job's log.

    A job's entries are counted by ranges of time, and each range goes on where those before it end, so that no task holds a whole job.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    dealt, every = _by_range(log), Window.partitionBy("job_id")
    _, earlier, within = _windows()
    sums = dealt.groupBy("job_id", "_range").agg(F.count("*").alias("_n"), F.min(seconds).alias("_first"))
    sums = sums.select("job_id", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("total"), F.min("_first").over(every).alias("_first"))
    rows = _carried(dealt, sums).withColumn("done", F.col("_before") + F.row_number().over(within))
    rows = rows.withColumn("elapsed_s", seconds - F.col("_first")).withColumn("remaining", F.col("total") - F.col("done"))
    rows = rows.withColumn("mean_s", F.floor(F.col("elapsed_s") / F.col("done"))).withColumn("eta_s", F.floor(F.col("elapsed_s") * F.col("remaining") / F.col("done")))
    return rows.withColumn("eta", clock(F.col("eta_s"))).select(*log.columns, "done", "total", "elapsed_s", "remaining", "mean_s", "eta_s", "eta")


def stalled(log: DataFrame, max_wait_s: int, max_idle_s: int, state_counts: bool = False, as_of: Column | None = None, ended: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, waited_s, longest_idle_s, over_wait, over_idle). ``state_counts``: a change of state is progress too.

    With ``as_of``, a timestamp, jobs wait until then: the silence after a job's last progress counts, unless its last state is one of
    ``ended``. Entries after ``as_of`` don't count. A job is followed by ranges of time, each of which starts from the last state and
    progress of those before it, so that no task holds a whole job.
    """
    if as_of is not None:
        log = log.where(F.col("ts").cast("timestamp") <= as_of)
    ranges, earlier, within = _windows()
    dealt = _by_range(log).withColumn("_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    moved = F.col("ok")
    if state_counts:
        last = dealt.groupBy("job_id", "_range").agg(F.max_by(F.struct("state"), F.struct("ts", "event_id")).alias("_state"))
        dealt = _carried(dealt, last.select("job_id", "_range", F.lag("_state").over(ranges).alias("_entry")))
        dealt = dealt.withColumn("_before", F.coalesce(F.lag(F.struct("state")).over(within), F.col("_entry")))
        moved = moved | F.coalesce(F.col("state") != F.col("_before.state"), F.lit(True))
    marked = dealt.withColumn("_p", moved)
    sums = marked.groupBy("job_id", "_range").agg(F.min("_s").alias("_first"), F.max(F.when(F.col("_p"), F.col("_s"))).alias("_moved"))
    carried = sums.select("job_id", "_range", F.min("_first").over(Window.partitionBy("job_id")).alias("_first"), F.max("_moved").over(earlier).alias("_moved"))
    here = F.last(F.when(F.col("_p"), F.col("_s")), True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    moves = _carried(marked, carried).withColumn("_last", F.coalesce(here, "_moved", "_first"))
    waited, longest = F.max("_s") - F.min("_s"), F.max("_idle")
    if as_of is not None:
        now = F.unix_seconds(as_of)
        over = F.coalesce(F.max_by("state", F.struct("ts", "event_id")).isin(*ended), F.lit(False)) if ended else F.lit(False)
        silence = now - F.coalesce(F.max(F.when(F.col("_p"), F.col("_s"))), F.min("_s"))
        waited, longest = F.when(over, waited).otherwise(now - F.min("_s")), F.when(over, longest).otherwise(F.greatest(longest, silence))
    out = moves.withColumn("_idle", F.col("_s") - F.col("_last")).groupBy("job_id").agg(waited.alias("waited_s"), longest.alias("longest_idle_s"))
    return out.withColumn("over_wait", F.col("waited_s") > max_wait_s).withColumn("over_idle", F.col("longest_idle_s") > max_idle_s)


def request_sets(requests: DataFrame, by: str = "doc_id", of: tuple[str, ...] = ("doc_id", "pages", "payload")) -> DataFrame:
    """(``by``, request_count, request_set) of each job: how many requests it has, and a fingerprint of which.

    The fingerprint is the sum and the exclusive or of 64-bit hashes of the columns ``of``: it doesn't depend on the order of requests or on how they
    are numbered, changes with any page list or payload, and is added up before the shuffle. Repeated requests count as often as they occur.
    """
    h = F.xxhash64(*of, *[F.col(c).isNull() for c in of])
    fingerprint = F.struct(F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum"), F.bit_xor(h).alias("xor"))
    return requests.groupBy(by).agg(F.count("*").alias("request_count"), fingerprint.alias("request_set"))


def resumable(jobs: DataFrame, log: DataFrame, ended=("failed", "cancelled", "expired")) -> DataFrame:
    """(job_id, state, resumable, count_matches): a saved job is used again unless it ended badly or its requests changed.

    ``jobs`` have (job_id, request_count, pending_count). If they also have request_set and pending_set, as ``request_sets`` makes them, the requests must be the same, not
    as many only, and the result has set_matches.
    """
    latest = log.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    count = F.col("request_count") == F.col("pending_count")
    checked = {"request_set", "pending_set"} <= set(jobs.columns)
    same = count & F.coalesce(F.col("request_set") == F.col("pending_set"), F.lit(False)) if checked else count
    joined = jobs.join(latest, "job_id", "left")
    found = joined.select("job_id", "state", (same & F.coalesce(~F.col("state").isin(*ended), F.lit(True))).alias("resumable"), count.alias("count_matches"), same.alias("set_matches"))
    return found if checked else found.drop("set_matches")


def resume(saved: DataFrame, pending: DataFrame, log: DataFrame, by: str = "doc_id", of: tuple[str, ...] = ("doc_id", "pages", "payload"), ended=("failed", "cancelled", "expired")) -> DataFrame:
    """``resumable`` for the requests that saved jobs were made of and those that are pending now; a row for each saved job.

    A job of which nothing is pending any more has a pending_count of 0 and doesn't match.
    """
    now = request_sets(pending, by, of).select(by, F.col("request_count").alias("pending_count"), F.col("request_set").alias("pending_set"))
    jobs = request_sets(saved, by, of).join(now, by, "left").withColumn("pending_count", F.coalesce("pending_count", F.lit(0)))
    return resumable(jobs.withColumnRenamed(by, "job_id"), log, ended)
