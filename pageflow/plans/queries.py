"""Every page, batch and naming operator applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import text as t
from pageflow.operators import batch, merge, naming, pages, split
from pageflow.sources import fixtures as fx
from pageflow.sources import io

RUN_DATE = "2024-12-31"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def parsed(spark, sf_dir) -> DataFrame:
    return pages.parse_pages(fx.paged_docs(documents(spark, sf_dir)))


def faulty(spark, sf_dir, **options) -> DataFrame:
    return pages.parse_pages(fx.faulty_docs(documents(spark, sf_dir)), **options)


def number(df: DataFrame) -> DataFrame:
    """Whole numbers as long."""
    return df.select(*[F.col(c).cast("long").alias(c) if k in ("int", "tinyint", "smallint") else F.col(c) for c, k in df.dtypes])


def digest(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(f"{name}_len", F.length(column)).withColumn(f"{name}_md5", F.md5(column)).drop(column)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows that several steps of a query read, made once."""
    path = io.new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@query
def remove_blank(spark, sf_dir):
    out = pages.remove_blank(fx.paged_docs(documents(spark, sf_dir)))
    return number(digest(out.select("doc_id", "old_page", F.col("page_num").alias("new_page"), "body"), "body", "body"))


@query
def parse_pages(spark, sf_dir):
    return number(digest(faulty(spark, sf_dir).withColumn("body", t.body_of(F.col("content"))).drop("content"), "body", "body"))


@query
def last_wins(spark, sf_dir):
    good = pages.last_wins(faulty(spark, sf_dir, strict=False, drop_errors=True))
    return number(digest(good.select("doc_id", "page_num", "pos", t.body_of(F.col("content")).alias("body")), "body", "body"))


@query
def page_markers(spark, sf_dir):
    return number(pages.page_markers(parsed(spark, sf_dir)).drop("content"))


@query
def render_dash(spark, sf_dir):
    """Pages written and read in the dash dialect."""
    body = parsed(spark, sf_dir).withColumn("content", t.body_of(F.col("content")))
    again = pages.parse_pages(pages.render_pages(body, "dash"), dialect="dash")
    return number(digest(again.drop("pos"), "content", "body"))


@query
def fill_missing(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.col("text").isNotNull())
    ranges = docs.select("doc_id", F.lit(1).alias("start_page"), F.size(F.split("text", "\n", -1)).alias("end_page"))
    filled = pages.fill_missing(pages.last_wins(faulty(spark, sf_dir, drop_errors=True)), ranges)
    return number(filled.select("doc_id", "page_num", "missing", t.is_error(F.col("content")).alias("is_error")))


@query
def flag_blank(spark, sf_dir):
    return number(pages.flag_blank(faulty(spark, sf_dir)).select("doc_id", "pos", "page_num", "is_blank", "is_error"))


@query
def renumber(spark, sf_dir):
    return number(digest(pages.renumber(faulty(spark, sf_dir)).select("doc_id", "pos", "old_page", "page_num", F.regexp_extract("content", r"^[^\n]*", 0).alias("marker")), "marker", "marker"))


@query
def select_pages(spark, sf_dir):
    return number(pages.select_pages(parsed(spark, sf_dir), 3, 7).select("doc_id", "page_num"))


@query
def has_text(spark, sf_dir):
    return number(pages.has_text(fx.page_numbers(documents(spark, sf_dir)), "text").select("doc_id", "page_num"))


@query
def page_source(spark, sf_dir):
    every = fx.page_numbers(documents(spark, sf_dir))
    embedded, ocr = every.where((F.col("doc_id") + F.col("page_num")) % 3 == 0), every.where((F.col("doc_id") + F.col("page_num")) % 4 != 1)
    return number(digest(pages.page_source(every, embedded, ocr), "text", "text"))


@query
def reflow(spark, sf_dir):
    turns = fx.conv_pages(table(spark, sf_dir, "conversations"))
    return number(digest(turns.select("doc_id", "page_num", t.reflow(F.col("text")).alias("text")), "text", "text"))


@query
def reflow_documents(spark, sf_dir):
    return number(digest(documents(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", t.reflow(F.col("text")).alias("text")), "text", "text"))


@query
def normalize_ws(spark, sf_dir):
    return number(digest(documents(spark, sf_dir).select("doc_id", t.normalize_ws(F.col("text")).alias("text")), "text", "text"))


@query
def normalize_digits(spark, sf_dir):
    wide = fx.page_numbers(documents(spark, sf_dir)).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.translate("text", t.DIGITS, t.FULL_DIGITS)).otherwise(F.col("text")))
    found = wide.withColumn("n_wide", t.full_width_digits(F.col("text"))).withColumn("text", t.normalize_digits(F.col("text")))
    return number(digest(found, "text", "text"))


@query
def annotations(spark, sf_dir):
    p = F.col("page_num")
    notes = F.concat_ws(" ", F.when(p % 2 == 0, F.concat(F.lit("(--! picture "), p.cast("string"), F.lit(")"))), F.col("text"), F.when(p % 3 == 0, "(--# margin)"), F.when(p % 4 == 0, "(--* note) (--* more)"), F.when(p % 5 == 0, "(-- as is)"), F.when(p % 6 == 0, "■■"))
    marked = fx.page_numbers(documents(spark, sf_dir)).select("doc_id", "page_num", notes.alias("content"))
    return number(pages.annotations(marked).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("n").alias("most"), F.min("text").alias("least")))


@query
def page_stats(spark, sf_dir):
    return number(pages.page_stats(faulty(spark, sf_dir)).withColumn("blank_pages", joined("blank_pages")))


@query
def page_ranges(spark, sf_dir):
    return number(pages.page_ranges(faulty(spark, sf_dir)))


@query
def marker_counts(spark, sf_dir):
    return number(pages.marker_counts(fx.faulty_docs(documents(spark, sf_dir))).drop("content"))


@query
def upsert_pages(spark, sf_dir):
    every = faulty(spark, sf_dir)
    old = every.where((F.col("doc_id") + F.col("page_num")) % 3 == 0)
    new = every.where((F.col("doc_id") + F.col("page_num")) % 2 == 0)
    return number(digest(pages.upsert_pages(old, new).select("doc_id", "page_num", "pos", t.body_of(F.col("content")).alias("body")), "body", "body"))


@query
def head_tail(spark, sf_dir):
    return number(pages.head_tail(faulty(spark, sf_dir)).select("doc_id", "pos", "page_num"))


@query
def split_docs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = split.split_docs(parsed(spark, sf_dir), fx.split_defs(docs))
    return number(out.select("doc_id", "entry_no", "filename", "old_page", "page_num", F.md5(t.body_of(F.col("content"))).alias("body_md5")))


@query
def split_missing(spark, sf_dir):
    return number(split.split_missing(faulty(spark, sf_dir), fx.split_defs(documents(spark, sf_dir))).withColumn("missing", joined("missing")))


@query
def split_uncovered(spark, sf_dir):
    return number(split.split_uncovered(parsed(spark, sf_dir), fx.split_defs(documents(spark, sf_dir))))


@query
def split_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return number(split.split_manifest(fx.split_defs(docs), docs.where(F.col("text").isNotNull()).select("doc_id", F.size(F.split("text", "\n", -1)).alias("total"))))


@query
def coverage(spark, sf_dir):
    return number(split.coverage(fx.split_defs(documents(spark, sf_dir))))


@query
def pending_pages(spark, sf_dir):
    every = fx.page_numbers(documents(spark, sf_dir)).select("doc_id", "page_num")
    return number(split.pending_pages(every, fx.done(every)))


@query
def merge_pages(spark, sf_dir):
    return number(digest(merge.merge_pages(parsed(spark, sf_dir)), "merged", "merged"))


@query
def merge_with_head(spark, sf_dir):
    """Pages behind a text without a marker, and documents without any marker."""
    text = fx.paged_docs(documents(spark, sf_dir))
    d = F.col("doc_id")
    headed = text.withColumn("content", F.when(d % 3 == 0, F.concat(F.lit("Head of "), d.cast("string"), F.lit("\n\n"), "content")).when(d % 7 == 0, F.lit("no marker")).otherwise(F.col("content")))
    return number(digest(merge.merge_pages(pages.parse_pages(headed, keep_head=True)), "merged", "merged"))


@query
def without_markers(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 != 0, F.col("text"))).select("doc_id", F.col("text").alias("content"))
    marked = fx.paged_docs(documents(spark, sf_dir).where(F.col("doc_id") % 5 == 0))
    return pages.without_markers(docs.where(F.col("doc_id") % 5 != 0).unionByName(marked))


@query
def strip_legacy(spark, sf_dir):
    """Lines parted by marks of the old form."""
    p = F.col("page_num")
    mark = F.concat(F.lit("=-- Page "), p.cast("string"), F.when(p % 3 == 0, " (Continuation)").otherwise(""), F.lit(" --=\n"))
    old = fx.page_numbers(documents(spark, sf_dir)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(p, F.concat(mark, "text").alias("t")))), lambda x: x["t"]), "\n").alias("old"))
    return number(digest(old.select("doc_id", t.strip_legacy(F.col("old")).alias("text")), "text", "text"))


@query
def read_results(spark, sf_dir):
    """Answers written as JSON lines and read again."""
    lines = fx.result_lines(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir)))
    path = io.new_folder(spark, "results")
    lines.select(F.col("line").alias("value")).write.text(path)
    rows = io.read_results_jsonl(spark, path).withColumn("text_md5", F.md5("text"))
    return rows.groupBy("key", "error", "text_md5").agg(F.count("*").alias("n"))


@query
def split_gaps(spark, sf_dir):
    """Ranges of missing pages; each document's entries and one that reaches far past its end."""
    defs = fx.split_defs(documents(spark, sf_dir))
    far = defs.where(F.col("entry_no") == 0).withColumn("entry_no", F.lit(-1)).withColumn("end_page", F.lit(2_000_000_000))
    return number(split.split_gaps(faulty(spark, sf_dir), defs.unionByName(far)))


@query
def audit_sequence(spark, sf_dir):
    return number(merge.audit_sequence(faulty(spark, sf_dir)))


@query
def audit_printed(spark, sf_dir):
    return number(merge.audit_printed(parsed(spark, sf_dir)))


@query
def find_boundaries(spark, sf_dir):
    titled = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct((i + 1).alias("p"), F.when((F.col("doc_id") + i + 1) % 4 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("line")))
    content = F.array_join(F.transform(titled, lambda x: pages.page_text(x["p"], x["line"], fx.begin_continues(x["p"]), fx.end_continues(x["p"]), fx.printed(x["p"]))), "\n\n")
    docs = documents(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", content.alias("content"))
    return number(merge.find_boundaries(pages.parse_pages(docs)))


@query
def outline(spark, sf_dir):
    p = F.col("page_num")
    head = F.when(p % 4 == 0, F.concat(F.lit("第"), p.cast("string"), F.lit(" 章"))).when(p % 4 == 1, F.concat(F.lit("("), p.cast("string"), F.lit(") x"))).when(p % 4 == 2, "### --左").otherwise("plain")
    lined = fx.page_numbers(documents(spark, sf_dir)).select("doc_id", "page_num", F.concat(head, F.lit("\n(1) "), "text", F.lit("\n"), "text").alias("content"))
    return number(digest(pages.outline(lined), "heading", "heading"))


def batches(spark, sf_dir) -> DataFrame:
    every = fx.page_numbers(documents(spark, sf_dir)).select("doc_id", "page_num")
    return batch.pack_pages(split.pending_pages(every, fx.done(every)))


@query
def pack_pages(spark, sf_dir):
    return number(batches(spark, sf_dir).withColumn("pages", joined("pages")))


@query
def request_text(spark, sf_dir):
    return number(digest(batch.request_text(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir))).select("doc_id", "batch_no", "payload"), "payload", "payload"))


@query
def request_parts(spark, sf_dir):
    made = batch.request_parts(batch.request_text(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir))), "Transcribe.")
    part = F.try_variant_get(F.try_parse_json("body"), "$.contents[0].parts[1].text", "string")
    return number(made.select("doc_id", "batch_no", (part == F.col("payload")).alias("same"), F.length(part).alias("payload_len")))


@query
def route_by_size(spark, sf_dir):
    made = batch.request_text(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir))).withColumnRenamed("payload", "body")
    return number(batch.route_by_size(made, 4_000, 8_000))


@query
def assign_workers(spark, sf_dir):
    return number(batch.assign_workers(batches(spark, sf_dir).select("doc_id", "batch_no"), batch.workers(6), "batch_no"))


def aligned(spark, sf_dir) -> DataFrame:
    b = batches(spark, sf_dir)
    lines = fx.result_lines(b, fx.page_numbers(documents(spark, sf_dir)))
    return batch.align_results(batch.normalize_results(lines), b.select("doc_id", F.col("batch_no").alias("request_no")))


@query
def normalize_results(spark, sf_dir):
    lines = fx.result_lines(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir)))
    return number(digest(batch.normalize_results(lines).drop("line"), "text", "text"))


@query
def align_results(spark, sf_dir):
    return number(digest(aligned(spark, sf_dir), "text", "text"))


@query
def validate_batch(spark, sf_dir):
    return number(batch.validate_batch(aligned(spark, sf_dir), batches(spark, sf_dir)).select("doc_id", "request_no", "error_code"))


@query
def to_absolute(spark, sf_dir):
    out = batch.to_absolute(batch.validate_batch(aligned(spark, sf_dir), batches(spark, sf_dir)))
    return number(digest(out.select("doc_id", "page_num", "content"), "content", "content"))


@query
def doc_status(spark, sf_dir):
    return number(batch.doc_status(faulty(spark, sf_dir)).withColumn("failed_pages", joined("failed_pages")))


def log(spark, sf_dir) -> DataFrame:
    return fx.progress_log(table(spark, sf_dir, "events"))


@query
def batch_counts(spark, sf_dir):
    return number(batch.batch_counts(log(spark, sf_dir)))


@query
def progress(spark, sf_dir):
    return number(batch.progress(log(spark, sf_dir)).select("event_id", "job_id", "done", "total", "elapsed_s", "mean_s", "remaining", "eta_s", "eta"))


@query
def stalled(spark, sf_dir):
    return number(batch.stalled(log(spark, sf_dir), 86_400 * 20, 86_400))


@query
def stalled_now(spark, sf_dir):
    """Silence up to a moment: jobs whose last state is ``purchase`` have ended."""
    every = log(spark, sf_dir)
    moment = F.lit(every.agg(F.max("ts")).first()[0])
    return number(batch.stalled(every, 86_400 * 20, 86_400, as_of=moment, ended=("purchase",)))


@query
def resumable(spark, sf_dir):
    entries = log(spark, sf_dir)
    jobs = entries.groupBy("job_id").agg(F.count("*").alias("request_count"), F.count_if(F.col("state") != "view").alias("pending_count"))
    jobs = jobs.withColumn("pending_count", F.when(F.col("job_id") % 2 == 0, F.col("request_count")).otherwise(F.col("pending_count")))
    return number(batch.resumable(jobs, entries, ended=("error", "purchase")))


def named(spark, sf_dir) -> DataFrame:
    return naming.parse_decision(fx.decisions(documents(spark, sf_dir), naming.TYPES), RUN_DATE)


@query
def parse_decision(spark, sf_dir):
    return number(named(spark, sf_dir).drop("raw"))


@query
def sanitize_title(spark, sf_dir):
    lines = fx.page_numbers(documents(spark, sf_dir))
    return number(lines.select("doc_id", "page_num", naming.sanitize_title(F.concat(F.lit(" ._"), F.col("text"), F.lit(":*. "))).alias("title")))


@query
def is_named(spark, sf_dir):
    files = fx.file_list(table(spark, sf_dir, "documents"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/in/2024-01-00_x_"), F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise(F.col("path"))
    return files.select("doc_id", naming.is_named(path).alias("is_named"))


@query
def excerpt(spark, sf_dir):
    return number(digest(naming.excerpt(fx.paged_docs(documents(spark, sf_dir))), "excerpt", "excerpt"))


@query
def head_tail_text(spark, sf_dir):
    return number(digest(documents(spark, sf_dir).select("doc_id", t.head_tail_text(F.col("text"), 1000).alias("excerpt")), "excerpt", "excerpt"))


@query
def excerpt_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = naming.companion_files(fx.file_list(docs), fx.existing_outputs(docs))
    preferred = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "preferred").otherwise("").alias("excerpt"))
    return naming.excerpt_source(preferred, found.select("doc_id", "kind", F.col("output").alias("excerpt")))


@query
def companion_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return number(naming.companion_files(fx.file_list(docs), fx.existing_outputs(docs)))


def wanted_names(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    files = fx.file_list(docs)
    title = F.concat(F.lit("2024-00-00_x_T"), (F.col("doc_id") % 23).cast("string"))
    return files.join(docs, "doc_id").select("path", F.concat(F.lit("/in/"), F.col("source")).alias("folder"), title.alias("name"), F.regexp_extract("path", r"\.[^.]*$", 0).alias("ext"))


@query
def unique_names(spark, sf_dir):
    """Names beside files, outputs and job states that exist already."""
    wanted = wanted_names(spark, sf_dir)
    d = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("long")
    at = lambda name, end: F.concat(F.concat_ws("/", "folder", name), end)
    there = F.array(
        F.when(d % 5 == 0, at(F.concat("name", F.lit(" (2)")), F.col("ext"))),
        F.when(d % 7 == 0, at(F.concat("name", F.lit(" (3)")), F.lit("_paged.md"))),
        F.when(d % 11 == 0, at(F.concat("name", F.lit(" (5)")), F.concat("ext", F.lit(naming.STATE)))),
        F.when(d % 13 == 0, at(F.col("name"), F.lit("_ERROR_merged.md"))),
    )
    existing = wanted.select(F.explode(F.filter(there, lambda x: x.isNotNull())).alias("target"))
    return naming.unique_names(wanted, existing)


@query
def unique_names_free(spark, sf_dir):
    """Names where nothing exists yet."""
    wanted = wanted_names(spark, sf_dir)
    return naming.unique_names(wanted, wanted.limit(0).select(F.col("path").alias("target")))


@query
def rename_plan(spark, sf_dir):
    """Renames to shared names, some of which exist, as do some outputs beside them."""
    docs = table(spark, sf_dir, "documents")
    files = fx.file_list(docs)
    pairs = files.select("path", F.when(F.col("doc_id") % 4 == 0, F.col("path")).otherwise(F.concat(F.lit("/out/"), (F.col("doc_id") % 50).cast("string"), F.lit(".pdf"))).alias("target"))
    no = F.col("doc_id") % 50
    out = lambda base, end: F.concat(F.lit(base), no.cast("string"), F.lit(end))
    there = F.array(F.when(no % 5 == 0, out("/OUT/", ".PDF")), F.when(no % 7 == 0, out("/out/", "_merged.md")))
    taken = docs.select(F.explode(F.filter(there, lambda x: x.isNotNull())).alias("path"))
    return naming.rename_plan(pairs, files.select("path").unionByName(fx.existing_outputs(docs)).unionByName(taken))


@query
def classify_inputs(spark, sf_dir):
    return io.classify_inputs(fx.file_list(table(spark, sf_dir, "documents")))


@query
def pending_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return io.pending_inputs(fx.file_list(docs), fx.existing_outputs(docs))


@query
def merged_path(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fx.file_list(docs).select("path").unionByName(fx.existing_outputs(docs)).select("path", io.merged_path(F.col("path")).alias("merged"))


@query
def check_split_defs(spark, sf_dir):
    d, e = F.col("doc_id"), F.col("entry_no")
    raw = fx.split_defs(documents(spark, sf_dir)).select(
        d.alias("set_id"), "entry_no", F.when((d % 10 == 0) & (e == 1), F.lit(None)).otherwise(F.col("filename")).alias("filename"),
        F.when((d % 10 == 1) & (e == 0), "x").otherwise(F.col("start_page").cast("string")).alias("start_page"),
        F.when((d % 10 == 2) & (e == 0), "0").otherwise(F.col("end_page").cast("string")).alias("end_page"),
    )
    valid, rejected = io.check_split_defs(raw)
    both = valid.select("set_id", "entry_no", F.lit("VALID").alias("reason")).unionByName(rejected.select("set_id", "entry_no", "reason"))
    return number(both)


@query
def request_lines(spark, sf_dir):
    """Request files' lines and what is read from them: texts with quotes and line ends in JSON, a line each."""
    made = batch.request_parts(batch.request_text(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir))), 'Say "yes".\nThen stop.')
    v = F.try_parse_json("value")
    get = lambda path: F.try_variant_get(v, path, "string")
    lines = io.request_lines(made.withColumnRenamed("batch_no", "request_no"))
    read = lines.select(get("$.key").alias("key"), get("$.request.contents[0].parts[0].text").alias("instruction"), F.md5(get("$.request.contents[0].parts[1].text")).alias("text_md5"), F.col("value").contains("\n").alias("broken"))
    return read.groupBy("key", "instruction", "text_md5", "broken").agg(F.count("*").alias("n"))


@query
def candidate_paths(spark, sf_dir):
    """Where to look for a document's text: its path and its outputs, each once, in order."""
    docs = table(spark, sf_dir, "documents")
    return fx.file_list(docs).select("doc_id", F.array_join(naming.candidate_paths(F.col("path")), ",").alias("candidates"))


@query
def order_pages(spark, sf_dir):
    """Places of the faulty documents' pages by number."""
    return number(pages.order_pages(faulty(spark, sf_dir)).select("doc_id", "pos", "page_num", "place"))


def shaky(doc: int, no: int, payload: str, attempt: int) -> str:
    """A stand-in for a service: some requests fail at first, some always."""
    if (doc + no) % 19 == 0 or ((doc + no) % 7 == 0 and attempt < 3):
        raise RuntimeError("unavailable")
    return payload[::-1]


@query
def infer(spark, sf_dir):
    """Inference with retries; only requests that fail go to the next round."""
    requests = batch.request_text(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir)))
    done = batch.infer(requests, shaky, io.new_folder(spark, "infer"), rounds=2, delay=0)
    return number(digest(done, "text", "text"))


def shuffled(doc: int, no: int, payload: str, attempt: int) -> str:
    """An answer that has too few End markers for some documents."""
    return payload.replace("### -- End --", "", 1) if (doc + no) % 23 == 0 else payload


@query
def infer_valid(spark, sf_dir):
    """Inference whose answers are checked for their markers before the next round."""
    b = batches(spark, sf_dir)
    requests = batch.request_text(b, fx.page_numbers(documents(spark, sf_dir)))
    done = batch.infer(requests, shuffled, io.new_folder(spark, "infer"), rounds=2, delay=0, validate=batch.validator(b))
    return number(digest(done, "text", "text"))


@query
def resumable_sets(spark, sf_dir):
    """Saved requests and those of now: by document, another page, another text, one less, another order, or the same."""
    d, b = F.col("doc_id"), F.col("batch_no")
    saved = batch.request_text(batches(spark, sf_dir), fx.page_numbers(documents(spark, sf_dir)))
    moved = F.transform("pages", lambda p, i: F.when(i == 0, p + 1000).otherwise(p))
    now = saved.where(~((d % 5 == 2) & (b == 1))).withColumns({
        "pages": F.when((d % 5 == 0) & (b == 1), moved).otherwise(F.col("pages")), "payload": F.when((d % 5 == 1) & (b == 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")),
        "batch_no": F.when(d % 5 == 3, 1_000_000 - b).otherwise(b),
    })
    log = saved.select(d.alias("job_id"), d.alias("event_id"), F.lit(0).alias("ts"), F.when(d % 7 == 0, "failed").otherwise("running").alias("state")).distinct()
    return number(batch.resume(saved, now, log))


@query
def split_far(spark, sf_dir):
    """Entries that reach far past the end: pages, pages in no entry, and what is covered."""
    defs = fx.split_defs(documents(spark, sf_dir))
    far = defs.where((F.col("entry_no") == 0) & (F.col("doc_id") % 3 == 0)).withColumns({"entry_no": F.lit(-1), "start_page": F.lit(3), "end_page": F.lit(2_000_000_000)})
    both, pages_ = kept(defs.unionByName(far), "entries"), kept(parsed(spark, sf_dir), "pages")
    held = split.split_docs(pages_, both).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("page_num").alias("numbers"))
    free = split.split_uncovered(pages_, both).groupBy("doc_id").agg(F.count("*").alias("uncovered"))
    rows = split.coverage(both).join(held, "doc_id", "left").join(free, "doc_id", "left")
    return number(rows.select("doc_id", "covered", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "numbers", "uncovered")]))


def one_line(spark, sf_dir, *cases) -> DataFrame:
    """Pages with a text that is made of the page's line, by the page number."""
    p, found = F.col("page_num"), None
    for i, parts in reversed(list(enumerate(cases))):
        made = F.concat(*[x if isinstance(x, str) and x in ("page_num", "text") else F.lit(x) for x in parts])
        found = made if found is None else F.when(p % len(cases) == i, made).otherwise(found)
    return fx.page_numbers(documents(spark, sf_dir)).select("doc_id", F.col("page_num").alias("pos"), "page_num", found.alias("content"))


@query
def block_spans(spark, sf_dir):
    """Blocks in blocks, one that nothing closes, and a close of nothing."""
    blocks = one_line(spark, sf_dir, ("### --右\n", "text", "\n### --左\nx\n### --\n### --"), ("### --左\n", "text"), ("### --\n### --中\n", "text", "\n### --"), ("### -- 別紙 --\n", "text"), ("- ", "text"))
    return number(pages.block_spans(blocks))


@query
def heading_parents(spark, sf_dir):
    headed = one_line(spark, sf_dir, ("第", "page_num", " 章\n- ", "text"), ("1 one\n- ", "text"), ("(", "page_num", ") x\n- ", "text"), ("a b\n- ", "text"), ("- ", "text"))
    return number(pages.heading_parents(headed.withColumn("page_num", F.col("page_num").cast("int"))))


@query
def write_paged(spark, sf_dir):
    """Documents put into a table, some without a status, and some put there again."""
    docs, d = documents(spark, sf_dir).withColumnRenamed("text", "content"), F.col("doc_id")
    folder = io.new_folder(spark, "written")
    io.write_paged(docs.where(d % 3 != 0).select("doc_id", F.when(d % 2 == 0, "complete").otherwise("error").alias("status")), docs, folder, buckets=8)
    again = docs.where(d % 4 == 0).withColumn("content", F.concat("content", F.lit("!")))
    io.write_paged(again.select("doc_id", F.lit("complete").alias("status")), again, folder)
    return number(digest(io.read_written(spark, folder), "content", "content"))


@query
def office_parts(spark, sf_dir):
    """Parts of office files that are made of the documents."""
    parts = io.office_parts(fx.office_files(documents(spark, sf_dir)))
    return number(parts.withColumn("data_md5", F.md5("data")).drop("data"))
