"""Reading and writing files of paged documents, definitions, requests and results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.operators.batch import normalize_results
from pageflow.sources.folders import new_folder, shared_dir  # noqa: F401
from pageflow.sources.table import Table

#: File kinds and media types by extension. A ``.gif`` has a media type but is no input.
KINDS = {"pdf": "pdf", "docx": "docx", "doc": "doc", "odt": "odt", "pptx": "pptx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}
MEDIA = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "odt": "application/vnd.oasis.opendocument.text", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def read_paged(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's paged Markdown: ``*_paged.md`` if there are any, else ``*.md``; never merged ones. Not recursive."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    files = files.where(~F.col("path").endswith("_merged.md"))
    paged = files.where(F.col("path").endswith("_paged.md"))
    return files if paged.select("path").isEmpty() else paged


def scan_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, length, modificationTime) of a folder's files with these extensions; contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return files.where(extension(F.col("path")).isin(*[e.lower().lstrip(".") for e in extensions]))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def classify_inputs(files: DataFrame) -> DataFrame:
    """Add kind and media_type by extension; ``unsupported`` and null for others."""
    look = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[extension(F.col("path"))]
    return files.withColumn("kind", F.coalesce(look(KINDS), F.lit("unsupported"))).withColumn("media_type", look(MEDIA))


def pending_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs whose output (the stem and ``_paged.md``) isn't in ``outputs.path``."""
    keyed = inputs.withColumn("_out", F.concat(F.regexp_replace("path", r"\.[^./]*\z", ""), F.lit("_paged.md")))
    return keyed.join(outputs.select(F.col("path").alias("_out")), "_out", "left_anti").drop("_out")


def merged_path(path: Column) -> Column:
    """``x_paged.md`` becomes ``x_merged.md``, any other ``x.ext`` ``x_merged.ext``."""
    other = F.regexp_replace(path, r"(?s)^(.*?)(\.[^./]*)?\z", "$1_merged$2")
    return F.when(path.endswith("_paged.md"), F.regexp_replace(path, r"_paged\.md\z", "_merged.md")).otherwise(other)


def check_split_defs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of (set_id, entry_no, filename, start_page, end_page as text); one bad row refuses its set.

    ``rejected`` has a reason: FIELD_MISSING, NOT_A_NUMBER, START_AFTER_END or SET_REFUSED.
    """
    number = lambda c: F.col(c).try_cast("int")
    missing = F.col("filename").isNull() | (F.col("filename") == "") | F.col("start_page").isNull() | F.col("end_page").isNull()
    reason = (
        F.when(missing, "FIELD_MISSING")
        .when(number("start_page").isNull() | number("end_page").isNull(), "NOT_A_NUMBER")
        .when(number("start_page") > number("end_page"), "START_AFTER_END")
    )
    judged = raw.withColumn("reason", reason)
    bad = judged.where(F.col("reason").isNotNull()).select("set_id").distinct()
    valid = judged.join(bad, "set_id", "left_anti").select("set_id", "entry_no", "filename", number("start_page").alias("start_page"), number("end_page").alias("end_page"))
    rejected = judged.join(bad, "set_id", "left_semi").withColumn("reason", F.coalesce("reason", F.lit("SET_REFUSED")))
    return valid, rejected


def read_split_defs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of JSON files, each an array of definitions. A file that is empty or no JSON is refused."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("set_id"), "value")
    array = F.from_json("value", "array<struct<filename:string,start_page:string,end_page:string>>", {"mode": "PERMISSIVE"})
    named = files.select("set_id", F.posexplode_outer(array).alias("entry_no", "d")).select("set_id", "entry_no", "d.*")
    return check_split_defs(named)


def paged_table(spark: SparkSession, folder: str, buckets: int = 64) -> Table:
    return Table(spark, folder, ["doc_id"], buckets)


def write_paged(status: DataFrame, docs: DataFrame, folder: str, buckets: int = 64) -> int:
    """Put (doc_id, content, status) into the table in ``folder``; ``status`` has (doc_id, status). The number of the table's new version.

    Documents that are there already stay; those written again are replaced, whatever their status was, so that a
    document that is complete at last has no failed copy any more. A document without a status is an ``error``. Only
    buckets that a new document falls into are read and written, and readers see all of the new documents or none: see ``Table``.
    """
    judged = docs.select("doc_id", "content").join(status.select("doc_id", "status"), "doc_id", "left")
    return paged_table(docs.sparkSession, folder, buckets).commit(judged.select("doc_id", "content", F.coalesce("status", F.lit("error")).alias("status")))


def read_written(spark: SparkSession, folder: str) -> DataFrame | None:
    """(doc_id, content, status) as of the last version of ``write_paged``; None where none was written."""
    return paged_table(spark, folder).read()


def request_lines(requests: DataFrame, shape: str = "key", url: str = "/v1/chat/completions") -> DataFrame:
    """(value): one JSON object a request: ``{key, request}``, or ``{custom_id, method, url, body}``. Needs request_no and body."""
    key = F.concat(F.lit("request-"), F.col("request_no").cast("string"))
    head = F.concat(F.lit('{"key":"'), key, F.lit('","request":')) if shape == "key" else F.concat(F.lit('{"custom_id":"'), key, F.lit(f'","method":"POST","url":"{url}","body":'))
    return requests.select(F.concat(head, F.col("body"), F.lit("}")).alias("value"))


def write_requests_jsonl(requests: DataFrame, path: str, shape: str = "key") -> None:
    request_lines(requests, shape).write.mode("overwrite").text(path)


def read_results_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Result lines read by ``normalize_results``: bad lines become error rows."""
    return normalize_results(spark.read.text(path).withColumnRenamed("value", "line"))


PARTS = [
    ("main", re.compile(r"^(word/document\.xml|content\.xml)$")), ("styles", re.compile(r"^(word/styles\.xml|styles\.xml)$")),
    ("slide", re.compile(r"^ppt/slides/slide(\d+)\.xml$")), ("notes", re.compile(r"^ppt/notesSlides/notesSlide(\d+)\.xml$")),
    ("media", re.compile(r"^(?:word/media|ppt/media|Pictures)/.+$")),
]
_DRAWN = re.compile(r"\.(svg|emf|wmf)$", re.IGNORECASE)


def part_of(name: str) -> tuple[str, int, str | None] | None:
    """(kind, ordinal, media type) of a part of an office file; None for parts that aren't read.

    Slides and notes have their number as ordinal. ``.svg`` pictures, and ``.emf`` and ``.wmf`` ones of slides, are left out.
    """
    for kind, pattern in PARTS:
        if m := pattern.match(name):
            if kind == "media":
                drawn = _DRAWN.search(name) and not (name.startswith("word/") and not name.lower().endswith(".svg"))
                return None if drawn else (kind, 0, MEDIA.get(name.rpartition(".")[2].lower()))
            return kind, int(m[1]) if kind in ("slide", "notes") else 0, "text/xml"
    return None


def office_parts(files: DataFrame) -> DataFrame:
    """(path, part_name, kind, ordinal, mime, data) of zipped office files; ``files`` have (path, content), whole files.

    Parts are as ``part_of`` tells. A file that is no zip gives one row of kind ``broken``. Parts are unzipped one after the other. To read
    files without holding them, and without the kinds that aren't wanted, see ``office.read_office_parts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):
                yield from part_batches(path, io.BytesIO(data or b""))

    return files.select("path", "content").mapInArrow(run, OFFICE_PARTS)


OFFICE_PARTS = "path string, part_name string, kind string, ordinal int, mime string, data binary"
_OFFICE_SCHEMA = pa.schema({"path": pa.string(), "part_name": pa.string(), "kind": pa.string(), "ordinal": pa.int32(), "mime": pa.string(), "data": pa.binary()})


def part_batches(path: str, file, wanted: Callable[[str, str], bool] = lambda name, kind: True, data: bool = True, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of one office file in batches of about ``size`` bytes: the parts that are ``wanted`` by name and kind, without their bytes if not ``data``."""
    rows, held = [], 0
    try:
        with zipfile.ZipFile(file) as z:
            for name in z.namelist():
                if (part := part_of(name)) and wanted(name, part[0]):
                    content = z.read(name) if data else None
                    rows.append((path, name, *part, content))
                    held += len(content or b"")
                    if held > size:
                        yield _office_batch(rows)
                        rows, held = [], 0
    except zipfile.BadZipFile:
        if wanted("", "broken"):
            rows.append((path, None, "broken", 0, None, None))
    if rows:
        yield _office_batch(rows)


def _office_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OFFICE_SCHEMA, strict=True)], schema=_OFFICE_SCHEMA)
