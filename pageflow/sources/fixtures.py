"""Paged documents and job logs derived from plain tables, by fixed rules of document and page number."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.operators.pages import error_page, page_text


def begin_continues(p: Column) -> Column:
    return (p % 8 == 1) & (p > 1)


def end_continues(p: Column) -> Column:
    return p % 5 == 0


def printed(p: Column) -> Column:
    return F.when(p % 7 == 0, F.lit(None)).when(p % 29 == 0, 1).otherwise(p + 2 + (p >= 11).cast("int"))


def _page(line: Column, p: Column) -> Column:
    return page_text(p, line, begin_continues(p), end_continues(p), printed(p))


def paged_docs(documents: DataFrame) -> DataFrame:
    """(doc_id, content): each line of a text is a page."""
    pages = F.transform(F.split("text", "\n", -1), lambda line, i: _page(line, i + 1))
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.array_join(pages, "\n\n").alias("content"))


def faulty_docs(documents: DataFrame) -> DataFrame:
    """As ``paged_docs`` with pages left out, failed, and given a second time at the end."""
    d = F.col("doc_id")
    every = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("p")))
    kept = F.filter(every, lambda x: (d + x["p"]) % 17 != 0)
    first = F.transform(kept, lambda x: F.when((d + x["p"]) % 13 == 0, error_page(x["p"])).otherwise(_page(x["line"], x["p"])))
    again = F.transform(F.filter(kept, lambda x: (d + x["p"]) % 19 == 0), lambda x: _page(F.concat(x["line"], F.lit("!")), x["p"]))
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.array_join(F.concat(first, again), "\n\n").alias("content"))


def page_numbers(documents: DataFrame) -> DataFrame:
    """(doc_id, page_num, text) of all pages."""
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("page_num"), "text")


def split_defs(documents: DataFrame) -> DataFrame:
    """Entries of four pages in each five, and one from page 2 to 6 that overlaps them."""
    n = F.size(F.split("text", "\n", -1))
    entries = F.transform(F.sequence(F.lit(0), F.ceil(n / 5).cast("int") - 1), lambda k: F.struct(k.alias("entry_no"), (k * 5 + 1).alias("start_page"), (k * 5 + 4).alias("end_page")))
    extra = F.array(F.struct(F.ceil(n / 5).cast("int").alias("entry_no"), F.lit(2).alias("start_page"), F.lit(6).alias("end_page")))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.inline(F.concat(entries, extra)))
    return rows.withColumn("filename", F.concat(F.lit("part-"), F.col("entry_no").cast("string"), F.lit(".md")))


def done(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("doc_id") + F.col("page_num")) % 3 == 0)


def conv_pages(conversations: DataFrame) -> DataFrame:
    """(doc_id, page_num, text): each turn of a conversation is a page."""
    return conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_num"), "text")


def result_lines(batches: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): what a service answers for each batch, with faults by the batch's number."""
    every = batches.select("doc_id", "batch_no", F.posexplode("pages").alias("i", "page_num")).join(texts, ["doc_id", "page_num"])
    h = F.col("doc_id") + F.col("batch_no")
    short = h % 17 == 0
    piece = F.concat(F.when((F.col("i") == 0) & short, "").otherwise(F.concat(F.lit("### -- Begin Page "), (F.col("i") + 1).cast("string"), F.lit(" --\n"))), F.col("text"), F.lit("\n### -- End --"))
    answers = every.groupBy("doc_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    key = F.concat(F.lit("request-"), F.col("batch_no").cast("string"))
    response = lambda text: F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = lambda text: F.to_json(F.struct(key.alias("key"), response(text).alias("response")))
    error = F.to_json(F.struct(key.alias("key"), F.struct(F.lit("quota").alias("message")).alias("error")))
    plain = F.array(line(F.col("text")))
    lines = (
        F.when(h % 11 == 0, F.array().cast("array<string>"))
        .when(h % 7 == 0, F.array(line(F.col("text")), line(F.concat("text", F.lit("?")))))
        .when(h % 13 == 0, F.array(F.lit("{broken")))
        .when(h % 5 == 0, F.array(error))
        .otherwise(plain)
    )
    return answers.select("doc_id", "batch_no", F.posexplode(lines).alias("j", "line")).select("doc_id", (F.col("batch_no") * 2 + F.col("j")).alias("line_no"), "line")


def progress_log(events: DataFrame) -> DataFrame:
    """(event_id, job_id, ts, state, ok)."""
    return events.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), (F.col("event_type") != "error").alias("ok"))


def decisions(documents: DataFrame, types: list[str]) -> DataFrame:
    """(doc_id, raw): a naming answer for each document, in all the forms that answers have."""
    d = F.col("doc_id")
    first = F.get(F.split("text", "\n", -1), F.lit(0))
    kind = F.get(F.array(*[F.lit(x) for x in [*types, "?", "??"]]), (d % 14).cast("int"))
    pad = lambda n: F.lpad(n.cast("string"), 2, "0")
    date = F.concat(F.lit("2024-"), pad(d % 14), F.lit("-"), pad(d % 33))
    json = F.when(d % 4 == 0, F.to_json(F.struct(date.alias("date"), kind.alias("type"), first.alias("title")))).otherwise(F.to_json(F.struct(date.alias("date"), kind.alias("documentType"), first.alias("title"))))
    raw = F.when(d % 10 == 9, first).when(d % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)
    return documents.where(F.col("text").isNotNull()).select("doc_id", raw.alias("raw"))


EXTENSIONS = [".pdf", ".PDF", ".docx", ".doc", ".odt", ".pptx", ".png", ".gif", ".txt"]


def file_list(documents: DataFrame) -> DataFrame:
    """(doc_id, path)."""
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 9).cast("int"))
    return documents.select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"))


def existing_outputs(documents: DataFrame) -> DataFrame:
    """(path): outputs that are there already, by document number."""
    base = F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    d = F.col("doc_id")
    made = F.array(
        F.when(d % 2 == 0, F.concat(base, F.lit("_paged.md"))), F.when(d % 3 == 0, F.concat(base, F.lit("_ERROR_paged.md"))),
        F.when(d % 5 == 0, F.concat(base, F.lit("_merged.md"))), F.when(d % 7 == 0, F.concat(base, F.lit("_ERROR_merged.md"))),
    )
    return documents.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("path"))


def office_files(documents: DataFrame) -> DataFrame:
    """(path, content): a word file with a picture for documents of even number, slides of a line each for others; each eleventh is no zip."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for doc, text in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):
                file = io.BytesIO()
                if doc % 11 == 0:
                    file.write(b"no zip")
                else:
                    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                        if doc % 2 == 0:
                            z.writestr("word/document.xml", text)
                            z.writestr("word/media/a.png", str(doc))
                            z.writestr("word/media/b.svg", "left out")
                        else:
                            for i, line in enumerate(text.split("\n")):
                                z.writestr(f"ppt/slides/slide{i + 1}.xml", line)
                paths.append(f"/in/{doc}.{'docx' if doc % 2 == 0 else 'pptx'}")
                contents.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(made, "path string, content binary")
