"""Operator 10: language identification by compression.

Each language's sample text becomes a raw-content zstandard dictionary. A text is cut into pieces, every piece
is compressed with every dictionary, and the language whose total is smallest wins. Pieces keep the
dictionaries decisive in long texts; all pieces of a text count, so whole texts are judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: May be a letter: superscripts and fractions are found, too.
LETTER = re.compile(r"[^\W\d_]")
#: Bytes as they are compressed: ASCII letters and all of other characters stay, the rest becomes blank.
LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def encoded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY) + b" "


def training_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> Column:
    """Condition: the row may be learned from."""
    return (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held_out) & F.col("lang").isNotNull()


def fit_dictionaries(
    labelled: DataFrame, rows_per_language: int = 1000, max_chars: int = 20_000, dictionary_bytes: int = 112_640, max_languages: int = 1_000
) -> dict[str, bytes]:
    """Learn one dictionary a language from a bounded sample of labelled rows.

    The sample takes at most ``rows_per_language`` texts for each language, drawn by the hash of the text; equal
    texts count once, and a language with fewer distinct texts gives all of them. Of a text longer than
    ``max_chars`` a run of so many characters is taken, at a place that its hash tells. A dictionary has up to
    ``dictionary_bytes``, of which each text is given an equal share at least: whole texts that fit their share, else a
    slice at a place that the hash tells, so that slices come from all over the texts. More than ``max_languages``
    languages raise an error, since dictionaries are sent to every task.
    """
    fit = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    hashed = fit.select("lang", "text", F.xxhash64("text").alias("h"))
    # The draw acts on distinct texts, so they are what is counted: copies would make the share too small.
    sizes = {r["lang"]: r["count"] for r in hashed.select("lang", "h").distinct().groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return {}
    # A share of the hashes that leaves about four times the wanted texts, so that a language's ranking stays small.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4 * rows_per_language / n))])
    start = F.when(F.length("text") > max_chars, F.pmod("h", F.length("text") - max_chars + 1)).otherwise(0).cast("int")
    piece = F.substring("text", start + 1, F.lit(max_chars))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).groupBy("lang", "h").agg(F.first(piece).alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    sample = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_language).orderBy("lang", "h")
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.toLocalIterator():
        texts.setdefault(row["lang"], []).append((row["h"], encoded(row["text"])))
    made = {}
    for lang, parts in sorted(texts.items()):
        share = max(64, dictionary_bytes // len(parts))
        spare = max(0, dictionary_bytes - sum(min(share, len(p)) for _, p in parts))
        content = []
        for h, part in parts:
            take = min(len(part), share + spare)
            spare -= max(0, take - share)
            start = (h >> 30) % (len(part) - take + 1)
            content.append(part[start : start + take])
        made[lang] = b"".join(content)[-dictionary_bytes:]
    return made


def classify(dictionaries: dict[str, bytes], level: int = 6, piece_bytes: int = 4096):
    """A function text -> (language, score, letters?) with the dictionaries compiled once."""
    import zstandard

    coders = []
    for lang, content in sorted(dictionaries.items()):
        compiled = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compiled.precompute_compress(level=level)
        coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=compiled, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def one(text: str | None) -> tuple[str, float]:
        if text is None or not coders or not any(m[0].isalpha() for m in LETTER.finditer(text)):
            return UNKNOWN, 0.0
        data = encoded(text)
        pieces = [data[i : i + piece_bytes] for i in range(0, len(data), piece_bytes)]
        sizes = [(sum(len(coder.compress(p)) for p in pieces), lang) for lang, coder in coders]
        sizes.sort()
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        best, second = sizes[0][0], sizes[1][0]
        return sizes[0][1], (second - best) / second if second else 0.0

    return one


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.002, level: int = 6, piece_bytes: int = 4096) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1: how much smaller the best size is than the second) and ``rejected``.

    A row is rejected when its text is null or has no letter (``und``, score 0), or when the margin between
    the two best languages is under ``min_margin``; ties go to the language first by code point and are
    rejected. No column but ``text`` is looked at. Repeated rows are judged alike; empty tables give empty
    tables; existing columns named as the three new ones are replaced. With one language learned, the score is 1; with none, every
    text is ``und``. Rows pass through one Arrow stage without a shuffle.
    """
    rest = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*rest.schema.fields, *added])
    text_at = rest.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = classify(shared.value, level, piece_bytes)
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(text_at)]
            rejected = [lang == UNKNOWN or score < min_margin for lang, score in found]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return rest.mapInArrow(judge, schema)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every document, learning from three quarters of the labelled ones.

    A row without a doc_id is neither learned from nor held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit_dictionaries(docs.where(training_rows(docs)))
    rows = docs.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "text")
    return identify_language(rows, dictionaries).drop("text")
