import hashlib
import re

from pyspark.sql import functions as F

from pageflow.llm import fill_middle as fim


def plain(doc, text):
    """The contract, word by word."""
    text = text or ""
    n = len(found := list(re.finditer("[A-Za-z]+|[^A-Za-z]", text)))
    h = [int(x, 16) for x in re.findall(".{8}", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest())[:4]]
    lo, hi = sorted(h[i] % (n + 1) for i in range(2))
    at = lambda u: found[u].start() if u < n else len(text)
    p, m, s = text[: at(lo)], text[at(lo) : at(hi)], text[at(hi) :]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return doc, n, form, *sizes, out


def sha(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def same(spark, docs, **options):
    df = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = [plain(*r) for r in rows]
    got = fim.digests(df, **options).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*w[:-1], sha(w[-1]), sha(t))) for w, (_, t) in zip(want, rows, strict=True))
    assert sorted(map(str, map(tuple, fim.outputs(df, **options).collect()))) == sorted(map(str, want))


def test_whole_table(spark, sf001):
    same(spark, spark.read.parquet(f"{sf001}/documents.parquet"))
    got = fim.op13_query(spark, sf001).agg(F.countDistinct("form"), F.count("*")).first()
    assert tuple(got) == (3, 200)


def test_pieces_of_a_few_characters(spark, sf001):
    """Marks and units that lie across pieces."""
    texts = ["a<", "<S", "<<P", "P>", "ab<PS>", "x<P>y", "<M>", "é<S", "日本語 text 𝔘nicode\r\n\n", "<S<S<S", "S><S", "a" * 50, "- - -"]
    for size in (1, 2, 7):
        same(spark, [(i * 31 + j, t) for i, t in enumerate(texts) for j in range(4)], size=size)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "same"), (3, "same"), (3, "same"), (3, "other"), (4, "word " * 60_000), (5, "\0\t\n"), (6, "x" * 300_000)]
    same(spark, rows)
    df = spark.createDataFrame([(7, "a b", "k", 1), (7, "a b", "k", 1)], "doc_id long, text string, key string, place int")
    same(spark, df.repartition(2))
    same(spark, df.limit(0))


def test_all_forms_by_share(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert {r["form"] for r in fim.digests(docs, plain_share=0, spm_share=100).collect()} == {"spm"}
    assert {r["form"] for r in fim.digests(docs, plain_share=100).collect()} == {"plain"}
