from pyspark.sql import functions as F
import regex
from collections import Counter
import math
import random
import re

from pageflow.llm import pii
from tests.llm import brute


def base(spark, texts):
    rows = pii.base_spans(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()
    return [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]) for r in rows]


def test_base_spans_match_plain_patterns(spark):
    random.seed(5)
    bits = ["a@b.c", "_x@d.e", ".", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", "+49", " ", "-", "é😀", "5", "ab%", "+", "\n", "12345678901234567890"]
    texts = ["".join(random.choices(bits, k=random.randint(1, 12))) for _ in range(1500)] + [None, "", "9" * 30_000, "a" * 30_000, "1 " * 20_000, "a.b@" * 5000, "x@y.z " * 2000]
    assert base(spark, texts) == [brute.pii(t)[2] for t in texts]


def test_whole_table(spark, sf001):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = pii.op1_query(spark, sf001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts, sha, joined = brute.pii(docs[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == sha
        assert [x for x in r["spans"].split(",") if not x.startswith("term")] == (joined or "").split(",")


def test_disclosing_terms(spark):
    texts = [f"mister zyx met ann at a.b@c.de on day {i}" for i in range(3)] + ["mister zyx met nobody"] * 1 + [f"mister met ann {i}" for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.sanitise(docs, generalise_at=0.85).collect()}
    n = len(texts)

    def share(term):
        terms = [set(re.findall("[a-z]{3,}", t or "")) for t in texts]
        both, one = sum(term in t for t in terms[:3]), sum(term in t for t in terms)
        return math.log2(both * n / (3 * one)) / math.log2(n / 3)

    flagged = {texts[0][s["start"] : s["end"]] for s in out[0]["spans"] if s["kind"] == "term"}
    assert flagged == {t for t in ("mister", "zyx", "met", "ann", "day") if share(t) >= 0.85} == {"zyx", "day"} - ({"zyx"} if share("zyx") < 0.85 else set())
    assert "[EMAIL]" in out[0]["sanitised"] and out[3]["sanitised"] == texts[3]
    assert out[n - 2]["sanitised"] is None and out[n - 1]["sanitised"] == ""


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, base int, spans string, text_hash long")
    assert pii.sanitise(docs).count() == 0
    twice = spark.createDataFrame([(None, "x@y.zz", 1), (None, "x@y.zz", 2)], "doc_id long, text string, base int")
    assert [r["sanitised"] for r in pii.sanitise(twice).collect()] == ["[EMAIL]"] * 2


def test_terms_far_from_the_entity(spark):
    """Document counts decide, not the distance: every place of a risky term in the entity's documents is marked."""
    filler = "and so on " * 50
    texts = [f"İzmir zyx wrote {filler} A@b.cd {filler} Zyx qqq {i}" for i in (1, 2)] + [f"wrote and izmir on {i}" for i in range(60)] + ["far qqqq@rrr.de", "éqqq@rrr.de éqqq"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    for i in (0, 1):
        marked = [(texts[i][s["start"] : s["end"]], s["action"]) for s in out[i]["spans"] if s["kind"] == "term"]
        assert [m for m in marked if m[0] != "İzmir"] == [("zyx", "remove"), ("Zyx", "remove"), ("qqq", "remove")]
    assert out[2]["sanitised"] == texts[2]


def test_repeated_rows_count_once(spark):
    texts = [f"mister zyx met ann at a.b@c.de on day {i}" for i in range(3)] + ["zyx"] + [f"mister met ann {i}" for i in range(60)]
    rows = list(enumerate(texts))
    spans = lambda r: {(x["doc_id"], tuple(s["start"] for s in x["spans"])) for x in pii.sanitise(spark.createDataFrame(r, "doc_id long, text string")).collect()}
    assert spans(rows) == spans(rows + rows[:2] * 6 + [rows[20]] * 9)


def test_term_spans_on_a_whole_table(spark, sf001):
    """Term spans equal those of a plain count over all documents."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    # Few documents disclose anything: every tenth gets an entity that goes with a rare word.
    more = F.concat("text", F.lit(" Quixotry seen by agent"), (F.col("doc_id") % 20).cast("string"), F.lit("@zz.example and quixotry"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, more).otherwise(F.col("text")))
    rows = [tuple(r) for r in docs.collect()]
    n, holders, with_term = len(rows), {}, {}
    places = {}
    for d, text in rows:
        base = [(m[0], m[1], m[2], m[3]) for m in plain_spans(text or "")]
        terms = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{3,}", text or "")]
        for t in {t for _, _, t in terms}:
            with_term.setdefault(t, set()).add(d)
        # A run of letters that a base span cuts is no term of the document, and none is marked there.
        free = [(a, b, t) for a, b, t in terms if not any(a < e and s < b for s, e, _, _ in base)]
        places[d] = free
        for _, _, kind, value in base:
            holders.setdefault((kind, value.lower()), {})[d] = {t for _, _, t in free}
    want = {}
    for docs_of in holders.values():
        if not 2 <= len(docs_of) < n:
            continue
        counts = Counter(t for ts in docs_of.values() for t in ts)
        for t, both in counts.items():
            if both < 2:
                continue
            share = math.log2(both * n / (len(docs_of) * len(with_term[t]))) / math.log2(n / len(docs_of))
            if share >= 0.85:
                for d in (d for d, ts in docs_of.items() if t in ts):
                    want.setdefault(d, set()).update((a, b) for a, b, x in places[d] if x == t)
    got = {}
    for r in pii.disclosures(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r["added"]:
            got[r["doc_id"]] = {(x["start"], x["end"]) for x in r["added"]}
    assert want and got == want


def plain_spans(text):
    """(start, end, kind, value)."""
    out = []
    for item in (brute.pii(text)[2] or "").split(","):
        if item:
            kind, start, end = item.split(":")
            out.append((int(start), int(end), kind, text[int(start) : int(end)]))
    return out
