"""Operator 1: information-theoretic sanitisation of personal data.

Protected entities are the values that the base patterns find. Over the corpus, each term of an entity's documents is
judged by how much of the entity's information it gives away: PMI(entity; term) / IC(entity), with probabilities
estimated from document counts. Terms over the thresholds are generalised or removed wherever they stand in documents
that hold the entity. All steps are DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.llm.common import cut, stored

#: Kinds in the order in which spans with one start are listed. Patterns never step back into what they have
#: read, so that long runs of digits or letters take linear time; they match what the plain forms match.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
TERM = r"\p{L}{3,}"
#: What stands for a letter at a base span's end in ``_bare_terms``, so that a run of letters into the span is no term.
EDGE = "\uffff"
BARE_TERM = rf"(?<![\p{{L}}{EDGE}])\p{{L}}{{3,}}+(?!{EDGE})"
#: So many candidate terms are sent to all executors at most; more are joined by shuffling.
BROADCAST_TERMS = 2_000_000
#: So many documents with risky terms are sent to all executors at most.
BROADCAST_DOCS = 100_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; digits from the right are doubled at every second place."""
    total = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.length(digits)),
            lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
        ),
        F.lit(0),
        lambda a, x: a + F.when(x > 9, x - 9).otherwise(x),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(IP_PARTS),
        "card": F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Places of ``matches``, which ``pattern`` has found in ``text``: array of (start, end, value), in code points.

    What ``split`` leaves between the matches gives their distances.
    """
    between = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,value:string>>"
    walk = F.aggregate(
        F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.array_append(
                a["out"],
                F.struct((a["at"] + F.length(x["b"])).alias("start"), (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("value")),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(matches) > 0, walk).otherwise(F.array().cast(kind))


def _kind_spans(place: int, kind: str) -> Column:
    matches = F.coalesce(F.col(f"_m_{kind}"), F.array().cast("array<string>"))
    spans = F.filter(located(F.col("text"), KINDS[kind], matches), lambda s: _valid(kind, s["value"]))
    as_base = lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    return F.transform(spans, as_base)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: array of (start, place, kind, end, value), sorted by start and then kind."""
    gate = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    found = docs.withColumns(
        {f"_m_{k}": F.when(gate.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, p in KINDS.items()}
    )
    kept = [_kind_spans(place, kind) for place, kind in enumerate(KINDS)]
    none = reduce(lambda a, b: a & b, [F.coalesce(F.size(f"_m_{k}"), F.lit(0)) <= 0 for k in KINDS])
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,value:string>>")
    return found.withColumn("base", F.when(none, empty).otherwise(F.array_sort(F.concat(*kept)))).drop(*[f"_m_{k}" for k in KINDS])


def _terms(text: Column, pattern: str = TERM) -> Column:
    """Distinct terms in lower case. Terms are found before, as lower case may have other lengths."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.lower(t)))


def _bare_terms(text: Column, base: Column) -> Column:
    """Distinct terms that stand somewhere without a base span over them."""
    edge = lambda c: F.when(c.rlike(r"^\p{L}"), EDGE).otherwise(" ")
    hidden = lambda s: F.concat(edge(F.substring(s["value"], 1, 1)), edge(F.substring(s["value"], -1, 1)))
    rebuilt = F.aggregate(
        base,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.when(s["end"] > a["at"], hidden(s)).otherwise("")).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return _terms(rebuilt, BARE_TERM)


def _marked(text: Column, base: Column, risky: Column) -> Column:
    """All places of the terms in ``risky`` (a map to actions) that no base span covers, in order."""
    matches = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    between = F.split(text, TERM, -1)
    kind = "array<struct<start:int,place:int,kind:string,end:int,action:string>>"

    def step(a, x):
        start = a["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        action = F.try_element_at(risky, F.lower(x["m"]))
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("place"), F.lit("term").alias("kind"), end.alias("end"), action.alias("action"))
        free = action.isNotNull() & ~F.exists(base, lambda s: (start < s["end"]) & (s["start"] < end))
        return F.struct(end.alias("at"), F.when(free, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    pieces = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])


def disclosures(docs: DataFrame, generalise_at: float = 0.85, remove_at: float = 0.98, min_support: int = 2) -> DataFrame:
    """Spans to sanitise: a row (doc_id, text_hash, base, added) for each row of ``docs``.

    ``base`` holds the personal data, ``added`` the terms that disclose it: those that stand in at least
    ``min_support`` documents of an entity and whose share of the entity's information,
    PMI(entity; term) / IC(entity), is at least ``generalise_at`` (action ``generalise``) or ``remove_at``
    (``remove``), at every place in all documents of the entity, however far from it. Terms under a base span are
    no terms of an entity's document. Entities are compared in lower case by kind and value. Document counts cover all
    documents; rows equal in doc_id and text count as one document. Null and empty texts have no spans and count as
    documents. An entity in every document carries no information and discloses nothing. Ties and repeated
    rows get equal results; an empty table gives an empty one; other columns of ``docs`` play no part.
    """
    source = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = base_spans(source)
    kept = stored(found.select("doc_id", "text_hash", "base", F.when(F.size("base") > 0, _bare_terms(F.col("text"), F.col("base"))).alias("terms")), "pii-spans")

    key = ["doc_id", "text_hash"]
    # Repeated rows are one document.
    copies = cut(kept.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1))
    total = float(max(kept.count() - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0), 1))
    holders = kept.where(F.size("base") > 0).select(*key, "base", "terms", F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"])))).alias("entities"))
    # An entity of fewer documents than the support asks for can't have a term with that support.
    pairs = holders.select(*key, F.explode("entities").alias("entity")).distinct()
    entities = pairs.groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = cut(entities.where((F.col("n_entity") >= min_support) & (F.col("n_entity") < total)))
    held = pairs.join(entities, "entity")
    held = cut(held.groupBy(*key).agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities")))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    once = source
    if not copies.isEmpty():
        repeated = source.alias("s").join(copies.alias("c"), same("s", "c"), "left_semi").dropDuplicates(key)
        once = source.alias("s").join(copies.alias("c"), same("s", "c"), "left_anti").unionByName(repeated)
    carried = holders.drop("entities").alias("h").join(held.alias("e"), same("h", "e")).select("h.*", "e.entities")
    carried = stored(carried.dropDuplicates(key), "pii-holders")
    # PMI is at most log2(total / max(n_entity, n_term)): that leaves out the many frequent terms and no risky one.
    log = lambda n: F.log2(F.lit(total) / n)
    possible = lambda n_entity, n_term: log(F.greatest(n_entity, n_term)) >= generalise_at * log(n_entity) - 1e-9
    most = entities.agg(F.max("n_entity")).first()[0] or 1
    wanted = carried.select(F.explode("terms").alias("term")).distinct()
    counted = once.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counted = counted.where((F.col("n_term") >= min_support) & possible(F.lit(most), F.col("n_term")))
    counted = cut(counted.join(wanted, "term", "left_semi"))
    near = carried.select(*key, "entities", F.explode("terms").alias("term"))
    near = near.join(F.broadcast(counted) if counted.count() <= BROADCAST_TERMS else counted, "term")
    seen = near.select(*key, "term", "n_term", F.explode("entities").alias("e")).where(possible(F.col("e.n_entity"), F.col("n_term")))
    seen = stored(seen.select(*key, "term", "n_term", "e.*"), "pii-seen")
    information = log(F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    risky = (
        seen.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
        .where(F.col("n_both") >= min_support)
        .withColumn("share", F.when(information > 0, mutual / information).otherwise(0.0))
        .where(F.col("share") >= generalise_at)
        .select("entity", "term", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"))
    )
    flagged = (
        seen.join(risky, ["entity", "term"])
        .groupBy(*key, "term").agg(F.max("action").alias("action"))
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("risky"))
    )
    flagged = cut(flagged.alias("f").join(carried.alias("c"), same("f", "c")).select("f.*", "c.base"))
    if flagged.count() <= BROADCAST_DOCS:
        flagged = F.broadcast(flagged)
    spotted = source.alias("s").join(flagged.alias("f"), same("s", "f")).select("s.*", "f.risky", "f.base")
    spans = spotted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), _marked(F.col("text"), F.col("base"), F.col("risky")).alias("added")).dropDuplicates(["_id", "_hash"])
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,action:string>>")
    return (
        kept.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
        .select(*key, "base", F.coalesce("added", none).alias("added"))
    )


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end, action) and ``sanitised``: the text with spans replaced.

    Personal data become ``[EMAIL]`` and so on, generalised terms ``[TERM]``, removed terms nothing; where spans
    overlap, the one that starts first stands. Null texts stay null. Rows as in ``disclosures``; columns of
    ``docs`` named as the two new ones are replaced.
    """
    spans = disclosures(docs, **thresholds).dropDuplicates(["doc_id", "text_hash"])
    every = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("replace").alias("action"))),
            F.col("added"),
        )
    )
    text = F.col("text")
    new = lambda s: F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rebuilt = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), new(s)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    rest = docs.drop("spans", "sanitised", "_id", "_hash", "_hash2")
    keyed = rest.withColumn("_hash2", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), every.alias("spans"))
    return (
        keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash2") == F.col("_hash")), "left")
        .withColumn("sanitised", rebuilt)
        .select(*rest.columns, "spans", "sanitised")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = disclosures(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat(bare(F.col("base")), bare(F.col("added"))))).alias("spans")
    )
