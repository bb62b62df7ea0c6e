from pyspark.sql import functions as F

from pageflow.llm import langid


def test_held_out_accuracy(spark, sf001):
    rows = langid.op10_query(spark, sf001).join(spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "lang"), "doc_id")
    total, right = rows.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / total > 0.9


def test_odd_rows(spark):
    texts = [(1, None, 5), (None, "", None), (3, "12 34 -- !!", 7), (4, "the house and the garden " * 20, 1), (4, "the house and the garden " * 20, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score int")
    coded = {"en": langid.encoded("the house and the garden by the sea"), "de": langid.encoded("das haus und der garten am meer")}
    out = langid.identify_language(docs, coded).collect()
    assert [r["lang_pred"] for r in out if r["text"] is None or len(r["text"]) < 20] == ["und"] * 3
    assert [(r["lang_pred"], r["rejected"]) for r in out if r["doc_id"] == 4] == [("en", False)] * 2
    assert langid.identify_language(docs.limit(0), coded).count() == 0
    assert {r["lang_pred"] for r in langid.identify_language(docs, {}).collect()} == {"und"}


def test_few_texts_among_many_copies(spark):
    """A language of few distinct texts keeps them all, however many rows are copies or have no text."""
    own = spark.range(30).selectExpr("'xx' lang", "concat('alpha', id, repeat(' quux', 3)) text")
    copies = spark.range(60_000).selectExpr("'xx' lang", "if(id % 3 = 0, null, 'same text') text")
    made = langid.fit_dictionaries(own.unionByName(copies), rows_per_language=40)
    assert made["xx"].count(b"quux") == 90 and made["xx"].count(b"same text") == 1
    long = spark.createDataFrame([("yy", "wort " * 100)], "lang string, text string")
    assert 40 <= len(langid.fit_dictionaries(long, max_chars=50)["yy"].strip()) <= 50
    marked = spark.createDataFrame([("zz", f"{'head ' * 40}{'tail ' * 40}{i}") for i in range(40)], "lang string, text string")
    made = langid.fit_dictionaries(marked, dictionary_bytes=4000)
    assert made["zz"].count(b"head") > 100 and made["zz"].count(b"tail") > 100


def test_sizes_ties_and_letters(spark):
    """The prediction is the smallest total over pieces; equal sizes go to the first language and are rejected; no letter, no language."""
    import zstandard

    coded = {"b": langid.encoded("der hund und die katze im garten " * 3), "a": langid.encoded("the dog and the cat in the yard " * 3), "c": b""}
    texts = ["the dog and the yard " * 400, "die katze und der hund", "²½ 12", "x", "é" * 5000, " the dog\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def size(lang, text):
        data = langid.encoded(text)
        made = zstandard.ZstdCompressionDict(coded[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=6, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(coder.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))

    for r in langid.identify_language(docs, coded).collect():
        if r["doc_id"] == 2:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            first, second = sorted((size(lang, r["text"]), lang) for lang in coded)[:2]
            assert r["lang_pred"] == first[1] and abs(r["score"] - (second[0] - first[0]) / second[0]) < 1e-12
    twins = langid.identify_language(docs, {"q": coded["a"], "p": coded["a"]}).where("doc_id = 0").first()
    assert (twins["lang_pred"], twins["score"], twins["rejected"]) == ("p", 0.0, True)


def test_nothing_to_learn_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (None, "other " * 50_000, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = langid.op10_query(spark, str(tmp_path)).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2 and {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
