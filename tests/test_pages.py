"""Hand-made documents: the format's corners."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from pageflow.functions import text as t
from pageflow.operators import batch, merge, naming, pages, split
from pageflow.sources import io as files


def docs(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id long, content string")


def page(n, body, end="### -- End --"):
    return f"### -- Begin Page {n} --\n{body}\n{end}"


def bodies(df):
    return [(r["page_num"], r["b"]) for r in df.withColumn("b", t.body_of(F.col("content"))).orderBy("doc_id", "pos").collect()]


def test_parse_corners(spark):
    text = "before\n" + page(1, "a　") + "\n\n### -- Begin Page 2\nloose\n" + page(3, "[ERROR: OCR Failed for page 3]") + "\n" + page(1, "again") + "\n### -- Begin Page 9999999999 --\nlast"
    d = docs(spark, text, "", None, "no marker", "### -- Begin Page 0 --")
    assert bodies(pages.parse_pages(d)) == [(1, "a　\n\n\n### -- Begin Page 2\nloose"), (3, ""), (1, "again"), (None, "last"), (0, "")]
    loose = pages.parse_pages(d, strict=False, drop_errors=True)
    assert [n for n, _ in bodies(loose)] == [1, 2, 1, None, 0]
    assert [(r["page_num"], r["pos"]) for r in pages.last_wins(loose).where("page_num = 1").collect()] == [(1, 4)]


def test_merge_keeps_pages_after_a_plain_end(spark):
    text = "intro\n" + "\n\n".join([page(1, "body1"), page(2, "body2", "### -- End  --"), page(3, " body3 \n", "### -- End (Printed Page 7) (Continuation) --"), page(4, "body4"), "### -- Begin Page 5 (Continuation) --\nbody5"])
    (row,) = merge.merge_pages(pages.parse_pages(docs(spark, text))).collect()
    (whole,) = merge.merge_pages(pages.parse_pages(docs(spark, text), keep_head=True)).collect()
    assert whole["merged"] == "intro\n\n" + row["merged"]
    bare = docs(spark, "no marker", "", None, page(1, "x"))
    assert [tuple(r) for r in merge.merge_pages(pages.parse_pages(bare, keep_head=True)).orderBy("doc_id").collect()] == [(0, "no marker"), (3, "x")]
    assert [r[0] for r in pages.without_markers(bare).orderBy("doc_id").collect()] == [0, 1, 2]
    assert row["merged"] == "body1\n\nbody2\n\nbody3body4body5"
    assert merge.merge_pages(pages.parse_pages(docs(spark, page(1, "a\n\n\n\nb") + "\n" + page(2, "")))).first()["merged"] == "a\n\nb\n\n"


def test_legacy_marks_and_digits(spark):
    df = docs(spark, "a \n=-- Page 1 (Continuation) --=\n b\n=-- Page 2 --=\nc ２０２４年")
    assert df.select(t.normalize_digits(t.strip_legacy(F.col("content")))).first()[0] == "ab\nc 2024年"


def test_blank_threshold_and_errors(spark):
    d = docs(spark, page(1, "x" * 10) + page(2, "x" * 11) + page(3, "[ERROR: OCR Failed for page 3]") + "\n### -- Begin Page 4 (Continuation) --\n" + "y" * 20)
    assert [(r["old_page"], r["page_num"], r["content"].split("\n")[0]) for r in pages.remove_blank(d).orderBy("pos").collect()] == [(2, 1, "### -- Begin Page 1 --"), (4, 2, "### -- Begin Page 2 (Continuation) --")]
    assert pages.remove_blank(d, keep_errors=True).count() == 3
    with pytest.raises(ValueError):
        pages.flag_blank(d, -1)


def test_split_ranges(spark):
    p = pages.parse_pages(docs(spark, "\n".join(page(i, f"b{i}") for i in (1, 2, 4))))
    defs = spark.createDataFrame([(0, 0, "a", 1, 2), (0, 1, "b", 2, 4), (0, 2, "c", 5, 3), (0, 3, "d", 9, 9)], "doc_id long, entry_no int, filename string, start_page int, end_page int")
    assert [(r["filename"], r["old_page"], r["page_num"]) for r in split.split_docs(p, defs).orderBy("entry_no", "pos").collect()] == [("a", 1, 1), ("a", 2, 2), ("b", 2, 1), ("b", 4, 2)]
    assert {(r["entry_no"], *r["missing"]) for r in split.split_missing(p, defs).collect()} == {(1, 3), (3, 9)}
    assert split.split_uncovered(p, defs).count() == 0
    wide = spark.createDataFrame([(0, 0, "a", 1, 2_000_000_000), (7, 0, "none", 2, 3)], defs.schema)
    assert {tuple(r) for r in split.split_gaps(p, wide).collect()} == {(0, 0, 3, 3), (0, 0, 5, 2_000_000_000), (7, 0, 2, 3)}


def fold(text):
    """The same joining as a loop over lines."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        line = line.strip()
        if not line:
            if out and out[-1] != "":
                out.append("")
        elif not out or out[-1] == "" or re.search(t.SENTENCE_END.replace(r"\z", r"\Z"), out[-1]) or re.search(t.LINE_START, line):
            out.append(line)
        else:
            out[-1] += line
    return "\n".join(out).strip()


def test_reflow_equals_a_fold(spark):
    random.seed(8)
    bits = ["a", "b。", "", " ", "・x", "- y", "1. z", "(一) w", "c)", "　", "(1) v", "d」", "# h", "１２"]
    texts = ["\n".join(random.choices(bits, k=random.randint(0, 9))).replace("b。\n", random.choice(["b。\n", "b。\r\n"])) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame(enumerate(texts), "i int, s string").orderBy("i").select(t.reflow(F.col("s"))).collect()]
    assert got == [fold(x) for x in texts]


def test_reflow_of_very_many_lines(spark):
    text = "\n".join(f"line {i}" + ("。" if i % 3 == 0 else "") for i in range(20_000))
    assert spark.createDataFrame([(text,)], "s string").select(t.reflow(F.col("s"))).first()[0] == fold(text)


def test_renumber_keeps_all_characters(spark):
    d = docs(spark, page(3, "a\u0001b $1 \\") + "\n" + page(7, "\u0001"))
    got = [r["content"] for r in pages.renumber(pages.parse_pages(d)).orderBy("pos").collect()]
    assert got == [page(1, "a\u0001b $1 \\"), page(2, "\u0001")]


def test_names(spark):
    titles = ["<>:*", "a_b  c. ", "x" * 100, None, "　題　"]
    got = [r[0] for r in spark.createDataFrame(enumerate(titles), "i int, s string").orderBy("i").select(naming.sanitize_title(F.col("s"))).collect()]
    assert got == [naming.NO_TITLE, "a b c", "x" * 80, naming.NO_TITLE, "題"]
    dates = ["2024-02-31", "2024-00-00", "0000-01-01", "2024-13-01", "2024-1-1", " 2024-12-31\n", None]
    got = [r[0] for r in spark.createDataFrame(enumerate(dates), "i int, s string").orderBy("i").select(naming.normalize_date(F.col("s"), "2000-01-01")).collect()]
    assert got == ["2024-02-31", "2024-00-00", "2000-01-01", "2000-01-01", "2000-01-01", "2024-12-31", "2000-01-01"]
    raws = ['```json\n{"date":"2024-05-06","type":"契約","name":"n"}\n```', "{'date':'2024-05-06'}", 'so: {"documentType":"?","title":"t"} end', "just text\nmore", None]
    out = naming.parse_decision(spark.createDataFrame(enumerate(raws), "i int, raw string"), "2000-01-01").orderBy("i").collect()
    assert [(r["date"], r["document_type"], r["title"]) for r in out] == [("2024-05-06", "契約", "n"), ("2000-01-01", "その他", "{'date' '2024-05-06'}"), ("2000-01-01", "その他", "t"), ("2000-01-01", "その他", "just text"), ("2000-01-01", "その他", naming.NO_TITLE)]


def test_decisions_are_whole_json(spark):
    """What follows a JSON value makes it none, as in a first line that starts with a number."""
    raws = ["4763 Of thnd", '{"title":"a"} {"title":"b"}', '{"title":"a"}}', '[{"title":"a"},{"title":"b"}]', '{"title":"a","title":"b"}', "4763", '1] x [', '"a" b', '1,"v":2', "1} x", 'so {"title":"a"}\nend']
    out = naming.parse_decision(spark.createDataFrame(enumerate(raws), "i int, raw string"), "2000-01-01").orderBy("i").collect()
    none = naming.NO_TITLE
    assert [r["title"] for r in out] == ["4763 Of thnd", "{ title a } { title b }", "{ title a }}", none, "b", none, "1] x [", "a b", "1, v 2", "1} x", "a"]


def test_unique_names_with_taken_numbers(spark):
    wanted = spark.createDataFrame([(f"/p{i}", "/d", n, ".pdf") for i, n in enumerate(["A", "a", "A", "A (2)", "B", "b"])], "path string, folder string, name string, ext string")
    taken = spark.createDataFrame([("/d/a (3).PDF",), ("/d/B.pdf",)], "target string")
    got = {r["path"]: r["target"] for r in naming.unique_names(wanted, taken).collect()}
    assert got == {"/p0": "/d/A.pdf", "/p1": "/d/a (4).pdf", "/p2": "/d/A (5).pdf", "/p3": "/d/A (2).pdf", "/p4": "/d/B (2).pdf", "/p5": "/d/b (3).pdf"}
    pairs = [("/x.pdf", "/n.pdf"), ("/y.pdf", "/n.pdf"), ("/z.pdf", "/z.pdf"), ("/v.pdf", "/w.pdf"), ("/q.pdf", "/Q.pdf")]
    there = ["/x.pdf", "/y.pdf", "/x_paged.md", "/v.pdf", "/W.pdf", "/v.pdf.batch_state.txt", "/q.pdf"]
    plan = naming.rename_plan(spark.createDataFrame(pairs, "path string, target string"), spark.createDataFrame([(x,) for x in there], "path string"))
    assert sorted(map(tuple, plan.collect())) == [
        ("/v.pdf", "/w.pdf", True), ("/v.pdf.batch_state.txt", "/w.pdf.batch_state.txt", False), ("/x.pdf", "/n.pdf", True), ("/x_paged.md", "/n_paged.md", False), ("/y.pdf", "/n.pdf", True)
    ]


def test_unique_names_beside_outputs(spark):
    """One name for many documents equals taking them one by one."""
    random.seed(5)
    names = [random.choice(["A", "a", "B", "B (2)", "C (2)", "C"]) for _ in range(200)]
    wanted = [(f"/p/{i:03}.pdf" if i else "/d/b.pdf", "/d", n, random.choice([".pdf", ".PDF", ".docx"]) if i else ".pdf") for i, n in enumerate(["B", *names])]
    taken = ["/d/a (3)_paged.md", "/d/A (5).pdf.batch_state.txt", "/d/B_ERROR_merged.md", "/d/b.pdf", "/d/c (07).pdf", "/d/C (4)_ERROR_paged.md", "/d/x.pdf"]
    made = naming.unique_names(spark.createDataFrame(wanted, "path string, folder string, name string, ext string"), spark.createDataFrame([(x,) for x in taken], "target string"))
    got = {r["path"]: r["target"] for r in made.collect()}
    low = {x.lower() for x in taken}
    outputs = [o.lower() for o in naming.OUTPUTS]
    keys = {f"{d}/{n}{e}".lower() for _, d, n, e in wanted}
    homes = {p.lower() for p, d, n, e in wanted if p.lower() == f"{d}/{n}{e}".lower()}
    used, want = set(), {}
    for path, folder, name, ext in sorted(wanted):
        key = f"{folder}/{name}{ext}".lower()
        if path.lower() == key:
            want[path] = f"{folder}/{name}{ext}"
            continue
        for no in range(1, 1000):
            full = f"{folder}/{name}{'' if no == 1 else f' ({no})'}"
            k = (full + ext).lower()
            busy = k in low or k + naming.STATE in low or any(full.lower() + o in low for o in outputs)
            if not busy and k not in used and (k not in homes if no == 1 else k not in keys):
                used.add(k)
                want[path] = full + ext
                break
    assert got == want


def test_result_shapes(spark):
    lines = ['{"key":"request-1","response":{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}}', '{"metadata":{"key":"2"},"error":{"message":"bad"}}', '{"candidates":[{"content":{"parts":[{"text":"bare"}]}}]}', '{"code":7,"message":"status"}', '{"custom_id":"request-3","response":{"status_code":200,"body":{"choices":[{"message":{"content":"http"}}]}},"error":null}', '{"custom_id":"request-4","response":{"status_code":500,"body":{}},"error":null}', "{oops", "　"]
    rows = batch.normalize_results(spark.createDataFrame(enumerate(lines), "line_no int, line string")).orderBy("line_no").collect()
    assert [(r["key"], r["text"], r["error"]) for r in rows] == [("request-1", "ab", None), ("2", None, "bad"), (None, "bare", None), (None, None, "status"), ("request-3", "http", None), ("request-4", None, "HTTP 500"), (None, None, "JSON parse failed")]


def test_relative_numbers_out_of_range(spark):
    b = spark.createDataFrame([(1, 1, [4, 9], 2)], "doc_id long, batch_no int, pages array<int>, num_pages int")
    answer = lambda text: spark.createDataFrame([(1, 1, text, None)], "doc_id long, request_no int, text string, error string")
    bad = batch.validate_batch(answer(page(1, "x") + "\n" + page(3, "y")), b)
    assert bad.first()["error_code"] == "REL_OUT_OF_RANGE" and batch.to_absolute(bad).count() == 0
    good = batch.to_absolute(batch.validate_batch(answer(page(1, "x") + "\n" + page(2, "y")), b)).orderBy("pos").collect()
    assert [(r["page_num"], r["content"].split("\n")[0]) for r in good] == [(4, "### -- Begin Page 4 --"), (9, "### -- Begin Page 9 --")]


def test_infer_retries(spark, tmp_path):
    requests = spark.createDataFrame([(i, 1, f"p{i}") for i in range(12)], "doc_id long, batch_no int, payload string")
    rounds = f"{tmp_path}/rounds"

    def shaky(doc, no, payload, attempt):
        if attempt <= doc % 3 or doc == 11:
            raise RuntimeError("try again")
        return payload.upper()

    out = {r["doc_id"]: r for r in batch.infer(requests, shaky, rounds, rounds=2, delay=0).collect()}
    assert len(out) == 12 and all(out[i]["text"] == f"P{i}" and out[i]["round"] == 1 for i in range(11))
    assert out[11]["error"] == "try again" and out[11]["round"] == 2


def test_infer_tries_invalid_answers_again(spark, tmp_path):
    b = spark.createDataFrame([(i, 1, [4], 1, page(1, "x")) for i in range(6)], "doc_id long, batch_no int, pages array<int>, num_pages int, payload string")

    def sloppy(doc, no, payload, attempt):
        if doc == 5 or (doc % 2 and not (tmp_path / f"{doc}").exists()):
            (tmp_path / f"{doc}").touch()
            return payload.replace("### -- End --", "")
        return payload

    out = batch.infer(b, sloppy, f"{tmp_path}/rounds", rounds=3, delay=0, validate=batch.validator(b.drop("payload")))
    assert {r["doc_id"]: (r["error"], r["round"]) for r in out.collect()} == {0: (None, 1), 2: (None, 1), 4: (None, 1), 1: (None, 2), 3: (None, 2), 5: ("END_COUNT", 3)}


def test_silence_until_a_moment(spark):
    rows = [(1, 1, 0, "run", True), (2, 1, 60, "run", True), (3, 2, 0, "run", True), (4, 2, 50, "done", True), (5, 3, 900, "run", True)]
    log = spark.createDataFrame(rows, "event_id long, job_id long, s long, state string, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["job_id"]: (r["waited_s"], r["longest_idle_s"], r["over_idle"]) for r in batch.stalled(log, 500, 100, as_of=F.timestamp_seconds(F.lit(600)), ended=("done",)).collect()}
    assert got == {1: (600, 540, True), 2: (50, 50, False)}


def test_office_parts_and_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in (10, 2, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<s{n}/>")
        z.writestr("ppt/media/a.png", b"png")
        z.writestr("ppt/media/b.wmf", b"wmf")
    rows = files.office_parts(spark.createDataFrame([("/x.pptx", bytearray(data.getvalue())), ("/y.docx", bytearray(b"no zip")), ("/z.odt", None)], "path string, content binary"))
    assert [r["part_name"] for r in rows.where("kind = 'slide'").orderBy("ordinal").collect()] == [f"ppt/slides/slide{n}.xml" for n in (1, 2, 10)]
    assert rows.where("kind = 'media'").count() == 1 and rows.where("kind = 'broken'").count() == 2
    for name, text in (("a_paged.md", "A"), ("a_merged.md", "M"), ("b.md", "B"), ("c.PDF", "%PDF")):
        (tmp_path / name).write_text(text)
    assert [r["content"] for r in files.read_paged(spark, str(tmp_path)).collect()] == ["A"]
    assert files.scan_files(spark, str(tmp_path), [".pdf"]).count() == 1
    (tmp_path / "defs").mkdir()
    (tmp_path / "defs/d.json").write_text('[{"filename":"a","start_page":1,"end_page":2},\n{"filename":"b","start_page":3,"end_page":2}]')
    valid, rejected = files.read_split_defs(spark, f"{tmp_path}/defs")
    assert valid.count() == 0 and {r["reason"] for r in rejected.collect()} == {"SET_REFUSED", "START_AFTER_END"}
    status = batch.doc_status(pages.parse_pages(docs(spark, page(1, "x"), page(1, "[ERROR: OCR Failed for page 1]"))))
    files.write_paged(status, docs(spark, "x", "y"), f"{tmp_path}/out")
    assert {r["doc_id"]: r["status"] for r in files.read_written(spark, f"{tmp_path}/out").collect()} == {0: "complete", 1: "error"}
    late = spark.createDataFrame([(1, "complete", "y2"), (7, "error", "z")], "doc_id long, status string, content string")
    files.write_paged(late, late, f"{tmp_path}/out")
    assert {tuple(r) for r in files.read_written(spark, f"{tmp_path}/out").select("doc_id", "status", "content").collect()} == {(0, "complete", "x"), (1, "complete", "y2"), (7, "error", "z")}
    assert batch.workers(4) == 3 and batch.workers(64) == 8 and batch.workers(4, 99) == 16


def test_request_shapes(spark):
    one = spark.createDataFrame([(1, "text", bytearray(b"%PDF"), "application/pdf")], "doc_id long, payload string, data binary, mime_type string")
    body = lambda service: batch.request_parts(one, "do", service).first()["body"]
    assert '"inlineData":{"mimeType":"application/pdf","data":"JVBERg=="}' in body("parts")
    assert '"type":"document"' in body("blocks") and "data:application/pdf;base64,JVBERg==" in body("messages")
