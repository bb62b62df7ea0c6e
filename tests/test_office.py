"""Office files read by parts."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from pageflow.sources import io as files
from pageflow.sources import office


def write(folder):
    random = os.urandom
    folder.mkdir()
    (folder / "deep").mkdir()
    with zipfile.ZipFile(folder / "a.pptx", "w") as z:
        for n in (10, 2, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<s{n}/>" * 50)
            z.writestr(f"ppt/media/picture{n}.png", random(300_000))
        z.writestr("ppt/notesSlides/notesSlide2.xml", "<n/>")
        z.writestr("ppt/media/b.wmf", b"wmf")
        z.writestr("other.bin", random(100))
    with zipfile.ZipFile(folder / "deep/b.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w>語</w>" * 1000)
        z.writestr("word/styles.xml", "<s/>")
        z.writestr("word/media/x.emf", b"emf")
        z.writestr("word/media/y.svg", b"svg")
    with zipfile.ZipFile(folder / "c.odt", "w") as z:
        z.writestr("content.xml", "<o/>")
        z.writestr("Pictures/p.jpeg", b"jpeg")
    (folder / "broken.docx").write_bytes(b"no zip at all")
    (folder / "none.txt").write_text("x")


def rows(df):
    return sorted(("/" + r["path"].split(":")[-1].lstrip("/"), r["part_name"] or "", r["kind"], r["ordinal"], r["mime"] or "", bytes(r["data"] or b"")) for r in df.collect())


def test_same_rows_as_whole_files(spark, tmp_path):
    write(tmp_path / "in")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/in").where("path like '%.docx' or path like '%.odt' or path like '%.pptx'")
    want = rows(files.office_parts(whole.select("path", "content")))
    assert len(want) == 13 and {r[2] for r in want} == {"slide", "notes", "media", "main", "styles", "broken"}
    for size in (1, 400_000, 1 << 26):
        assert rows(office.read_office_parts(spark, f"{tmp_path}/in", task_bytes=size)) == want
    assert rows(office.read_office_parts(spark, f"file://{tmp_path}/in")) == want
    assert rows(office.read_office_parts(spark, f"{tmp_path}/in/c.odt")) == [r for r in want if r[0].endswith("c.odt")]
    listed = office.read_office_parts(spark, f"{tmp_path}/in", data=False)
    assert rows(listed) == sorted((*r[:5], b"") for r in want)
    slides = office.read_office_parts(spark, f"{tmp_path}/in").where((F.col("kind") == "slide") & (F.col("ordinal") > 1))
    assert rows(slides) == [r for r in want if r[2] == "slide" and r[3] > 1]
    some = office.read_office_parts(spark, f"{tmp_path}/in", kinds=["main", "broken"]).where(F.col("kind").isin("broken", "slide"))
    assert rows(some) == [r for r in want if r[2] == "broken"]
    (tmp_path / "nothing").mkdir()
    assert office.read_office_parts(spark, f"{tmp_path}/nothing").count() == 0


class Counted(io.FileIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        Counted.taken += len(data)
        return data


def test_only_wanted_bytes_are_read(tmp_path, monkeypatch):
    write(tmp_path / "in")
    monkeypatch.setattr(office.OfficeReader, "_open", lambda self, name: Counted(name))
    taken = {}
    for kind in ("slide", "media"):
        reader = office.OfficeReader({"path": f"{tmp_path}/in/a.pptx"})
        rest = list(reader.pushFilters([office.EqualTo(("kind",), kind), office.EqualTo(("ordinal",), 2)]))
        assert rest == [office.EqualTo(("ordinal",), 2)]
        Counted.taken = 0
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
        taken[kind] = Counted.taken
    assert taken["slide"] < 10_000 and taken["media"] > 900_000


def test_a_large_file_has_several_tasks(tmp_path):
    write(tmp_path / "in")
    reader = office.OfficeReader({"path": f"{tmp_path}/in/a.pptx", "bytes": "310000"})
    runs = reader.partitions()
    assert len(runs) == 3 and sum(b.num_rows for p in runs for b in reader.read(p)) == 7
    assert len(office.OfficeReader({"path": f"{tmp_path}/in", "bytes": "310000"}).partitions()) == 3
    assert len(office.OfficeReader({"path": f"{tmp_path}/in"}).partitions()) == 1
