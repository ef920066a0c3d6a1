"""Parser adapters, typed problems, upload guards, ingestion that parses once, retries."""

import pytest
from pyspark.sql import functions as F

from folio.operators import embedding
from folio.sources import files
from folio.streaming import ingest as I

HTML = b"""<!DOCTYPE html><html><head><title> A &amp; B
</title><meta name="Author" content="Ann"><meta name="description" content=" "><meta name="generator" content="pen"><meta name="DATE" content="2001"><style>p{}</style></head>
<body><h1>Head</h1><p>One <b>bold</b>ly &lt;said&gt;.<br>next<script>var x="<p>no</p>"</script><hr><div>second   page</div><hr></body></html>"""


def test_html_pages_and_metadata():
    p = files.html_document(HTML)
    assert p.pages == ["Head\nOne boldly <said>.\nnext", "second page", ""] and p.metadata == {"title": " A & B\n", "author": "Ann", "subject": " ", "creator": "pen", "creation_date": "2001"}
    for bad in (b"\xff\xfe<p>", b"no markup"):
        with pytest.raises(files.BrokenFile):
            files.html_document(bad)


def test_html_references_without_a_semicolon_are_text():
    p = files.html_document(b"<title>a &amp; b&amp</title><meta name=author content='x&amp'><p>&lt; &lt &#38; &#38 & &eacute;&amp")
    assert p.metadata == {"title": "a & b&amp", "author": "x&amp"} and p.pages == ["< &lt & &#38 & \xe9&amp"]


def test_documents_and_their_problems(spark):
    def parser(content):
        if content == b"page":
            raise files.ExtractionFailed("page 2")
        if content == b"bad":
            raise files.BrokenFile("broken")
        if content == b"text":
            raise UnicodeDecodeError("utf-8", b"", 0, 1, "why")
        return [] if content == b"none" else files.Parsed(["a", "b"], {"title": " T ", "author": " ", "other": "x"}) if content == b"two" else ["p"] * 9

    cases = [(n, n.encode(), "empty" if n == "empty" else None) for n in ("two", "none", "many", "page", "bad", "text", "empty")]
    got = files.parse_documents(spark.createDataFrame(cases, "document_id string, content binary, problem string"), parser, 5).collect()
    assert {(r.document_id, r.problem, r.detail) for r in got if r.problem} == {("none", "no_pages", "0 pages"), ("many", "too_many_pages", "9 pages"), ("page", "extraction_failed", "page 2"), ("bad", "unreadable", "broken"), ("text", "unreadable", "'utf-8' codec can't decode bytes in position 0-0: why"), ("empty", "empty", None)}
    two = [r for r in got if r.document_id == "two"]
    assert [(r.page_number, r.text, r.metadata.title, r.metadata.author, r.metadata.mod_date) for r in two] == [(1, "a", "T", None, None), (2, "b", "T", None, None)]
    assert all(r.problem is None or r.problem in files.PROBLEMS for r in got)


@pytest.mark.parametrize(
    ("path", "at", "fits"),
    [
        ("/data/in/a.html", "/data/in/a.html", True), ("file:///data/in/a.html", "/data/in/a.html", True), ("hdfs://host:1/data/in/a", "/data/in/a", True), ("/data/in/../in/./a", "/data/in/a", True), ("/data/in/../../../../x", "/x", False), ("/data/in", "/data/in", False), ("/data/inner/a", "/data/inner/a", False),
        ("/data/in/..\\..\\a", "/a", False), ("", "/", False),
    ],
)
def test_paths_are_walked_before_they_are_judged(spark, path, at, fits):
    r = spark.createDataFrame([(path,)], "p string").select(files.normalised_path(F.col("p")).alias("at"), files.inside(F.col("p"), ("/data/in/", "/other")).alias("fits")).first()
    assert (r.at, r.fits) == (at, fits)


def test_ingestion_parses_a_file_once(spark, tmp_path):
    land, seen = tmp_path / "in", tmp_path / "seen"
    land.mkdir()
    seen.mkdir()
    for i in range(3):
        (land / f"{i}.txt").write_text(f"file {i} has a page. It ends.\fand another {i}.")

    def parser(content):
        import os

        (lambda f: os.close(f))(os.open(f"{seen}/{content.decode()[:6]}-{os.urandom(4).hex()}", os.O_CREAT))
        return content.decode().split("\f")

    I.ingest(spark, f"file://{land}", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", parser, embed=embedding.hash_embedder())
    assert len(list(seen.iterdir())) == 3
    chunks = I.committed(spark, f"file://{tmp_path}/out", "chunks").collect()
    assert len(chunks) == 6 and all(abs(sum(x * x for x in c.embedding) - 1) < 1e-5 for c in chunks)


def test_waits_double_within_their_jitter(monkeypatch):
    waits = []
    monkeypatch.setattr(I.time, "sleep", waits.append)

    def fails():
        raise OSError

    with pytest.raises(OSError):
        I.with_retries(fails, 4, 1.0, longest=5.0)
    assert all(w * 0.5 <= x <= w for w, x in zip((1, 2, 4, 5), waits, strict=True)) and len(set(waits)) == 4
    with pytest.raises(ValueError):
        I.with_retries(lambda: (_ for _ in ()).throw(ValueError()), 3)
    assert len(waits) == 4 and I.with_retries(lambda: None) == 0
