"""Sources and sinks on small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.operators import manifest
from quillmill.sources import fetch, files, sinks
from quillmill.streaming import streams


@pytest.fixture
def tree(tmp_path):
    for name, data in {"raw/logic/a.txt": b"one\n\n" + b"text of a book " * 20, "raw/logic/b.html": b"<html><nav>menu</nav><h1>Title</h1><p>" + b"body " * 60 + b"</p></html>", "raw/x/c.pdf": b"%PDF", "raw/x/d.txt": b"short", "raw/x/e.txt": b"bad \xff byte " * 20, "raw/x/empty.txt": b"", "raw/x/extraction_log.txt": b"log", "raw/x/f.djvu": b"d"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("1.xhtml", "<html><head><title>no</title></head><body><h1>One</h1><p>" + "chapter text " * 20 + "</p></body></html>")
        z.writestr("2.xhtml", "<p>too short</p>")
    (tmp_path / "raw/x/g.epub").write_bytes(book.getvalue())
    (tmp_path / "raw/x/broken.epub").write_bytes(b"no zip")
    return str(tmp_path / "raw")


def test_raw_tree_and_extract(spark, tree):
    raw = files.raw_tree(spark, tree)
    rows = {r.rel: r for r in raw.select("rel", "category", "suffix", "readable").collect()}
    assert rows["logic/a.txt"].category == "logic" and rows["x/c.pdf"].suffix == ".pdf" and not rows["x/f.djvu"].readable and len(rows) == 9
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.extract(raw).collect()}
    assert {n: r.outcome for n, r in got.items()} == {"a.txt": "ok", "b.html": "ok", "c.pdf": "unsupported", "d.txt": "too_short", "e.txt": "ok", "extraction_log.txt": "too_short", "f.djvu": "unsupported", "g.epub": "ok", "broken.epub": "too_short"}
    assert "menu" not in got["b.html"].text and "Title" in got["b.html"].text and "�" in got["e.txt"].text and "too short" not in got["g.epub"].text
    counts = {r.outcome: r.n for r in files.extraction_metrics(files.extract(raw)).collect()}
    assert counts == {"ok": 4, "too_short": 3, "unsupported": 2}


def test_text_files(spark, tree):
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    assert names(files.text_files(spark, tree)) == ["a.txt", "d.txt", "e.txt"]
    assert names(files.text_files(spark, tree, least=50)) == ["a.txt", "e.txt"]


def test_json_lines_and_manifest(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": null}\n')
    assert [r.a for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", drop_bad=True).collect()] == [1, None]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    row = {"filename": "f", "url": "u", "file_size": 5}
    for name, value in {"list": [row, {"filename": None}], "wrapped": {"files": [row]}, "broken": None}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value) if value else "{oops")
    assert [(r.filename, r.file_size) for n in ("list", "wrapped", "broken") for r in files.manifest(spark, str(tmp_path / f"{n}.json")).collect()] == [("f", 5)] * 2


def test_search_answers(spark):
    pages = spark.createDataFrame([("q", 1, '{"next": "n", "results": [{"id": 1}, {"id": 2}]}'), ("q", 4, '{"results": [{"id": 9}]}'), ("q", 2, "broken"), ("q", 3, None)], "query string, page int, json string")
    assert [r.item.id for r in files.search_pages(pages, "struct<id:int>").orderBy("pos").collect()] == [1, 2]
    answers = spark.createDataFrame([('{"response": {"docs": [{"identifier": "a", "mediatype": "texts"}, {"identifier": "b", "mediatype": "audio"}]}}',), ("broken",), (None,)], "json string")
    assert [[x.identifier for x in r.h] for r in answers.select(files.archive_hits(F.col("json")).alias("h")).collect()] == [["a"], [], []]


def stub_get(url):
    return (200, b"x" * 2000) if url.endswith("good") else (200, b"x") if url.endswith("small") else (404, None)


def test_fetch(spark):
    spark.sparkContext.addPyFile(__file__)
    spark.dataSource.register(fetch.FetchSource)
    rows = spark.read.format("fetch").option("urls", "a/good\na/small").option("transport", "test_sources:stub_get").option("slices", "2")
    got = {r.url: r.outcome for r in rows.load().collect()}
    assert got == {"a/good": "ok", "a/small": "too_small"}


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    docs = spark.createDataFrame([(1, "a b", "x", "train"), (2, "c", None, "val"), (3, None, "x", "train")], "doc_id int, text string, category string, split string")
    sinks.write_documents(docs, f"{base}/docs")
    sinks.write_documents(docs.limit(2), f"{base}/docs")
    assert spark.read.parquet(f"{base}/docs").count() == 2
    sinks.write_training(docs, f"{base}/t")
    assert {(r.split, r.text) for r in spark.read.schema("text string, split string").json(f"{base}/t").collect()} == {("train", "a b"), ("train", None), ("val", "c")}
    sinks.append(docs, f"{base}/log")
    sinks.append(docs, f"{base}/log")
    assert spark.read.parquet(f"{base}/log").count() == 6
    sinks.write_report(docs.groupBy("category").count(), f"{base}/report")
    assert spark.read.json(f"{base}/report").count() == 2
    sinks.write_index(docs, f"{base}/index")
    entries, header = sinks.read_index(spark, f"{base}/index")
    assert entries.count() == 3 and header.collect()[0].asDict() == {"version": "1.0", "total": 3, "categories": ["x"]}
    new = spark.createDataFrame([(2, "new", None, None), (9, "more", None, None), (None, "n", None, None)], docs.schema)
    merged = {(r.doc_id, r.text) for r in sinks.upsert(docs, new, "doc_id").collect()}
    assert merged == {(1, "a b"), (3, None), (2, "new"), (9, "more"), (None, "n")}
    sinks.write_examples(docs.withColumnRenamed("category", "example_type"), f"{base}/ex")
    assert spark.read.parquet(f"{base}/ex").filter("example_type = 'x'").count() == 2
    row = sinks.rounded_results(spark.createDataFrame([(0.12345, 0.12345678)], "confidence double, cost double")).first()
    assert (row.confidence, row.cost) == (0.123, 0.123457)


def test_manifest_parts(spark):
    rows = spark.createDataFrame([("u", 3, "c"), ("u", 1, "a"), ("v", 2, None), (None, 5, "x"), (None, 4, "y")], "url string, n int, t string")
    assert {(r.url, r.n, r.t) for r in manifest.first_of(rows, "url", ["n"]).collect()} == {("u", 1, "a"), ("v", 2, None), (None, 4, "y")}
    hits = spark.createDataFrame([("Meditations", ["X"]), ("Other", ["Rene Descartes"]), ("Other", None), (None, ["Y"])], "title string, authors array<string>")
    assert manifest.relevant_hits(hits, F.lit("descartes")).count() == 2
    points = spark.createDataFrame([("the cause of motion stands", "cause motion mind soul", True), ("nothing here", "cause motion mind soul", False), (None, "cause", False)], "r string, p string, want boolean")
    assert all(r.got == r.want for r in points.select(S.rubric_hit(F.col("r"), F.col("p")).alias("got"), "want").collect())


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i % 3, f"2024-01-0{i % 5 + 1} 00:00:00") for i in range(30)], "url int, at string").selectExpr("url", "cast(at as timestamp) as download_date").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url int, download_date timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.url for r in streams.run_available(streams.first_urls(stream).select("url"), "append", "t").collect()) == [0, 1, 2]
