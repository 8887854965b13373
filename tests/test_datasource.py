"""Files as a data source: kinds, broken and large files, page ranges, and as a stream."""

import pytest

from tessera.sources import datasource

EXTRACTOR = """
def pages(content):
    if b"|" not in content:
        raise RuntimeError("no pages")
    return content.decode().split("|")
"""


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(datasource.Documents)
    (tmp_path / "extractor_of_tests.py").write_text(EXTRACTOR)
    spark.sparkContext.addPyFile(str(tmp_path / "extractor_of_tests.py"))
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "a.md").write_bytes(b"# x\r\ny")
    (root / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (root / "c.pdf").write_bytes(b"|".join(b"page %d" % k if k % 7 else b"  " for k in range(60)))
    (root / "deep" / "d.pdf").write_bytes(b"broken")
    (root / "deep" / "e.bin").write_bytes(b"no")
    (root / "deep" / "f.py").write_text("")
    return root


def read(spark, root, **options):
    return spark.read.format("documents").options(extractor="extractor_of_tests:pages", **options).load(str(root))


def test_files_as_a_source(spark, source):
    rows = read(spark, source)
    got = sorted((r.filename, r.file_type, r.page or 0, r.text) for r in rows.where("error is null and file_type <> 'pdf'").collect())
    assert got == [("a.md", "markdown", 0, "# x\ny"), ("b.txt", "txt", 0, "café"), ("f.py", "py", 0, "")]
    assert [(r.filename, r.error, r.text) for r in rows.where("error is not null").collect()] == [("d.pdf", "RuntimeError: no pages", None)]
    pages = [(r.page, r.text, r.total_pages) for r in rows.where("filename = 'c.pdf'").orderBy("page").collect()]
    assert pages == [(k + 1, f"page {k}", 60) for k in range(60) if k % 7]
    assert read(spark, source, recursive="false").where("error is not null").count() == 0
    docs = datasource.documents(rows)
    assert docs.select("doc_id").distinct().count() == docs.count() == len(pages) + 3 and docs.where("source like '/%in/a.md'").count() == 1


def test_page_ranges_and_runs_of_files(spark, source):
    whole = read(spark, source)
    cut = read(spark, source, partitionBytes="50")
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 1
    key = lambda df: sorted(map(str, df.collect()))
    assert key(cut) == key(whole)
    files = [datasource.File(f"/x/{i}.txt", 30, 0) for i in range(5)] + [datasource.File("/x/y.pdf", 250, 0), datasource.File("/x/z.txt", 500, 0)]
    got = datasource.parts(files, 100)
    assert sorted((len(p.files), p.number, p.of) for p in got) == [(1, 0, 1), (1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 0, 1), (3, 0, 1)]


def test_paths_that_are_not_there(spark, source):
    with pytest.raises(Exception, match="FileNotFoundError"):
        read(spark, source / "none").collect()
    with pytest.raises(Exception, match="no kind"):
        read(spark, source / "deep" / "e.bin").collect()
    assert read(spark, source / "a.md").first().text == "# x\ny"


def test_files_as_a_stream(spark, source, tmp_path):
    seen = []

    def run():
        stream = spark.readStream.format("documents").option("extractor", "extractor_of_tests:pages").load(str(source))
        take = lambda batch, _: seen.append(sorted((r.filename, r.error is None) for r in batch.collect()))
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert len(sum(seen, [])) == 51 + 4 and ("d.pdf", False) in seen[0]
    seen.clear()
    (source / "g.md").write_text("later")
    run()
    assert [x for x in seen if x] == [[("g.md", True)]]
