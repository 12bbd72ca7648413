import hashlib
import os

from pyspark.sql import functions as F

from orewright.operators import partition
from orewright.plans import file_queries
from orewright.sources import readers, writers


def _write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    _write(tmp_path / "d/a.txt", "one\r\ntwo\nthree")
    _write(tmp_path / "d/b.txt", "")
    got = {r.doc_id: r.text for r in readers.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got["a.txt"] == "one two\nthree"


def test_documents_written_and_read(spark, tmp_path, monkeypatch):
    """A file for each row, of repeated and missing ids too, without a folder for each; read in rounds by few tasks."""
    rows = [(i % 90 if i else None, f"text {i}\r\nend") for i in range(100)] + [(-7, "")]
    spark.createDataFrame(rows, "file_id long, content string").write.parquet(f"{tmp_path}/doc_files.parquet")
    made = []
    monkeypatch.setattr(file_queries, "FILES", 40)
    written = file_queries.writers.write_documents

    def spied(df, *more):
        made.append(written(df, *more))
        files = [f for folder in made[-1] for f in os.listdir(folder.removeprefix("file://"))]
        assert len(files) == df.count() and not any(f.endswith(".crc") for f in files)
        return made[-1]

    monkeypatch.setattr(file_queries.writers, "write_documents", spied)
    monkeypatch.setattr(readers, "READ_TASKS", 1)
    got = sorted((r.file_id or 0, r.length, r.hash) for r in file_queries.documents_read(spark, str(tmp_path)).collect())
    whole = [(i or 0, t.replace("\r\n", " ") + "\n") for i, t in rows]
    assert got == sorted((i, len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in whole)
    assert len(made) == 3 and not any(os.path.exists(f.removeprefix("file://")) for folders in made for f in folders)


def test_baskets(spark, tmp_path):
    path = _write(tmp_path / "b.dat", "1 2  3 2\n\n7\nx 5\n")
    assert [r["items"] for r in readers.read_baskets(spark, path).orderBy("basket_id").collect()] == [[1, 2, 3], [7], [5]]


def test_edges(spark, tmp_path):
    path = _write(tmp_path / "e.txt", "% sym\n1 2\n\n  3\t4 0.5\n5\n6 7x\n9 8\n")
    assert [(r.u, r.v) for r in readers.read_edges(spark, path).orderBy("seq").collect()] == [(1, 2), (3, 4), (9, 8)]


def test_points(spark, tmp_path):
    path = _write(tmp_path / "p.dat", "1.5,2\n-3, 4e1\n")
    assert [r.features for r in readers.read_points(spark, path).orderBy("id").collect()] == [[1.5, 2.0], [-3.0, 40.0]]


def test_adjacency(spark, tmp_path):
    path = _write(tmp_path / "g.graph", "% c\n4 3\n 2 3\n1  3\n# c\n1 2\n\n")
    vertices, arcs = readers.read_adjacency(spark, path)
    assert [r.id for r in vertices.orderBy("id").collect()] == [1, 2, 3, 4]
    assert sorted((r.src, r.dst) for r in arcs.collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    parts = readers.read_parts(spark, _write(tmp_path / "g.part", "0\n0\n1\n1\n"))
    assert partition.partition_report(arcs, parts).first().edge_cut == 2


def test_writers(spark, tmp_path):
    metrics = spark.createDataFrame([(0, 5, 1, 2)], "round int, edge_cut int, swaps int, migrations int")
    writers.write_report(metrics, f"{tmp_path}/r", temperature=2.0, policy="HYBRID")
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/r")
    assert back.columns == ["round", "edge_cut", "swaps", "migrations", "temperature", "policy"] and back.first().policy == "HYBRID"
    writers.write_text(metrics, "edge_cut", f"{tmp_path}/t")
    writers.write_text(metrics, "swaps", f"{tmp_path}/t", append=True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["1", "5"]
    writers.write_table(metrics, f"{tmp_path}/x.orc", "orc", by=["round"])
    assert readers.read_any(spark, f"{tmp_path}/x.orc").count() == 1
    assert readers.read_any(spark, f"{tmp_path}/t").filter(F.length("value") == 1).count() == 2
    assert writers.read_text(spark, f"{tmp_path}/t").count() >= 2


def test_stream_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in/a", "1 2\n% no\n3 4\n")
    query = readers.stream_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines_read").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("lines_read").collect())) == [(1, 2), (3, 4)]
