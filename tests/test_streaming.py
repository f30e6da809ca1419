from lodegraph import CsvImportConfig, GraphSession
from lodegraph.streaming.ingest import stream_nodes


def test_files_become_nodes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,x\n2,y\n")
    g = GraphSession.open(spark, str(tmp_path / "db"))
    g.execute("CREATE NODE TABLE T(id INT64, name STRING, PRIMARY KEY(id))")
    for text in (None, "id,name\n3,z\nbad,w\n"):
        if text:
            (folder / "b.csv").write_text(text)
        q = stream_nodes(g, "T", str(folder), str(tmp_path / "cp"), CsvImportConfig(ignore_errors=True), available_now=True)
        q.awaitTermination()
        assert q.exception() is None
    again = GraphSession.open(spark, str(tmp_path / "db"), read_only=True)
    assert sorted(r[0] for r in again.execute("MATCH (t:T) RETURN t.id").collect()) == [1, 2, 3]
