from pyspark.sql import functions as F

from quillon.streaming.folders import start, stream


def test_files_that_arrive_are_read_once(spark, tmp_path):
    folder, header, seen = tmp_path / "in", "Id (N) (P),At (D),What (T)", []
    folder.mkdir()
    (folder / "a.csv").write_text(header + "\n1,2020-01-01 00:00:00,x\n2,,y\n")

    def sink(rows, number):
        seen.extend((number, *r) for r in rows.select("Id", "What").collect())

    for _ in range(2):
        start(stream(spark, str(folder), header), str(tmp_path / "state"), sink).awaitTermination(60)
    (folder / "b.csv").write_text(header + "\n3,2020-01-02 00:00:00,z\n")
    start(stream(spark, str(folder), header), str(tmp_path / "state"), sink).awaitTermination(60)
    assert sorted(x[1:] for x in seen) == [(1.0, "x"), (2.0, "y"), (3.0, "z")]
    assert len({x[0] for x in seen}) == 2


def test_windows_with_late_rows(spark, tmp_path):
    folder, header, seen = tmp_path / "in", "Id (N),At (D)", {}
    folder.mkdir()
    (folder / "a.csv").write_text(header + "\n1,2020-01-01 00:01:00\n2,2020-01-01 00:04:00\n3,2020-01-01 00:11:00\n")
    counts = stream(spark, str(folder), header, "1 minute", "At").groupBy(F.window("At", "10 minutes")).count()

    def sink(rows, number):
        seen.update({str(r["window"]["start"]): r["count"] for r in rows.collect()})

    start(counts, str(tmp_path / "state"), sink, "update").awaitTermination(60)
    assert sorted(seen.values()) == [1, 2]
