import pytest

from orrery.sources import landing


def _land(folder, run, pages, whole=True):
    (folder / run).mkdir()
    for name, text in pages.items():
        (folder / run / name).write_bytes(text)
    if whole:
        (folder / run / "_SUCCESS").touch()


def _rows(df):
    return sorted(map(tuple, df.select("run", "page", "number", "record").collect()))


def test_pages_of_whole_runs(spark, tmp_path):
    landing.register(spark)
    read = spark.read.format(landing.FORMAT)
    assert read.load(str(tmp_path)).count() == 0
    _land(tmp_path, "r1", {"a.json": b'{"x": 1}\r\n\n{"x": "\xce\xb1"}', "b.json": b"", "_note": b"no page", ".hid": b"no page"})
    _land(tmp_path, "r2", {"a.json": b"\n".join(b'{"x": %d}' % i for i in range(10_000))})
    _land(tmp_path, "r3", {"a.json": b"bad \xff line\n"}, whole=False)
    (tmp_path / "_temporary").mkdir()
    got = read.load(f"file://{tmp_path}")
    assert _rows(got.where("run = 'r1'")) == [("r1", "a.json", 1, '{"x": 1}'), ("r1", "a.json", 3, '{"x": "α"}')]
    assert got.where("run = 'r2'").count() == 10_000 and got.count() == 10_002 and got.rdd.getNumPartitions() == 3
    assert _rows(read.option("whole", "false").load(str(tmp_path)).where("run = 'r3'")) == [("r3", "a.json", 1, "bad � line")]
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format(landing.FORMAT).load().count()


def test_a_stream_reads_each_run_once(spark, tmp_path):
    landing.register(spark)
    source, rows, marks = tmp_path / "in", tmp_path / "rows", tmp_path / "marks"
    source.mkdir()

    def step():
        stream = spark.readStream.format(landing.FORMAT).load(str(source)).writeStream.format("parquet").option("path", str(rows)).option("checkpointLocation", str(marks))
        stream.trigger(availableNow=True).start().awaitTermination()
        return [r[:2] for r in _rows(spark.read.schema("run string, page string, number long, record string").parquet(str(rows)))]

    _land(source, "r1", {"a.json": b"1\n2\n"})
    assert step() == [("r1", "a.json")] * 2
    _land(source, "r2", {"a.json": b"3\n"})
    _land(source, "r3", {"a.json": b"4\n"}, whole=False)
    assert step() == [("r1", "a.json")] * 2 + [("r2", "a.json")]
    (source / "r3" / "_SUCCESS").touch()
    assert step() == step() == [("r1", "a.json")] * 2 + [("r2", "a.json"), ("r3", "a.json")]


def test_text_files_are_whole(spark, tmp_path):
    from orrery.sources.files import text_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.sql").write_bytes(b"one\n\ntwo\r\nthree")
    (tmp_path / "y.sql").write_bytes(b"")
    (tmp_path / "z.txt").write_bytes(b"no")
    assert sorted(r.content for r in text_files(spark, str(tmp_path), "*.sql").collect()) in (["", "one\n\ntwo\r\nthree"], ["one\n\ntwo\r\nthree"])
