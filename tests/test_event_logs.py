from korpusa.sources.formats import sse_stream
from korpusa.streaming.events import run_once

LOG = ': ping\n\nevent: token\ndata: {"n": 1}\n\ndata: {"n":\ndata: 2}\n\nevent: token\r\ndata:{"n": 3}\n\nevent: end\n\nevent: token\ndata: {bad\n\nid: 9\nevent: a\nevent: b\ndata: {"n": 4, "data": "x"}\n\n\n\nevent: last\ndata: {"n": 5}'


def read(spark, folder):
    rows = sse_stream(spark, str(folder), "n int, s string", files=1)
    return [(r.event, r.n, r.s, r.broken) for r in run_once(spark, rows.select("event", "data.n", "data.s", "broken"), "append").collect()]


def test_frames(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(LOG.encode())
    (tmp_path / "empty.log").write_bytes(b"")
    got = read(spark, tmp_path)
    assert {(e, n) for e, n, _, b in got if b is None} == {("token", 1), ("message", 2), ("token", 3), ("b", 4), ("last", 5)}
    assert [(e, n, b) for e, n, _, b in got if b is not None] == [("token", None, "{bad")]
    assert len(got) == 6


def test_frames_across_splits(spark, tmp_path):
    many = 400
    (tmp_path / "a.log").write_bytes("".join(f'event: e{i % 3}\ndata: {{"n": {i},\ndata: "s": "{"x" * (i % 40)}"}}\n\n' for i in range(many)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    try:
        got = read(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=lambda r: r[1]) == [(f"e{i % 3}", i, "x" * (i % 40), None) for i in range(many)]
