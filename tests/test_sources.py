"""Sources that settle: addresses, numbered pages in batches and as a stream, lines of JSON."""

import json

import pytest

from leafmill.sources import paged, readers
from leafmill.streaming import state


def put(spark, path, bodies):
    paged.register(spark)
    spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in bodies], "page long, body binary").repartition(2).write.format("leafmill_pages").mode("append").option("path", path).save()


def test_pages_settle(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    put(spark, path, [(0, b"{}"), (1, None), (2, b"x" * 50), (3, b"")])
    read = lambda **more: {r.page: (r.ok, bytes(r.body) if r.body is not None else None, r.error) for r in spark.read.format("leafmill_pages").options(path=path, **more).load().collect()}
    assert read() == {0: (True, b"{}", None), 1: (False, None, "missing"), 2: (True, b"x" * 50, None), 3: (True, b"", None)}
    assert read(max_bytes=49)[2] == (False, None, "too large") and read(max_bytes=50)[2][0]
    assert spark.read.format("leafmill_pages").option("path", path).load().rdd.getNumPartitions() == 4
    put(spark, path, [(1, b"late"), (0, b"again")])  # tried again: in its place, and the index doesn't shrink
    assert read()[1] == (True, b"late", None) and read()[0][1] == b"again" and len(read()) == 4
    assert not [p for p in (tmp_path / "p").iterdir() if p.name.startswith(".page")]
    assert spark.read.format("leafmill_pages").option("path", f"file://{tmp_path}/none").load().count() == 0
    with pytest.raises(Exception, match="file: addresses only"):
        put(spark, "http://example.invalid/p", [(0, b"x")])


def test_addresses_settle(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>a</p>")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    rows = [(f"file://{tmp_path}/a.html", 1), (f"file://{tmp_path}/b.pdf", 2), (f"file://{tmp_path}/none", 3), ("javascript:alert(1)", 4), (None, 5), ("http://127.0.0.1:9/x", 6)]
    got = {r.n: (r.ok, r.type, r.error) for r in paged.fetched_urls(spark.createDataFrame(rows, "url string, n long"), seconds=2).collect()}
    assert got == {1: (True, "text/html", None), 2: (True, "application/pdf", None), 3: (False, None, "missing"), 4: (False, None, "refused"), 5: (False, None, "refused"), 6: (False, None, "URLError")}
    files = {r.url.rsplit("/")[-1]: (r.kind, r.refused) for r in readers.fetched_files(spark, f"file://{tmp_path}", "*.*").collect()}
    assert files == {"a.html": ("html", False), "b.pdf": ("pdf", False)}
    none = paged.fetched_urls(spark.createDataFrame([], "url string"))
    assert none.collect() == [] and none.columns == ["url", "ok", "type", "body", "error"]


def test_a_stream_of_pages_goes_on(spark, tmp_path):
    path, lines = f"file://{tmp_path}/p", f"file://{tmp_path}/lines"
    paged.register(spark)

    def drain():
        stream = spark.readStream.format("leafmill_pages").option("path", path).load().selectExpr("page", "ok", "cast(body as string) as text")
        q = stream.writeStream.format("json").option("path", lines).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    put(spark, path, [(0, b"zero"), (1, None)])
    drain()
    drain()  # nothing new
    put(spark, path, [(k, f"page {k}".encode()) for k in range(2, 5)])
    drain()
    out = state.run_to_end(readers.ndjson_events(spark, lines, "page long, ok boolean, text string"), spark, f"file://{tmp_path}/out")
    assert sorted((r.page, r.ok, r.text) for r in out.collect()) == [(0, True, "zero"), (1, False, None), (2, True, "page 2"), (3, True, "page 3"), (4, True, "page 4")]


def test_lines_of_json_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    schema = "id long, at timestamp, note string, tags array<string>"
    df = spark.sql("select id, timestamp_millis(id * 1001) as at, case when id % 2 = 0 then concat('line\\n\"', id, '\" é') end as note, array('a', cast(id as string)) as tags from range(7)")
    readers.write_ndjson(df, path)
    with next((tmp_path / "l").glob("*.json")).open() as f:
        assert all("note" not in r or r["note"] is not None for r in map(json.loads, f))  # nulls are left out
    (tmp_path / "l/broken.json").write_text("not json\n")
    got = state.run_to_end(readers.ndjson_events(spark, path, schema), spark, f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.where("id is not null").collect())) == sorted(map(tuple, df.collect())) and got.count() == 8
