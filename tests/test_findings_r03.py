"""What the third round's findings were about: each would have failed before."""

import datetime as dt

import duckdb
import pytest

from leafmill.plans.catalogue import ORACLES, QUERIES


def both(spark, name, tables):
    """Sorted rows of a query and of its SQL over small tables ({name: SQL that makes it})."""
    import tempfile

    con, path = duckdb.connect(), tempfile.mkdtemp()
    con.execute("set timezone='UTC'")
    for table, made in tables.items():
        con.execute(f"copy ({made}) to '{path}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    got = QUERIES[name](spark, path)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"select {columns} from ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def events(*rows):
    start = dt.datetime(2024, 1, 1)
    made = ", ".join(f"({i}::bigint, timestamp '{start + dt.timedelta(seconds=s)}', 1::bigint, 'view', 1.0::double)" for i, s in rows)
    return {"events": f"select * from (values {made}) t(event_id, ts, user_id, event_type, value)"}


@pytest.mark.parametrize("name", ["ticket_desk", "stream_ticket_desk"])
def test_desks_go_by_the_nearest_second(spark, name):
    """A ticket of second 0.6 is of second 1, so that 25 days and 0.4 seconds later it is still there; and commands of one such
    second stand by their numbers."""
    got, want = both(spark, name, events((0, 0.6), (5, 25 * 86_400 + 0.4), (16, 40 * 86_400 + 0.6), (9, 40 * 86_400 + 1.2)))
    assert got == want and {r[3] for r in got} == {"pending", "claimed"}


def test_lifecycles_go_by_the_nearest_second(spark):
    """Ten days and 0.6 seconds after a ticket of second 0.4, it is a second over its time."""
    got, want = both(spark, "ticket_lifecycle", events((0, 0.4), (1, 10 * 86_400 + 0.6)))
    assert got == want == [("t1", "gone", 1, 1)]


def shuffled(spark, run):
    """Rows written to shuffles by what `run` does."""
    spark.sparkContext.setJobGroup("shuffled", "shuffled")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))}
    known = set(stages())
    run()
    return sum(n for i, n in stages().items() if i not in known)


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
LINES = "from '/root/testdata/sf0.001/lineitem.parquet'"


def test_lines_with_equal_order_stay_one_each(spark):
    got, want = both(spark, "layout_paragraphs", {"lineitem": f"select {LINE} {LINES}, range(3)"})
    assert got == want


def test_coverage_moves_runs_and_not_their_buckets(spark):
    from leafmill.operators import layout

    rows = [(d, 0, r, 10.0 * k, 10.0 * k + w) for d in range(3) for r in range(40) for k, w in ((0, 900.0), (d + r % 7, 50.0), (90, 30.0))]
    runs = spark.createDataFrame(rows, "doc long, page long, row long, x0 double, x1 double")
    found = []
    moved = shuffled(spark, lambda: found.extend(layout.coverage(runs).collect()))
    want = {}
    for d in range(3):
        own = [r for r in rows if r[0] == d]
        left, wide = min(r[3] for r in own), max(r[4] for r in own) - min(r[3] for r in own)
        for _, _, row, a, z in own:
            for b in range(*(min(239, int((x - left) / wide * 240)) + i for i, x in enumerate((a, z)))):
                want.setdefault((d, 0, b), set()).add(row)
    assert {tuple(r)[:3]: r["rows"] for r in found} == {k: len(v) for k, v in want.items()}
    assert moved <= 3 * len(rows)


@pytest.mark.parametrize("name", ["layout_rows", "layout_columns"])
def test_pages_cost_no_call_each(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_runs_without_a_given_row_among_those_with_one(spark):
    from leafmill.operators import layout

    rows = [(1, 0, 5.0, 9.0, 70.0, 4.0, "a", 7), (1, 0, 1.0, 2.0, 50.0, 4.0, "b", None), (1, 0, 3.0, 4.0, 50.5, 4.0, "c", 3), (1, 0, 6.0, 7.0, 20.0, 4.0, "d", 7), (2, 0, 0.0, 1.0, 9.0, 4.0, "e", None), (2, 0, 0.0, 1.0, 7.5, 4.0, "f", None)]
    got = layout.numbered_rows(spark.createDataFrame(rows, "doc long, page long, x0 double, x1 double, y double, size double, text string, given long"))
    assert sorted((r["text"], r["row"], r["top"]) for r in got.collect()) == [("a", 0, 70.0), ("b", 2, 50.0), ("c", 1, 50.5), ("d", 0, 70.0), ("e", 0, 9.0), ("f", 0, 9.0)]


def test_rows_of_hot_keys_stay_where_they_are(spark):
    from pyspark.sql import functions as F

    from leafmill.operators.ranks import nearest_ranks

    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    found = []
    moved = shuffled(spark, lambda: found.extend(nearest_ranks(rows, ["k"], "v", {"p50": 0.5}, most=64).collect()))
    want = {k: sorted(float(i * 7919 % 20_011) for i in range(k, 20_000, 2))[5_000] for k in (0, 1)}
    assert {r["k"]: r["p50"] for r in found} == want and moved < 20_000


def test_windows_are_compared_without_a_join(spark):
    from leafmill.operators import cache

    jobs = cache.wanted_not_running(spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "session string, key long"), spark.createDataFrame([(2,), (3,), (3,)], "key long"))
    assert sorted(map(tuple, jobs.collect())) == [(1, "start"), (3, "cancel")]
    assert "Join" not in jobs._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_address_are_tried_in_their_order(spark, tmp_path):
    """37 * id % 1000 words: pages 20, 23 and 26 of one address are whole at once; the first of them counts, wherever it lies."""
    for k, ids in enumerate(([26, 20, 23], [20, 23, 26], [23, 26, 20])):
        spark.createDataFrame([(i, "https://a.example/x", "") for i in ids], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{k}/pages.parquet")
        assert [r["word_count"] for r in QUERIES["best_attempt"](spark, f"{tmp_path}/{k}").collect()] == [740]


def test_more_partitions_for_larger_tables(spark, tmp_path):
    """a task's share stays the same as a table grows; before, the number of partitions was the session's."""
    from leafmill.operators import search
    from leafmill.sources.shared import lots_of

    path = f"file://{tmp_path}/large"
    spark.range(1_500_000).selectExpr("id as doc_id", "'text_content' as col", "md5(string(id)) as token", "array(1) as places").write.parquet(path)
    large = spark.read.parquet(path)
    assert lots_of(large) > int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    assert search.in_token_order(large).rdd.getNumPartitions() == lots_of(large)


def test_postings_are_gathered_and_handed_over_in_lots(spark, monkeypatch):
    """a row for each token of a document's column, however often it occurs, and no batch of all of a task's postings."""
    from leafmill.operators import search

    n = 300
    docs = spark.range(n).selectExpr("id", "concat('ran running ', repeat('word other ', 500), id) as t").coalesce(1)
    rows = search.gathered(docs, ["t"])
    assert rows.count() == 5 * n
    assert {(r["token"], len(r["places"])) for r in rows.where("doc_id = 7").collect()} == {("ran", 1), ("run", 1), ("word", 500), ("other", 500), ("7", 1)}
    sizes = []
    with monkeypatch.context() as patch:
        patch.setattr(search, "in_batches", lambda df, each, schema: each)
        each = search.gathered(docs, ["t"])
    for b in each(iter([docs.selectExpr("id as doc_id", "t").toArrow().combine_chunks().to_batches()[0]])):
        sizes.append(sum(map(len, b.column("places").to_pylist())))
    assert sum(sizes) == 1003 * n and len(sizes) > 1 and max(sizes) <= search.HELD + 1003
    assert search.postings(docs, ["t"]).count() == 1003 * n


def test_passages_are_handed_over_in_lots(spark, monkeypatch):
    """what a batch of texts becomes leaves Python as soon as there is much of it, and batches are bounded by bytes."""
    from leafmill.operators import extract, narration

    docs = spark.range(300).selectExpr("id", "repeat('A sentence of some length, and so on and on. ', 200) as text").coalesce(1)
    whole = narration.passages(docs).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    assert whole == 300 * len(narration.cut_passages("A sentence of some length, and so on and on. " * 200)) > narration.HELD
    pages = spark.range(250).selectExpr("concat('https://a.example/', id) as url", "'<html><body><p>text</p></body></html>' as html").coalesce(1)
    with monkeypatch.context() as patch:
        for module in (narration, extract):
            patch.setattr(module, "in_batches", lambda df, each, schema: each)
        cut, read = narration.passages(docs), extract.article_rows(pages)
    lots = [b.num_rows for b in cut(iter(docs.toArrow().combine_chunks().to_batches()))]
    assert sum(lots) == whole and max(lots) < narration.HELD + 100
    assert [b.num_rows for b in read(iter(pages.toArrow().combine_chunks().to_batches()))] == [100, 100, 50]


def test_a_page_is_read_once(spark):
    """Blocks meet the quotes among them without a second parse of every page."""
    from leafmill.operators import narration

    page = "<p>" + "A body of words that goes on and on for a longer while, it does. " * 3 + "</p><blockquote><p>A body of words that goes on and on for a longer while, it does.</p></blockquote>"
    b = narration.blocks(spark.createDataFrame([(1, "T", "s", None, page)], "id long, title string, site_name string, byline string, content_html string"))
    assert "MapInArrow" not in b._jdf.queryExecution().toString()
    assert [r["skip_reason"] for r in b.orderBy("ord").collect()] == [None, "duplicate"]


def test_pages_are_dealt_by_the_size_of_their_input(spark, monkeypatch):
    """both steps of a page's layout keep to partitions that follow the input, and gutters are found on their own."""
    from leafmill.operators import layout

    rows = [(d, 0, 60.0 + 260 * (i % 2), 160.0 + 260 * (i % 2), 900.0 - 14 * (i // 2), 10.0, f"{i}") for d in range(20) for i in range(20)]
    runs = spark.createDataFrame(rows, "doc long, page long, x0 double, x1 double, y double, size double, text string")
    monkeypatch.setattr(layout, "lots_of", lambda df, megabytes: 9)
    numbered = layout.numbered_rows(runs)
    assert numbered.rdd.getNumPartitions() == 9
    placed = layout.in_columns(numbered.cache(), 9)
    assert placed.rdd.getNumPartitions() == 9
    assert [r["text"] for r in placed.where("doc = 3").orderBy("place").collect()] == [f"{i}" for i in (*range(0, 20, 2), *range(1, 20, 2))]


def test_edges_that_are_not_known_cross_nothing(spark):
    """pages are placed in one walk, as the SQL places them; a run without a right edge reaches the margin and is over no gutter."""
    made = "select * replace (if(hash(l_orderkey, l_linenumber) % 5 = 0, null, l_quantity) as l_quantity) from '/root/testdata/sf0.001/lineitem.parquet'"
    got, want = both(spark, "layout_columns", {"lineitem": made})
    assert got == want


def test_runs_are_read_once_on_their_way_to_lines(spark):
    """a page is walked once for its rows and its columns, and its lines are made from one reading of its runs."""
    from leafmill.operators import layout

    rows = [(d, 0, 60.0 + 260 * (i % 2), 160.0 + 260 * (i % 2), 900.0 - 14 * (i // 2), 10.0 + i % 3, f"{i}") for d in range(20) for i in range(20)]
    runs = spark.createDataFrame(rows, "doc long, page long, x0 double, x1 double, y double, size double, text string")
    lines = layout.finished_rows(layout.page_rows(runs), ["doc", "page", "row"])
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert [(r["row"], r["text"], r["size"]) for r in lines.where("doc = 3").orderBy("row").limit(2).collect()] == [(0, "0", 10.0), (1, "2", 12.0)]


def test_a_size_carries_a_line_by_all_its_characters(spark):
    from leafmill.operators import layout

    rows = [(1, 0, 0, 0.0, 5.0, 9.0, 8.0, "aaa"), (1, 0, 0, 5.0, 9.0, 9.5, 12.0, " bbbb"), (1, 0, 0, 20.0, 25.0, 9.0, 8.2, "cc"), (1, 0, 1, 0.0, 5.0, 3.0, 7.0, "dd"), (1, 0, 1, 6.5, 9.0, 3.0, 6.0, "ee"), (1, 0, 2, 0.0, 5.0, 1.0, 6.0, "  ")]
    lines = layout.finished_rows(spark.createDataFrame(rows, "doc long, page long, row long, x0 double, x1 double, y double, size double, text string"), ["doc", "page", "row"])
    assert sorted((r["row"], r["text"], r["x0"], r["x1"], r["y"], r["size"]) for r in lines.collect()) == [(0, "aaa bbbb cc", 0.0, 25.0, 9.5, 8.0), (1, "dd ee", 0.0, 9.0, 3.0, 7.0)]


def test_windows_are_kept_by_buckets(spark, tmp_path):
    """a batch costs a call for each bucket and not for each client, also with clients that have no name."""
    from leafmill.streaming import expiring, state

    start = dt.datetime(2024, 1, 1)
    rows = [(None if i % 50 == 7 else i * 7 % 200, start + dt.timedelta(minutes=i // 3, seconds=i % 3), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, id long")
    stream = expiring.stream_rate_limit(expiring.segmented(df, "ts", 4), 2, 3600, late="10 minutes", buckets=5)
    q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in state.rate_limited(df, 2, 3600).collect()), key=repr)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 5 * 3


def test_many_pages_share_a_task(spark, tmp_path):
    """with as many pages as a large catalogue has, a task reads several; all come, the missing and the last ones too."""
    from leafmill.sources import paged

    assert [len(paged.lots(0, n)) for n in (0, 4, 200, 201, 3_334, 20_000, 10**6)] == [0, 4, 200, 101, 197, 313, 15_625]
    paged.register(spark)
    path = f"file://{tmp_path}/p"
    spark.range(1001).selectExpr("id as page", "if(id % 10 = 3, null, cast(concat('page ', id) as binary)) as body").write.format("leafmill_pages").mode("append").option("path", path).save()
    pages = spark.read.format("leafmill_pages").option("path", path).load()
    assert pages.rdd.getNumPartitions() == 167
    got = {r["page"]: (r["text"], r["error"]) for r in pages.selectExpr("page", "cast(body as string) as text", "error").collect()}
    assert got == {n: (None, "missing") if n % 10 == 3 else (f"page {n}", None) for n in range(1001)}


def test_lists_of_words_are_made_once_and_dealt_by_their_input(spark):
    """a title's words are made once, titles that no candidate's size allows aren't counted, and what a task counts goes
    by the size of the input."""
    from pyspark.sql import functions as F

    from leafmill.operators import similarity

    titles = [(" ".join(["word"] * n + ["other"]),) for n in range(40)]
    rows = spark.createDataFrame(titles, "title string").withColumn("bag", F.md5(F.col("title").cast("binary")))
    bags = similarity.bags_of(rows, spark.createDataFrame([("word",), ("other",)], "word string"), 720, (5, 9), 9)
    # 3 * 1280 >= 5 * 720 and 16 * 720 <= 9 * 1280
    assert {r["n"] for r in bags.select("n").distinct().collect()} == set(range(3, 17))
    assert bags.rdd.getNumPartitions() == 9
    plan = bags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
