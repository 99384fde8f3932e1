from pyspark.sql import functions as F

from leafmill.operators import layout, writes
from leafmill.plans import layout as plans
from leafmill.streaming import state


def test_atomic_swap(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writes.atomic_swap(spark, spark.range(3), path)
    writes.atomic_swap(spark, spark.range(5), path)
    assert writes.current(spark, path).count() == 5
    assert writes.atomic_swap(spark, spark.range(7), path) == 3 and writes.current(spark, path).count() == 7
    assert len(list((tmp_path / "t").glob("v*"))) == 2
    (tmp_path / "t/v4-broken").mkdir()  # a swap that broke off before its name
    assert writes.current(spark, path).count() == 7


def test_compare_and_set_on_empty(spark):
    assert writes.compare_and_set(spark.createDataFrame([], "key long, ord long, expected long, value string")).count() == 0


RUN = "doc long, page long, x0 double, x1 double, y double, size double, text string"


def test_two_columns_read_one_after_the_other(spark):
    rows = [(1, 0, c, c + 100.0, 700.0 - 14 * i, 10.0, f"{c:.0f}-{i}") for i in range(8) for c in (50.0, 300.0)] + [(1, 0, 50.0, 400.0, 790.0, 12.0, "title"), (2, 0, 50.0, 90.0, 1.0, 9.0, "alone")]
    got = layout.page_rows(spark.createDataFrame(rows, RUN)).where("doc = 1").orderBy("row").collect()
    assert [r["text"] for r in got] == ["title", *(f"50-{i}" for i in range(8)), *(f"300-{i}" for i in range(8))]


def test_rows_by_eye_keep_their_row(spark):
    rows = [(1, 0, 10.0, 20.0, 99.0, 10.0, "b", 7), (1, 0, 30.0, 40.0, 95.0, 10.0, "c", 7), (1, 0, 5.0, 9.0, 96.0, 10.0, "d", 3)]
    got = {r["text"]: (r["row"], r["y"]) for r in layout.page_rows(spark.createDataFrame(rows, RUN + ", given long")).collect()}
    assert got == {"b": (0, 99.0), "c": (0, 99.0), "d": (1, 96.0)}
    assert {r["row"] for r in layout.page_rows(spark.createDataFrame([r[:-1] for r in rows], RUN)).collect()} == {0}


def test_drop_cap_joins_its_line(spark):
    lines = spark.createDataFrame([(1, 0, 0, "ith a pair", 80.0, 200.0, 700.0, 10.0), (1, 0, 1, "W", 50.0, 78.0, 680.0, 30.0), (1, 0, 2, "of glasses", 80.0, 200.0, 686.0, 10.0), (1, 1, 3, "X", 50.0, 78.0, 680.0, 30.0)], "doc long, page long, ord long, text string, x0 double, x1 double, y double, size double")
    got = layout.with_drop_caps(lines, ["doc", "page"]).orderBy("ord").collect()
    assert [(r["text"], r["x0"]) for r in got] == [("With a pair", 50.0), ("of glasses", 80.0), ("X", 50.0)]


def test_another_space_ends_a_paragraph(spark):
    lines = [(1, i, 0, 50.0, 300.0, 700.0 - 14 * i, 10.0, None, f"line {i} goes on", 14.0, 250.0, "ink" if i < 2 else "eye") for i in range(4)]
    kind = "doc long, ord long, page long, x0 double, x1 double, y double, size double, level long, text string, leading double, width double, space string"
    got = layout.assembled(spark.createDataFrame(lines, kind), ["doc"]).orderBy("n").collect()
    assert [r["text"] for r in got] == ["line 0 goes on line 1 goes on", "line 2 goes on line 3 goes on"]


def test_heading_rule_keeps_its_sign(spark):
    lines = spark.createDataFrame([(1, 0, 0, 50.0, 150.0, 700.0, 10.0, "Body text runs"), (1, 0, 1, 50.0, 100.0, 660.0, 10.0, "A Heading"), (1, 0, 2, 50.0, 150.0, 646.0, 10.0, "body again here")], "doc long, page long, ord long, x0 double, x1 double, y double, size double, text string")
    levels = layout.heading_levels(lines, layout.measured_spaces(lines, ["doc"]), ["doc"])
    assert levels.where("level is not null").count() == 0  # the next line stands lower, so the lone heading isn't one


def test_tickets(spark):
    c = spark.createDataFrame([("a", 1, 0.0, "create"), ("a", 2, 1.0, "claim"), ("a", 3, 2.0, "claim"), ("b", 1, 0.0, "create"), ("b", 2, 1000.0, "claim"), ("a", 4, 3.0, "ready")], "ticket string, ord long, at double, command string")
    got = {r["ticket"]: (r["state"], r["refused"]) for r in state.tickets(c).collect()}
    assert got == {"a": ("ready", 1), "b": ("gone", 1)}


def test_queue_joins_and_keeps_a_slot(spark):
    rows = [("q", i, 0.0, f"j{i}", 10.0, True, 99.0) for i in range(3)] + [("q", 3, 1.0, "f", 10.0, False, 99.0), ("q", 4, 2.0, "f", 10.0, False, 99.0)]
    got = {r["job"]: (r["started"], r["users"]) for r in state.queue_runs(spark.createDataFrame(rows, "queue string, ord long, at double, job string, work double, speculative boolean, leave double"), slots=3).collect()}
    assert got["j0"][0] == got["j1"][0] == 0.0 and got["f"] == (1.0, 2) and got["j2"][0] >= 10.0


def test_stats_on_empty_logs(spark):
    empty = spark.createDataFrame([], "kind string, wait_ms double")
    assert state.queue_stats(empty).first()["waits"] == 0
    assert state.timing(spark.createDataFrame([], "key long, ord long, ms double")).count() == 0
    assert layout.weighted_mode(spark.createDataFrame([], "doc long, size double, w long, o long"), ["doc"], "size", "w", "o").agg(F.count("*")).first()[0] == 0


def test_long_lines_are_laid_out_whole(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    text = " ".join(words[:2]) + "\n\n" + " ".join(words[2:]) + " " + "x" * 100
    spark.createDataFrame([(1, text), (2, "One line")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = plans._document_runs(spark, str(tmp_path)).where("doc = 1 and text <> 'A Running Head'").select("text", "page", "x0", "y").collect()
    assert max(len(r["text"]) for r in runs) <= 45 and sorted(w for r in runs for w in r["text"].split() if w[0] == "w") == sorted(words)
    assert sum(r["text"].count("x") for r in runs) == 100 and len({r[1:] for r in runs}) == len(runs)
    blocks = " ".join(str(v) for r in plans.layout_blocks(spark, str(tmp_path)).where("doc = 1").collect() for v in r)
    assert all(w in blocks for w in words)
    left = {r["doc"]: r["lines"] for r in plans.layout_titles(spark, str(tmp_path)).collect()}
    assert left[1] >= len(text) // 90 - 1
