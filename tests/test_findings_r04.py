"""What the fourth round's findings were about: each would have failed before."""

import datetime as dt
import random

from pyspark.sql import functions as F


def test_desks_share_a_bucket(spark, tmp_path):
    """a batch costs no state calls for each desk; nor are desks mixed up, the one without an owner among them."""
    from leafmill.streaming import expiring

    rng, rows = random.Random(7), []
    for owner in [None, *range(60)]:
        for k in range(30):
            command = rng.choice(["create", "create", "claim", "ready", "error", "read"])
            ticket = f"t{k if command == 'create' else max(0, k - rng.randint(1, 6))}"
            rows.append((owner, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k * 60 + rng.randint(0, 40)), len(rows), command, ticket))
    df = spark.createDataFrame(rows, "owner long, ts timestamp, ord long, command string, ticket string")
    want = {tuple(r) for r in expiring.desk(df.withColumn("at", F.unix_seconds("ts")), ttl=600, most=8).collect()}
    stream = expiring.stream_desk(expiring.segmented(df, "ts", 3), ttl=600, most=8, late="1 minute", buckets=4)
    q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows) and {r["outcome"] for r in got} == {"pending", "claimed", "ready", "refused", "expired"}
    # a value and a timer a bucket, where it was a list and a timer for each of 61 desks
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 4 * 3


def test_a_script_is_dealt_by_document_once(spark):
    """blocks are shuffled once with what they say, and the rows of a script aren't shuffled again."""
    from leafmill.operators import narration

    rows = [(i, f"Title {i}", "s", None, f"<h2>Title {i}</h2><p>" + "Many words stand here, and some more of them follow. " * 30 + "</p><p>Short words.</p><blockquote><p>Many words stand here, and some more of them follow. Many words stand here.</p></blockquote><p>Short words.</p>") for i in range(5)]
    articles = spark.createDataFrame(rows, "id long, title string, site_name string, byline string, content_html string")
    whole = narration.script(narration.blocks(articles, cuts=(narration.TARGET, narration.MOST)))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    carrying = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "MapInArrow" not in plan and len([line for line in carrying if "REPARTITION_BY_NUM" in line]) == 1
    # whether the passages are found on the way or afterwards, they are numbered in order
    later = narration.script(narration.blocks(articles))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, later.collect()))
    one = whole.where("id = 3").orderBy("seq").collect()
    assert [r["seq"] for r in one] == list(range(len(one))) and one[-1]["text"] == one[-2]["text"] == "Short words." and one[-1]["block_id"].endswith("-1")
    assert all(len(r["text"]) == r["stop"] - r["start"] for r in one)


def test_quotes_that_repeat_the_body_are_found_by_article(spark):
    """bodies are gathered for articles with such a quote alone; a quote of another article's words is read."""
    from leafmill.operators import narration

    body = "A body of words that goes on and on for a longer while, it does."
    quote = f"<blockquote><p>{body}</p></blockquote>"
    rows = [(1, None, None, None, f"<p>{body} {body}</p>{quote}{quote}"), (2, None, None, None, f"<p>Nothing of the kind is said here, or anywhere else at all, by anybody.</p>{quote}"), (3, None, None, None, f"<p>{body}</p>")]
    b = narration.blocks(spark.createDataFrame(rows, "id long, title string, site_name string, byline string, content_html string"))
    assert [(r["id"], r["skip_reason"]) for r in b.orderBy("id", "ord").collect()] == [(1, None), (1, "duplicate"), (1, "duplicate"), (2, None), (2, None), (3, None)]
    assert "raw" not in spark.read.parquet(b.inputFiles()[0]).columns


def test_laid_out_lines_take_less_than_their_text(spark):
    """what layout_blocks leaves in the shared folder is columns of one table; it was two checkpoints of whole rows."""
    import os

    from leafmill.plans.catalogue import QUERIES
    from leafmill.sources.shared import shared_dir

    def held():
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark).removeprefix("file://")) for f in files}

    data, before = "/root/testdata/sf0.001", held()
    blocks = QUERIES["layout_blocks"](spark, data)
    left = {f: n for f, n in held().items() if f not in before}
    text = spark.read.parquet(f"{data}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert sum(left.values()) < text and not any("/letters-" in f for f in left)
    assert blocks.count() == spark.read.parquet(f"{data}/documents.parquet").where("text rlike '[^\\\\n]'").count()


def test_a_document_is_dealt_before_it_becomes_runs(spark, tmp_path):
    """pages are walked where their document's text lies; rows of one document in two files are one page's."""
    from leafmill.operators import layout
    from leafmill.plans import layout as plans

    for k, text in enumerate(("One line of it\nAnd one more", "Another line of it")):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    runs = plans._document_runs(spark, str(tmp_path)).select("doc", "page", "x0", "x1", "y", "size", "text")
    rows = layout.page_rows(runs, together=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, layout.page_rows(runs).collect()))
