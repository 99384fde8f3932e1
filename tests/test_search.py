"""The index against SQLite's own full-text search with the same tokenizer."""

import sqlite3

import pytest

from leafmill.operators import search
from leafmill.sources import store

TEXTS = [
    "Running in the rain", "generalizations of relational databases", "A state-of-the-art café", "state art of the", "alpha", "hopping hoped hopes", "happily happiness", "conditional rational triplicate", "", "ponies caresses cats",
]
QUERIES = ["run", "runn", "general", "generaliz", "cafe", "state-of", "alpha gamma", "-", "- alpha", "hop", "happi", "pony", "the rai", "relat", "THE"]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(i, t, "gamma" if i == 4 else None) for i, t in enumerate(TEXTS)], "id long, title string, note string")
    return search.postings(df, ["title", "note"]).cache()


@pytest.mark.parametrize("q", QUERIES)
def test_like_fts5(index, q):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, note, tokenize='porter unicode61')")
    con.executemany("insert into f(rowid, title, note) values (?, ?, ?)", [(i, t, "gamma" if i == 4 else None) for i, t in enumerate(TEXTS)])
    match = " ".join('"' + t.replace('"', '""') + '"*' for t in q.split())
    want = sorted(r[0] for r in con.execute("select rowid from f where f match ?", (match,)))
    assert sorted(r[0] for r in search.search(index, q).collect()) == want


def test_refresh_replaces_changed_documents(spark, index):
    changed = spark.createDataFrame([(0, "Walking home", None)], "id long, title string, note string")
    new = search.refreshed(index, changed, ["title", "note"])
    assert [r[0] for r in search.search(new, "walk").collect()] == [0]
    assert search.search(new, "rain").count() == 0
    assert search.search(new, "alpha").count() == 1


ARTICLES = [
    (1, "Running water", "By Jane Doe", "Rivers", "It runs and ran, the rivers of the north", ["news", "good reads"]),
    (2, "Still", None, "Jane", "nothing runs here", []),
    (3, "Ran", "By Élodie Good", "site", "", ["running"]),
    (4, None, None, None, None, None),
    (5, "of the runner", "the", "north", "doe jane", ["poor"]),
]


@pytest.mark.parametrize("q", ["run", "jane", "jane doe", "good", "the-north", "elodie", "rivers run", "read", "doe-jane", '["good', "of-the"])
def test_articles_like_fts5_from_a_stored_index(spark, tmp_path_factory, q):
    import json

    df = spark.createDataFrame(ARTICLES, "id long, title string, byline string, site_name string, text_content string, tags array<string>")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, byline, site, text, tags, tokenize='porter unicode61')")
    con.executemany("insert into f(rowid, title, byline, site, text, tags) values (?, ?, ?, ?, ?, ?)", [(*a[:5], None if a[5] is None else json.dumps(a[5])) for a in ARTICLES])
    match = " ".join('"' + t.replace('"', '""') + '"*' for t in q.split())
    want = sorted(r[0] for r in con.execute("select rowid from f where f match ?", (match,)))
    index = search.stored_index(spark, "articles of the test", lambda: df)
    assert sorted(r[0] for r in search.search(index, q).collect()) == want


def test_a_search_reads_its_tokens_alone(spark):
    index = search.stored_index(spark, "articles of the test", lambda: None)
    plan = search.search(index, "run")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(token), StringStartsWith(token,run)]" in plan


def test_an_index_that_follows_its_library(spark, tmp_path):
    """After updates, deletes, inserts and a fold, searches are those of a fresh index, and an update writes its own share."""
    rows = [(i, f"{TEXTS[i % len(TEXTS)]} number{i}", f"note {i % 7} " + "filling words of all kinds " * 20) for i in range(1000)]
    schema = "id long, title string, note string"
    index = search.LivingIndex(store.Store(spark, f"file://{tmp_path}/i"), ["title", "note"])
    index.create(spark.createDataFrame(rows, schema))
    whole = index.tables.read("postings").count()

    def same():
        fresh = search.postings(spark.createDataFrame(rows, schema), ["title", "note"]).cache()
        for q in ["run", "general", "cafe", "state-of", "hop", "revis", "note-3", "number1", "fresh", "alpha number4"]:
            assert sorted(r[0] for r in index.search(q).collect()) == sorted(r[0] for r in search.search(fresh, q).collect()), q

    same()
    old = index.tables.snapshot()
    for k in range(0, 1000, 100):
        rows[k] = (k, f"Revised title {k}", rows[k][2])
    index.update(spark.createDataFrame(rows[::100], schema))
    assert 0 < index.tables.read("postings").count() - whole < 0.012 * whole
    same()
    gone = {7, 100, 999}
    rows = [r for r in rows if r[0] not in gone]
    index.update(deleted=spark.createDataFrame([(i,) for i in gone], "id long"))
    same()
    rows += [(5000, "a fresh one", None), (7, "back again, revised", "note 3")]
    index.update(spark.createDataFrame(rows[-2:], schema), spark.createDataFrame([(12345,)], "id long"))
    same()
    assert index.read(old).where("token = 'revis'").count() == 0  # who began before the change doesn't see half of it
    index.compact()
    index.tables.vacuum(keep=1)
    same()
    assert index.tables.read("gone").count() == 0 and len(index.tables.snapshot().tables["postings"]) == 1


def test_a_changed_table_is_never_answered_from_an_old_index(spark, tmp_path):
    path = f"file://{tmp_path}/articles"
    columns = "id long, title string, byline string, site_name string, text_content string, tags array<string>"

    def save(title):
        spark.createDataFrame([(1, title, None, None, "body", [])], columns).write.mode("overwrite").parquet(path)

    find = lambda q: [r[0] for r in search.search(search.stored_index(spark, path, lambda: spark.read.parquet(path)), q).collect()]
    save("first title")
    assert find("first") == [1] and find("second") == []
    before = dict(search._STORED)
    assert find("first") == [1] and search._STORED == before  # the same state is indexed once
    save("second title")
    assert find("first") == [] and find("second") == [1]
