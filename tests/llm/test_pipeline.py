"""The pipeline against a plain version of the same stages."""

import collections

import corpus_pipeline
from leafmill.llm import common, quality, secrets
from test_operators import check_packed, classes_by_hand

SF = "/root/testdata/sf0.001"


def test_run_by_hand(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ratios = quality.fit(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if quality.judge(r["text"] or "", r["lang"], ratios, quality.word_hashes())[-1]}
    # line dedup
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for d, t in rows.items():
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    rows = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d) for d, t in rows.items()}
    # near dedup, secrets
    classes = classes_by_hand(sorted(rows.items()))
    rows = {d: secrets.redacted(t) for d, t in rows.items() if classes[d] == d}
    check_packed(corpus_pipeline.run(spark, SF).collect(), rows)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' as kept", "1 as class", "2 as _drops", "3 as _gone", "4 as _doc", "5 as doc")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "secrets", "packing"]


def test_tables_in_the_shared_folder_can_be_cleared(spark):
    kept = common.written(spark.range(3), "kept")
    assert kept.count() == 3
    common.clear(spark)
    again = common.written(spark.range(2), "again")
    assert again.count() == 2


def odd_tables(spark, folder, rows, labelled):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_an_empty_table(spark, tmp_path):
    folder = odd_tables(spark, f"file://{tmp_path}", [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_null_texts_and_repeated_rows(spark, tmp_path):
    """Rows without a text go; of copies one keeps its lines, the others are empty and stay, as they are no copies any more; what is
    left is packed whole. Without labels the base rules alone judge."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopq"]
    prose = [" ".join(words[(j + 5 * k) % len(words)] + str(k) for j in range(30)) for k in range(4)]
    rows = [(1, prose[0], "en", "s", 1), (1, prose[0], "en", "s", 1), (2, prose[0], None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, prose[1], None, None, None), (5, prose[2], "en", None, 9), (5, prose[3], "en", None, 9), (6, "too short", "en", "s", 9)]
    folder = odd_tables(spark, f"file://{tmp_path}", rows, [])
    got = corpus_pipeline.run(spark, folder).collect()
    pieces = collections.Counter(r["doc_id"] for r in got)
    assert set(pieces) == {None, 1, 2, 5} and {r["length"] for r in got if r["doc_id"] == 2} == {1}
    # gapless in the sequence, each document's ids whole
    assert sorted(r["offset"] for r in got)[0] == 0 and all(r["sequence_id"] == 0 for r in got)
    assert sum(r["length"] for r in got) == max(r["offset"] + r["length"] for r in got)
