"""Language identification: passes against all ways to cut a word, held-out accuracy, and nulls, empty tables, ties, repeats and clashing columns."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from leafmill.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def pieces():
    return langid.worker_pieces(PATH)


def cuts(word, pieces):
    """All ways to cut a word into ids of pieces; a letter that is no piece is the unknown one."""
    known = {p: k for k, p in enumerate(pieces.pieces)}

    def after(i):
        if i == len(word):
            yield ()
        for j in range(i + 1, len(word) + 1):
            k = known.get(word[i:j], pieces.unknown if j == i + 1 else None)
            if k is not None:
                yield from ((k, *rest) for rest in after(j))

    return list(after(0))


def test_forward_sums_all_cuts(pieces):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(pieces.size, 0.3), 2).T
    p = np.maximum(p, langid.FLOOR)
    words = ["a", "the", "thing", "straße", "éàç", "日本語", "ⴰⴱ", "xqzk", "information"]
    want = [[math.log(sum(math.prod(p[k, g] for k in cut) for cut in cuts("▁" + w, pieces))) for g in range(2)] for w in words]
    assert np.allclose(langid.word_logs(words, pieces, pieces.scaled(p)), want, rtol=1e-9)
    lang, n = np.array([k % 2 for k in range(len(words))]), np.arange(1.0, len(words) + 1)
    counts = np.zeros(p.shape)
    for w, g, times in zip(words, lang, n, strict=True):
        ways = cuts("▁" + w, pieces)
        weights = np.array([math.prod(p[k, g] for k in cut) for cut in ways])
        for cut, weight in zip(ways, weights / weights.sum(), strict=True):
            for k in cut:
                counts[k, g] += weight * times
    assert np.allclose(langid.expected(words, lang, n, pieces, pieces.scaled(p)), counts, atol=1e-9)


def test_long_words_stay_in_range(pieces):
    p = np.full((pieces.size, 2), langid.FLOOR)
    logs = langid.word_logs(["ⴰ" * langid.LONGEST, "x" * langid.LONGEST, "a"], pieces, pieces.scaled(p))
    assert np.isfinite(logs).all() and math.isclose(logs[0, 0], langid.LONGEST * math.log(langid.FLOOR) + math.log(langid.FLOOR), rel_tol=1e-9)
    assert langid.word_counts("x" * 100) == {"x" * 47: 2, "x" * 6: 1} and langid.word_counts("12 ½ _ 🙂") == {}
    text = "Wört " * 300_000 + "ß" * 99
    assert langid.word_counts(text) == collections.Counter(langid.WORD.findall(text.lower()))


def test_matrices_stay_bounded(pieces, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 50)
    monkeypatch.setattr(langid, "MEMO_BYTES", 500)
    p = langid.probabilities(np.random.default_rng(1).random((pieces.size, 3)), pieces.absent)
    scorer = langid.Scorer(langid.Model(PATH, ["a", "b", "c"], np.full(3, 1 / 3), p))
    batches = [["some words", "and others"], ["some words again", "", "more of those words"], ["some words"]]
    got = [scorer.predict(b) for b in batches]
    assert got[0][0] == got[2][0] and got[1][1] == ("und", 0.0) and scorer.held < 1000


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.language_id(docs, PATH, sample=40).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_learns_from_the_right_rows(spark):
    """Held-out labels and those of null aren't learnt, a rare language is."""
    rows = [(i, "the house and the garden of the old man", "en", "s", 1) for i in range(60)] + [(100 + i, "das haus und der garten des alten mannes", "de", None, 1) for i in range(60)]
    rows += [(200, "la maison et le jardin du vieil homme", "fr", "s", 1), (201, "huset og hagen til den gamle mannen", None, "s", 1)]
    assert zlib.crc32(b"200") % 4 != 2
    held = [i for i in range(300, 900) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [(i, "huset og hagen til den gamle mannen", "no", "s", 1) for i in held[:30]]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "'x' as hash", "'x' as lang_pred", "1 as n", "1 as left", "'x' as word")
    got = {r.doc_id: r for r in langid.language_id(df, PATH).collect()}
    assert got[0].lang_pred == "en" and got[100].lang_pred == "de" and got[200].lang_pred == "fr" and got[201].lang_pred != "no"
    assert all(got[i].held_out and got[i].lang_pred in ("de", "en", "fr") for i in held[:30])


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, "12 + 34 🙂", None, None, 9), (None, "the words of the text", "en", None, 1), (4, "die Wörter des Textes", "de", None, 1)]
    rows += [(4, "die Wörter des Textes", "de", None, 1), (5, "x" * 100_000, None, None, 1), (6, "the " * 100_000, None, None, 1), (7, "ЖЖ日本ⴰ", "", None, 1)]
    got = langid.language_id(spark.createDataFrame(rows, DOC), PATH).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.held_out))
    assert len(got) == len(rows) and len(by[4]) == 2 and len(set(by[4])) == 1
    assert {by[i][0][0] for i in (1, 2, 3)} == {"und"} and by[6][0][0] == "en" and by[4][0][0] == "de" and by[7][0][0] in ("", "en", "de") and by[None][0] == ("en", False)
    assert langid.language_id(spark.createDataFrame([], DOC), PATH).collect() == []
    unlabelled = langid.language_id(spark.createDataFrame([(1, "words", None, None, 1)], DOC), PATH).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)
