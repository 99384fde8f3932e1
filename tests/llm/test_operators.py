"""The training-data operators against brute-force versions, and on nulls, empty tables, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import math
import random
import re
import threading
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import ann, bpe, common, linededup, mainhtml, neardup, packing, quality, rollup, secrets, shards

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD_TEXTS = [None, "", " \n\t ", "a", "x" * 40_000, "é ﬁ 日本語 🙂   \x1c", "same line of text\nsame line of text\nother", "same line of text", "same line of text"]


def docs(spark, texts, clash=True):
    """Documents with those texts, a null in every column, and columns whose names the operators use themselves."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s1", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for name in ("n_words", "doc", "bands", "row", "n", "ids", "_drops", "slot", "kept", "class") if clash else ():
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(table):
    return {r["doc_id"]: r["text"] for r in table.collect()}


# ── 1 quality ──


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base_rules(spark, table, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for r in quality.quality_rules(table, labels).collect():
        want = base_by_hand(texts[r["doc_id"]])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "\n", " ", "#x", "é"]), max_size=60).map(" ".join))
def test_quality_features_by_hand(text):
    assert quality.base_features(text, quality.word_hashes()) == base_by_hand(text)


def test_quality_ratio_by_hand(spark):
    good, bad = "the quiet river runs on " * 8, "### $$$ %%% &&& " * 8
    rows = spark.createDataFrame([(i, good if i < 6 else bad, "en", "s", 1) for i in range(9)], DOC)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    ratios = quality.fit(rows, labels)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i in range(9):
        for c in quality.gram_buckets((good if i < 6 else bad).encode()):
            raw[c] += 1
            target[c] += i < 4
    share = (raw + 0.5) / (raw + 0.5).sum()
    want = np.log((target + quality.PRIOR * share * quality.BUCKETS) / (target.sum() + quality.PRIOR * quality.BUCKETS)) - np.log(share)
    at = quality.slot("en")
    assert np.allclose(ratios[at : at + quality.BUCKETS], want, atol=1e-5)
    assert quality.score(good.encode(), "en", ratios) > quality.score(bad.encode(), "en", ratios)
    assert quality.score((good * 50).encode(), "en", ratios) == pytest.approx(quality.score((good * 49).encode(), "en", ratios), abs=0.01)
    assert quality.slot("xx") == at or quality.score(good.encode(), "xx", ratios) == pytest.approx(0, abs=1e-5)


def test_quality_separates_held_out_labels(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.quality_rules(d, lab.where("doc_id % 2 = 0")).where("not base_failed").join(lab.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in kept if r["quality"] == 1], [r["kept"] for r in kept if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_quality_filters_a_rare_language(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trusted = lab.where("quality = 1 and coalesce(toxic, 0) = 0").join(d.where("lang = 'fr'"), "doc_id", "left_semi").orderBy("doc_id").limit(5)
    few = lab.join(d.where("lang = 'fr'"), "doc_id", "left_anti").unionByName(trusted)
    judged = quality.quality_rules(d.where("lang = 'fr' or doc_id % 4 = 0"), few).where("not base_failed").join(lab, "doc_id").join(d.where("lang = 'fr'").select("doc_id"), "doc_id").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in judged if r["quality"] == 1], [r["kept"] for r in judged if r["quality"] == 0]
    assert bad and sum(bad) <= 0.25 * len(bad) and sum(good) >= 0.95 * len(good)


def test_quality_samples_each_slot(spark):
    rows = spark.createDataFrame([(i, "x", "en" if i < 400 else "fr" if i < 405 else None, "s", 1) for i in range(410)], DOC)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(410), 9999]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    ids = quality.trusted_ids(rows.union(rows), labels, 20).tolist()
    least = [r["doc_id"] for r in rows.where("lang = 'en'").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").limit(20).collect()]
    assert ids == sorted(least + list(range(400, 410)))


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs(spark, ODD_TEXTS), none).orderBy("doc_id").collect()
    assert [tuple(r[1:6]) for r in got] == [base_by_hand(t) for t in ODD_TEXTS] and not any(r["kept"] for r in got)
    assert quality.quality_rules(empty(spark), none).count() == 0 and quality.keep_quality(empty(spark), none).columns == [c.split()[0] for c in DOC.split(", ")]


# ── 2 token counts ──


def test_rollup_batches_are_idempotent(spark, tmp_path):
    state = f"file://{tmp_path}/s"
    change = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", 7, None)], change)
    two = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10)], change)
    assert rollup.commit(spark, state, "b1", rollup.signed(one)) and not rollup.commit(spark, state, "b1", rollup.signed(two))
    assert rollup.commit(spark, state, "b2", rollup.signed(two)) and rollup.commit(spark, state, "b3", rollup.signed(spark.createDataFrame([], change)))
    want = {("a", "en", "v1", 1, 12), (None, None, "v1", 1, 7)}
    assert {tuple(r) for r in rollup.totals(spark, state).collect()} == want
    rollup.compact(spark, state)
    assert {tuple(r) for r in rollup.totals(spark, state).collect()} == want and rollup.committed(spark, state) == ["b1", "b2", "b3"]
    assert not rollup.commit(spark, state, "b2", rollup.signed(two))
    assert rollup.commit(spark, state, "b4", rollup.signed(one))
    rollup.compact(spark, state)
    rollup.vacuum(spark, state)
    assert {tuple(r) for r in rollup.totals(spark, state).collect()} == {("a", "en", "v1", 3, 27), (None, None, "v1", 2, 14)}
    assert len(list((tmp_path / "s/data").iterdir())) == 1
    with pytest.raises(ValueError):
        rollup.commit(spark, state, "../x", rollup.signed(two))


def test_rollup_survives_what_breaks_off(spark, tmp_path, monkeypatch):
    state = f"file://{tmp_path}/s"
    one = rollup.signed(spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"))
    rollup.commit(spark, state, "b1", one)
    want = [("a", "en", "v1", 1, 10)]
    totals = lambda: [tuple(r) for r in rollup.totals(spark, state).collect()]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # between the data and the file that names them
        m.setattr(rollup, "_create", killed)
        for step in (lambda: rollup.commit(spark, state, "b2", one), lambda: rollup.compact(spark, state)):
            with pytest.raises(KeyboardInterrupt):
                step()
            assert totals() == want and rollup.committed(spark, state) == ["b1"]
    (tmp_path / "s/commits/b2").write_text("")  # a file that broke off before its end
    assert totals() == want and rollup.committed(spark, state) == ["b1"]
    assert rollup.commit(spark, state, "b2", one) and totals() == [("a", "en", "v1", 2, 20)]
    rollup.compact(spark, state)
    (tmp_path / "s/folds/0000000009").write_text('{"data": "no')
    assert totals() == [("a", "en", "v1", 2, 20)] and not rollup.commit(spark, state, "b1", one)


def test_rollup_writers_at_once(spark, tmp_path):
    """Of writers that race for a batch one has committed, also where an earlier one has left half a file."""
    state, change = f"file://{tmp_path}/s", "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    (tmp_path / "s/commits").mkdir(parents=True)
    (tmp_path / "s/commits/half").write_text("0123")
    for batch in ("b1", "half"):
        said = []
        work = [threading.Thread(target=lambda k=k, batch=batch: said.append((rollup.commit(spark, state, batch, rollup.signed(spark.createDataFrame([("insert", "a", "en", f"v{k}", 10**k, None)], change))), k))) for k in range(5)]
        for t in work:
            t.start()
        for t in work:
            t.join()
        winner = [k for ok, k in said if ok]
        assert len(said) == 5 and len(winner) == 1
        now = {r["tokenizer"]: r["n_tokens"] for r in rollup.totals(spark, state).collect()}
        assert now[f"v{winner[0]}"] >= 10 ** winner[0] and sum(r["n_docs"] for r in rollup.totals(spark, state).collect()) == {"b1": 1, "half": 2}[batch]
    assert rollup.committed(spark, state) == ["b1", "half"]


def test_rollup_commits_dont_look_at_earlier_ones(spark, tmp_path, monkeypatch):
    state, change = f"file://{tmp_path}/s", "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    one = rollup.signed(spark.createDataFrame([("insert", "a", "en", "v", 10, None)], change)).persist()
    opened = []
    real = rollup.read_small
    monkeypatch.setattr(rollup, "read_small", lambda s, path: opened.append(path) or real(s, path))
    for k in range(12):
        with monkeypatch.context() as m:
            m.setattr(rollup, "_listed", lambda *_: pytest.fail("a commit lists nothing"))
            assert rollup.commit(spark, state, f"day-{k:04d}", one) and not rollup.commit(spark, state, f"day-{k:04d}", one)
        if k % 4 == 3:
            rollup.compact(spark, state)
    assert len(opened) <= 12 + 3 and [tuple(r)[3:] for r in rollup.totals(spark, state).collect()] == [(12, 120)]
    assert rollup._folded(spark, state)["ids"] == [["day-", 4, 0, 11]]


@given(st.lists(st.from_regex(r"[ab]?-?[0-9]{0,3}[ab]?", fullmatch=True), max_size=30))
def test_ranges_of_ids(ids):
    inside = rollup.in_ranges(rollup.ranges(ids))
    assert all(inside(i) for i in ids) and [i for i in ("a", "a1", "a01", "b-7", "999", "x") if inside(i)] == [i for i in ("a", "a1", "a01", "b-7", "999", "x") if i in ids]


def test_rollup_counts_by_hand(spark, table, texts):
    version = {"v": (RANKS, public_tokenizers.PATTERN)}
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.maintained_counts(table, version).collect()}
    encode = rollup.encoder(*version["v"]).encode_ordinary
    want = collections.defaultdict(lambda: (0, 0))
    for r in table.collect():
        n, t = want[r["source"], r["lang"]]
        want[r["source"], r["lang"]] = n + 1, t + len(encode(r["text"]))
    assert got == dict(want)
    assert rollup.maintained_counts(empty(spark), version).count() == 0
    assert rollup.maintained_counts(docs(spark, ODD_TEXTS), version).agg({"n_docs": "sum"}).first()[0] == len(ODD_TEXTS)


# ── 3 packing ──


def check_packed(rows, whole):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    ids = {d: array("I", t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in whole.items()}
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(sum(n for _, n in s) < 4096 for s in sequences.values()) <= 1
    assert set(pieces) == set(ids)
    for d, found in pieces.items():
        at = 0
        for start, length, crc, total in sorted(found):
            assert start == at and total == len(ids[d]) and zlib.crc32(ids[d][start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids[d])


def test_packing_keeps_every_id(table, texts):
    check_packed(packing.pack(table, WORD_BPE).collect(), texts)


def test_packing_odd_rows(spark):
    odd = [*ODD_TEXTS, "İstanbul. á b. क़. x", "a.b,c.. d., 'tis don't. x's", "<|endoftext|> y", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|", "ß. ﬁ, ǅ. ϓ.", "..., . ,", "１２. x1. ²."]
    check_packed(packing.pack(docs(spark, odd), WORD_BPE).collect(), dict(enumerate(odd)))
    assert packing.pack(empty(spark), WORD_BPE).count() == 0


def test_deficit_round_robin_by_hand(table):
    """The closed form against the queues themselves, round by round."""
    tokens = packing.tokenised(table, WORD_BPE)
    window = 20_000
    got = {r["row"]: r["window"] for r in packing.placed(tokens, window=window).collect()}
    from pyspark.sql import functions as F

    queue = collections.defaultdict(list)
    for r in tokens.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(packing.CHUNKS))).orderBy("source", "chunk", "doc_id", "row").collect():
        queue[r["source"]].append((r["row"], r["n"]))
    total = sum(n for q in queue.values() for _, n in q)
    quantum = {s: window * sum(n for _, n in q) / total for s, q in queue.items()}
    deficit, w = dict.fromkeys(queue, 0.0), 0
    while any(queue.values()):
        w += 1
        for s, q in queue.items():
            deficit[s] += quantum[s]
            while q and q[0][1] <= deficit[s] + 1e-6:
                row, n = q.pop(0)
                deficit[s] -= n
                assert got[row] == w


def test_clock_by_hand():
    """Rounds along the common clock against queues that are poured out token by token."""
    rng = random.Random(7)
    for mixture in (None, {"a": 3.0, "b": 1.0}, {"c": 1.0}):
        totals = {s: rng.randint(1, 900) for s in "abcd"} | {"none": 0}
        weight = packing.weights(totals, mixture, 0.7)
        pace, stretches = packing.clock(totals, weight, 50)
        sent, rounds, live = dict.fromkeys(weight, 0.0), 0.0, {s: w for s, w in weight.items() if w}
        while live or any(sent[s] < totals[s] - 1e-6 for s in weight):
            live = live or {s: float(totals[s]) for s in weight if sent[s] < totals[s] - 1e-6}
            step = min((totals[s] - sent[s]) / w for s, w in live.items())
            for s, w in live.items():
                at = pace[s][0] + (sent[s] + w * step / 2) / pace[s][1]
                middle = rounds + step / 2 * sum(live.values()) / 50
                assert packing.rounds_at(np.array([at]), stretches)[0] in (math.ceil(middle - 1e-6), math.ceil(middle + 1e-6))
                sent[s] += w * step
            rounds += step * sum(live.values()) / 50
            live = {s: w for s, w in live.items() if sent[s] < totals[s] - 1e-6}
        assert rounds == pytest.approx(sum(totals.values()) / 50)


def test_mixture_is_kept_while_it_lasts(spark):
    tokens = packing.tokenised(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORD_BPE)
    sources = sorted(r[0] for r in tokens.select("source").distinct().collect())
    rows = packing.placed(tokens, mixture={sources[0]: 3.0, sources[1]: 1.0}, window=8_000).join(tokens.select("row", "source"), "row").collect()
    last = max(r["window"] for r in rows if r["source"] == sources[0])
    share = collections.Counter()
    for r in rows:
        if r["window"] < last:  # others follow in the window in which a queue runs dry
            share[r["source"]] += r["n"]
    assert share[sources[0]] / sum(share.values()) == pytest.approx(0.75, abs=0.2)
    assert len({r["at"] for r in rows}) == len(rows) == tokens.count()


# ── 4 byte-level BPE ──


@pytest.fixture(scope="module")
def codec():
    return bpe.loaded(RANKS, public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal_and_exact(codec):
    w = codec.words
    assert len(w.keys) == len(codec.ranks) and None not in w.keys
    assert all(w.get(k) == v for k, v in codec.ranks.items()) and w.get(b"no such entry") == -1
    assert bpe.PerfectHash({}).get(b"x") == -1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_like_tiktoken(codec, text):
    assert codec.encode(text) == rollup.encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_round_trip(spark, table, texts):
    enc = rollup.encoder(RANKS, public_tokenizers.PATTERN)
    for r in bpe.round_trip(table, RANKS, public_tokenizers.PATTERN).collect() + bpe.round_trip(docs(spark, ODD_TEXTS), RANKS, public_tokenizers.PATTERN).where("doc_id < 0").collect():
        ids = array("I", enc.encode_ordinary(texts[r["doc_id"]]))
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    odd = bpe.round_trip(docs(spark, ODD_TEXTS), RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r["decoded_sha256"] for r in odd] == [hashlib.sha256((t or "").encode()).hexdigest() for t in ODD_TEXTS]
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# ── 5 HTML ──

PAGES = [
    ('<html><head><title>t</title></head><body><nav><ul><li>Home<li>More</ul></nav><article><h1>Head &amp; title</h1><p>One <b>bold\n word</b>.<br>Two<p>Three&nbsp;four</article><footer>foot</footer></body></html>', "Head & title\n\nOne bold word. Two\n\nThree four"),
    ('<body><header><h1>Site</h1></header><div class="sidebar">side</div><div id="content"><p>' + "Long prose here. " * 20 + '</p><p>Short.</p></div><div class="comments"><p>I disagree strongly with all of this.</p></div><form><p>Name</p></form></body>', "Long prose here. " * 19 + "Long prose here.\n\nShort."),
    ('<main><p>Text</p><div class="cookie-notice"><p>We use cookies</p></div><script>var a="<p>x</p>"</script><aside>aside</aside><p>End</p></main><p>Outside</p>', "Text\n\nEnd"),
    ("<article><p>First</p><p>Only</article><article><p>" + "The longer piece wins. " * 5 + "</p></article>", "The longer piece wins. " * 4 + "The longer piece wins."),
    ("", ""), ("<nav>only a menu</nav>", ""), ("plain text", "plain text"), ("<article><p>a</b></i></p></div>b &am &copy;", "a\n\nb &am ©"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert mainhtml.main_text(page) == text


PROSE = "Long prose of the article goes on here. " * 4
MENU = "<div><div><a href=x>Home</a></div><div><a href=y>More</a></div></div>"


def paragraphs(key, n):
    return "".join(f"<p>{key}{i} {PROSE}</p>" for i in range(n))


def starts(page):
    return [line.split()[0] for line in mainhtml.main_text(page).split("\n\n")]


def test_split_sections_and_sibling_articles():
    split = f"<body>{MENU}<div><section>{paragraphs('a', 7)}<p>Short.</p></section><h2>Two</h2><section>{paragraphs('b', 3)}<p>Brief.</p></section></div>{MENU}"
    assert starts(split) == [*(f"a{i}" for i in range(7)), "Short.", "Two", "b0", "b1", "b2", "Brief."]
    assert starts(f"<article>{paragraphs('a', 5)}</article>{MENU}<article>{paragraphs('b', 3)}</article>") == ["a0", "a1", "a2", "a3", "a4", "b0", "b1", "b2"]


@pytest.mark.parametrize("page", [
    "<div class='content-sidebar-wrap'><main>{}</main><div class='sidebar'><p>Side</p></div></div>", "<div class='no-sidebar'><div>{}</div></div>",
    "<article><div class='entry-content share-enabled'>{}<span class='share'>Share</span></div></article>", "<div class='hidden'><article>{}</article></div>",
    "<div id='widget'>{}</div>", "<main><article>{}</article><div class='comments'><article><p>c0 I disagree.</article></div></main>",
])
def test_names_alone_dont_leave_out_the_article(page):
    assert starts(page.format(paragraphs("a", 4))) == ["a0", "a1", "a2", "a3"]


def test_doubtful_names_of_short_pages():
    assert mainhtml.main_text("<div class='widget'><p>All there is</p></div>") == "All there is"
    assert mainhtml.main_text("<p>Start <span class='share'>Share</span> end</p>") == "Start end"


@pytest.mark.parametrize("page", [
    "<article>{}</article><section><article class='comment'><p>c0 I disagree, at some length, and with reasons of my own.</p></article></section>",
    "<main>{}<article class='comment'><p>c0 I disagree, at some length, and with reasons of my own.</p></article><article id='comments'><p>c1 So do I.</p></article></main>",
    "<article>{}<article class='reply post'><p>c0 " + PROSE + "</p></article></article>",
    "<section class='comments'><article><p>c0 I disagree.</p></article></section><article class='post article'>{}</article>",
])
def test_articles_that_are_comments(page):
    assert starts(page.format(paragraphs("a", 4))) == ["a0", "a1", "a2", "a3"]


LINKS = "<ul><li><a href=x>s1 of somebody</a></li><li><a href=y>s2 of somebody</a></li><li><a href=z>s3 of somebody</a></li></ul>"


@pytest.mark.parametrize(("page", "want"), [
    ("<article>{}<p><a href=x>l0 see also the other part</a></p></article>", ["a0", "a1", "a2", "l0"]),
    ("<article>{}" + LINKS + "</article>", ["a0", "a1", "a2", "s1", "s2", "s3"]),
    ("<article>{}<h2>Sources</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>", ["a0", "a1", "a2", "Sources", "One", "Two"]),
    ("<article><p><a href=x>l0 is first</a></p>{}</article>", ["l0", "a0", "a1", "a2"]),
    ("<article><ul><li><a href=x>Home</a></li><li><a href=y>News of today</a></li></ul>{}<ul><li><a href=x>Tweet</a></li><li><a href=y>Mail</a></li></ul></article>", ["a0", "a1", "a2"]),
    ("<article>{}<nav>" + LINKS + "</nav></article>", ["a0", "a1", "a2"]),
    ("<div>{}</div>" + LINKS, ["a0", "a1", "a2"]),
])
def test_lines_of_links(page, want):
    assert starts(page.format(paragraphs("a", 3))) == want


def test_pages_repeated_and_none(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article>{paragraphs('a', 2)}</article>", "clash", "clash")] * 3 + [(1, "v", None, None, None)]
    got = [tuple(r) for r in mainhtml.extract_pages(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 4 and len(set(got)) == 2 and (1, "v", "", 0) in got
    none = mainhtml.extract_pages(spark.createDataFrame([], schema))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]


def test_smoothing_and_clusters():
    assert mainhtml.smoothed([5.0, 5.0, 5.0], [0, 0, 0]) == pytest.approx([5.0] * 3)
    assert mainhtml.smoothed([1.0, 9.0, 1.0], [0, 1, 0]) == pytest.approx([1.0, 9.0, 1.0])
    lines = [mainhtml.Line("x" * 5, 3, ())] * 4 + [mainhtml.Line("y" * 200, 1, ())] * 6 + [mainhtml.Line("z" * 4, 2, ())] * 4
    content = mainhtml.high_cluster(mainhtml.smoothed([mainhtml.ratio(x) for x in lines], [0] * 14))
    assert content[5:9] == [True] * 4 and not content[0]


def plain_main_text(page):
    """Ratio, smoothing, clusters and text of pages as the tables have them, by splitting the markup at block tags."""
    body = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<head>.*?</head>|<!DOCTYPE[^>]*>", "", page)
    lines, place, tags, held = [], "", 0, ""
    for token in [*re.findall(r"(?s)<[^>]*>|[^<]+", body), "<p>"]:
        tag = re.match(r"</?([a-z0-9]+)", token)
        if tag and tag[1] not in ("a", "b", "br"):
            text = " ".join(html.unescape(held).split())
            if text:
                lines.append((text, tags, place))
            held, tags = "", 0
            if tag[1] in ("nav", "footer", "article", "div"):
                place = "" if token.startswith("</") else "ad" if tag[1] == "div" else tag[1]
        if not tag:
            held += token
        else:
            tags += 1 if tag[1] not in ("html", "body") or token.startswith("<b") else 0
            held += "\n" if tag[1] == "br" else ""
    weight = {"article": 1, "": 0.05}
    n = len(lines)
    r = np.array([len(t) / max(1, k) for t, k, _ in lines])
    r = r / (r + 40) * np.array([weight.get(p, 0.01) for _, _, p in lines])
    kernel = np.array([[math.exp(-((i - j) ** 2) / 2) * (abs(i - j) <= 2 and lines[i][2] == lines[j][2]) for j in range(n)] for i in range(n)])
    v = kernel @ r / kernel.sum(1)
    cut = v.mean()
    for _ in range(20):
        if not (v < cut).any() or abs((new := (v[v >= cut].mean() + v[v < cut].mean()) / 2) - cut) < 1e-9:
            break
        cut = new
    held = any(v[i] >= cut and lines[i][2] == "article" for i in range(n))
    return "\n\n".join(t for i, (t, _, p) in enumerate(lines) if v[i] >= cut or held and p == "article")


def test_main_text_by_hand(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = [mainhtml.main_text(p) for p in pages]
    assert got == [plain_main_text(p) for p in pages] and all(got)
    for forced in (True, False):  # the clusters decide
        monkeypatch.setattr(mainhtml, "high_cluster", lambda values, forced=forced: [forced] * len(values))
        assert all(mainhtml.main_text(p) != text for p, text in zip(pages, got, strict=True))


@pytest.mark.parametrize("page", [
    "<div class='site has-sidebar'><article>{}</article></div>", "<div class='post ad-free'>{}</div>", "<div class='post comments-open'>{}</div>",
    "<article>{}<div><p><a href=x>Related one</a></p><p><a href=y>Related two</a></p></div></article>", "<form><main>{}</main><p><label>Name</label></p></form>",
    "<div class='ad'><p>" + PROSE + "</p></div><div>{}</div><div id='comments'><article><p>" + PROSE * 9 + "</p><p>" + PROSE * 9 + "</p></article></div>",
])
def test_names_and_tags_are_weights(page):
    assert starts(page.format(paragraphs("a", 4))) == ["a0", "a1", "a2", "a3"]
    assert starts(page.format(f"{paragraphs('a', 2)}<section id='cookies'>{paragraphs('b', 2)}</section><div class='social-history'>{paragraphs('c', 1)}</div>")) == ["a0", "a1", "b0", "b1", "c0"]


def test_pages_of_other_parts_alone():
    assert mainhtml.main_text("<nav>menu</nav><footer>" + PROSE + "</footer>") == ""
    assert mainhtml.main_text("<div class='comments'><p>c0 All there is</p></div>") == "c0 All there is"


@settings(max_examples=60, deadline=None)
@given(st.text("<>/abp \n&;=\"'!-", max_size=120))
def test_any_soup_parses(soup):
    assert isinstance(mainhtml.main_text(soup), str)


def test_pages_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, "clash"), (None, "u", "<p>x", "clash"), (2, "u", "<article>" + "<p>word</p>" * 5000 + "</article>", "clash")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["n_chars"] for r in mainhtml.extract_pages(rows).collect()}
    assert got == {1: 0, None: 1, 2: 5000 * 4 + 4999 * 2}


# ── 6 neighbours ──


def by_hand(rows, step, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    return {q: sorted((math.sqrt(((x - v) ** 2).sum()), i) for i, x in fine if i != q)[:k] for q, v in fine if q % step == 0}


def test_neighbours_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 10)
    got = collections.defaultdict(list)
    for r in ann.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == set(want) and all(g == sorted(g) and len(g) == 10 for g in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / (10 * len(want)) >= 0.9
    scores = {(q, i): s for q, w in by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 10**6).items() for s, i in w}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q, g in got.items() for s, i in g)


def test_neighbours_whole_index_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5), (105, [1.0, 2.0]), (None, [1.0] * 6), (200, rows[3][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, v string")
    want = by_hand([(i, v) for i, v in rows if v is None or len(v) == 6], 10, 5)
    got = collections.defaultdict(list)
    for r in ann.search(df, "vec_id % 10 = 0", k=5, centroids=4, share=1.0, entries_a_task=10, block=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == want
    assert ann.search(df.where("false"), "vec_id % 10 = 0").count() == 0
    assert ann.search(df.where("vec_id in (10, 11)"), "vec_id % 10 = 0").count() == 1


def test_neighbours_of_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(1, 50)]
    want = by_hand(rows, 5, 6)
    for times in (1, 2, 40):
        got = collections.defaultdict(list)
        for r in ann.search(spark.createDataFrame(rows * times, "vec_id long, embedding array<float>"), "vec_id % 5 = 0", k=6, centroids=4, share=1.0, block=3).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert dict(got) == want
    moved = [*rows, *((i, [x + 1.0 for x in v]) for i, v in rows)]  # two vectors an id: the smaller asks, the nearer is found
    ask = {i: np.array(min(v for j, v in moved if j == i)) for i, _ in rows if i % 5 == 0}
    want = {q: sorted((min(math.sqrt(((x - np.array(v)) ** 2).sum()) for j, v in moved if j == i), i) for i, _ in rows if i != q)[:6] for q, x in ask.items()}
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(moved, "vec_id long, embedding array<double>"), "vec_id % 5 = 0", k=6, centroids=4, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == want


def test_entries_go_to_the_blocks_that_visit_them(spark):
    """Two far clusters, half of the entries a query: each entry meets the blocks of its own cluster alone."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(9, 1, (200, 4)), rng.normal(-9, 1, (200, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, "vec_id % 4 = 0", k=5, centroids=2, block=50)
    want = by_hand([(i, v) for i, v in enumerate(x)], 4, 5)
    found = collections.defaultdict(set)
    for r in got.collect():
        found[r["query_id"]].add(r["vec_id"])
    assert all(found[q] == {i for _, i in w} for q, w in want.items())


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    counts = np.ones((7, 5), int)
    walked = [a[i] + b[j] for i, j in ann.traverse(a, b, counts, 35)]
    assert walked == sorted(walked) and len(walked) == 35
    assert len(ann.traverse(a, b, counts, 4)) == 4


# ── 7 shards ──


def test_shards(spark, table, texts):
    rows = shards.shard(table).collect()
    assert len(rows) == len(texts)
    places = collections.defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text) and r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    half = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in shards.shard(table.where("doc_id % 2 = 0")).collect()}
    assert all(half[r["doc_id"]] == (r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] in half)


def test_shards_by_hand(spark, table, texts, tmp_path):
    """Slots, shards of all three versions and places, made anew without the engine."""
    slot_of = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % shards.SLOTS
    turn = lambda v: v // 40 + 1
    held = collections.defaultdict(list)
    for i, t in texts.items():
        held[slot_of(i)].append((i, zlib.crc32(t.encode()), len(t.encode()) + 16))
    want, before = set(), collections.Counter()
    for v in sorted(held):
        for n, (i, crc, size) in enumerate(sorted(held[v])):
            want.add((i, size, crc, "key", v % 40, before[v % 40] + n, 40 if (turn(v) + v % 40) % 41 == 40 else v % 40))
        before[v % 40] += len(held[v])
    rows = shards.shard(table, maps=f"file://{tmp_path}/maps").collect()
    assert {tuple(r)[:7] for r in rows} == want and len(rows) == len(want)
    for version, column in ((1, "shard"), (2, "grown_shard"), (3, "balanced_shard")):
        stored = {r["vslot"]: r["shard"] for r in shards.read_map(spark, f"file://{tmp_path}/maps", version).collect()}
        assert len(stored) == shards.SLOTS and all(stored[slot_of(r["doc_id"])] == r[column] for r in rows)


def test_rebalanced_by_bytes(spark):
    rng = random.Random(9)
    first = shards.first_map(spark, 10, 400)
    sizes = [rng.randint(0, 999) for _ in range(400)]
    sizes[3], sizes[13] = 10**6, 5 * 10**4
    new = shards.rebalanced(first, spark.createDataFrame([(v, 1, b) for v, b in enumerate(sizes) if v % 50], "vslot int, slot_rows long, slot_bytes long"), 10)
    got = {r["vslot"]: r["shard"] for r in new.collect()}
    loads = collections.Counter()
    for v, s in got.items():
        loads[s] += sizes[v] if v % 50 else 0
    assert set(got) == set(range(400)) and got[3] == 3 and loads[3] == 10**6  # a slot above an equal share is alone
    others = [loads[s] for s in range(10) if s != 3]
    assert max(others) - min(others) <= 5 * 10**4 and max(sorted(others)[:-1]) - min(others) <= 2 * 999
    even = shards.rebalanced(first, spark.createDataFrame([(v, 1, 7) for v in range(400)], "vslot int, slot_rows long, slot_bytes long"), 10)
    assert {r["vslot"]: r["shard"] for r in even.collect()} == {v: v % 10 for v in range(400)}  # nothing moves without need


def homes_by_hand(sizes, shards):
    """The rule of rebalanced(), slot by slot; slot v starts on shard v % shards."""
    order = sorted(range(len(sizes)), key=lambda v: (-sizes[v], v))
    bigs = []
    for k, v in enumerate(order):
        if sizes[v] * (shards - k) <= sum(sizes[w] for w in order[k:]):
            break
        bigs.append(v)
    home, extra = {}, []
    for v in bigs:
        if v % shards in home.values():
            extra.append(v)
        else:
            home[v] = v % shards
    load = lambda s: sum(sizes[s::shards])
    free = sorted((s for s in range(shards) if s not in home.values()), key=lambda s: (load(s), s))
    home.update(zip(extra, free, strict=False))
    closed = set(home.values())
    share = sum(sizes[v] for v in order[len(bigs) :]) // max(shards - len(bigs), 1)
    held, leaving = dict.fromkeys(set(range(shards)) - closed, 0), []
    for s in range(shards):
        excess = max(load(s) - share, 0)
        for v in sorted((v for v in range(s, len(sizes), shards) if v not in home), key=lambda v: (-sizes[v], v)):
            if s in closed or 0 < sizes[v] <= excess:
                leaving.append(v)
                excess -= sizes[v]
            else:
                home[v] = s
                held[s] += sizes[v]
    moved = sum(home.get(v) != v % shards for v in range(len(sizes)))
    for v in sorted(leaving, key=lambda v: (-sizes[v], v)):
        s = min(held, key=lambda s: (held[s], s))
        home[v] = s
        held[s] += sizes[v]
    return home, moved


@pytest.mark.parametrize("case", ["even", "some above a room", "all in one shard", "few slots", "nothing"])
def test_rebalanced_by_hand(spark, case):
    rng, shards_, n = random.Random(case), 8, 200
    sizes = [rng.randint(50, 99) for _ in range(n)]
    if case == "some above a room":
        for v, b in ((3, 9000), (11, 5000), (19, 4000), (4, 3000), (5, 2400), (44, 900), (84, 890)):
            sizes[v] = b
    if case == "all in one shard":
        sizes = [b * (v % shards_ == 2) for v, b in enumerate(sizes)]
    if case == "few slots":
        sizes = [7, 9, 100, 5, 6]
    if case == "nothing":
        sizes = [0] * n
    first = shards.first_map(spark, shards_, len(sizes))
    new = shards.rebalanced(first, spark.createDataFrame([(v, 1, b) for v, b in enumerate(sizes)], "vslot int, slot_rows long, slot_bytes long"), shards_)
    want, moved = homes_by_hand(sizes, shards_)
    assert {r["vslot"]: r["shard"] for r in new.collect()} == want and moved <= {"even": 30, "nothing": 0}.get(case, n)
    if case == "some above a room":
        loads = collections.Counter()
        for v, s in want.items():
            loads[s] += sizes[v]
        assert loads[want[3]] == 9000 and loads[want[11]] == 5000 and want[3] == 3
        # what a large slot's arrival has left above the share, the next version evens out
        again = shards.rebalanced(spark.createDataFrame([(v, s, 2) for v, s in want.items()], "vslot int, shard int, version int"), spark.createDataFrame([(v, 1, b) for v, b in enumerate(sizes)], "vslot int, slot_rows long, slot_bytes long"), shards_)
        loads = collections.Counter()
        for r in again.collect():
            loads[r["shard"]] += sizes[r["vslot"]]
        assert max(sorted(loads.values())[:-2]) - min(loads.values()) <= 200


def test_shard_maps(spark, tmp_path):
    first = shards.first_map(spark, 40)
    new = shards.grown(first, 40)
    old, now = {r["vslot"]: r["shard"] for r in first.collect()}, {r["vslot"]: r["shard"] for r in new.collect()}
    moved = [s for s in old if old[s] != now[s]]
    assert all(now[s] == 40 for s in moved) and abs(len(moved) - shards.SLOTS / 41) < 41
    path = f"file://{tmp_path}/m"
    shards.write_map(first, path)
    shards.write_map(new, path)
    assert {r["vslot"]: r["shard"] for r in shards.read_map(spark, path).collect()} == now and {r["vslot"]: r["shard"] for r in shards.read_map(spark, path, 1).collect()} == old
    totals = spark.range(shards.SLOTS).selectExpr("cast(id as int) as vslot", "1L as slot_rows", "id % 977 as slot_bytes")
    loads = [r[0] for r in shards.rebalanced(first, totals, 40).join(totals, "vslot").groupBy("shard").sum("slot_bytes").select("sum(slot_bytes)").collect()]
    assert max(loads) <= 1.01 * min(loads)


def test_shards_odd_rows(spark):
    rows = docs(spark, ODD_TEXTS).union(docs(spark, ODD_TEXTS)).selectExpr("if(doc_id = 3, null, doc_id) as doc_id", "text", "n", "slot")
    got = shards.shard(rows).collect()
    assert len(got) == 2 * len(ODD_TEXTS) and all(r["shard"] is not None and r["slot"] is not None for r in got)
    assert {r["size"] for r in got if r["doc_id"] == 0} == {16} and shards.shard(empty(spark)).count() == 0


# ── 8 lines ──


def lines_by_hand(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    top = 2**63 - 1
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(top if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (top if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_by_hand(spark):
    rows = [(5, " Shared Line here \nown"), (3, "shared line HERE\nshared line here"), (None, "shared line here\nx"), (9, None), (7, ""), (8, "ééééééééé\nééééééééé"), (10, "ééééééééé\n日本語日本語日本語日"), (11, "日本語日本語日本語日"), (5, "shared line here\nagain"), (12, " shared line here"), (13, "İSTANBUL LINES")]
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], "doc_id long, text string, _drops string, doc string")
    assert sorted((tuple(r) for r in linededup.line_dedup(df).collect()), key=repr) == lines_by_hand(rows)
    assert linededup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_of_many_rows_without_an_id(spark):
    rows = [(None, f"shared line number {i % 7}\nown line number {i}\nshared line number {i % 5}") for i in range(40)] + [(1, "shared line number 3\nshared line number 3"), (2, "own line number 9")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    assert sorted((tuple(r) for r in linededup.line_dedup(df).collect()), key=repr) == lines_by_hand(rows + rows[:3])


def test_line_dedup_least_and_columns(spark):
    df = docs(spark, ["a line that repeats\nb", "a line that repeats", "a line that repeats", None], clash=False)
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.line_dedup(df, least=3).collect()} == {0: 0, 1: 1, 2: 1, 3: 0}
    assert sum(r["n_dropped"] for r in linededup.line_dedup(df, least=4).collect()) == 0
    out = linededup.drop_lines(df).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"]) for r in out] == [("a line that repeats\nb", 21), ("", 0), ("", 0), (None, None)] and linededup.drop_lines(df).columns == df.columns


# ── 9 secrets ──


def spans_by_hand(text):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "token", "API_key", "=", ":", " ", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "ſ", "K", "é", "\n", "x"]), max_size=25).map("".join))
def test_fixed_patterns_by_hand(text):
    assert secrets.base_spans(text) == spans_by_hand(text)


def test_entropy_by_hand():
    rng = random.Random(1)
    for _ in range(50):
        run = "".join(rng.choice("abcdefghij0123456789"[: rng.randint(2, 20)]) for _ in range(rng.randint(10, 60)))
        entropy = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in collections.Counter(w).values())
        hot = {i + k for i in range(len(run) - 19) if entropy(run[i : i + 20]) >= 2.5 + 1e-9 for k in range(20)}
        near = {i + k for i in range(len(run) - 19) if entropy(run[i : i + 20]) >= 2.5 - 1e-9 for k in range(20)}
        got = {k for a, b in secrets.windows(run, 20, 2.5) for k in range(a, b)}
        assert hot <= got <= near


def test_entropy_spans_and_allow_list():
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ9u3Lk8"
    base, spans = secrets.all_spans(f"use {key} now, not antidisestablishmentarianism or snake_case_name_of_words or 123e4567-e89b-12d3-a456-426614174000")
    assert base == [] and len(spans) == 1 and spans[0][1] == 3
    assert key not in secrets.redacted(f"a {key} b") and secrets.redacted("plain words") == "plain words"
    assert secrets.redacted("token = abcdef123 end") == "[secret] end"


def test_secrets_beside_fixed_patterns():
    one, two = "0123456789abcdef" * 2, "wJalrXUtnFEMIqK7MDENGpbPxRfiCYzQ9u3Lk8Tz"
    for text in (f"{one}_{two}", f"{two}/token=abcdef", f"{two}_{one}-{two[::-1]}"):
        base, spans = secrets.all_spans(text)
        assert base and not any(a < d and c < b for a, _, b in base for c, k, d in spans if k == 3)
        assert two not in secrets.redacted(text) and two[::-1] not in secrets.redacted(text)
    assert secrets.redacted("/path/of/some/long/words/token=abcdef") == "/path/of/some/long/words/[secret]"


def test_secrets_of_mixed_classes_and_of_letters():
    assert secrets.windows("x" * 40, 20, 3.6) == []
    mixed = "Zq8Lw2Xn5Rt9Vb3Kd7Hs4/Gm1+Pf6Jc0Yx_Ug-Te+Oa"
    assert secrets.redacted(f"a {mixed} b") == "a [secret] b" and len(secrets.entropy_spans(mixed, [])) == 1
    for key in ("qWbXkZpTLmvRcYdNsJhGfA", "xkqjzvbwpmtrhgfdlcnyaeiu", "QZJXKVBWPMTRHGFDLCNY"):
        assert secrets.redacted(f"a {key} b") == "a [secret] b"
    for words in ("antidisestablishmentarianism", "the-quick-brown-fox-jumps-over-lazy-dogs", "MAXIMUM_NUMBER_OF_RETRIES_BEFORE_GIVING_UP", "getElementsByTagNameAndValue", "Donaudampfschifffahrtsgesellschaft", "z" * 40):
        assert secrets.redacted(words) == words


def test_secrets_of_a_long_text():
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = "".join(f"word{i} token={key()} and {key()}\n" for i in range(8000))
    import time

    start = time.perf_counter()
    base, spans = secrets.all_spans(text)
    took = time.perf_counter() - start
    assert len(base) == 8000 and len([s for s in spans if s[1] == 3]) >= 7900
    start = time.perf_counter()
    secrets.all_spans(text[: len(text) // 4])
    assert took < 12 * (time.perf_counter() - start)  # in proportion to the text


def test_long_texts_keep_memories_bounded(codec):
    """20 MB without spaces, and as many different long words."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh日本") for _ in range(1000)) * 20_000
    words = " ".join("".join(rng.choices("abcdefghij", k=40)) for _ in range(60_000))
    memo = quality.word_hashes()
    for text in (long, words, words[::-1]):
        n = len(text.split())
        assert quality.base_features(text, memo)[0] == n and memo.held <= quality.MEMO_BYTES + 200 * n + 2 * len(text.encode())
        assert len(neardup.shingle_hashes(text, memo)) == max(1, n - 4)
        assert len(linededup.kept_lines(text, set())[0]) == 1 and secrets.base_spans(text) is not None
    small = common.WordMemory(1000, len)
    for i in range(100):
        assert small.learn({b"x" * i})[b"x" * i] == i and small.held <= 1000 + common.WORD_BYTES + 100
    ids = packing.loaded(WORD_BPE).packed(pa.array([words, "a " * 10]))
    assert [len(x) > 0 for x in ids] == [True, True]
    assert codec.decode(codec.encode(words)) == words.encode()


def test_secrets_odd_rows(spark):
    got = secrets.scan_secrets(docs(spark, [*ODD_TEXTS, "password=hunter22"])).orderBy("doc_id").collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing for r in got[:-1]) and got[-1]["spans"] == "assign:0:17" and got[-1]["n_assign"] == 1
    red = secrets.redact_secrets(docs(spark, [None, "password=hunter22"], clash=False)).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"]) for r in red] == [(None, None), ("[secret]", 8)] and secrets.scan_secrets(empty(spark)).count() == 0


# ── 10 near duplicates ──


def bag(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def classes_by_hand(rows):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or union and sum((bags[i] & bags[j]).values()) / union >= 0.8:
                a, b = sorted((top(i), top(j)), key=lambda x: rows[x][0])
                parent[b] = a
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def family(rng, n, words=120, edits=4):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_near_duplicates_by_hand(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 16)
    rng = random.Random(5)
    texts = family(rng, 60) + family(rng, 25, words=40, edits=3) + family(rng, 3, 2000, 30) + [f"alone {i} " + " ".join(str(rng.random()) for _ in range(30)) for i in range(30)] + [None, "", "", "  ", "one two", "one two", "one  two", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == classes_by_hand(rows)
    kept = neardup.keep_one(docs(spark, texts, clash=False))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == [c.split()[0] for c in DOC.split(", ")]


def test_near_duplicates_of_the_table(spark, table, texts):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(table).collect()}
    assert got == classes_by_hand(sorted(texts.items()))


def test_near_duplicates_odd_rows(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "a b c d e f", "x")], "doc_id long, text string, class string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True)], key=repr)


def test_near_duplicates_of_very_long_texts(spark):
    """Whole texts go through the signatures: a change past any prefix tells copies, and a great change at the end parts them."""
    rng = random.Random(12)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    near, far = list(long), long[:30_000] + [f"x{rng.randrange(5000)}" for _ in range(30_000)]
    near[59_000:59_010] = ["changed"] * 10
    texts = [" ".join(t) for t in (long, near, far, ["same"] * 80_000, ["same"] * 79_000)] + ["y" * 300_000, "y" * 300_000]
    rows = list(enumerate(texts))
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()} == classes_by_hand(rows)


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(150):
        u = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = rng.integers(0, 7, 200), rng.integers(0, 7, 200)
        b = np.where(rng.random(200) < 0.6, a, b)
        x, y = neardup.bag_minhash([(u[a > 0], a[a > 0]), (u[b > 0], b[b > 0])])
        off.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.06


def test_forest_joins_exactly_the_linked():
    rng = random.Random(2)
    items = [np.sort(np.array(rng.sample(range(60), rng.randint(20, 50)), np.int64)) for _ in range(40)]
    parent = list(range(40))
    top = lambda i: i if parent[i] == i else top(parent[i])
    for i in range(40):
        for j in range(i):
            both = len(set(items[i]) & set(items[j]))
            if both / (len(items[i]) + len(items[j]) - both) >= 0.6:
                parent[top(i)] = top(j)
    mine = list(range(40))
    root = lambda i: i if mine[i] == i else root(mine[i])
    edges = neardup.forest(list(range(40)), items, 0.6)
    for a, b in edges:
        assert root(a) != root(b)
        mine[root(a)] = root(b)
    assert {(i, j) for i in range(40) for j in range(40) if top(i) == top(j)} == {(i, j) for i in range(40) for j in range(40) if root(i) == root(j)}
