"""The Merkle manifest and the spelling variants against plain versions, and on nulls, empty tables, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import merkle, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_by_hand(nodes):
    """The root, and the siblings (left, right) of each node by level."""
    ways, level, members = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        above, holds = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k in range(len(run)):
                for i in members[at + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            holds.append([i for m in members[at : at + 3] for i in m])
        level, members = above, holds
    return level[0], ways


def manifest_by_hand(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        held = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(*r)))
        trees[s] = held, *tree_by_hand([leaf_by_hand(*r) for r in held])
    root, tops = tree_by_hand([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        held, subroot, ways = trees[s]
        for r, way in zip(held, ways, strict=True):
            text = r[1]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf_by_hand(r[0], text, *r[2:])
            for left, right in way + top:
                now = h(left, now, right)
            out.append((r[0], leaf_by_hand(*r), subroot, root, h(*(a + b for a, b in way + top)), now, now == root))
    return out


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (4, 9, 10), (28, 1, 1, 1, 5, 82)])
def test_manifest_by_hand(spark, sizes):
    rng, rows = random.Random(sum(sizes)), []
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice(["a\nb", "one line", "é\n\n日本🙂", ""]), rng.choice(["en", None]), f"s{s}", rng.choice([3, None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC).repartition(3).selectExpr("*", "'clash' as tree", "'clash' as idx", "'clash' as hash", "'clash' as path", "1 as total", "1 as part")
    got = keyed(merkle.manifest(df).collect())
    assert got == keyed(manifest_by_hand(rows))
    assert len({r[3] for r in got}) == 1 and all(r[6] for r in got if zlib.crc32(str(r[0]).encode()) % 2)


def test_manifest_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (7, "a\nb", "en", None, 3), (7, "a\nb", "en", None, 3), (7, "other", "en", None, 3), (1, "x\n" * 50_000, "de", "=", 9), (2, "ü" * 9, None, "é", None)]
    df = spark.createDataFrame(rows, DOC)
    assert keyed(merkle.manifest(df).collect()) == keyed(manifest_by_hand(rows))
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == [] and merkle.manifest(spark.createDataFrame([], DOC)).columns[:2] == ["doc_id", "leaf"]
    one = merkle.manifest(df.where("doc_id = 2")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == h()


def test_manifest_finds_each_change(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 2}", i) for i in range(20)]
    levels = {(r.kind, r.source): (r.hash, r.n_leaves) for r in merkle.manifest_levels(spark.createDataFrame(rows, DOC)).collect()}
    assert levels["root", None] == (manifest_by_hand(rows)[0][3], 20) and levels["source", "s1"][1] == 10 and len(levels) == 3
    rows[4] = (4, "text 4", "en", "s0", 5)
    after = {(r.kind, r.source): (r.hash, r.n_leaves) for r in merkle.manifest_levels(spark.createDataFrame(rows, DOC)).collect()}
    assert {k for k in levels if levels[k] != after[k]} == {("root", None), ("source", "s0")}


# ── spelling ──


def counted_by_hand(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 199 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(n):
    near = {w: sorted((v for v in n if one_edit(v, w)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_by_hand(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 9]))) for _ in range(150)]
    words += [w[:i] + c + w[i + k :] for w in words[:80] for i, c, k in [(rng.randrange(len(w)), rng.choice("abÿX"), rng.choice([0, 1]))]]
    rows = [(d if d % 9 else None, " ".join(rng.choices(words, [1.6**-(k % 17) for k in range(len(words))], k=300)).title()) for d in range(40)]
    rows += [(90, None), (91, ""), (92, "x" * 30_000 + " " + "日本語 ×÷ short"), (93, ("x" * 30_000 + "\n") * 5), (94, ("x" * 29_999 + " ") * 6), (95, "aa bb")]
    rows += [(200 + i, w) for i, w in enumerate(["mmmmmmaa"] * 7 + ["mmmmmmab"] * 60 + ["mmmmmmbb"] * 500)]  # a chain of two steps
    n = counted_by_hand(rows)
    want = variants_by_hand(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as word", "1 as n", "'clash' as root", "'clash' as run", "'clash' as ident")
    got = {tuple(r) for r in spelling.spelling_variants(df.repartition(3)).collect()}
    assert got == want and sum(r[1] is not None for r in want) > 9 and any(r[1] and r[2] != r[1] for r in want)


def test_spoilt_occurrences(spark):
    rows = [(i, "wonderful") for i in range(20_000)]
    n = counted_by_hand(rows)
    assert len(n) > 1 and {(r.word, r.n) for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(n.items())
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chains_of_forms(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("v", "w7")]
    got = {r.word: r.root for r in spelling.chains(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert got == {w: "w21" for w, _ in steps}


@settings(max_examples=8, deadline=None)
@given(st.sets(st.text("aà", min_size=6, max_size=9), min_size=2, max_size=40))
def test_near_pairs_are_all_pairs_of_one_edit(spark, words):
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df).collect()]
    assert sorted(got) == sorted(p for p in itertools.combinations(sorted(words), 2) if one_edit(*p))
