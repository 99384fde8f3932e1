"""Merkle manifest of a dataset: a hash tree for each source, one over the sources' roots, and a proof for each row.

H is the lowercase hex sha256 of its inputs, end to end; digests go in as hex text. A row's leaf is H of its fields, each `-` if
null, else the bytes of its UTF-8 form, a colon and the value. In each source leaves stand by id; while a source has more than
one node, every FANOUT successive ones (the last run may have fewer, even one) become their H. The subroots that remain, by
source (null first, then by bytes), likewise give the root. A row's siblings are the other nodes of the runs on its way to the
root; with them its leaf gives the root again, so a row is checked without any other row.

Nodes are rows (tree, idx, hash). Places come from a range partitioning that is stored with each row's partition: a number
within it, plus what the tree has in earlier partitions, so no task sees a whole source. A level is the one below, grouped by
idx // FANOUT, and keeps the sorted hashes of its runs; each is a table in the shared folder, a third of the one below. Then
paths come down: a level joins the one above by (tree, idx // FANOUT) and puts its siblings before its parent's path. Keys
of all joins are nodes, never sources, and a key has FANOUT rows; all levels together are half as many rows as the leaves.

Null ids come first. Rows with equal ids stand by their leaves; equal rows stand side by side, each with a proof of its own, and
such that agree in all fields stay in one partition. Null fields are `-`, so null and empty text differ. A tree of one leaf has
that leaf as its subroot. An empty table gives no rows. Other columns are not read. Tampering, the query's trial, deletes \\n
from the text where 2 divides the crc32 of the decimal id (of a null id: 0); null text stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import sql_crc32, written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: tuple[str, ...] = FIELDS, text: Column | None = None) -> Column:
    """The leaf of a row, with another text if one is given."""
    return digest(*(field(text if text is not None and f == "text" else F.col(f)) for f in fields))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with idx, from 0 in this order within each tree, and total, the tree's nodes."""
    placed = written(nodes.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))  # a row a tree and partition that has some of it
    whole = Window.partitionBy("tree")
    starts = counts.select("tree", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(whole).alias("total"))
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return placed.withColumn("at", within).join(starts, ["tree", "part"]).withColumn("idx", F.col("start") + F.col("at") - 1).drop("part", "at", "start")


def parent(idx: Column) -> Column:
    return F.floor(idx / FANOUT)


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels over the leaves (tree, idx, hash, total), lowest first: tree, idx, run (its children's hashes), hash, total."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    found, level = [], leaves
    while most > 1:
        runs = level.where("total > 1").groupBy("tree", parent(F.col("idx")).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash")))["hash"].alias("run"), F.max("total").alias("below"))
        level = written(runs.select("tree", "idx", "run", digest(F.array_join("run", "")).alias("hash"), F.ceil(F.col("below") / FANOUT).alias("total")), f"level-{len(found) + 1}")
        found.append(level)
        most = -(-most // FANOUT)
    return found


def roots(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """tree, hash and height of what remains of each tree."""
    ends = [level.where("total = 1").select("tree", "hash", F.lit(k).alias("height")) for k, level in enumerate([leaves, *above])]
    return reduce(DataFrame.unionByName, ends)


def paths(leaves: DataFrame, above: list[DataFrame], ends: DataFrame, carried: list[str]) -> DataFrame:
    """leaves with path, the siblings on the way up, left and right of the node a level. It goes on with the path that `ends`
    (tree, height, path) has for the tree, and each leaf gets the columns `carried` of its tree from there."""
    over = None
    for k in range(len(above), -1, -1):
        top = ends.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<string>").alias("family"), F.col("path").alias("rest"), *carried)
        over = top if over is None else over.unionByName(top)
        level = leaves if k == 0 else above[k - 1]
        place = (F.col("idx") % FANOUT).cast("int")
        own = F.struct(
            F.array_join(F.slice("family", F.lit(1), place), "").alias("left"),
            F.array_join(F.slice("family", place + 2, F.lit(FANOUT)), "").alias("right"),
        )
        path = F.when(F.col("family").isNull(), F.col("rest")).otherwise(F.concat(F.array(own), F.col("rest")))
        joined = level.withColumn("up", parent(F.col("idx"))).join(over, ["tree", "up"]).withColumn("path", path)
        if k == 0:
            return joined.drop("up", "family", "rest")
        over = joined.select("tree", F.col("idx").alias("up"), F.col("run").alias("family"), F.col("path").alias("rest"), *carried)
    raise AssertionError


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda so_far, s: digest(s["left"], so_far, s["right"]))


def with_proofs(documents: DataFrame, leaf_columns: dict[str, Column]) -> DataFrame:
    """doc_id and the leaf columns (one is called hash: the manifest's own) with subroot, path and root of each row."""
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), *(c.alias(n) for n, c in leaf_columns.items())), "doc_id", "hash")
    leaves = written(rows, "leaves")
    above = levels(leaves)
    ends = written(roots(leaves, above), "subroots")

    tops = numbered(ends.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash", "height"), "source")
    tops = written(tops.withColumnRenamed("height", "own_height"), "tops")
    over_tops = levels(tops)
    root = roots(tops, over_tops).withColumn("path", F.array().cast(PATH)).withColumnRenamed("hash", "root")
    sources = paths(tops, over_tops, root, ["root"])
    known = sources.select(F.col("source").alias("tree"), F.col("own_height").alias("height"), "path", F.col("hash").alias("subroot"), "root")
    return paths(leaves, above, written(known, "known"), ["subroot", "root"])


def manifest(documents: DataFrame) -> DataFrame:
    """A row of leaf, subroot, root, proof and the trial's outcome for each row of documents."""
    ident = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    struck = F.when(F.crc32(ident.cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = with_proofs(documents, {"hash": leaf(), "tampered": leaf(text=struck)})
    return proven.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_levels(documents: DataFrame) -> DataFrame:
    """The root and each source's subroot with its leaves' number: what is kept beside the dataset. tree is null for the root."""
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = written(numbered(documents.select("doc_id", tree.alias("tree"), leaf().alias("hash")), "doc_id", "hash"), "leaves")
    ends = written(roots(leaves, levels(leaves)), "subroots")
    tops = written(numbered(ends.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), "source"), "tops")
    counts = leaves.groupBy("tree").agg(F.max("total").alias("n_leaves"))
    subroots = ends.join(counts, "tree").select(F.lit("source").alias("kind"), F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"), "hash", "n_leaves")
    whole = roots(tops, levels(tops)).join(counts.agg(F.sum("n_leaves").alias("n_leaves")))
    return subroots.unionByName(whole.select(F.lit("root").alias("kind"), F.lit(None).cast("string").alias("source"), "hash", "n_leaves"))


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: The same in DuckDB's SQL.
ORACLE = f"""
with recursive rows as (
  select doc_id, coalesce('=' || source, '') as tree, {_sql_leaf("text")} as leaf,
    {_sql_leaf(f"(case when {sql_crc32("coalesce(doc_id::varchar, '')")} % 2 = 0 then replace(text, chr(10), '') else text end)")} as tampered
  from documents
), leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as total, row_number() over () as doc from rows
), level as (
  select tree, 0 as k, idx, leaf as h, total from leaves
  union all
  select tree, k + 1, idx // 3, sha256(string_agg(h, '' order by idx)), max((total + 2) // 3) from level where total > 1 group by tree, k, idx // 3
), subroots as (select tree, h, k from level where total = 1
), tops as (select tree, h, k, row_number() over (order by tree) - 1 as idx, count(*) over () as total from subroots
), top as (
  select 0 as k, idx, h, total from tops
  union all
  select k + 1, idx // 3, sha256(string_agg(h, '' order by idx)), max((total + 2) // 3) from top where total > 1 group by k, idx // 3
), way as (
  select l.doc, n.k, coalesce(string_agg(n.h, '' order by n.idx) filter (n.idx < l.idx // (3 ** n.k)::bigint), '') as "left",
    coalesce(string_agg(n.h, '' order by n.idx) filter (n.idx > l.idx // (3 ** n.k)::bigint), '') as "right"
  from leaves l join level n on n.tree = l.tree and n.total > 1 and n.idx // 3 = l.idx // (3 ** (n.k + 1))::bigint group by l.doc, n.k
  union all
  select l.doc, t.k + n.k, coalesce(string_agg(n.h, '' order by n.idx) filter (n.idx < t.idx // (3 ** n.k)::bigint), ''),
    coalesce(string_agg(n.h, '' order by n.idx) filter (n.idx > t.idx // (3 ** n.k)::bigint), '')
  from leaves l join tops t using (tree) join top n on n.total > 1 and n.idx // 3 = t.idx // (3 ** (n.k + 1))::bigint group by l.doc, t.k, n.k
), fold as (
  select doc, 0 as k, tampered as h from leaves
  union all
  select f.doc, f.k + 1, sha256(w."left" || f.h || w."right") from fold f join way w on w.doc = f.doc and w.k = f.k
), ends as (select doc, max_by(h, k) as folded_root from fold group by doc
), proofs as (select doc, sha256(string_agg("left" || "right", '' order by k)) as proof_sha256 from way group by doc
)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.h as verified
from leaves l join subroots s using (tree) join ends e using (doc) left join proofs p using (doc) cross join (select h from top where total = 1) r
"""
