"""Merkle dataset manifest (11): trees of three-way hashes over a data set, verified by recursive queries.

*Building.* Leaves are ordered per group; every three consecutive nodes of a level (the last run may be
shorter) give their parent, one grouped aggregate per level, until one subroot is left. The subroots, in the
order of their groups, are the leaves of a tree of the same kind, whose last node is the root of the data set.
Every level is written as parent-linked node rows: (node, parent, lft, rgt) with the digests of the run's
members before and after the node.

*Verifying.* A recursive query (``WITH RECURSIVE``) starts with a digest per leaf and joins each leaf's node to
its row, appends the siblings and folds the digest, until no parent is left. Levels are climbed in bands: the
recursive query of a band reads only that band's rows, and what it leaves is written, so a lost executor costs
one band. Once the levels left have at most ``BROADCAST_NODES`` rows they are climbed in one band, as a
broadcast of that proven size.

A node is named by one long: its level in the top byte, the position of its first leaf below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm.common import stored, table
from riskmart.llm.ranks import ranked

#: Members of a run.
RUN = 3
#: Levels that one recursive query climbs by shuffled joins.
BAND = 4
#: Rows of the upper levels (at most 200 bytes each) that may be broadcast.
BROADCAST_NODES = 10_000
#: Level of the tree of subroots; a group's own levels stay below it (3^36 > 2^56 leaves).
TOP = 64
_LEVEL = 56


@dataclass
class Manifest:
    """A built tree. ``leaves``: the input rows with ``_leaf``, ``_node``, ``_tree``; ``levels``: node rows by level
    number, ``counts`` of them; ``subroots``: (_tree, subroot); ``root``: hexadecimal digest (None for an empty table)."""

    leaves: DataFrame
    levels: dict[int, DataFrame]
    counts: dict[int, int]
    subroots: DataFrame
    root: str | None


def leaf_digest(*columns: Column) -> Column:
    """Hexadecimal sha256 of the columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in columns]
    return F.sha2(F.concat(*parts), 256)


def _hex(c: str | Column) -> Column:
    return F.lower(F.hex(c))


def _name(level: int) -> Column:
    return F.lit(level << _LEVEL).cast("long")


def _level(nodes: DataFrame, level: int, first: int) -> tuple[DataFrame, DataFrame]:
    """Rows (tree, start, idx, n, node, digest) of one level, n > 1 -> its node rows and the rows of the next level."""
    runs = nodes.groupBy("tree", "start", "n", F.expr(f"idx div {RUN}").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "node", "digest"))).alias("members"))     # at most RUN of them
    parent = _name(first + level + 1) + F.col("start") + F.col("run") * F.lit(RUN ** (level + 1)).cast("long")
    if first < TOP:                                   # a subroot is a leaf of the upper tree
        parent = F.when(F.col("n") <= RUN, _name(TOP) + F.col("tree")).otherwise(parent)
    runs = stored(runs.withColumn("parent", parent).withColumn("digests", F.transform("members", lambda m: m["digest"])), "merkle-runs")
    empty = F.lit(b"")
    rows = runs.select("parent", "digests", F.posexplode("members").alias("at", "m")).select(
        F.col("m.node").alias("node"), "parent",
        F.aggregate(F.expr("slice(digests, 1, at)"), empty, lambda a, d: F.concat(a, d)).alias("lft"),
        F.aggregate(F.expr(f"slice(digests, at + 2, {RUN})"), empty, lambda a, d: F.concat(a, d)).alias("rgt"))
    above = runs.select("tree", "start", F.col("run").alias("idx"), F.ceil(F.col("n") / RUN).cast("long").alias("n"),
                        F.col("parent").alias("node"),
                        F.unhex(F.sha2(F.array_join(F.transform("digests", lambda d: _hex(d)), ""), 256)).alias("digest"))
    return rows, above


def _tree(nodes: DataFrame, most: int, first: int) -> tuple[dict[int, DataFrame], DataFrame]:
    """Level 0 of one or more trees of at most ``most`` leaves -> node rows by level, and the last nodes."""
    levels, ends, k = {}, [nodes.filter("n = 1")], 0
    while most > 1:
        rows, nodes = _level(nodes.filter("n > 1"), k, first)
        levels[first + k] = rows
        most, k = -(-most // RUN), k + 1
        ends.append(nodes.filter("n = 1"))
    return levels, reduce(DataFrame.unionAll, ends)


def build(rows: DataFrame, *, group_col: str, order_cols: Sequence[str], digest_col: str) -> Manifest:
    """The manifest of ``rows``, whose hexadecimal leaf digests are in ``digest_col``.

    Groups stand in the order of ``group_col`` (null is a group, the first; bytewise) and their leaves in that of
    ``order_cols`` (nulls first), then of the digest: rows that tie in both are equal leaves, each a leaf of
    its own. ``rows`` may have any other columns except those that begin with ``_``; ``leaves`` keeps them and adds
    ``_leaf`` (position of the leaf), ``_node`` and ``_tree``. A group of one leaf has that leaf as subroot.
    No rows: no root.
    """
    leaves = ranked(rows, [group_col, *order_cols, digest_col], "_leaf", "merkle-leaves")
    groups = leaves.groupBy(F.col(group_col).alias("_group")).agg(F.min("_leaf").alias("_start"), F.count("*").alias("_n"))
    groups = stored(ranked(groups, ["_start"], "_tree", "merkle-groups"), "merkle-trees")
    most, n_groups = groups.agg(F.max("_n"), F.count("*")).first()
    leaves = leaves.join(groups, F.col(group_col).eqNullSafe(F.col("_group"))).drop("_group")
    leaves = stored(leaves.withColumn("_node", F.when(F.col("_n") == 1, _name(TOP) + F.col("_tree")).otherwise(F.col("_leaf"))), "merkle-placed")
    level0 = leaves.select(F.col("_tree").alias("tree"), F.col("_start").alias("start"), (F.col("_leaf") - F.col("_start")).alias("idx"),
                           F.col("_n").alias("n"), F.col("_node").alias("node"), F.unhex(digest_col).alias("digest"))
    levels, ends = _tree(level0, most or 0, 0)
    ends = stored(ends.select("tree", "node", "digest"), "merkle-subroots")
    zero = F.lit(0).cast("long")
    top = ends.select(zero.alias("tree"), zero.alias("start"), F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "node", "digest")
    upper, last = _tree(top, n_groups, TOP)
    root = last.select(_hex("digest")).first()
    counts = {TOP + k: -(-n_groups // RUN ** k) for k in range(len(upper))}
    if levels:                                        # a group of n leaves has ceil(n / 3^k) nodes at level k
        size = [F.ceil(F.col("_n") / float(RUN ** k)) for k in levels]
        counts |= zip(levels, groups.agg(*[F.sum(F.when(c > 1, c).otherwise(0)) for c in size]).first())
    return Manifest(leaves.drop("_start", "_n"), {**levels, **upper}, counts,
                    ends.select(F.col("tree").alias("_tree"), _hex("digest").alias("subroot")), root[0] if root else None)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: One row per leaf and level: ``folded`` is the digest of ``node`` as it follows from the leaf's.
CLIMB = """
WITH RECURSIVE climb(leaf, node, folded, depth, siblings) MAX RECURSION LEVEL 100 AS (
  SELECT leaf, node, folded, depth, CAST(NULL AS BINARY) FROM {starts}
  UNION ALL
  SELECT {hint} c.leaf, n.parent,
         unhex(sha2(concat(lower(hex(n.lft)), lower(hex(c.folded)), lower(hex(n.rgt))), 256)),
         c.depth + 1, concat(n.lft, n.rgt)
  FROM climb c JOIN {nodes} n ON n.node = c.node
)
SELECT * FROM climb
"""


def climb(manifest: Manifest, starts: DataFrame) -> DataFrame:
    """(leaf, folded, proof) for ``starts`` (leaf, node, digest): any key, the leaf's node, a hexadecimal digest to fold.

    ``folded`` is the root that follows from the digest and the leaf's siblings, ``proof`` the siblings' digests
    from the bottom to the root, left to right, concatenated (empty where a leaf is the root itself).
    """
    spark = starts.sparkSession
    now = starts.select("leaf", "node", F.unhex("digest").alias("folded"), F.lit(0).alias("depth"))
    order, steps = sorted(manifest.levels), []
    while order:
        left = sum(manifest.counts[k] for k in order)
        band = order if left <= BROADCAST_NODES else order[:BAND]
        order = order[len(band):]
        nodes = reduce(DataFrame.unionAll, [manifest.levels[k] for k in band])
        text = CLIMB.replace("{hint}", "/*+ BROADCAST(n) */" if left <= BROADCAST_NODES else "")
        # the limit on rows is a guard against endless recursion, which a tree cannot have
        with _settings(spark, {"spark.sql.cteRecursionRowLimit": "-1"}):
            rows = stored(spark.sql(text, starts=now, nodes=nodes), "merkle-climb")
        steps.append(rows.filter("siblings IS NOT NULL").select("leaf", "depth", "siblings"))
        above = order[0] if order else max(band) + 1
        now = rows.filter(F.shiftright("node", _LEVEL) >= above).select("leaf", "node", "folded", "depth")
    folds = now.select("leaf", _hex("folded").alias("folded"))
    if not steps:
        return folds.withColumn("proof", F.lit(""))
    proofs = reduce(DataFrame.unionAll, steps).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "siblings"))).alias("s"))
    proofs = proofs.select("leaf", F.array_join(F.transform("s", lambda x: _hex(x["siblings"])), "").alias("proof"))
    return folds.join(proofs, "leaf")


def verify(manifest: Manifest, *, id_col: str, group_col: str, digest_col: str, claimed_col: str) -> DataFrame:
    """Every leaf's id, group and digest with subroot, root, proof_sha256, folded_root (from the digest in
    ``claimed_col``) and verified (folded_root equals root)."""
    folds = climb(manifest, manifest.leaves.select(F.col("_leaf").alias("leaf"), F.col("_node").alias("node"), F.col(claimed_col).alias("digest")))
    root = F.lit(manifest.root).cast("string")
    return (manifest.leaves.join(manifest.subroots, "_tree").join(folds.withColumnRenamed("leaf", "_leaf"), "_leaf")
            .select(id_col, group_col, F.col(digest_col).alias("leaf"), "subroot", root.alias("root"),
                    F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
                    (F.col("folded") == root).alias("verified")))


def document_manifest(docs: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    The tampering is that of the query's contract: where the crc32 of the decimal doc_id is even, the newlines
    are deleted from the text. Null columns count as ``-``; a null text or doc_id is never tampered
    with. Repeated rows are leaves of their own. Extra columns are not hashed. No rows give no rows.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf_digest(*fields_of(fields)).alias("leaf"),
                       leaf_digest(*fields_of(fields[:-1]), cut).alias("claimed"))
    manifest = build(rows, group_col="source", order_cols=["doc_id"], digest_col="leaf")
    return verify(manifest, id_col="doc_id", group_col="source", digest_col="leaf", claimed_col="claimed")


def fields_of(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))
