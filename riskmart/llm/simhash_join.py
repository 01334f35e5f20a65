"""SimHash near-dedup (13): binary trie self-join of 64-bit fingerprints.

*Fingerprints.* A text's bit is 1 if it is set in over half of the XXH64 values (seed 42) of its 3-word shingles,
repeats included. Equal fingerprints are one entry of the trie, however many texts have them.

*Upper trie.* From the root on, all node pairs whose prefixes differ in at most ``BITS`` bits are taken down
together, ``STEP`` bits at a time, as a join of a table of pairs with the children of both nodes; the differing
bits add up and a pair over the budget goes. A pair whose nodes have at most ``LEAF`` fingerprints goes no
deeper. Only nodes with counts are shuffled here, no fingerprints.

*Lower trie.* The fingerprints below the two nodes of such a pair meet in one task, as two sorted arrays; a node is
a range of them. The traversal goes on bit by bit over arrays of range pairs, in bounded portions; what meets its
budget down to single fingerprints is a link. A spanning forest of the links leaves the task.

Links are closed by the distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import stored, table
from riskmart.llm.components import components

#: Words of a shingle; the seed of its hash; fingerprints link at so many differing bits or fewer.
WIDTH, SEED, BITS = 3, 42, 2
#: Fingerprints of a trie node that are joined in one task; bits taken down at once above that.
LEAF, STEP = 32_768, 4
#: Range pairs held at once in a task; shingles hashed at once.
PORTION, CHUNK = 1 << 20, 1 << 18


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, most significant first; zero for a text without words."""
    raw = (text or "").encode().lower().split()         # bytes: A-Z and the six blanks of ASCII alone
    if not raw:
        return bytes(8)
    joined = b" ".join(raw)
    if len(raw) <= WIDTH:
        return xxhash.xxh64_digest(joined, SEED)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[:len(raw) - WIDTH + 1].tolist(), end[WIDTH - 1:].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_digest
    for lo in range(0, len(first), CHUNK):
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[lo:lo + CHUNK], last[lo:lo + CHUNK])])
        ones += np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(first)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b"".join([fingerprint(t) for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))], names=["doc_id", "f"])


def prefix(f: str, depth: int) -> str:
    """SQL: the first ``depth`` bits of fingerprint ``f`` as a number."""
    return f"shiftrightunsigned({f}, {64 - depth})" if depth else "0L"


def node_pairs(prints: DataFrame) -> DataFrame:
    """(depth, a, b, diff): pairs a <= b of trie nodes whose fingerprints meet in a task. All pairs of fingerprints within
    ``BITS`` bits lie below exactly one of them. ``prints``: distinct ``f``."""
    spark = prints.sparkSession
    done = []
    pairs = spark.createDataFrame([(0, 0, 0)], "a long, b long, diff int")
    for depth in range(0, 64, STEP):
        here = prints.groupBy(F.expr(prefix("f", depth)).alias("node")).agg(F.count("*").alias("n"))
        pairs = (pairs.join(here.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
                 .join(here.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"))
        pairs = stored(pairs.select(F.lit(depth).alias("depth"), "a", "b", "diff", (F.greatest("na", "nb") <= LEAF).alias("small")), "trie-pairs")
        done.append(pairs.filter("small").drop("small"))
        rest = pairs.filter("NOT small")
        if rest.isEmpty():
            break
        deeper = prints.groupBy(F.expr(prefix("f", depth + STEP)).alias("child")).count().select(F.shiftrightunsigned("child", STEP).alias("node"), "child")
        # at most 2^STEP children a node; equal nodes give each pair of children once
        pairs = (rest.join(deeper.select(F.col("node").alias("a"), F.col("child").alias("ca")), "a")
                 .join(deeper.select(F.col("node").alias("b"), F.col("child").alias("cb")), "b")
                 .withColumn("diff", F.col("diff") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))))
                 .filter((F.col("diff") <= BITS) & ((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))))
                 .select(F.col("ca").alias("a"), F.col("cb").alias("b"), "diff"))
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out


def trie_links(x: np.ndarray, y: np.ndarray, same: bool, depth: int, diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in the sorted uint64 arrays with x[i] and y[j] at most ``BITS`` bits apart, in portions.

    The values of each array agree in the first ``depth`` bits, which differ in ``diff`` bits between them.
    ``same``: both are one array, and each pair is given once, i < j.
    """
    if not len(x) or not len(y):
        return
    one = np.ones(1, dtype=np.int64)
    stack = [(depth, one * 0, one * len(x), one * 0, one * len(y), one * diff)]
    while stack:
        d, alo, ahi, blo, bhi, e = stack.pop()
        if len(e) > PORTION:
            half = len(e) // 2
            stack += [(d, *(v[half:] for v in (alo, ahi, blo, bhi, e))), (d, *(v[:half] for v in (alo, ahi, blo, bhi, e)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if d == 64 or single.any():
            at = np.flatnonzero(single) if d < 64 else np.arange(len(e))
            i, j = alo[at], blo[at]
            near = np.bitwise_count(x[i] ^ y[j]) <= BITS
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            if d == 64:
                continue
            rest = ~single
            alo, ahi, blo, bhi, e = (v[rest] for v in (alo, ahi, blo, bhi, e))
        if not len(e):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        above = ~(bit | (bit - np.uint64(1)))
        # where the bit turns 1 inside a range: the bits above are those of its first value
        amid = np.clip(np.searchsorted(x, (x[alo] & above) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(y, (y[blo] & above) | bit), blo, bhi)
        parts = []
        for p, q, r, s, more in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            keep = (p < q) & (r < s) & (e + more <= BITS)
            if same:                                # one node twice: its two halves meet once
                keep &= p <= r
            parts.append((p[keep], q[keep], r[keep], s[keep], e[keep] + more))
        stack.append((d + 1, *(np.concatenate(v) for v in zip(*parts))))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place of the component of each of n places."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _joined(t: pa.Table) -> pa.Table:
    """All fingerprints below one pair of nodes -> a spanning forest of their links."""
    depth, diff, same = (t.column(c)[0].as_py() for c in ("depth", "diff", "same"))
    f, side = t.column("f").to_numpy().view(np.uint64), t.column("side").to_numpy()
    x = np.sort(f[side == 0])
    if same:
        label, values = _forest(len(x), trie_links(x, x, True, depth, diff)), x
    else:
        y = np.sort(f[side == 1])
        values = np.concatenate([x, y])
        label = _forest(len(values), ((i, j + len(x)) for i, j in trie_links(x, y, False, depth, diff)))
    own = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(values[own].view(np.int64)), "b": pa.array(values[label[own]].view(np.int64))})


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links whose closure is that of all pairs of different fingerprints ``f`` within ``BITS`` bits."""
    pairs = stored(node_pairs(prints).withColumn("pair", F.monotonically_increasing_id()), "trie-leaf-pairs")
    sides = pairs.select("depth", "pair", "diff", F.expr("a = b").alias("same"),
                         F.explode(F.expr("IF(a = b, array(struct(a AS node, 0 AS side)), array(struct(a AS node, 0 AS side), struct(b AS node, 1 AS side)))")).alias("s"))
    sides = sides.select("depth", "pair", "diff", "same", "s.node", "s.side")
    out = None
    for (depth,) in sorted(pairs.select("depth").distinct().collect()):          # at most 64 / STEP + 1
        met = (prints.select("f", F.expr(prefix("f", depth)).alias("node")).join(sides.filter(F.col("depth") == depth), "node")
               .select("pair", "depth", "diff", "same", "side", "f")
               .groupBy("pair").applyInArrow(_joined, "a long, b long"))
        out = met if out is None else out.unionAll(met)
    return out if out is not None else prints.select(F.col("f").alias("a"), F.col("f").alias("b")).filter("false")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable by links of
    fingerprints that differ in at most ``BITS`` bits.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows stay rows of
    their own; a row without an id takes part by its text and gets the smallest id of its component. Other columns
    are not looked at. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = stored(texts.mapInArrow(_fingerprints, "doc_id long, f long"), "fingerprints")
    lowest = stored(members.groupBy("f").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    tree = components(links(lowest.select("f"))).withColumnRenamed("id", "f")
    roots = lowest.join(tree, "f", "left").withColumn("root", F.coalesce("root", "f"))
    ids = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = stored(roots.select("f", "root").join(ids, "root").select("f", "component_id"), "fingerprint-components")
    return (members.join(ids, "f")
            .select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component holds a smaller id (rows that tie in it, and rows without an id, stay)."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_other"), "left_anti")


def op13_simhash_trie(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
