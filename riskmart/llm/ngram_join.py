"""N-gram Jaccard join (7): blocked sparse product of the document-by-shingle incidence matrix.

1. *members*: every document's set size and class (fingerprint of its shingle set). Equal sets are one row
   of the matrix from here on, however many copies there are.
2. *columns*: the matrix is dealt out in column blocks (ranges of shingle fingerprints, packed per class).
   Each block counts how many classes hold each of its shingles; entries that only one class has can't
   overlap anything and end here. Shingles that a fixed share of all entries repeats (a bounded list, found
   by counts per batch) skip this step and are spread over many keys, so a common passage never gathers
   in one task.
3. *size bound*: a class with fewer than 75 % shared entries can't reach the threshold. Of the others, the
   ``n - ceil(0.75 n) + 1`` rarest shingles must meet those of any partner (one global order: count, then
   fingerprint), which gives the candidate graph; only stars of it are written, never all pairs.
4. *row blocks*: each candidate component is multiplied with itself in blocks of rows and of columns,
   accumulating overlap counts; pairs below the size-derived bound are dropped and a spanning forest
   of the links leaves the task. A large component is cut into chunks that meet pairwise in separate tasks.
5. Links are closed by the distributed union-find, and every document gets its component's smallest id.

Fingerprints have 64 bits: two different shingles or sets are taken for equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import row_key, stored, table, without_rows
from riskmart.llm.components import components
from riskmart.llm.shingles import shingle_sets

#: Link at 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Entries of the matrix in one column block; classes in one chunk of a row block.
BLOCK_ENTRIES, CHUNK = 3_000_000, 512
#: The list of common shingles holds those with at least 1 / HOT_SHARE of all entries (so at most HOT_SHARE).
HOT_SHARE = 100_000
MANY = 65535


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shared shingles that a set of n needs with any partner."""
    return -(-THRESHOLD * n // 100)


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(texts: list[str | None]) -> tuple[list[int | None], list[np.ndarray]]:
    sets = shingle_sets(texts)
    return [_class(s) if len(s) else None for s in sets], sets


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, sets = _classes(b.column(1).to_pylist())
        own = {c: s for c, s in zip(cls, sets) if c is not None}
        common = b""
        if own:
            h, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
            often = n >= 4
            common = h[often].tobytes() + n[often].astype(np.uint64).tobytes()
        note = [None] * (b.num_rows - 1) + [common or None]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()),
             pa.array(note, pa.binary())], names=["doc_id", "n_shingles", "cls", "common"])


def _unpack_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            h, n = np.frombuffer(raw, dtype=np.uint64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.view(np.int64))], names=["h", "n"])


def hot_shingles(members: DataFrame) -> tuple[np.ndarray, int]:
    """Sorted fingerprints of the commonest shingles (at most HOT_SHARE of them) and the matrix's entries."""
    entries = members.agg(F.sum("n_shingles")).first()[0] or 0
    least = max(64, entries // HOT_SHARE)
    rows = (members.select("common").filter("common is not null").mapInArrow(_unpack_common, "h long, n long")
            .groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h", "n").collect())
    h = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    return np.sort(h), entries


def _blob(cls: np.ndarray, size: np.ndarray, count: np.ndarray, *columns: np.ndarray) -> bytes:
    """Per class: fingerprint, set size and number of entries; then the entries' columns."""
    return b"".join([np.int64(len(cls)).tobytes(), cls.astype(np.int64).tobytes(), size.astype(np.int32).tobytes(),
                     count.astype(np.int32).tobytes(), *(c.tobytes() for c in columns)])


def _open(raw: bytes, *dtypes) -> list[np.ndarray]:
    """Entry-wise columns of a blob: class, set size, then the columns."""
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    cls, size, count = (np.frombuffer(raw, t, k, o) for t, o in ((np.int64, 8), (np.int32, 8 + 8 * k), (np.int32, 8 + 12 * k)))
    at, out, n = 8 + 16 * k, [np.repeat(cls, count), np.repeat(size, count)], int(count.sum())
    for t in dtypes:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _deal(hot: np.ndarray, blocks: int):
    """Entries of each batch's classes, by column block; common shingles under keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()
        for b in batches:
            cls, sets = _classes(b.column(0).to_pylist())
            own = {c: s for c, s in zip(cls, sets) if c is not None}
            if not own:
                continue
            c = np.array(list(own), dtype=np.int64)
            n = np.array([len(s) for s in own.values()])
            h, row = np.concatenate(list(own.values())), np.repeat(np.arange(len(c)), n)
            at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
            common = hot[at] == h if len(hot) else np.zeros(len(h), bool)
            key = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
            key[common] = blocks + salt % 1_000_000
            salt += 7919
            order = np.argsort(key, kind="stable")
            key, row, h = key[order], row[order], h[order]
            keys, blobs = [], []
            for lo, m in zip(*_runs(key)):
                r = row[lo:lo + m]
                f, k = _runs(r)
                keys.append(int(key[lo]))
                blobs.append(_blob(c[r[f]], n[r[f]], k, h[lo:lo + m]))
            for i in range(0, len(keys), 64):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 64], pa.int32()), pa.array(blobs[i:i + 64], pa.binary())],
                                                 names=["key", "blob"])

    return run


def _shared(blocks: int, groups: int):
    """One column block -> its shared entries with their counts, packed by group of classes."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_open(raw, np.uint64) for raw in t.column("blob").to_pylist()]
        cls, size, h = (np.concatenate(x) for x in zip(*parts))
        if t.column("key")[0].as_py() >= blocks:                  # common shingles: the count is known to be high
            order = np.lexsort((h, cls))
            cls, size, h = cls[order], size[order], h[order]
            new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (h[1:] != h[:-1])])
            cls, size, h = cls[new], size[new], h[new]
            count = np.full(len(h), MANY)
        else:
            order = np.argsort(h, kind="stable")
            h = h[order]
            first, n = _runs(h)
            some = np.repeat(n > 1, n)
            h, order = h[some], order[some]
            cls, size = cls[order], size[order]
            order = np.lexsort((cls, h))                          # copies of a class from other batches go
            cls, size, h = cls[order], size[order], h[order]
            new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
            cls, size, h = cls[new], size[new], h[new]
            first, n = _runs(h)
            count = np.repeat(n, n)
            some = count > 1
            cls, size, h, count = cls[some], size[some], h[some], count[some]
        group = (cls.view(np.uint64) % np.uint64(groups)).astype(np.int32)
        order = np.lexsort((cls, group))
        cls, size, h, count, group = cls[order], size[order], h[order], np.minimum(count[order], MANY).astype(np.uint16), group[order]
        keys, blobs = [], []
        for lo, m in zip(*_runs(group)):
            c = cls[lo:lo + m]
            f, k = _runs(c)
            keys.append(int(group[lo]))
            blobs.append(_blob(c[f], size[lo:lo + m][f], k, h[lo:lo + m], count[lo:lo + m]))
        return pa.table({"grp": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _bounded(t: pa.Table) -> pa.Table:
    """Classes of a group that pass the size bound, entries in the global order."""
    cls, size, h, count = (np.concatenate(x) for x in zip(*(_open(raw, np.uint64, np.uint16) for raw in t.column("blob").to_pylist())))
    order = np.lexsort((h, count, cls))
    cls, size, h, count = cls[order], size[order], h[order], count[order]
    new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (h[1:] != h[:-1])])     # common ones of several batches
    cls, size, h = cls[new], size[new], h[new]
    first, k = _runs(cls)
    rows = []
    for lo, m in zip(first.tolist(), k.tolist()):
        n = int(size[lo])
        need = least_overlap(n)
        if m >= need:
            rows.append((int(cls[lo]), n, m - need + 1, h[lo:lo + m].tobytes()))
    c, n, p, raw = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"cls": pa.array(c, pa.int64()), "n": pa.array(n, pa.int32()), "prefix": pa.array(p, pa.int32()),
                     "hashes": pa.array(raw, pa.binary())})


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, prefix = b.column(0).to_numpy(), b.column(1).to_numpy()
        h = [np.frombuffer(raw, np.int64, p) for raw, p in zip(b.column(2).to_pylist(), prefix.tolist())]
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.repeat(cls, prefix))], names=["h", "cls"])


def product_links(sizes: np.ndarray, sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Boolean matrix of links: the incidence matrix times its transpose, ``columns`` columns at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[col] > 1
    rank = np.cumsum(n > 1) - 1
    row, col = row[keep], rank[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        a, b = np.searchsorted(col, (lo, lo + columns))
        x = np.zeros((len(sets), columns), dtype=np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        overlap += x @ x.T
    union = sizes[:, None] + sizes[None, :] - overlap
    return 100 * overlap.astype(np.float64) >= THRESHOLD * union


def _links(t: pa.Table) -> pa.Table:
    """A row block -> a spanning forest of the links in it, as (a, smallest class of its tree)."""
    root = t.column("root").to_numpy()
    cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
    raw = t.column("hashes").to_pylist()
    order = np.lexsort((cls, root))
    a, b = [], []
    for lo, m in zip(*_runs(root[order])):
        at = order[lo:lo + m]
        linked = product_links(n[at].astype(np.float64), [np.frombuffer(raw[i], np.uint64) for i in at])
        label = np.arange(m)
        while True:                                  # smallest label over the neighbours until nothing changes
            new = np.where(linked, label[None, :], m).min(axis=1)
            new = np.minimum(new, label)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(m))
        a += cls[at[own]].tolist()
        b += cls[at[label[own]]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id reachable
    by links (Jaccard of the 5-word shingle sets >= 0.75), its own included.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows with equal sets are
    linked; repeated rows stay rows of their own. A row without an id takes part by its text. An empty
    table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = stored(texts.mapInArrow(_members, "doc_id long, n_shingles long, cls long, common binary"), "members")
    hot, entries = hot_shingles(members)
    blocks = max(64, -(-entries // BLOCK_ENTRIES))
    groups = max(64, -(-entries // BLOCK_ENTRIES))
    dealt = texts.select("text").mapInArrow(_deal(hot, blocks), "key int, blob binary")
    shared = dealt.groupBy("key").applyInArrow(_shared(blocks, groups), "grp int, blob binary")
    play = stored(shared.groupBy("grp").applyInArrow(_bounded, "cls long, n int, prefix int, hashes binary"), "bounded")

    meet = play.select("cls", "prefix", "hashes").mapInArrow(_prefixes, "h long, cls long")
    star = meet.groupBy("h").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
    candidates = components(meet.join(star.select("h", "low"), "h").select(F.col("cls").alias("a"), F.col("low").alias("b")))
    chunks = (candidates.groupBy("root").agg(F.count("*").alias("m"))
              .withColumn("k", F.ceil(F.col("m") / CHUNK).cast("int")))
    n_small = F.lit(max(64, blocks)).cast("long")
    rows = (play.select("cls", "n", "hashes").join(candidates.withColumnRenamed("id", "cls"), "cls").join(chunks, "root")
            .withColumn("c", F.pmod(F.xxhash64("cls"), F.col("k").cast("long")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)))
            .withColumn("key", F.when(F.col("k") == 1, F.pmod(F.xxhash64("root"), n_small))
                        .otherwise(F.xxhash64("root", F.least("c", "other"), F.greatest("c", "other")))))
    links = rows.select("key", "root", "cls", "n", "hashes").groupBy("key").applyInArrow(_links, "a long, b long")
    linked = components(links)

    smallest = members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    smallest = (smallest.join(linked.withColumnRenamed("id", "cls"), "cls", "left")
                .withColumn("root", F.coalesce("root", "cls")))
    ids = smallest.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = smallest.select("cls", "root").join(ids, "root").select("cls", "component_id")
    return (members.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest id (rows without one last; ties: the smaller
    :func:`row_key`). Of rows equal in id and text one stays. Rows without words are copies of nothing and stay."""
    rows = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
    found = near_duplicates(rows, id_col="key").select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("root"))
    found = stored(found.filter("n_shingles > 0").distinct().join(rows.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")), "key"), "near-rows")
    order = F.struct(F.col("id").isNull(), "id", "key")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.key").alias("first"))
    out = without_rows(docs, found.join(first, "root").filter("key <> first").select("key"))
    again = found.filter("n > 1").select("key")
    if again.isEmpty():
        return out
    once = out.withColumn("key" + "_".join(docs.columns), row_key(out))          # a name that clashes with none
    key = once.columns[-1]
    some = once.join(again.toDF(key), key, "left_semi").dropDuplicates([key])
    return once.join(again.toDF(key), key, "left_anti").select(*docs.columns).unionByName(some.select(*docs.columns))
