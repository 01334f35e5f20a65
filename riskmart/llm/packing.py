"""Packing (9): lexical retrieval packing with a sharded BM25 inverted index.

Texts are tokenised once into a table in the shared folder. Document frequencies and the mean length are
counted over all documents. Every task then packs its rows in shards of documents: whole windows are cut
from long documents, the tails are indexed (BM25 over token ids, corpus-wide idf), and each seed - the
longest tail not used yet - takes its best unused neighbours that still fit; what is left of the window is
filled by cutting the best neighbour that does not fit. Only a task's last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import stored, table
from riskmart.llm.wordtokens import END_ID, default_tokenizer, encoder

WINDOW = 2048
#: A shard is closed by the document that brings it to this many documents or ids.
SHARD_DOCS, SHARD_IDS = 1024, 1 << 21
K1, B = 1.2, 0.75
PIECE = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def token_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids as little-endian uint16/32 bytes with the end id), written to the shared folder."""
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [x + end for x in enc.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(encode, "doc_id long, ids binary"), "tokens")


def corpus_statistics(tokens: DataFrame, dtype: np.dtype, vocab: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of every id, number of documents and mean length, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, size = np.zeros(vocab, np.int64), 0, 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                ids = np.frombuffer(raw, dtype=dtype)
                df[np.unique(ids)] += 1
                docs, size = docs + 1, size + len(ids)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([seen, [-1, -2]])), pa.array(np.concatenate([df[seen], [docs, size]]))],
            names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(vocab, np.int64), {-1: 0, -2: 0}      # at most one row per id of the vocabulary
    for r in rows:
        if r.id < 0:
            total[r.id] = r.n
        else:
            df[r.id] = r.n
    return df, total[-1], total[-2] / max(1, total[-1])


class Shard:
    """Documents of one shard and the BM25 index of their tails."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean
        self.keys: list = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.size += len(ids)

    def index(self, lo: np.ndarray) -> None:
        docs, terms, weights = [], [], []
        for k, ids in enumerate(self.ids):
            if lo[k] < len(ids):
                t, tf = np.unique(ids[lo[k]:], return_counts=True)
                keep = self.idf[t] > 0
                t, tf = t[keep].astype(np.int64), tf[keep]
                docs.append(np.full(len(t), k))
                terms.append(t)
                weights.append(self.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(ids) - lo[k]) / self.mean)))
        self.terms = [None] * len(self.ids)
        for d, t in zip(docs, terms):
            if len(d):
                self.terms[d[0]] = t
        t = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(t, kind="stable")
        self.docs = (np.concatenate(docs) if docs else t)[order]
        self.weights = (np.concatenate(weights) if weights else t.astype(float))[order]
        self.at = np.searchsorted(t[order], np.arange(len(self.idf) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a term with the seed, best BM25 score first (ties: order in the shard)."""
        t = self.terms[seed]
        if t is None or not len(t):
            return np.zeros(0, np.int64)
        lo, n = self.at[t], self.at[t + 1] - self.at[t]
        pos = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        score = np.bincount(self.docs[pos], weights=self.weights[pos], minlength=len(self.ids))
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]

    def sequences(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, from, to); the last one may be shorter than the window."""
        end = np.array([len(x) for x in self.ids], dtype=np.int64)
        lo = end - end % window
        for k in np.flatnonzero(lo):
            for a in range(0, int(lo[k]), window):
                yield [(int(k), a, a + window)]
        self.index(lo)
        free = lo < end
        by_size = np.argsort(lo - end, kind="stable")
        at = 0
        while True:
            while at < len(by_size) and not free[by_size[at]]:
                at += 1
            if at == len(by_size):
                return
            seed = int(by_size[at])
            free[seed] = False
            out, room = [(seed, int(lo[seed]), int(end[seed]))], window - int(end[seed] - lo[seed])
            near = self.neighbours(seed) if room else by_size[:0]
            near = np.concatenate([near[free[near]], by_size[at:][free[by_size[at:]]]]) if room else near
            while room:
                near = near[free[near]]
                if not len(near):
                    break
                fits = near[end[near] - lo[near] <= room]
                k = int(fits[0] if len(fits) else near[0])
                n = min(room, int(end[k] - lo[k]))
                out.append((k, int(lo[k]), int(lo[k]) + n))
                lo[k] += n
                room -= n
                free[k] = lo[k] < end[k]
            yield out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``window`` ids.

    Columns: doc_id, start (the document's ids before the piece), length, ids (little-endian uint32 bytes),
    doc_tokens, sequence_id, offset (position in the sequence, gapless from 0). Each id lies in exactly one
    piece. Null and empty texts hold the end id alone; rows with a null or repeated id are packed like any
    other. An empty table gives no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    enc = encoder(tokenizer)
    dtype, vocab = enc.dtype, max(enc.vocab, end_id + 1)
    tokens = token_table(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id)
    df, n, mean = corpus_statistics(tokens, dtype, vocab)
    # Robertson/Sparck Jones idf, not below 0: ids in more than half of the documents retrieve nothing
    idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5))).astype(np.float32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        shard, rest, n_seq = Shard(idf, mean), [], 0

        def rows(pieces: list[tuple], seq: list[int], offset: list[int]) -> pa.RecordBatch:
            key, a, x, size = zip(*pieces)
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array([len(v) for v in x], pa.int64()),
                 pa.array([v.astype("<u4").tobytes() for v in x], pa.binary()), pa.array(size, pa.int64()),
                 pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close(shard: Shard, rest: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
            """Pack a shard; short sequences wait (in ``rest``) and are joined with later ones."""
            nonlocal n_seq
            pieces, seq, offset = [], [], []

            def put(parts: list[tuple]) -> None:
                nonlocal n_seq
                at = 0
                for p in parts:
                    pieces.append(p)
                    seq.append(first + n_seq)
                    offset.append(at)
                    at += len(p[2])
                n_seq += 1

            for s in shard.sequences(window):
                parts = [(shard.keys[k], a, shard.ids[k][a:b], len(shard.ids[k])) for k, a, b in s]
                if sum(len(p[2]) for p in parts) == window:
                    put(parts)
                else:
                    rest += parts
                if len(pieces) >= 2048:
                    yield rows(pieces, seq, offset)
                    pieces, seq, offset = [], [], []
            while rest and (last or sum(len(p[2]) for p in rest) >= window):
                parts, room = [], window
                while rest and room:
                    key, a, x, size = rest.pop(0)
                    parts.append((key, a, x[:room], size))
                    if len(x) > room:
                        rest.insert(0, (key, a + room, x[room:], size))
                    room -= len(parts[-1][2])
                put(parts)
            if pieces:
                yield rows(pieces, seq, offset)

        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard.add(key, np.frombuffer(raw, dtype=dtype))
                if len(shard.ids) >= SHARD_DOCS or shard.size >= SHARD_IDS:
                    yield from close(shard, rest, False)
                    shard = Shard(idf, mean)
        yield from close(shard, rest, True)

    return tokens.mapInArrow(packed, PIECE)


def op9_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the remaining documents as packed pieces."""
    return digest(pack(docs))
