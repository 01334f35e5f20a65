"""Benchmark decontamination (3): pigeonhole edit matching.

A test item of m characters that occurs in a document with at most k edits, cut into k + 1 pieces, leaves
at least one piece untouched. So the pieces of all items go into one Aho-Corasick automaton, documents are
searched for exact piece hits, and each hit's surroundings are verified by Myers' bit-parallel approximate
search (one Python integer per column, any item length). Both sides are compared in lower case with white
space runs as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import row_key, table, without_rows

#: Edits allowed per character of an item.
RATE = 0.08
#: Bytes of item text that one pass over the documents searches for (bounds the automaton in each task).
PASS_BYTES = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places in the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, masks: dict[str, int], text: str, k: int) -> tuple[int, int] | None:
    """Fewest edits (if at most k) of ``item`` against any substring of ``text``, and the first end of such
    a substring. ``masks``: bit i of masks[c] is set where item[i] is c."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


class Matcher:
    """Piece automaton and verification for a set of items [(item_id, normalised text)]."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, places = [], {}
        for item_id, item in items:
            k = budget(item, rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            for at, piece in pieces(item, k):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, item, k, masks))
        self.find = ahocorasick.Automaton()
        for piece, where in places.items():
            self.find.add_word(piece, (len(piece), where))
        self.find.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, end in the normalised text) of each item found, at its fewest edits."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (n, where) in self.find.iter(text):
            for i, at in where:
                m, k = len(self.items[i][1]), self.items[i][2]
                lo = end + 1 - n - at
                spans.setdefault(i, []).append((lo - k, lo + m + k))
        out = []
        for i, found in spans.items():
            item_id, item, k, masks = self.items[i]
            best = None
            found.sort()
            lo, hi = found[0]
            for a, b in [*found[1:], (None, None)]:
                if a is not None and a <= hi:        # hits whose surroundings overlap are verified together
                    hi = max(hi, b)
                    continue
                lo = max(0, lo)
                hit = myers(item, masks, text[lo:max(lo, hi)], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1])
                lo, hi = a, b
            if best:
                out.append((item_id, *best))
        return out


def item_passes(items: DataFrame, id_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in passes of at most ``pass_bytes`` of text; read by a local iterator, so the driver holds one
    pass at a time and any number of items is searched for."""
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        text = normal(r.t)
        if not text:
            continue
        if held and size + 4 * len(text) > pass_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, text))
        size += 4 * len(text)
    if held:
        yield held


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
                  pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, match_end) for each document and each item that it contains with at most
    ``rate`` edits per item character. ``match_end``: where the best match ends in the normalised text.

    Null, empty and blank texts and items match nothing. Repeated rows each give their matches; an item
    whose text is repeated matches under each id. Empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, match_end long"
    out = None
    for part in item_passes(items, item_id_col, item_text_col, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(part)        # at most pass_bytes

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for m in matcher.search(normal(t))]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                         pa.array(cols[3], pa.int64())], names=["doc_id", "item_id", "edits", "match_end"])

        found = texts.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def op3_edit_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go, each row by its own text (also rows without an id)."""
    rows = docs.select(row_key(docs).alias("doc_id"), "text")
    return without_rows(docs, contamination(rows, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
