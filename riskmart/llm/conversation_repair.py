"""Conversation structure repair (12): cheapest edits that give every conversation a legal order of roles.

The role grammar: an optional system turn, then one or more pairs of user and assistant turn; or nothing at all.
A generalised LR parser reads the turns with a graph-structured stack, whose tops are extended by every action at
once: keep (shift the turn's role), rerole (shift another one), delete, and insert (shift a role without reading a
turn). Equal stack tops are merged: the one with the least (cost, audit) stays.

Merging makes the parse associative: what a stretch of turns does is said by the least (cost, audit) from each
stack top before it to each one after it. So rows are dealt out in ranges of (conversation, turn), a long
conversation over many tasks, and parsed in stretches of at most ``STRETCH`` turns; the stretches of conversations
that lie in more than one are put together by one pass over their summaries. (Two audits of equal cost for the same
turns never extend each other, so the ASCII order of the whole follows from that of the parts.) The digest of a
repaired conversation is one running hash over its turns in their order, as its definition asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import BLANKS, stored, table

#: Costs of the edits, and of a truncated turn that stays.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Turns parsed as one stretch.
STRETCH = 4096
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}

# LR tables: states 0 start, 1 system, 2 user, 3 user assistant, 4 pairs; a pair and the list of pairs are reduced
# to state 4, above the start or the system turn.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 4: {"u": 2}}
TOPS, ACCEPT = (0, 1, 2, 4), (0, 4)
#: Any stack with that top will do: what may follow depends on the top alone.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 4: (0, 4)}


@lru_cache(maxsize=256)
def shift(stack: tuple[int, ...], role: str) -> tuple[int, ...] | None:
    """The stack after a role and the reductions that follow, or None if it isn't legal there."""
    to = SHIFT[stack[-1]].get(role)
    if to is None:
        return None
    stack = (*stack, to)
    if to == 3:                                   # pair -> user assistant; pairs -> pairs pair | pair
        stack = stack[:-2]
        stack = stack if stack[-1] == 4 else (*stack, 4)
    return stack


def _offer(tops: dict, stack: tuple[int, ...], cost: int, audit: str) -> bool:
    old = tops.get(stack[-1])
    if old is None or (cost, audit) < (old[0], old[1]):
        tops[stack[-1]] = (cost, audit, stack)
        return True
    return False


def _inserted(tops: dict) -> dict:
    """The stack tops together with those that insertions lead to."""
    work = list(tops)
    while work:
        cost, audit, stack = tops[work.pop()]
        for role in NAMES:
            after = shift(stack, role)
            if after and _offer(tops, after, cost + INSERT, audit + "I"):
                work.append(after[-1])
    return tops


def _read(tops: dict, initial: str, fault: str) -> dict:
    """The stack tops after a turn."""
    out: dict = {}
    for cost, audit, stack in tops.values():
        _offer(out, stack, cost + DELETE, audit + "D")
        if fault in ("blank", "duplicate"):
            continue
        more = TRUNCATED if fault == "truncated" else 0
        after = shift(stack, initial) if initial else None
        if after:
            _offer(out, after, cost + more, audit + "K")
        for role in NAMES:
            after = shift(stack, role)
            if after:
                _offer(out, after, cost + more + REROLE, audit + "R")
    return _inserted(out)


def parse(turns: list[tuple[str, str]], entry: int = 0) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) to each stack top for turns (initial, fault), from the top ``entry``."""
    tops = _inserted({entry: (0, "", STACKS[entry])})
    for initial, fault in turns:
        tops = _read(tops, initial, fault)
    return {top: (cost, audit) for top, (cost, audit, _) in tops.items()}


class _Writer:
    """Applies an audit to turns as they come and hashes the repaired ones."""

    def __init__(self, audit: str):
        self.audit, self.at, self.kept, self.hash = audit, 0, 0, hashlib.sha256()
        self.last = ""

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
        self.kept, self.last = self.kept + 1, role[:1]

    def _next(self) -> str:
        return "a" if self.last == "u" else "u"

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._put(NAMES[self._next()], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self._put(role if edit == "K" else NAMES[self._next()], text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _digest(turns: list, audit: str) -> str:
    w = _Writer(audit)
    for _, role, text, _ in turns:
        w.turn(role, text)
    return w.digest()


def _summary(turns: list) -> dict:
    """Counts of a stretch of turns (turn, role, text, fault), and what its neighbours need of its ends."""
    first = [r[:1] for _, r, _, _ in turns]
    numbers = [t for t, _, _, _ in turns if t is not None]
    faults = [f for *_, f in turns]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])), "head": first[0], "tail": first[-1],
            "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None,
            "distinct": len(set(numbers))}


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PATH = pa.struct([("entry", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_STRETCHES = ("conv {conv}, seg long, whole boolean, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
              "low long, high long, distinct long, paths array<struct<entry: int, top: int, cost: long, audit: string>>, sha string")


def _batch(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = {"conv": conv, "seg": long, "whole": pa.bool_(), **dict.fromkeys(_COUNTS, long), "head": text, "tail": text, "low": long,
             "high": long, "distinct": long, "paths": pa.list_(_PATH), "sha": text}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order -> one row per stretch. Conversations that lie wholly inside are done here."""
    from pyspark import TaskContext

    base, done, out = TaskContext.get().partitionId() << 32, 0, []
    conv, turns, opened, kind = None, [], True, None      # opened: what came before may belong to it

    def end(open_before: bool, open_after: bool) -> dict:
        row = {"conv": conv, "seg": base + done, "whole": not (open_before or open_after), **_summary(turns), "sha": None}
        read = [(r[:1], f) for _, r, _, f in turns]
        if row["whole"]:
            tops = parse(read)
            cost, audit = min(tops[t] for t in ACCEPT if t in tops)
            return row | {"paths": [{"entry": 0, "top": 0, "cost": cost, "audit": audit}], "sha": _digest(turns, audit)}
        return row | {"paths": [{"entry": e, "top": t, "cost": c, "audit": a} for e in TOPS for t, (c, a) in parse(read, e).items()]}

    for b in batches:
        kind = b.schema.field(0).type
        for c, *turn in zip(*(col.to_pylist() for col in b.columns)):
            if turns and (c != conv or len(turns) >= STRETCH):
                same = c == conv
                out.append(end(opened, same))
                done, opened, turns = done + 1, same, []
            conv = c
            turns.append(turn)
        if len(out) >= 1000:
            yield _batch(out, kind)
            out = []
    if turns:
        out.append(end(opened, True))
    if out:
        yield _batch(out, kind)


def _less(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether the concatenation of ``a`` is less than that of ``b``."""
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return "".join(a[k:]) < "".join(b[k:])


def compose(before: dict, paths: list[dict]) -> dict:
    """Stack tops {top: (cost, pieces of the audit)} after one more stretch."""
    out: dict = {}
    for p in paths:
        if p["entry"] in before:
            cost, pieces = before[p["entry"]]
            cost, pieces = cost + p["cost"], (*pieces, p["audit"])
            old = out.get(p["top"])
            if old is None or cost < old[0] or cost == old[0] and _less(pieces, old[1]):
                out[p["top"]] = (cost, pieces)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order -> one row per conversation, without its digest."""
    now: dict | None = None
    tops: dict = {}

    def end() -> dict:
        cost, pieces = min(((tops[t][0], "".join(tops[t][1])) for t in ACCEPT if t in tops))
        return now | {"paths": [{"entry": 0, "top": 0, "cost": cost, "audit": pieces}]}

    for b in batches:
        kind = b.schema.field(0).type
        for r in b.to_pylist():
            if now is not None and r["conv"] == now["conv"]:
                for k in _COUNTS:
                    now[k] += r[k]
                now["illegal"] += now["tail"] + r["head"] not in LEGAL
                now["distinct"] += r["distinct"] - (now["high"] is not None and now["high"] == r["low"])
                now["low"], now["high"] = now["low"] if now["low"] is not None else r["low"], r["high"] if r["high"] is not None else now["high"]
                now["tail"] = r["tail"]
            else:
                if now is not None:
                    yield _batch([end()], kind)
                now, tops = r, {0: (0, ())}
            tops = compose(tops, r["paths"])
    if now is not None:
        yield _batch([end()], kind)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: a row with the audit, then its turns in order -> its digest."""
    conv, writer = None, None
    for b in batches:
        kind, ids, sums = b.schema.field(0).type, [], []
        for c, head, role, text in zip(*(col.to_pylist() for col in b.columns)):
            if head == 0:
                if writer is not None:
                    ids.append(conv)
                    sums.append(writer.digest())
                conv, writer = c, _Writer(text)
            else:
                writer.turn(role, text)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums)], names=["conv", "sha"])
    if writer is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([writer.digest()])], names=["conv", "sha"])


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text), stored, with ``row`` and the first ``fault``: blank, duplicate, truncated or none.

    Duplicates are those of an earlier row, by turn; of equal rows all but one are duplicates.
    """
    rows = stored(turns, "turns").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    first = (rows.groupBy("conv", "role", "key").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    end = F.expr(r"substring(rtrim(' \t\n\u000B\u000C\r', text), -1, 1)")
    fault = (F.when(~F.col("text").rlike(f"[^{BLANKS}]"), "blank")
             .when(F.col("first").isNotNull() & (F.col("first.row") != F.col("row")), "duplicate")
             .when(~end.isin(".", "!", "?"), "truncated").otherwise(""))
    return stored(rows.select("conv", "turn", "role", "text", "row", fault.alias("fault")), "faults")


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.

    Turns stand in the order of their number (nulls first), then of role and text; a null role or text is one
    blank, so such a text is a blank turn and such a role is never legal, nor is an empty one. A null conversation is
    one, too. Equal rows count each. Other columns are not looked at; no rows give no rows.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = with_faults(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                                    F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                                    F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text")))
    order = ["conv", "turn", "role", "text", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _STRETCHES.format(conv=kind)
    parts = stored(placed.select("conv", "turn", "role", "text", "fault").mapInArrow(_stretches, schema), "stretches")
    split = parts.filter("NOT whole").repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_joined, schema)
    split = stored(split, "joined-stretches")
    audits = split.select("conv", F.lit(0).alias("head"), F.lit("").alias("role"), F.col("paths")[0]["audit"].alias("text"),
                          F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("row"))
    own = rows.join(split.select(F.col("conv").alias("c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    both = audits.unionByName(own.select("conv", F.lit(1).alias("head"), "role", "text", "turn", "row"))
    sums = (both.repartition("conv").sortWithinPartitions("conv", "head", "turn", "role", "text", "row")
            .select("conv", "head", "role", "text").mapInArrow(_hashed, f"conv {kind}, sha string"))
    split = split.drop("sha").join(sums.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return (parts.filter("whole").unionByName(split)
            .select(F.col("conv").alias("conv_id"), F.coalesce(F.expr("high - low + 1 - distinct"), F.lit(0)).cast("long").alias("gaps"),
                    "blank", "duplicate", "truncated", "illegal", F.col("paths")[0]["cost"].alias("cost"),
                    F.col("paths")[0]["audit"].alias("audit"), F.col("sha").alias("repaired_sha256")))


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query's contract: by crc32 of ``conv_id:turn`` mod 20 a row goes (0), loses its text (1) or the
    text's final points (2), comes twice (3) or gets the role user (4). Nulls count as one blank."""
    blank = F.lit(" ")
    seen = {c: F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(seen["conv_id"], F.lit(":"), seen["turn"])) % 20
    return (turns.select("conv_id", "turn", kind.alias("kind"), seen["role"].alias("role"), seen["text"].alias("text"))
            .filter("kind <> 0")
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = repair(damaged(turns))
    rest = turns.select("conv_id").distinct().join(done.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    zero = F.lit(0).cast("long")
    rest = rest.select("conv_id", *[zero.alias(c) for c in ("gaps", *_COUNTS, "cost")], F.lit("").alias("audit"),
                       F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return done.unionByName(rest)
