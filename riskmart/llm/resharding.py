"""Sharding (2): minimum-cost-flow resharding.

From the bytes in the old shards and the capacities of the new ones a transport problem is solved (keeping a
byte costs 0, moving it 1, or any cost table): successive shortest paths over shards. Its flows are
made up of whole blocks. A block is all documents of an old shard with one text-hash bucket, so equal texts move
together; the number of blocks is fixed by ``BUCKETS``, whatever the input. A block larger than
``BIG`` of a capacity is placed on its own first, and one that no shard can hold is cut by document. Then the
texts of the affected shards are rewritten, one folder per shard.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import scratch, table

#: Text-hash buckets of one old shard; cells (parts by document hash) of one block.
BUCKETS, CELLS = 1024, 8
#: Share of a new shard's capacity from which a block is placed on its own.
BIG = 1 / 256


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at least total cost: successive shortest paths (Bellman-Ford)
    over the bipartite residual graph. The capacities must hold the supply."""
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(capacity)
    n, m = len(supply), len(capacity)
    while any(left):
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        prev: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost(i, j) < dist[n + j]):
                        dist[n + j], prev[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow[i, j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost(i, j) < dist[i]):
                        dist[i], prev[i], changed = dist[n + j] - cost(i, j), n + j, True
        ends = [j for j in range(m) if room[j] and dist[n + j] is not None]
        if not ends:
            raise ValueError("the new shards can't hold the old ones")
        end = min(ends, key=lambda j: (dist[n + j], j))
        path, node = [], n + end
        while prev[node] is not None:
            path.append((prev[node], node))
            node = prev[node]
        amount = min([left[node], room[end], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[node] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


@dataclass
class Plan:
    shards: dict[tuple[int, int, int], int]     # (old shard, bucket, cell) -> new shard
    moved: int
    flows: dict[tuple[int, int], int]


def plan_moves(blocks: dict[tuple[int, int, int], int], n_old: int, capacity: list[int], cost) -> Plan:
    """Whole cells to new shards. ``blocks``: bytes by (old shard, bucket, cell); cells of a block stay
    together unless the block is larger than every capacity."""
    whole: dict[tuple[int, int], int] = defaultdict(int)
    for (s, b, _), size in blocks.items():
        whole[s, b] += size
    cells = defaultdict(list)
    for k in sorted(blocks):
        cells[k[0], k[1]].append(k)
    units = []                                   # (bytes, old shard, cells)
    for (s, b), size in sorted(whole.items()):
        if size > max(capacity):
            units += [(blocks[k], s, [k]) for k in cells[s, b]]
        else:
            units.append((size, s, cells[s, b]))
    room, shards, moved = list(capacity), {}, 0

    def put(unit, j: int) -> None:
        nonlocal moved
        room[j] -= unit[0]
        moved += unit[0] * (cost(unit[1], j) != 0)
        shards.update((k, j) for k in unit[2])

    least = BIG * max(capacity)
    big = sorted((u for u in units if u[0] > least), key=lambda u: (-u[0], u[1:]))
    for u in big:                                # at home if there is room, else where there is most
        fits = [j for j in range(len(room)) if room[j] >= u[0]] or list(range(len(room)))
        put(u, min(fits, key=lambda j: (cost(u[1], j), -room[j], j)))
    small = defaultdict(list)
    for u in units:
        if u[0] <= least:
            small[u[1]].append(u)
    supply = [sum(u[0] for u in small[s]) for s in range(n_old)]
    free = [max(0, r) for r in room]
    short = sum(supply) - sum(free)
    free = [f + -(-max(0, short) // len(free)) for f in free]
    flows = min_cost_flow(supply, free, cost)
    for s in range(n_old):                       # cut each old shard's blocks at its flows; cheapest target first
        targets = sorted((j for i, j in flows if i == s), key=lambda j: (cost(s, j), j))
        queue = [(j, flows[s, j]) for j in targets]
        for u in small[s]:
            while len(queue) > 1 and queue[0][1] <= u[0] / 2:
                rest = queue.pop(0)[1]           # what is missing or too much goes on to the next target
                queue[0] = (queue[0][0], queue[0][1] + rest)
            j, want = queue[0]
            put(u, j)
            queue[0] = (j, want - u[0])
    return Plan(shards, moved, flows)


def sized(docs: DataFrame, old_shard, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, size (UTF-8 bytes + 1; null texts 1), old shard, bucket and cell of every document."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), old_shard.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(CELLS)).cast("int").alias("cell"))


def reshard(docs: DataFrame, old_shard, n_old: int, n_new: int, out_dir: str, *, id_col: str = "doc_id",
            text_col: str = "text", cost=None) -> Plan:
    """Write all documents to ``out_dir``, one folder ``new_shard=j`` per shard of near equal bytes, moving the
    fewest bytes out of the old shards (column expression ``old_shard``, 0 .. n_old - 1).

    Rows hold doc_id, text, size, old_shard and slot (gapless from 0 in the shard). Null texts count 1 byte;
    rows with null or repeated ids are placed like any other; an empty table writes no rows. Shards that
    no block enters or leaves still get their slots; with ``n_old == n_new`` their rows are simply equal to the old ones.
    """
    cost = cost or (lambda i, j: int(i != j))
    rows = sized(docs, old_shard, id_col, text_col)
    # the result has at most n_old * BUCKETS * CELLS rows, whatever the input
    found = rows.groupBy("old_shard", "bucket", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    blocks = {(r.old_shard, r.bucket, r.cell): r.size for r in found}
    total = sum(blocks.values())
    plan = plan_moves(blocks, n_old, [-(-total // n_new)] * n_new, cost)
    first, at = {}, defaultdict(int)
    n = {(r.old_shard, r.bucket, r.cell): r.n for r in found}
    for k in sorted(n):
        first[k] = at[plan.shards[k]]
        at[plan.shards[k]] += n[k]
    spark = docs.sparkSession
    cells = spark.createDataFrame([(*k, plan.shards[k], first[k]) for k in sorted(n)],
                                  "old_shard int, bucket int, cell int, new_shard int, first long")
    order = Window.partitionBy("old_shard", "bucket", "cell").orderBy("doc_id", F.crc32("text"))
    slots = (rows.join(F.broadcast(cells), ["old_shard", "bucket", "cell"])
             .withColumn("slot", F.col("first") + F.row_number().over(order) - 1))
    slots.select("doc_id", "text", "size", "old_shard", "slot", "new_shard").write.partitionBy("new_shard").parquet(out_dir)
    return plan


def read_shards(spark, out_dir: str) -> DataFrame:
    return spark.read.schema("doc_id long, text string, size long, old_shard int, slot long, new_shard int").parquet(out_dir)


def op2_flow_resharding(spark, sf_dir: str) -> DataFrame:
    """From 12 shards by text hash to 16 of near equal bytes."""
    path = scratch(spark, "op2")
    old = F.pmod(F.crc32(F.coalesce(F.col("text"), F.lit(""))), F.lit(12))
    reshard(table(spark, sf_dir, "documents"), old, 12, 16, path)
    return read_shards(spark, path).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("new_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
