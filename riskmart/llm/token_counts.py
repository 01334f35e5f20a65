"""Token counts (8): separator scan over flat token files without an index.

A flat file is a run of token ids in fixed-size blocks; documents end with a separator id and may span
any number of blocks. Each block is searched for the separator by numpy on its own; block totals are then
stitched with a two-level prefix scan (within groups of blocks, then over the groups of a file), so no task
ever sees more than a group of block summaries, however long a file or a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import scratch, table
from riskmart.llm.wordtokens import default_tokenizer, encoder

#: Ids in a block, and blocks in a group of the prefix scan.
BLOCK_IDS, GROUP_BLOCKS = 1 << 16, 1024
#: ``<|endoftext|>`` of the word_bpe_49k tokenizer.
SEPARATOR = 49407
FLAT = "file long, block long, ids binary"


def write_flat_files(docs: DataFrame, path: str, *, text_col: str = "text", tokenizer: str | None = None,
                     separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> str:
    """Flat token files of the texts: one per input partition, ids and separators only, cut into blocks
    of ``block_ids`` ids wherever they fall. Null and empty texts give a separator alone. Special-token
    strings inside a text are ordinary text, so the separator stands only between documents."""
    tokenizer = tokenizer or default_tokenizer()

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, literal_specials=True)
        sep, part, k, rest = np.array([separator], enc.dtype).tobytes(), TaskContext.get().partitionId(), 0, b""
        size = block_ids * enc.dtype.itemsize
        for b in batches:
            for i in range(0, b.num_rows, 512):
                raw = rest + b"".join(x + sep for x in enc.encode(b.column(0).slice(i, 512).to_pylist()))
                whole = len(raw) // size
                if whole:
                    yield rows(part, k, [raw[j * size:(j + 1) * size] for j in range(whole)])
                k, rest = k + whole, raw[whole * size:]
        if rest:
            yield rows(part, k, [rest])

    def rows(part: int, k: int, blocks: list[bytes]) -> pa.RecordBatch:
        n = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()),
                                           pa.array(blocks, pa.binary())], names=["file", "block", "ids"])

    docs.select(F.col(text_col).cast("string")).mapInArrow(flat, FLAT).write.parquet(path)
    return path


def separator_scan(blocks: DataFrame, *, separator: int = SEPARATOR, dtype: str = "<u2",
                   group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Documents of flat files given as rows (file, block, ids bytes): file, doc_no (from 0 in the file),
    start (id position in the file), n_tokens (with the separator) and ``ended`` (false for tokens after
    the last separator of a file). Blocks may be empty or null; block numbers need only be in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for raw in b.column(2).to_pylist():
                ids = np.frombuffer(raw or b"", dtype=dtype)
                at.append(np.flatnonzero(ids == separator).astype(np.int64))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()),
                                              pa.array(at, pa.list_(pa.int64()))], names=["file", "block", "n", "at"])

    found = (blocks.select("file", "block", "ids").mapInArrow(scan, "file long, block long, n long, at array<long>")
             .withColumn("grp", F.floor(F.col("block") / group_blocks)))
    before = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = (found.withColumn("base", F.coalesce(F.sum("n").over(before), zero))
             .withColumn("seps", F.coalesce(F.sum(F.size("at").cast("long")).over(before), zero))
             .withColumn("last", F.when(F.size("at") > 0, F.col("base") + F.element_at("at", -1)))
             .withColumn("prev", F.max("last").over(before)))
    upto = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = (found.groupBy("file", "grp").agg(F.sum("n").alias("gn"), F.sum(F.size("at").cast("long")).alias("gs"))
              .withColumn("gbase", F.coalesce(F.sum("gn").over(upto), zero))
              .withColumn("gseps", F.coalesce(F.sum("gs").over(upto), zero)))
    lasts = local.groupBy("file", "grp").agg(F.max("last").alias("glast"))
    groups = (groups.join(lasts, ["file", "grp"])
              .withColumn("gprev", F.max(F.col("gbase") + F.col("glast")).over(upto))
              .select("file", "grp", "gbase", "gseps", "gprev"))
    placed = local.join(groups, ["file", "grp"]).select(
        "file", (F.col("gbase") + F.col("base")).alias("base"), (F.col("gseps") + F.col("seps")).alias("seps"),
        F.coalesce(F.col("gbase") + F.col("prev"), F.col("gprev"), F.lit(-1)).alias("prev"), "n", "at")
    ended = (placed.select("file", "base", "seps", "prev", "at", F.posexplode("at").alias("i", "p"))
             .select("file", (F.col("seps") + F.col("i")).alias("doc_no"),
                     F.when(F.col("i") == 0, F.col("prev") + 1)
                      .otherwise(F.col("base") + F.expr("get(at, i - 1)") + 1).alias("start"),
                     (F.col("base") + F.col("p") + 1).alias("end")))
    tails = (placed.groupBy("file").agg(
                F.max(F.col("base") + F.col("n")).alias("end"), F.max(F.col("seps") + F.size("at")).alias("doc_no"),
                F.max(F.greatest("prev", F.when(F.size("at") > 0, F.col("base") + F.element_at("at", -1)))).alias("prev"))
             .filter(F.col("end") > F.col("prev") + 1)
             .select("file", "doc_no", (F.col("prev") + 1).alias("start"), "end", F.lit(False).alias("ended")))
    return (ended.withColumn("ended", F.lit(True)).unionByName(tails)
            .select("file", "doc_no", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended"))


def op8_separator_scan(spark, sf_dir: str) -> DataFrame:
    """All documents as flat token files; the scan finds every document's length again."""
    path = write_flat_files(table(spark, sf_dir, "documents"), scratch(spark, "op8"))
    return separator_scan(spark.read.schema(FLAT).parquet(path))
