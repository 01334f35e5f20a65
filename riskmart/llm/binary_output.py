"""Token-ID / binary output (4): fixed-width bit packing with block offsets.

Each id takes the fewest bits that hold the vocabulary. A file is a run of blocks; a block holds whole
documents in ascending doc_id order:

    bytes 0-3   magic "TOKB"            byte 4      bits per id
    bytes 8-15  documents in the block  16-23       ids in the block
    24-31       ids of the file before this block
    then        (documents + 1) uint64 offsets of the documents, in ids from the block's start
    then        ids, 64 to a group of ``bits`` uint64 words (little-endian, low bits first)

64 ids always fill ``bits`` whole words, so any run of ids can be unpacked by numpy from the groups that
hold it, without touching the rest (``unpack(..., lo, hi)``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import scratch, table
from riskmart.llm.wordtokens import END_ID, default_tokenizer, encoder

MAGIC = b"TOKB"
HEADER = struct.Struct("<4sB3xQQQ")
#: A block is closed by the document that brings it to this many ids.
BLOCK_IDS = 1 << 18


def bits_for(vocab: int) -> int:
    """Fewest bits for ids 0 .. vocab - 1."""
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as groups of 64 in ``bits`` uint64 words each; the last group is filled up with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, dtype=np.uint64)
    lanes[:len(ids)] = ids
    lanes = lanes.reshape(groups, 64)
    out = np.zeros((groups, bits), dtype=np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, bits: int, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` (exclusive) of packed data, as uint32."""
    if hi <= lo:
        return np.zeros(0, dtype=np.uint32)
    first, last = lo // 64, -(-hi // 64)
    rows = np.frombuffer(data, dtype="<u8", count=(last - first) * bits, offset=first * bits * 8).reshape(-1, bits)
    out = np.empty((last - first, 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        v = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = v & mask
    return out.reshape(-1)[lo - first * 64:hi - first * 64]


def write_block(ids: list[np.ndarray], before: int, bits: int) -> bytes:
    offsets = np.zeros(len(ids) + 1, dtype="<u8")
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return (HEADER.pack(MAGIC, bits, len(ids), int(offsets[-1]), before) + offsets.tobytes()
            + pack(np.concatenate(ids) if ids else np.zeros(0, np.uint16), bits))


class Block:
    """Random access to the documents of one block."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n_docs, self.n_ids, self.before = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.offsets = np.frombuffer(data, dtype="<u8", count=self.n_docs + 1, offset=HEADER.size)
        self.body = memoryview(data)[HEADER.size + 8 * (self.n_docs + 1):]

    def document(self, k: int) -> np.ndarray:
        return unpack(self.body, self.bits, int(self.offsets[k]), int(self.offsets[k + 1]))

    def all(self) -> np.ndarray:
        return unpack(self.body, self.bits, 0, self.n_ids)


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> str:
    """Tokenise every whole text, append ``end_id`` and write block files in ascending id order to ``path``.

    One range partition makes one file (column ``file`` numbers them in order); its rows are the blocks,
    with the doc ids they hold. A null text has only the end id. Rows with a null id come first, repeated
    ids stand beside each other. An empty table gives a folder without blocks.
    """
    tokenizer = tokenizer or default_tokenizer()
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        bits, end = bits_for(max(enc.vocab, end_id + 1)), np.array([end_id], enc.dtype).tobytes()
        part, ids, held, size, before = TaskContext.get().partitionId(), [], [], 0, 0
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids.append(np.frombuffer(raw + end, dtype=enc.dtype))
                held.append(key)
                size += len(ids[-1])
                if size >= BLOCK_IDS:
                    yield block_row(part, held, write_block(ids, before, bits))
                    before, ids, held, size = before + size, [], [], 0
        if ids:
            yield block_row(part, held, write_block(ids, before, bits))

    def block_row(part: int, held: list, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([held], pa.list_(pa.int64())), pa.array([data], pa.binary())],
            names=["file", "doc_ids", "block"])

    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
         .repartitionByRange(n, "id").sortWithinPartitions("id", "text")
         .mapInArrow(blocks, "file long, doc_ids array<long>, block binary")
         .write.parquet(path))
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (unsigned, over the ids as little-endian uint32), unpacked from the blocks."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, held, data in zip(*(c.to_pylist() for c in b.columns)):
                block = Block(data)
                raw = memoryview(block.all().astype("<u4").tobytes())
                at = block.offsets.astype(np.int64)
                crc = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(held), pa.int64()), pa.array(held, pa.int64()),
                     pa.array(block.before + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "in_file", "n_tokens", "ids_crc32"])

    files = spark.read.schema("file long, doc_ids array<long>, block binary").parquet(path)
    docs = files.mapInArrow(documents, "file long, doc_id long, in_file long, n_tokens long, ids_crc32 long")
    # ids before each file: one row per file, from the headers only
    header = files.select("file", (_uint64(25) + _uint64(17)).alias("upto")).groupBy("file").agg(F.max("upto").alias("ids"))
    before = header.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))
    return (docs.join(before, "file")
                .select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"))


def _uint64(at: int):
    """Little-endian integer at a (1-based) byte of the block header."""
    parts = ", ".join(f"hex(substring(block, {at + k}, 1))" for k in range(7, -1, -1))
    return F.expr(f"conv(concat({parts}), 16, 10)").cast("long")


def op4_bitpacked_ids(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents encoded, written in the block format and read back."""
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "op4")))
