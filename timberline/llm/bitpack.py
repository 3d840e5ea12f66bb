"""Token ids in a fixed-width bit format with block offsets.

Files are Parquet tables whose rows are blocks: whole documents in ascending id
order, at least ``BLOCK_TOKENS`` ids (the last block of a file may be shorter).
``payload`` holds every id in the fewest bits that hold the vocabulary, most
significant bit first, so id ``i`` of a block starts at bit ``i * bits``.
``part`` and ``block`` order the blocks, ``first`` is the number of ids before
the block in its part, ``doc_ids`` and ``lengths`` list its documents. Parquet
only carries the rows: the job's commit protocol and any file system work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import folder, table
from timberline.llm.tokens import encoder

BLOCK_TOKENS = 65_536
TEXTS_AT_ONCE = 256

BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64()),
                    ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCKS_DDL = ("part int, block int, first bigint, tokens bigint, bits int, doc_ids array<bigint>, lengths array<bigint>, "
              "payload binary")


def width(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to ``vocabulary - 1``."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    places = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f">u{bits // 8}", count, start * bits // 8).astype("<u4")
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first))
    skip = start * bits - first * 8
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return (flat[skip:skip + count * bits].reshape(count, bits) @ weights).astype("<u4")


def _packer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits = width(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids, docs, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, ids, docs, lengths, held
            row = {"part": part, "block": block, "first": first, "tokens": held, "bits": bits, "doc_ids": docs, "lengths": lengths,
                   "payload": pack(np.frombuffer(b"".join(ids), "<u4"), bits)}
            block, first = block + 1, first + held
            ids, docs, lengths, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE).to_pydict()
                for doc, raw in zip(some["doc_id"], enc.encode(some["text"])):
                    ids += [raw, end]
                    docs.append(doc)
                    lengths.append(len(raw) // 4 + 1)
                    held += lengths[-1]
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if docs:
            yield flush()
    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> None:
    """Encode ``doc_id, text`` with the end id after each text and write the blocks to folder ``out``.

    NULL text is empty. Rows go to the files in ascending ``doc_id`` order, NULL ids first; rows with one id follow
    the hash of their text, so that a repeated id cannot fill a task unless its texts are equal too. Other columns
    are ignored. An empty table gives an empty folder of blocks.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_packer(tokenizer, end_id), BLOCKS_DDL).write.option("compression", "zstd").parquet(out)


def _unpacker(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(b["payload"], b["bits"], 0, b["tokens"])
                at = np.cumsum([0] + b["lengths"])
                parts = [ids[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
                cols = [pa.array(b["doc_ids"], pa.int64()), pa.array([b["part"]] * len(parts), pa.int32()),
                        pa.array(b["first"] + at[:-1], pa.int64()), pa.array(b["lengths"], pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = cols + [pa.array(parts, pa.binary())], names + ["ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, doc_id: int | None = None) -> DataFrame:
    """Documents read back from the blocks: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``, 32-bit little-endian).

    ``doc_id`` reads only the blocks that hold that document.
    """
    blocks = spark.read.schema(BLOCKS_DDL).parquet(path)
    per_part = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per file
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    if doc_id is not None:
        blocks = blocks.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    ddl = "doc_id bigint, part int, in_part bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    docs = blocks.mapInArrow(_unpacker(with_ids), ddl)
    if doc_id is not None:
        docs = docs.where(F.col("doc_id") == doc_id)
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32",
                                            *(["ids"] if with_ids else []))


def op3_bit_packed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All ``documents`` as byte-level BPE ids with end id 2, written as packed blocks and read back."""
    import public_tokenizers
    out = folder(spark, "bit-packed")
    write_tokens(table(spark, sf, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, out)
