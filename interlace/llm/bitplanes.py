"""Token ids in a binary format with shuffled planes.

Ids are cut into blocks of fixed size. A block is transposed into its 32 bit planes or 4 byte planes, each plane is
compressed with zstandard, and the table of blocks is the chunk index: for each block its place in the stream and the
documents that begin in it. Shards are ranges of documents; Spark writes and reads the blocks as rows of Parquet files,
so a lost task is written again and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WIDE_ROWS, arrow_limits, materialise, table
from .encode import worker_encoder

#: Ids in a block; the last block of a shard may have fewer.
BLOCK_IDS = 1 << 16
END_ID = 0
#: A row for each block. first_doc, doc_starts and doc_lengths: the documents that begin in the block, in their order.
FORMAT = "shard int, block int, n_ids int, mode string, planes array<binary>, doc_keys array<long>, doc_starts array<long>, doc_lengths array<long>"


def pack(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """The compressed planes of a block of ids, lowest plane first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    elif mode == "byte":
        planes = [raw[:, i].tobytes() for i in range(4)]
    else:
        raise ValueError(f"mode {mode!r} is neither bit nor byte")
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(p) for p in planes]


def unpack(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    """The ids of a block; ValueError if a plane has another size than the block needs."""
    width = n if mode == "byte" else (n + 7) // 8
    expand = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(expand.decompress(p, max_output_size=max(1, width)), np.uint8) for p in planes]
    if any(len(r) != width for r in rows) or len(rows) != (4 if mode == "byte" else 32):
        raise ValueError("a plane is damaged")
    if mode == "bit":
        bits = np.stack([np.unpackbits(r, bitorder="little", count=n) for r in rows], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(rows, axis=1)).reshape(-1).view("<u4")


def write(docs: DataFrame, tokenizer: str, drops_space: bool = False, key: str = "doc_id", text: str = "text", mode: str = "byte", end_id: int | None = END_ID, shards: int | None = None) -> DataFrame:
    """Encode docs in ascending order of the key (null keys first, ties in order of their texts) and write the blocks.

    Returns the table of blocks as read back from the shared folder. Shards follow each other in the order of their
    numbers. A null or empty text has no ids but the end id. Repeated rows are separate documents.
    """
    spark = docs.sparkSession
    arrow_limits(spark, WIDE_ROWS)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(shards, F.asc_nulls_first("k")).sortWithinPartitions(F.asc_nulls_first("k"), "t")
    rows = rows.select(F.spark_partition_id().alias("shard"), "k", "t")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("mode", pa.string()), ("planes", pa.list_(pa.binary())), ("doc_keys", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, drops_space)
        shard, block, written = 0, 0, 0  # written: ids in earlier blocks of the shard
        waiting = bytearray()
        keys: list = []
        starts: list[int] = []
        lengths: list[int] = []

        def flush(n: int) -> pa.RecordBatch:
            nonlocal block, written, keys, starts, lengths
            ids = np.frombuffer(bytes(waiting[: 4 * n]), "<u4")
            del waiting[: 4 * n]
            own = sum(s < written + n for s in starts)  # documents that begin in this block
            row = {"shard": shard, "block": block, "n_ids": n, "mode": mode, "planes": pack(ids, mode), "doc_keys": keys[:own], "doc_starts": starts[:own], "doc_lengths": lengths[:own]}
            keys, starts, lengths = keys[own:], starts[own:], lengths[own:]
            block, written = block + 1, written + n
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if len(batch) else shard
            for k, ids in zip(batch.column("k").to_pylist(), encoder.encode_array(batch.column("t"))):
                keys.append(k), starts.append(written + len(waiting) // 4), lengths.append(len(ids) + len(end) // 4)
                waiting += ids.astype("<u4").tobytes()
                waiting += end
                while len(waiting) >= 4 * BLOCK_IDS:
                    yield flush(BLOCK_IDS)
        if waiting or keys:
            yield flush(len(waiting) // 4)

    return materialise(rows.mapInArrow(run, FORMAT), "blocks")


def documents_of(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the blocks alone.

    A document inside one block is digested where the block is read. Only of those that run over a block's end the pieces
    are brought together, each document by itself.
    """
    # A row for each shard, as many as there were writing tasks.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, lo = unpack(row["planes"], row["n_ids"], row["mode"]).tobytes(), row["block"] * BLOCK_IDS
                hi = lo + row["n_ids"]
                out = []
                first = min(row["doc_starts"], default=hi)
                if first > lo:  # goes on from an earlier block; its start is known there
                    out.append({"shard": row["shard"], "k": None, "start": None, "n_tokens": None, "lo": lo, "crc": None, "piece": raw[: 4 * (first - lo)]})
                for k, s, n in zip(row["doc_keys"], row["doc_starts"], row["doc_lengths"]):
                    whole = s + n <= hi
                    part = raw[4 * (s - lo) : 4 * (min(s + n, hi) - lo)]
                    out.append({"shard": row["shard"], "k": k, "start": s, "n_tokens": n, "lo": s, "crc": zlib.crc32(part) if whole else None, "piece": None if whole else part})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int32()), ("k", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("lo", pa.int64()), ("crc", pa.int64()), ("piece", pa.binary())]))

    found = blocks.mapInArrow(pieces, "shard int, k long, start long, n_tokens long, lo long, crc long, piece binary")
    found = materialise(found, "pieces")
    done = found.filter("crc is not null").select("shard", "k", "start", "n_tokens", "crc")
    # A piece belongs to the document that runs over the block's end; its blocks follow from its start and length.
    open_ = found.filter("crc is null and start is not null")
    block = lambda c: F.expr(f"{c} div {BLOCK_IDS}")
    later = found.filter("start is null").select("shard", block("lo").alias("block"), F.col("lo").alias("at"), F.col("piece").alias("more"))
    wanted = open_.select("shard", "start", F.explode(F.sequence(block("start") + 1, block("(start + n_tokens - 1)"))).alias("block"))
    tails = wanted.join(later, ["shard", "block"]).select("shard", "start", F.struct("at", "more").alias("p"))
    heads = open_.select("shard", "start", F.struct(F.col("lo").alias("at"), F.col("piece").alias("more")).alias("p"))
    joined = heads.unionByName(tails).groupBy("shard", "start").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    joined = joined.select("shard", "start", F.crc32(F.aggregate("ps", F.lit(b""), lambda x, p: F.concat(x, p["more"]))).alias("crc"))
    rest = open_.select("shard", "k", "start", "n_tokens").join(joined, ["shard", "start"])
    rows = done.unionByName(rest.select("shard", "k", "start", "n_tokens", "crc")).join(F.broadcast(offsets), "shard")
    return rows.select(F.col("k").alias(key), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return documents_of(write(table(spark, sf_dir, "documents"), path))
