"""Resampling by importance towards a target distribution.

Documents and target texts are bags of hashed features (runs of one to three words). A bucket's gain is the logarithm of
how much likelier it is in the target than in the corpus; a document's weight is the sum of the gains of its features, and
weight plus Gumbel noise is its score, so that the highest scores are a draw without replacement in proportion to the
weights. The k highest are found by a distributed quickselect: random keys divide the candidates, the rows before, at and
after each are counted exactly, and only the interval that holds the k-th key goes on. Only the winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WIDE_ROWS, arrow_limits, delete_table, materialise, released, table
from .words import LOWER, bytes_of, groups

#: Buckets of features, and words of the longest run.
BUCKETS, RUN = 10_000, 3
#: Words that a document needs to be drawn, the share drawn in hundredths, and the seed of the noise.
LEAST_WORDS, SHARE, SEED = 20, 5, 42
#: Keys by which the candidates of a round of the selection are divided, on average.
PIVOTS = 24

#: Bytes inside words: digits, letters, and all of characters beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
#: The checksum's own table: what a byte of zero makes of each value of the lowest byte.
STEP = np.array([reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)], np.uint32)


def _zeros(tables: np.ndarray) -> np.ndarray:
    """The tables (4, 256) of a checksum shifted by one more zero byte."""
    return tables >> np.uint32(8) ^ STEP[tables & np.uint32(255)]


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksums shifted by the number of zero bytes that the tables stand for; the shift is linear in each byte."""
    return reduce(np.bitwise_xor, (tables[i][crc >> np.uint32(8 * i) & np.uint32(255)] for i in range(4)))


#: Tables of shifts by 0 to 63 bytes; longer ones are put together from doubled shifts.
SHIFTS = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
while len(SHIFTS) < 64:
    SHIFTS.append(_zeros(SHIFTS[-1]))
SHIFTS = np.stack(SHIFTS)


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums as they count in front of `sizes` further bytes: crc(a + b) is shifted(crc(a), len(b)) ^ crc(b)."""
    low = sizes & 63
    out = reduce(np.bitwise_xor, (SHIFTS[low, i, crc >> np.uint32(8 * i) & np.uint32(255)] for i in range(4)))
    rest, tables = sizes >> 6, None
    while rest.any():
        tables = _zeros(SHIFTS[63]) if tables is None else _apply(tables, tables)
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(tables, out[odd])
        rest = rest >> 1
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums with one more space at the end."""
    state = ~crc
    return ~(state >> np.uint32(8) ^ STEP[(state ^ np.uint32(32)) & np.uint32(255)])


def feature_buckets(texts: pa.StringArray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts (none null), the text of each, and the words of each text.

    The checksum of each distinct word is taken once; those of runs follow from it by array operations.
    """
    data, begins = bytes_of(texts)
    data = LOWER[data]
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = begins[:-1][begins[:-1] < len(data)]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    n_words = np.diff(np.searchsorted(at, begins))
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), n_words
    starts = np.append(np.flatnonzero(first[inside]), inside.sum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(data[inside])]).dictionary_encode()
    which = words.indices.to_numpy()
    own = np.fromiter(map(zlib.crc32, words.dictionary.to_pylist()), np.uint32, len(words.dictionary))[which]
    sizes, of = np.diff(starts), np.repeat(np.arange(len(texts)), n_words)
    found, places, runs = [own], [of], own
    for n in range(1, RUN):  # runs[i] ends n words after word i
        runs = shifted(_spaced(runs[: len(own) - n]), sizes[n:]) ^ own[n:]
        same = of[n:] == of[: len(of) - n]
        found.append(runs[same])
        places.append(of[n:][same])
    return np.concatenate(found).astype(np.int64) % buckets, np.concatenate(places), n_words


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: an array of `buckets` numbers, summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in groups(batch.column(0)):
                total += np.bincount(feature_buckets(texts, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    arrow_limits(docs.sparkSession, WIDE_ROWS)
    sums = docs.select(text).mapInArrow(released(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # a row for each bucket at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets, in doubles."""
    s, t, b = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) for every row of docs; the gains go to the tasks as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for texts in groups(batch.column(1)):
                found, of, n_words = feature_buckets(texts, len(gain))
                sums = np.bincount(of, gain[found], len(texts)).astype(np.int64)  # doubles hold such sums exactly
                parts.append((n_words, np.bincount(of, minlength=len(texts)), sums))
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_words", "n_features", "weight"])

    arrow_limits(docs.sparkSession, WIDE_ROWS)
    return docs.select(F.col(key).cast("long"), text).mapInArrow(released(run), f"{key} long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by seed and key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(candidates: DataFrame, k: int, total: int, name: str = "place", pivots: int = PIVOTS):
    """The k-th smallest (from 1) of the `total` values in column `name`, which are all different; None unless 1 <= k <= total.

    Each round takes about `pivots` random values and counts, in one pass, the candidates at and between them. The interval
    with the k-th is written as the next candidates, so that all rounds together read little more than the first. A round
    whose candidates are no more than the pivots takes them all and ends.
    """
    if not 1 <= k <= total:
        return None
    value, round_ = F.col(name), 0
    written = None
    while True:
        chance = pivots / total
        drawn = candidates.select(name) if chance >= 1 else candidates.select(name).filter(F.pmod(F.xxhash64(value, F.lit(round_)), F.lit(1 << 40)) < int(chance * (1 << 40)))
        keys = sorted(r[0] for r in drawn.collect())
        round_ += 1
        if not keys:
            continue  # no value was drawn; the next round draws others
        known = [F.struct(*[F.lit(x).alias(f) for f, x in key.asDict().items()]) if hasattr(key, "asDict") else F.lit(key) for key in keys]
        after = reduce(lambda a, b: a + b, [(value >= x).cast("int") for x in known])
        equal = reduce(lambda a, b: a | b, [value == x for x in known])
        parts = {(r.after, r.equal): r.n for r in candidates.groupBy(after.alias("after"), equal.alias("equal")).agg(F.count("*").alias("n")).collect()}
        before = 0
        for i in range(len(keys) + 1):  # the i-th key itself, then what lies between it and the next
            own = 1 if i else 0
            if own and k == before + 1:
                if written is not None:
                    delete_table(written)
                return keys[i - 1]
            between = parts.get((i, False), 0)
            if k <= before + own + between:
                break
            before += own + between
        k, total = k - before - own, between
        left = candidates.filter((after == i) & ~equal).select(name)
        candidates = materialise(left, "candidates")
        if written is not None:
            delete_table(written)
        written = candidates


def ranked(winners: DataFrame, place: str = "place") -> DataFrame:
    """winners with column rank: 1, 2, 3... in order of `place`. Sorted by ranges; only the sizes of the ranges meet."""
    spark = winners.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(winners.repartitionByRange(parts, place).withColumn("part", F.spark_partition_id()), "winners")
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(place))
    return rows.join(offsets, "part").withColumn("rank", F.col("before") + inside).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for every row of docs; rank is null for rows that are not drawn.

    Of the rows with least_words or more, share hundredths are drawn, rounded down: those with the highest scores, and among
    equal scores those with the smaller keys (null keys last). Rows with equal scores and keys are told apart by their
    places in the table of scores, so exactly so many are drawn, and all ranks differ. Null texts have no words; without any
    target text or document the gains follow from the empty counts. docs and target may have any other columns.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    rows = weighted(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    place = F.struct((-F.col("score")).alias("falling"), F.col(key).isNull().alias("unknown"), F.coalesce(key, F.lit(0)).alias("k"), F.monotonically_increasing_id().alias("row"))
    scored = materialise(rows.withColumn("place", place), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    total = able.count()
    last = kth_key(able.select("place"), share * total // 100, total)
    if last is None:
        return scored.drop("place").withColumn("rank", F.lit(None).cast("long"))
    limit = F.struct(*[F.lit(x).alias(f) for f, x in last.asDict().items()])
    drawn = (F.col("n_words") >= least_words) & (F.col("place") <= limit)
    winners = ranked(scored.filter(drawn)).drop("place")
    return scored.filter(~drawn).drop("place").withColumn("rank", F.lit(None).cast("long")).unionByName(winners)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
