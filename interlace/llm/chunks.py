"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; boundaries are normalised: a strict mask before the normal chunk size, a loose
one after it, a minimum and a maximum. The fingerprint is the set of chunk digests with the chunk lengths as weights; an
insertion moves bytes but leaves the chunks away from it alone. Likeness is length-weighted containment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, table

#: Chunk sizes in bytes, and how many bits more or fewer than the normal size's the two masks have.
MIN_SIZE, NORMAL_SIZE, MAX_SIZE, NORMALISATION = 16, 48, 192, 2
#: Bytes of a chunk's digest that the fingerprint keeps, and bytes of its length.
DIGEST_BYTES, LENGTH_BYTES = 6, 1
#: The gear table follows from a rule: the first four bytes of the MD5 of the byte's number.
GEAR = np.array([int.from_bytes(hashlib.md5(str(i).encode()).digest()[:4], "little") for i in range(256)], dtype=np.uint32)
_BITS = NORMAL_SIZE.bit_length() - 1
STRICT = np.uint32((1 << (_BITS + NORMALISATION)) - 1 << (32 - _BITS - NORMALISATION))
LOOSE = np.uint32((1 << (_BITS - NORMALISATION)) - 1 << (32 - _BITS + NORMALISATION))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the 32 bytes that end there: the sum of GEAR[b] << age, by doubling the window."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def boundaries(raw: bytes) -> list[int]:
    """The ends of the chunks of raw, the last at its length."""
    n = len(raw)
    if n <= MIN_SIZE:
        return [n] if n else []
    h = gear_hash(np.frombuffer(raw, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    ends, start = [], 0
    for at, hard in zip((loose + 1).tolist(), strict):
        while at - start > MAX_SIZE:
            start += MAX_SIZE
            ends.append(start)
        if at - start >= NORMAL_SIZE or hard and at - start >= MIN_SIZE:
            ends.append(at)
            start = at
    while n - start > MAX_SIZE:
        start += MAX_SIZE
        ends.append(start)
    return ends if start == n else [*ends, n]


def fingerprint(text: str) -> dict[bytes, int]:
    """Chunk digest to weight in bytes; chunks that occur again in the text add to the weight."""
    raw = text.encode("utf-8", "surrogatepass")
    out: dict[bytes, int] = {}
    start = 0
    for end in boundaries(raw):
        digest = xxhash.xxh3_64_digest(raw[start:end])[:DIGEST_BYTES]
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Shared weight over the weight of the smaller fingerprint; two empty fingerprints are alike, one empty is like nothing."""
    total = min(sum(a.values()), sum(b.values()))
    if not total:
        return 1.0 if not a and not b else 0.0
    if len(b) < len(a):
        a, b = b, a
    return sum(min(w, b.get(d, 0)) for d, w in a.items()) / total


def to_string(print_: dict[bytes, int]) -> str:
    """Base64 of the sorted digests, each with its weight as a variable-length number."""
    out = bytearray()
    for digest, weight in sorted(print_.items()):
        out += digest
        while weight > 127:
            out.append(weight & 127 | 128)
            weight >>= 7
        out.append(weight)
    return base64.b64encode(bytes(out)).decode()


def from_string(text: str) -> dict[bytes, int]:
    raw, at, out = base64.b64decode(text), 0, {}
    while at < len(raw):
        digest, at, weight, shift = raw[at : at + DIGEST_BYTES], at + DIGEST_BYTES, 0, 0
        while raw[at] & 128:
            weight, shift, at = weight | (raw[at] & 127) << shift, shift + 7, at + 1
        out[digest] = weight | raw[at] << shift
        at += 1
    return out


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as many first code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


class Cuts:
    """Where the buckets of the keys begin. Buckets are numbered in ascending order of (key, tie), null keys lowest.

    A key that many of the quantiles name has that many buckets, among which its rows are dealt by ranges of `tie`; so
    have the null keys, by their share of the rows.
    """

    def __init__(self, quantiles: list[int], nulls: int, rows: int, buckets: int) -> None:
        self.keys, self.times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.null_buckets = -(-nulls * buckets // max(1, rows))
        self.first = np.r_[0, np.cumsum(self.times)] + self.null_buckets
        self.ties = bool(nulls) or bool((self.times > 1).any())

    def number(self, null: np.ndarray, k: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The bucket of each row; keys that are null have any number as k."""
        share = (ties >> 32) + (1 << 31)  # the upper half as a number from 0 to 2^32 - 1
        at = np.searchsorted(self.keys, k)
        times = np.append(self.times, 1)[at]
        here = np.append(self.keys, 0)[at] == k
        here[at == len(self.keys)] = False
        out = self.first[at] + np.where(here, share * times >> 32, 0)
        return np.where(null, share * self.null_buckets >> 32, out).astype(np.int32)


def in_buckets(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(bucket, head, k, tie, t): rows by ranges of the key, each range followed by a copy of the first row of the next.

    Ranges come from approximate quantiles of the key alone. In descending order the row after the last of a range is the
    first of the next range below, and after the smallest key comes the largest. Only those first rows, one for each
    range, are copied; the text is shuffled once. The driver sees one key for each range.
    """
    keys = docs.select(F.col(key).cast("long").alias("k"))
    at = [i / buckets for i in range(1, buckets)] or [0.5]
    seen = keys.agg(F.percentile_approx("k", at, 100 * buckets).alias("q"), F.count_if(F.col("k").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    cuts = Cuts(seen.q or [], seen.nulls, seen.n, buckets)
    tie = F.xxhash64(F.coalesce(text, F.lit(""))) if cuts.ties else F.lit(0).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("k"), tie.alias("tie"), F.coalesce(text, F.lit("")).alias("t"))
    place = (F.col("k").isNull(), F.coalesce("k", F.lit(0)), F.col("tie"))  # no nulls: pandas would make them floats

    @F.pandas_udf("int")
    def number(null: pd.Series, k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(cuts.number(null.to_numpy(bool), k.to_numpy(np.int64), tie.to_numpy(np.int64)))

    # One row for each range that has rows: its largest key, at which the range begins, for keys run downwards.
    largest = F.max(F.struct((~place[0]).alias("some"), place[1].alias("k"), "tie")).alias("top")
    tops = sorted((r.bucket, *r.top) for r in rows.select("k", "tie", number(*place).alias("bucket")).groupBy("bucket").agg(largest).collect())
    above = {(not some, k, tie): tops[(i + 1) % len(tops)][0] for i, (_, some, k, tie) in enumerate(tops)}

    @F.pandas_udf("int")
    def copied_to(null: pd.Series, k: pd.Series, tie: pd.Series) -> pd.Series:
        """The bucket above, for rows with which a bucket begins."""
        return pd.Series(map(above.get, zip(null.tolist(), k.tolist(), tie.tolist())), dtype="Int32")

    rows = rows.withColumn("bucket", number(*place)).withColumn("to", copied_to(*place))
    own = F.struct("bucket", F.lit(False).alias("head"))
    copy = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("head"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy)))).select("place.bucket", "place.head", "k", "tie", "t")
    return rows.repartitionByRange(buckets, "bucket").sortWithinPartitions("bucket", "head", F.desc_nulls_last("k"), F.desc("tie"), "t")


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    The next document is the one with the next smaller key (null keys last), and the first after the last; a single
    document is its own next. Equal keys come in order of their texts, or of the texts' hashes if a key is null or fills
    a range by itself. Null texts count as empty.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_buckets(docs, key, text, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "head", "k", "t"]
        before = None  # (bucket, key, text, fingerprint) of the row whose next comes
        for batch in batches:
            out = []
            for number, head, k, t in zip(*(batch.column(c).to_pylist() for c in names)):
                if before is None and head:
                    continue  # further rows with the first key of the next range
                mine = fingerprint(t)
                if before is not None:
                    _, k0, t0, f0 = before
                    changed = edited(t0, t)
                    f1 = fingerprint(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append({key: k0, "n_chars": len(t0), "edited_sha256": sha, "fingerprint": to_string(f0), "edited_fingerprint": to_string(f1), "near_edited": containment(f0, f1), "near_next": containment(f0, mine)})
                before = None if head else (number, k, t, mine)
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return rows.mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
