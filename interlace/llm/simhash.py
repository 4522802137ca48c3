"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at 3 differing bits or fewer. Of two linked fingerprints, one half of 32 bits differs in
one bit at most. The anchors of a half are the words of a covering code: its first 31 bits are a Hamming code word
(covering radius 1), its last bit is free. A fingerprint has its home at the anchor nearest to its half, and is
replicated to every anchor within covering radius plus threshold (1 + 1); so a linked pair meets at the home of either.
At each anchor homes are compared with all that came, and only a spanning forest of the links leaves the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, arrow_limits, delete_table, materialise, table

BITS, MAX_BITS, SHINGLE, SEED = 64, 3, 3, 42
#: Homes that a task holds at an anchor, or the HOT_SHARE-th part of all if that is more; larger anchors are split into
#: blocks, each of which sees all visitors. BLOCK homes are compared at once.
BLOCK = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the digests."""
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(x) for x in texts], dtype=np.uint64).view(np.int64))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is home) for all anchors within distance 2 of either half of each fingerprint (uint64)."""
    rows, keys, homes = [], [], []
    position = np.arange(1, 32, dtype=np.uint64)
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        low, free = word & np.uint64(0x7FFFFFFF), word & np.uint64(0x80000000)
        syndrome = np.zeros(len(fp), np.uint64)
        for p in position:
            syndrome ^= np.where((low >> (p - np.uint64(1))) & np.uint64(1), p, np.uint64(0))
        flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        tag = np.uint64(half << 32)
        each = np.arange(len(fp))
        near = low ^ flip
        for extra, home in ((free, True), (free ^ np.uint64(0x80000000), False)):
            rows.append(each), keys.append(tag | near | extra), homes.append(np.full(len(fp), home))
        for p in position:  # code words at distance 2: flip p and p ^ syndrome, each pair once
            other = p ^ syndrome
            at = np.flatnonzero((syndrome > 0) & (other > p))
            rows.append(at), homes.append(np.zeros(len(at), bool))
            keys.append(tag | free[at] | (low[at] ^ (np.uint64(1) << (p - np.uint64(1))) ^ (np.uint64(1) << (other[at] - np.uint64(1)))))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        rows, keys, homes = anchors(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(homes)], ["anchor", "fp", "home"])


class Links:
    """Union-find over the fingerprints of one group that hands out each link that joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each (anchor, block); rows come sorted by it, homes first, so only a block's homes are held."""
    now, homes, links = None, np.empty(0, np.uint64), Links()
    for batch in batches:
        key = np.stack([batch.column("anchor").to_numpy(), batch.column("block").to_numpy()], axis=1)
        fp, home = batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        stops = np.r_[cut[1:], len(fp)]
        found: list[tuple[int, int]] = []
        # A run of one row can link only if it goes on from or into another batch.
        for a, b in zip(cut.tolist(), stops.tolist()):
            if b - a == 1 and a > 0 and b < len(fp):
                continue
            this = (int(key[a, 0]), int(key[a, 1]))
            if this != now:
                now, homes, links = this, np.empty(0, np.uint64), Links()
            run, h = fp[a:b], home[a:b]
            homes = np.concatenate([homes, run[h]])
            for lo in range(0, len(run), 1024):
                for at in range(0, len(homes), BLOCK):
                    near = np.bitwise_count(homes[at : at + BLOCK, None] ^ run[None, lo : lo + 1024]) <= MAX_BITS
                    for i, j in zip(*np.nonzero(near)):
                        x, y = int(homes[at + i]), int(run[lo + j])
                        if x != y and links.join(x, y):
                            found.append((x, y))
        if found:
            pairs = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links_of(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), a spanning forest of those that meet at each anchor."""
    rows = fps.mapInArrow(replicate, "anchor long, fp long, home boolean")
    # Each fingerprint has two homes, so at most 2 * HOT_SHARE anchors are above the limit, and they may be broadcast.
    limit = max(BLOCK, fps.count() // HOT_SHARE)
    hot = rows.filter("home").groupBy("anchor").count().filter(F.col("count") > limit)
    hot = F.broadcast(hot.select("anchor", F.ceil(F.col("count") / limit).cast("int").alias("blocks")))
    rows = rows.join(hot, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.hash("fp"), F.col("blocks")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.select("anchor", "fp", "home", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(every)).alias("block"), own[0].alias("own"))
    rows = rows.select("anchor", "block", "fp", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return rows.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, nodes_name: str = "fp") -> DataFrame:
    """(fp, root): the smallest node that each linked node reaches, by alternating large-star and small-star steps.

    Every step is an aggregation over the edges with a map-side combine; each round is written to the shared folder.
    The stars leave as many rows as there are nodes at most, and end when a round changes nothing.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b")
        if large:
            both = both.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        """Rows and digests over them: the rows are distinct, so a change shows in one of the three."""
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)")), F.bit_xor(F.xxhash64("b", "a"))).first())

    before = state(edges)
    while True:
        earlier, edges = edges, materialise(star(star(edges, True), False), "edges")
        delete_table(earlier)
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias(nodes_name), F.col("b").alias("root"))
        before = after


def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row; component_id is the smallest key reachable over links.

    A null text has no words (fingerprint zero, linked like any other). Null keys get a component like other rows but
    never name one, unless all keys of a component are null. Equal fingerprints are one node, so thousands of copies
    cost one comparison.
    """
    arrow_limits(docs.sparkSession)
    prints = materialise(docs.select(F.col(key), simhash_udf(F.col(text)).alias("fp")), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links_of(nodes.select("fp")))
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
