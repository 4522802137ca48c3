"""Near copies for the pipeline: SimHash candidates, an exact check, and an exact way for what SimHash cannot reach.

A text is the set of its SHINGLE-word shingles; two texts are near copies if their sets have a Jaccard similarity of
NUM / DEN or more. SimHash prints of the sets that link under the anchor-point covering (module simhash) are candidates.
But at a similarity of 0.8 prints differ in some ten of 64 bits, far beyond any covering that can be paid for. For these
there is a prefix filter: two such sets, each sorted by one order of all shingles, share a shingle among the first few of
each (a fifth of the set at 0.8), so texts are compared where these prefixes meet, and no near copy is missed. Any order
is right; shingles that many texts share come last in it, so that a passage of a third of all texts makes no candidates.

Candidates that a count of shingles by hash ranges cannot rule out are compared by their whole sets. First each text is
compared with the least of those that it meets at a shingle, then, where many texts meet, with a few that have the most
links so far; what this joins need not be compared pair by pair, so a dense group costs a few comparisons a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_ROWS, arrow_limits, delete_table, materialise, released, split_join
from .simhash import components, links_of, majority
from .words import groups, word_hashes

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, NUM, DEN = 5, 4, 5
#: One text in SAMPLE is looked at for common shingles; those in COMMON of these or more come last, the MOST commonest at most.
SAMPLE, COMMON, MOST = 8, 12, 200_000
#: Texts that meet at a shingle and are paired in one task; more are dealt out.
BLOCK = 2000
#: Texts that a text is compared with before the rest: the first ones at the shingles that it shares with them.
FIRSTS = 3
#: Shingles of more texts than LARGE, where texts are compared with the HUBS of most links first, in TURNS turns
#: at most, or until fewer than one comparison in FEW finds a near copy.
LARGE, HUBS, TURNS, FEW = 32, 6, 3, 20
#: Hash ranges in which the shingles of a text are counted.
RANGES = 256
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray) -> np.ndarray:
    """The digests of the shingles of a text, from the hashes of its words (one of all words, if they are fewer)."""
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(words), SHINGLE)))
    for k in range(min(SHINGLE, len(words))):
        out = out * _FACTOR + words[k : k + n]
        out ^= out >> np.uint64(29)
        out *= _MIX
    return out ^ (out >> np.uint64(32))


def node_of(found: np.ndarray) -> int:
    """The digest of a set as a signed number: texts with one set are one node."""
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), dtype=np.uint64).view(np.int64))


def _sets(texts: pa.StringArray) -> Iterator[np.ndarray]:
    """The sorted distinct digests of the shingles of each text."""
    for group in groups(texts):
        hashes, begins = word_hashes(group, True)
        every = shingles(hashes)  # of all texts in a row: those that cross a text's end are left out below
        for a, b in zip(begins.tolist(), begins[1:].tolist()):
            yield np.unique(every[a : b - SHINGLE + 1] if b - a >= SHINGLE else shingles(hashes[a:b]))


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle): all shingles of the texts."""
    for batch in batches:
        for found in _sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])


def counts_by_range(found: np.ndarray) -> bytes | None:
    """How many shingles lie in each of RANGES hash ranges, a byte each; None if a count needs more than a byte."""
    counts = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return None if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def prefixes(common: np.ndarray):
    """A function of batches of (hash, text) that gives for each text its hash, its set's digest, size, print and counts, and the first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, counts, firsts = [], [], [], [], []
            for found in _sets(batch.column("text")):
                n = len(found)
                nodes.append(node_of(found)), sizes.append(n), prints.append(majority(found)), counts.append(counts_by_range(found))
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
                    found = np.concatenate([found[~last], found[last]])
                firsts.append(found[: n - (NUM * n + DEN - 1) // DEN + 1].tobytes())
            fps = np.array(prints, np.uint64).view(np.int64)
            columns = [batch.column("hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps), pa.array(counts, pa.binary()), pa.array(firsts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "node", "n", "fp", "counts", "prefix"])

    return run


def postings(common: np.ndarray, times: np.ndarray):
    """A function of batches of nodes that gives (shingle, pieces, piece, node, n, at): the prefixes row by row.

    at is the place in the order. A shingle that about `times` texts hold is dealt to pieces of some HOT_ROWS by the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
            if not found:
                continue
            sizes = [len(f) for f in found]
            node, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "n"))
            at, shingle = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]), np.concatenate(found)
            pieces = np.ones(len(shingle), np.int64)
            if len(common):
                place = np.minimum(np.searchsorted(common, shingle.view(np.uint64)), len(common) - 1)
                pieces = np.where(common[place] == shingle.view(np.uint64), -(-times[place] // HOT_ROWS), 1)
            piece = (node.view(np.uint64) % pieces.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle, pieces.astype(np.int32), piece, node, n, at)], ["shingle", "pieces", "piece", "node", "n", "at"])

    return run


def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by (shingle, piece), that share both with another row or whose shingle has pieces, each with the first of its group."""
    names = ["shingle", "pieces", "piece", "node", "n", "at"]
    held = {c: np.empty(0, np.int64) for c in names}  # the last row so far, whose group may go on
    first, begun = None, False  # of the group of the held row: its first row, and whether rows of it were given already

    def groups(rows: dict[str, np.ndarray], last: bool) -> pa.RecordBatch | None:
        nonlocal held, first, begun
        total = len(rows["shingle"])
        if not total:
            return None
        new = np.r_[True, (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["piece"][1:] != rows["piece"][:-1])]
        start = np.flatnonzero(new)
        group, sizes = np.cumsum(new) - 1, np.diff(np.r_[start, total])
        firsts = {c: rows[c][start] for c in ("node", "n", "at")}
        if first is not None:  # the first group is the held row's
            for c in firsts:
                firsts[c][0] = first[c]
        keep = (sizes > 1) | (rows["pieces"][start] > 1)
        keep[0] |= begun
        out = keep[group]
        if not last:  # the last row waits, as long as it may be alone
            out[-1] = False
            begun = bool((begun and len(start) == 1) or sizes[-1] > 1)
            first = {c: firsts[c][-1] for c in firsts}
            held = {c: rows[c][-1:] for c in names}
        return pa.RecordBatch.from_arrays([*(pa.array(rows[c][out]) for c in names), *(pa.array(firsts[c][group][out]) for c in firsts)], [*names, "f_node", "f_n", "f_at"]) if out.any() else None

    for batch in batches:
        if (found := groups({c: np.concatenate([held[c], batch.column(c).to_numpy().astype(np.int64)]) for c in names}, False)) is not None:
            yield found
    if (found := groups(held, True)) is not None:
        yield found


def may_reach(a: str, b: str) -> F.Column:
    """Whether sets of these sizes whose first common shingle has these places can be similar enough (fields node, n, at)."""
    size = lambda x, c: F.col(f"{x}.{c}").cast("long")
    rest = F.least(size(a, "n") - size(a, "at"), size(b, "n") - size(b, "at"))
    return rest * (NUM + DEN) >= (size(a, "n") + size(b, "n")) * NUM


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose whole sets are similar enough; rows hold the sets as sorted digests."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of the texts."""
    for batch in batches:
        found = list(_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])


def may_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose counts by hash range leave room for enough common shingles."""
    for batch in batches:
        keep = []
        for x, y, n in zip(*(batch.column(c).to_pylist() for c in ("counts_a", "counts_b", "n"))):
            shared = n if x is None or y is None else int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum(dtype=np.int64))
            keep.append(shared * (NUM + DEN) >= NUM * n)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are near copies; nodes has the hash of one text of each, texts is (hash, text)."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "counts_a", "counts_b", (F.col("n_a").cast("long") + F.col("n_b")).alias("n"))
    pairs = materialise(rows.mapInArrow(released(may_share), "a long, b long"), "maybe")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(nodes.select("node", "hash").join(ends, "node", "left_semi").select("hash"), "wanted")
    sets = materialise(texts.join(wanted, "hash", "left_semi").dropDuplicates(["hash"]).select("text").mapInArrow(released(whole_sets), "node long, shingles binary"), "sets")
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    found = materialise(rows.select("a", "b", "left", "right").mapInArrow(released(similar), "a long, b long"), "similar")
    for done in (pairs, wanted, sets):
        delete_table(done)
    return found


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the sampled texts hold, ascending, and about how many texts hold each.

    Only the order of the prefixes and the pieces of the work depend on them, no result.
    """
    some = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(released(sampled), "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(MOST).toArrow()
    found = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows.column("count").to_numpy()[order] * SAMPLE


def linked_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes whose prints are equal or link, by the covering; of one print each node meets the least only."""
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fps")
    same = nodes.select("fp", "node").join(prints, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = links_of(prints.select("fp"))
    for c in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")), c)
    return same.union(links.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def rooted(met: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (shingle, x, root) with the least node that links join each with, and of the shingles where more than one root is left
    (shingle, n, blocks, main): its rows, their blocks, and the root of its least text."""
    roots = components(links, "node")
    rows = met.join(roots.withColumnRenamed("node", "__node"), F.col("x.node") == F.col("__node"), "left").select("shingle", "x", F.coalesce("root", "x.node").alias("root"))
    rows = materialise(rows, "rooted")
    delete_table(roots)
    apart = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct("x", "root")).alias("first")).filter("r0 <> r1")
    return rows, materialise(apart.select("shingle", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.col("first.root").alias("main")), "apart")


def hub_pairs(rows: DataFrame, apart: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """(a, b): texts at shingles of many texts, each with HUBS of other roots at most.

    Hubs are the texts with the most links so far, one of each of HUBS parts of the texts at a shingle; parts change by the turn.
    What has a near copy in a dense group has one among its hubs more likely than elsewhere, so few texts are left to be held
    against all others.
    """
    total = rows.count()
    ends = links.select(F.col("a").alias("__node")).union(links.select("b")).groupBy("__node").agg(F.count("*").alias("links"))
    rows = split_join(rows, apart.filter(F.col("n") > LARGE).select("shingle", "n"), ["shingle"], total, ["x.node"])
    rows = rows.join(ends, F.col("x.node") == F.col("__node"), "left").select("shingle", "x", "root", F.coalesce("links", F.lit(0)).alias("links"))
    rows = materialise(rows, "large")
    part = F.pmod(F.xxhash64("x.node", F.lit(turn)), F.lit(HUBS)).alias("part")
    hubs = rows.groupBy("shingle", part).agg(F.max(F.struct("links", "x", "root")).alias("hub"), F.count("*").alias("n"))
    hubs = hubs.groupBy("shingle").agg(F.sum("n").alias("n"), F.collect_list("hub").alias("hubs"))
    pairs = split_join(rows, hubs, ["shingle"], total, ["x.node"]).select("x", "root", F.explode(F.filter("hubs", lambda hub: hub["root"] != F.col("root"))).alias("hub"))
    pairs = pairs.filter(may_reach("x", "hub.x"))
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("hub.x.node").alias("b")).agg(F.count("*").alias("n"), F.max("hub.links").alias("links"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), F.desc("links"), "b"))
    pairs = materialise(pairs.withColumn("best", best).filter(F.col("best") <= HUBS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "hubs")
    delete_table(rows)
    return pairs


def near_pairs(nodes: DataFrame, texts: DataFrame, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """(a, b): pairs of near copies that join all of them; nodes is (node, n, fp, counts, prefix, hash), each node once."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "n", "prefix").mapInArrow(released(postings(common, times)), "shingle long, pieces int, piece int, node long, n int, at int")
    rows = rows.repartition(n, "shingle", "piece").sortWithinPartitions("shingle", "piece", "node")
    met = materialise(rows.mapInArrow(released(meeting), "shingle long, pieces long, piece long, node long, n long, at long, f_node long, f_n long, f_at long"), "met")
    x, first = F.struct("node", "n", "at").alias("x"), F.struct(F.col("f_node").alias("node"), F.col("f_n").alias("n"), F.col("f_at").alias("at")).alias("first")
    stars = met.filter("node <> f_node").select(x, first)
    # The first of each piece of a shingle meets the least of them.
    heads = met.filter("pieces > 1 and node = f_node").select("shingle", x)
    stars = stars.union(heads.join(heads.groupBy("shingle").agg(F.min("x").alias("first")), "shingle").select("x", "first"))
    stars = stars.filter((F.col("x.node") != F.col("first.node")) & may_reach("x", "first")).groupBy(F.col("first.node").alias("a"), F.col("x.node").alias("b")).count()
    # A text of a dense group meets many firsts: those that it meets most are enough here, and what they do not join is left to the rest.
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
    stars = stars.withColumn("best", best).filter(F.col("best") <= FIRSTS).select("a", "b")
    stars = materialise(stars.union(linked_prints(nodes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    links, tried = [verified(stars, nodes, texts)], [stars]
    both = lambda tables: reduce(DataFrame.union, tables)
    met_rows = met.select("shingle", x)
    rows, apart = rooted(met_rows, links[0])
    for turn in range(TURNS):
        pairs = hub_pairs(rows, apart, both(links), turn)
        tried.append(materialise(pairs.join(both(tried), ["a", "b"], "left_anti"), "stars"))
        delete_table(pairs)
        if not (compared := tried[-1].count()):
            break
        links.append(verified(tried[-1], nodes, texts))
        if FEW * links[-1].count() < compared:  # a further turn would find little, and what was found is kept
            break
        for done in (rows, apart):
            delete_table(done)
        rows, apart = rooted(met_rows, both(links))
    delete_table(met)
    # What is left: texts that meet and that no chain of links joins yet, each pair of them once.
    rows_table = rows
    rows = split_join(rows, apart, ["shingle"], rows.count(), ["x.node"])
    # One of two texts of different roots is not of the root of the least text: only such ones are held against all others.
    left = rows.filter("root <> main").select("shingle", F.pmod(F.xxhash64("x.node"), F.col("blocks")).cast("int").alias("block"), F.col("x").alias("p"), F.col("root").alias("p_root"))
    right = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("q"), F.col("root").alias("q_root"), "main")
    once = (F.col("q_root") == F.col("main")) | (F.col("p.node") < F.col("q.node"))
    pairs = left.join(right, ["shingle", "block"]).filter(once & (F.col("p_root") != F.col("q_root")) & may_reach("p", "q"))
    pairs = pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct().join(both(tried), ["a", "b"], "left_anti")
    pairs = materialise(pairs, "pairs")
    links.append(verified(pairs, nodes, texts))
    for done in (*tried, rows_table, apart, pairs):
        delete_table(done)
    return both(links)


def copy_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, root): the XXH64 of each distinct text, and the least node (digest of a text's shingles) of its group.

    Groups are what chains of near copies join. Null texts have no words, like empty ones.
    """
    arrow_limits(docs.sparkSession)
    texts = docs.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    common, times = common_shingles(docs, text)
    prints = materialise(texts.mapInArrow(released(prefixes(common)), "hash long, node long, n int, fp long, counts binary, prefix binary"), "prints")
    nodes = materialise(prints.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "counts", "prefix")], F.min("hash").alias("hash")), "nodes")
    hashes = materialise(prints.select("hash", "node").distinct(), "hashes")
    delete_table(prints)
    roots = components(near_pairs(nodes, texts, common, times), "node")
    delete_table(nodes)
    return hashes.join(roots, "node", "left").select("hash", F.coalesce("root", "node").alias("root"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with the columns it came with.

    Rows are told apart by id and text, so a null or repeated id drops nothing but near copies.
    """
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("hash")).join(copy_groups(docs), "hash")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "hash")).alias("first"))
    first = first.select(F.col("root").alias("__root"), "first.__id", F.col("first.hash").alias("__hash"))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    return kept.dropDuplicates(["__root"]).select(*docs.columns)
