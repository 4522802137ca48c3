"""Packing by lexical retrieval.

Documents are encoded and dealt to shards of bounded size, those of like vocabulary together. Each shard has a BM25
inverted index over its documents. A seed document opens a window, the index returns its best unused
neighbours, and they fill the window greedily; the one that runs over is cut, and its rest is the next seed. The last
window of a shard is cut into sequences of power-of-two length, so that nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WIDE_ROWS, arrow_limits, released, table
from .encode import worker_encoder

WINDOW, END_ID = 4096, 2
#: Tokens of a shard at most (but for one longer document), query terms of a seed (None: all), and BM25's two parameters.
SHARD_TOKENS, QUERY_TERMS, K1, B = 2_000_000, None, 1.2, 0.75
#: Terms that more than one document in DENSE holds are kept as rows instead of lists.
DENSE = 8
#: Documents that the topics are fitted on (about as many, by their hashes, and twice as many at most), dimensions of their
#: vectors, bits of a topic.
TOPIC_SAMPLE, TOPIC_DIMENSIONS, TOPIC_BITS = 4000, 32, 8
Piece = tuple[int, int, int, int, int]  # document in the shard, start, length, sequence, offset


def locality(ids: np.ndarray) -> int:
    """The least hash of two neighbouring ids: equal for most near copies, and by chance for texts that share phrases."""
    if len(ids) < 2:
        return int(ids[0]) if len(ids) else 0
    return int((_mixed(ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)) >> np.uint64(1)).min())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def directions(vocabulary: int) -> np.ndarray:
    """A row of +1 and -1 for each id, by a hash of the id: TOPIC_DIMENSIONS directions in the space of the ids."""
    bits = _mixed(np.arange(1, vocabulary + 1, dtype=np.uint64))[:, None] >> np.arange(64, dtype=np.uint64)
    return (bits[:, 64 - TOPIC_DIMENSIONS :] & np.uint64(1)).astype(np.float32) * 2 - 1


def vector(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The document's counts of ids (as logarithms) along the directions, of length one."""
    kinds, times = np.unique(ids, return_counts=True)
    v = np.log1p(times, dtype=np.float32) @ signs[kinds]
    return v / max(1e-6, float(np.linalg.norm(v)))


class Topics:
    """The signs of a document's vector along the axes in which the sampled documents differ most: alike for like vocabularies."""

    def __init__(self, sample: np.ndarray) -> None:
        self.mean, self.axes = np.zeros(TOPIC_DIMENSIONS, np.float32), np.zeros((TOPIC_DIMENSIONS, TOPIC_BITS), np.float32)
        if len(sample):
            self.mean = sample.mean(axis=0)
            axes = np.linalg.svd(sample - self.mean, full_matrices=False)[2][:TOPIC_BITS].T
            self.axes[:, : axes.shape[1]] = axes

    def of(self, v: np.ndarray) -> int:
        return int.from_bytes(np.packbits((v - self.mean) @ self.axes > 0).tobytes(), "big")


def fit_topics(docs: DataFrame, tokenizer: str, drops_space: bool, key: str, text: str) -> Topics:
    """Topics from a bounded sample of documents; only their short vectors come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, drops_space)
        signs = directions(encoder.tokenizer.get_vocab_size())
        for batch in batches:
            vectors = [vector(x, signs).tolist() for x in encoder.encode_array(batch.column("t")) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float32()))], ["v"])

    one_in = max(1, docs.count() // TOPIC_SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64(key, text), F.lit(one_in)) == 0).select(F.col(text).alias("t")).limit(2 * TOPIC_SAMPLE)
    found = some.mapInArrow(run, "v array<float>").toArrow().column("v").to_pylist()
    return Topics(np.array(found, np.float32).reshape(-1, TOPIC_DIMENSIONS))


class Bm25:
    """Inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int64), lengths)
        terms = np.concatenate(docs).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
        pairs, tf = np.unique(terms * self.n + owner, return_counts=True)
        self.terms, self.doc = pairs // max(1, self.n), pairs % max(1, self.n)
        vocabulary, first, df = np.unique(self.terms, return_index=True, return_counts=True)
        self.first, self.df = first, df
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.sum() / max(1, self.n)))
        self.slot = np.repeat(np.arange(len(vocabulary)), df)
        self.score = idf[self.slot] * tf * (K1 + 1) / (tf + norm[self.doc])
        order = np.lexsort((-self.score, self.doc))  # each document's terms, the heaviest first
        self.own, self.doc_first = self.slot[order], np.searchsorted(self.doc[order], np.arange(self.n + 1))
        # Terms of more than one document in DENSE have a row over all documents: as much memory as DENSE lists at most.
        dense = df * DENSE > self.n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((int(dense.sum()), self.n))
        at = np.flatnonzero(dense[self.slot])
        self.rows[self.row[self.slot[at]], self.doc[at]] = self.score[at]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties by their order in the shard."""
        own = self.own[self.doc_first[seed] : self.doc_first[seed + 1]][:QUERY_TERMS]
        if not len(own):
            return np.empty(0, np.int64)
        row = self.row[own]
        rare = own[row < 0]
        df = self.df[rare]
        at = np.repeat(self.first[rare] - np.cumsum(df) + df, df) + np.arange(df.sum())
        scores = np.bincount(self.doc[at], self.score[at], minlength=self.n) + self.rows[row[row >= 0]].sum(axis=0)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], first_sequence: int = 0, window: int = WINDOW) -> list[Piece]:
    """Pieces that hold each id of docs once, in sequences of `window` ids; the last ones have power-of-two lengths."""
    pieces: list[Piece] = []
    sequence = first_sequence
    at = np.zeros(len(docs), dtype=np.int64)  # what is packed of each document
    for i, ids in enumerate(docs):
        while len(ids) - at[i] >= window:
            pieces.append((i, int(at[i]), window, sequence, 0))
            at[i] += window
            sequence += 1
    left = np.array([len(d) for d in docs], dtype=np.int64) - at
    unused = left > 0
    index = Bm25([d[:-1] for d in docs])
    waiting = iter(np.flatnonzero(unused).tolist())
    open_: list[tuple[int, int, int]] = []  # document, start, length
    space, seed = window, None

    def put(i: int) -> None:
        nonlocal space, sequence, open_, seed
        take = int(min(space, left[i]))
        open_.append((i, int(at[i]), take))
        at[i] += take
        left[i] -= take
        space -= take
        unused[i] = left[i] > 0
        if not space:
            offset = 0
            for doc, start, n in open_:
                pieces.append((doc, start, n, sequence, offset))
                offset += n
            sequence, open_, space, seed = sequence + 1, [], window, i if left[i] else None

    while True:
        if seed is None or not unused[seed]:
            seed = next((i for i in waiting if unused[i]), None)
            if seed is None:
                break
        this, done = seed, sequence
        put(this)
        if sequence != done:
            continue
        for i in index.neighbours(this, unused).tolist():
            put(i)
            if sequence != done:
                break
        else:
            seed = None  # no neighbour is left: the next document in order goes on with the window
    total = window - space
    parts = [1 << b for b in range(window.bit_length() - 1, -1, -1) if total >> b & 1]
    room, offset = (parts.pop(0), 0) if parts else (0, 0)
    for doc, start, n in open_:
        while n:
            take = min(n, room - offset)
            pieces.append((doc, start, take, sequence, offset))
            start, n, offset = start + take, n - take, offset + take
            if offset == room and parts:
                sequence, room, offset = sequence + 1, parts.pop(0), 0
    return pieces


def encoded(docs: DataFrame, tokenizer: str, drops_space: bool, key: str, text: str, end_id: int) -> DataFrame:
    """(k, topic, place, ids): the ids of each row of docs with the end id, as unsigned 16-bit or 32-bit numbers.

    place orders by topic, and in one topic by locality.
    """
    schema = pa.schema([("k", pa.int64()), ("topic", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])
    topics = fit_topics(docs, tokenizer, drops_space, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, drops_space)
        size = encoder.tokenizer.get_vocab_size()
        kind, signs = "<u2" if size <= 1 << 16 else "<u4", directions(max(size, end_id + 1))
        for batch in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode_array(batch.column("t"))]
            found = [topics.of(vector(x, signs)) for x in ids]
            places = [t << 63 - TOPIC_BITS | locality(x) >> TOPIC_BITS for t, x in zip(found, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.int64()), pa.array(places, pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], schema=schema)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(released(run, keep=True), "k long, topic long, place long, ids binary")


def pack(docs: DataFrame, tokenizer: str, drops_space: bool = False, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every row of docs, ids as 32-bit numbers.

    Null texts count as empty: such a document is its end id. Null and repeated keys are separate documents; an empty
    table gives no pieces. Documents of one topic may be a third of all: Spark splits their partition when it is large.
    """
    arrow_limits(docs.sparkSession, WIDE_ROWS)
    wide = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    rows = encoded(docs, tokenizer, drops_space, key, text, end_id).hint("rebalance", "topic").sortWithinPartitions("place", "k")
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        keys: list = []
        shard: list[np.ndarray] = []
        tokens = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, keys, shard, tokens
            pieces = pack_shard(shard, sequence, window)
            for lo in range(0, len(pieces), 2000):
                part = pieces[lo : lo + 2000]
                columns = [
                    [keys[p[0]] for p in part], [p[1] for p in part], [p[2] for p in part],
                    [shard[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in part],
                    [len(shard[p[0]]) for p in part], [p[3] for p in part], [p[4] for p in part],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            sequence = max((p[3] for p in pieces), default=sequence) + 1
            keys, shard, tokens = [], [], 0

        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(raw, wide)
                if shard and tokens + len(ids) > SHARD_TOKENS:
                    yield from close()
                keys.append(k), shard.append(ids)
                tokens += len(ids)
        if shard:
            yield from close()

    return rows.mapInArrow(released(run), f"{key} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def packed(docs: DataFrame) -> DataFrame:
    """pack() with the tokenizer of the query, and a checksum for each piece."""
    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces with their ids."""
    return packed(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
