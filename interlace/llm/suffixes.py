"""Repeated passages by a logarithmic family of sparse suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is found. Not all suffixes are indexed: in each
string of LENGTH bytes the gram with the least hash among its first WINDOW positions is its sample, which depends on
the string alone, so equal strings have their samples at the same place. A batch of texts gets a sparse suffix array:
its samples in the order of (a, u), where a digests the REACH bytes from the sample, a prefix that all strings with
this sample share, and u digests the stretch that these strings cover together. A new batch is scanned together with
the levels there are: equal neighbours in a are possible matches. Levels of equal size merge, so n batches leave log n.

Where u is equal too, all the strings of the sample repeat. What is left (equal in a, not in u: the ends of repeats) is
compared string by string, only inside the groups with equal a.

The query counts bytes. The stage of the pipeline counts words: there a text is the digests of its words, WORD bytes
each, and a string of WORDS words that starts elsewhere too is cut, however long or short its words are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, delete_table, materialise, released, split_join, table, text_of
from .words import groups, word_hashes

LENGTH, GRAM, WINDOW = 400, 16, 180
#: The stage cuts passages of WORDS words or more; a word's digest has WORD bytes.
WORDS, WORD = 51, 6
#: Positions handled at once by the sampling, and batches that the query cuts its texts into.
PIECE, BATCHES = 1 << 19, 2
#: Stretches of one group that one task compares; of larger groups digests are counted, by bands of STEP distances first.
GROUP, STEP = 4000, 12
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A sample's place: its offset in the text, how far the first string starts before it, and how many strings it stands for.
_SHIFT = 10


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes (a power of two) from each position, as uint64."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, base = 1, int(_BASE)
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h >> np.uint64(32)


def first_minima(h: np.ndarray) -> np.ndarray:
    """For each position the place of the leftmost least value among the WINDOW values from it."""
    n = len(h) - WINDOW + 1
    v = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    v = np.concatenate([v, np.full(-len(v) % WINDOW, np.uint64(2**64 - 1))]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(v, axis=1).reshape(-1)
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def samples(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first string, last string, sample) for runs of strings with one sample; texts end at `ends` (ascending) in data."""
    total = len(data)
    for lo in range(0, total - length + 1, PIECE):
        hi = min(lo + PIECE, total - length + 1)
        at = np.arange(lo, hi)
        at = at[at + length <= ends[np.searchsorted(ends, at, side="right")]]  # strings that cross no text's end
        if not len(at):
            continue
        least = first_minima(gram_hashes(data[lo : hi + WINDOW + GRAM - 2])) + lo
        f = least[at - lo]
        cut = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (at[1:] != at[:-1] + 1)])
        yield at[cut], at[np.r_[cut[1:], len(at)] - 1], f[cut]


def suffix_rows(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(text_id, place, a, u) of all samples of the texts in the batches."""
    digest, reach = xxhash.xxh3_64_intdigest, length - WINDOW + 1
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("text_id").to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or offsets[-1] == offsets[0]:
            continue
        whole = memoryview(texts.buffers()[2])[int(offsets[0]) : int(offsets[-1])]
        offsets -= offsets[0]
        data = np.frombuffer(whole, np.uint8)
        for p0, p1, f in samples(data, offsets[1:], length):
            owner = np.searchsorted(offsets, p0, side="right") - 1
            place = ((f - offsets[owner]) << (2 * _SHIFT)) | ((f - p0) << _SHIFT) | (p1 - p0 + 1)
            a = np.fromiter((digest(whole[i : i + reach]) for i in f.tolist()), np.uint64, len(f))
            u = np.fromiter((digest(whole[i:j]) for i, j in zip(p0.tolist(), (p1 + length).tolist())), np.uint64, len(f))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(place), pa.array(a.view(np.int64)), pa.array(u.view(np.int64))], ["text_id", "place", "a", "u"])


def after(prepare, function):
    """The function on what prepare() makes of the batches, in one Python worker instead of two at a time."""
    return function if prepare is None else lambda batches: function(prepare(batches))


class SuffixFamily:
    """Levels of sparse suffix arrays in the shared folder, each of a size in batches that is a power of two.

    prepare: turns batches of texts into batches of what is indexed, such as digests of the words.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, prepare=None) -> None:
        self.spark, self.length, self.prepare = spark, length, prepare
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []

    def _array(self, rows: DataFrame) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # The text has a part in it: a passage that a third of the texts share is one a, and one u if they go on alike.
        return materialise(rows.repartition(n, "a", F.pmod("text_id", F.lit(n))).sortWithinPartitions("a", "u"), "level")

    def scan(self, fresh: DataFrame) -> DataFrame:
        """(a, n): digests of the new level that occur twice or more in it and the levels together, and how often."""
        rows = fresh.select("a", F.lit(1).alias("fresh"))
        for _, level in self.levels:
            rows = rows.union(level.select("a", F.lit(0)))
        return rows.groupBy("a").agg(F.count("*").alias("n"), F.max("fresh").alias("fresh")).filter("n > 1 and fresh = 1").select("a", "n")

    def add(self, texts: DataFrame) -> None:
        """Index a batch of (text_id, text), note its matches with itself and all levels, and merge equal levels."""
        size, rows = 1, self._array(texts.select("text_id", "text").mapInArrow(released(after(self.prepare, partial(suffix_rows, length=self.length))), "text_id long, place long, a long, u long"))
        self.matches.append(materialise(self.scan(rows), "matches"))
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = self._array(other.union(rows))
            delete_table(other), delete_table(rows)
            size, rows = 2 * size, merged
        self.levels.append((size, rows))

    def candidates(self) -> DataFrame:
        """All samples whose a occurs twice or more in the family."""
        rows, found = self.levels[0][1], self.matches[0]
        for _, level in self.levels[1:]:
            rows = rows.union(level)
        for more in self.matches[1:]:
            found = found.union(more)
        # The last batch that has a digest counted all its samples.
        found = found.groupBy("a").agg(F.max("n").alias("n"))
        return split_join(rows, found, ["a"], rows.count(), ["text_id", "place"], "left_semi")


def _place(column: str = "place") -> tuple[Column, Column, Column]:
    """(sample's offset, first string's distance before it, number of strings) of a packed place."""
    c, mask = F.col(column), (1 << _SHIFT) - 1
    return F.shiftright(c, 2 * _SHIFT), F.shiftright(c, _SHIFT).bitwiseAND(mask), c.bitwiseAND(mask)


def stretches(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The bytes that the wanted samples' strings cover, for each text and its list of wanted samples."""
    schema = pa.schema([("a", pa.int64()), ("text_id", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("bytes", pa.binary())])
    mask = (1 << _SHIFT) - 1
    for batch in batches:
        out = []
        for text_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text_id", "text", "wanted"))):
            raw = text if isinstance(text, bytes) else text.encode()
            for w in wanted:
                first = (w["place"] >> 2 * _SHIFT) - (w["place"] >> _SHIFT & mask)
                out.append((w["a"], text_id, w["place"], w["alone"], raw[first : first + (w["place"] & mask) - 1 + length]))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repeated_strings(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(text_id, start, stop): covered spans, by comparing the strings of each group a; rows come sorted by it.

    Groups have GROUP stretches at most. Strings are compared by 128-bit digests, at the same distance before the sample.
    """
    digest = xxhash.xxh3_128_digest
    mask = (1 << _SHIFT) - 1
    now, group = None, []

    def compare() -> list[tuple[int, int, int]]:
        seen: Counter = Counter()
        lists = []
        for text_id, place, alone, raw in group:
            before, n = place >> _SHIFT & mask, place & mask
            own = [digest(raw[i : i + length]) + (before - i).to_bytes(2, "little") for i in range(n)]
            seen.update(own)
            if alone:
                lists.append((text_id, (place >> 2 * _SHIFT) - before, own))
        found = []
        for text_id, first, own in lists:
            span = None
            for i, d in enumerate(own):
                if seen[d] > 1:
                    if span and first + i <= span[1]:
                        span[1] = first + i + length
                    else:
                        if span:
                            found.append((text_id, *span))
                        span = [first + i, first + i + length]
            if span:
                found.append((text_id, *span))
        return found

    for batch in batches:
        found = []
        for a, *row in zip(*(batch.column(c).to_pylist() for c in ("a", "text_id", "place", "alone", "bytes"))):
            if a != now:
                if len(group) > 1:
                    found += compare()
                now, group = a, []
            group.append(tuple(row))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["text_id", "start", "stop"])
    if len(group) > 1 and (found := compare()):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["text_id", "start", "stop"])


def probes(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(a, band, core, whole, text_id, place, alone) for each band of STEP distances in which a stretch has strings.

    core digests what all strings of the band share, whole what they cover together; whole is null if some are missing.
    """
    digest, mask = xxhash.xxh3_128_digest, (1 << _SHIFT) - 1
    names = ["a", "band", "core", "whole", "text_id", "place", "alone"]
    for batch in batches:
        out = []
        for a, text_id, place, alone, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "text_id", "place", "alone", "bytes"))):
            before, n = place >> _SHIFT & mask, place & mask  # strings at distances before, before - 1, .. before - n + 1
            for band in range((before - n + 1) // STEP, before // STEP + 1):
                low, high = band * STEP, band * STEP + STEP - 1
                full = high <= before and low >= before - n + 1
                out.append((a, band, digest(raw[before - low : before - high + length]), digest(raw[before - high : before - low + length]) if full else None, text_id, place, alone))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def strings_of_bands(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(a, distance, string, text_id, start, asks): a digest for each string of the wanted bands of the stretches."""
    digest, mask = xxhash.xxh3_128_digest, (1 << _SHIFT) - 1
    names = ["a", "distance", "string", "text_id", "start", "asks"]
    for batch in batches:
        out = []
        for a, text_id, place, raw, bands in zip(*(batch.column(c).to_pylist() for c in ("a", "text_id", "place", "bytes", "bands"))):
            before, n, at = place >> _SHIFT & mask, place & mask, place >> 2 * _SHIFT
            for b in bands:
                for d in range(max(b["band"] * STEP, before - n + 1), min(b["band"] * STEP + STEP - 1, before) + 1):
                    out.append((a, d, digest(raw[before - d : before - d + length]), text_id, at - d, b["asks"]))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def large_groups(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_id, start, stop) for groups a of any size, from their stretches: what repeated_strings() finds, but counted.

    No task holds a group. Digests are counted by aggregations with a map-side combine, first of bands of STEP distances:
    a band whose core is alone has no repeat, one whose whole repeats is repeats only. Of the rest each string is counted.
    """
    cut = materialise(cut, "stretches")
    rows = materialise(cut.mapInArrow(released(partial(probes, length=length)), "a long, band int, core binary, whole binary, text_id long, place long, alone boolean"), "probes")
    total, own = rows.count(), ["text_id", "place"]
    cores = materialise(rows.groupBy("a", "band", "core").agg(F.count("*").alias("n")).filter("n > 1"), "cores")
    one = F.min(F.struct("text_id", "place")).alias("one")
    wholes = rows.filter("whole is not null").groupBy("a", "band", "whole").agg(F.count("*").alias("n"), one).filter("n > 1")
    wholes = materialise(wholes, "wholes")
    same = F.col("whole").isNotNull() & F.col("n_whole").isNotNull()
    marked = wholes.select("a", "band", "whole", "n", F.col("n").alias("n_whole"), "one")
    rows = split_join(rows, marked, ["a", "band", "whole"], total, own, "left")
    sample, _, _ = _place()
    sure = rows.filter(same & F.col("alone")).select("text_id", (sample - F.col("band") * STEP - (STEP - 1)).alias("start"), (sample - F.col("band") * STEP + length).alias("stop"))
    # One stretch of each repeated whole stands for the others where single strings are counted.
    asks = ~same & F.col("alone")
    rest = rows.filter(~same | (F.col("one") == F.struct("text_id", "place"))).select("a", "band", "core", *own, asks.alias("asks"))
    rest = split_join(rest, cores, ["a", "band", "core"], total, own, "left_semi")
    bands = rest.groupBy("a", *own).agg(F.collect_list(F.struct("band", "asks")).alias("bands"))  # a row for each band at most
    strings = cut.join(bands, ["a", *own]).select("a", *own, "bytes", "bands").mapInArrow(released(partial(strings_of_bands, length=length)), "a long, distance int, string binary, text_id long, start long, asks boolean")
    strings = materialise(strings, "strings")
    again = materialise(strings.groupBy("a", "distance", "string").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    found = split_join(strings.filter("asks"), again, ["a", "distance", "string"], strings.count(), ["text_id", "start"], "left_semi")
    delete_table(cut)
    return sure.unionByName(found.select("text_id", "start", (F.col("start") + length).alias("stop")))


def distinct_texts(docs: DataFrame, text: str, least: int = LENGTH) -> DataFrame:
    """(sha, text, copies, text_id) of the texts with `least` bytes or more, each once: copies meet before any shuffle."""
    rows = docs.select(F.col(text).alias("text")).filter(F.octet_length("text") >= least)
    rows = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # The number is fixed once the table is written.
    return materialise(rows.withColumn("text_id", F.monotonically_increasing_id()), "texts")


def repeated_spans(texts: DataFrame, batches: int = BATCHES, length: int = LENGTH, prepare=None) -> DataFrame:
    """(text_id, start, stop): a table of spans that cover the bytes to remove, in any order and overlapping.

    With prepare() the bytes are those that it makes of the texts.
    """
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    family = SuffixFamily(spark, length, prepare)
    for i in range(batches):
        family.add(texts.filter(F.pmod(F.xxhash64("sha"), F.lit(batches)) == i))
    rows = materialise(family.candidates(), "candidates")
    for _, level in family.levels:
        delete_table(level)
    total = rows.count()
    pairs = materialise(rows.groupBy("a", "u").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "place")).alias("one")), "pairs")
    sample, before, count = _place()
    sure = split_join(rows, pairs.filter("n > 1").select("a", "u", "n"), ["a", "u"], total, ["text_id", "place"], "left_semi")
    sure = sure.select("text_id", (sample - before).alias("start"), (sample - before + count - 1 + length).alias("stop"))
    # Groups with several u: one text for each u is enough to compare with, and needs an answer itself if it is alone.
    mixed = pairs.groupBy("a").agg(F.count("*").alias("nu"), F.min("n").alias("least")).filter("nu > 1 and least = 1")
    mixed = materialise(mixed.select("a", "nu", F.col("nu").alias("n")), "mixed")
    ones = pairs.select("a", "one.*", (F.col("n") == 1).alias("alone"))
    ones = materialise(split_join(ones, mixed, ["a"], total, ["text_id", "place"]), "ones")

    def cut(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("text_id").agg(F.collect_list(F.struct("a", "place", "alone")).alias("wanted"))
        return texts.select("text_id", "text").join(wanted, "text_id").mapInArrow(released(after(prepare, partial(stretches, length=length))), "a long, text_id long, place long, alone boolean, bytes binary")

    small = cut(ones.filter(F.col("nu") <= GROUP)).repartition(n, "a").sortWithinPartitions("a")
    ends = small.mapInArrow(released(partial(repeated_strings, length=length)), "text_id long, start long, stop long")
    if not mixed.filter(F.col("nu") > GROUP).isEmpty():
        ends = ends.unionByName(large_groups(cut(ones.filter(F.col("nu") > GROUP)), length))
    copies = texts.filter("copies > 1").select("text_id", "text")
    if prepare is not None:
        copies = copies.mapInArrow(released(prepare), "text_id long, text binary").filter(F.octet_length("text") >= length)
    copies = copies.select("text_id", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop"))
    spans = materialise(sure.unionByName(ends).unionByName(copies), "spans")
    for done in (rows, pairs, mixed, ones, *family.matches):
        delete_table(done)
    return spans


def merge_spans(spans: list[dict]) -> list[list[int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text: counts, the digest of the bytes, and the text (bytes of a cut character go too)."""
    for batch in batches:
        out = []
        for sha, copies, text, spans in zip(*(batch.column(c).to_pylist() for c in ("sha", "copies", "text", "spans"))):
            raw, runs = text.encode(), merge_spans(spans)
            kept = b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)]))
            out.append({"sha": sha, "copies": copies, "n_removed": len(raw) - len(kept), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode("utf-8", "ignore")})
        if out:
            yield pa.RecordBatch.from_pylist(out)


def changed_texts(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(sha, copies, n_removed, n_spans, kept_sha256, kept_text) of the texts that lose bytes; sha is the digest of the text."""
    arrow_limits(docs.sparkSession)
    texts = distinct_texts(docs, text)
    spans = repeated_spans(texts, batches)
    spans = spans.groupBy("text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = texts.select("text_id", "sha", "copies", "text").join(spans, "text_id").select("sha", "copies", "text", "spans")
    return rows.mapInArrow(released(cut_texts), "sha string, copies long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, kept: str | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs, and what is left of the text in a column `kept`.

    Null texts count as empty. Texts shorter than LENGTH bytes stay. Equal texts of LENGTH bytes or more go entirely, for
    each of their strings starts in the other copy. Null and repeated keys are separate documents. n_bytes counts the
    text before the removal; kept_sha256 is of all bytes left, the column `kept` lacks those of characters cut in two.
    """
    changed = changed_texts(docs, text, batches)
    changed = materialise(changed if kept else changed.drop("kept_text"), "changed")
    rows = docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")).select("__key", F.octet_length("__text").cast("long").alias("n_bytes"), F.sha2("__text", 256).alias("sha"), *(["__text"] if kept else []))
    # All copies of a text meet one row; those of a text with very many are dealt by their keys.
    rows = split_join(rows, changed.withColumnRenamed("copies", "n"), ["sha"], docs.count(), ["__key"], "left")
    zero = F.lit(0).cast("long")
    left = [F.coalesce("kept_text", "__text").alias(kept)] if kept else []
    return rows.select(F.col("__key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *left)


def word_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with the digests of their words in place of them."""
    for batch in batches:
        at, done = batch.schema.get_field_index("text"), 0
        for texts in groups(batch.column(at)):
            hashes, begins = word_hashes(texts, False)
            digests = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD])
            offsets = (begins * WORD).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(digests)])
            yield batch.slice(done, len(texts)).set_column(at, "text", made)
            done += len(texts)


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the words that the spans of digests cover and the white space after them."""
    for batch in batches:
        out = []
        for sha, text, spans in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "spans"))):
            raw = text.encode()
            starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
            runs = merge_spans([{"start": starts[-(-r["start"] // WORD)], "stop": starts[r["stop"] // WORD]} for r in spans])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)]))
            out.append({"sha": sha, "kept_text": kept.decode()})
        if out:
            yield pa.RecordBatch.from_pylist(out)


def without_passages(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(sha, kept_text) of the texts that lose passages of WORDS words or more which also start elsewhere."""
    arrow_limits(docs.sparkSession)
    texts = distinct_texts(docs, text, 2 * WORDS - 1)
    # The digests are computed where they are read: as large as the texts and not to be compressed, they would cost more on disk.
    spans = repeated_spans(texts, batches, WORDS * WORD, word_digests).groupBy("text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.select("text_id", "sha", "text").join(spans, "text_id").select("sha", "text", "spans").mapInArrow(released(cut_words), "sha string, kept_text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the repeated passages of WORDS words or more cut out of their texts; n_chars follows the text."""
    changed = without_passages(docs).select(F.col("sha").alias("__sha"), F.col("kept_text").alias("__kept"))
    rows = docs.join(changed, F.sha2(F.col("text"), 256) == F.col("__sha"), "left")
    kept = F.coalesce("__kept", "text")
    out = rows.withColumn("text", kept).withColumn("n_chars", F.when(F.col("__sha").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document and, in column text, what is left of it."""
    return remove(table(spark, sf_dir, "documents"), kept="text")
