"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent n-grams of letters, most frequent first. A document is in the language
whose profile is nearest by the out-of-place distance: the sum, over the document's n-grams, of how far each lies from its
place in the language's profile, with a fixed distance for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_limits, released, table

#: n-grams of a profile (a language's, a document's), and letters of the longest.
PROFILE, LONGEST = 400, 3
#: Bounds of what is learned from: languages (those with the most rows), and rows of each (a draw of about that many by hash).
LANGUAGES, ROWS = 1000, 5000
#: One document in so many is held out, and the answer for texts without letters.
FOLDS, UNKNOWN = 5, "und"
#: Bits of a code point inside an n-gram's number, and the code of the mark at both ends of a word.
BITS, MARK = 21, 1


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


LETTERS = _letters()


def grams(text: str) -> np.ndarray:
    """The numbers of all n-grams of the words of a text, in lower case. A word is a run of letters with a mark at both ends;
    the mark counts as a letter, but is no n-gram by itself. A number holds the code points, the last lowest."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[~LETTERS[points]] = MARK
    points = np.concatenate([[MARK], points, [MARK]])
    points = points[(points != MARK) | np.r_[True, points[:-1] != MARK]]  # one mark between two words
    letter = points != MARK
    found, numbers = [points[letter]], points
    for n in range(2, min(LONGEST, len(points)) + 1):
        numbers = numbers[:-1] << BITS | points[n - 1 :]
        inner = np.ones(len(numbers), bool)
        for i in range(1, n - 1):  # a mark in the middle would join two words
            inner &= letter[i : i + len(numbers)]
        found.append(numbers[inner])
    return np.concatenate(found)


def most_frequent(numbers: np.ndarray, limit: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the numbers, and their places from 0; equally frequent ones share the mean of their places.

    Where the limit falls among equally frequent ones, the smaller numbers are in.
    """
    distinct, counts = np.unique(numbers, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:limit]
    counts = counts[order]
    heads = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])[: len(counts)]
    sizes = np.diff(np.r_[heads, len(counts)])
    return distinct[order], np.repeat(heads + (sizes - 1) / 2, sizes)


class Profiles:
    """The profiles of all languages: their n-grams in ascending order, and the place of each in each language."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        """rows: (language, number of an n-gram, its place)."""
        self.names = sorted({r[0] for r in rows})
        self.numbers = np.array(sorted({r[1] for r in rows}), np.int64)
        self.places = np.full((len(self.numbers) + 1, len(self.names)), -1, np.int32)  # the last row is for unknown n-grams
        which = {name: i for i, name in enumerate(self.names)}
        at = np.searchsorted(self.numbers, np.array([r[1] for r in rows], np.int64))
        self.places[at, [which[r[0]] for r in rows]] = [r[2] for r in rows]

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name among equally near ones, and by how much the next is farther, from 0 to 1.

        With one language alone the second number is its nearness. No letters, or no language known: UNKNOWN and 0.
        """
        numbers = grams(text or "")
        if not len(numbers) or not self.names:
            return UNKNOWN, 0.0
        numbers, places = most_frequent(numbers)
        at = np.searchsorted(self.numbers, numbers)
        at[at == len(self.numbers)] = 0
        at = np.where(self.numbers[at] == numbers, at, len(self.numbers))
        known = self.places[at]
        distance = np.where(known < 0, PROFILE, np.abs(known - places[:, None])).sum(axis=0)
        best = int(distance.argmin())
        second = float(PROFILE * len(numbers)) if len(self.names) == 1 else float(np.partition(distance, 1)[1])
        return self.names[best], (second - float(distance[best])) / second if second else 0.0


def learn(labelled: DataFrame, language: str = "lang", text: str = "text", languages: int = LANGUAGES, rows: int = ROWS) -> DataFrame:
    """(language, number, place): the profiles of the languages of the labelled rows; rows without a language are left out.

    Learned from the `languages` most frequent labels and about `rows` rows of each at most, drawn by the hash of the text, so
    the result has languages x PROFILE rows at most. n-grams are counted inside the tasks before they are shuffled.
    """
    known = labelled.select(F.col(language).alias("language"), F.coalesce(text, F.lit("")).alias("t")).filter(F.col("language").isNotNull())
    sizes = known.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(languages)
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n"))
    drawn = known.join(F.broadcast(sizes), "language").filter(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < share * (1 << 40)).select("language", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(name, []).append(t)
            for name, some in texts.items():
                numbers, counts = np.unique(grams("\n".join(some)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(numbers), pa.string()), pa.array(numbers), pa.array(counts, pa.int64())], ["language", "number", "n"])

    arrow_limits(labelled.sparkSession)
    counts = drawn.mapInArrow(released(run), "language string, number long, n long").groupBy("language", "number").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "number"))
    return counts.withColumn("place", place - 1).filter(F.col("place") < PROFILE).select("language", "number", "place")


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", to: str = "language") -> DataFrame:
    """docs with a struct column `to` of lang_pred and score, from the text alone.

    profiles comes from learn(), by which its size is bounded; the tasks get it as a whole.
    """
    known = Profiles([(r.language, r.number, r.place) for r in profiles.collect()])

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([known.judge(t) for t in texts], columns=["lang_pred", "score"])

    arrow_limits(docs.sparkSession)
    return docs.withColumn(to, judged(F.col(text)))


def held_out(key: Column) -> Column:
    """Whether a document is held out, by the checksum of its key; one without a key is."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of docs; profiles are learned from the rows that are not held out.

    lang_pred is UNKNOWN, with score 0, where the text is null or has no letter, or where no language could be learned.
    Equal texts have equal predictions. Columns of docs other than these are not read.
    """
    profiles = learn(docs.filter(~held_out(F.col(key))), language, text)
    rows = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("t"))
    return predict(rows, profiles, "t", "p").select(key, "held_out", "p.lang_pred", "p.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
