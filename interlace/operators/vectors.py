"""Nearest vectors by an inverted file: cells around centres, every vector in its cell, a few cells looked through per query.

The centres are fitted on a bounded sample; all vectors are assigned and searched. Equal vectors are one entry of the index.
Cells are divided in blocks, so no task holds a whole large cell; each block gives its best, and the best of all are ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from interlace.plans.registry import read, register

#: Vectors to which the centres are fitted (about so many, drawn by hash), centres at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8
#: Share of the neighbours that lie in the cells looked through, judged on so many vectors of the sample.
RECALL, JUDGED = 0.97, 500
#: Neighbours of a query, vectors of a block, and decimals of a similarity.
NEAREST, BLOCK, DECIMALS = 10, 20_000, 6
#: Queries that a block is compared with in one task (about so many; more are dealt to several), and similarities that a task holds.
ASKED, HELD = 5_000, 2_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; a zero vector stays zero."""
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(sizes == 0, 1, sizes)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of the sample's unit vectors by a few rounds of spherical k-means; empty cells keep their centres."""
    sample = unit(sample)
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


def cells_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest cells hold that share of the k nearest vectors, within the sample and for some of it.

    Neighbours within a sample are farther than those among all vectors, so the number is rather too large than too small.
    """
    sample = unit(sample)
    some = sample[:JUDGED]
    near = some @ sample.T
    best = np.argpartition(-near, min(k, len(sample)) - 1, axis=1)[:, :k]
    own = (sample @ centres.T).argmax(axis=1)
    ranks = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(ranks, own[best], 1), recall, method="higher")) + 1


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, recall: float | None = RECALL) -> DataFrame:
    """(key, place, neighbour, copies, similarity): for each row of queries the k nearest different vectors of rows by cosine.

    neighbour is the smallest key that has the vector, copies how many rows have it; a query's own vector is a neighbour too if
    rows hold it. recall None looks through all cells: exact, at the cost of comparing each query with every vector. Null vectors
    and null queries are left out; all vectors must have one length. Equal similarities are ranked by neighbour.
    """
    spark = rows.sparkSession
    index = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    index = index.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    asked = queries.select(F.col(key).alias("asked"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    total = index.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = [r.v for r in index.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()]  # about SAMPLE at most
    centres = fit_centres(np.array(sample), max(1, min(MOST_CELLS, round(total**0.5)))) if sample else np.zeros((1, 1))
    reach = cells_needed(np.array(sample), centres, k, recall) if recall is not None and sample else len(centres)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        """The nearest cells of each vector, nearest first."""
        near = unit(np.stack(vectors)) @ centres.T
        best = np.argpartition(-near, reach - 1, axis=1)[:, :reach]
        return pd.Series(list(np.take_along_axis(best, np.take_along_axis(-near, best, 1).argsort(axis=1, kind="stable"), 1).astype(np.int32)))

    placed = index.withColumn("cell", cells("v")[0])
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each cell
    left = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = asked.withColumn("cell", F.explode(cells("v")))
    parts = F.broadcast(right.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts")))  # a row for each cell
    left = left.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = right.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("asked", "v"), F.col("parts")).cast("int")).drop("parts")
    right = right.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def best_of(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(some):
            held, wanted, step = unit(np.stack(block["v"])).T, unit(np.stack(some["v"])), max(1, HELD // len(block))
            ids, copies = block["id"].to_numpy(), block["copies"].to_numpy()
            for i, who in enumerate(some["asked"]):
                if i % step == 0:
                    near = np.round(wanted[i : i + step] @ held, DECIMALS)
                order = np.lexsort((ids, -near[i % step]))[:k]
                out.append(pd.DataFrame({"asked": who, "neighbour": ids[order], "copies": copies[order], "similarity": near[i % step][order]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["asked", "neighbour", "copies", "similarity"])

    found = left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInPandas(best_of, "asked long, neighbour long, copies long, similarity double")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select(F.col("asked").alias(key), "place", "neighbour", "copies", "similarity")


def asked_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return rows, rows.filter("vec_id % 100 = 0")


@register("nearest_vectors")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, by the index; recall is tested against the exact ones."""
    return nearest(*asked_of(spark, sf))


@register("nearest_vectors_exact", f"WITH v AS (SELECT min(vec_id) AS id, count(*) AS copies, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding), q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT vec_id, id AS neighbour, copies, round(list_cosine_similarity(q.v, v.v), {DECIMALS}) AS similarity FROM q CROSS JOIN v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS place FROM s) SELECT vec_id, CAST(place AS INT) AS place, neighbour, copies, similarity FROM r WHERE place <= {NEAREST}")
def nearest_vectors_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all cells looked through."""
    return nearest(*asked_of(spark, sf), recall=None)
