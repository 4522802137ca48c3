import math
import random
import re

import numpy as np
import pytest
import xxhash

from interlace.llm import mixing
from pyspark.sql import functions as F

from .cases import documents, empty

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=600):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "low", "toxic"])
        words = rng.choices(common, k=60) + {"good": ["and"], "low": ["|"] * 5, "toxic": ["awful", "nasty"]}[kind]
        rng.shuffle(words)
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return spark.createDataFrame(rows, "doc_id long, text string, kind string"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_targets(spark):
    docs, labels = corpus(spark)
    rows = mixing.mix(docs, labels, {"good": 0.5, "low": 0.25, "toxic": 0.25}).join(docs.select("doc_id", "kind"), "doc_id").filter("doc_id % 2 = 0").toPandas()
    best = rows[[f"p_{x}" for x in mixing.DOMAINS]].to_numpy().argmax(axis=1)
    assert np.mean([mixing.DOMAINS[b] == k for b, k in zip(best, rows["kind"])]) > 0.97
    every = mixing.mix(docs, labels, {"good": 0.5, "low": 0.25, "toxic": 0.25}).toPandas()
    totals = [float((every["rate"] * every["n_tokens"] * every[f"p_{x}"]).sum()) for x in mixing.DOMAINS]
    assert np.allclose(np.array(totals) / sum(totals), [0.5, 0.25, 0.25], atol=1e-4) and (every["rate"] >= 0).all()


def brute_posteriors(rows, known):
    """p0..p2 by id, step by step over dictionaries; rows are (id, text), known is {id: (domain, fold)}."""
    low = lambda t: re.findall(r"[^\W\d_]+", t.lower())

    def features(t):
        words, names = low(t), set()
        share = lambda name, count, of, scale: f" {name}{min(mixing.BINS - 1, math.floor(math.log2(1 + scale * count / max(1, of))))}"
        names.add(share("signs", sum(c in mixing.SIGNS for c in t), len(words), 100))
        names.add(share("capitals", sum("A" <= c <= "Z" for c in t), len(t), 20))
        names.add(f" again{10 * (len(words) - len(set(words))) // max(1, len(words))}")
        digest = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
        return {(h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS for h in map(digest, names | {w[: mixing.LETTERS] for w in words})}

    found = {i: features(t) for i, t in rows}
    size = [sum(d == k and f == 0 for d, f in known.values()) for k in range(3)]
    total, counts = sum(size), {}
    for i, (d, f) in known.items():
        for x in found[i] if f == 0 else ():
            counts.setdefault(x, [0, 0, 0])[d] += 1
    weights = {}
    for x, c in counts.items():
        w = [math.log((c[k] + mixing.PRIOR * size[k] / total) / (size[k] + mixing.PRIOR) * (total + mixing.PRIOR) / (sum(c) + mixing.PRIOR)) for k in range(3)]
        if max(w) >= mixing.TELLING:
            weights[x] = w

    def cell(i, t):
        s = [math.fsum(weights[x][k] for x in found[i] if x in weights) for k in range(3)]
        level = lambda v, limits: sum(v >= c for c in limits)
        return (*(level(s[k] - s[0], mixing.EVIDENCE) for k in (1, 2)), level(len(t.split()) + 1, mixing.LENGTHS))

    cells = {i: cell(i, t) for i, t in rows}
    seen = [(cells[i], d) for i, (d, f) in known.items() if f == 1]
    share = [(sum(d == k for _, d in seen) + 1) / (len(seen) + 3) for k in range(3)]
    out = {}
    for i, c in cells.items():
        p = share
        for part in (2, 3):
            n = [sum(x[:part] == c[:part] and d == k for x, d in seen) for k in range(3)]
            p = [(n[k] + mixing.SMOOTH * p[k]) / (sum(n) + mixing.SMOOTH) for k in range(3)]
        out[i] = p
    return out


def test_posteriors_match_brute_force(spark):
    docs, labels = corpus(spark)
    known = {r.doc_id: (r.domain, r.fold) for r in mixing.labelled(labels, "doc_id").collect()}
    assert len(known) == labels.count() and {f for _, f in known.values()} == {0, 1}
    want = brute_posteriors([(r.doc_id, r.text) for r in docs.collect()], known)
    got = {r.doc_id: (r.p0, r.p1, r.p2) for r in mixing.posteriors(docs, labels).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_held_out_toxic_recall_calibration_and_mix_of_the_tables(spark):
    """Fitted on even ids, judged on odd ones; and the mix of all rows is within a hundredth of its targets."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 2 = 1").select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rows = mixing.posteriors(docs, labels.filter("doc_id % 2 = 0")).join(held, "doc_id").toPandas()
    assert (rows[rows.domain == 2].p2 >= 0.5).mean() >= 0.75 and rows[rows.domain == 0].p2.mean() <= 0.03
    assert all(abs(rows[f"p{i}"].mean() - (rows.domain == i).mean()) <= 0.03 for i in range(3))
    off = mixing.mix(docs, labels).select(*[f"off_{x}" for x in mixing.DOMAINS]).distinct().collect()
    assert len(off) == 1 and max(map(abs, off[0])) <= 0.01


def test_query_has_a_bound_of_copies_and_states_its_distance(spark):
    """On a small table the bound keeps the targets out of reach; how far is stated and is no more than this."""
    rows = mixing.query(spark, "/root/testdata/sf0.01").toPandas()
    assert rows.rate.between(0, mixing.COPIES).all()
    off = [rows[f"off_{x}"].iloc[0] for x in mixing.DOMAINS]
    reached = [(rows.rate * rows.n_tokens * rows[f"p_{x}"]).sum() / (rows.rate * rows.n_tokens).sum() for x in mixing.DOMAINS]
    assert np.allclose(off, np.array(reached) - np.array([mixing.TARGETS[x] for x in mixing.DOMAINS]), atol=1e-9) and max(map(abs, off)) <= 0.045


def test_stage_never_makes_the_corpus_larger_than_its_bounds_ask(spark):
    """Targets out of reach are not made up for by copies of everything: expected tokens stay near those of the input."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.stage_rates(docs, labels).toPandas()
    stays = rows.p_toxic < mixing.SURE
    assert (rows.rate[stays] >= 1).all() and (rows.rate <= mixing.MOST).all()
    # The targets add up to the corpus at most; what the bounds keep of the other domains comes on top.
    kept = (rows.n_tokens * (rows.p_low + rows.p_toxic))[stays].sum()
    assert (rows.rate * rows.n_tokens).sum() <= rows.n_tokens.sum() + kept
    reached = [(rows.rate * rows.n_tokens * rows[f"p_{x}"]).sum() / (rows.rate * rows.n_tokens).sum() - mixing.TARGETS[x] for x in mixing.DOMAINS]
    assert np.allclose([rows[f"off_{x}"].iloc[0] for x in mixing.DOMAINS], reached, atol=1e-9)


def test_plan_has_no_python(spark):
    docs, labels = corpus(spark, 40)
    for rows in (mixing.posteriors(docs, labels), mixing.mix(docs, labels)):
        plan = rows._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rates_stay_under_their_bound(spark):
    rows = spark.createDataFrame([(i, 10, *((0.9, 0.1, 0.0) if i % 2 else (0.1, 0.9, 0.0))) for i in range(20)], "i int, n_tokens long, p0 double, p1 double, p2 double")
    rates = {r.i % 2: r.rate for r in mixing.fit_rates(rows, [400.0, 60.0, 0.0], F.lit(1.0), 2.0).collect()}
    assert abs(rates[1] - 2) < 1e-6 and 1 <= rates[0] <= 1.5


@pytest.mark.parametrize("targets, least", [([300.0, 200.0, 0.0], 0.0), ([900.0, 10.0, 40.0], 0.0), ([50.0, 20.0, 10.0], 0.5)])
def test_rates_reach_the_least_squares_optimum(spark, targets, least):
    rng = np.random.default_rng(3)
    n = 40
    p, t = rng.dirichlet([0.4] * 3, n), rng.integers(1, 30, n)
    rows = spark.createDataFrame([(i, int(a), *map(float, q)) for i, (a, q) in enumerate(zip(t, p))], "i int, n_tokens long, p0 double, p1 double, p2 double")
    got = np.array([r.rate for r in mixing.fit_rates(rows, targets, F.lit(least)).orderBy("i").collect()])
    design = (p * t[:, None]).T
    rate = np.ones(n)
    for _ in range(100_000):  # plain projected gradient in the metric of the tokens
        rate = np.maximum(least, rate - 0.5 / (design @ (design / t).T).max() / t * (design.T @ (design @ rate - targets)))
    value = lambda r: float(((design @ r - targets) ** 2).sum()) ** 0.5
    assert (got >= least).all() and value(got) <= value(rate) + 5e-3 * sum(targets)


def test_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 1), (5, None, 1)], LABELS)
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == 13 and all(r.rate >= 0 and abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)
    assert mixing.mix(docs, spark.createDataFrame([], LABELS)).count() == 13
    assert mixing.mix(empty(spark), labels).count() == 0


def test_stage_drops_what_is_toxic(spark, tmp_path):
    docs, labels = corpus(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = mixing.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    ids = {r.kind: r.n for r in out.groupBy("kind").agg(F.countDistinct("doc_id").alias("n")).collect()}
    there = {r.kind: r["count"] for r in docs.groupBy("kind").count().collect()}
    assert ids["good"] == there["good"] and ids["low"] == there["low"] and ids.get("toxic", 0) <= 0.02 * there["toxic"]
