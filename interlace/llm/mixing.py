"""Mixing to target weights with soft domain membership. DataFrame functions only.

A naive Bayes classifier over the beginnings of words and a few measures of the text, fitted on labelled rows, gives each
document evidence for each domain. Other labelled rows say how often each domain occurs among documents of like evidence
and length: that share is the posterior. Rates (expected numbers of copies) are then fitted so that the expected tokens
of each domain meet their targets: least squares over the domain totals, by projected gradient steps. A step needs only
sums for each domain and pair of domains. Documents of one bin have one posterior and so one rate: a single pass sums the
tokens of each bin, the steps run over the bins, and a join with the bins gives each document its rate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_table, materialise, table, text_of

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.97, "low": 0.03, "toxic": 0.0}
#: Labelled rows that the classifier is fitted on at most (those with the least hashes), and hash buckets of features.
MAX_LABELLED, BUCKETS = 20_000, 1 << 17
#: Strength of the prior that a feature says nothing, in documents, and the log ratio from which a feature counts at all.
PRIOR, TELLING = 10.0, 1.0
#: Letters of a word that count, signs that are counted, and bins of these measures.
LETTERS, SIGNS, BINS = 6, "#*$%&|<>!", 7
#: Limits between bins of evidence and of words, and strength of a coarser estimate in a bin, in documents.
EVIDENCE, LENGTHS, SMOOTH = (0.5, 1.5, 3.0, 5.0), (100, 300, 1000), 1.0
#: Gradient steps at most, and the relative error at which they end.
STEPS, ENOUGH = 20, 1e-9
#: Distance from its bound within which a rate counts as bound.
NEAR = 0.1
#: Bins of evidence and length: as many different posteriors there are at most.
BINNED = (len(EVIDENCE) + 1) ** 2 * (len(LENGTHS) + 1)
#: The pipeline's stage: posterior from which a document is taken for toxic, and copies of a document at most.
SURE, MOST = 0.7, 2.0
#: Copies of a document at most in the query. Without a bound a small table meets its targets with a few documents alone: at 1,000
#: documents 131 of them held 95 hundredths of the tokens. The price is a mix that is farther from the targets there.
COPIES = 8.0


def domain_of(quality: Column, toxic: Column) -> Column:
    """Index of the domain of a label; null where the label says nothing."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _share_bin(name: str, count: Column, of: Column, scale: int) -> Column:
    """The name and a logarithmic bin of scale * count / of."""
    bin_ = F.least(F.lit(BINS - 1), F.floor(F.log2(1 + scale * count / F.greatest(of, F.lit(1)))))
    return F.concat(F.lit(name), bin_.cast("string"))


def features_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, hash, n_tokens, buckets) for every row of docs: the distinct buckets of its features.

    Features are the beginnings of words (runs of letters, lower case), and three measures of the text by their bins: the
    shares of signs, of ASCII capitals and of words that occurred before. n_tokens counts words between white space, one
    more for the document's end; hash is the XXH64 of the text. Each step is a column of its own, so that it is computed
    once, and the table is written, for the classifier reads it three times.
    """
    t, words, distinct, parts = F.col("__text"), F.col("__words"), F.col("__distinct"), F.col("__parts")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.xxhash64(text).alias("hash"), text_of(text).alias("__text"))
    rows = rows.withColumn("__parts", F.split(t, r"[\x20\x09-\x0D]+")).withColumn("__words", F.array_remove(F.split(F.lower(t), r"[^\p{L}]+"), ""))
    ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    rows = rows.withColumn("__distinct", F.array_distinct(words)).withColumn("n_tokens", (F.size(parts) - ends + 1).cast("long"))
    count = lambda signs: F.length(F.regexp_replace(t, f"[^{signs}]+", ""))
    measures = F.array(
        _share_bin(" signs", count(SIGNS), F.size(words), 100), _share_bin(" capitals", count("A-Z"), F.length(t), 20),
        F.concat(F.lit(" again"), F.floor(10 * (F.size(words) - F.size(distinct)) / F.greatest(F.size(words), F.lit(1))).cast("string")),
    )
    bucket = lambda w: F.pmod(F.xxhash64(F.substring(w, 1, LETTERS)), F.lit(BUCKETS)).cast("int")
    measured = [F.pmod(F.xxhash64(measures[i]), F.lit(BUCKETS)).cast("int") for i in range(3)]
    rows = rows.withColumn("buckets", F.array_distinct(F.concat(F.transform(distinct, bucket), F.array(*measured))))
    return materialise(rows.select("row", key, "hash", "n_tokens", "buckets"), "features")


def labelled(labels: DataFrame, key: str) -> DataFrame:
    """(key, domain, fold) of MAX_LABELLED labelled rows at most; fold 0 fits the evidence, fold 1 the posteriors.

    Of different labels of one key the worst counts. The table is small by its limit, so it may be broadcast.
    """
    known = labels.select(F.col("doc_id").alias(key), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter(F.col(key).isNotNull() & F.col("domain").isNotNull())
    known = known.groupBy(key).agg(F.max("domain").alias("domain")).orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    return materialise(known.withColumn("fold", F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(2)).cast("int")), "labelled")


def feature_weights(features: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """(bucket, w0..w2): by how much a feature's chance in a domain exceeds its chance in all, as a logarithm.

    Features count once in a document. Only telling ones have weights: those that some domain has e times as often as all
    documents or more. Small differences, such as between languages, would else add up over a long text and outweigh them.
    The table has BUCKETS rows at most, so it may be broadcast. Without labelled rows no feature has a weight.
    """
    d = range(len(DOMAINS))
    known = known.filter("fold = 0")
    by = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}  # a row for each domain
    total = sum(by.values())
    rows = features.join(F.broadcast(known), key).select("domain", F.explode("buckets").alias("bucket"))
    counts = rows.groupBy("bucket").agg(*[F.count_if(F.col("domain") == i).alias(f"c{i}") for i in d])
    all_ = sum((F.col(f"c{i}") for i in d), F.lit(0))
    inside = [(F.col(f"c{i}") + PRIOR * by.get(i, 0) / max(1, total)) / (by.get(i, 0) + PRIOR) for i in d]
    weights = [F.log(inside[i] * (total + PRIOR) / (all_ + PRIOR)).alias(f"w{i}") if by.get(i) else F.lit(0.0).alias(f"w{i}") for i in d]
    return materialise(counts.select("bucket", *weights).filter(F.greatest(*[f"w{i}" for i in d]) >= TELLING), "words")


def evidence(features: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(row, key, hash, n_tokens, b1, b2, length) for every row: bins of the evidence against the first domain."""
    rows = features.select("row", key, "hash", "n_tokens", F.explode("buckets").alias("bucket"))  # the measures are never missing
    # All features of a row are in one task: they are summed before the shuffle.
    rows = rows.join(F.broadcast(weights), "bucket", "left").groupBy("row").agg(
        *[F.first(c).alias(c) for c in (key, "hash", "n_tokens")], *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(DOMAINS))]
    )
    level = lambda x, limits: reduce(lambda a, b: a + b, [(x >= c).cast("int") for c in limits])
    return rows.select("row", key, "hash", "n_tokens", *[level(F.col(f"s{i}") - F.col("s0"), EVIDENCE).alias(f"b{i}") for i in (1, 2)], level(F.col("n_tokens"), LENGTHS).alias("length"))


def calibration(cells: DataFrame) -> DataFrame:
    """(b1, b2, length, p0..p2) for each bin, from labelled rows (b1, b2, length, domain): the shares of the domains in it.

    A bin's shares are drawn to those of its evidence at any length, and these to the shares of all, as by SMOOTH rows.
    """
    d = range(len(DOMAINS))
    counts = [F.count_if(F.col("domain") == i).alias(f"n{i}") for i in d]
    total = cells.agg(*counts).first()
    share = [(total[i] + 1) / (sum(total) + len(DOMAINS)) for i in d]
    n, m = len(EVIDENCE) + 1, len(LENGTHS) + 1
    grid = cells.sparkSession.range(n * n * m).selectExpr(f"CAST(id DIV {n * m} AS INT) AS b1", f"CAST(id DIV {m} % {n} AS INT) AS b2", f"CAST(id % {m} AS INT) AS length")

    def drawn(rows: DataFrame, keys: list[str], to: list[Column], name: str) -> DataFrame:
        rows = rows.join(cells.groupBy(*keys).agg(*counts), keys, "left").fillna(0, [f"n{i}" for i in d])
        whole = sum((F.col(f"n{i}") for i in d), F.lit(0)) + SMOOTH
        return rows.select(*grid.columns, *[((F.col(f"n{i}") + SMOOTH * to[i]) / whole).alias(f"{name}{i}") for i in d])

    coarse = drawn(grid, ["b1", "b2"], [F.lit(x) for x in share], "q")
    return drawn(coarse, ["b1", "b2", "length"], [F.col(f"q{i}") for i in d], "p")


def posteriors(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, hash, n_tokens, p0..p2) for every row of docs.

    Null and empty texts are judged by their measures like others. Null and repeated keys are rows of their own.
    """
    known, features = labelled(labels, key), features_of(docs, key, text)
    weights = feature_weights(features, known, key)
    some = features.join(F.broadcast(known.filter("fold = 1").select(key)), key)
    cells = materialise(evidence(some, weights, key).join(F.broadcast(known), key).select("b1", "b2", "length", "domain"), "cells")
    rows = evidence(features, weights, key).join(F.broadcast(calibration(cells)), ["b1", "b2", "length"])  # a row for each bin
    return rows.select("row", key, "hash", "n_tokens", *[f"p{i}" for i in range(len(DOMAINS))])


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small symmetric system, by elimination with a ridge of a millionth of the trace."""
    n = len(right)
    ridge = 1e-6 * sum(matrix[i][i] for i in range(n)) / n + 1e-12
    rows = [[*matrix[i], right[i]] for i in range(n)]
    for i in range(n):
        rows[i][i] += ridge
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for r in range(n):
            if r != i:
                share = rows[r][i] / rows[i][i]
                rows[r] = [a - share * b for a, b in zip(rows[r], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def in_place(rows: DataFrame, name: str) -> DataFrame:
    """A table of the bins, which has BINNED rows at most, as literal values of the plan: cuts the lineage without a file."""
    names, values = ", ".join(rows.columns), ", ".join("(" + ", ".join(f"{float(x)!r}D" for x in r) + ")" for r in rows.collect())
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in rows.columns)
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS {name}({names})" if values else f"SELECT {none} WHERE false")


def fit_rates(rows: DataFrame, targets: list[float], least: Column | None = None, most: float = math.inf, keep=materialise) -> DataFrame:
    """rows (n_tokens, p0..) with a column rate from least (zero if not given) to most, fitted to the domains' target totals.

    keep(rows, name) writes the rates of a step; in_place() does it for small tables.

    Minimises the squared distance of the totals from the targets, whether or not they can be met. A step moves along the
    gradient as it is and as scaled by the Gram matrix of the rates that are free to move, is projected onto the bounds,
    and the best of a few lengths is taken. Only sums come to the driver: one for each domain, pair of domains and length.
    """
    d = range(len(targets))
    rows = rows.withColumn("least", F.lit(0.0) if least is None else least.cast("double")).withColumn("rate", F.greatest(F.lit(1.0), "least"))
    # Expressions are texts here: each step builds some hundred of them.
    inside = lambda rate: f"greatest(least, {rate})" if most == math.inf else f"least({most!r}D, greatest(least, {rate}))"
    along = lambda move: "(" + " + ".join(f"p{i} * ({move[i]!r}D)" for i in d) + ")"
    totals = lambda rate: [F.expr(f"coalesce(sum({rate} * n_tokens * p{i}), 0D)") for i in d]

    def squares(sums) -> float:
        return math.fsum((x - t) ** 2 for x, t in zip(sums, targets))

    sums = list(rows.agg(*totals("rate")).first())
    pairs = [(i, j) for i in d for j in d if i <= j]
    # Lengths of the steps along the scaled and along the plain gradient; all are tried at once.
    ways = [(True, x) for x in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)] + [(False, x) for x in (1.0, 2.0, 4.0, 16.0)]
    way = "explode(array(" + ", ".join(f"struct({k} AS k, {str(x).lower()} AS scaled, {y!r}D AS length)" for k, (x, y) in enumerate(ways)) + ")) AS way"
    for step in range(STEPS):
        if squares(sums) <= (ENOUGH * max(1.0, math.fsum(targets))) ** 2:
            break
        error = [x - t for x, t in zip(sums, targets)]
        # Rates at or near their bound that the gradient pushes further out stay out of the metric and follow the gradient.
        free = f"((rate > least + {NEAR} OR {along(error)} < 0)" + (")" if most == math.inf else f" AND (rate < {most - NEAR!r}D OR {along(error)} > 0))")
        grams = rows.agg(*[F.expr(f"coalesce(sum(CASE WHEN {keep_} THEN n_tokens * p{i} * p{j} END), 0D)") for keep_ in (free, "true") for i, j in pairs]).first()
        gram = [[0.0] * len(targets) for _ in d]
        for (i, j), x in zip(pairs, grams):
            gram[i][j] = gram[j][i] = x
        bound = sum(x for (i, j), x in zip(pairs, grams[len(pairs) :]) if i == j) or 1.0
        newton, plain = solve(gram, error), [x / bound for x in error]
        step_to = lambda scaled, length: inside(f"(rate - {length} * CASE WHEN {scaled} AND {free} THEN {along(newton)} ELSE {along(plain)} END)")  # noqa: B023, E731
        moved = rows.selectExpr("*", way).selectExpr("way.k", "n_tokens", *[f"p{i}" for i in d], step_to("way.scaled", "way.length") + " AS moved")
        found = {r.k: list(r)[1:] for r in moved.groupBy("k").agg(*totals("moved")).collect()}  # a row for each length
        best = min(found, key=lambda k: squares(found[k]), default=None)
        if best is None or squares(found[best]) >= squares(sums) * (1 - 1e-9):
            break
        # Kept at each step: else the expression of the rates would hold all steps before.
        before, sums = rows, found[best]
        scaled, length = ways[best]
        rows = keep(rows.withColumn("rate", F.expr(step_to(str(scaled).lower(), f"{length!r}D"))), "rates")
        if step and keep is materialise:
            delete_table(before)
    return rows.drop("least")


def targets_of(rows: DataFrame, weights: dict[str, float], least: Column | None = None) -> list[float]:
    """Token totals in the proportions of weights.

    Without lower bounds of a size that keeps the first domain's natural total. With them of the least size at which no wanted
    domain is above its target at its lower bounds already, but never larger than the corpus is: a target that the bounds put
    out of reach must not be made up for by copies of everything else.
    """
    totals = lambda factor: [F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{i}") * factor), F.lit(0.0)) for i in range(len(DOMAINS))]
    now = rows.agg(*totals(1)).first()
    bound = now if least is None else rows.agg(*totals(least)).first()
    sizes = [bound[i] / weights[x] for i, x in enumerate(DOMAINS) if weights[x] > 0]
    size = sizes[0] if least is None else min(max(sizes), sum(now))
    return [size * weights[x] for x in DOMAINS]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text", least: Column | None = None, most: float = math.inf) -> DataFrame:
    """(row, key, hash, n_tokens, p_good, p_low, p_toxic, rate, off_good, off_low, off_toxic) for every row of docs.

    least and most: bounds of the rates; least is an expression over p0..p2, zero if not given. off_x is by how much the
    domain's share of the expected tokens differs from its target, the same for all rows. An empty table gives no rows.
    Documents of equal posteriors have equal rates, so the fit runs on the bins (BINNED at most) with the tokens of each.
    """
    rows = materialise(posteriors(docs, labels, key, text), "posteriors")
    p = [f"p{i}" for i in range(len(DOMAINS))]
    bins = in_place(rows.groupBy(*p).agg(F.sum("n_tokens").alias("n_tokens")), "bins")
    fitted = in_place(fit_rates(bins, targets_of(bins, weights, least), least, most, in_place), "fitted")
    sums = fitted.agg(*[F.coalesce(F.sum(F.col("rate") * F.col("n_tokens") * F.col(c)), F.lit(0.0)) for c in p]).first()
    off = [F.lit(sums[i] / (sum(sums) or 1.0) - weights[x] / sum(weights.values())).alias(f"off_{x}") for i, x in enumerate(DOMAINS)]
    rows = rows.join(F.broadcast(fitted.select(*p, "rate")), p)
    return rows.select("row", key, "hash", "n_tokens", *[F.col(f"p{i}").alias(f"p_{x}") for i, x in enumerate(DOMAINS)], "rate", *off)


def stage_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """mix() under the pipeline's bounds: a document that the classifier is not sure is toxic keeps one copy at least, and has
    MOST at most; the others may go. So no clean document is lost; the price is that what is toxic and stays under SURE, and the
    low documents that stay, keep the mix from its targets by off_good, off_low and off_toxic."""
    return mix(docs, labels, least=(F.col("p2") < SURE).cast("double"), most=MOST)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their rate in stage_rates() says (its fraction decided by a hash of the id), columns as
    they came. Rates belong to an id and its text."""
    rates = stage_rates(docs, table(spark, sf_dir, "labels"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    times = rates.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(F.max("rate").alias("__rate")).filter("__rate > 0")
    rows = docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    rows = rows.withColumn("__n", F.floor(F.col("__rate") + chance).cast("int")).filter("__n > 0")
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), most=COPIES).drop("row", "hash")
