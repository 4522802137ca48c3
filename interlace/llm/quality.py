"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure lies above a cutoff. The cutoffs are chosen on labelled holdout rows: in each
stratum and for each rule the strictest cutoff whose share of wrongly rejected good documents is certified, by an exact
binomial test with Bonferroni's correction over all strata, rules and cutoffs tried, to lie under a stated limit.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, materialise, table

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures by rule, as whole numbers, so that cutoffs have no rounding: per thousand words, or hundredths of a character.
MEASURES = {
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_words, 1)",
    "long_words": "100 * word_chars div greatest(n_words, 1)",
}
CUTOFFS = {"symbols": (50, 100, 200, 400, 800), "dup_lines": (5, 10, 20, 40, 80), "long_words": (800, 1000, 1500, 2500)}
#: Share of good documents that a rule may reject in a stratum, and the chance that any of the certificates is wrong.
MAX_FALSE, ALPHA = 0.005, 0.05


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    again = {w for w in windows if w in seen or seen.add(w)}
    total, until = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            total += i + 3 - max(until, i)
            until = i + 3
    return total


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text; bytes.split() splits at the same six characters as the contract's words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=COUNTS)


@F.pandas_udf(T.DoubleType())
def binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k) for X binomial with n draws of chance p, exactly summed."""
    def one(k, n, p):
        if k >= n:
            return 1.0
        a = math.lgamma(n + 1)
        return math.fsum(math.exp(a - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))

    return pd.Series([one(int(a), int(b), c) for a, b, c in zip(k, n, p)])


def with_counts(docs: DataFrame, text: str = "text", to: str = "q") -> DataFrame:
    """docs with a struct column of the counts, of base_failed, and of a measure for each rule; a null text has no words."""
    arrow_limits(docs.sparkSession)
    docs = docs.withColumn(to, counts_udf(F.col(text)))
    base = F.expr(f"{to}.n_words < 50 or 100 * {to}.n_repeat_words > 50 * {to}.n_words").alias("base_failed")
    return docs.withColumn(to, F.struct(f"{to}.*", base))


def certified(good: DataFrame, max_false: float = MAX_FALSE, alpha: float = ALPHA) -> DataFrame:
    """(stratum, rule, cutoff) from good, the labelled good rows (stratum and the counts) that pass the base rules.

    A rule without a certified cutoff in a stratum has no row there and rejects nothing. An empty holdout certifies nothing.
    """
    tests = [(rule, c) for rule, cuts in CUTOFFS.items() for c in cuts]
    cases = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.expr(MEASURES[r]) > c).alias("rejected")) for r, c in tests])
    rows = good.select("stratum", F.explode(cases).alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(F.count("*").alias("n"), F.count_if("t.rejected").alias("k"))
    # A table of strata x rules x cutoffs rows. Where more than the limit is rejected, no sum is needed.
    tried = rows.join(rows.agg(F.count("*").alias("m")))
    tried = tried.filter(F.col("k") <= F.col("n") * max_false)
    sure = tried.filter(binomial_cdf(F.col("k"), F.col("n"), F.lit(max_false)) <= F.lit(alpha) / F.col("m"))
    return sure.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def verdicts(docs: DataFrame, cutoffs: DataFrame, to: str = "q") -> DataFrame:
    """docs (with 'stratum' and the counts in struct `to`) and a column kept: base rules passed and no certified cutoff exceeded.

    cutoffs has a row for each stratum at most, so the join keeps the rows of docs as they are.
    """
    wide = cutoffs.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.first("cutoff")).select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in CUTOFFS])
    rows = docs.join(wide, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    over = F.lit(False)
    for rule in CUTOFFS:
        value = F.expr(MEASURES[rule].replace("n_", f"{to}.n_").replace("word_chars", f"{to}.word_chars"))
        over = over | F.coalesce(value > F.col(f"__{rule}"), F.lit(False))
    return rows.withColumn("kept", ~F.col(f"{to}.base_failed") & ~over).drop("__stratum", *[f"__{r}" for r in CUTOFFS])


def good_rows(counted: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The counted rows (key, stratum, q) whose label is quality 1 and that pass the base rules; repeated labels count once."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias(key)).distinct()
    return counted.join(good, key, "left_semi").filter("not q.base_failed").select("stratum", "q.*")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, the counts, base_failed, kept) for every row of docs.

    Null texts and texts under 50 words fail the base rules. Null strata form a stratum of their own. Repeated rows are
    judged alike. The counts are written to the shared folder, so that each text is counted once.
    """
    return judged(docs, labels, key, text, stratum).select(key, "stratum", "q.*", "kept")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, hash, stratum, q, kept) for every row of docs; hash is the XXH64 of the text."""
    rows = docs.select(F.col(key), F.xxhash64(text).alias("hash"), F.col(stratum).alias("stratum"), F.col(text))
    counted = materialise(with_counts(rows, text).select(key, "hash", "stratum", "q"), "quality")
    return verdicts(counted, certified(good_rows(counted, labels, key)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    Rows with equal ids are told apart by their texts and strata.
    """
    kept = judged(docs, table(spark, sf_dir, "labels")).filter("kept").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("stratum").alias("__stratum")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")) & F.col("lang").eqNullSafe(F.col("__stratum"))
    return docs.join(kept, same, "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CASES = ", ".join(f"('{r}', {c})" for r, cuts in CUTOFFS.items() for c in cuts)
_VALUE = "CASE rule " + " ".join(f"WHEN '{r}' THEN {e.replace(' div ', ' // ')}" for r, e in MEASURES.items()) + " END"
SQL = rf"""
WITH w AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN again USING (doc_id, g)) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT doc_id, stratum, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS (SELECT f.*, rule, cutoff, {_VALUE} > cutoff AS rejected FROM f CROSS JOIN (VALUES {_CASES}) AS t(rule, cutoff)),
k AS (SELECT stratum, rule, cutoff, count(*) AS n, CAST(count_if(rejected) AS BIGINT) AS k, count(*) OVER () AS m FROM v
      WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
sure AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM k WHERE k <= n * {MAX_FALSE} AND
      (k >= n OR list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({MAX_FALSE}) + (n - j) * ln(1 - {MAX_FALSE})))) <= {ALPHA} / m) GROUP BY ALL),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN sure s ON v.stratum IS NOT DISTINCT FROM s.stratum AND v.rule = s.rule AND v.cutoff = s.cutoff WHERE rejected)
SELECT f.*, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""
