"""Fill-in-middle transformation. DataFrame functions only.

A text is cut into units (a run of ASCII letters, or any other character). Two cuts, fixed by a hash of the document's key,
divide the units into prefix, middle and suffix. The number of units comes from regexp_count; a pattern of the row's own,
with as many possessive repetitions of the unit as each piece has, captures the three pieces in one match, and the
replacement puts them in the order of the form. Possessive groups keep no way back, so long texts need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How many texts of a hundred are transformed, and how many of these put the suffix first; the seed of the hashes.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1
#: What the captured pieces become, by form.
ORDERS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every row of docs; n is the number of units.

    Empty and null texts, texts that hold a marker, and those that the rate leaves out are plain: the output is the text, and
    the two lengths are null. Rows with equal keys and texts come out alike; columns of docs other than these are not read.
    """
    h1, h2, h3, h4 = (F.col(f"h{i}") for i in (1, 2, 3, 4))
    n, t = F.col("n"), F.col("t")
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    rows = rows.select("k", "t", F.regexp_count("t", F.lit(UNIT)).cast("long").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("k"), seed), 1)])
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((n == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("k", "t", "n", form.alias("form"), F.least(h1 % (n + 1), h2 % (n + 1)).alias("a"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("b"))
    group = lambda count: F.concat(F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("(?s)^"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"(.*)\z"))
    replacement = F.when(F.col("form") == "spm", ORDERS["spm"]).otherwise(ORDERS["psm"])
    rows = rows.select("k", "n", "form", F.when(F.col("form") == "plain", t).otherwise(F.regexp_replace(t, pattern, replacement)).alias("output"))
    return rows.select(F.col("k").alias(key), "n", "form", *lengths(F.col("output"), F.col("form")), "output")


def pieces(output: Column) -> Column:
    """The text before the first marker (always empty) and the pieces after the markers, in the order of the output.

    No piece holds a marker, and none arises where a piece meets one.
    """
    return F.split(output, "<[PSM]>", -1)


def lengths(output: Column, form: Column) -> list[Column]:
    """Characters of prefix and of middle; null for plain texts."""
    at = F.when(form == "psm", 1).when(form == "spm", 2)
    return [F.when(form != "plain", F.length(F.element_at(pieces(output), i + 1)).cast("long")).alias(c) for c, i in (("prefix_chars", at), ("middle_chars", F.lit(3)))]


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone."""
    part = lambda i: F.element_at(pieces(output), i + 1)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(table(spark, sf_dir, "documents"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {", ".join(f"CAST('0x' || substr(g, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
