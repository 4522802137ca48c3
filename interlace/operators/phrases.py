"""Many phrases in many texts: which names of a list, of any length, a text holds, by equality joins on runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.plans.registry import read, register

#: Words of the runs that are joined. A longer phrase is looked up by its first so many words and then compared whole.
RUN = 4


def words_of(text: Column) -> Column:
    """The words of a text in order, lower case; a word is a run of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def find(texts: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """(key, phrase, n, first) for each row of texts and each distinct phrase in it: how often it occurs, and at which word first.

    Phrases match whole words, whatever stands between them. Phrases with equal words are found each under its own spelling;
    null phrases and those without words never are. Rows with equal keys are rows of their own. Each run of a text is counted
    inside the text before it is joined, so a phrase that many texts hold meets one row of each.
    """
    known = phrases.select(F.col(phrase).alias("phrase")).distinct().withColumn("all", words_of(F.col("phrase"))).filter(F.size("all") > 0)
    known = known.select("phrase", "all", F.array_join(F.slice("all", 1, RUN), " ").alias("run"), F.least(F.size("all"), F.lit(RUN)).alias("size"))
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # RUN numbers at most
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(F.array_join(F.slice("words", i, n), " ").alias("run"), i.alias("at")))
    runs = [F.when(F.size("words") >= n, at(n)).otherwise(F.array().cast("array<struct<run:string,at:int>>")) for n in sizes]
    if not runs:
        runs = [F.array().cast("array<struct<run:string,at:int>>")]
    found = rows.withColumn("r", F.explode(F.concat(*runs))).select("row", "key", "r.run", "r.at").join(known, "run")
    short = found.filter(F.size("all") <= RUN)
    # The rest of long phrases is compared at the places where they begin, with the words of the text.
    long = found.filter(F.size("all") > RUN).join(rows.select("row", "words"), "row").filter(F.slice("words", F.col("at"), F.size("all")) == F.col("all"))
    both = short.select("row", "key", "phrase", "at").unionByName(long.select("row", "key", "phrase", "at"))
    return both.groupBy("row", "key", "phrase").agg(F.count("*").alias("n"), F.min("at").alias("first")).select(F.col("key").alias(key), "phrase", "n", "first")


@register("part_names_in_documents", "WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand AS phrase, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), d AS (SELECT doc_id, concat(coalesce(text, ''), ' ', upper(a.phrase), ', ', CASE WHEN doc_id % 2 = 0 THEN replace(a.phrase, ' ', ' - ') || '; ' ELSE '' END, b.phrase, 's') AS text FROM documents JOIN p a ON a.i = doc_id * 7 % a.n JOIN p b ON b.i = doc_id * 3 % b.n), w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '  ', 'g')) || ' ' AS text FROM d), k AS (SELECT DISTINCT phrase, ' ' || regexp_replace(lower(phrase), '[^\\p{L}\\p{N}]+', '  ', 'g') || ' ' AS run FROM p) SELECT doc_id, phrase, CAST(len(string_split(text, run)) - 1 AS BIGINT) AS n, CAST(len(string_split(trim(string_split(text, run)[1]), '  ')) + 1 AS INT) AS first FROM w JOIN k ON contains(text, run)".replace("\\\\", "\\"))
def part_names_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The names of all parts with their brands, looked for in all documents, of which each has two planted, one of them
    in capitals or with dashes, and one with a wrong end."""
    part = read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("phrase"))
    n = part.count()
    docs = read(spark, sf, "documents").select("doc_id", "text")
    side = lambda name: part.select(F.col("p_partkey").alias(f"{name}_key"), F.col("phrase").alias(name))
    docs = docs.join(side("a"), F.col("doc_id") * 7 % n == F.col("a_key")).join(side("b"), F.col("doc_id") * 3 % n == F.col("b_key"))
    dashed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.replace("a", F.lit(" "), F.lit(" - ")), F.lit("; "))).otherwise("")
    planted = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.upper("a"), F.lit(", "), dashed, "b", F.lit("s")).alias("text"))
    return find(planted, part, "doc_id", "text", "phrase")
