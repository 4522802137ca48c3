"""Pair scoring: six signals as column expressions, their weighted verdict, predictions, and image verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import text as X
from interlace.plans.model import NOUNS, chain
from interlace.plans.registry import read, register

# Weights of the signals.
WEIGHTS = {"oem": 40, "category": 20, "description": 15, "fitment": 15, "specs": 5, "visual": 5}
TOLERANCE, RATIO = 0.08, 0.85


# Each text signal has two steps: what belongs to one part is computed once for the part, and pairs only compare it.
def reference_forms(refs: Column) -> Column:
    """The normal forms of references and their base numbers."""
    normal = F.transform(refs, X.normal_reference)
    return F.struct(normal.alias("normal"), F.transform(normal, X.base_reference).alias("base"))


def compare_references(a: Column, b: Column, residue: Column | None = None) -> Column:
    none = (F.size(a["normal"]) <= 0) | (F.size(b["normal"]) <= 0)
    same, same_base = F.arrays_overlap(a["normal"], b["normal"]), F.arrays_overlap(a["base"], b["base"])
    return F.when(F.coalesce(none, F.lit(True)), 0.3).when(same, 1.0).when(same_base, 0.7).otherwise(F.lit(0.0) if residue is None else residue)


def score_oem(a: Column, b: Column, residue: Column | None = None) -> Column:
    """Shared references 1, shared base numbers .7, else `residue` (similar spelling, .5 or 0); .3 without references."""
    return compare_references(reference_forms(a), reference_forms(b), residue)


def category_form(category: Column) -> Column:
    """A category without case and edges, and its words."""
    return F.struct(F.lower(F.trim(category)).alias("name"), X.words(category).alias("words"))


def compare_categories(a: Column, b: Column) -> Column:
    overlap = F.try_divide(F.size(F.array_intersect(a["words"], b["words"])), F.greatest(F.size(a["words"]), F.size(b["words"])))
    missing = F.coalesce(a["name"] == "", F.lit(True)) | F.coalesce(b["name"] == "", F.lit(True))
    return F.when(missing, 0.3).when(a["name"] == b["name"], 1.0).when(overlap >= 0.75, 0.8).when(overlap >= 0.4, 0.5).otherwise(0.0)


def score_category(a: Column, b: Column) -> Column:
    """Equal 1; shared words over the larger set: .8 from .75, .5 from .4, else 0; .3 if either is missing."""
    return compare_categories(category_form(a), category_form(b))


def compare_words(a: Column, b: Column, kind: Column) -> Column:
    """The words of two texts, those of the part type added to both."""
    left, right = F.array_union(a, kind), F.array_union(b, kind)
    j = X.jaccard(left, right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.3).when((j >= 0.25) & (F.size(kind) > 0), F.least(F.lit(1.0), j * 2.5)).when(j >= 0.3, j).when(j >= 0.1, 0.3).otherwise(0.1)


def score_description(a: Column, b: Column, part_type: Column) -> Column:
    """Shared words of two texts, the part type added to both."""
    return compare_words(X.telling_words(a), X.telling_words(b), X.telling_words(part_type))


def years_in(text: Column, compat: bool = False) -> Column:
    """Years in a text; compat: centuries only, as the first version of the rule compared them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda y: F.substring(y, 1, 2)) if compat else found)


def makes_in(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(" + "|".join(m.lower() for m in X.MAKES) + r")\b"), F.lit(1))
    return F.array_distinct(found)


def fitment_form(text: Column, compat: bool = False) -> Column:
    """The years and makes that a text names."""
    return F.struct(years_in(text, compat).alias("years"), makes_in(text).alias("makes"))


def compare_fitments(a: Column, b: Column) -> Column:
    some = lambda x: (F.size(x["years"]) > 0) | (F.size(x["makes"]) > 0)
    years, makes = F.arrays_overlap(a["years"], b["years"]), F.arrays_overlap(a["makes"], b["makes"])
    return F.when(~(some(a) & some(b)), 0.4).when(years & makes, 1.0).when(makes, 0.6).when(years, 0.5).otherwise(0.0)


def score_fitment(a: Column, b: Column, compat: bool = False) -> Column:
    """Years and makes shared 1, makes .6, years .5, neither 0; .4 if a text names none."""
    return compare_fitments(fitment_form(a, compat), fitment_form(b, compat))


def spec_form(table: Column) -> Column:
    """A spec table by normal field names: each value in lower case and the mean of the numbers in it."""
    text = lambda e: F.lower(F.trim(e["value"]))
    entry = lambda e: F.struct(F.regexp_replace(F.lower(F.trim(e["key"])), r"\s+", " ").alias("key"), F.struct(text(e).alias("text"), X.mean_of(X.numbers(text(e))).alias("mean")).alias("value"))
    return F.map_from_entries(F.array_distinct(F.transform(F.map_entries(table), entry)))


def compare_specs(left: Column, right: Column) -> Column:
    shared = F.array_intersect(F.map_keys(left), F.map_keys(right))

    def same(key: Column) -> Column:
        x, y = F.element_at(left, key), F.element_at(right, key)
        near = (x["mean"] == y["mean"]) | (F.abs(x["mean"] - y["mean"]) <= TOLERANCE * F.greatest(x["mean"], y["mean"]))
        return (x["text"] == y["text"]) | F.coalesce(near, F.lit(False))

    empty = F.coalesce(F.size(left) <= 0, F.lit(True)) | F.coalesce(F.size(right) <= 0, F.lit(True))
    return F.when(empty, 0.4).when(F.size(shared) == 0, 0.3).otherwise(F.size(F.filter(shared, same)) / F.size(shared))


def score_specs(a: Column, b: Column) -> Column:
    """Matching over shared fields, numbers within eight per cent; .3 without shared fields, .4 without a table."""
    return compare_specs(spec_form(a), spec_form(b))


def score_visual(url_a: Column, url_b: Column, hash_a: Column, hash_b: Column) -> Column:
    """One image 1, equal content .95, else unknown .4."""
    return F.when(F.coalesce((url_a != "") & (url_a == url_b), F.lit(False)), 1.0).when(F.coalesce(hash_a == hash_b, F.lit(False)), 0.95).otherwise(0.4)


def confidence_of(scores: dict[str, Column]) -> Column:
    """The weighted sum, truncated; rounding first keeps sums just below a whole number from falling."""
    total = sum((scores[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.floor(F.round(total, 9)).cast("int")


def with_verdict(pairs: DataFrame) -> DataFrame:
    """P07 over columns s_oem .. s_visual and both_found: confidence, verdict, fitment and description labels, top signals."""
    c = {k: F.col(f"s_{k}") for k in WEIGHTS}
    out = pairs.withColumn("confidence", confidence_of(c))
    result = X.verdict(F.col("confidence"), c["category"])
    result = F.when((result == "NO") & ~F.col("both_found"), "UNCERTAIN").otherwise(result)
    ranked = F.array_sort(F.array(*[F.struct((-c[k] * w).alias("share"), F.lit(i).alias("place"), F.lit(k).alias("signal")) for i, (k, w) in enumerate(WEIGHTS.items())]))
    gaps = F.array_compact(F.array(F.when(c["fitment"] == 0.4, "fitment year/make data"), F.when(c["visual"] == 0.4, "product images"), F.when(c["specs"] == 0.4, "spec tables")))
    return out.withColumns(
        {
            "match_result": result,
            "fitment_match": chain([(c["fitment"] >= 0.8, "YES"), (c["fitment"] <= 0.1, "NO")], "UNKNOWN"),
            "desc_match": chain([(c["description"] >= 0.7, "YES"), (c["description"] >= 0.35, "PARTIAL")], "NO"),
            "top_signals": F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["signal"]), ","),
            "missing_info": F.coalesce(F.nullif(F.array_join(gaps, ", "), F.lit("")), F.lit("None")),
        }
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """A part observation for each part, with references, texts and specs fixed by its row."""
    k, size = F.col("p_partkey"), F.col("p_size")
    noun = F.substring_index("p_name", " ", -1)
    make = F.element_at(F.array(*map(F.lit, ("Ford", "Honda", "Jeep"))), (size % 3 + 1))
    ref = F.concat(F.lit("7b0"), F.lpad((F.expr("p_partkey div 3")).cast("string"), 6, "0"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "-B").otherwise(""))
    return read(spark, sf, "part").select(
        k.alias("part"), F.col("p_brand").alias("brand"), chain([(noun == n, v) for n, v in NOUNS.items()], F.upper(noun)).alias("category"),
        F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.when(size % 5 > 0, F.concat(F.lit(" fits "), make, F.lit(" "), (F.lit(1990) + size % 25).cast("string"))).otherwise("")).alias("description"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(ref)).alias("refs"),
        F.when(k % 7 != 0, F.create_map(F.lit("Weight "), F.concat(size.cast("string"), F.lit(" lb")), F.lit("material"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>")).alias("specs"),
        F.when(k % 4 == 0, F.concat(F.lit("http://img/"), F.expr("p_partkey div 8").cast("string"))).otherwise("").alias("url"), (size % 10).cast("string").alias("hash"),
    )


def pairs(spark: SparkSession, sf: str, reach: int = 4) -> DataFrame:
    """Pairs of parts at most `reach` keys apart: an equality on the key of the second, so pairs grow with the parts."""
    obs = observations(spark, sf)
    obs = obs.select("*", *[form().alias(name) for name, form in FORMS.items()])
    a = obs.select(*[F.col(c).alias(f"a_{c}") for c in obs.columns], F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step"))
    b = obs.select(*[F.col(c).alias(f"b_{c}") for c in obs.columns])
    return a.join(b, F.col("a_part") + F.col("step") == F.col("b_part"))


#: What scored() and predict_match() compare of each part.
FORMS = {
    "f_refs": lambda: reference_forms(F.col("refs")), "f_category": lambda: category_form(F.col("category")), "f_kind": lambda: X.telling_words(F.col("category")),
    "f_words": lambda: X.telling_words(F.col("description")), "f_fitment": lambda: fitment_form(F.col("description")), "f_specs": lambda: spec_form(F.col("specs")),
    "f_bag": lambda: F.array_distinct(F.split(F.lower("description"), " ")),
}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    return pairs(spark, sf).select(
        "a_part", "b_part", "a_category", "b_category", "a_brand", "b_brand", "a_refs", "b_refs", "a_f_refs", "b_f_refs", "a_f_bag", "b_f_bag", (F.size("a_refs") + F.size("b_refs") > 0).alias("both_found"),
        compare_references(a("f_refs"), b("f_refs")).alias("s_oem"), compare_categories(a("f_category"), b("f_category")).alias("s_category"), F.round(compare_words(a("f_words"), b("f_words"), a("f_kind")), 6).alias("s_description"),
        compare_fitments(a("f_fitment"), b("f_fitment")).alias("s_fitment"), compare_specs(a("f_specs"), b("f_specs")).alias("s_specs"), score_visual(a("url"), b("url"), a("hash"), b("hash")).alias("s_visual"),
    )


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_WORDS = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}')), lambda w: NOT list_contains({_STOP}, w))"
_MAKES = "|".join(m.lower() for m in X.MAKES)
_NOUN = "CASE split_part(p_name, ' ', -1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOUNS.items()) + " ELSE upper(split_part(p_name, ' ', -1)) END"
_SCORED = f"""
WITH o AS (SELECT p_partkey AS part, p_brand AS brand, p_size AS size, p_type AS type, {_NOUN} AS category,
  p_name || ' ' || lower(p_type) || CASE WHEN p_size % 5 > 0 THEN ' fits ' || ['Ford', 'Honda', 'Jeep'][p_size % 3 + 1] || ' ' || (1990 + p_size % 25) ELSE '' END AS description,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE '7B0' || lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0') || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END END AS ref,
  CASE WHEN p_partkey % 4 = 0 THEN 'http://img/' || (p_partkey // 8) ELSE '' END AS url, CAST(p_size % 10 AS VARCHAR) AS hash FROM part),
w AS (SELECT *, {_WORDS("description || ' ' || category")} AS own, {_WORDS("category")} AS kind, regexp_extract_all(lower(description), '{_MAKES}') AS makes, regexp_extract_all(description, '(19|20)[0-9][0-9]') AS years FROM o),
p AS (SELECT a.part AS a_part, b.part AS b_part, a.category AS a_category, b.category AS b_category, a.brand AS a_brand, b.brand AS b_brand, a.ref AS a_ref, b.ref AS b_ref, a.description AS a_description, b.description AS b_description,
  a.ref IS NOT NULL OR b.ref IS NOT NULL AS both_found,
  CASE WHEN a.ref IS NULL OR b.ref IS NULL THEN 0.3::DOUBLE WHEN a.ref = b.ref THEN 1 WHEN regexp_replace(a.ref, '[A-Z]{{1,2}}$', '') = regexp_replace(b.ref, '[A-Z]{{1,2}}$', '') THEN 0.7 ELSE 0 END AS s_oem,
  CASE WHEN a.category = b.category THEN 1.0::DOUBLE ELSE (SELECT CASE WHEN v >= 0.75 THEN 0.8 WHEN v >= 0.4 THEN 0.5 ELSE 0 END FROM (SELECT len(list_intersect(regexp_extract_all(a.category, '[A-Z]{{3,}}'), regexp_extract_all(b.category, '[A-Z]{{3,}}')))::DOUBLE / nullif(greatest(len(list_distinct(regexp_extract_all(a.category, '[A-Z]{{3,}}'))), len(list_distinct(regexp_extract_all(b.category, '[A-Z]{{3,}}')))), 0) AS v)) END AS s_category,
  len(list_intersect(a.own, list_distinct(list_concat({_WORDS("b.description || ' ' || a.category")}, [])))) AS shared, len(list_distinct(list_concat(a.own, {_WORDS("b.description || ' ' || a.category")}))) AS every, len(a.kind) AS kinds,
  CASE WHEN len(a.makes) + len(a.years) = 0 OR len(b.makes) + len(b.years) = 0 THEN 0.4::DOUBLE WHEN list_has_any(a.years, b.years) AND list_has_any(a.makes, b.makes) THEN 1 WHEN list_has_any(a.makes, b.makes) THEN 0.6 WHEN list_has_any(a.years, b.years) THEN 0.5 ELSE 0 END AS s_fitment,
  CASE WHEN a.part % 7 = 0 OR b.part % 7 = 0 THEN 0.4::DOUBLE ELSE (CAST(a.size = b.size OR abs(a.size - b.size) <= 0.08 * greatest(a.size, b.size) AS INT) + CAST(a.type = b.type AS INT)) / 2.0::DOUBLE END AS s_specs,
  CASE WHEN a.url <> '' AND a.url = b.url THEN 1.0::DOUBLE WHEN a.hash = b.hash THEN 0.95 ELSE 0.4 END AS s_visual
  FROM w a JOIN w b ON b.part - a.part BETWEEN 1 AND 4),
s AS (SELECT *, round(CASE WHEN shared::DOUBLE / every >= 0.25 AND kinds > 0 THEN least(1, shared::DOUBLE / every * 2.5::DOUBLE) WHEN shared::DOUBLE / every >= 0.3 THEN shared::DOUBLE / every WHEN shared::DOUBLE / every >= 0.1 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END, 6) AS s_description FROM p),
v AS (SELECT *, CAST(floor(round(s_oem * 40 + s_category * 20 + s_description * 15 + s_fitment * 15 + s_specs * 5 + s_visual * 5, 9)) AS INT) AS confidence FROM s),
r AS (SELECT *, CASE WHEN s_category = 0 THEN 'NO' WHEN confidence >= 80 THEN 'YES' WHEN confidence >= 60 THEN 'LIKELY' WHEN confidence >= 35 THEN 'UNCERTAIN' ELSE 'NO' END AS raw FROM v)
"""


def _score(name: str) -> None:
    register(f"score_{name}", _SCORED + f"SELECT a_part, b_part, s_{name} AS score FROM s")(lambda spark, sf: scored(spark, sf).select("a_part", "b_part", F.col(f"s_{name}").cast("double").alias("score")))


for _name in ("category", "description", "fitment", "specs", "visual"):
    _score(_name)
register("score_oem_native", _SCORED + "SELECT a_part, b_part, s_oem AS score FROM s")(lambda spark, sf: scored(spark, sf).select("a_part", "b_part", F.col("s_oem").cast("double").alias("score")))


@register("verdict", _SCORED + "SELECT a_part, b_part, confidence, CASE WHEN raw = 'NO' AND NOT both_found THEN 'UNCERTAIN' ELSE raw END AS match_result, CASE WHEN s_fitment >= 0.8 THEN 'YES' WHEN s_fitment <= 0.1 THEN 'NO' ELSE 'UNKNOWN' END AS fitment_match, CASE WHEN s_description >= 0.7 THEN 'YES' WHEN s_description >= 0.35 THEN 'PARTIAL' ELSE 'NO' END AS desc_match, array_to_string(list_transform(list_sort([{'share': -s_oem * 40, 'place': 0, 'signal': 'oem'}, {'share': -s_category * 20, 'place': 1, 'signal': 'category'}, {'share': -s_description * 15, 'place': 2, 'signal': 'description'}, {'share': -s_fitment * 15, 'place': 3, 'signal': 'fitment'}, {'share': -s_specs * 5, 'place': 4, 'signal': 'specs'}, {'share': -s_visual * 5, 'place': 5, 'signal': 'visual'}])[1:3], lambda x: x.signal), ',') AS top_signals, coalesce(nullif(concat_ws(', ', CASE WHEN s_fitment = 0.4 THEN 'fitment year/make data' END, CASE WHEN s_visual = 0.4 THEN 'product images' END, CASE WHEN s_specs = 0.4 THEN 'spec tables' END), ''), 'None') AS missing_info FROM r")
def verdict_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole rule engine over pairs."""
    return with_verdict(scored(spark, sf)).select("a_part", "b_part", "confidence", "match_result", "fitment_match", "desc_match", "top_signals", "missing_info")


@register("score_oem_full")
def score_oem_full(spark: SparkSession, sf: str) -> DataFrame:
    """P01 with C08: Python sees only the pairs that references and base numbers leave undecided."""
    rows = scored(spark, sf).select("a_part", "b_part", "a_f_refs", "b_f_refs", "s_oem")
    ratio = X.sequence_ratio(F.col("a_f_refs.normal")[0], F.col("b_f_refs.normal")[0])
    rest = rows.filter("s_oem = 0").withColumn("score", F.when(ratio >= RATIO, 0.5).otherwise(0.0)).select("a_part", "b_part", "score")
    return rows.filter("s_oem <> 0").select("a_part", "b_part", F.col("s_oem").alias("score")).unionByName(rest)


@register("rules_only", "SELECT p_partkey AS part, 43 AS confidence, 'UNCERTAIN' AS match_result FROM part")
def rules_only(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs without observations: missing references, category, fitment, specs and images; the part type is shared."""
    kind = read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.lit("ENGINE MOUNT").alias("kind"))
    none = F.array().cast("array<string>")
    rows = kind.select("part", score_oem(none, none).alias("s_oem"), score_category(F.lit(""), F.lit("")).alias("s_category"), score_description(F.lit(""), F.lit(""), F.col("kind")).alias("s_description"), F.lit(0.4).alias("s_fitment"), F.lit(0.4).alias("s_specs"), F.lit(0.4).alias("s_visual"), F.lit(False).alias("both_found"))
    return with_verdict(rows).select("part", "confidence", "match_result")


# Thresholds (yes, likely, uncertain) by category, and quality factor and boost by brand.
THRESHOLDS = {"ENGINE MOUNT": (85, 65, 35), "BRAKE PAD": (80, 60, 30), "FILTER": (75, 55, 25), "SENSOR": (90, 70, 40), "BELT": (80, 60, 30), "DEFAULT": (80, 60, 35)}
BRAND_FACTORS = {"ANCHOR": (1.1, 5), "DORMAN": (1.0, 0), "GMB": (1.2, 10), "SMP": (1.0, 0), "FOUR SEASONS": (1.0, 0)}


def predicted(score: Column, category: Column, boost: Column) -> tuple[Column, Column]:
    """Class and confidence of a composite score under the category's thresholds, with caps and a floor."""
    limit = lambda i: chain([(category == k, float(v[i])) for k, v in THRESHOLDS.items() if k != "DEFAULT"], float(THRESHOLDS["DEFAULT"][i]))
    label = F.when(score >= limit(0), "YES").when(score >= limit(1), "LIKELY").when(score >= limit(2), "UNCERTAIN").otherwise("NO")
    raised = score + boost
    confidence = F.when(label == "YES", F.least(F.lit(95.0), raised)).when(label == "LIKELY", F.least(F.lit(85.0), raised)).when(label == "UNCERTAIN", F.least(F.lit(75.0), raised)).otherwise(F.greatest(F.lit(10.0), raised))
    return label, F.floor(confidence).cast("int")


_LIMIT = lambda i: "CASE a_category " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in THRESHOLDS.items() if k != "DEFAULT") + f" ELSE {THRESHOLDS['DEFAULT'][i]} END"


@register("predict_match", _SCORED + f", q AS (SELECT a_part, b_part, a_category, list_distinct(string_split(lower(a_description), ' ')) AS wa, list_distinct(string_split(lower(b_description), ' ')) AS wb, a_ref = b_ref AS oem, a_category = b_category AS same, s_specs, a_brand = b_brand AS one_brand FROM s), c AS (SELECT a_part, b_part, a_category, round(CASE WHEN oem THEN 40 ELSE 0 END + CASE WHEN same THEN 20 ELSE 0 END + 15.0::DOUBLE * len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) + 15 * s_specs + CASE WHEN one_brand THEN 10 ELSE 3 END, 9) AS score FROM q) SELECT a_part, b_part, CASE WHEN score >= {_LIMIT(0)} THEN 'YES' WHEN score >= {_LIMIT(1)} THEN 'LIKELY' WHEN score >= {_LIMIT(2)} THEN 'UNCERTAIN' ELSE 'NO' END AS predicted, CAST(floor(CASE WHEN score >= {_LIMIT(0)} THEN least(95, score) WHEN score >= {_LIMIT(1)} THEN least(85, score) WHEN score >= {_LIMIT(2)} THEN least(75, score) ELSE greatest(10, score) END) AS INT) AS confidence FROM c")
def predict_match(spark: SparkSession, sf: str) -> DataFrame:
    """A quick prediction from references, category, whole words, specs and brands, before any scoring."""
    c = F.col
    oem = F.coalesce(X.jaccard(c("a_f_refs.normal"), c("b_f_refs.normal")), F.lit(0.0))
    score = oem * 40 + F.when(c("a_category") == c("b_category"), 20.0).otherwise(0.0) + 15.0 * X.jaccard(c("a_f_bag"), c("b_f_bag")) + 15 * c("s_specs") + F.when(c("a_brand") == c("b_brand"), 10.0).otherwise(3.0)
    factor = chain([(F.upper("a_brand") == k, v[0]) for k, v in BRAND_FACTORS.items()], 1.0)
    boost = chain([(F.upper("a_brand") == k, float(v[1])) for k, v in BRAND_FACTORS.items()], 0.0)
    label, confidence = predicted(F.round(score * factor, 9), c("a_category"), boost)
    return scored(spark, sf).select("a_part", "b_part", label.alias("predicted"), confidence.alias("confidence"))


@register("obvious_pairs", _SCORED + "SELECT a_part, b_part, CASE WHEN a_ref = b_ref AND a_brand <> b_brand THEN 'YES' WHEN a_category <> b_category AND s_oem = 0 THEN 'NO' ELSE 'OPEN' END AS screen FROM s")
def obvious_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that need no scoring: one number under two brands, or neither category nor reference in common."""
    same = F.arrays_overlap("a_f_refs.normal", "b_f_refs.normal")
    yes = F.coalesce(same, F.lit(False)) & (F.col("a_brand") != F.col("b_brand"))
    no = (F.col("a_category") != F.col("b_category")) & (F.col("s_oem") == 0)
    return scored(spark, sf).select("a_part", "b_part", chain([(yes, "YES"), (no, "NO")], "OPEN").alias("screen"))


@register("prediction_accuracy", _SCORED + "SELECT raw AS predicted, count(*) AS n, CAST(count_if((raw IN ('YES', 'LIKELY')) = (a_category = b_category)) AS BIGINT) AS correct FROM r GROUP BY 1")
def prediction_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often a prediction holds, by class (confusion counts)."""
    rows = scored(spark, sf).withColumn("confidence", confidence_of({k: F.col(f"s_{k}") for k in WEIGHTS}))
    rows = rows.withColumn("predicted", X.verdict(F.col("confidence"), F.col("s_category")))
    return rows.groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isin("YES", "LIKELY") == (F.col("a_category") == F.col("b_category"))).alias("correct"))


def image_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Image comparison scores for each part, fixed by its row; the kernels that make them are not part of the engine."""
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k.alias("part"), (k % 101 / 100.0).alias("phash"), F.when(k % 6 != 0, k % 89 / 88.0).alias("clip"), (k % 71 / 70.0).alias("orb"), F.when(k % 5 != 0, k % 61 / 60.0).alias("ssim"))


@register("image_verdict", "WITH i AS (SELECT p_partkey AS part, p_partkey % 101 / 100.0::DOUBLE AS phash, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 89 / 88.0::DOUBLE END AS clip, p_partkey % 71 / 70.0::DOUBLE AS orb, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 61 / 60.0::DOUBLE END AS ssim FROM part), s AS (SELECT part, round(CASE WHEN clip IS NOT NULL AND ssim IS NOT NULL THEN phash * 0.3::DOUBLE + clip * 0.3::DOUBLE + orb * 0.25::DOUBLE + ssim * 0.15::DOUBLE ELSE phash * 0.6::DOUBLE + orb * 0.4::DOUBLE END, 6) AS similarity FROM i) SELECT part, similarity, CASE WHEN similarity >= 0.65 THEN 'HIGH' WHEN similarity >= 0.45 THEN 'MEDIUM' WHEN similarity >= 0.25 THEN 'LOW' ELSE 'NONE' END AS band, CASE WHEN similarity >= 0.25 THEN 'LIKELY' ELSE 'UNCERTAIN' END AS match_result FROM s")
def image_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted image scores, fewer weights where a score is missing, and their bands."""
    c = F.col
    full = c("phash") * 0.3 + c("clip") * 0.3 + c("orb") * 0.25 + c("ssim") * 0.15
    out = image_scores(spark, sf).select("part", F.round(F.coalesce(full, c("phash") * 0.6 + c("orb") * 0.4), 6).alias("similarity"))
    s = c("similarity")
    return out.select("part", s, chain([(s >= 0.65, "HIGH"), (s >= 0.45, "MEDIUM"), (s >= 0.25, "LOW")], "NONE").alias("band"), F.when(s >= 0.25, "LIKELY").otherwise("UNCERTAIN").alias("match_result"))


@register("image_policy", "WITH i AS (SELECT p_partkey AS part, p_partkey % 101 / 100.0::DOUBLE AS cv, ['YES', 'LIKELY', 'UNCERTAIN', 'NO'][p_partkey % 4 + 1] AS vision, CAST(50 + p_partkey % 50 AS INT) AS c FROM part) SELECT part, CASE WHEN cv >= 0.75 OR (cv >= 0.35 AND vision IN ('YES', 'LIKELY') AND c >= 65) THEN 'LIKELY' ELSE 'UNCERTAIN' END AS match_result, CASE WHEN cv >= 0.75 THEN 72 WHEN cv >= 0.35 AND vision IN ('YES', 'LIKELY') AND c >= 65 THEN least(c, 80) END AS confidence FROM i")
def image_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A clear image score upgrades alone; a middling one needs a second opinion."""
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(k.alias("part"), (k % 101 / 100.0).alias("cv"), F.element_at(F.array(*map(F.lit, ("YES", "LIKELY", "UNCERTAIN", "NO"))), (k % 4 + 1).cast("int")).alias("vision"), (50 + k % 50).cast("int").alias("c"))
    second = (F.col("cv") >= 0.35) & F.col("vision").isin("YES", "LIKELY") & (F.col("c") >= 65)
    clear = F.col("cv") >= 0.75
    return rows.select("part", F.when(clear | second, "LIKELY").otherwise("UNCERTAIN").alias("match_result"), F.when(clear, 72).when(second, F.least("c", F.lit(80))).alias("confidence"))


@register("vision_jaccard", _SCORED + ", j AS (SELECT a_part, b_part, list_distinct(regexp_extract_all(lower(a_description), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(b_description), '[a-z]{3,}')) AS b FROM s), vj AS (SELECT a_part, b_part, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM j) SELECT *, CASE WHEN similarity >= 0.45 THEN 'YES' WHEN similarity >= 0.25 THEN 'LIKELY' WHEN similarity >= 0.1 THEN 'UNCERTAIN' ELSE 'NO' END AS match_result, CASE WHEN similarity >= 0.45 THEN 85 WHEN similarity >= 0.25 THEN 70 WHEN similarity >= 0.1 THEN 40 ELSE 20 END AS confidence FROM vj")
def vision_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict from the words that two image descriptions share."""
    rows = pairs(spark, sf).select("a_part", "b_part", F.round(X.jaccard(X.words(F.col("a_description")), X.words(F.col("b_description"))), 6).alias("similarity"))
    s = F.col("similarity")
    return rows.select("*", chain([(s >= 0.45, "YES"), (s >= 0.25, "LIKELY"), (s >= 0.1, "UNCERTAIN")], "NO").alias("match_result"), chain([(s >= 0.45, 85), (s >= 0.25, 70), (s >= 0.1, 40)], 20).alias("confidence"))


@register("embedding_cosine", "SELECT a.vec_id AS a_vec, b.vec_id AS b_vec, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of neighbouring vectors, brought to 0..1."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a, b = e.select(F.col("vec_id").alias("a_vec"), F.col("v").alias("x")), e.select(F.col("vec_id").alias("b_vec"), F.col("v").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda u, v: u + v)
    cosine = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    return a.join(b, F.col("b_vec") == F.col("a_vec") + 1).select("a_vec", "b_vec", F.round((cosine + 1) / 2, 5).alias("similarity"))


@register("hash_similarity", "SELECT a.p_partkey AS a_part, b.p_partkey AS b_part, round((64 - bit_count(xor(a.p_partkey * 2654435761, b.p_partkey * 2654435761))) / 64.0::DOUBLE, 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def hash_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Share of equal bits of two 64-bit image hashes."""
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 2654435761).alias("h"))
    a, b = p.toDF("a_part", "ha"), p.toDF("b_part", "hb")
    return a.join(b, F.col("b_part") == F.col("a_part") + 1).select("a_part", "b_part", F.round((64 - F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))) / 64.0, 6).alias("similarity"))
