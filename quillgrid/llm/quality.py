"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

A rule rejects a document whose rate is above a cutoff. All steps (a rule with one of its cutoffs) of a
stratum are put in one order, and each prefix of it is a configuration: reject what any of its steps hits.
So configurations are nested, and what they are tested on is the loss of all rules together. The order
comes from the documents that are not labelled good alone: steps that hit most labelled bad documents for
each document hit come first, steps that hit none are left out. It is thus fixed before the holdout, the
labelled good documents that the base rules keep, is looked at; prefixes are certified in order while the
exact binomial test rejects "more than alpha of the good documents are lost" at level delta divided by the
number of strata that could be certified at all (strata with fewer good documents than that, see
``least_holdout``, get no share of delta). Testing nested prefixes in a fixed order needs no further
correction. With probability 1 - delta, in no stratum do the certified rules lose more than alpha of the good
documents that the base rules keep; what the base rules reject is outside that bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ALPHA, DELTA = 0.02, 0.05
WINDOW_WORDS = 8
#: Rates and their cutoffs, mildest first.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_rate": (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.05),
    "dup_line_rate": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_rate": (0.28, 0.25, 0.2, 0.15, 0.1, 0.05),
    "capital_rate": (0.9, 0.7, 0.5, 0.35, 0.25, 0.15),
    "word_length": (40.0, 25.0, 18.0, 14.0, 12.0, 10.0),
}


def _pairs(a: Column, gap: int) -> Column:
    """Fingerprints of elements ``gap`` apart."""
    n = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, gap + 1, n), lambda x, y: F.xxhash64(x, y))


def features(docs: DataFrame) -> DataFrame:
    """Counts of ``docs`` (doc_id, text, stratum); null or empty text gives zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", "stratum", text.alias("text")).withColumn("words", F.filter(F.split("text", common.SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    counted = words.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        without(r"\p{Lu}").cast("long").alias("n_capitals"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    hashed = counted.withColumn("h2", _pairs(F.col("h1"), 1)).withColumn("h4", _pairs(F.col("h2"), 2)).withColumn("h8", _pairs(F.col("h4"), 4))
    sorted_ = hashed.withColumn(
        "runs",
        F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    same = lambda e, k: F.coalesce(F.get(F.col("runs"), k)["x"] == e["x"], F.lit(False))
    places = sorted_.withColumn("at", F.sort_array(F.transform(F.filter("runs", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(WINDOW_WORDS)))), F.lit(0), lambda a, b: a + b
    )
    return places.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rates() -> dict[str, Column]:
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "capital_rate": per("n_capitals", "word_chars"),
        "word_length": per("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, from the largest term downwards; no term under- or overflows."""
    zero = F.lit(0.0)
    up = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))))
    log_top = F.coalesce(F.aggregate(up, zero, lambda a, j: a + F.log((n - k + j).cast("double") / j.cast("double"))), zero) + k * F.log(p) + (n - k) * F.log(1 - p)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    down = F.when(k > 0, F.sequence(F.greatest(k, F.lit(1)), F.lit(1).cast("long"), F.lit(-1).cast("long")))
    ratio = lambda i: i.cast("double") * (1 - p) / ((n - i + 1).cast("double") * p)
    summed = F.aggregate(down, start, lambda a, i: F.struct((a["t"] * ratio(i)).alias("t"), (a["s"] + a["t"] * ratio(i)).alias("s")))
    return F.exp(log_top) * F.coalesce(summed["s"], F.lit(1.0))


def least_holdout(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good documents below which not even a configuration without any loss can be certified."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


STEPS = [(rule, i, c) for rule, grid in RULES.items() for i, c in enumerate(grid)]


def cutoffs(marked: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The strictest certified cutoff (null: none) of each rule, one row per stratum of ``marked`` (features, q: 1 good, 0 bad, null unknown).

    The tables beyond ``marked`` have a row per stratum and step.
    """
    value = rates()
    good = F.coalesce(F.col("q") == 1, F.lit(False))
    hit = [value[rule] > c for rule, _, c in STEPS]
    counts = marked.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        F.array(*[F.struct(F.lit(k).alias("step"), F.lit(c).alias("cutoff"), F.count_if(hit[k] & ~good).alias("hits"), F.count_if(hit[k] & F.coalesce(F.col("q") == 0, F.lit(False))).alias("bad")) for k, (_, _, c) in enumerate(STEPS)]).alias("steps"),
    )
    enough = counts.where(F.col("n") >= least_holdout(alpha, delta)).withColumn("strata", F.count("*").over(Window.partitionBy()))
    best = Window.partitionBy("stratum").orderBy(F.desc(F.col("s.bad") / F.col("s.hits")), F.desc("s.bad"), "s.step")
    each = enough.select("stratum", "n", "strata", F.explode("steps").alias("s")).where("s.bad > 0")
    ranked = common.materialize(each.select("stratum", "n", "strata", F.col("s.step").alias("step"), F.col("s.cutoff").alias("cutoff"), F.row_number().over(best).alias("rank")), "step-order")
    ranks = ranked.groupBy("stratum").agg(*[F.max(F.when(F.col("step") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(STEPS))])
    none = len(STEPS) + 1
    first = F.least(*[F.coalesce(F.when(hit[k], F.col(f"r{k}")), F.lit(none)) for k in range(len(STEPS))])
    holdout = marked.where(good).alias("m").join(ranks.alias("r"), F.expr("m.stratum <=> r.stratum")).drop(F.col("r.stratum"))
    losses = holdout.groupBy("stratum", first.alias("rank")).agg(F.count("*").alias("lost"))
    so_far = Window.partitionBy("stratum").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ranked.alias("o").join(losses.alias("l"), F.expr("o.stratum <=> l.stratum and o.rank = l.rank"), "left").select("o.*", F.coalesce("lost", F.lit(0)).alias("lost"))
    tested = met.withColumn("lost", F.sum("lost").over(so_far))
    p = F.lit(alpha)
    safe = F.when(F.col("lost") <= F.col("n") * p, binomial_tail(F.col("n"), F.col("lost"), p) <= F.lit(delta) / F.col("strata")).otherwise(False)
    kept = tested.withColumn("safe", safe).withColumn("certified", F.min("safe").over(so_far))
    own = lambda rule: F.col("step").isin([k for k, s in enumerate(STEPS) if s[0] == rule])
    return kept.groupBy("stratum").agg(*[F.min(F.when(F.col("certified") & own(rule), F.col("cutoff"))).alias(f"max_{rule}") for rule in RULES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts and verdict of each of ``docs`` (doc_id, text, stratum) given ``labels`` (doc_id, quality).

    A document counts as good if all its labels say 1, as bad if one says 0. Null strata form a stratum.
    Where fewer than ``least_holdout`` good documents are labelled, nothing is certified and only the base
    rules reject; so it is without labelled bad documents. Rows of equal doc_id share their labels.
    """
    base_failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    counted = common.materialize(features(docs).withColumn("base_failed", base_failed), "features")
    known_label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).where("doc_id is not null and q is not null")
    marked = counted.where("not base_failed").join(known_label.groupBy("doc_id").agg(F.min("q").alias("q")), "doc_id", "left")
    known = lambda df: df.withColumn("__stratum", F.coalesce("stratum", F.lit(""))).withColumn("__none", F.col("stratum").isNull()).drop("stratum")
    limits = known(common.materialize(cutoffs(marked, alpha, delta), "cutoffs", "snappy"))
    rejected = F.lit(False)
    for rule, rate in rates().items():
        rejected = rejected | F.coalesce(rate > F.col(f"max_{rule}"), F.lit(False))
    judged = known(counted).join(limits, ["__stratum", "__none"], "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` judged, strata by lang, good documents from ``labels``."""
    docs = common.table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("stratum"))
    return judge(docs, common.table(spark, sf_dir, "labels"))


def _op4_sql() -> str:
    value = {
        "symbol_rate": "n_symbols::DOUBLE / greatest(n_words, 1)::DOUBLE",
        "dup_line_rate": "n_dup_lines::DOUBLE / greatest(n_lines, 1)::DOUBLE",
        "repeat_rate": "n_repeat_words::DOUBLE / greatest(n_words, 1)::DOUBLE",
        "capital_rate": "n_capitals::DOUBLE / greatest(word_chars, 1)::DOUBLE",
        "word_length": "word_chars::DOUBLE / greatest(n_words, 1)::DOUBLE",
    }
    tests = ", ".join(f"({k}, '{rule}', {c}::DOUBLE)" for k, (rule, _, c) in enumerate(STEPS))
    pick = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {sql}" for rule, sql in value.items()) + " END"
    rejects = " OR ".join(f"coalesce({sql} > (SELECT min(cutoff) FROM certified c WHERE c.stratum IS NOT DISTINCT FROM f.stratum AND rule = '{rule}'), false)" for rule, sql in value.items())
    failed = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    return rf"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), spread AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), gram AS (
  SELECT r, i, word || ' ' || {" || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(1, 8))} AS g FROM spread WINDOW o AS (PARTITION BY r ORDER BY i)
), win AS MATERIALIZED (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM gram WHERE g IS NOT NULL
), rep AS MATERIALIZED (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win WHERE n > 1) GROUP BY r
), f AS MATERIALIZED (
  SELECT r, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), marked AS MATERIALIZED (
  SELECT f.*, q FROM f LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT {failed}
), holdout AS MATERIALIZED (
  SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM marked WHERE q = 1 GROUP BY stratum HAVING count(*) >= {least_holdout()}
), hits AS MATERIALIZED (
  SELECT stratum, step, rule, cutoff, count(*) FILTER (q IS DISTINCT FROM 1) AS hits, count(*) FILTER (q = 0) AS bad
  FROM marked, (VALUES {tests}) t(step, rule, cutoff) WHERE {pick} > cutoff GROUP BY ALL
), ordered AS MATERIALIZED (
  SELECT h.*, n, strata, row_number() OVER (PARTITION BY h.stratum ORDER BY bad::DOUBLE / hits DESC, bad DESC, step) AS rank
  FROM hits h JOIN holdout o ON h.stratum IS NOT DISTINCT FROM o.stratum WHERE bad > 0
), first AS MATERIALIZED (
  SELECT stratum, rank, count(*) AS lost FROM (
    SELECT m.r, m.stratum, min(rank) AS rank FROM marked m JOIN ordered o ON m.stratum IS NOT DISTINCT FROM o.stratum AND {pick} > cutoff WHERE q = 1 GROUP BY m.r, m.stratum) GROUP BY ALL
), tested AS MATERIALIZED (
  SELECT o.*, sum(coalesce(lost, 0)) OVER (PARTITION BY o.stratum ORDER BY o.rank)::BIGINT AS lost
  FROM ordered o LEFT JOIN first l ON o.stratum IS NOT DISTINCT FROM l.stratum AND o.rank = l.rank
), safe AS MATERIALIZED (
  SELECT *, lost <= n * {ALPHA!r}::DOUBLE AND coalesce((
    SELECT sum(exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) + i * ln({ALPHA!r}::DOUBLE) + (n - i) * ln(1 - {ALPHA!r}::DOUBLE)))
    FROM range(0, lost + 1) s(i)), 0) <= {DELTA!r}::DOUBLE / strata AS safe
  FROM tested
), certified AS MATERIALIZED (
  SELECT stratum, rule, cutoff FROM (SELECT *, bool_and(safe) OVER (PARTITION BY stratum ORDER BY rank) AS ok FROM safe) WHERE ok
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT ({rejects}) AS kept
FROM f
"""


OP4_SQL = _op4_sql()
