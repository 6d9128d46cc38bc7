"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Rows are range-sorted by key within their source: the key's leading
bits number equal ranges, so that a source that holds most rows is spread over many tasks. Range totals
are summed ahead (one row per source and range), then each range is summed inside; the running total
cuts each source at its exact budget. A budget beyond the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST_EPOCHS = 2
ROWS_PER_RANGE = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes;
    no target passes ``most_epochs`` times its size, and what is above goes to the others by weight. That is
    min(cap, weight * level) for one level, found where the sources in order of cap / weight stop being full.
    """
    num, den = share
    exact = "decimal(38,0)"
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    fullness = Window.orderBy(F.col("__cap").cast("double") / F.col("__weight"), F.asc_nulls_last("source"))
    named = sizes.withColumn("__at", (F.row_number().over(by_name) - 1) % len(weights)).select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("__at") + 1).cast(exact).alias("__weight"),
        (F.col("source_size") * most_epochs).cast(exact).alias("__cap"),
        F.sum("source_size").over(Window.partitionBy()).cast(exact).alias("__all"),
    )
    placed = named.select(
        "*",
        F.row_number().over(fullness).alias("__rank"),
        F.coalesce(F.sum("__cap").over(fullness.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(exact).alias("__full"),
        F.sum("__weight").over(fullness.rowsBetween(0, Window.unboundedFollowing)).cast(exact).alias("__rest"),
    ).withColumn("__spare", (F.col("__all") * num - F.col("__full") * den).cast(exact))
    capped = (F.col("__cap") * F.col("__rest") * den).cast("double") < (F.col("__weight") * F.col("__spare")).cast("double")
    level = F.first(F.when(~F.col("__capped"), F.struct("__spare", "__rest")), ignorenulls=True).over(
        Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(
        (F.col("__weight") * F.col("__level.__spare")).cast(exact).cast("double") / (F.col("__level.__rest") * den).cast("double")
    )
    return placed.withColumn("__capped", capped).withColumn("__level", level).select("source", "source_size", target.alias("target"))


def draw(rows: DataFrame, counted: DataFrame, seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE, **goal) -> DataFrame:
    """Add source_size, target, ``epochs`` (whole passes), ``budget`` (words of the pass that is cut) and
    ``before`` (words of the source ahead of this row in that pass) to ``rows`` (doc_id, source, size, ...).

    ``counted`` holds doc_id, source and size of the same rows, cheap to read. Null source is a source of
    its own; rows of equal doc_id follow each other; an empty table gives no rows.
    """
    ranges = max(1, counted.count() // rows_per_range)
    names = rows.columns

    def keyed(df: DataFrame) -> DataFrame:
        lead = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
        return df.withColumn("__key", random_key(F.col("doc_id"), seed)).withColumns(
            {"__range": F.shiftright(lead * ranges, 32).cast("int"), "__source": F.coalesce(F.col("source"), F.lit("")), "__none": F.col("source").isNull()}
        )

    keys = ["__source", "__none", "__range"]
    totals = common.materialize(keyed(counted).groupBy(*keys).agg(F.sum("size").alias("__in_range")), "mix-ranges")
    sizes = totals.groupBy("__source", "__none").agg(F.sum("__in_range").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("__none"), F.col("__source")).alias("source"), "source_size")
    targets = source_targets(sizes, **goal).select(F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"), "source_size", "target")
    ahead = Window.partitionBy("__source", "__none").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("__base", F.coalesce(F.sum("__in_range").over(ahead), F.lit(0))).join(targets, ["__source", "__none"])
    inside = Window.partitionBy(*keys).orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed(rows).withColumn("__ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.floor("target")
    size = F.greatest("source_size", F.lit(1))
    return summed.join(base.drop("__in_range"), keys).select(
        *names,
        "source_size",
        "target",
        F.floor(whole / size).cast("long").alias("epochs"),
        (whole % size).cast("long").alias("budget"),
        (F.col("__base") + F.col("__ahead")).cast("long").alias("before"),
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """How many words the mix takes of each of ``docs`` (doc_id, text, source); the cut is exact to the word."""
    counted = common.materialize(sized(docs), "mix-sizes")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    return draw(counted, counted, **options).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, whole documents only.

    The document at the cut stays if at least half of it is within the budget; rows that share doc_id and
    size stand or fall together. Texts are not exchanged: the order is found on ids and sizes, and each
    source's last taken place comes back as one row, which a join brings to the documents (Spark broadcasts
    it while it is small).
    """
    counted = common.materialize(sized(docs), "mix-sizes")
    place = lambda seed="mix": F.struct(random_key(F.col("doc_id"), seed).alias("k"), F.col("doc_id").alias("i"), F.col("size").alias("n"))
    seed = options.get("seed", "mix")
    within = F.col("before") * 2 + F.col("size") <= F.col("budget") * 2
    named = lambda df: df.withColumns({"__source": F.coalesce("source", F.lit("")), "__none": F.col("source").isNull()})
    limits = named(draw(counted, counted, **options)).groupBy("__source", "__none").agg(F.max("epochs").alias("__epochs"), F.max(F.when(within, place(seed))).alias("__last"))
    limits = common.materialize(limits, "mix-limits")
    internal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.struct(*docs.columns).alias("__row"))
    copies = F.col("__epochs") + F.when(F.coalesce(place(seed) <= F.col("__last"), F.lit(False)), 1).otherwise(0)
    taken = named(internal).join(limits, ["__source", "__none"]).select("__row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("__copy"))
    return taken.select("__row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by source weights 3, 1, 2 to 150 % of all words, at most two epochs."""
    return mix_words(common.table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents
), named AS (
  SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[(pos - 1) % 3 + 1]::HUGEINT AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM named
), placed AS (
  SELECT *, row_number() OVER f AS rank, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), tested AS (
  SELECT *, 3 * total - 2 * filled AS spare, 2 * cap * rest < weight * (3 * total - 2 * filled) AS capped FROM placed
), level AS (
  SELECT min_by(spare, rank) AS spare, min_by(rest, rank) AS rest FROM tested WHERE NOT capped
), targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (SELECT spare FROM level))::DOUBLE / (2 * (SELECT rest FROM level))::DOUBLE END AS target
  FROM tested
), summed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         floor(t.target)::BIGINT AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source,
       (whole // greatest(source_size, 1) * size + greatest(0, least(size, whole % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM summed
"""
