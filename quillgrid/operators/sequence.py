"""Ring-number sequences: rebuilding from an anchor, and the first pass over observed digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ("doc_id", "page", "col")


def rebuild(cells: DataFrame, override: Column | None = None, overwrite_manual: bool = False, key: tuple[str, ...] = KEY) -> DataFrame:
    """Number a column from its anchor by physical distance, blank cells included.

    Reads row, text, score, is_anchor and is_manual_edit; the anchor is the first flagged cell, else the
    first cell. Numbers above it stop at 1, what lies beyond keeps its text. Manual edits stay.
    """
    part = Window.partitionBy(*key)
    flagged = F.min(F.when(F.col("is_anchor"), F.col("row"))).over(part)
    at = cells.withColumn("__a", F.coalesce(flagged, F.min("row").over(part)))
    own = F.col("text") if override is None else F.coalesce(override, F.col("text"))
    seen = at.withColumn("__own", F.when(F.col("row") == F.col("__a"), own).otherwise(F.col("text")))
    seen = seen.withColumn("__s", T.split_anchor(F.first(F.when(F.col("row") == F.col("__a"), F.col("__own")), ignorenulls=True).over(part)))
    value = F.col("__s.number") + F.col("row") - F.col("__a")
    anchor = F.col("row") == F.col("__a")
    reach = F.col("__s").isNotNull() & (anchor | (F.col("row") > F.col("__a")) | (value > 0))
    manual = F.coalesce(F.col("is_manual_edit"), F.lit(False)) & ~anchor & F.lit(not overwrite_manual)
    fill = reach & ~manual
    written = T.zero_padded(F.col("__s.prefix"), value, F.col("__s.width"))
    same = [c for c in cells.columns if c not in ("text", "score", "is_anchor", "is_manual_edit", "is_extrapolated", "skip_ocr", "is_blank")]
    return seen.select(
        *same,
        F.when(fill, written).otherwise(F.col("__own")).alias("text"),
        F.when(fill & anchor, F.greatest(F.coalesce("score", F.lit(-1)), F.lit(100))).when(fill, F.greatest(F.coalesce("score", F.lit(-1)), F.lit(70))).otherwise(F.col("score")).cast("int").alias("score"),
        anchor.alias("is_anchor"),
        (F.coalesce(F.col("is_manual_edit"), F.lit(False)) & ~fill).alias("is_manual_edit"),
        (fill & ~anchor).alias("is_extrapolated"),
        fill.alias("skip_ocr"),
        (reach & manual).alias("is_preserved"),
    )


def rebuild_stats(rebuilt: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return rebuilt.groupBy(*key).agg(
        F.max(F.when(F.col("is_anchor"), F.col("text"))).alias("anchor"),
        F.count_if(F.col("skip_ocr")).alias("filled"),
        F.count_if(F.col("is_preserved")).alias("preserved"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"),
    )


def find_anchor(observed: Column, row: Column, part, digits: tuple[int, int] = (4, 7), best: int | None = 5) -> Column:
    """Row of the cell with the most plausible number (``digits`` long, best ``best``), ties to the earliest.

    Where the form's numbers have no usual length, ``best`` is None and the first plausible number is taken.
    """
    n = F.length(T.digits_only(observed))
    score = F.when(n.between(*digits), F.lit(100) if best is None else 100 - F.abs(best - n))
    return F.max_by(F.when(score.isNotNull(), row), F.when(score.isNotNull(), F.struct(score, -row))).over(part)


def initial(cells: DataFrame, header_number: str | None = None, key: tuple[str, ...] = KEY, digits: tuple[int, int] = (4, 7), best: int | None = 5) -> DataFrame:
    """Number a column along its non-blank cells from the best observed number.

    Reads row, observed and is_blank. Without an anchor a header number of 4 digits or more stands for the
    row above the first cell; without either, digits that were observed stay at score 30. ``digits`` and
    ``best`` are those of ``find_anchor``.
    """
    part = Window.partitionBy(*key)
    upto = part.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inked = ~F.coalesce(F.col("is_blank"), F.lit(False))
    read = F.when(inked, F.coalesce("observed", F.lit("")))
    placed = cells.withColumn("__rank", F.when(inked, F.count_if(inked).over(upto) - 1)).withColumn("__a", find_anchor(read, F.col("row"), part, digits, best))
    at_anchor = F.col("row") == F.col("__a")
    from_cell = F.max(F.when(at_anchor, T.parse_anchor(F.col("observed")) - F.col("__rank"))).over(part)
    head = F.col(header_number) if header_number else F.lit(None).cast("string")
    from_header = F.when(F.length(T.digits_only(head)) >= 4, T.parse_anchor(head) + 1)
    begun = placed.withColumn("__start", F.coalesce(from_cell, from_header))
    good = F.coalesce(F.col("__start") > 0, F.lit(False))
    value = (F.col("__start") + F.col("__rank")).cast("string")
    agrees = F.coalesce(F.col("observed").rlike("^[0-9]+$") & (F.right("observed", F.lit(1)) == F.right(value, F.lit(1))), F.lit(False))
    anchor = F.coalesce(at_anchor, F.lit(False)) & good
    lone = F.coalesce(F.col("observed").rlike("^[0-9]+$"), F.lit(False))
    return begun.select(
        *cells.columns,
        F.when(~inked, "").when(good, value).when(lone, F.col("observed")).otherwise("").alias("text"),
        F.when(~inked, -1).when(anchor, 100).when(good & agrees, 100).when(good, 70).when(lone, 30).otherwise(-1).alias("score"),
        anchor.alias("is_anchor"),
        (inked & good & ~anchor & ~agrees).alias("is_extrapolated"),
    )


def initial_stats(numbered: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    inked = F.col("text") != ""
    return numbered.groupBy(*key).agg(
        F.count_if(inked & (F.col("score") == 100)).alias("verified"),
        F.count_if(inked & F.col("is_extrapolated") & (F.coalesce("observed", F.lit("")) != "")).alias("mismatches"),
        F.count_if(inked & F.col("is_extrapolated")).alias("extrapolated"),
    )


def resolve_ditto(df: DataFrame, column: str, partition: list[str], order: list[str]) -> DataFrame:
    """Extension: a ditto mark becomes the last value above it."""
    above = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("resolved", F.last(F.nullif(T.canonical_ditto(F.col(column)), F.lit(T.DITTO)), ignorenulls=True).over(above))


def contiguous(df: DataFrame, number: Column, partition: list[str]) -> DataFrame:
    """Whether each group's numbers are all distinct and without a gap."""
    n = F.count(number)
    return df.groupBy(*partition).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), n.alias("n"), ((F.max(number) - F.min(number) + 1 == n) & (F.count_distinct(number) == n)).alias("contiguous"))
