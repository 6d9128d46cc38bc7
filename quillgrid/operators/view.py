"""Views of a page: labels, pivot, confidence, tallies, review, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The labels of the roles, in order of the form.
LABELS = {"batch": "Bague", "species": "Espèce", "sexe": "Sexe", "age": "Age", "jour_mois": "Jour/Mois", "heure": "Heure", "aile": "Aile", "poids": "Poids"}


def column_label(role: Column, col: Column) -> Column:
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(label, role), F.concat(F.lit("Spalte "), (col + 1).cast("string")))


def visible_columns(columns: DataFrame, page: list[str]) -> DataFrame:
    """Labels of a page's columns, repeated ones numbered, in form order (unknown and numbered ones last)."""
    named = columns.withColumn("__label", column_label(F.col("role"), F.col("col")))
    nth = F.row_number().over(Window.partitionBy(*page, "__label").orderBy("col"))
    label = F.when(F.col("__n") > 1, F.concat("__label", F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))).otherwise(F.col("__label"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LABELS.values()]), F.col("label")), F.lit(0))
    shown = named.withColumn("__n", nth).withColumn("label", label).withColumn("rank", F.when(rank > 0, rank - 1).otherwise(999).cast("int"))
    return shown.select(*columns.columns, "label", "rank").withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("rank", "col")))


def page_pivot(cells: DataFrame, key: list[str], labels: list[str]) -> DataFrame:
    """One row per form row, one column per label; missing cells are ''. The labels are given, so no extra job finds them."""
    return cells.where("row > 0").groupBy(*key, "row").pivot("label", labels).agg(F.first(T.clean(F.col("text")))).na.fill("", labels)


def level(score: Column) -> Column:
    return F.when(score >= 95, "green").when(score >= 60, "yellow").when(score >= 0, "red").otherwise("white")


def row_confidence(cells: DataFrame, key: list[str]) -> DataFrame:
    """Least known score of each row, its level, and whether any cell has alternatives."""
    known = T.score_or_unknown(F.col("score"))
    rows = cells.groupBy(*key).agg(F.coalesce(F.min(F.when(known >= 0, known)), F.lit(-1)).alias("score"), F.bool_or(F.size("alternatives") > 0).alias("has_alternatives"))
    return rows.withColumn("level", level(F.col("score")))


#: The sign of each level, and of a row with alternatives.
SIGNS = {"green": "🟢", "yellow": "🟡", "red": "🔴", "white": "⬜"}
CHOICE = "↔"


def status_columns(rows: DataFrame, confidence: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the sign of their level in front; a last column marks rows with alternatives, if any row has some.

    Whether that column exists depends on the data, so one row of ``confidence`` is asked for.
    """
    sign = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    met = rows.join(confidence.select(*key, "level", "has_alternatives"), key, "left")
    first = F.coalesce(F.try_element_at(sign, F.col("level")), F.lit(SIGNS["white"])).alias("✓")
    if confidence.where("has_alternatives").isEmpty():
        return met.select(first, *rows.columns)
    return met.select(first, *rows.columns, F.when(F.col("has_alternatives"), CHOICE).otherwise("").alias("⚠"))


def tallies(cells: DataFrame, doc: str, page: str) -> DataFrame:
    """Counts by confidence for each page and for the whole document (page null), in one pass."""
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    s = T.score_or_unknown(F.col("score"))
    marked = cells.select(doc, page, empty.alias("e"), (~empty & (s >= 95)).alias("h"), (~empty & s.between(60, 94)).alias("m"), (~empty & s.between(0, 59)).alias("l"))
    counts = [F.count("*").alias("total"), F.count_if("e").alias("empty"), F.count_if("h").alias("high"), F.count_if("m").alias("medium"), F.count_if("l").alias("low")]
    out = marked.groupingSets([[F.col(doc), F.col(page)], [F.col(doc)]], F.col(doc), F.col(page)).agg(*counts)
    return out.withColumn("percent", F.bround(F.col("high") * 100 / F.greatest("total", F.lit(1))).cast("int"))


def review_items(cells: DataFrame, order: list[str], limit: int | None = 30) -> DataFrame:
    """Cells under 95 that have alternatives, with the first of them; a report, so cut to its first ``limit``."""
    s = T.score_or_unknown(F.col("score"))
    items = cells.where((s < 95) & (F.size("alternatives") > 0)).select(*order, F.col("text").alias("chosen"), F.get("alternatives", F.lit(0)).alias("alternative"), s.alias("score"))
    return items if limit is None else items.orderBy(*order, "chosen", "alternative", "score").limit(limit)


def needs_review(score: Column, has_alternatives: Column) -> Column:
    return level(score).isin("red", "yellow") | has_alternatives


def model_comparison(cells: DataFrame, voices: list[str], key: list[str]) -> DataFrame:
    """One row per cell with readings, one column per voice."""
    return cells.where(F.size("predictions") > 0).select(*key, *[F.coalesce(F.try_element_at("predictions", F.lit(v)), F.lit("")).alias(v) for v in voices], "text", "score")


def unpivot_voices(df: DataFrame, key: list[str], voices: list[str]) -> DataFrame:
    return df.unpivot(key, voices, "voice", "reading").where(F.coalesce(F.col("reading"), F.lit("")) != "")
