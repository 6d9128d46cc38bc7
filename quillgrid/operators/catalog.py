"""Catalogues of names and options."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Options that each catalogue starts with.
OPTIONS = {
    "sexe": ["", "m", "w", "f", "(m)", "(w)", "(f)", "m?", "w?", "f?", "?", "X", '"'],
    "age": ["", "Fd", "Fnd", '"'],
}


def name_indices(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx) of a JSON file: {name: idx}, {"classes": [...]} or a list."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    mapped = F.from_json("v", "map<string,int>")
    listed = F.coalesce(F.when(F.trim("v").startswith("["), F.from_json("v", "array<string>")), F.from_json("v", "struct<classes:array<string>>")["classes"])
    rows = raw.select(listed.alias("l"), F.when(listed.isNull(), mapped).alias("m"))
    from_list = rows.select(F.posexplode("l").alias("idx", "name")).select("name", "idx")
    return from_list.union(rows.select(F.explode("m").alias("name", "idx")))


def merge(default: DataFrame, custom: DataFrame) -> DataFrame:
    """(name, idx): custom entries override, blank names and the ditto mark go, names are in normal form C and distinct."""
    both = default.select("name", "idx", F.lit(1).alias("rank")).union(custom.select("name", "idx", F.lit(0)))
    usable = both.where((T.clean(F.col("name")) != "") & (F.col("name") != T.DITTO)).withColumn("name", T.composed(F.col("name")))
    return usable.groupBy("name").agg(F.min_by("idx", F.struct("rank", "idx")).alias("idx"))


def sorted_names(catalog: DataFrame) -> DataFrame:
    """The names of a merged catalogue, in code point order."""
    return catalog.select("name").distinct().orderBy("name")


def class_labels(indices: DataFrame) -> DataFrame:
    """Names by their index (S5); names of equal or null index by name, null ones last."""
    return indices.orderBy(F.asc_nulls_last("idx"), "name")


def load_options(name: str, path: str | None = None) -> list[str]:
    """The options of a catalogue: a readable JSON list at ``path``, with "" added in front if it lacks it, else the defaults."""
    try:
        listed = json.loads(Path(path).read_text(encoding="utf-8")) if path else None
    except (OSError, ValueError):
        listed = None
    if not isinstance(listed, list):
        return list(OPTIONS.get(name, [""]))
    options = [str(x) for x in listed]
    return options if "" in options else ["", *options]


def known(names: DataFrame, catalog: DataFrame, column: str = "name") -> DataFrame:
    """Rows of ``names`` whose name is in the catalogue, without regard to case and accents."""
    return names.join(catalog.select(F.col("name").alias("__n")), T.same_name(names[column], F.col("__n")), "left_semi")


def unknown(names: DataFrame, catalog: DataFrame, column: str = "name") -> DataFrame:
    return names.join(catalog.select(F.col("name").alias("__n")), T.same_name(names[column], F.col("__n")), "left_anti")


def append(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """The catalogue with the new ones of ``names``; numbers go on after the largest."""
    clean = names.select(T.clean(F.col("name")).alias("name")).where((F.col("name") != "") & (F.col("name") != T.DITTO))
    fresh = unknown(clean, catalog).groupBy(F.collate("name", "UNICODE_CI_AI").alias("k")).agg(F.min("name").alias("name"))
    top = catalog.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("top"))
    numbered = fresh.withColumn("n", F.row_number().over(Window.orderBy("name"))).join(F.broadcast(top), F.lit(True))
    return catalog.select("name", "idx").union(numbered.select("name", (F.col("top") + F.col("n")).cast("int")))


def options_with_present(catalog: list[str], present: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(pos, value): the catalogue's options, then values that occur in order of their first row."""
    values = [("", -1), *[(v, i) for i, v in enumerate(catalog) if v != ""]]
    spark = present.sparkSession
    fixed = spark.createDataFrame(values, "value string, pos int")
    seen = present.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order)).alias("at"))
    extra = seen.join(F.broadcast(fixed), "value", "left_anti").withColumn("pos", F.row_number().over(Window.orderBy("at")) + len(catalog)).select("value", "pos")
    return fixed.union(extra).select(F.row_number().over(Window.orderBy("pos")).alias("pos"), "value")


def recognition_labels(options: list[str]) -> list[str]:
    return [o for o in options if o not in ("", T.DITTO)]


def add_option(options: list[str], value: str) -> list[str]:
    value = value.strip()
    return options if not value or value in options else [*options, value]


def remove_option(options: list[str], value: str) -> list[str]:
    return options if value == "" or value not in options else [o for o in options if o != value]


def reset_json(path: str) -> bool:
    """Drop a saved override; whether there was one."""
    try:
        Path(path).unlink()
    except FileNotFoundError:
        return False
    return True


def save_json(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=isinstance(value, dict)), encoding="utf-8")
