"""Readers of forms, labels and pages."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

ROLE_SCHEMA = (
    "role string, label string, keywords array<string>, width_share array<double>, models array<string>, value_range array<double>, digit_count array<int>, enabled boolean"
)


def pages(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Page images below ``path``: doc_id (folder), page (order of the names), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select(folder.alias("doc_id"), (F.row_number().over(Window.partitionBy(folder).orderBy("path")) - 1).alias("page"), "path", "content")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with whether they are PDF, by their first bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.expr("startswith(content, X'25504446')").alias("is_pdf"), "content")


def rasterise(files: DataFrame, render) -> DataFrame:
    """Pages of PDF files through ``render(bytes) -> list[bytes]``; other files are one page each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, pdf, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                images = render(data) if pdf else [data]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(images)), pa.array(range(len(images)), pa.int32()), pa.array(images, pa.binary())], ["doc_id", "page", "content"])

    return files.select("path", "is_pdf", "content").mapInArrow(run, "doc_id string, page int, content binary")


#: The form that stands in where no schema file is usable (role, keywords, least and greatest share of the width).
DEFAULT_FORM = [
    ("batch", ["bague", "bague no", "numero", "nummer"], 0.04, 0.14),
    ("species", ["espece", "espèce", "art"], 0.15, 0.38),
    ("sexe", ["sexe", "d'sexe", "sex"], 0.03, 0.11),
    ("age", ["age", "âge", "alter"], 0.05, 0.14),
    ("jour_mois", ["jour mois", "jour", "mois"], 0.05, 0.15),
    ("heure", ["heure"], 0.03, 0.11),
    ("aile", ["aile", "alle", "aiie"], 0.04, 0.13),
    ("poids", ["poids", "polds"], 0.03, 0.12),
]


def default_form(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, role, None, words, None, True, lo, hi, None, None, None, None) for i, (role, words, lo, hi) in enumerate(DEFAULT_FORM)]
    return spark.createDataFrame(
        rows,
        "pos int, role string, label string, keywords array<string>, models array<string>, enabled boolean, width_lo double, width_hi double, "
        "value_lo double, value_hi double, digits_lo int, digits_hi int",
    )


def form_schema(spark: SparkSession, *paths: str) -> DataFrame:
    """Roles of the first path that can be read and names columns, else the built-in form: pos, role, label, keywords, widths, ranges.

    A form has few roles, so the file is read when the schema is asked for; a missing or malformed one is passed over.
    """
    for path in paths:
        try:
            fields = ", ".join(x.replace(" ", ":", 1) for x in ROLE_SCHEMA.split(", "))
            raw = spark.read.schema(f"columns array<struct<{fields}>>").json(path, multiLine=True)
            found = raw.select(F.posexplode("columns").alias("pos", "c")).select((F.col("pos") + 1).alias("pos"), "c.*")
            if not found.isEmpty():
                pair = lambda c, i: F.get(c, F.lit(i))
                return found.select(
                    "pos", "role", "label", "keywords", "models", F.coalesce("enabled", F.lit(True)).alias("enabled"),
                    *[pair(c, i).alias(f"{n}_{e}") for c, n in (("width_share", "width"), ("value_range", "value"), ("digit_count", "digits")) for i, e in enumerate(("lo", "hi"))],
                )
        except PySparkException as e:
            log.warning("form schema %s passed over: %s", path, e.getCondition())
    return default_form(spark)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, line) of text files in file order, without a byte order mark or carriage returns."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("v"))
    lines = whole.select("path", F.posexplode(F.split("v", "\r?\n")).alias("row", "line"))
    return lines.where("line <> ''")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pages: path, row (1 is the first below the header), and the nine columns; all-empty rows stay."""
    names = ["bague_no", "espece", "sexe", "age", "jour_mois", "heure", "aile", "poids", "notes"]
    fields = F.from_csv("line", F.lit(", ".join(f"{n} string" for n in names)), {"sep": ";"})
    rows = numbered_lines(spark, path).where("row > 0").select("path", "row", fields.alias("f"))
    return rows.select("path", "row", *[F.coalesce(F.col(f"f.{n}"), F.lit("")).alias(n) for n in names])


def digit_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="filename string, label string")


def recogniser_export(spark: SparkSession, path: str) -> DataFrame:
    schema = "row int, label string, digit string, yolo string, trocr string, htr_vt string, text string, score int"
    return spark.read.csv(path, schema=schema, header=True, escape='"', enforceSchema=True)


def image_folder(spark: SparkSession, path: str, train_share: int = 80) -> DataFrame:
    """Images with their class (folder) and a split by hashed path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    split = F.when(F.crc32("path") % 100 < train_share, "train").otherwise("test")
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), split.alias("split"), "content")


def listed_texts(spark: SparkSession, listing: str, folder: str) -> DataFrame:
    """(path, text) of the label files that ``listing`` names, one a line, relative to ``folder``."""
    wanted = spark.read.text(listing).select(F.regexp_replace(F.trim("value"), r"\.[^./]+$", ".txt").alias("name")).where("name <> ''")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.join(wanted.distinct(), F.element_at(F.split("path", "/"), -1) == F.element_at(F.split("name", "/"), -1), "left_semi")


def alphabet(texts: DataFrame, column: str) -> DataFrame:
    """Distinct characters of white-space-normalised text, in order."""
    letters = texts.select(F.explode(F.split(F.regexp_replace(column, r"\s+", " "), "")).alias("symbol")).where("symbol <> ''")
    return letters.distinct().orderBy("symbol")


def html_title(html):
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
