"""The cell record: its defaults, and the stages that decide before any recogniser runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..functions import text as T

def defaults() -> dict[str, Column]:
    """What a missing or null field of a cell reads as."""
    return {
        "text": F.lit(""),
        "score": F.lit(-1),
        "skip_ocr": F.lit(False),
        "is_blank": F.lit(False),
        "is_anchor": F.lit(False),
        "is_extrapolated": F.lit(False),
        "is_manual_edit": F.lit(False),
        "predictions": F.create_map().cast("map<string,string>"),
        "alternatives": F.array().cast("array<string>"),
    }


def format_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with every field of the record; columns beyond it stay as they are.

    ``image`` and ``image_raw`` stand in for each other. Cells with neither keep their text, score and
    skip; all others pass the blank gate, and blank ones become final: '', -1, skipped.
    """
    have = set(cells.columns)
    none = F.lit(None).cast("binary")
    raw = F.coalesce(*[F.col(c) for c in ("image_raw", "image") if c in have], none)
    image = F.coalesce(*[F.col(c) for c in ("image", "image_raw") if c in have], none)
    filled = {c: F.coalesce(F.col(c), d) if c in have else d for c, d in defaults().items()}
    crops = [c for c in ("image_raw", "image") if c in have]
    marked = images.with_blank(cells, "__blank", crops) if crops else cells.withColumn("__blank", F.lit(None).cast("boolean"))
    full = marked.withColumns({**filled, "image": image, "image_raw": raw})
    blank = F.coalesce("__blank", F.lit(False))
    return full.withColumns(
        {
            "is_blank": F.col("is_blank") & F.col("image_raw").isNull() | blank,
            "skip_ocr": F.col("skip_ocr") | blank,
            "text": F.when(blank, "").otherwise(F.col("text")),
            "score": F.when(blank, -1).otherwise(F.col("score")),
        }
    ).drop("__blank")


def ditto_stage(cells: DataFrame) -> DataFrame:
    """Cells whose crop is a ditto mark become '"' at 100 and final; others that were looked at are open again.

    Headers, number columns (role batch), blank, final and imageless cells are not looked at. A crop
    without ink is blank, not ditto. Marks are found by ink, in species columns by shape, too.
    """
    looked = (F.col("row") > 0) & (F.coalesce("role", F.lit("")) != "batch") & ~F.col("is_blank") & ~F.col("skip_ocr") & F.col("image").isNotNull()
    seen = images.with_mark(cells.withColumn("__looked", looked), "__mark", ["image"], "__looked")
    looked = F.col("__looked")
    blank = looked & (F.col("__mark") == "blank")
    ditto = looked & ((F.col("__mark") == "ink") | (F.col("__mark") == "shape") & (F.coalesce("role", F.lit("")) == "species"))
    return seen.withColumns(
        {
            "is_blank": F.col("is_blank") | F.coalesce(blank, F.lit(False)),
            "text": F.when(ditto, T.DITTO).otherwise(F.col("text")),
            "score": F.when(ditto, 100).otherwise(F.col("score")),
            "skip_ocr": F.when(looked, F.coalesce(blank | ditto, F.lit(False))).otherwise(F.col("skip_ocr")),
        }
    ).drop("__mark", "__looked")


def skip_fuzzy(text: Column, predictions: Column) -> Column:
    """Whether a cell is left out of snapping: a ditto mark, or no text and no reading at all."""
    shown = T.clean(text)
    return (shown == T.DITTO) | (shown == "") & (F.coalesce(F.size(predictions), F.lit(0)) <= 0)
