"""What recognisers return: box composition, arg-max labels, CTC decoding, and which cells they may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    both = area(a) + area(b) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def compose_digits(boxes: Column, min_conf: float = 0.30, max_iou: float = 0.45) -> Column:
    """struct(text, confidence) of boxes array<struct<x0, y0, x1, y1 double, conf double, cls int>>.

    Digits only, best first (ties in input order); a box that overlaps a survivor goes; left to right.
    """
    kind = "array<struct<nconf:double,i:int,x0:double,y0:double,x1:double,y1:double,conf:double,cls:int>>"
    good = F.transform(
        boxes,
        lambda b, i: F.struct(
            (-b["conf"]).alias("nconf"), i.alias("i"), *[b[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1", "conf")], b["cls"].cast("int").alias("cls")
        ),
    )
    ranked = F.array_sort(F.filter(good, lambda b: (b["conf"] >= min_conf) & b["cls"].between(0, 9)).cast(kind))
    kept = F.aggregate(ranked, F.array().cast(kind), lambda held, b: F.when(F.exists(held, lambda s: iou(s, b) > max_iou), held).otherwise(F.concat(held, F.array(b))))
    left = F.array_sort(F.transform(kept, lambda b: F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), b["nconf"].alias("nconf"), b["i"].alias("i"), b["cls"].alias("cls"))))
    mean = F.aggregate(kept, F.lit(0.0), lambda s, b: s + b["conf"]) / F.greatest(F.size(kept), F.lit(1))
    return F.struct(F.array_join(F.transform(left, lambda b: b["cls"].cast("string")), "").alias("text"), F.when(F.size(kept) > 0, mean).otherwise(0.0).alias("confidence"))


def argmax_label(probabilities: Column, labels: list[str], least: float = 0.5) -> Column:
    """struct(label, score): the first greatest entry, as a percentage, if it reaches ``least`` and has a label."""
    top = F.array_max(probabilities)
    at = F.array_position(probabilities, top).cast("int")
    known = (top >= least) & (at <= len(labels)) & (at > 0)
    return F.when(known, F.struct(F.get(F.array(*[F.lit(x) for x in labels]), at - 1).alias("label"), F.bround(top * 100).cast("int").alias("score")))


def ctc_collapse(steps: Column, blank: int, alphabet: Column | None = None) -> Column:
    """Repeats collapse, blanks and -1 go; symbols joined by ``alphabet`` if given, else the numbers."""
    kept = F.filter(steps, lambda x, i: (x != blank) & (x != -1) & F.coalesce(x != F.get(steps, i - 1), F.lit(True)))
    if alphabet is None:
        return kept
    return F.array_join(F.transform(kept, lambda x: F.get(alphabet, x)), "")


def eligible(roles: tuple[str, ...] = (), only_empty: bool = False) -> Column:
    """Cells that a recogniser reads; written below the Python node, so that it sees no other rows."""
    ok = (F.col("row") > 0) & ~F.coalesce(F.col("is_blank"), F.lit(False)) & ~F.coalesce(F.col("skip_ocr"), F.lit(False))
    if only_empty:
        ok = ok & (F.coalesce(F.col("text"), F.lit("")) == "")
    return ok & F.col("role").isin(*roles) if roles else ok


def add_reading(cells: DataFrame, voice: str, reading: Column, provisional: int | None) -> DataFrame:
    """Store a non-empty reading under its voice; an empty cell shows it at the provisional score."""
    read = F.coalesce(reading, F.lit(""))
    there = read != ""
    old = F.coalesce("predictions", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: k != voice), F.create_map(F.lit(voice), read))
    out = cells.withColumn("predictions", F.when(there, merged).otherwise(old))
    if provisional is None:
        return out
    fresh = there & (F.coalesce(F.col("text"), F.lit("")) == "")
    return out.withColumns({"text": F.when(fresh, read).otherwise(F.col("text")), "score": F.when(fresh, provisional).otherwise(F.col("score"))})
