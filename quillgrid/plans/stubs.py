"""Deterministic stubs of the recognisers, for tests and for trying a plan without any model.

A stub reads no handwriting: it returns a digest of the crop in the form that the real recogniser would use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detections
from .pipeline import Recognisers

NUMBERS = ("batch", "jour_mois", "heure", "aile", "poids")


def _digest(salt: str) -> Column:
    return F.crc32(F.concat(F.lit(salt).cast("binary"), F.col("image")))


def stub_htr_vt() -> Column:
    """Letters, as the collapsed path of a line recogniser."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.floor(_digest("htr_vt") / F.pow(F.lit(2), i * 4)), F.lit(27)).cast("int"))
    alphabet = F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), "")
    return detections.ctc_collapse(F.transform(steps, lambda s: s - 1), -1, alphabet)


def stub_trocr() -> Column:
    return F.concat(F.lit("t"), _digest("trocr").cast("string"))


def stub_tesseract() -> Column:
    return T.digits_only(F.concat(F.lit("no "), F.pmod(_digest("tesseract"), F.lit(100_000)).cast("string")))


def stub_crnn() -> Column:
    return F.pmod(_digest("crnn"), F.lit(1000)).cast("string")


def stub_yolo() -> Column:
    """Two boxes side by side, composed like real detections."""
    digit = lambda at: F.pmod(F.shiftright(_digest("yolo").cast("long"), at), F.lit(10)).cast("int")
    box = lambda x, at: F.struct(F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 8).alias("x1"), F.lit(9.0).alias("y1"), F.lit(0.9).alias("conf"), digit(at).alias("cls"))
    return detections.compose_digits(F.array(box(10.0, 0), box(0.0, 8)))["text"]


def _reader(voice: str, reading: Callable[[], Column], roles: tuple[str, ...], provisional: int | None, only_empty: bool = False):
    def run(cells: DataFrame) -> DataFrame:
        asked = detections.eligible(roles, only_empty) & F.col("image").isNotNull()
        return detections.add_reading(cells, voice, F.when(asked, reading()), provisional)

    return run


def _numbers(cells: DataFrame) -> DataFrame:
    """Voice digit: the most plausible of two readers; voice yolo on its own."""
    asked = detections.eligible(NUMBERS) & F.col("image").isNotNull()
    digit = F.when(asked, T.plausible_pick(stub_tesseract(), stub_crnn()))
    return detections.add_reading(detections.add_reading(cells, "digit", digit, 70), "yolo", F.when(asked, stub_yolo()), 70)


def stub_recognisers() -> Recognisers:
    """A registry with a stub for each recogniser."""
    known = Recognisers()
    known.register("htr_vt", _reader("htr_vt", stub_htr_vt, ("species",), 70, only_empty=True))
    known.register("trocr", _reader("trocr", stub_trocr, ("species", "age", *NUMBERS[1:]), 50))
    known.register("digits", _numbers)
    return known
