"""Text rules of form cells as Column functions. Values are strings; null, missing and '' mean the same."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DITTO = '"'
#: The spellings of a ditto mark.
DITTO_MARKS = ['"', "„", "''", "//", "ii", "“", "”"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it.

    Projections that are merged, and filters that are pushed below them, would copy it once for each mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all Unicode white space (the built-in trim takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def composed(c: Column) -> Column:
    """Unicode normal form C. Spark has no function for it; catalogues are small."""

    def nfc(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(nfc, "string")(c)


def clean(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def digits_key(c: Column) -> Column:
    return blank_to_null(digits_only(c))


def normalise(c: Column) -> Column:
    """First number in the text, comma as point; leading zeros go ('0.5' gives '.5'), trailing ones stay."""

    def rule(number: Column) -> Column:
        dotted = F.coalesce(blank_to_null(F.ltrim(number, F.lit("0"))), F.lit("0"))
        whole = F.regexp_replace(F.regexp_replace(number, "^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
        return F.when(number.contains("."), dotted).when(number.startswith("0") | number.startswith("-0"), whole).otherwise(number)

    return let(F.replace(blank_to_null(F.regexp_extract(c, r"-?[0-9]+(?:[.,][0-9]+)?", 0)), F.lit(","), F.lit(".")), rule)


def compound_display(c: Column) -> Column:
    """Digits and inner separators of dates and times."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(c, "[^0-9.:,/-]", ""), "^[.:,/-]+|[.:,/-]+$", ""))


def shape_score(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^[0-9]{1,3}(\.[0-9]{1,2})?$"), 80).when(c.rlike("^[0-9]+$"), 60).otherwise(20)
    )


def integer_digits(c: Column) -> Column:
    return F.length(digits_only(F.substring_index(c, ".", 1)))


def parse_anchor(c: Column) -> Column:
    return digits_only(c).try_cast("long")


def split_anchor(c: Column) -> Column:
    """struct(prefix, number, width), null where there is no digit."""
    form = r"^\s*([A-Za-z]{0,4})[\s.\-]*([0-9]{1,9})\s*$"
    digits = F.when(c.rlike(form), F.regexp_extract(c, form, 2)).otherwise(digits_only(c))
    prefix = F.when(c.rlike(form), F.upper(F.regexp_extract(c, form, 1))).otherwise("")
    number = digits.try_cast("long")
    return F.when(number.isNotNull(), F.struct(prefix.alias("prefix"), number.alias("number"), F.length(digits).alias("width")))


def zero_padded(prefix: Column, number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.concat(prefix, F.lpad(text, F.greatest(width, F.length(text)), F.lit("0")))


def process(c: Column) -> Column:
    """Lower case, everything but letters, digits and underscores to spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " "))


def canonical_ditto(c: Column) -> Column:
    return F.when(clean(c).isin(DITTO_MARKS), DITTO).otherwise(clean(c))


def same_name(a: Column, b: Column) -> Column:
    """Equality without regard to case, accents and normal form."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def transliterate(c: Column) -> Column:
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def before_parenthesis(c: Column) -> Column:
    return F.regexp_extract(c, r"^([^\(]+)", 1)


def longest_digit_run(reads: Column, least: int = 4) -> Column:
    """Longest run of each read, those of 4 to 7 digits first, then by length; ties in order of the reads."""
    runs = F.transform(reads, lambda r, i: F.struct(F.array_max(F.transform(F.regexp_extract_all(F.coalesce(r, F.lit("")), F.lit("([0-9]+)"), 1), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))).alias("m"), (-i).alias("o")))
    long_enough = F.filter(runs, lambda r: r["m"]["n"] >= least)
    ranked = F.transform(long_enough, lambda r: F.struct((r["m"]["n"] <= 7).alias("fits"), r["m"]["n"].alias("n"), r["o"].alias("o"), r["m"]["x"].alias("x")))
    return F.transform(F.sort_array(ranked, asc=False), lambda r: r["x"])


def last_digit_or(*reads: Column) -> Column:
    """Last digit of the first non-empty read."""
    return F.right(F.coalesce(*[blank_to_null(digits_only(r)) for r in reads]), F.lit(1))


def plausible_pick(*reads: Column) -> Column:
    """The read whose number of digits is most plausible; ties to the earlier one."""
    scored = [
        F.struct(
            F.when(F.length(r).between(4, 7), 2).when(F.length(r).between(2, 8), 1).otherwise(0).alias("score"), F.lit(-i).alias("o"), F.coalesce(r, F.lit("")).alias("x")
        )
        for i, r in enumerate(reads)
    ]
    return F.array_max(F.array(*scored))["x"]


def score_or_unknown(c: Column) -> Column:
    """A score of 0 reads as unknown."""
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(-1))
