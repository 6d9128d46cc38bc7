import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import similarity as S
from quillgrid.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def plain_normalise(raw):
    """The rule, one character class at a time."""
    found = re.search(r"-?[0-9]+([.,][0-9]+)?", raw)
    if not found:
        return None
    number = found.group().replace(",", ".")
    if "." in number:
        return number.lstrip("0") or "0"
    sign, digits = ("-", number[1:]) if number.startswith("-") else ("", number)
    digits = digits.lstrip("0") or "0"
    return digits if digits == "0" else sign + digits


def test_normalise(spark):
    rng = random.Random(1)
    raw = ["".join(rng.choices("0059-,. kg", k=rng.randint(0, 8))) for _ in range(400)]
    got = spark.createDataFrame([(r,) for r in raw], "x string").select("x", T.normalise(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(r, plain_normalise(r)) for r in raw]


def test_digits_and_separators(spark):
    rng = random.Random(2)
    raw = ["".join(rng.choices("07.:,/- hé", k=rng.randint(0, 7))) for _ in range(300)]
    got = spark.createDataFrame([(r,) for r in raw], "x string").select("x", T.digits_key(F.col("x")).alias("k"), T.compound_display(F.col("x")).alias("d")).collect()
    for r in got:
        assert r.k == ("".join(c for c in r.x if c in "07") or None)
        assert r.d == ("".join(c for c in r.x if c in "07.:,/-").strip(".:,/-") or None)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("7", ("", 7, 1)), ("xy.0042", ("XY", 42, 4)), ("  q - 3\t", ("Q", 3, 1)), ("abcde12", ("", 12, 2)), ("12/34", ("", 1234, 4)), ("z0", ("Z", 0, 1)), ("…", None), (None, None)],
)
def test_split_anchor(spark, raw, want):
    got = one(spark, raw, T.split_anchor)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 61.54), ("abc", "cba", 33.33), ("ab ab", "ba ba", 60.0), ("", "", 100.0), ("", "z", 0.0)])
def test_ratio(spark, a, b, want):
    assert round(spark.createDataFrame([(a, b)], "a string, b string").select(S.ratio(F.col("a"), F.col("b")).alias("r")).first().r, 2) == want


def test_lcs_matrix():
    rng = random.Random(4)
    some = ["".join(rng.choices("abcé𝒳 ", k=rng.choice([0, 1, 3, 20, 63, 64, 65, 130]))) for _ in range(40)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda left, j, old=row, x=x: old[j - 1] + 1 if b[j - 1] == x else max(old[j], left), initial=0)][1:]
        return row[-1]

    assert S.lcs_matrix(some, some[::3]).tolist() == [[lcs(a, b) for b in some[::3]] for a in some]
    assert S.lcs_matrix(["a"], [""]).tolist() == [[0]] and S.lcs_matrix([], ["a"]).shape == (0, 1)


def test_extract_best_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "READING_ROWS", 3)
    monkeypatch.setattr(S, "NAME_ROWS", 2)
    words = ["meise kohl", "kohl meise", "amsel", "star", "stare", "", None, "kleiber"]
    names = spark.createDataFrame([(w, 7 - i) for i, w in enumerate(words)] + [("amsel", 9)], "name string, idx int")
    got = S.extract_best(spark.createDataFrame([(w,) for w in [*words, "stark", "amse"]], "reading string"), names, top=2).collect()
    best = {r.reading: (r.name, round(r.score, 2)) for r in got if r["rank"] == 1}
    assert best == {"meise kohl": ("kohl meise", 100.0), "kohl meise": ("kohl meise", 100.0), "amsel": ("amsel", 100.0), "star": ("star", 100.0), "stare": ("stare", 100.0), "": ("", 100.0), "kleiber": ("kleiber", 100.0), "stark": ("star", 88.89), "amse": ("amsel", 88.89)}
    assert len(got) == 18 and S.extract_best(names.select(F.col("name").alias("reading")), names.where("false")).count() == 0


def test_marks_names_and_padding(spark):
    assert [one(spark, x, T.canonical_ditto) for x in (" “ ", "ii", "i", None)] == ['"', '"', "i", ""]
    assert one(spark, "Zürcher Ölkäfer", lambda c: T.same_name(c, F.lit("zurcher olkafer"))) is True
    assert one(spark, "cafe\u0301", T.composed) == "caf\u00e9"
    assert one(spark, "98765", lambda c: T.zero_padded(F.lit("K"), c.cast("long"), F.lit(2))) == "K98765"
    assert one(spark, " \u00a0Größe: 3_m! ", T.process) == "größe  3_m"
    reads = spark.createDataFrame([(["1234567890 22", "", "777", "no 5555 no", "666666"],)], "x array<string>")
    assert reads.select(T.longest_digit_run(F.col("x")).alias("y")).first().y == ["666666", "5555", "1234567890"]
    assert one(spark, "straße", T.transliterate) == "strasse" and one(spark, "Wing (mm)", T.before_parenthesis) == "Wing "


def test_let_computes_once(spark):
    """A let keeps a filter's copy of nested steps linear in size."""
    value = F.col("x")
    for _ in range(12):
        value = T.let(value, lambda v: F.when(v.contains("a"), F.concat(v, F.lit("b"))).when(F.length(v) > 9, F.substring(v, 2, 9)).otherwise(F.concat(v, F.lit("a"))))
    df = spark.createDataFrame([("",)], "x string").withColumn("y", value).where("y <> 'q'")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 40_000 and df.first().y == "abbbbbbbbbbb"
