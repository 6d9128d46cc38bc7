"""Voting between recognisers, arbitration, and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import extract_best, ratio

VOICES = ("digit", "yolo", "trocr")
#: What a lone voice scores, in order of the voices.
LONE_SCORE = (60, 55, 50)
DECIMAL, COMPOUND = ("aile", "poids"), ("heure", "jour_mois")


def is_decimal(role: Column) -> Column:
    return role.isin(*DECIMAL)


def _each(a: Column, n: int) -> list[Column]:
    return [F.get(a, F.lit(i)) for i in range(n)]


def adopt_dotted(shown: list[Column], digits: list[Column]) -> list[Column]:
    """An undotted decimal adopts the only dotted vote with its digits."""
    dotted = [d.contains(".") for d in shown]

    def adopt(i: int) -> Column:
        twins = F.array_distinct(F.array_compact(F.array(*[F.when(dotted[j] & (digits[j] == digits[i]), shown[j]) for j in range(len(shown)) if j != i])))
        return F.when(dotted[i], shown[i]).otherwise(T.let(twins, lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))).otherwise(shown[i])))

    return [adopt(i) for i in range(len(shown))]


def ranked_buckets(shown: list[Column], keys: list[Column]) -> Column:
    """Buckets of equal keys, best first: most votes, best shape, earliest voice. Display: the longest, then the first."""

    def bucket(i: int) -> Column:
        own = [keys[j] == keys[i] for j in range(len(keys))]
        members = F.array_compact(F.array(*[F.when(own[j], F.struct(F.length(d).alias("n"), F.lit(-j).alias("o"), d.alias("disp"), T.shape_score(d).alias("shape"))) for j, d in enumerate(shown)]))
        made = lambda m: F.struct(F.size(m).alias("n"), F.array_max(m["shape"]).alias("shape"), F.lit(-i).alias("first"), F.array_max(m)["disp"].alias("disp"))
        later = F.lit(False)
        for j in range(i):
            later = later | F.coalesce(own[j], F.lit(False))
        return F.when(keys[i].isNotNull() & ~later, T.let(members, made))

    return F.sort_array(F.array_compact(F.array(*[bucket(i) for i in range(len(keys))])), asc=False)


def majority(voices: list[Column], decimal: Column) -> Column:
    """struct(text, score, alternatives): the majority of the voices. Each step is bound once, so its size is linear."""
    n = len(voices)
    none = F.array().cast("array<string>")

    def outcome(votes: Column, first: Column, top: Column, names: Column) -> Column:
        lone = F.element_at(F.array(*[F.lit(s) for s in LONE_SCORE]), first + 1)
        score = F.when(votes == 0, -1).when(votes == 1, lone).when(top == votes, 100).when(top >= 2, 90).otherwise(60)
        rest = F.when(F.size(names) > 1, F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(none)
        return F.struct(F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("text"), score.cast("int").alias("score"), rest.alias("alternatives"))

    def decide(shown: Column) -> Column:
        d = _each(shown, n)
        there = F.array_compact(shown)
        votes, first = F.size(there), F.coalesce(*[F.when(x.isNotNull(), F.lit(i)) for i, x in enumerate(d)], F.lit(0))
        digits = F.array(*[F.translate(x, "-.", "") for x in d])
        merged = T.let(digits, lambda g: F.when(decimal, F.array(*adopt_dotted(d, _each(g, n)))).otherwise(shown))
        keys = lambda m: F.when(decimal, m).otherwise(F.array(*[T.digits_key(x) for x in _each(m, n)]))
        buckets = T.let(merged, lambda m: T.let(keys(m), lambda k: ranked_buckets(_each(m, n), _each(k, n))))
        agreed = outcome(votes, first, votes, F.slice(there, 1, 1))
        return F.when(F.size(F.array_distinct(there)) <= 1, agreed).otherwise(T.let(buckets, lambda b: outcome(votes, first, F.get(b, F.lit(0))["n"], b["disp"])))

    def usable(v: Column) -> Column:
        compound = T.let(T.compound_display(v), lambda d: F.when(T.digits_key(d).isNotNull(), d))
        return F.when(decimal, T.normalise(v)).otherwise(compound)

    return T.let(F.array(*[usable(v) for v in voices]), decide)


def numeric_consensus(df: DataFrame, decimal: Column, voices: tuple[str, ...] = VOICES) -> DataFrame:
    """Add text, score and alternatives: the majority of the voice columns. Row-wise, so nothing is exchanged."""
    decided = df.withColumn("__vote", majority([F.col(v) for v in voices], decimal))
    return decided.select(*df.columns, *[F.col("__vote")[c].alias(c) for c in ("text", "score", "alternatives")])


def plausible(value: Column, value_lo: Column, value_hi: Column, digits_lo: Column, digits_hi: Column) -> Column:
    number = value.try_cast("double")
    ranged = F.when(value_lo.isNull() | value_hi.isNull(), True).otherwise(F.coalesce(number.between(value_lo, value_hi), F.lit(False)))
    counted = F.when(digits_lo.isNull() | digits_hi.isNull(), True).otherwise(T.integer_digits(value).between(digits_lo, digits_hi))
    return ranged & counted


def arbitrated(vote: Column, value_lo: Column, value_hi: Column, digits_lo: Column, digits_hi: Column) -> Column:
    """struct(text, score, alternatives): an implausible winner gives way to its first plausible alternative (score 60), else its score is capped at 30."""
    ok = lambda v: plausible(v, value_lo, value_hi, digits_lo, digits_hi)
    ruled = (value_lo.isNotNull() & value_hi.isNotNull()) | (digits_lo.isNotNull() & digits_hi.isNotNull())
    made = lambda text, score, rest: F.struct(text.alias("text"), score.cast("int").alias("score"), rest.alias("alternatives"))

    def second(pick: Column) -> Column:
        rest = F.concat(F.filter(vote["alternatives"], lambda a: a != pick), F.array(vote["text"]))
        return F.when(pick.isNotNull(), made(pick, F.lit(60), rest)).otherwise(made(vote["text"], F.least(vote["score"], F.lit(30)), vote["alternatives"]))

    doubted = ruled & (vote["text"] != "") & ~ok(vote["text"])
    return F.when(doubted, T.let(F.get(F.filter(vote["alternatives"], ok), F.lit(0)), second)).otherwise(made(vote["text"], vote["score"], vote["alternatives"]))


def arbitrate(df: DataFrame, value_lo: Column, value_hi: Column, digits_lo: Column, digits_hi: Column) -> DataFrame:
    """``arbitrated`` for the columns text, score and alternatives of ``df``."""
    now = F.struct("text", F.col("score").cast("int").alias("score"), "alternatives")
    others = [c for c in df.columns if c not in ("text", "score", "alternatives")]
    judged = df.withColumn("__vote", arbitrated(now, value_lo, value_hi, digits_lo, digits_hi))
    return judged.select(*others, *[F.col("__vote")[c].alias(c) for c in ("text", "score", "alternatives")])


LIMITS = ("value_lo", "value_hi", "digits_lo", "digits_hi")


def vote_stage(cells: DataFrame, voices: tuple[str, ...] = VOICES) -> DataFrame:
    """Votes on the open number cells of ``cells``, whose map ``predictions`` holds the voices.

    Headers, blank and final cells, other roles and cells without any voice stay as they are, and so does a
    cell whose vote comes out empty. Decimals are arbitrated by ``LIMITS``, where those columns exist.
    What is written is final; alternatives are replaced only by a vote that has some.
    """
    reading = [F.try_element_at(F.col("predictions"), F.lit(v)) for v in voices]
    heard = F.coalesce(*[F.nullif(r, F.lit("")) for r in reading]).isNotNull()
    open_ = (F.col("row") > 0) & ~F.coalesce("is_blank", F.lit(False)) & ~F.coalesce("skip_ocr", F.lit(False)) & F.col("role").isin(*DECIMAL, *COMPOUND)
    vote = majority(reading, is_decimal(F.col("role")))
    if set(LIMITS) <= set(cells.columns):
        limits = [F.col(c) for c in LIMITS]
        vote = T.let(vote, lambda v: F.when(is_decimal(F.col("role")), arbitrated(v, *limits)).otherwise(v))
    cast = cells.withColumn("__vote", F.when(open_ & heard, vote))
    written = F.coalesce(F.col("__vote.text") != "", F.lit(False))
    others = [c for c in cells.columns if c not in ("text", "score", "alternatives", "skip_ocr")]
    return cast.select(
        *others,
        F.when(written, F.col("__vote.text")).otherwise(F.col("text")).alias("text"),
        F.when(written, F.col("__vote.score")).otherwise(F.col("score")).cast("int").alias("score"),
        F.when(written & (F.size("__vote.alternatives") > 0), F.col("__vote.alternatives")).otherwise(F.col("alternatives")).alias("alternatives"),
        (F.coalesce(F.col("skip_ocr"), F.lit(False)) | written).alias("skip_ocr"),
    )


def species_consensus(df: DataFrame, catalog: DataFrame, threshold: float = 66.0) -> DataFrame:
    """Snap columns htr and trocr to the catalog (name, idx) and agree: adds text, score, alternatives, consensus.

    A row whose column ``current`` is a ditto mark is left as it is.
    """
    readings = df.select(F.explode(F.array(T.clean(F.col("htr")), T.clean(F.col("trocr")))).alias("reading")).where("reading <> ''")
    best = extract_best(readings, catalog).where(F.col("score") >= threshold)
    snap = lambda v: best.select(F.col("reading").alias(f"__{v}"), F.col("name").alias(f"{v}_name"), F.col("score").alias(f"{v}_score"))
    met = df.withColumns({"__htr": T.clean(F.col("htr")), "__trocr": T.clean(F.col("trocr"))}).join(snap("htr"), "__htr", "left").join(snap("trocr"), "__trocr", "left")
    h, t, hs, ts = F.col("htr_name"), F.col("trocr_name"), F.col("htr_score"), F.col("trocr_score")
    ditto = F.coalesce(F.col("current"), F.lit("")) == T.DITTO
    first = hs >= ts
    raw = F.coalesce(T.blank_to_null(F.col("__htr")), F.col("__trocr"))
    floor = lambda s, cut: F.greatest((s - cut).cast("int"), F.lit(30))
    return met.select(
        *df.columns,
        F.when(ditto, T.DITTO).when(h.isNotNull() & t.isNotNull(), F.when(first, h).otherwise(t)).otherwise(F.coalesce(h, t, raw)).alias("text"),
        F.when(ditto, F.lit(None))
        .when(h == t, F.least(F.lit(100), ((hs + ts) / 2 + 15).cast("int")))
        .when(h.isNotNull() & t.isNotNull(), floor(F.greatest(hs, ts), 10))
        .when(h.isNotNull() | t.isNotNull(), floor(F.coalesce(hs, ts), 5))
        .when(raw != "", 20)
        .otherwise(-1)
        .cast("int")
        .alias("score"),
        F.when(~ditto & (h != t), F.array(F.when(first, t).otherwise(h))).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        F.when(ditto, F.lit(None))
        .when(h == t, "both_agree")
        .when(h.isNotNull() & t.isNotNull(), F.when(first, "htr_preferred").otherwise("trocr_preferred"))
        .when(h.isNotNull(), "htr_only")
        .when(t.isNotNull(), "trocr_only")
        .otherwise("no_match")
        .alias("consensus"),
    )


def age_snap(source: Column, threshold: float = 62.0) -> Column:
    """struct(text, score) in the vocabulary Fd, Fnd: 'Fnd' where a short read has an n or u, else 'Fd'."""
    read = T.process(F.coalesce(source, F.lit("")))
    short = read.rlike(r"\p{L}") & (F.length(read) <= 6)
    rule = F.when(read.rlike("[nu]"), "Fnd").otherwise("Fd")
    fd, fnd = ratio(read, F.lit("fd")), ratio(read, F.lit("fnd"))
    fuzzy = F.when(fd >= fnd, "Fd").otherwise("Fnd")
    best = F.greatest(fd, fnd)
    agreed = F.when((fuzzy == rule) & (best >= threshold), best.cast("int")).otherwise(45)
    return (
        F.when(read == "", F.struct(F.lit("").alias("text"), F.lit(-1).alias("score")))
        .when(short, F.struct(rule.alias("text"), agreed.alias("score")))
        .when(best >= threshold, F.struct(fuzzy.alias("text"), best.cast("int").alias("score")))
        .otherwise(F.struct(F.lit("").alias("text"), F.lit(-1).alias("score")))
    )


def vocabulary_snap(df: DataFrame, column: str, vocabulary: DataFrame, threshold: float = 62.0) -> DataFrame:
    """The general closed vocabulary (name, idx): best name at ``threshold`` or more, else '' at -1."""
    read = df.withColumn("__read", T.process(F.coalesce(F.col(column), F.lit(""))))
    best = extract_best(read.select(F.col("__read").alias("reading")), vocabulary, T.process).where((F.col("score") >= threshold) & (F.col("reading") != ""))
    met = read.join(best.withColumnRenamed("reading", "__read"), "__read", "left")
    return met.select(*df.columns, F.coalesce("name", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("int"), F.lit(-1)).alias("score"))


def age_stage(cells: DataFrame, vocabulary: DataFrame | None = None, threshold: float = 62.0) -> DataFrame:
    """Snap the open cells of age columns: the source is voice trocr, else htr_vt, else the text itself.

    Headers, other roles, blank cells, ditto marks and manual edits stay as they are, and so do cells with
    no source. ``vocabulary`` (name, idx) replaces the pair Fd, Fnd by plain snapping to its names.
    """
    voice = lambda v: T.blank_to_null(F.try_element_at(F.col("predictions"), F.lit(v)))
    shown = T.clean(F.col("text"))
    source = F.coalesce(voice("trocr"), voice("htr_vt"), T.blank_to_null(shown))
    open_ = (F.col("row") > 0) & (F.col("role") == "age") & ~F.coalesce("is_blank", F.lit(False)) & (shown != T.DITTO) & ~F.coalesce("is_manual_edit", F.lit(False))
    asked = cells.withColumn("__source", F.when(open_, source))
    if vocabulary is None:
        said = asked.withColumn("__said", age_snap(T.clean(F.col("__source")), threshold))
    else:
        kept = asked.select(F.struct(*cells.columns).alias("__row"), "__source")
        snapped = vocabulary_snap(kept, "__source", vocabulary, threshold)
        said = snapped.select("__row.*", "__source", F.struct("text", "score").alias("__said"))
    hit = F.col("__source").isNotNull()
    others = [c for c in cells.columns if c not in ("text", "score")]
    return said.select(*others, F.when(hit, F.col("__said.text")).otherwise(F.col("text")).alias("text"), F.when(hit, F.col("__said.score")).otherwise(F.col("score")).cast("int").alias("score"))
