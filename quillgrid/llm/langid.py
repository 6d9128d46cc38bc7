"""Language identification with a blended-spectrum presence kernel.

A text is its set of letter n-grams (n = 1 to 3, over UTF-8 bytes; A-Z folded, other ASCII bytes count
as one separator). The kernel of two texts is the size of the common set over the root of the product of
both sizes: one for equal sets. Nystrom features come from landmark texts; a kernel ridge regression per
language (one against the rest) is solved on them. As the kernel is linear in the presence vector,
landmarks and weights fold into one matrix: documents are scored by a product of presence rows with it,
block by block. There is no intercept: grams that no landmark has count in a text's size and so lower all
its scores alike, without a change of the best language; a text in a strange script scores near zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: texts per language on average and in all, landmarks per language, and the length up to which texts are preferred.
TRAIN_PER_LANG = 400
TRAIN_TEXTS = 40_000
LANDMARKS_PER_LANG = 40
PREFERRED_CHARS = 20_000
RIDGE = 1e-3
SHARPNESS = 8.0
BLOCK_DOCS = 64

_SYMBOLS = 155
_CODE = np.zeros(256, dtype=np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)
#: Places of the 1-, 2- and 3-grams in one numbering.
_BASES = (0, _SYMBOLS, _SYMBOLS + _SYMBOLS**2)
_GRAMS = _SYMBOLS + _SYMBOLS**2 + _SYMBOLS**3


def grams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to 3: the gram at each byte, and the row it belongs to; grams never cross rows."""
    code = _CODE[raw]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    two = code[:-1] * _SYMBOLS + code[1:]
    three = two[:-1] * _SYMBOLS + code[2:]
    return [
        (code + _BASES[0], row),
        ((two + _BASES[1])[row[:-1] == row[1:]], row[:-1][row[:-1] == row[1:]]),
        ((three + _BASES[2])[row[:-2] == row[2:]], row[:-2][row[:-2] == row[2:]]),
    ]


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    #: Best scores below this are of no learned language: half of the least that a labelled text had for its own language.
    floor: float = 0.0

    def table(self) -> np.ndarray:
        place = np.full(_GRAMS, len(self.vocabulary), dtype=np.int32)
        place[self.vocabulary] = np.arange(len(self.vocabulary))
        return place

    def presence(self, texts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row per text: which grams of the vocabulary it has; and the number of all its grams."""
        out = np.zeros((len(texts), len(self.vocabulary) + 1), dtype=np.float32)
        flat = out.reshape(-1)
        strange = np.zeros(len(texts), dtype=np.int64)
        for lo, hi in common.slices(texts, 1 << 20):
            raw, offsets = common.buffer_of(texts.slice(lo, hi - lo))
            for gram, row in grams(raw, offsets):
                at = place[gram]
                flat[(row.astype(np.int64) + lo) * out.shape[1] + at] = 1
                unknown = at == len(self.vocabulary)
                if unknown.any():
                    pairs = np.unique(row[unknown].astype(np.int64) * _GRAMS + gram[unknown])
                    strange[lo:hi] += np.bincount(pairs // _GRAMS, minlength=hi - lo)
        return out[:, :-1], out[:, :-1].sum(axis=1) + strange

    def scores(self, texts: pa.Array, place: np.ndarray) -> np.ndarray:
        rows, size = self.presence(texts, place)
        return rows @ self.weights / np.sqrt(np.maximum(size, 1))[:, None]


def fit(texts: list[str], langs: list[str], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """Fit on labelled texts; the first of each language are its landmarks."""
    known = sorted(set(langs))
    seen: dict[str, int] = {}
    marks = []
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks_per_lang:
            marks.append(i)
    raw, offsets = common.buffer_of(pa.array([texts[i] for i in marks], pa.string()))
    vocabulary = np.unique(np.concatenate([g for g, _ in grams(raw, offsets)] or [np.zeros(0, np.int32)]))
    empty = Model(known, vocabulary, np.zeros((len(vocabulary), len(known)), np.float32))
    if not known:
        return empty
    place = empty.table()

    def unit(some: list[str]) -> np.ndarray:
        rows, size = empty.presence(pa.array(some, pa.string()), place)
        return rows / np.sqrt(np.maximum(size, 1))[:, None]

    landmark = unit([texts[i] for i in marks])
    across = np.concatenate([unit(texts[i : i + 256]) @ landmark.T for i in range(0, len(texts), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = across @ root
    goal = (np.asarray(langs)[:, None] == np.asarray(known)[None, :]).astype(np.float64)
    share = 1 / np.sqrt(np.asarray([langs.count(x) for x in langs], dtype=np.float64))[:, None]
    left = (features * share).T @ (features * share)
    solved = np.linalg.solve(left + ridge * np.trace(left) / len(left) * np.eye(len(left)), (features * share).T @ (goal * share))
    own = (features @ solved)[np.arange(len(texts)), [known.index(x) for x in langs]]
    return Model(known, vocabulary, (landmark.T @ (root @ solved)).astype(np.float32), max(0.0, float(own.min())) / 2)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, preferred_chars: int = PREFERRED_CHARS) -> Model:
    """Fit on about ``per_lang`` texts of each language that are not held out (fewer if TRAIN_TEXTS would be passed).

    A text is drawn if its hashed doc_id lies under a threshold that the language's number of texts sets,
    so no language is gathered anywhere but in the sample. Texts of up to ``preferred_chars`` are drawn
    where a language has enough of them. Rows of equal doc_id count as one text, the smallest. Of more than
    TRAIN_TEXTS languages the most frequent ones are learnt; one short row for each is broadcast.
    """
    common.settle(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    short = F.length("text") <= preferred_chars
    counts = usable.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_TEXTS).collect()
    if not counts:
        return fit([], [])
    want = min(per_lang, max(1, TRAIN_TEXTS // len(counts)))
    limits = [(r.lang, r.short >= want, min(1.0, want / (r.short if r.short >= want else r.n))) for r in counts]
    rule = docs.sparkSession.createDataFrame(limits, "lang string, only_short boolean, share double")
    key = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(F.broadcast(rule), "lang").where((key < F.col("share")) & (short | ~F.col("only_short")))
    found = drawn.groupBy("doc_id", "lang").agg(F.min(F.struct(F.length("text"), "text"))["text"].alias("text")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"] * 2654435761 & 0xFFFFFFFF, r["doc_id"], r["lang"]))
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score (0 to 1) and known (the raw best score reaches the model's floor) to ``docs``, which has ``text``.

    Null texts, those without a letter and all texts of a model without languages are ``und`` at 0.
    """
    cache: dict[str, np.ndarray] = {}

    def predict(text: pa.Array, lettered: pa.Array) -> pa.Array:
        common.enter("langid")
        if "place" not in cache:
            cache["place"] = model.table()
        names, certainty, known = [], [], []
        usable = lettered.to_pylist()
        for lo in range(0, len(text), BLOCK_DOCS):
            f = model.scores(text.slice(lo, BLOCK_DOCS), cache["place"]) if model.langs else np.zeros((min(BLOCK_DOCS, len(text) - lo), 0))
            for i in range(len(f)):
                if not usable[lo + i] or not model.langs:
                    names.append("und")
                    certainty.append(0.0)
                    known.append(False)
                    continue
                best = int(f[i].argmax())
                names.append(model.langs[best])
                certainty.append(float(1 / np.exp(np.clip(SHARPNESS * (f[i] - f[i, best]), -60, 0)).sum()))
                known.append(bool(f[i, best] >= model.floor))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(certainty, pa.float64()), pa.array(known, pa.bool_())], ["lang_pred", "score", "known"])

    udf = F.arrow_udf(predict, "lang_pred string, score double, known boolean").asNondeterministic()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("__said", udf(F.col("text"), lettered)).select(*docs.columns, *[F.col("__said")[c].alias(c) for c in ("lang_pred", "score", "known")])


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def keep_recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose text is in no learned language: ``und``, or a best score below the model's floor.

    The floor comes from labelled texts and does not depend on how many languages there are. Without any
    label nothing can be told, and all rows with a letter stay.
    """
    said = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").cast("string").alias("text"))
    model = train(labelled(docs))
    if not model.langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return with_language(said, model).where((F.col("lang_pred") != "und") & F.col("known")).select("__row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, learnt from those that are not held out."""
    docs = labelled(common.table(spark, sf_dir, "documents"))
    said = with_language(docs.select("doc_id", "text"), train(docs))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
