"""String similarity: for pairs of columns as higher-order functions, for readings against a catalogue as a bit-parallel kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import process


def lcs(a: Column, b: Column) -> Column:
    left, right = F.split(a, ""), F.split(b, "")
    start = F.array_repeat(F.lit(0), F.size(right) + 1)

    def row(above: Column, letter: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.get(right, j - 1) == letter, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(done, j - 1)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(right)), F.array(F.lit(0)), cell)

    full = F.aggregate(left, start, row)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.get(full, F.length(b))).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    """100 times twice the common subsequence over both lengths; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs(a, b) / total)


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_words(a), sorted_words(b))


def keyword_score(header: Column, keywords: Column) -> Column:
    """Best ratio of a header's words (and of the whole, if several) to any keyword, 0 to 1; short strangers count a fifth."""
    text = process(header)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    candidates = F.when(F.size(words) > 1, F.concat(words, F.array(text))).otherwise(words)
    score = lambda c, k: ratio(c, k) / 100 * F.when((F.length(c) <= 3) & (c != k), 0.2).otherwise(1.0)
    best = F.array_max(F.transform(candidates, lambda c: F.array_max(F.transform(F.transform(keywords, process), lambda k: score(c, k)))))
    return F.when(F.length(text) < 2, 0.0).otherwise(F.coalesce(best, F.lit(0.0)))


#: Rows of a block of readings, and of a block of a catalogue.
READING_ROWS, NAME_ROWS = 512, 2048


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text as a row, padded with 0, and the lengths."""
    size = np.asarray([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), dtype=np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, size


def lcs_matrix(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all pairs: the columns of the table as bits of one word.

    Texts of ``left`` beyond 64 letters use Python's long integers.
    """
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    short = [i for i, t in enumerate(left) if len(t) <= 64]
    b, _ = _letters(right)
    if short and b.size:
        a, size = _letters([left[i] for i in short])
        alphabet = np.unique(b)
        place = np.minimum(np.searchsorted(alphabet, a), len(alphabet) - 1)
        rows, cols = np.nonzero((alphabet[place] == a) & (np.arange(a.shape[1]) < size[:, None]))
        masks = np.zeros((len(short), len(alphabet)), dtype=np.uint64)
        np.bitwise_or.at(masks, (rows, place[rows, cols]), np.uint64(1) << cols.astype(np.uint64))
        masks[:, alphabet == 0] = 0
        letters = np.searchsorted(alphabet, b)
        state = np.full((len(short), len(right)), ~np.uint64(0))
        with np.errstate(over="ignore"):
            for j in range(b.shape[1]):
                met = state & masks[:, letters[:, j]]
                state = (state + met) | (state - met)
        inside = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
        out[short] = np.bitwise_count(~state & inside[:, None])
    for i in set(range(len(left))) - set(short):
        mask: dict[str, int] = {}
        for at, letter in enumerate(left[i]):
            mask[letter] = mask.get(letter, 0) | 1 << at
        full = (1 << len(left[i])) - 1
        for k, text in enumerate(right):
            bits = full
            for letter in text:
                met = bits & mask.get(letter, 0)
                bits = ((bits + met) | (bits - met)) & full
            out[i, k] = (~bits & full).bit_count()
    return out


def _best_of_blocks(top: int):
    """Rows (readings, names): the ``top`` names of the block for each reading, by ratio and then by idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for readings, names in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                names.sort(key=lambda n: (n["idx"], n["name"]))
                left, right = [r["key"] for r in readings], [n["key"] for n in names]
                total = np.add.outer([len(x) for x in left], [len(x) for x in right])
                score = np.where(total == 0, 100.0, 200.0 * lcs_matrix(left, right) / np.maximum(total, 1))
                best = np.argsort(-score, axis=1, kind="stable")[:, :top]
                owner = np.repeat(np.arange(len(left)), best.shape[1])
                picked = best.ravel()
                columns = [pa.array([readings[i]["reading"] for i in owner], pa.string()), pa.array([names[k]["name"] for k in picked], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([names[k]["idx"] for k in picked], pa.int32()), pa.array(score[owner, picked])], ["reading", "name", "idx", "score"])

    return run


def extract_best(readings: DataFrame, catalog: DataFrame, prepare: Callable[[Column], Column] = sorted_words, top: int = 1) -> DataFrame:
    """For each distinct ``reading``: the ``top`` catalog names by the ratio of the ``prepare``d texts, ties to the smaller ``idx``.

    Blocks of readings meet blocks of the catalogue, each pair of blocks once and as one row, so neither
    side has to fit anywhere as a whole. Null readings and names are left out; an empty catalogue gives no rows.
    """
    said = readings.select("reading").where("reading is not null").distinct()
    names = catalog.select("name", F.col("idx").cast("int").alias("idx")).where("name is not null")
    n_left, n_right = max(1, -(-said.count() // READING_ROWS)), max(1, -(-names.count() // NAME_ROWS))
    block = lambda n, *on: F.pmod(F.xxhash64(*on), F.lit(n)).cast("int")
    left = said.select(block(n_left, "reading").alias("left"), F.struct("reading", prepare(F.col("reading")).alias("key")).alias("r")).groupBy("left").agg(F.collect_list("r").alias("readings"))
    right = names.select(block(n_right, "name", "idx").alias("right"), F.struct("name", "idx", prepare(F.col("name")).alias("key")).alias("n")).groupBy("right").agg(F.collect_list("n").alias("names"))
    met = left.withColumn("right", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).join(right, "right").select("readings", "names")
    found = met.mapInArrow(_best_of_blocks(top), "reading string, name string, idx int, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("reading").orderBy(F.desc("score"), "idx", "name"))).where(F.col("rank") <= top)
    return ranked.select("reading", "name", "score") if top == 1 else ranked.select("reading", "rank", "name", "score")
