"""Page geometry: line filters, clustering, templates, and assignment of column roles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import keyword_score


def line_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


def keep_lines(lines: DataFrame, vertical: bool, extent: Column) -> DataFrame:
    """Lines (x0, y0, x1, y1) near the wanted direction that span enough of ``extent`` (page height or width)."""
    angle = F.abs(line_angle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    if vertical:
        return lines.where(angle.between(80, 100) & (length >= extent * 0.85))
    return lines.where(((angle <= 10) | angle.between(170, 190)) & (length >= extent * 0.5))


def gap_clusters(df: DataFrame, partition: list[str], position: str, tolerance) -> DataFrame:
    """Groups of positions whose neighbours are at most ``tolerance`` apart: cluster number, value (whole mean), n."""
    order = Window.partitionBy(*partition).orderBy(position)
    broken = F.when(F.col(position) - F.lag(position).over(order) > tolerance, 1).otherwise(0)
    marked = df.withColumn("__break", broken)
    grouped = marked.withColumn("cluster", F.sum("__break").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*partition, "cluster").agg((F.sum(position) / F.count("*")).cast("int").alias("value"), F.count("*").alias("n"))


def seed_clusters(counted: Column, tolerance: int) -> Column:
    """Greedy seeds over an ordered array<struct<x, n>>: each position joins the first seed within ``tolerance``, or becomes one.

    Returns array<struct<seed, total, n>> in order of the seeds; seeds never move.
    """
    empty = F.array().cast("array<struct<seed:bigint,total:bigint,n:bigint>>")

    def place(seeds: Column, p: Column) -> Column:
        x, n = p["x"], p["n"]

        def at(hit: Column) -> Column:
            grown = F.transform(seeds, lambda s, i: F.when(i == hit, F.struct(s["seed"].alias("seed"), (s["total"] + x * n).alias("total"), (s["n"] + n).alias("n"))).otherwise(s))
            fresh = F.struct(x.alias("seed"), (x * n).alias("total"), n.alias("n"))
            return F.when(hit.isNotNull(), grown).otherwise(F.concat(seeds, F.array(fresh)))

        return T.let(F.array_min(F.transform(seeds, lambda s, i: F.when(F.abs(x - s["seed"]) <= tolerance, i))), at)

    return F.aggregate(F.transform(counted, lambda p: F.struct(p["x"].cast("long").alias("x"), p["n"].cast("long").alias("n"))), empty, place)


def seeds_of(df: DataFrame, key: list[str], position: str, order: list[str], tolerance: int) -> DataFrame:
    """(key, n_all, seeds): ``seed_clusters`` of each group's positions in ``order``.

    A repeated position joins whatever its first occurrence joined, so equal positions are counted before
    they meet; a group's array is as long as its distinct positions are many.
    """
    counted = df.groupBy(*key, F.col(position).alias("x")).agg(F.min(F.struct(*order)).alias("at"), F.count("*").alias("n"))
    lists = counted.groupBy(*key).agg(F.sum("n").alias("n_all"), F.array_sort(F.collect_list(F.struct("at", "x", "n"))).alias("all"))
    return lists.select(*key, "n_all", seed_clusters(F.col("all"), tolerance).alias("seeds"))


def frequent_seeds(seeds: Column, pages: Column, share: float = 0.4) -> Column:
    """The seeds that occur on at least the given share of pages."""
    return F.filter(seeds, lambda s: s["n"] >= F.floor(pages * share))


def frequent_positions(seeds: Column, pages: Column, share: float = 0.4) -> Column:
    """Whole means of the frequent seeds, in order."""
    return F.array_sort(F.transform(frequent_seeds(seeds, pages, share), lambda s: (s["total"] / s["n"]).cast("long")))


def drop_narrow(positions: Column, page_width: Column, least: int) -> Column:
    """Positions that leave at least ``least`` to the last kept one; the last is measured to the page's end."""
    n = F.size(positions)
    state = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("long").alias("i"))

    def step(s: Column, x: Column) -> Column:
        last = F.coalesce(F.get(s["kept"], F.size(s["kept"]) - 1), F.lit(0))
        width = F.when(s["i"] == 0, x).when(s["i"] == n - 1, page_width.cast("long") - x).otherwise(x - last)
        kept = F.when(width >= least, F.concat(s["kept"], F.array(x))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.transform(positions, lambda p: p.cast("long")), state, step, lambda s: s["kept"])


def fold_lines(lines: Column, threshold: int, least: int) -> Column:
    """Merge an ordered array of segments struct<x0, y0, x1, y1>: near-vertical ones extend the lines that they meet.

    A segment that begins above a line, near its top, becomes its top; else one that ends below it, near its
    bottom, becomes its bottom. Each counts as a find of that line; one that extends none is a new line.
    Returns the lines with at least ``least`` finds. Every segment meets every line: ``fold_pages`` is for long pages.
    """
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,found:int>>"
    points = ("x0", "y0", "x1", "y1")
    made = lambda values, found: F.struct(*[v.alias(n) for n, v in zip(points, values, strict=True)], found.alias("found"))

    def meet(held: Column, s: Column) -> Column:
        above = lambda v: (s["y0"] < v["y0"]) & (F.abs(v["x0"] - s["x0"]) < threshold)
        below = lambda v: (s["y1"] > v["y1"]) & (F.abs(v["x1"] - s["x1"]) < threshold)
        grown = F.transform(
            held,
            lambda v: F.when(above(v), made([s["x0"], s["y0"], v["x1"], v["y1"]], v["found"] + 1))
            .when(below(v), made([v["x0"], v["y0"], s["x1"], s["y1"]], v["found"] + 1))
            .otherwise(v),
        )
        fresh = F.array(made([s[n] for n in points], F.lit(0)))
        return F.when(F.exists(held, lambda v: above(v) | below(v)), grown).otherwise(F.concat(held, fresh))

    upright = F.filter(lines, lambda s: F.abs(s["x1"] - s["x0"]) < threshold)
    doubles = F.transform(upright, lambda s: F.struct(*[s[n].cast("double").alias(n) for n in points]))
    return F.filter(F.aggregate(doubles, F.array().cast(kind), meet), lambda v: v["found"] >= least)


class _Fold:
    """The lines of one page as ``fold_lines`` merges them, fed in order.

    Lines that came to the same place stay together from then on, so each place is held once with how many
    lines have which number of finds. Places are few where lines are many.
    """

    def __init__(self, threshold: float):
        self.threshold, self.at = threshold, np.empty((4, 64))
        self.points: list[tuple[float, ...]] = []
        self.place: dict[tuple[float, ...], int] = {}
        self.finds: list[dict[int, int]] = []  # number of lines by finds, less ``more``
        self.more: list[int] = []

    def _put(self, point: tuple[float, ...], finds: dict[int, int], more: int) -> None:
        i = self.place.get(point)
        if i is None:
            i = self.place[point] = len(self.points)
            if i == self.at.shape[1]:
                self.at = np.concatenate([self.at, np.empty_like(self.at)], axis=1)
            self.at[:, i] = point
            self.points.append(point)
            self.finds.append(finds)
            self.more.append(more)
            return
        if len(finds) > len(self.finds[i]):
            finds, more, self.finds[i], self.more[i] = self.finds[i], self.more[i], finds, more
        into, by = self.finds[i], more - self.more[i]
        for n, lines in finds.items():
            into[n + by] = into.get(n + by, 0) + lines

    def _take(self, i: int) -> tuple[dict[int, int], int]:
        """Remove place ``i``; the last one moves there."""
        out = self.finds[i], self.more[i]
        del self.place[self.points[i]]
        point, finds, more = self.points.pop(), self.finds.pop(), self.more.pop()
        if i < len(self.points):
            self.points[i], self.finds[i], self.more[i] = point, finds, more
            self.place[point] = i
            self.at[:, i] = point
        return out

    def meet(self, segments: np.ndarray) -> None:
        """Segments as rows x0, y0, x1, y1; NaN stands for null, which meets nothing."""
        for s in map(tuple, segments[np.abs(segments[:, 2] - segments[:, 0]) < self.threshold].tolist()):
            x0, y0, x1, y1 = self.at[:, : len(self.points)]
            above = (s[1] < y0) & (np.abs(x0 - s[0]) < self.threshold)
            met = np.flatnonzero(above | ((s[3] > y1) & (np.abs(x1 - s[2]) < self.threshold)))
            if not len(met):
                self._put(s, {0: 1}, 0)
                continue
            moved = [(s[:2] + self.points[i][2:] if above[i] else self.points[i][:2] + s[2:], *self._take(i)) for i in met[::-1].tolist()]
            for point, finds, more in moved:
                self._put(point, finds, more + 1)

    def lines(self, least: int) -> list[tuple[float, ...]]:
        """(x0, y0, x1, y1, found) of the lines with at least ``least`` finds."""
        each = ((p, n + more, lines) for p, finds, more in zip(self.points, self.finds, self.more, strict=True) for n, lines in finds.items())
        return [(*p, found) for p, found, lines in each if found >= least for _ in range(lines)]


def fold_pages(segments: DataFrame, key: list[str], order: list[str], threshold: float, least: int) -> DataFrame:
    """``fold_lines`` of each page's rows (key, x0, y0, x1, y1), in ``order``: a row per line (key, x0, y0, x1, y1, found).

    For pages of any length: a page's rows pass one task in sorted batches, and only its places are held. A
    page without lines has one row without values. Coordinates are numbers or null.
    """
    points = ("x0", "y0", "x1", "y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, fold, schema = None, None, None

        def done() -> pa.RecordBatch:
            lines = fold.lines(least) or [(None,) * 5]
            values = [pa.array(v, pa.float64(), from_pandas=True) for v in list(zip(*lines, strict=True))[:4]]
            return pa.RecordBatch.from_arrays([*(pa.array([k] * len(lines), f.type) for k, f in zip(page, schema, strict=True)), *values, pa.array([v[4] for v in lines], pa.int32())], [*key, *points, "found"])

        for batch in batches:
            schema = [batch.schema.field(k) for k in key]
            codes = [np.asarray(pc.dictionary_encode(batch.column(k), null_encoding="encode").indices) for k in key]
            starts = np.flatnonzero(np.any([np.append(True, c[1:] != c[:-1]) for c in codes], axis=0)) if len(batch) else []
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in points], axis=1)
            for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
                here = tuple(batch.column(k)[int(lo)].as_py() for k in key)
                if fold is None or here != page:
                    if fold is not None:
                        yield done()
                    page, fold = here, _Fold(threshold)
                fold.meet(values[lo:hi])
        if fold is not None:
            yield done()

    fields = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in key)
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else small partitions of long work are joined
    dealt = segments.repartition(parts, *key).sortWithinPartitions(*key, *order)
    return dealt.select(*key, *[F.col(c).cast("double").alias(c) for c in points]).mapInArrow(run, f"{fields}, x0 double, y0 double, x1 double, y1 double, found int")


def skew(lines: Column) -> Column:
    """Degrees by which a page is turned so that the leftmost of its folded lines is upright; null without lines."""
    first = F.get(F.array_sort(lines), F.lit(0))
    slope = F.when(first["x1"] == first["x0"], -90.0).otherwise(F.degrees(F.atan((first["y1"] - first["y0"]) / (first["x1"] - first["x0"]))))
    turned = lambda a: F.when(a > 0, 90 - a).otherwise(a)
    return T.let(T.let(slope, turned), lambda a: F.when(a < 0, a + 90).otherwise(a))


def header_pick(cropped: Column, full: Column) -> Column:
    """The longer of two reads of a header, trimmed; the full one if they are as long."""
    a, b = T.clean(cropped), T.clean(full)
    return F.when(F.length(b) >= F.length(a), b).otherwise(a)


def template_intervals(positions: Column, extent: Column, overlap: int = 5, least: int = 1) -> Column:
    """array<struct<i, lo, hi>> of the strips between template lines, overlapping and clamped."""
    edges = F.concat(F.array(F.lit(None).cast("long")), F.transform(positions, lambda p: p.cast("long")), F.array(F.lit(None).cast("long")))
    strips = F.transform(
        F.sequence(F.lit(0), F.size(positions)),
        lambda i: F.struct(
            i.alias("i"),
            F.greatest(F.lit(0).cast("long"), F.coalesce(F.get(edges, i) - overlap, F.lit(0).cast("long"))).alias("lo"),
            F.least(extent.cast("long"), F.coalesce(F.get(edges, i + 1) + overlap, extent.cast("long"))).alias("hi"),
        ),
    )
    return F.filter(strips, lambda s: s["hi"] - s["lo"] >= least)


def clamp_box(df: DataFrame, pad: int = 10) -> DataFrame:
    """Crop boxes (x0, y0, x1, y1 in a page of w by h): padded, whole pixels, within the page; the first per page."""
    first = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    return df.withColumn("__at", F.row_number().over(first)).where("__at = 1").select(
        "doc_id",
        "page",
        F.greatest(F.lit(0), F.floor(F.col("x0")) - pad).alias("x0"),
        F.greatest(F.lit(0), F.floor(F.col("y0")) - pad).alias("y0"),
        F.least(F.col("w"), F.ceil(F.col("x1")) + pad).alias("x1"),
        F.least(F.col("h"), F.ceil(F.col("y1")) + pad).alias("y1"),
    )


def table_crops(pages: DataFrame, boxes: DataFrame, pad: int = 10) -> DataFrame:
    """``clamp_box`` of each of ``pages`` (doc_id, page, w, h); a page without a box stops the job, as nothing after it could work."""
    crops = clamp_box(boxes.join(pages.select("doc_id", "page", "w", "h"), ["doc_id", "page"]), pad)
    met = pages.join(crops, ["doc_id", "page"], "left")
    missing = F.raise_error(F.concat(F.lit("no table on page "), F.col("page").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")))
    return met.select("doc_id", "page", *[F.coalesce(F.col(c), missing.cast("long")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def width_score(share: Column, lo: Column, hi: Column) -> Column:
    band = F.greatest(hi - lo, F.lit(1e-6))
    off = F.when(share < lo, lo - share).otherwise(share - hi)
    return F.when(share <= 0, 0.0).when(share.between(lo, hi), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - off / band))


def pair_score(header: Column, keywords: Column, share: Column, lo: Column, hi: Column) -> Column:
    return 0.75 * keyword_score(header, keywords) + 0.25 * width_score(share, lo, hi)


def align(scores: np.ndarray, min_assign: float = 0.2, skip_column: float = 0.05, skip_role: float = 0.25) -> list[int | None]:
    """Best order-preserving assignment of roles (columns of ``scores``) to page columns (rows).

    Ties prefer to assign, then to leave out a role, then a column.
    """
    n, m = scores.shape
    best = np.zeros((n + 1, m + 1))
    move = np.zeros((n + 1, m + 1), dtype=np.int8)
    for i in range(n + 1):
        for j in range(m + 1):
            options = []
            if i and j and scores[i - 1, j - 1] >= min_assign:
                options.append((best[i - 1, j - 1] + scores[i - 1, j - 1], 0))
            if j:
                options.append((best[i, j - 1] - skip_role, 1))
            if i:
                options.append((best[i - 1, j] - skip_column, 2))
            for value, kind in options:
                if kind == options[0][1] or value > best[i, j]:
                    best[i, j], move[i, j] = value, kind
    out: list[int | None] = [None] * n
    i, j = n, m
    while i or j:
        if i and j and move[i, j] == 0:
            i, j = i - 1, j - 1
            out[i] = j
        elif j and (not i or move[i, j] == 1):
            j -= 1
        else:
            i -= 1
    return out


def assign_roles(columns: DataFrame, roles: DataFrame, key: list[str], **penalties) -> DataFrame:
    """Roles of page columns (key, col, header, share) by alignment with the enabled form roles.

    ``roles`` (pos, role, keywords, width_lo, width_hi) is a form's dimension; a page has few columns.
    """
    used = roles.where(F.coalesce(F.col("enabled"), F.lit(True))) if "enabled" in roles.columns else roles
    scored = columns.join(used, F.lit(True)).select(
        *key, "col", "pos", "role", pair_score(F.col("header"), F.col("keywords"), F.col("share"), F.col("width_lo"), F.col("width_hi")).alias("score")
    )

    def solve(page: pd.DataFrame) -> pd.DataFrame:
        matrix = page.pivot_table(index="col", columns="pos", values="score", aggfunc="max").sort_index().sort_index(axis=1)
        names = page.drop_duplicates("pos").set_index("pos")["role"]
        chosen = align(matrix.to_numpy(), **penalties)
        out = pd.DataFrame({"col": matrix.index, "role": [None if c is None else names[matrix.columns[c]] for c in chosen]})
        for k in key:
            out[k] = page[k].iloc[0]
        return out[[*key, "col", "role"]]

    fields = ", ".join(f"{k} {columns.schema[k].dataType.simpleString()}" for k in key)
    return scored.groupBy(*key).applyInPandas(solve, f"{fields}, col {columns.schema['col'].dataType.simpleString()}, role string")


def keyword_scores(texts: list[str], keywords: list[list[str]]) -> np.ndarray:
    """``similarity.keyword_score`` of processed headers (rows) for the processed keywords of each role, with numpy."""
    words = [t.split() for t in texts]
    candidates = [w if len(w) < 2 else [*w, t] for t, w in zip(texts, words, strict=True)]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in candidates])
    flat = [c for cs in candidates for c in cs]
    size = np.asarray([len(c) for c in flat], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    code = np.frombuffer("".join(flat).encode("utf-32-le"), dtype=np.uint32)
    start, long, owner = (np.cumsum(size) - size)[order], size[order], owner[order]
    out = np.zeros((len(texts), len(keywords)))
    for r, k in ((r, k) for r, ks in enumerate(keywords) for k in ks):
        letters = np.frombuffer(k.encode("utf-32-le"), dtype=np.uint32)
        table = np.zeros((len(k) + 1, len(flat)), dtype=np.int32)
        for at in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-long, -at, side="left"))
            letter, above = code[start[:n] + at], table[:, :n].copy()
            for j, x in enumerate(letters, 1):
                table[j, :n] = np.where(letter == x, above[j - 1] + 1, np.maximum(above[j], table[j - 1, :n]))
        equal = np.asarray([flat[i] == k for i in order], dtype=bool)
        score = 200.0 * table[-1] / np.maximum(long + len(k), 1) / 100 * np.where((long <= 3) & ~equal, 0.2, 1.0)
        np.maximum.at(out[:, r], owner, score)
    out[[len(t) < 2 for t in texts]] = 0
    return out


def align_pages(scores: np.ndarray, min_assign: float = 0.2, skip_column: float = 0.05, skip_role: float = 0.25) -> np.ndarray:
    """``align`` for many pages (first axis) of as many columns at once; -1 is no role."""
    pages, n, m = scores.shape
    best = np.zeros((n + 1, m + 1, pages))
    move = np.zeros((n + 1, m + 1, pages), dtype=np.int8)
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            value, kind = np.full(pages, -np.inf), np.zeros(pages, dtype=np.int8)
            if i and j:
                s = scores[:, i - 1, j - 1]
                value = np.where(s >= min_assign, best[i - 1, j - 1] + s, value)
            for other, k in ([(best[i, j - 1] - skip_role, 1)] if j else []) + ([(best[i - 1, j] - skip_column, 2)] if i else []):
                better = other > value
                value, kind = np.where(better, other, value), np.where(better, np.int8(k), kind)
            best[i, j], move[i, j] = value, kind
    out = np.full((pages, n), -1, dtype=np.int32)
    i, j, every = np.full(pages, n), np.full(pages, m), np.arange(pages)
    for _ in range(n + m):
        left = (i > 0) | (j > 0)
        kind = move[i, j, every]
        assign, role, column = left & (kind == 0), left & (kind == 1), left & (kind == 2)
        out[every[assign], i[assign] - 1] = j[assign] - 1
        i, j = i - (assign | column), j - (assign | role)
    return out


def _by_headers(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose second column has about ``limit`` elements; whole rows only."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def assign_roles_in_runs(rows: DataFrame, roles: DataFrame, key: str, columns_per_page: int, **penalties) -> DataFrame:
    """``assign_roles`` for ``rows`` (key, headers, share) whose pages are runs of ``columns_per_page`` headers.

    All headers become columns (key, page, col, role) and no row is exchanged. Only the form's roles come to the driver.
    """
    used = roles.where(F.coalesce(F.col("enabled"), F.lit(True))) if "enabled" in roles.columns else roles
    form = used.select("role", F.transform("keywords", T.process).alias("keywords"), "width_lo", "width_hi").orderBy("pos").collect()
    names, keywords = pa.array([r.role for r in form], pa.string()), [r.keywords for r in form]
    widths = F.array(*[width_score(F.col("share"), F.lit(r.width_lo), F.lit(r.width_hi)) for r in form])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_headers(whole)):
            headers = batch.column(1)
            counts = np.asarray(pc.fill_null(pc.list_value_length(headers), 0), dtype=np.int64)
            seen = pc.dictionary_encode(headers.flatten())
            word = np.asarray(seen.indices, dtype=np.int64)
            width = np.asarray(batch.column(2).flatten()).reshape(len(counts), -1)
            by_word = keyword_scores(seen.dictionary.to_pylist(), keywords)
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
            page, col = place // columns_per_page, place % columns_per_page
            first = np.flatnonzero(col == 0)
            size = np.diff(np.append(first, len(word)))
            chosen = np.full(len(word), -1, dtype=np.int32)
            for n in np.unique(size):
                for some in np.array_split(first[size == n], 1 + np.count_nonzero(size == n) // 4096):
                    at = some[:, None] + np.arange(n)
                    chosen[at] = align_pages(0.75 * by_word[word[at]] + 0.25 * width[owner[some], None, :], **penalties)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(page.astype(np.int32)), pa.array(col.astype(np.int32)), names.take(pa.array(chosen, mask=chosen < 0))],
                [key, "page", "col", "role"],
            )

    ready = rows.select(key, F.transform("headers", T.process).alias("headers"), widths.alias("widths"))
    return ready.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, page int, col int, role string")


def one_hot(role: Column, roles: list[str]) -> dict[str, Column]:
    return {f"is_{r}_column": F.coalesce(role == r, F.lit(False)) for r in roles}


def schema_to_rows(roles: DataFrame) -> DataFrame:
    """Editable rows of a form schema: position, label, active, keywords as text, widths in percent."""
    return roles.select(
        "role", F.col("pos").alias("Pos"), "label", F.coalesce("enabled", F.lit(True)).alias("active"), F.array_join("keywords", ", ").alias("keywords"),
        F.round(F.col("width_lo") * 100, 1).alias("min_percent"), F.round(F.col("width_hi") * 100, 1).alias("max_percent"),
    )


def rows_to_schema(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Back from edited rows: unknown roles go, empty keywords and impossible widths fall back to ``base``."""
    b = base.select("role", F.col("label").alias("b_label"), F.col("keywords").alias("b_keywords"), F.col("width_lo").alias("b_lo"), F.col("width_hi").alias("b_hi"))
    words = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), T.strip), lambda w: w != "")
    lo, hi = F.col("min_percent") / 100, F.col("max_percent") / 100
    good = F.coalesce((lo >= 0) & (lo < hi) & (hi <= 1), F.lit(False))
    order = Window.orderBy("Pos", "role")
    return rows.join(b, "role").select(
        F.row_number().over(order).alias("pos"),
        "role",
        F.coalesce(T.blank_to_null(T.clean(F.col("label"))), "b_label").alias("label"),
        F.when(F.size(words) > 0, words).otherwise(F.col("b_keywords")).alias("keywords"),
        F.when(good, lo).otherwise(F.col("b_lo")).alias("width_lo"),
        F.when(good, hi).otherwise(F.col("b_hi")).alias("width_hi"),
        F.col("active").alias("enabled"),
    )


def ragged_mean(df: DataFrame, key: list[str], values: str) -> DataFrame:
    """Mean by ordinal over arrays of different lengths."""
    return df.select(*key, F.posexplode(values).alias("ordinal", "v")).groupBy(*key, "ordinal").agg(F.avg("v").alias("mean"))


def nearest_widths(targets: Column, widths: Column) -> Column:
    """For each target width in order, the place of the nearest unused width if it is within half of the target, else null."""

    def choose(taken: Column, target: Column) -> Column:
        free = F.filter(F.transform(widths, lambda w, i: F.struct(F.abs(w - target).alias("off"), i.alias("i"))), lambda c: ~F.coalesce(F.array_contains(taken, c["i"]), F.lit(False)))
        best = lambda b: F.concat(taken, F.array(F.when(b["off"] <= target * 0.5, b["i"])))
        return T.let(F.array_min(free), best)

    return F.aggregate(targets, F.array().cast("array<int>"), choose)


def usual_count(values: str) -> Column:
    """Whole median of the lengths of the arrays in a column: how many columns a form has."""
    return F.floor(F.median(F.size(values))).cast("int")


def split_tall_rows(df: DataFrame, partition: list[str], least: int = 30) -> DataFrame:
    """Row strips (lo, hi) of at least 1.75 median heights are cut into median-sized pieces; those of ``least`` or less go first."""
    part = Window.partitionBy(*partition)
    tall = df.where(F.col("hi") - F.col("lo") > least).withColumn("median", F.median(F.col("hi") - F.col("lo")).over(part))
    pieces = F.when(F.col("hi") - F.col("lo") >= 1.75 * F.col("median"), F.greatest(F.lit(1), F.round((F.col("hi") - F.col("lo")) / F.col("median")).cast("int"))).otherwise(1)
    cut = tall.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    height = (F.col("hi") - F.col("lo")) / F.col("pieces")
    return cut.select(*partition, (F.col("lo") + F.col("piece") * height).cast("int").alias("lo"), (F.col("lo") + (F.col("piece") + 1) * height).cast("int").alias("hi"))


def row_spans(df: DataFrame, partition: list[str]) -> DataFrame:
    """Span of each row between slanted lines (y0, y1): least y of the line above to greatest y of its own."""
    order = Window.partitionBy(*partition).orderBy(F.least("y0", "y1"))
    return df.select(*partition, F.coalesce(F.lag(F.least("y0", "y1")).over(order), F.lit(0)).alias("lo"), F.greatest("y0", "y1").alias("hi"))


def proportional_band(row: Column, rows: Column, around: int = 5, top: float = 0.08, bottom: float = 0.985) -> Column:
    """struct(lo, hi): share of the page that shows ``around`` rows on either side of one."""
    height = (bottom - top) / F.greatest(rows, F.lit(1))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(clamp(top + (row - around) * height).alias("lo"), clamp(top + (row + around + 1) * height).alias("hi"))
