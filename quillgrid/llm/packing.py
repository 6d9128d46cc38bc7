"""Sequence packing by non-negative least squares over length patterns.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. There, patterns of
up to three length bins that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares, rounded, and cut to what the histogram holds. What remains
is packed by best fit, first into the room that the patterns leave, then into new sequences. The result
is a bounded table of slots; each piece finds its slot from its rank among the pieces of its length. The
task that makes a piece counts its place among the pieces of its length in a part (a run of the task's
pieces); running sums over the parts' counts turn places into ranks, so that no piece is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
BINS = 256
ROWS_PER_PART = 16_384


def patterns(bins: int) -> np.ndarray:
    """All multisets of one to three bins whose numbers (1..bins) add up to ``bins``, zero-padded."""
    one = [(bins, 0, 0)]
    two = [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    three = [(a, b, bins - a - b) for a in range((bins + 2) // 3, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)]
    return np.asarray(one + two + three, dtype=np.int64)


def nnls(columns: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Lawson-Hanson active sets: x >= 0 that minimises |W (A x - target)|; a column lists its rows (0: none)."""
    n_rows, n = len(target), len(columns)
    scale = np.append(weight, 0.0)
    rows = np.where(columns > 0, columns - 1, n_rows)
    goal = target * weight

    def dense(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((n_rows + 1, len(chosen)))
        for k in range(rows.shape[1]):
            np.add.at(out, (rows[chosen, k], np.arange(len(chosen))), scale[rows[chosen, k]])
        return out[:n_rows]

    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    left = goal.copy()
    least = 1e-9 * max(1.0, float(np.abs(goal).max(initial=0)))
    for _ in range(rounds):
        pull = np.append(left * weight, 0.0)[rows].sum(axis=1)
        pull[active] = -np.inf
        best = int(pull.argmax())
        if pull[best] <= least:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            a = dense(chosen)
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-10 * max(1.0, float(gram.diagonal().max()))
            z = np.linalg.solve(gram, a.T @ goal)
            if z.min() > 0:
                break
            falling = z <= 0
            step = np.min(x[chosen][falling] / np.maximum(x[chosen][falling] - z[falling], 1e-300))
            moved = x[chosen] + step * (z - x[chosen])
            x[chosen] = np.where(moved > 1e-12, moved, 0)
            if not falling.any() or (x[chosen] > 0).all():
                x[chosen[falling]] = 0
            active = active & (x > 0)
            if not active.any():
                break
        x[:] = 0
        chosen = np.flatnonzero(active)
        if len(chosen):
            x[chosen] = z
            left = goal - dense(chosen) @ z
    return x


class Plan:
    """Slots: for each length, ranges of ranks that share a place in a range of sequences."""

    def __init__(self, start: np.ndarray, copies: np.ndarray, offset: np.ndarray, first: np.ndarray, sequences: int, from_patterns: int) -> None:
        self.start, self.copies, self.offset, self.first = start, copies, offset, first
        self.sequences, self.from_patterns = sequences, from_patterns

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << np.int64(44) | rank
        at = np.searchsorted(self.start, key, side="right") - 1
        inner = key - self.start[at]
        return self.first[at] + inner // self.copies[at], self.offset[at] + inner % self.copies[at] * length


def plan(histogram: np.ndarray, capacity: int = CAPACITY, bins: int = BINS) -> Plan:
    """``histogram[n]``: how many pieces have length n (1..capacity; index 0 is ignored)."""
    left = np.asarray(histogram, dtype=np.int64).copy()
    left[0] = 0
    bins = min(bins, capacity)
    width = -(-capacity // bins)
    bins = capacity // width
    bin_of = np.minimum(-(-np.arange(capacity + 1) // width), bins)
    bin_of[np.arange(capacity + 1) > bins * width] = 0
    have = np.bincount(bin_of, left, bins + 1)[1:]
    shapes = patterns(bins)
    weight = np.maximum(0.1, np.arange(1, bins + 1) / bins)
    counts = nnls(shapes, have, weight, 3 * bins)

    open_at: dict[int, list[tuple[tuple | None, int]]] = {}
    closed = 0
    by_bin = [[int(n) for n in np.flatnonzero(bin_of == b)[::-1]] for b in range(bins + 1)]

    def draw(b: int, most: int, room: int) -> tuple[int, int]:
        """The largest length of bin b; with ``room``, the last part: the largest that still fits, from bin b up."""
        for n in range(room, by_bin[b][-1] - 1, -1) if room else by_bin[b]:
            if left[n]:
                return n, min(most, int(left[n]))
        return 0, 0

    from_patterns = 0
    for p in np.argsort(-counts, kind="stable"):
        todo = int(counts[p] + 0.5)
        if not todo:
            break
        parts = [int(b) for b in shapes[p] if b]
        while todo:
            node, used, n = None, 0, todo
            taken = []
            for i, b in enumerate(parts):
                length, got = draw(b, n, capacity - sum(t for t, _ in taken) if i and i == len(parts) - 1 else 0)
                if not got:
                    break
                taken.append((length, 1))
                left[length] -= 1
                n = min(n, got)
            for length, _ in taken:
                left[length] += 1
            if len(taken) < len(parts):
                break
            need: dict[int, int] = {}
            for length, _ in taken:
                need[length] = need.get(length, 0) + 1
            n = min([n, *(int(left[length]) // k for length, k in need.items())])
            if n == 0:
                break
            for length, k in need.items():
                left[length] -= n * k
                node, used = (node, length, k), used + length * k
            open_at.setdefault(capacity - used, []).append((node, n))
            todo -= n
            from_patterns += n
    for length in range(capacity, 0, -1):
        n = int(left[length])
        rooms = sorted(r for r, held in open_at.items() if r >= length and held)
        for room in rooms:
            held, rest = open_at.pop(room), []
            fit = room // length
            for node, count in held:
                full = min(count, n // fit)
                if full:
                    open_at.setdefault(room - fit * length, []).append(((node, length, fit), full))
                    n -= full * fit
                    count -= full
                if count and n:
                    open_at.setdefault(room - n * length, []).append(((node, length, n), 1))
                    n, count = 0, count - 1
                if count:
                    rest.append((node, count))
            if rest:
                open_at.setdefault(room, []).extend(rest)
            if not n:
                break
        if n:
            fit = capacity // length
            if n // fit:
                open_at.setdefault(capacity - fit * length, []).append(((None, length, fit), n // fit))
            if n % fit:
                open_at.setdefault(capacity - n % fit * length, []).append(((None, length, n % fit), 1))
    rank = np.zeros(capacity + 1, dtype=np.int64)
    slots: list[tuple[int, int, int, int]] = []
    for room in sorted(open_at):
        for node, count in open_at[room]:
            items = []
            while node:
                node, length, k = node
                items.append((length, k))
            offset = 0
            for length, k in reversed(items):
                slots.append((length << 44 | int(rank[length]), k, offset, closed))
                rank[length] += k * count
                offset += k * length
            closed += count
    slots.sort()
    start, copies, offset, first = (np.asarray(c, dtype=np.int64) for c in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 4
    return Plan(start, copies, offset, first, closed, from_patterns)


#: What ``numbered`` adds: a piece's part, its place among the part's pieces of its length, and, in a row of its own, the part's counts by length.
PART, PLACE, COUNTS = "__part", "__place", "__counts"


def numbered(batches: Iterator[pa.RecordBatch], capacity: int, rows_per_part: int) -> Iterator[pa.RecordBatch]:
    """A task's pieces (with ``length``, 1..capacity) and their places; a part ends with the batch that fills it."""
    counts_type = pa.list_(pa.int64())
    part, rows, counts = TaskContext.get().partitionId() << 32, 0, np.zeros(capacity + 1, dtype=np.int64)

    def end(schema: pa.Schema) -> pa.RecordBatch:
        columns = [*(pa.nulls(1, f.type) for f in schema), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts], counts_type)]
        return pa.RecordBatch.from_arrays(columns, [*schema.names, PART, PLACE, COUNTS])

    for batch in batches:
        length = np.asarray(batch.column(batch.schema.get_field_index("length")), dtype=np.int64)
        here = np.bincount(length, minlength=capacity + 1)
        order = np.argsort(length, kind="stable")
        place = np.empty(len(length), dtype=np.int64)
        place[order] = np.arange(len(length)) + np.repeat(counts - (np.cumsum(here) - here), here)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part)), pa.array(place), pa.nulls(len(length), counts_type)], [*batch.schema.names, PART, PLACE, COUNTS])
        counts += here
        rows += len(length)
        if rows >= rows_per_part:
            yield end(batch.schema)
            part, rows = part + 1, 0
            counts[:] = 0
    if rows:
        yield end(batch.schema)


def _sums(capacity: int):
    """Counts of the parts before each part; part -1: of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            before = []
            for counts in batch.column(1):
                before.append(total.copy())
                total += np.asarray(counts.values, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.list_(pa.int64()))], [PART, "__before"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.list_(pa.int64()))], [PART, "__before"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, which ``numbered`` made for this capacity; they are read more than once.

    A row of ``capacity`` + 1 counts for each part goes through one task and then meets the part's pieces.
    """
    parts = pieces.where(F.col(COUNTS).isNotNull()).select(PART, COUNTS).repartition(1).sortWithinPartitions(PART)
    before = common.materialize(parts.mapInArrow(_sums(capacity), f"{PART} long, __before array<long>"), "piece-counts")
    total = before.where(F.col(PART) < 0).select("__before").head()
    fitted = plan(np.asarray(total[0], dtype=np.int64) if total else np.zeros(capacity + 1, dtype=np.int64), capacity)
    names = [c for c in pieces.columns if c not in (PART, PLACE, COUNTS)]
    rank = F.get("__before", F.col("length").cast("int")) + F.col(PLACE)
    met = pieces.where(F.col(PLACE).isNotNull()).drop(COUNTS).join(before.hint("shuffle_hash"), PART)
    schema = met.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("places")
        for batch in batches:
            length, rank = (np.asarray(batch.column(i), dtype=np.int64) for i in (len(names), len(names) + 1))
            sequence, offset = fitted.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return met.select(*names, F.col("length").cast("long").alias("__length"), rank.alias("__rank")).mapInArrow(place, schema)


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool, rows_per_part: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, ids, counts in tokens.encoded(batch, path, end_id):
                n_pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                length = np.minimum(capacity, counts[owner] - piece * capacity)
                base = (np.cumsum(counts) - counts)[owner] + piece * capacity
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(base.tolist(), length.tolist(), strict=True)]
                columns = [doc_ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(common.binaries(ids, 4 * np.append(0, np.cumsum(length))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from numbered(cut(batches), capacity, rows_per_part)
        common.leave()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Pack all token ids of ``docs`` (doc_id, text) into sequences of at most ``capacity``.

    Each document's ids are followed by ``end_id``; only documents longer than ``capacity`` are cut.
    Null or empty text is a piece of one id; rows with the same or a null doc_id are packed each on its
    own; an empty table gives no rows. Returns a row for each piece; ``with_ids`` adds its ids (little-endian
    unsigned 32-bit), so that the pieces of a sequence in order of their offset are its content.
    """
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long{', ids binary' * with_ids}, {PART} long, {PLACE} long, {COUNTS} array<long>"
    pieces = common.materialize(docs.mapInArrow(_pieces(path or tokens.tokenizer_path(), end_id, capacity, with_ids, rows_per_part), schema), "pieces")
    return pack(pieces, capacity)


def op1_pack_documents(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    return pack_documents(common.documents(common.table(spark, sf_dir, "documents")))
