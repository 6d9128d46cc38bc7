"""Repeated passages by recompression.

Each text is parsed in rounds. A round names maximal runs of one symbol (by symbol and length) and then pairs
of neighbours (a, b), where the round's coin puts a on the left and b on the right side. Names and coins are
functions of content alone, so equal passages get equal symbols inside. Spark rounds make the names global:

1. The first rounds (``ROUNDS``) merge symbols of at most the round's limit of words, so that none passes
   four words and of any four neighbouring borders one survives. A surviving border depends on five words to
   each side at most and is named by those ten, so each window of 13 words has a named border inside (long
   runs of one word keep all borders). An exchange finds the names that occur in several documents.
2. Between borders that nobody shares, runs and pairs are named on without a limit (``HIGH_ROUNDS``). Symbols
   of 13 words and more go through a second exchange, which tells each occurrence whether a smaller document
   has the same symbol: that reveals a long repeat whole, by a few symbols, and verifies it by a hash that
   is independent of the names. All windows inside such a symbol are settled.
3. Windows under shared names that no settled symbol covers (at the ends of repeats, and in the smallest
   document that has a symbol) go through a third exchange by a fingerprint of their 13 words, independent of
   the names, too. The smallest document with a window is never settled by a symbol, so none is missed.

Documents travel in blocks of a few megabytes. Blocks send sorted, delta-coded names to hashed ranges and get
back one bit for each, so a passage that is in a third of all documents costs each block one entry, and
no range collects documents. Beyond ``FAN`` ranges names go in two steps: groups of blocks are merged for
each coarse range first, so that rows stay large and a name in every block counts once for its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
REACH = 5
#: The most words of a symbol that may merge, by round.
ROUNDS = (1, 2, 1, 2)
#: Rounds of runs and pairs without a limit of words.
HIGH_ROUNDS = 20
BLOCK_BYTES = 2 << 20
BYTES_PER_RANGE = 32 << 20
#: Ranges that blocks send to directly, and blocks that are merged for each of them where there are more.
FAN = 1024
GROUP_BLOCKS = 4096


_PAIR, _RUN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)


def _coin(name: np.ndarray, i: int) -> np.ndarray:
    return (common.mix64(name + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)


def _paired(join: np.ndarray, keep: np.ndarray, name: np.ndarray, i: int) -> np.ndarray:
    out, at = name.copy(), np.flatnonzero(join)
    out[at] = common.mix64(name[at] * _PAIR + name[at + 1] + np.uint64(i + 1))
    return out[keep]


class Symbols:
    """Neighbouring symbols of a block: first word, words, name, and a second name with independent hashes."""

    def __init__(self, code: np.ndarray, check: np.ndarray | None, group: np.ndarray) -> None:
        self.start, self.size, self.name, self.check, self.group = np.arange(len(code)), np.ones(len(code), dtype=np.int32), code, check, group

    def only(self, keep: np.ndarray) -> None:
        self.start, self.size, self.name, self.group = (x[keep] for x in (self.start, self.size, self.name, self.group))
        self.check = None if self.check is None else self.check[keep]

    def runs(self) -> None:
        """Each maximal run of one symbol becomes a symbol; with second names only."""
        same = (self.name[1:] == self.name[:-1]) & (self.check[1:] == self.check[:-1]) & (self.group[1:] == self.group[:-1])
        if not same.any():
            return
        head = np.append(True, ~same)
        first = np.flatnonzero(head)
        times = np.diff(np.append(first, len(head))).astype(np.uint64)
        size = np.add.reduceat(self.size, first)
        self.only(head)
        with np.errstate(over="ignore"):
            self.name, self.check = (np.where(times > 1, common.mix64(x * _RUN + times), x) for x in (self.name, self.check))
        self.size = size

    def pairs(self, i: int, limit: int | None = None) -> bool:
        """Neighbours that the coin of round ``i`` puts on the left and right side become a symbol."""
        if len(self.start) < 2:
            return False
        coin = _coin(self.name, i)
        join = ~coin[:-1] & coin[1:] & (self.group[:-1] == self.group[1:])
        if limit is not None:
            may = self.size <= limit
            join &= may[:-1] & may[1:]
        if not join.any():
            return False
        join, keep = np.append(join, False), np.append(True, ~join)
        with np.errstate(over="ignore"):
            name, check = (None if x is None else _paired(join, keep, x, i) for x in (self.name, self.check))
        size = np.where(join, self.size + np.roll(self.size, -1), self.size)[keep]
        self.only(keep)
        self.name, self.check, self.size = name, check, size
        return True


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``code``, where each distinct value begins in it, the distinct values, and which one each place has."""
    order = np.argsort(code)
    in_order = code[order]
    new = np.append(True, in_order[1:] != in_order[:-1])[: len(code)]
    at = np.empty(len(code), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), in_order[new], at


class Content:
    """Occurrences by content: distinct codes in order, the least doc_id of each, and which code each occurrence has."""

    def __init__(self, code: np.ndarray, doc_id: np.ndarray) -> None:
        self.doc_id = doc_id
        order, head, self.codes, self.at = _distinct(code)
        self.least = np.minimum.reduceat(doc_id[order], head) if len(head) else doc_id[:0]

    def earlier(self, answers: list[dict] | None, ranges: int) -> np.ndarray:
        """Which occurrences have the same content in a smaller document, here or, by the ``answers``, anywhere."""
        return _bits_of(answers, self.codes, ranges)[self.at] | (self.doc_id > self.least[self.at])


class Parsed:
    """A block's words, its symbols and named borders, and the windows."""

    def __init__(self, block: bytes, checked: bool = True) -> None:
        """``checked``: with the second hashes, which names do not need."""
        common.enter("words")
        self.rows = pa.ipc.open_stream(block).read_all().combine_chunks()
        ids = self.rows.column("doc_id").combine_chunks() if self.rows.num_rows else pa.array([], pa.int64())
        self.valid = np.asarray(ids.is_valid())
        self.doc_id = np.asarray(ids.fill_null(0), dtype=np.int64)
        self.raw, offsets = common.buffer_of(self.rows.column("text"))
        self.start, self.end, self.first, self.code, *check = common.words_of(self.raw, offsets, seeds=(0, 1) if checked else (0,))
        self.check = check[0] if checked else None
        n_words = np.diff(self.first)
        self.row = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
        stop = np.repeat(self.first[1:], n_words)
        begin = np.repeat(self.first[:-1], n_words)
        place = np.arange(len(self.code))
        usable = self.valid[self.row] if len(self.row) else np.zeros(0, dtype=bool)
        self.symbols = Symbols(self.code, self.check, self.row)
        for i, limit in enumerate(ROUNDS):
            self.symbols.pairs(i, limit)
        border = np.zeros(len(self.code), dtype=bool)
        border[self.symbols.start] = True
        self.border = np.flatnonzero(border & (place - REACH >= begin) & (place + REACH <= stop) & usable)
        self.window = np.flatnonzero((place + WINDOW <= stop) & usable)
        name = common.chain(self.code, 2 * REACH)[self.border - REACH] if len(self.border) else np.zeros(0, np.uint64)
        self.order, self.head, self.names, self.name_at = _distinct(name)

    def several(self) -> np.ndarray:
        """Which of the distinct border names are in several documents of the block."""
        doc_id = self.doc_id[self.row[self.border]][self.order]
        return np.minimum.reduceat(doc_id, self.head) < np.maximum.reduceat(doc_id, self.head) if len(self.head) else np.zeros(0, bool)

    def alone(self, shared: np.ndarray) -> np.ndarray:
        """Which words a border without a shared name stands before; ``shared``: by distinct name."""
        out = np.zeros(len(self.code) + 1, dtype=bool)
        if len(self.border):
            out[self.border] = ~shared[self.name_at]
        return out

    def long_symbols(self, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, Content]:
        """Symbols of 13 words and more between borders that nobody shares: first word, words, content."""
        some = self.symbols
        if len(some.start):
            usable = self.valid[self.row[some.start]]
            some.group = np.cumsum(alone[some.start] | np.append(True, some.group[1:] != some.group[:-1]))
            some.only(usable & (np.bincount(some.group, some.size)[some.group] >= WINDOW))
        starts, sizes, checks = [some.start[:0]], [some.size[:0]], [some.check[:0]]
        words = np.zeros(len(self.code), dtype=np.int64)
        for i in range(HIGH_ROUNDS):
            if not len(some.start):
                break
            words[some.start] = some.size
            some.runs()
            some.pairs(len(ROUNDS) + i)
            new = (some.size >= WINDOW) & (words[some.start] != some.size)
            starts.append(some.start[new])
            sizes.append(some.size[new])
            checks.append(some.check[new])
        start, size, check = (np.concatenate(x) for x in (starts, sizes, checks))
        return start, size, Content(check, self.doc_id[self.row[start]] if len(start) else np.zeros(0, np.int64))

    def windows(self, alone: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, Content]:
        """Windows under shared names that are not inside settled words: their places and content.

        ``settled``: for each word, how many words from it on belong to one settled symbol.
        """
        so_far = np.cumsum(np.append(False, alone))
        p = self.window
        p = p[(so_far[p + WINDOW - REACH + 1] == so_far[p + REACH]) & (settled[p] < WINDOW)]
        return p, Content(common.chain(self.check, WINDOW)[p] if len(p) else np.zeros(0, np.uint64), self.doc_id[self.row[p]] if len(p) else np.zeros(0, np.int64))

    def settled(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each word the most words from it on that one of the symbols covers."""
        reach = np.zeros(len(self.code) + 1, dtype=np.int64)
        np.maximum.at(reach, start, start + size)
        return np.maximum(np.maximum.accumulate(reach)[:-1] - np.arange(len(self.code)), 0)

    def covered(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that the passages cover."""
        edge = np.zeros(len(self.code) + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size, -1)
        return np.cumsum(edge)[: len(self.code)] > 0

    def kept(self, gone: np.ndarray) -> Iterator[bytes]:
        """Each row's remaining words, joined by one space."""
        stay = np.flatnonzero(~gone)
        begin, size = self.start[stay], self.end[stay] - self.start[stay] + 1
        out = np.cumsum(size)
        bounds = np.append(0, out)[np.searchsorted(stay, self.first)]
        for a, b, lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.searchsorted(stay, self.first[:-1]).tolist(), np.searchsorted(stay, self.first[1:]).tolist(), strict=True):
            if a == b:
                yield b""
                continue
            index = np.arange(b - a) + np.repeat(begin[lo:hi] - (out[lo:hi] - size[lo:hi] - a), size[lo:hi])
            text = self.raw[np.minimum(index, len(self.raw) - 1)]
            text[out[lo:hi] - a - 1] = 32
            yield text[:-1].tobytes()


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted or similar 64-bit integers: differences, by byte plane, compressed."""
    step = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view(kind).reshape(-1), dtype=kind)


def _bounds(codes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted fingerprints; ranges divide the 64-bit space evenly."""
    if not len(codes):
        return []
    of = ((codes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return [(int(of[a]), int(a), int(b)) for a, b in zip(head, np.append(head[1:], len(of)), strict=True)]


def _write_blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base, n = (task.partitionId() if task else 0) << 32, 0
        held: list[pa.RecordBatch] = []
        weight = 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi in common.slices(texts, size):
                part = texts.slice(lo, hi - lo)
                held.append(batch.slice(lo, hi - lo))
                weight += int(common.pc.sum(common.pc.binary_length(part)).as_py() or 0)
                if weight >= size:
                    yield close()
                    held, weight, n = [], 0, n + 1
        if held:
            yield close()

    return run


_SENT = "range int, block long, codes binary, extra binary"
_BACK = "block long, range int, bits binary"


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _rows(codes: np.ndarray, extra: np.ndarray, block: int, ranges: int) -> pa.RecordBatch:
    """A row for each range that ``codes`` (sorted) fall into; ``extra`` is a flag or a number for each code."""
    cut = _bounds(codes, ranges)
    pack = (lambda x: np.packbits(x).tobytes()) if extra.dtype == bool else _squeeze
    return _batch(
        [[r for r, _, _ in cut], [block] * len(cut), [_squeeze(codes[a:b]) for _, a, b in cut], [pack(extra[a:b]) for _, a, b in cut]],
        [pa.int32(), pa.int64(), pa.binary(), pa.binary()],
        ["range", "block", "codes", "extra"],
    )


class Entries:
    """The rows of one range: all codes with their extras, sorted, and where each content begins."""

    def __init__(self, table: pa.Table, flags: bool) -> None:
        self.table = table
        self.each = [_unsqueeze(d, np.uint64) for d in table.column("codes").to_pylist()]
        unpack = (lambda x, n: np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool)) if flags else (lambda x, _: _unsqueeze(x, np.int64))
        extra = np.concatenate([unpack(x, len(e)) for x, e in zip(table.column("extra").to_pylist(), self.each, strict=True)])
        codes = np.concatenate(self.each)
        self.order = np.argsort(codes, kind="stable")
        codes = codes[self.order]
        self.own, self.flags = extra[self.order], flags
        self.head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        self.codes, self.times = codes[self.head], np.diff(np.append(self.head, len(codes)))

    def merged(self) -> np.ndarray:
        """Per content: whether several documents have it, or the least document."""
        if self.flags:
            return np.maximum.reduceat(self.own, self.head) | (self.times > 1)
        return np.minimum.reduceat(self.own, self.head)

    def answer(self, above: np.ndarray | None = None) -> pa.Table:
        """One bit for each entry, back to its block: shared, or in a smaller document; ``above``: what is known of the content beyond these rows."""
        by_code = self.merged()
        if self.flags:
            told = np.repeat(by_code if above is None else by_code | above, self.times)
        else:
            told = np.repeat(by_code, self.times) < self.own
            if above is not None:
                told |= np.repeat(above, self.times)
        bits = np.empty(len(self.order), dtype=bool)
        bits[self.order] = told
        ends = np.cumsum([len(e) for e in self.each])
        packed = [np.packbits(bits[b - len(e) : b]).tobytes() for e, b in zip(self.each, ends.tolist(), strict=True)]
        return pa.Table.from_arrays([self.table.column("block"), self.table.column("range"), pa.array(packed, pa.binary())], ["block", "range", "bits"])


def _bits_of(answers: list[dict] | None, codes: np.ndarray, ranges: int) -> np.ndarray:
    got = {a["range"]: a["bits"] for a in answers or ()}
    out = np.zeros(len(codes), dtype=bool)
    for r, a, b in _bounds(codes, ranges):
        out[a:b] = np.unpackbits(np.frombuffer(got[r], np.uint8))[: b - a].astype(bool)
    return out


def _answers(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias(name))


def exchange(sent: DataFrame, name: str, flags: bool, ranges: int, blocks: int) -> DataFrame:
    """(block, ``name``): the answers to what the blocks ``sent`` (_SENT) to the ``coarse(ranges)`` ranges."""
    answer = lambda table: Entries(table, flags).answer()
    if ranges <= FAN:
        return common.materialize(_answers(sent.groupBy("range").applyInArrow(answer, _BACK), name), name)
    groups = -(-blocks // GROUP_BLOCKS)
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    sent = common.materialize(sent.withColumn("group", group), f"{name}-sent")

    def combine(table: pa.Table) -> pa.Table:
        entries = Entries(table, flags)
        me = table.column("range")[0].as_py() * groups + table.column("group")[0].as_py()
        return pa.Table.from_batches([_rows(entries.codes, entries.merged(), me, ranges)])

    def reply(table: pa.Table, answers: pa.Table) -> pa.Table:
        entries = Entries(table, flags)
        told = [x for row in answers.column("answers").to_pylist() for x in row]
        return entries.answer(_bits_of(told, entries.codes, ranges))

    combined = sent.groupBy("range", "group").applyInArrow(combine, _SENT)
    told = _answers(combined.groupBy("range").applyInArrow(answer, _BACK), "answers")
    told = told.select(F.floor(F.col("block") / groups).cast("int").alias("range"), (F.col("block") % groups).cast("int").alias("group"), "answers")
    back = sent.groupBy("range", "group").cogroup(told.groupBy("range", "group")).applyInArrow(reply, _BACK)
    return common.materialize(_answers(back, name), name)


def coarse(ranges: int) -> int:
    """The ranges that blocks send to."""
    return min(ranges, FAN)


class Block:
    """What a block knows after the exchanges so far; ``answers``: names, symbols, windows."""

    def __init__(self, data, answers: list, ranges: int) -> None:
        self.parsed = parsed = Parsed(data.as_buffer(), bool(answers))
        if answers:
            alone = parsed.alone(_bits_of(answers[0], parsed.names, ranges))
            self.start, self.size, self.symbols = parsed.long_symbols(alone)
        if len(answers) > 1:
            early = self.symbols.earlier(answers[1], ranges)
            self.start, self.size = self.start[early], self.size[early]
            self.place, self.windows = parsed.windows(alone, parsed.settled(self.start, self.size))

    def gone(self, answers: list[dict] | None, ranges: int) -> np.ndarray:
        early = self.place[self.windows.earlier(answers, ranges)]
        return self.parsed.covered(np.concatenate([early, self.start]), np.concatenate([np.full(len(early), WINDOW), self.size]))


def _send(ranges: int):
    """What the next exchange needs of each block (block, data, answers so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, *answers in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                known = Block(data, [a.as_py() for a in answers], ranges)
                if not answers:
                    yield _rows(known.parsed.names, known.parsed.several(), block, ranges)
                else:
                    content = known.symbols if len(answers) == 1 else known.windows
                    yield _rows(content.codes, content.least, block, ranges)
                del known
        common.leave()

    return run


def _finish(ranges: int, names: list[str] | None):
    """names: the columns to return with the new text; None: the digest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, *answers in zip(*batch.columns, strict=True):
                told = [a.as_py() for a in answers]
                known = Block(data, told[:2], ranges)
                parsed, gone = known.parsed, known.gone(told[2], ranges)
                n_words = np.diff(parsed.first)
                n_removed = np.diff(np.append(0, np.cumsum(gone))[parsed.first])
                if names is None:
                    digest = [hashlib.sha256(t).hexdigest() for t in parsed.kept(gone)]
                    ids = parsed.rows.column("doc_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_removed), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                    continue
                old = parsed.rows.column("text").to_pylist()
                text = [new.decode() if n else t for new, n, t in zip(parsed.kept(gone), n_removed.tolist(), old, strict=True)]
                columns = [pa.array(text, pa.string()) if c == "__text" else parsed.rows.column(c).combine_chunks() for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)
        parsed = known = None
        common.leave()

    return run


EXCHANGES = ("names", "symbols", "windows")


def _run(rows: DataFrame, block_bytes: int, bytes_per_range: int) -> tuple[DataFrame, int]:
    """(data, names, symbols, windows): the blocks with the answers of all exchanges; and the number of coarse ranges."""
    blocks = common.materialize(rows.mapInArrow(_write_blocks(block_bytes), "block long, data binary"), "blocks", "none")
    size, n = blocks.select(F.sum(F.octet_length("data")), F.count("*")).first()
    ranges = max(1, 2 * (size or 0) // bytes_per_range)
    known = blocks
    for name in EXCHANGES:
        told = exchange(known.mapInArrow(_send(coarse(ranges)), _SENT), name, name == "names", ranges, n)
        known = known.join(told, "block", "left")
    return known.drop("block"), coarse(ranges)


def removed_words(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bytes_per_range: int = BYTES_PER_RANGE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each of ``docs`` (doc_id, text).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id.
    Null and empty texts have no words. Rows of equal doc_id count as one document; rows with null
    doc_id neither lose words nor make others lose them.
    """
    found, ranges = _run(docs.select("doc_id", "text"), block_bytes, bytes_per_range)
    return found.mapInArrow(_finish(ranges, None), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bytes_per_range: int = BYTES_PER_RANGE) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; texts that lose nothing stay as they are."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    rest = docs.toDF(*plain)
    at = {c: p for c, p in zip(docs.columns, plain, strict=True)}
    others = [p for p in plain if p != at["text"]]
    rows = rest.select(*others, F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).cast("string").alias("text"))
    found, ranges = _run(rows, block_bytes, bytes_per_range)
    names = ["__text" if p == at["text"] else p for p in plain]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "__text" else rest.schema[n].dataType) for n in names])
    return found.mapInArrow(_finish(ranges, names), schema).toDF(*docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without the 13-word passages that an earlier document has."""
    return removed_words(common.documents(common.table(spark, sf_dir, "documents")))
