"""Token-id files: canonical length-limited Huffman coding with bit-offset checkpoints.

A file set is a folder of two tables: ``blocks``, and ``code`` with the length of each id's code and
which id ends a document. Each block is one byte string that decodes on its own (given the code lengths):

    magic b"QGH1", then little-endian unsigned 32-bit: documents, checkpoint interval K, checkpoints,
    payload bytes; int64 document ids; uint32 token counts; uint64 bit offset of every K-th token of
    each document; payload.

Each document starts at a byte of its own. Blocks are written in ascending doc_id order: by ``part``
(a range of doc_id), then by ``block``.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"QGH1"
MAX_BITS = 20
CHECKPOINT_TOKENS = 64
BLOCK_TOKENS = 1 << 17
#: Tokens of a part, and the most parts; beyond that many, parts grow.
PART_TOKENS = 1 << 23
MAX_PARTS = 4096


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for symbols that never occur."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    packages = np.zeros(0)
    levels = []
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weights))
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(order) - 2
    depth = np.zeros(len(order) + 1, dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(depth)[:-1]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = lengths[order].astype(np.int64)
    if len(order):
        top = int(bits.max())
        share = np.left_shift(np.int64(1), top - bits)
        codes[order] = ((np.cumsum(share) - share) >> (top - bits)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``top`` bits: the symbol and how many bits it takes."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = max(1, int(lengths.max(initial=1)))
    share = np.left_shift(1, top - lengths[order].astype(np.int64))
    symbol, width = np.zeros(1 << top, dtype=np.uint32), np.ones(1 << top, dtype=np.uint8)
    n = int(share.sum())
    symbol[:n], width[:n] = np.repeat(order, share), np.repeat(lengths[order], share)
    return symbol, width, top


def pack_bits(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bit strings of documents, each from a byte of its own: bytes, byte offsets, bit offset of each token in its document."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    first = np.concatenate([[0], np.cumsum(counts)])
    edge = np.concatenate([[0], ends])[first]
    bytes_of = (np.diff(edge) + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(bytes_of)])
    inside = ends - bits - np.repeat(edge[:-1], counts)
    at = inside + np.repeat(starts[:-1] * 8, counts)
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - bits.astype(np.uint64) - shift)
    n = (int(starts[-1]) + 3) // 4 + 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: int(starts[-1])], starts, inside


def unpack_bits(payload: bytes, at: np.ndarray, todo: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Decode ``todo[i]`` tokens from bit ``at[i]`` of each lane i; all lanes advance together."""
    symbol, width, top = table
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = raw[:-4] << 24 | raw[1:-3] << 16 | raw[2:-2] << 8 | raw[3:-1]
    starts = np.concatenate([[0], np.cumsum(todo)])
    out = np.empty(int(starts[-1]), dtype=np.uint32)
    lanes, at = np.flatnonzero(todo > 0), at.astype(np.int64).copy()
    for step in range(int(todo.max(initial=0))):
        lanes = lanes[todo[lanes] > step]
        here = at[lanes]
        peek = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - top)
        out[starts[lanes] + step] = symbol[peek]
        at[lanes] = here + width[peek]
    return out


def write_block(doc_ids: list[int], counts: list[int], payloads: list[bytes], checkpoints: list[bytes]) -> bytes:
    """One block; each document's checkpoints are uint64 bit offsets within it."""
    sizes = np.asarray([len(p) for p in payloads], dtype=np.int64)
    base = (np.cumsum(sizes) - sizes) * 8
    marks = [np.frombuffer(c, dtype="<u8") + np.uint64(b) for c, b in zip(checkpoints, base.tolist(), strict=True)]
    offsets = np.concatenate([*marks, np.zeros(0, dtype="<u8")]).astype("<u8")
    body = b"".join(payloads)
    head = np.asarray([len(doc_ids), CHECKPOINT_TOKENS, len(offsets), len(body)], dtype="<u4").tobytes()
    return MAGIC + head + np.asarray(doc_ids, dtype="<i8").tobytes() + np.asarray(counts, dtype="<u4").tobytes() + offsets.tobytes() + body


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, token counts, and all ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, every, marks, size = np.frombuffer(block, dtype="<u4", count=4, offset=4).tolist()
    at = 20
    doc_ids = np.frombuffer(block, dtype="<i8", count=n, offset=at)
    counts = np.frombuffer(block, dtype="<u4", count=n, offset=at + 8 * n).astype(np.int64)
    offsets = np.frombuffer(block, dtype="<u8", count=marks, offset=at + 12 * n)
    at += 12 * n + 8 * marks
    lanes = (counts + every - 1) // every
    owner = np.repeat(np.arange(n), lanes)
    inner = np.arange(marks) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    return doc_ids, counts, unpack_bits(block[at : at + size], offsets, np.minimum(every, counts[owner] - inner * every), table)


def read_ids(block: bytes, table: tuple[np.ndarray, np.ndarray, int], document: int, first: int, n: int) -> np.ndarray:
    """``n`` ids of the block's ``document``-th document from its ``first``-th on; decoding begins at the checkpoint before it."""
    documents, every, marks, size = np.frombuffer(block, dtype="<u4", count=4, offset=4).tolist()
    counts = np.frombuffer(block, dtype="<u4", count=documents, offset=20 + 8 * documents).astype(np.int64)
    before = int(((counts[:document] + every - 1) // every).sum())
    skip, stop = first // every, -(-min(first + n, int(counts[document])) // every)
    offsets = np.frombuffer(block, dtype="<u8", count=marks, offset=20 + 12 * documents)[before + skip : before + stop]
    todo = np.minimum(every, counts[document] - np.arange(skip, stop) * every)
    at = 20 + 12 * documents + 8 * marks
    return unpack_bits(block[at : at + size], offsets, todo, table)[first - skip * every :][:n]


def _ids_of_texts(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, ids, counts in tokens.encoded(batch, path, end_id):
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), common.binaries(ids, ends)], ["doc_id", "n_tokens", "ids"])

    return run


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        ids = common.joined_bytes(batch.column(0)).view("<u4")
        more = np.bincount(ids, minlength=len(total))
        more[: len(total)] += total
        total = more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def _encode_docs(lengths: np.ndarray, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("huffman")
        codes = canonical_codes(lengths)
        for batch in batches:
            for lo, hi in common.slices(batch.column(2), 2 << 20):
                part = batch.slice(lo, hi - lo)
                counts = np.asarray(part.column(1), dtype=np.int64)
                ids = common.joined_bytes(part.column(2)).view("<u4")
                body, starts, inside = pack_bits(ids, counts, codes, lengths)
                first = np.concatenate([[0], np.cumsum(counts)])
                place = np.arange(len(ids)) - np.repeat(first[:-1], counts)
                keep = place % CHECKPOINT_TOKENS == 0
                marks = inside[keep].astype("<u8").tobytes()
                mark_at = np.concatenate([[0], np.cumsum((counts + CHECKPOINT_TOKENS - 1) // CHECKPOINT_TOKENS)]) * 8
                doc_ids = part.column(0)
                sort_id = np.asarray(doc_ids.fill_null(-(1 << 63)), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.searchsorted(bounds, sort_id, side="right").astype(np.int32)),
                        doc_ids,
                        pa.array(counts),
                        common.binaries(body, starts),
                        common.binaries(marks, mark_at),
                    ],
                    ["part", "doc_id", "n_tokens", "payload", "marks"],
                )

    return run


_BLOCKS = "part int, block int, first long, n_docs int, n_tokens long, nulls binary, data binary"
_CODE = "id long, bits int, is_end boolean"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by part and doc_id; a block closes at BLOCK_TOKENS or where a part ends."""
    held: list[tuple] = []
    part, block, first, size = None, 0, 0, 0

    def close() -> pa.RecordBatch:
        ids = [0 if r[0] is None else r[0] for r in held]
        data = write_block(ids, [r[1] for r in held], [r[2] for r in held], [r[3] for r in held])
        nulls = np.packbits([r[0] is None for r in held]).tobytes()
        row = [[part], [block], [first], [len(held)], [size], [nulls], [data]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        names = ["part", "block", "first", "n_docs", "n_tokens", "nulls", "data"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (p != part or size >= BLOCK_TOKENS):
                yield close()
                block, first = (block + 1, first + size) if p == part else (0, 0)
                held, size = [], 0
            elif p != part:
                block, first = 0, 0
            part = p
            held.append(tuple(row))
            size += row[1]
    if held:
        yield close()


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for part, first, nulls, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                doc_ids, counts, ids = read_block(data, table)
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                gone = np.unpackbits(np.frombuffer(nulls, dtype=np.uint8))[: len(doc_ids)].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc_ids), part, dtype=np.int32)), pa.array(doc_ids, mask=gone), pa.array(ends[:-1] + first), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    return run


def _tokens_by_bin(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            place = np.searchsorted(cuts, np.asarray(batch.column(0).fill_null(-(1 << 63)), dtype=np.int64), side="right")
            np.add.at(total, place, np.asarray(batch.column(1), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["bin", "n"])

    return run


def part_bounds(ids: DataFrame, total: int, tokens_per_part: int) -> np.ndarray:
    """First doc_id of each part but the first: parts of about ``tokens_per_part`` tokens, MAX_PARTS at most.

    Quantiles of doc_id make four times as many bins as parts; neighbouring bins are joined by their tokens.
    """
    parts = min(MAX_PARTS, -(-total // tokens_per_part))
    if parts < 2:
        return np.zeros(0, dtype=np.int64)
    bins = 4 * parts
    quantiles = ids.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / bins for i in range(1, bins)], 0.5 / bins)
    cuts = np.unique(np.asarray(quantiles, dtype=np.int64))
    held = np.zeros(len(cuts) + 1, dtype=np.int64)
    for r in ids.select("doc_id", "n_tokens").mapInArrow(_tokens_by_bin(cuts), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        held[r.bin] = r.n
    part = np.cumsum(held)[:-1] * parts // max(1, total)
    return cuts[np.append(part[:1] > 0, part[1:] > part[:-1])]


def write_token_folder(docs: DataFrame, path: str | None = None, end_id: int = 1, tokens_per_part: int = PART_TOKENS) -> str:
    """Encode ``docs`` (doc_id, text) and write the blocks and the code; returns their folder.

    Only the id counts (at most one row for each id of the vocabulary) and the bounds of the parts
    (MAX_PARTS at most) come to the driver. Null text is empty (its end id is still written), null doc_id
    sorts first; rows with the same doc_id follow each other in one part, the shorter first.
    """
    path = path or tokens.tokenizer_path()
    spark = docs.sparkSession
    ids = common.materialize(docs.mapInArrow(_ids_of_texts(path, end_id), "doc_id long, n_tokens long, ids binary"), "ids")
    found = ids.select("ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    bounds = part_bounds(ids, int(counts.sum()), tokens_per_part)
    coded = ids.mapInArrow(_encode_docs(lengths, bounds), "part int, doc_id long, n_tokens long, payload binary, marks binary")
    parts = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_tokens", "payload")
    folder = common.shared_dir(spark, "token-files")
    code = {int(i): int(lengths[i]) for i in np.flatnonzero(lengths)}
    code.setdefault(end_id, 0)
    spark.createDataFrame([(i, n, i == end_id) for i, n in code.items()], _CODE).coalesce(1).write.parquet(f"{folder}/code")
    parts.mapInArrow(_blocks, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_code(spark, folder: str) -> tuple[np.ndarray, int]:
    """The code lengths of a folder of token files, by id, and the id that ends a document."""
    rows = spark.read.schema(_CODE).parquet(f"{folder}/code").collect()
    lengths = np.zeros(max(r.id for r in rows) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r.id] = r.bits
    return lengths, next(r.id for r in rows if r.is_end)


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 1, tokens_per_part: int = PART_TOKENS) -> tuple[DataFrame, np.ndarray]:
    """``write_token_folder``; returns the written blocks and the written code lengths."""
    folder = write_token_folder(docs, path, end_id, tokens_per_part)
    return docs.sparkSession.read.schema(_BLOCKS).parquet(f"{folder}/blocks"), read_code(docs.sparkSession, folder)[0]


def read_token_folder(spark, folder: str) -> DataFrame:
    """``read_token_files`` from the files alone."""
    return read_token_files(spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks"), read_code(spark, folder)[0])


def read_token_files(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Decode the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg(F.sum("n_tokens").alias("in_part")).select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    decoded = blocks.select("part", "first", "nulls", "data").mapInArrow(_decode(lengths), "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return decoded.join(base, "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def huffman_cost(counts: np.ndarray) -> int:
    """Bits of an unlimited Huffman code: the sum of all merges. For comparison."""
    heap = sorted(int(c) for c in counts if c)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` written as Huffman-coded token-id files and read back from them."""
    return read_token_folder(spark, write_token_folder(common.documents(common.table(spark, sf_dir, "documents"))))
