"""Near duplicates by a chosen-path set similarity join.

Each distinct shingle set has ``COORDINATES`` minwise tokens. In each of ``TREES`` independent trees a
node picks coordinates, and a document goes to the child named by its token there: two sets of
similarity s share such a child with probability s. Small nodes are compared exhaustively, crowded ones
branch again (``BRANCHES`` coordinates), and what is still crowded after ``LEVELS`` is compared in pairs
of blocks, so no pair is dropped. A pair of similarity s meets in a tree with probability s at the first
level and s (1 - (1 - s) ** BRANCHES) ** l after l crowded ones; at 0.8 all trees miss it with probability
2.6e-6, or 5.5e-5 if all its nodes are crowded on all levels.

Only documents of different components need comparing. So a first pass links each document to its node's
smallest document where their sketches agree, confirms those links on the full sets, and joins them to
components; nodes that lie within one component then drop out. This is what keeps a group of thousands of
copies linear. A node's possible links come back as stars, whose components meet once more with their
texts. Sketches (four bits a coordinate) only choose which pairs are confirmed: they rule out a pair of
similarity 0.8 with probability below 1e-8 (``SLACK``). A confirmed link compares the full sets by shingle
fingerprints that are independent of those that sketches, trees and candidates come from.

Texts travel where they are compared only: once for each pair of the first pass and once for each ``PARTNERS``
pairs for its hub; in the second pass to those nodes where a sketch allows a link. Either pass exchanges
the texts by doc_id once, at every size: the ids that want them grow with the input, so they are not
broadcast. Nodes with texts are bounded by bytes (``NODE_BYTES``), beside single longer texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

COORDINATES = 128
TREES = 8
HUB_TREES = 3
#: Rows of a node that are compared at once, and how many outside its largest component make it branch.
SMALL = 512
MANY = 2048
BRANCHES = 2
LEVELS = 4
#: How far a sketch's estimate may lie under the threshold. At 0.8, 52 of 128 coordinates may differ, where 24 do on average.
SLACK = 0.234
#: Texts that meet a hub in one place, and bytes of text of a chunk of a node.
PARTNERS = 256
NODE_BYTES = 16 << 20
ROWS_PER_TASK = 60_000

_rng = np.random.default_rng(20_240_607)
_MULTIPLIERS = (_rng.integers(1, 1 << 31, COORDINATES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_FIRST = _rng.permutation(COORDINATES)[:TREES]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, seeds: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each seed, each row's distinct word shingles as sorted fingerprints; fewer words than ``width`` are one shingle."""
    _, _, first, *codes = common.words_of(raw, offsets, lower=True, seeds=seeds)
    rows = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    out = []
    for code in codes:
        wide = common.chain(code, width)
        whole = lambda a, b, code=code: common.chain(code[a:b], b - a)[:1] ^ np.uint64(b - a)
        out.append([np.unique(wide[a : b - width + 1]) if b - a >= width else whole(a, b) if b > a else np.zeros(0, dtype=np.uint64) for a, b in rows])
    return out


def checked_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sets that links are confirmed on."""
    return shingle_sets(*common.buffer_of(texts), width, (1,))[0]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minwise tokens of each non-empty set."""
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    sizes = np.asarray([len(s) for s in sets])
    at = 0
    while at < len(sets):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 16, side="right")))
        x = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        head = np.cumsum(sizes[at:upto]) - sizes[at:upto]
        with np.errstate(over="ignore"):
            for i in range(COORDINATES):
                y = x * _MULTIPLIERS[i] + _ADDENDS[i]
                out[at:upto, i] = np.minimum.reduceat(y ^ (y >> np.uint32(15)), head)
        at = upto
    return out


def nibbles(tokens: np.ndarray) -> np.ndarray:
    """Four bits of each token, 16 to a 64-bit word."""
    bits = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return np.ascontiguousarray(bits[:, 0::2] | bits[:, 1::2] << np.uint8(4)).view("<u8")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from two rows of nibbles, corrected for chance agreement."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int32)
    return 1 - differ / (COORDINATES * 15 / 16)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("words")
        for batch in batches:
            for lo, hi in common.slices(batch.column(1), 1 << 20):
                texts = batch.column(1).slice(lo, hi - lo)
                sets, others = shingle_sets(*common.buffer_of(texts), width, (0, 1))
                filled = [i for i, s in enumerate(sets) if len(s)]
                tokens = minwise([sets[i] for i in filled]) if filled else np.zeros((0, COORDINATES), np.uint32)
                sketch: list[bytes | None] = [None] * len(sets)
                key: list[bytes | None] = [None] * len(sets)
                with np.errstate(over="ignore"):
                    for i, row in zip(filled, tokens, strict=True):
                        sketch[i] = row.astype("<u4").tobytes()
                        key[i] = np.asarray([common.mix64(sets[i]).sum(), common.mix64(others[i]).sum()], dtype="<u8").tobytes()
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [batch.column(0).slice(lo, hi - lo), sizes, pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pc.binary_length(texts).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "tokens", "bytes"])
        common.leave()

    return run


_NODE = "tree int, node long, rid long, label long, n long, sketch binary"


def _rows(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(-1, width)


def _plant(trees: int):
    """The first level: a node for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _rows(batch, "tokens", "<u4", COORDINATES)
            sketch = [r.tobytes() for r in nibbles(tokens)]
            for tree in range(trees):
                with np.errstate(over="ignore"):
                    node = common.mix64(tokens[:, _FIRST[tree]].astype(np.uint64) + np.uint64(tree << 40)).view(np.int64)
                columns = [pa.array(np.full(len(node), tree, np.int32)), pa.array(node), batch.column("rid"), batch.column("label"), batch.column("n"), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "rid", "label", "n", "sketch"])

    return run


def _branch(level: int):
    """Children of large nodes: BRANCHES coordinates that the node's name selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _rows(batch, "tokens", "<u4", COORDINATES)
            parent = np.asarray(batch.column("node"), dtype=np.int64).view(np.uint64)
            for k in range(BRANCHES):
                with np.errstate(over="ignore"):
                    seed = common.mix64(parent + np.uint64(level * BRANCHES + k + 1))
                    token = tokens[np.arange(len(tokens)), (seed % np.uint64(COORDINATES)).astype(np.int64)]
                    node = common.mix64(seed ^ token.astype(np.uint64)).view(np.int64)
                columns = [batch.column("tree"), pa.array(node), *(batch.column(c) for c in ("rid", "label", "n", "sketch"))]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "rid", "label", "n", "sketch"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, rid, label, n, bytes, tokens) with the sketch in place of the tokens."""
    for batch in batches:
        if batch.num_rows:
            sketch = [r.tobytes() for r in nibbles(_rows(batch, "tokens", "<u4", COORDINATES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "rid", "label", "n", "bytes")), pa.array(sketch, pa.binary())], ["cluster", "rid", "label", "n", "bytes", "sketch"])


def _near(threshold: float):
    """Rows (hub, hub_n, hub_sketch, rid, n, sketch): the pairs whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (np.asarray(batch.column(c), dtype=np.int64) for c in ("n", "hub_n"))
            close = estimate(_rows(batch, "sketch", "<u8", 8), _rows(batch, "hub_sketch", "<u8", 8)) >= threshold - SLACK
            keep = pa.array(close & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(keep), batch.column("rid").filter(keep)], ["a", "b"])

    return run


def _reach(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs (i, j) connect it with."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of whole nodes; rows arrive sorted by node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.asarray(batch.column("node"), dtype=np.int64)
        cut = int(np.searchsorted(node, node[-1]))
        if held and held[0].column("node")[0].as_py() != node[-1]:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _candidates(batch: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one node and different labels whose sizes and sketches allow a link."""
    node, label, n = (np.asarray(batch.column(c), dtype=np.int64) for c in ("node", "label", "n"))
    sketch = _rows(batch, "sketch", "<u8", 8)
    here, found = np.arange(len(node)), [(np.zeros(0, np.int64),) * 2]
    for gap in range(1, len(node)):
        here = here[here + gap < len(node)]
        here = here[node[here] == node[here + gap]]
        if not len(here):
            break
        there = here + gap
        fit = (label[here] != label[there]) & (np.minimum(n[here], n[there]) >= threshold * np.maximum(n[here], n[there]) - 1e-9)
        i, j = here[fit], there[fit]
        close = estimate(sketch[i], sketch[j]) >= threshold - SLACK
        found.append((i[close], j[close]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _exhaust(threshold: float):
    """Rows sorted by node: all pairs of a node in different components are tried on their sketches.

    Returns, for each set of rows that possible links connect, a star (a, b) instead of all its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_node(batches):
            i, j = _candidates(batch, threshold)
            least = _reach(batch.num_rows, i, j)
            moved = np.flatnonzero(least != np.arange(len(least)))
            if len(moved):
                rid = np.asarray(batch.column("rid"), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rid[least[moved]]), pa.array(rid[moved])], ["a", "b"])

    return run


def _active(threshold: float):
    """Rows sorted by node: those that a sketch allows a link within the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_node(batches):
            yield batch.take(pa.array(np.unique(np.concatenate(_candidates(batch, threshold)))))

    return run


def _settle(percent: int, width: int):
    """Rows (node, label, n, rid, sketch, text) sorted by node: links between components, on the full sets.

    Within a node, a pair that earlier links already connect is not needed.
    """

    def links_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        label, rid = (np.asarray(batch.column(c), dtype=np.int64) for c in ("label", "rid"))
        i, j = _candidates(batch, percent / 100)
        order = np.lexsort((j, i))
        i, j = i[order].tolist(), j[order].tolist()
        last = {x: k for k, pair in enumerate(zip(i, j, strict=True)) for x in pair}
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        def of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = checked_sets(batch.column("text").slice(x, 1), width)[0]
            return sets[x]

        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            a, b = find(int(label[x])), find(int(label[y]))
            if a != b and similar(of(x), of(y), percent):
                root[max(a, b)] = min(a, b)
                yield int(rid[x]), int(rid[y])
            for done in (x, y):
                if last[done] == k:
                    sets.pop(done, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("words")
        for batch in _by_node(batches):
            found = list(links_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])
        common.leave()

    return run


def meetings(rows: DataFrame, group: str, weight: Column) -> DataFrame:
    """``rows`` (group, rid, label, ...) dealt to nodes in which all pairs of different labels meet.

    ``weight`` is a row's share of a chunk. Groups of at most one chunk are one node. In larger ones, the rows
    of the heaviest label need not meet each other: their chunks meet the chunks of the others, which also
    meet among themselves. Groups of one label are left out.
    """
    counts = rows.groupBy(group, "label").agg(F.sum(weight).alias("k"))
    stats = counts.groupBy(group).agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    chunks = lambda w: F.greatest(F.lit(1), F.ceil(w)).cast("int")
    stats = stats.select(group, "size", F.col("top.label").alias("major"), chunks(F.col("top.k")).alias("chunks"), chunks(F.col("size") - F.col("top.k")).alias("others"))
    met = rows.join(stats, group)
    whole = F.col("size") <= 1
    major = F.col("label") == F.col("major")
    mine = F.pmod(F.xxhash64("rid", F.lit("deal")), F.when(major, F.col("chunks")).otherwise(F.col("others"))).cast("int")
    with_major = lambda c, o: F.xxhash64(F.col(group), F.lit("major"), c, o)
    among = lambda a, b: F.xxhash64(F.col(group), F.lit("others"), F.least(a, b), F.greatest(a, b))
    nodes = (
        F.when(whole, F.array(F.xxhash64(group)))
        .when(major, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: with_major(F.col("mine"), o)))
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: with_major(c, F.col("mine"))), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: among(F.col("mine"), o))
            )
        )
    )
    keep = [c for c in rows.columns if c != group]
    return met.withColumn("mine", F.when(~whole, mine)).withColumn("nodes", nodes).select(*keep, F.explode("nodes").alias("node"))


def _confirm(percent: int, width: int):
    """Rows (a, chunk, is_partner, b, text) in order: a hub's text (b is a), then those of its partners; pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("words")
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for lo, hi in common.slices(batch.column(4), 4 << 20):
                part = batch.slice(lo, hi - lo)
                a, b = [], []
                for x, is_partner, y, s in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), checked_sets(part.column(4), width), strict=True):
                    if not is_partner:
                        hub, own = x, s
                    elif x == hub and similar(own, s, percent):
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        common.leave()

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links among candidate ``pairs`` (a, b), compared on the full sets of the texts of ``docs``.

    A hub a meets its partners b in chunks of about PARTNERS, each of which has the hub's text once.
    """
    wanted = common.materialize(pairs.where("a < b").distinct(), "pairs")
    chunks = wanted.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks"))
    dealt = common.materialize(wanted.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk")), "dealt-pairs")
    hubs = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(False).alias("is_partner"), F.col("a").alias("doc_id"))
    ends = hubs.union(dealt.select("a", "chunk", F.lit(True), "b"))
    texts = docs.where("doc_id is not null and text is not null")
    met = ends.hint("merge").join(texts, "doc_id").select("a", "chunk", "is_partner", "doc_id", "text")
    sorted_ = met.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "is_partner")
    return common.materialize(sorted_.mapInArrow(_confirm(percent, width), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, label): each linked id with the smallest id it reaches, by alternating star contractions.

    Every round is written to the shared folder; groups are only ever reduced to a minimum.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = edges.union(turned) if large else edges
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = around.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    seen = None
    while True:
        edges = common.materialize(star(star(edges, True), False), "star")
        state = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        seen = state


def link(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each of ``docs`` (doc_id, text).

    Documents are linked at a Jaccard similarity of ``percent`` / 100 of their distinct ``width``-word
    shingles (A-Z folded). Null and empty texts have no shingles and stay alone; so do rows with null
    doc_id, which are kept under a null component. Equal sets are one node of the join; rows of equal
    doc_id are one document, whatever their texts.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    described = common.materialize(docs.mapInArrow(_describe(width), "doc_id long, n_shingles long, set_key binary, tokens binary, bytes long"), "sets")
    grouped = described.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rid"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.max("bytes").alias("bytes"))
    reps = common.materialize(grouped, "representatives")
    parts = max(spark.sparkContext.defaultParallelism, TREES * reps.count() // ROWS_PER_TASK)

    # First pass: stars around each node's smallest document.
    planted = reps.select("rid", F.col("rid").alias("label"), "n", "tokens").mapInArrow(_plant(HUB_TREES), _NODE)
    hubs = planted.groupBy("node").agg(F.min(F.struct("rid", "n", "sketch")).alias("h"), F.count("*").alias("size")).where("size > 1")
    hubs = hubs.select("node", F.col("h.rid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.sketch").alias("hub_sketch"))
    stars = planted.join(hubs, "node").where("rid <> hub").select("hub", "hub_n", "hub_sketch", "rid", "n", "sketch")
    links = confirmed(stars.mapInArrow(_near(threshold), "a long, b long"), docs, percent, width)
    labels = components(links)

    # Second pass: nodes with several components, down to exhaustive comparison.
    marked = common.materialize(reps.join(labels.withColumnRenamed("id", "rid"), "rid", "left").select("rid", F.coalesce("label", "rid").alias("label"), "n", "tokens", "bytes"), "labelled")
    nodes = marked.mapInArrow(_plant(TREES), _NODE)
    found = None
    for level in range(LEVELS):
        nodes = common.materialize(nodes, "nodes")
        last = level == LEVELS - 1
        tops = nodes.groupBy("node", "label").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum("k").alias("size"), F.max("k").alias("k"))
        crowded = common.materialize(tops.where((F.col("size") - F.col("k") > MANY) & F.lit(not last)).select("node"), "crowded")
        few = meetings(nodes.join(crowded, "node", "left_anti").select("node", "label", "n", "rid", "sketch").withColumnRenamed("node", "group"), "group", F.lit(1 / SMALL))
        stars_ = few.select("node", "label", "n", "rid", "sketch").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_exhaust(threshold), "a long, b long")
        found = stars_ if found is None else found.union(stars_)
        if last or crowded.isEmpty():
            break
        nodes = nodes.join(crowded, "node", "left_semi").join(marked.select("rid", "tokens"), "rid").mapInArrow(_branch(level), _NODE)

    # What possible links connect meets once more, now with its texts.
    clusters = components(found)
    members = clusters.select(F.col("id").alias("rid"), F.col("label").alias("cluster")).union(clusters.select("label", "label").distinct())
    described_members = members.join(marked, "rid").mapInArrow(_sketched, "cluster long, rid long, label long, n long, bytes long, sketch binary")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("rid"), "text")
    load = F.greatest(F.lit(1 / SMALL), F.col("bytes") / NODE_BYTES)
    columns = ["node", "label", "n", "rid", "sketch"]
    met = meetings(described_members, "cluster", load).select(*columns).repartition(parts, "node").sortWithinPartitions("node")
    wanted = common.materialize(met.mapInArrow(_active(threshold), "node long, label long, n long, rid long, sketch binary"), "text-nodes")
    dealt = wanted.hint("merge").join(texts, "rid").select(*columns, "text")
    settled = dealt.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_settle(percent, width), "a long, b long")
    more = common.materialize(settled.distinct(), "links")
    final = components(links.union(more)).withColumnRenamed("id", "rid")
    by_set = reps.select("set_key", "rid").join(final, "rid", "left").select("set_key", F.coalesce("label", "rid").alias("component_id"))
    joined = described.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together.
    """
    plain = common.documents(docs)
    gone = link(plain, percent, width).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.withColumn("__gone", F.col("doc_id").cast("long")).join(gone, "__gone", "left_anti").drop("__gone")


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of all ``documents`` whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return link(common.documents(common.table(spark, sf_dir, "documents")), 80, 2)
