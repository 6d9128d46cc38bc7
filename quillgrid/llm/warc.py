"""WARC archives through Spark's text writer, and a capture index by external loser-tree merging.

A record is one gzip member, written as one "line" whose separator is an empty gzip member. So archives are
committed like any Spark output and are plain record-wise compressed WARC files: each begins with a warcinfo
record, and a record can be read from its offset alone. Payloads are HTTP responses; copies are revisit
records.

The index is built by an external merge. Each archive gives one locally sorted run of captures, stored in
chunks. Runs are cut at sampled splitters into key ranges (a long history of one URL may span ranges), and
in each range loser trees merge ``FAN_IN`` runs at a time, in as many passes as it takes, until one ordered
history is left. Spark orders chunks by their first key only; a merge holds about one chunk of each run.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DEDUP_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
CHUNK_ROWS = 1024
FAN_IN = 64
#: Captures of a key range, the most ranges (beyond that, ranges grow), and how many chunk keys are looked at for the splitters.
ROWS_PER_RANGE = 50_000
MAX_RANGES = 4096
SPLIT_SAMPLE = 65_536
#: Letters of a key that a splitter has at most.
SPLIT_LETTERS = 1024


def url_key(url: str | None) -> str:
    """Sort key of a URL: host names reversed and joined by commas, then the path and query, lower-cased."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return ")" + re.sub(r"\s+", "%20", url.lower())
    host = re.sub(r"^www\d*\.", "", host)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + path.lower()


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, so a step costs one path to the root.

    A run may be out of items for now: it loses all matches until ``refill`` plays it in again.
    """

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.k = list(runs), key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(self.runs))] or [None]
        self.losers = [0] * self.k
        self.winner = self._play(1)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def refill(self, i: int, run: Iterator) -> None:
        """Run ``i`` has more items (greater ones); it plays again if it was out."""
        self.runs[i] = run
        if self.heads[i] is None:
            self.heads[i] = self._next(i)
            self.winner = self._play(1)

    def head(self):
        """The key of the next item, or None."""
        found = self.heads[self.winner]
        return None if found is None else found[0]

    def pop(self):
        i = self.winner
        item = self.heads[i][2]
        self.heads[i] = self._next(i)
        node = (i + self.k) // 2
        while node:
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i
        return item

    def __iter__(self) -> Iterator:
        while self.head() is not None:
            yield self.pop()


def record_id(page_id: Column, otherwise: Column) -> Column:
    """A UUID (version 8) that holds the page_id; rows without one get ``otherwise`` (16 hex digits) and another ending."""
    digits = F.lower(F.coalesce(F.lpad(F.hex(page_id), 16, "0"), otherwise))
    part = lambda a, n: F.substring(digits, a, n)
    end = F.when(page_id.isNull(), "00-ffffffffffff").otherwise("00-000000000000")
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), end, F.lit(">"))


def page_of(record: Column) -> Column:
    """The page_id that a record id holds, or null."""
    form = r"^<urn:uuid:(.{8})-(.{4})-8(.{3})-8(.)00-0{12}>$"
    digits = F.concat(*[F.regexp_extract(record, form, i) for i in range(1, 5)])
    return F.when(record.rlike(form), F.conv(digits, 16, -10).cast("long"))


def records(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """The WARC record of each of ``pages`` (page_id, url, html, date) as text.

    Of equal payloads of at least ``dedup_bytes`` the largest page_id is the response and the others
    revisit it (equal: same length, SHA-1 and SHA-256). Null html is an empty payload, null url an empty target.
    A null date leaves the WARC-Date header out; the index then has a null date, before the others of its URL.
    Other columns are not looked at.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    data = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "date", body.alias("body"))
    data = data.withColumn("size", F.octet_length("body").cast("long")).withColumn("sha1", F.sha1("body"))
    long = F.col("size") >= dedup_bytes
    keyed = data.withColumn("same", F.when(long, F.concat_ws("-", "size", "sha1", F.sha2("body", 256))))
    groups = keyed.where("same is not null and page_id is not null").groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    groups = common.materialize(groups.where("copies > 1").select("same", "first"), "copies")
    marked = keyed.join(groups, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    spare = F.substring(F.sha2(F.concat_ws("|", "url", F.col("date").cast("string"), "sha1"), 256), 1, 16)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), spare)),
        F.coalesce(line("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("first"), spare)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("body")), F.lit("\r\n\r\n")).alias("value"))


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=6, mtime=0)


#: An empty gzip member, with Latin-1 letters for its bytes: what stands between records.
_BETWEEN = _member(b"").decode("latin-1")
_INFO = b"software: capture tables\r\nformat: WARC File Format 1.1\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, after one that describes the archive."""
    begun = False
    for batch in batches:
        texts = batch.column(0)
        if not begun and len(texts):
            name = hashlib.sha256(str(texts[0]).encode("utf-8", "replace")).hexdigest()
            uuid = f"{name[:8]}-{name[8:12]}-8{name[12:15]}-8{name[15:18]}-{name[18:30]}"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(_INFO)}\r\n\r\n"
            yield pa.RecordBatch.from_arrays([pa.array([_member(head.encode() + _INFO + b"\r\n\r\n")], pa.binary())], ["data"])
            begun = True
        yield pa.RecordBatch.from_arrays([pa.array([_member(x.as_buffer().to_pybytes()) for x in texts], pa.binary())], ["data"])


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the records to record-wise gzipped WARC files of about ``archive_bytes`` of payload; returns their folder."""
    path = common.shared_dir(pages.sparkSession, "warc")
    common.settle(pages.sparkSession)
    size = pages.select(F.sum(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))))).first()[0] or 0
    parts = max(1, size // archive_bytes)
    made = records(pages).repartition(parts, F.xxhash64("value")).mapInArrow(_members, "data binary")
    made.select(F.col("data").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _BETWEEN).text(path)
    return path


def read_record(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, compressed length) of the record at ``offset`` of an archive; nothing before it is needed."""
    inflate = zlib.decompressobj(31)
    raw = inflate.decompress(data[offset:]) if offset else inflate.decompress(data)
    return *parse_record(raw), len(data) - offset - len(inflate.unused_data)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    stop = raw.index(b"\r\n\r\n")
    head = raw[:stop].decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head[1:])
    return fields, raw[stop + 4 : stop + 4 + int(fields["Content-Length"])]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(headers, offset, block) of each record of an archive, empty members aside."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, raw, fed = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if fed >= len(data):
                raise ValueError(f"archive ends within the record at {at}")
            raw.append(inflate.decompress(view[fed : fed + 65_536]))
            fed = min(fed + 65_536, len(data))
        if whole := b"".join(raw):
            fields, block = parse_record(whole)
            yield fields, at, block
        at = fed - len(inflate.unused_data)


_CAPTURE = "url_key string, date string, record_id string, url string, record_type string, digest string, payload_bytes long, refers_to string, archive string, offset long"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


_ARROW = pa.schema([(n, pa.int64() if n in ("payload_bytes", "offset") else pa.string()) for n in _NAMES])
#: A chunk of a run: the run, the key of its first capture, its captures.
_CHUNK = "run long, k0 string, k1 string, k2 int, k3 string, n int, data binary"
_KEYS = ["k0", "k1", "k2", "k3"]


def _order(row: tuple) -> tuple:
    return row[0], row[1] or "", len(row[2]), row[2]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _pack(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(_table(rows))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(data).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def _sized(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _chunk_rows(chunks: Iterator[tuple[tuple, list[tuple]]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (keys of the caller, first key, n, data), a few at a time."""
    for lead, rows in chunks:
        row = [*lead, *_order(rows[0]), len(rows), _pack(rows)]
        kinds_ = [*kinds, pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds_, strict=True)], [*names, *_KEYS, "n", "data"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures in order, in chunks; payloads are checked against their digests."""
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            run = []
            for fields, at, block in parse_archive(data.as_py()):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:").lower()
                if fields["WARC-Type"] == "response" and hashlib.sha1(block[block.index(b"\r\n\r\n") + 4 :]).hexdigest() != digest:
                    raise ValueError(f"damaged record at {at} of {path}")
                url = fields["WARC-Target-URI"]
                run.append((url_key(url), fields.get("WARC-Date"), fields["WARC-Record-ID"], url, fields["WARC-Type"], digest, int(fields["X-Payload-Length"]), fields.get("WARC-Refers-To"), path, at))
            run.sort(key=_order)
            name = int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "little", signed=True)
            yield from _chunk_rows((((name,), rows) for rows in _sized(iter(run), CHUNK_ROWS)), ["run"], [pa.int64()])


def _cut(splitters: list[tuple]):
    """Chunks cut at the splitters: range i has the keys from splitter i - 1 on to before splitter i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_, data in zip(batch.column("run").to_pylist(), batch.column("data").to_pylist(), strict=True):
                pieces: dict[int, list[tuple]] = {}
                for row in _unpack(data):
                    pieces.setdefault(bisect.bisect_right(splitters, _order(row)), []).append(row)
                yield from _chunk_rows((((r, run_), rows) for r, rows in pieces.items()), ["range", "run"], [pa.int32(), pa.int64()])

    return run


def _merged(chunks: Iterator[tuple[int, tuple, bytes]]) -> Iterator[tuple]:
    """The captures of chunks (run, first key, data), which arrive by first key: one loser tree over their runs.

    Whatever comes before the first key of the next chunk to arrive can go out, so each run waits with the
    rest of one chunk, or more only where its chunks share their first key with others.
    """
    places: dict[int, int] = {}
    waiting: list[deque] = []
    tree: LoserTree | None = None

    def stream(i: int) -> Iterator[tuple]:
        while waiting[i]:
            yield from _unpack(waiting[i].popleft())

    for run, first, data in chunks:
        while tree is not None and (head := tree.head()) is not None and head < first:
            yield tree.pop()
        if run in places:
            i = places[run]
            waiting[i].append(data)
            if tree.heads[i] is None:
                tree.refill(i, stream(i))
        else:
            places[run] = len(waiting)
            waiting.append(deque([data]))
            grown = LoserTree([], _order)
            grown.runs = [*(tree.runs if tree else []), stream(len(waiting) - 1)]
            grown.k = len(grown.runs)
            grown.heads = [*(tree.heads if tree else [])]
            grown.heads.append(grown._next(len(grown.runs) - 1))
            grown.losers = [0] * grown.k
            grown.winner = grown._play(1)
            tree = grown
    if tree is not None:
        yield from tree


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[int, tuple, bytes]]]]:
    """Runs of rows that agree in ``names``: their values, and their chunks one by one."""
    rows = (
        (key, (run, first, data))
        for batch in batches
        for key, run, first, data in zip(
            zip(*(batch.column(c).to_pylist() for c in names), strict=True), batch.column("run").to_pylist(), zip(*(batch.column(k).to_pylist() for k in _KEYS), strict=True), batch.column("data").to_pylist(), strict=True
        )
    )
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def chunks() -> Iterator[tuple[int, tuple, bytes]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:  # noqa: B023
                yield ahead[1]
                ahead = next(rows, None)

        yield key, chunks()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass: the runs of each (range, group) become one run."""
    for (range_, group), chunks in _groups(batches, ["range", "group"]):
        yield from _chunk_rows((((range_, group), rows) for rows in _sized(_merged(chunks), CHUNK_ROWS)), ["range", "run"], [pa.int32(), pa.int64()])


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last pass: the captures of each range in order, with their range and place in it."""
    for (range_,), chunks in _groups(batches, ["range"]):
        inner = 0
        for rows in _sized(_merged(chunks), 4 * CHUNK_ROWS):
            table = _table(rows)
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array([range_] * len(rows), pa.int32()), pa.array(range(inner, inner + len(rows)), pa.int64())], [*_NAMES, "range", "inner"])
            inner += len(rows)


def _splitters(runs: DataFrame, total: int, rows_per_range: int) -> list[tuple]:
    """Keys that cut all captures into about equal ranges, from at most SPLIT_SAMPLE first keys of chunks."""
    ranges = min(MAX_RANGES, -(-total // rows_per_range))
    if ranges < 2:
        return []
    share = min(1.0, SPLIT_SAMPLE / 2 / max(1, total // CHUNK_ROWS + 1))
    keys = runs.select(F.substring("k0", 1, SPLIT_LETTERS).alias("k0"), "k1", "k2", F.substring("k3", 1, SPLIT_LETTERS).alias("k3"), F.xxhash64("run", *_KEYS).alias("h"))
    some = sorted(tuple(r)[:4] for r in keys.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).limit(SPLIT_SAMPLE).collect())
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def read_index(spark, path: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The capture histories of all archives in ``path``, globally ordered by url_key, date and record id, with their place in that order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = common.materialize(files.mapInArrow(_runs, _CHUNK), "runs")
    total, archives = runs.select(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("run")).first()
    splitters = _splitters(runs, total, rows_per_range)
    ranges = len(splitters) + 1
    runs = common.materialize(runs.mapInArrow(_cut(splitters), f"range int, {_CHUNK}"), "segments")
    while archives > FAN_IN:
        groups = -(-archives // FAN_IN)
        dealt = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        runs = common.materialize(dealt.repartition("range", "group").sortWithinPartitions("range", "group", *_KEYS).mapInArrow(_merge_runs, f"range int, {_CHUNK}"), "merged-runs")
        archives = groups
    held = runs.groupBy("range").agg(F.sum("n").alias("held"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("range", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    ordered = runs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", *_KEYS)
    found = ordered.mapInArrow(_histories, f"{_CAPTURE}, range int, inner long")
    return found.join(F.broadcast(base), "range").select(*_NAMES, (F.col("base") + F.col("inner") + 1).alias("place"))


def op8_warc_index(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to WARC archives and read back through the merged capture index, in its order (``place``)."""
    pages = common.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    pages = pages.withColumn("date", F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce("page_id", F.lit(0))))
    index = read_index(spark, write_archives(pages))
    return index.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"), "url_key", "place")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[0-9]*[.]', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '^([?]|$)', '/') AS path,
    regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1) AS port
  FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS first,
    array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || lower(path) AS url_key FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) AS place
FROM g
"""
