"""WARC archives and their index by external merge.

``write_archives`` writes one WARC/1.1 record per page, each a gzip member of its own, so
that offset and length in the index fetch a record alone. Archives are filled up to
``ARCHIVE_BYTES`` in the task and written by Spark's own writer, so any store that Spark
can write will do. Of pages with equal payloads of at least 1000 bytes, that with the
largest id is stored as a response; the others become revisits without a payload.

``read_archives`` parses the archives back record by record, checks each digest and sorts
the captures of each archive: a run, cut into blocks of ``BLOCK`` captures.
``merge_captures`` takes range bounds from the blocks' first keys, cuts blocks at the
bounds and sends each range its blocks, ordered by first key. A task then opens blocks
only when the merge comes to their first key and merges the open ones with a loser tree:
it holds a block of each overlapping run and not the range. Partitions in order give
every URL's capture history.

A capture's time is the column that the caller names, else the crawl's: ``FIRST`` and a
second for each id, within a year.

Edge cases: null html is an empty payload; a null url has no target and sorts first;
very long payloads are one record of any size in an archive of its own size; captures
that tie in key and time are ordered by id, archive and offset; rows that repeat an id
and payload that wins are all responses; ids may be any long, null ids lose against any
other; empty tables give an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import arrow_types
from facetry.llm.urlfilter import split_url
from facetry.session import drop_folder, settled, shared_folder, ship

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes from which an archive is closed, and how hard records are compressed.
ARCHIVE_BYTES, LEVEL = 16 << 20, 4
#: Groups of equal payloads that are broadcast at most (a digest and an id each), and
#: beyond that the parts of a group in the join with its winner.
BROADCAST_ROWS, SALTS = 500_000, 32
#: Captures of a block, and of a range at about.
BLOCK, RANGE = 4096, 1 << 20
#: First keys of blocks, for each range, that bounds are taken from.
SAMPLE = 20

FIRST, YEAR = 1_704_067_200, 31_536_000  # 2024-01-01, and seconds of 365 days
INDEX_SCHEMA = "run string, url_key string, captured long, page_id long, record_offset long, record_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: What captures are ordered by.
ORDER = ("url_key", "captured", "page_id", "run", "record_offset")


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels from the right, then path and query."""
    if not url:
        return ""
    host, _ = split_url(url)
    rest = url.partition("://")[2][len(host) :] if "://" in url else url
    name, _, port = host.partition(":")
    return ",".join(reversed(name.removeprefix("www.").split("."))) + (":" + port if port else "") + ")" + (rest.partition("#")[0] or "/")


def captured_by_id() -> Column:
    """Seconds of the capture where the pages have no time: within a year, by id."""
    return F.lit(FIRST) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(YEAR))


def record_types(pages: DataFrame, captured: Column | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pages with ``digest``, ``n_bytes``, ``captured`` (seconds), ``record_type`` and
    ``refers_to``.

    Groups of equal payloads are counted and their winner found by partial
    aggregation; only those of more than one row are joined back: broadcast while they
    are at most ``broadcast_rows``, beyond that by a shuffle of the pages, salted."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    when = (captured_by_id() if captured is None else captured).cast("long").alias("captured")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"), when)
    large = rows.filter(F.col("n_bytes") >= REVISIT_BYTES)
    groups = settled(large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "winner"))
    if groups.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(groups.select("digest", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["digest", "salt"], "left")
    revisits = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select(
        "page_id", "url", "html", "digest", "n_bytes", "captured", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("winner")).alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, captured: int, kind: str, refers_to: int | None) -> bytes:
    """A WARC record, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if url is not None:
        safe = "".join(c if "\x20" < c != "\x7f" else "%20" for c in url.replace("%", "%25"))
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Date: {datetime.fromtimestamp(captured, timezone.utc):%Y-%m-%dT%H:%M:%SZ}")
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """A gzip member. It ends with its length, little-endian in 32 bits, so with a zero
    byte as long as that is below 16 MB; a longer one is followed by a zero byte, which
    readers of gzip skip as padding."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    made = packer.compress(raw) + packer.flush()
    return made if made[-1] == 0 else made + b"\0"


def write_archives(pages: DataFrame, folder: str, captured: Column | None = None) -> None:
    """Write the pages' archives into ``folder``; ``captured`` gives seconds since 1970."""
    ship(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, room = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for page_id, url, html, digest, when, kind, winner in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    members.append(_member(record(page_id, url, html, digest, when, kind, winner)))
                    room += len(members[-1])
                    if room >= ARCHIVE_BYTES:
                        yield closed(members)
                        members, room = [], 0
        if members:
            yield closed(members)

    def closed(members: list[bytes]) -> pa.RecordBatch:
        # the writer ends each line, so each archive, with the zero byte left out here
        return pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(members)[:-1]], pa.binary())})

    typed = record_types(pages, captured).select("page_id", "url", F.encode("html", "UTF-8").alias("html"), "digest", "captured", "record_type", "refers_to")
    lines = typed.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def _fields(raw: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name else None


def members(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, bytes, record)`` of an archive's gzip members, one at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if view[at] == 0:  # padding
            at += 1
            continue
        reader = zlib.decompressobj(31)
        made, fed = [], at
        while not reader.eof:
            if fed >= len(view):
                raise ValueError(f"the archive ends inside the record at {at}")
            made.append(reader.decompress(view[fed : fed + (1 << 16)]))
            fed += 1 << 16
        end = min(fed, len(view)) - len(reader.unused_data)
        yield at, end - at, b"".join(made)
        at = end


def fetch(archive: bytes, offset: int, size: int) -> tuple[dict[str, str], bytes]:
    """The fields and the payload of the record that the index names."""
    raw = zlib.decompress(archive[offset : offset + size], 31)
    head = raw.index(b"\r\n\r\n")
    fields = _fields(raw[:head])
    block = raw[head + 4 : head + 4 + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def parse_archive(run: str, archive: bytes) -> list[tuple]:
    """The captures of an archive, sorted by URL key, time and id. Raises
    ``ValueError`` for a record whose payload doesn't match its digest."""
    out = []
    for at, size, raw in members(archive):
        ends = raw.index(b"\r\n\r\n")
        fields = _fields(raw[:ends])
        block = memoryview(raw)[ends + 4 : ends + 4 + int(fields["content-length"])]
        cut = raw.index(b"\r\n\r\n", ends + 4) - ends - 4
        n_bytes = int(_fields(bytes(block[:cut]))["content-length"])
        payload, digest = block[cut + 4 :], fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged record at {at} of {run}")
        captured = int(datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
        target = fields.get("warc-target-uri")
        url = target.replace("%25", "%") if target else None
        out.append((run, url_key(url), captured, _page(fields.get("warc-record-id")), at, size, n_bytes, digest, fields["warc-type"], _page(fields.get("warc-refers-to"))))
    return sorted(out, key=_order)


def _order(row: tuple) -> tuple:
    return (row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[4])


_BLOCKS = "url_key string, captured long, page_id long, run string, record_offset long, n long, captures binary"


def _packed(rows: list[tuple], types: pa.Schema) -> tuple:
    """A block: its first capture's order, its size and its captures as Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, types) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types))
    first = rows[0]
    return (first[1], first[2], first[3], first[0], first[4], len(rows), sink.getvalue().to_pybytes())


def _unpacked(raw: bytes) -> list[tuple]:
    with pa.ipc.open_stream(raw) as reader:
        return list(zip(*(c.to_pylist() for c in reader.read_all().columns), strict=True))


def read_archives(spark, folder: str) -> DataFrame:
    """The sorted runs of all archives below ``folder`` as blocks: what orders the first
    capture of each, its size and its captures."""
    ship(spark)
    files = spark.read.format("binaryFile").load(f"{folder}/part-*").select("path", "content")
    types, own = arrow_types(files, _BLOCKS), arrow_types(files, INDEX_SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = parse_archive(batch.column(0)[k].as_py().rpartition("/")[2], batch.column(1)[k].as_py())
                for at in range(0, len(rows), BLOCK):
                    yield _as_batch([_packed(rows[at : at + BLOCK], own)], types)

    return files.mapInArrow(work, _BLOCKS)


def _as_batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so a new head replays
    only the path from its leaf to the root."""

    def __init__(self, runs: list[Iterable], key: Callable) -> None:
        self.runs, self.key = [iter(x) for x in runs], key
        self.k = len(runs)
        self.heads: list = [next(x, None) for x in self.runs]
        self.keys: list = [key(x) if x is not None else None for x in self.heads]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, first=True)

    def _less(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int, first: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if first and other < 0:
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def until(self, limit) -> Iterator:
        """What comes before ``limit`` (None: all) in order."""
        while self.k and self.heads[winner := self.losers[0]] is not None and (limit is None or self.keys[winner] < limit):
            yield self.heads[winner]
            head = self.heads[winner] = next(self.runs[winner], None)
            self.keys[winner] = self.key(head) if head is not None else None
            self._play(winner)

    def __iter__(self) -> Iterator:
        return self.until(None)

    def open_runs(self) -> list[Iterator]:
        """The runs that have something left, heads first."""
        return [chain([head], run) for head, run in zip(self.heads, self.runs, strict=True) if head is not None]


def merged(blocks: Iterator[tuple], key: Callable = _order, unpack: Callable = _unpacked) -> Iterator[tuple]:
    """The captures of ``(first key, raw block)`` pairs, which come in the order of first
    keys. Blocks are opened when the merge comes to their first key, a few at a time so
    that the tree isn't made anew for each; it holds the open ones only."""
    tree, ahead = LoserTree([], key), next(blocks, None)
    while ahead is not None:
        runs = tree.open_runs()
        for _ in range(max(1, len(runs) // 4)):
            runs.append(iter(unpack(ahead[1])))
            ahead = next(blocks, None)
            if ahead is None:
                break
        tree = LoserTree(runs, key)
        yield from tree.until(ahead and ahead[0])
    yield from tree


def range_bounds(blocks: DataFrame, captures: int = RANGE) -> list[tuple]:
    """Orders that part the captures in ranges of some ``captures`` (smaller ones where
    the session's tasks would have none), from a sample of first keys: about ``SAMPLE``
    for each range, and a bound for each."""
    found = blocks.agg(F.count("*"), F.sum("n")).first()
    total, tasks = found[1] or 0, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-total // captures), min(tasks, total // BLOCK))
    if ranges < 2:
        return []
    every = max(1, found[0] // (SAMPLE * ranges))
    some = blocks.select(*ORDER).filter(F.pmod(F.xxhash64("run", "record_offset"), F.lit(every)) == 0)
    keys = sorted((r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0, r["run"], r["record_offset"]) for r in some.collect())  # SAMPLE keys a range
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def merge_captures(blocks: DataFrame, captures: int = RANGE) -> DataFrame:
    """The index in global order of (URL key, time, id), ranges as partitions. ``blocks``
    are those of ``read_archives``, stored."""
    spark = blocks.sparkSession
    ship(spark)
    bounds = range_bounds(blocks, captures)
    schema = f"place int, {_BLOCKS}"
    cut_types, types = arrow_types(blocks, schema), arrow_types(blocks, INDEX_SCHEMA)
    held = spark.sparkContext.broadcast(bounds)  # a bound for each range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = held.value
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _unpacked(row[-1])
                # a bound belongs to the range that it starts
                first, last = bisect_right(limits, _order(rows[0])), bisect_right(limits, _order(rows[-1]))
                steps = [0, *(bisect_left(rows, x, key=_order) for x in limits[first:last]), len(rows)]
                for place, (a, b) in enumerate(pairwise(steps), first):
                    if a < b:
                        yield _as_batch([(place, *(row if b - a == len(rows) else _packed(rows[a:b], types)))], cut_types)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in merged(opened(batches)):
            out.append(row)
            if len(out) == BLOCK:
                yield _as_batch(out, types)
                out = []
        if out:
            yield _as_batch(out, types)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                url, when, page, run, offset = (batch.column(c)[k].as_py() for c in ORDER)
                yield (url, when, page is not None, page or 0, run, offset), batch.column("captures")[k].as_py()

    dealt = blocks.mapInArrow(cut, schema).repartitionById(len(bounds) + 1, "place").sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(merge, INDEX_SCHEMA)


def capture_numbers(index: DataFrame) -> DataFrame:
    """Each capture's place in its URL's history, from 1."""
    by_time = Window.partitionBy("url_key").orderBy("captured", "page_id", "run", "record_offset")
    return index.withColumn("capture", F.row_number().over(by_time))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back and merge their runs. The archives go
    once the runs are stored in the shared folder, or when that fails."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    try:
        write_archives(pages, folder)
        runs = settled(read_archives(spark, folder))
    finally:
        drop_folder(spark, folder)
    return merge_captures(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
