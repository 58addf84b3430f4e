"""N-gram Jaccard join by a token-group matrix.

Documents are sets of shingles of ``size`` words; two link when their Jaccard similarity
is at least ``similarity``, a fraction ``(numerator, denominator)``. The join is exact:

1. A counting sketch of all shingles gives one global order, rare shingles first. Two
   sets that link share one of their first ``n - ceil(t n) + 1`` shingles in any order.
2. Equal sets are one entry. Entries with an equal minimum hash and like sizes name a
   leader, and those that link with it follow it. So a family of near copies, however
   large, is told by a comparison or a few for each member, and nothing compares its
   members with each other again.
3. Entries are partitioned into groups of at most about ``GROUP_SIZE`` members and
   ``GROUP_SHINGLES`` shingles: families by themselves, all others by their commonest
   shingle and a band of sizes; what is larger is split by a hash of the set.
4. The token-group matrix holds, per leading shingle, the groups it occurs in and their
   sizes. An entry asks its leading shingles for groups that can hold a partner of another
   family; a family asks as a whole and is a single row of the matrix.
5. Each group's union of tokens is stored as a histogram, of some bytes per shingle. It
   bounds the overlap of any query with any member: families whose unions can't overlap
   enough are not asked further, and a query opens only groups whose union, and then some
   member's own histogram, reaches the overlap that a link needs. Only such queries and
   members bring their texts.
6. In an open group, the query's overlap with the exact union of the members' shingles is
   one more bound; then exact overlaps with all members follow. Only a spanning forest of
   the links leaves the task, so a group of copies never makes all pairs.
7. Components of the forest are found by large-star and small-star rounds.

A text is hashed by arrays: words by a polynomial over bytes, shingles by mixing the
hashes of their words, all 64 bits.

Edge cases: null and empty texts and those without words have no shingles and link with
nothing; texts of fewer words than a shingle are one shingle; very long texts are hashed
whole, some MB at a time; shingles that tie in frequency are ordered by their hash, and of
leaders that tie the greatest fingerprint counts; repeated rows are in one component; rows without an
id get the component of their copies and partners; empty tables give empty results;
further columns are ignored (``keep_one`` passes them on).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import arrow_types, giving_back, small_batches
from facetry.session import settled, ship

#: Words of a shingle and least similarity (numerator, denominator) unless the caller says.
SHINGLE, SIMILARITY = 3, (90, 100)
#: Counters of the sketch are 2 to this power.
SKETCH_BITS = 20
#: Members of a group and their shingles, and queries that one task takes to a group, at
#: about most.
GROUP_SIZE, GROUP_SHINGLES, QUERY_SIZE = 1024, 1 << 22, 4096
#: Minimum hashes by which near copies find a leader; more leave less to the matrix.
HASHES = 4
#: Rows of a side that is broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows of a token in the matrix that one task reads, at about most, and the parts that
#: those of a commoner one are dealt to.
TOKEN_ROWS, TOKEN_PARTS = 1 << 17, 64
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x5851F42D4C957F2D | 1
_POWERS: list[np.ndarray] = []
_FACTORS = [0x9FB21C651E98DF25, 0xC6A4A7935BD1E995, 0x2545F4914F6CDD1D]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[np.frombuffer(_SPACES, np.uint8)] = 0
#: Odd factors that give each minimum hash an order of its own.
_SEEDS = _mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[np.frombuffer(_SPACES, np.uint8)] = True


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _factors(size: int) -> np.ndarray:
    """An odd factor for each word of a shingle."""
    more = _mix(np.arange(len(_FACTORS), max(size, len(_FACTORS)), dtype=np.uint64) + np.uint64(_BASE)) | np.uint64(1)
    return np.concatenate([np.array(_FACTORS, np.uint64), more])[:size]


def shingles(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles of ``size`` words, ascending."""
    out: list[np.ndarray] = []
    raw = [x.encode("utf-8", "surrogatepass").translate(_LOWER) for x in texts]
    at = 0
    while at < len(raw):
        end, room = at, 0
        while end < len(raw) and (end == at or room + len(raw[end]) < CHUNK):
            room += len(raw[end]) + 1
            end += 1
        out += _shingles(raw[at:end], size)
        at = end
    return out


def _shingles(raw: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(raw)
    up, down = _powers(max(CHUNK, len(data)))
    words = _mix(np.add.reduceat(_BYTES[data] * up[: len(data)], starts) * down[starts])
    ends = np.cumsum([len(x) + 1 for x in raw])
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    factors, runs = _factors(size), np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(runs) else 0):
        runs += words[k : k + len(runs)] * factors[k]
    runs = _mix(runs)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = words[a:b] * factors[: b - a]
            out.append(_mix(np.array([whole.sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(a: int, b: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """The shingles that sets of these sizes share at least when they link."""
    return -(-similarity[0] * (a + b) // sum(similarity))


def linked(a: int, b: int, shared: int, similarity: tuple[int, int] = SIMILARITY) -> bool:
    return similarity[1] * shared >= similarity[0] * (a + b - shared)


def _text_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def levels(documents: DataFrame, size: int) -> np.ndarray:
    """For each counter of the sketch, how common its shingles are: six times the binary
    logarithm of the documents counted there."""
    ship(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in _text_slices(batches):
            for found in shingles([x or "" for x in batch.column(0).to_pylist()], size):
                np.add.at(total, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                raw = zlib.decompress(raw)
                total += np.frombuffer(raw, np.uint32 if len(raw) == 4 << SKETCH_BITS else np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], ["counts"])

    counted = documents.select("text").mapInArrow(giving_back(count), "counts binary")
    total = np.zeros(1 << SKETCH_BITS, np.uint64)
    for row in counted.repartition(8).mapInArrow(giving_back(add), "counts binary").collect():  # 8 rows of at most 8 MB
        total += np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    return (6 * np.log2(total + 1.0)).astype(np.uint8)


def histogram(found: np.ndarray) -> bytes:
    """Shingles by ranges of their hash, about four a range: for any two sets the sum of
    the ranges' minima is at least what they share."""
    bits = min(16, max(5, (len(found) // 4).bit_length()))
    return np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2").tobytes()


def folded(ranges: np.ndarray, size: int) -> np.ndarray:
    """Histograms (the last axis) with ``size`` ranges."""
    return ranges if ranges.shape[-1] == size else ranges.reshape(*ranges.shape[:-1], size, -1).sum(-1)


SIGNATURES = "doc_id long, n long, fp binary, common long, usual double, lows array<long>, lead array<long>, ranges binary"


def signatures(documents: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Size, fingerprint, commonest shingle, how common its shingles are at the mean,
    minimum hashes, leading shingles and histogram of every document's set; all but the size
    are null for empty sets."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(levels(documents, size))
    types = arrow_types(documents, SIGNATURES)
    numerator, denominator = similarity

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for batch in _text_slices(batches):
            rows = []
            for found in shingles([x or "" for x in batch.column(1).to_pylist()], size):
                n = len(found)
                if not n:
                    rows.append((0, None, None, None, None, None, None))
                    continue
                rank = level[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = n - -(-numerator * n // denominator) + 1
                order = np.argsort(rank, kind="stable")  # ties by hash, as the set ascends
                common = found[np.flatnonzero(rank == rank.max())[0]]
                rows.append((n, blake2b(found.tobytes(), digest_size=16).digest(), int(common.view(np.int64)), float(rank.mean()), [int((found * x).min().view(np.int64)) for x in _SEEDS[:HASHES]], found[order[:p]].view(np.int64), histogram(found)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(types)[1:], strict=True)]], schema=types)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(sign), SIGNATURES)


def entries_of(signed: DataFrame) -> DataFrame:
    """The distinct sets of the signatures, with an id ``rep`` that has each."""
    return signed.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "common", "usual", "lows", "lead", "ranges")])


def _band(similarity: tuple[int, int], shift: float = 0.0) -> Column:
    """Bands of sizes, as wide as linked sets may differ."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(similarity[1] / similarity[0])) + F.lit(shift)).cast("int")


def _small(rows: DataFrame) -> DataFrame:
    """Rows of a number for each large group, stored: broadcast while there are at most
    ``BROADCAST_ROWS``, so that the many rows of one group needn't meet in a task."""
    stored = settled(rows)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def _families(documents: DataFrame, entries: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The links ``a, b`` of entries with the leaders they follow."""
    # bands are shifted from hash to hash, so that none parts a family in all
    keys = F.array(*[F.xxhash64(F.col("lows")[k], _band(similarity, k / HASHES), F.lit(k)) for k in range(HASHES)])
    near = entries.select("fp", "rep", "usual", F.explode(keys).alias("key"))
    # of copies with edits of their own, the one with the commonest shingles has the fewest
    # edits and is nearest to all others
    heads = _small(near.groupBy("key").agg(F.max(F.struct("usual", "fp", "rep")).alias("head"), F.count("*").alias("rows")).filter("rows > 1").select("key", "head"))
    # hashes mostly name the same leader, who is asked once
    asks = near.join(heads, "key").filter(F.col("fp") != F.col("head.fp")).select("fp", "rep", "head.fp", "head.rep").toDF("fp", "rep", "leader", "its_rep").distinct()
    asks = settled(asks.withColumn("gid", F.xxhash64("leader")))
    own = asks.groupBy("leader", "gid").agg(F.first("its_rep").alias("rep")).select(F.col("leader").alias("fp"), "rep", "gid", F.lit(True).alias("own"))
    sent = own.unionByName(asks.select("fp", "rep", "gid", F.lit(False).alias("own")))
    return _opened(documents, _bounded(sent, entries, similarity), size, similarity)


def _roots(followed: DataFrame) -> DataFrame:
    """``v, root`` of the entries that follow: their leader, or whom that one follows. A
    leader's shingles are commoner than its followers', so none follows itself."""
    first = followed.groupBy("a").agg(F.max("b").alias("b"))
    above = first.select(F.col("a").alias("b"), F.col("b").alias("top"))
    return settled(first.join(above, "b", "left").select(F.col("a").alias("v"), F.coalesce("top", "b").alias("root")))


def _grouped(entries: DataFrame, roots: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The entries with ``kin``, a hash of their family (of its root; of their own
    fingerprint if they have none), whether they are ``single``, and their group ``gid``."""
    family = entries.join(roots.select(F.col("v").alias("fp"), F.col("root").alias("family")), "fp", "left")
    # roots are no ends of their own, so they are told by those that follow them
    heads = roots.select(F.col("root").alias("fp")).distinct().withColumn("leads", F.lit(True))
    family = family.join(heads, "fp", "left").withColumn("single", F.col("family").isNull() & F.col("leads").isNull()).withColumn("family", F.coalesce("family", "fp")).drop("leads")
    key = F.when(F.col("single"), F.xxhash64("common", _band(similarity))).otherwise(F.xxhash64("family"))
    keyed = family.withColumn("key", key)
    # so many members at the mean that five deviations more are GROUP_SIZE
    usual = ((25 + 4 * GROUP_SIZE) ** 0.5 - 5) ** 2 / 4
    by_size = F.when(F.count("*") > GROUP_SIZE, F.ceil(F.count("*") / F.lit(usual))).otherwise(1)
    parts = F.greatest(by_size, F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("long")
    large = _small(keyed.groupBy("key").agg(parts.alias("parts")).filter("parts > 1"))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("parts", F.lit(1)))
    return keyed.join(large, "key", "left").select("fp", "rep", "n", "lead", "ranges", F.xxhash64("family").alias("kin"), "single", F.xxhash64("key", part).alias("gid"))


def _unions(members: DataFrame) -> DataFrame:
    """``gid, least, ranges`` of groups ``gid, n, ranges``: the smallest member's size and
    the union's histogram, in which any member's is contained."""
    schema = "gid long, least long, ranges binary"
    types = arrow_types(members, schema)
    ship(members.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, most, out = None, 0, np.zeros(0, "<u2"), []
        for batch in batches:
            for gid, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, "<u2").astype(np.int64)
                if gid != key:
                    if key is not None:
                        out.append((key, least, np.minimum(most, 65535).astype("<u2").tobytes()))
                    key, least, most = gid, n, own
                else:
                    size = min(len(most), len(own))
                    least, most = min(least, n), np.maximum(folded(most, size), folded(own, size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, least, np.minimum(most, 65535).astype("<u2").tobytes()), types, strict=True)], schema=types)

    sent = members.select("gid", "n", "ranges").repartition("gid").sortWithinPartitions("gid")
    return sent.mapInArrow(giving_back(work), schema)


def _may_meet(pairs: DataFrame, unions: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs ``source, gid`` of groups whose unions overlap enough."""
    numerator, denominator = similarity
    one = unions.select(F.col("gid").alias("source"), F.col("least").alias("least_a"), F.col("ranges").alias("ranges_a"))
    two = unions.select("gid", F.col("least").alias("least_b"), F.col("ranges").alias("ranges_b"))
    types = arrow_types(pairs, "source long, gid long")
    ship(pairs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, gid, na, nb, a, b in zip(*(batch.column(c).to_pylist() for c in ("source", "gid", "least_a", "least_b", "ranges_a", "ranges_b")), strict=True):
                a, b = (np.frombuffer(x, "<u2").astype(np.int64) for x in (a, b))
                size = min(len(a), len(b))
                if (numerator + denominator) * int(np.minimum(folded(a, size), folded(b, size)).sum()) >= numerator * (na + nb):
                    out.append((source, gid))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], schema=types)

    return pairs.join(one, "source").join(two, "gid").mapInArrow(giving_back(work), "source long, gid long")


def _asked_apart(posted: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """What ``_asked`` finds for tokens that one task can't hold: rows of a token are dealt
    to parts that each have the token's row of the matrix."""
    numerator, denominator = similarity
    matrix = posted.groupBy("token", F.col("gid").alias("target")).agg(F.min("low").alias("lows"), F.max("high").alias("highs"), F.max("most").alias("mosts"), F.first("kin").alias("its_kin"), F.count("fp").alias("lone"))
    each = matrix.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_PARTS - 1))))
    part = F.pmod(F.xxhash64("fp", "gid"), F.lit(TOKEN_PARTS)).cast("int")
    fits = (denominator * F.col("highs") >= numerator * F.col("low")) & (numerator * F.col("lows") <= denominator * F.col("high"))
    fits &= (numerator + denominator) * F.least("most", "mosts") >= numerator * (F.col("low") + F.col("lows"))
    # single entries ask families; of two groups of a kind, entries of the later ask the
    # earlier, and a family isn't asked by its own
    turn = F.when(F.col("gid") == F.col("target"), F.col("lone") > 1).when(F.col("fp").isNotNull() & (F.col("lone") == 0), True).when(F.col("fp").isNull() & (F.col("lone") > 0), False).otherwise((F.col("gid") > F.col("target")) & ((F.col("lone") > 0) | (F.col("kin") != F.col("its_kin"))))
    met = settled(posted.withColumn("part", part).join(each, ["token", "part"]).filter(fits & turn).select("token", "fp", "rep", "gid", "target"))
    source = F.when(F.col("fp").isNull(), F.col("gid")).alias("source")
    asks = met.select("fp", "rep", source, F.col("target").alias("gid"), (F.col("gid") == F.col("target")).alias("own"))
    members = posted.join(met.select("token", F.col("target").alias("gid")).distinct(), ["token", "gid"]).select("fp", "rep", source, "gid", F.lit(True).alias("own"))
    return asks.unionByName(members)


def _asked(entries: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``fp, rep, gid, own``: the entries that take part in opening each group; ``own``
    tells its members. Made from the token-group matrix of the leading shingles."""
    spark = entries.sparkSession
    numerator, denominator = similarity
    ship(spark)
    lead = entries.select("fp", "rep", "n", "gid", "kin", "single", F.posexplode("lead").alias("pos", "token")).withColumn("most", F.col("n") - F.col("pos"))
    lone = lead.filter("single").select("token", "gid", "fp", "rep", "kin", F.col("n").alias("low"), F.col("n").alias("high"), "most")
    whole = lead.filter("NOT single").groupBy("token", "gid").agg(F.first("kin").alias("kin"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("most"))
    posted = lone.unionByName(whole, allowMissingColumns=True).repartition("token").sortWithinPartitions("token")
    schema = "fp binary, rep long, source long, gid long, own boolean, token long, kin long, low long, high long, most long"
    types = arrow_types(entries, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows whose token may go on
        passed = None  # a token whose rows are too many to be held here
        for batch in batches:
            token = batch.column("token").to_numpy()
            if passed is not None:
                upto = int(np.searchsorted(token, passed, side="right"))
                yield common(pa.Table.from_batches([batch.slice(0, upto)]))
                batch, token = batch.slice(upto), token[upto:]
            if not len(token):
                continue
            passed = None
            last = int(np.searchsorted(token, token[-1], side="left"))
            if not held or held[0].column("token")[0].as_py() != token[-1]:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = []
            held.append(batch.slice(last))
            if sum(b.num_rows for b in held) > TOKEN_ROWS:
                yield common(pa.Table.from_batches(held))
                held, passed = [], token[-1]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    def common(table: pa.Table) -> pa.RecordBatch:
        """Rows of a common token as they are, to be dealt to more tasks."""
        none = pa.nulls(table.num_rows)
        columns = [table.column("fp"), table.column("rep"), none.cast(pa.int64()), table.column("gid"), none.cast(pa.bool_()), *(table.column(c) for c in ("token", "kin", "low", "high", "most"))]
        return pa.table(columns, schema=types).combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in types], schema=types)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        token, low, high, most, gid, family = (table.column(c).to_numpy() for c in ("token", "low", "high", "most", "gid", "kin"))
        lone = table.column("fp").is_valid().to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.append(starts[1:], len(token))
        # tokens of one family only have nothing to ask, nor have two rows that don't fit
        some = np.minimum.reduceat(family, starts) != np.maximum.reduceat(family, starts)
        fit = denominator * np.minimum.reduceat(high, starts) >= numerator * np.maximum.reduceat(low, starts)
        fit &= (numerator + denominator) * np.minimum.reduceat(most, starts) >= numerator * np.add.reduceat(low, starts)
        some &= fit | (ends - starts > 2)
        rows, groups, own = [], [], []
        many = some & (ends - starts > TOKEN_ROWS)
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            yield common(table.slice(a, b - a))
        some &= ~many
        for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            # the matrix row of this token: its groups with their smallest and largest entries
            # and the most shingles that an entry of each has from this one on
            order = np.lexsort((gid[a:b], lone[a:b])) + a
            names = gid[order]
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            there, count = names[first], np.diff(np.append(first, len(names)))
            lows, highs = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
            mosts = np.maximum.reduceat(most[order], first)
            small, large, room, kin, is_lone = low[order], high[order], most[order], family[order], lone[order]
            for g, at in enumerate(first.tolist()):
                # of two groups, entries of the later ask the earlier: families come first, so
                # that single entries ask them and not all of a family each single entry
                to = at + int(count[g])
                fits = (denominator * highs[g] >= numerator * small[at:]) & (numerator * lows[g] <= denominator * large[at:])
                # if this is the first shingle that two sets share, they share no more than
                # either has from it on; with a former one, that one asks
                fits &= (numerator + denominator) * np.minimum(room[at:], mosts[g]) >= numerator * (small[at:] + lows[g])
                if not is_lone[at]:
                    fits &= kin[at:] != kin[at]  # a family isn't asked by its own
                if not fits[to - at :].any() and fits[: to - at].sum() < 2:
                    continue
                k = np.unique(np.concatenate([np.flatnonzero(fits) + at, np.arange(at, to)]))
                rows.append(order[k])
                groups.append(np.full(len(k), there[g]))
                own.append(k < to)
        if not rows:
            return
        at, target, is_own = np.concatenate(rows), np.concatenate(groups), np.concatenate(own)
        # each (entry or family part, group) once a batch
        called = np.array([x or b"" for x in table.column("fp").take(pa.array(at)).to_pylist()], dtype="S16")
        name = np.where(lone[at], np.unique(called, return_inverse=True)[1] * 2, np.unique(gid[at], return_inverse=True)[1] * 2 + 1)
        _, keep = np.unique(np.stack([name, target, is_own], 1), axis=0, return_index=True)
        got = table.take(pa.array(at[keep]))
        source = pa.array(gid[at[keep]], mask=lone[at[keep]])
        rest = [pa.nulls(len(keep)).cast(f.type) for f in list(types)[5:]]
        for part in pa.table([got.column("fp"), got.column("rep"), source, pa.array(target[keep]), pa.array(is_own[keep]), *rest], schema=types).to_batches(max_chunksize=65536):
            yield part

    found = settled(posted.mapInArrow(giving_back(ask), schema).distinct())
    dealt = found.filter("own IS NULL").select("token", "gid", "fp", "rep", "kin", "low", "high", "most")
    found = found.filter("own IS NOT NULL").select("fp", "rep", "source", "gid", "own")
    if not dealt.isEmpty():
        found = settled(found.unionByName(_asked_apart(dealt, similarity)).distinct())
    alone = found.filter("source IS NULL").select("fp", "rep", "gid", "own")
    # families ask, and are asked, with all members of the part that the matrix names
    parts = found.filter("source IS NOT NULL").select("source", "gid", "own")
    asking = parts.filter("NOT own").select("source", "gid").distinct()
    wanted = parts.filter("own")
    if not asking.isEmpty():
        named = asking.select(F.col("source").alias("gid")).unionByName(asking.select("gid")).distinct()
        met = _may_meet(asking, _unions(entries.join(named, "gid", "left_semi")), similarity)
        wanted = wanted.unionByName(met.withColumn("own", F.lit(False)))
    members = entries.filter("NOT single").select(F.col("gid").alias("source"), "fp", "rep")
    return alone.unionByName(wanted.join(members, "source").select("fp", "rep", "gid", "own")).groupBy("fp", "gid").agg(F.first("rep").alias("rep"), F.max("own").alias("own"))


class _Group:
    """The members of an open group with the union of their shingles."""

    def __init__(self, members: list[tuple[bytes, np.ndarray]], similarity: tuple[int, int]) -> None:
        self.similarity = similarity
        self.names = [x for x, _ in members]
        self.sizes = np.array([len(x) for _, x in members])
        # arrays go as soon as they are used: a group may have millions of shingles
        tokens = np.concatenate([x for _, x in members])
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        self.owner = np.repeat(np.arange(len(members), dtype=np.int32), self.sizes)[order]
        del order
        self.first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.union, self.last = tokens[self.first], np.append(self.first[1:], len(tokens))
        self.above = list(range(len(members)))  # union-find over the members

    def root(self, k: int) -> int:
        while self.above[k] != k:
            self.above[k] = self.above[self.above[k]]
            k = self.above[k]
        return k

    def links(self, name: bytes, found: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links of a query that the forest so far doesn't have."""
        at = np.searchsorted(self.union, found)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == found)]
        if len(at) < least_overlap(len(found), int(self.sizes.min()), self.similarity):
            return []  # not even with all of the group
        first, count = self.first[at], self.last[at] - self.first[at]
        place = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        shared = np.bincount(self.owner[place], minlength=len(self.names))
        out, joined = [], -1
        for k in np.flatnonzero(linked(len(found), self.sizes, shared, self.similarity)).tolist():
            if joined < 0:
                joined = self.root(k)
                if self.names[k] != name:
                    out.append((name, self.names[k]))
            elif self.root(k) != joined:
                if self.names[k] != name:
                    out.append((name, self.names[k]))
                self.above[self.root(k)] = joined
        return out


def _spread(asked: DataFrame) -> DataFrame:
    """The asked rows with ``part`` and ``query``: a group's members go to all its parts
    as members and to one as a query, other queries go to one part."""
    shares = _small(asked.groupBy("gid").agg(F.ceil(F.count("*") / QUERY_SIZE).cast("long").alias("parts")).filter("parts > 1"))
    home = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1).cast("long")))
    to = F.explode(F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).otherwise(F.array(home)))
    spread = asked.join(shares, "gid", "left").select(*asked.columns, home.alias("home"), to.alias("part"))
    return spread.withColumn("query", F.col("home") == F.col("part")).drop("home")


def _bounded(asked: DataFrame, entries: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the asked rows, for queries and members alike, that have a partner in the
    group by the bound of their histograms."""
    sent = _spread(asked.join(entries.select("fp", "n", "ranges"), "fp"))
    sent = sent.select("gid", "part", "own", "query", "fp", "rep", "n", "ranges").repartition("gid", "part").sortWithinPartitions("gid", "part", F.desc("own"), "fp")
    schema = "fp binary, gid long, rep long, own boolean"
    types = arrow_types(asked, schema)
    numerator, denominator = similarity
    ship(asked.sparkSession)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, matrix, out = None, [], {}, []

        def partners(name: bytes, n: int, own: np.ndarray) -> bool:
            """Whether any member may link; marks those that may."""
            size = min(len(own), matrix["size"])
            if size not in matrix:
                matrix[size] = folded(matrix[matrix["size"]], size).astype(np.int32)
                matrix["union", size] = matrix[size].max(0)
            # the union first: any member's overlap is at most that with it
            mine, step, hit = folded(own, size).astype(np.int32), max(1, (1 << 21) // size), False
            if (numerator + denominator) * int(np.minimum(matrix["union", size], mine).sum()) < numerator * (matrix["least"] + n):
                return False
            # then the members, in slices, so that a large group needs no large product
            for at in range(0, len(members), step):
                most = np.minimum(matrix[size][at : at + step], mine).sum(1)
                may = np.flatnonzero((numerator + denominator) * most >= numerator * (matrix["n"][at : at + step] + n)) + at
                for k in may.tolist():
                    if members[k][0] != name:
                        matrix["wanted"][k] = hit = True
            return hit

        def ready() -> None:
            if not matrix:
                size = min(len(m[3]) for m in members)
                rows = np.empty((len(members), size), np.int32)
                for k, m in enumerate(members):
                    rows[k] = folded(m[3], size)
                matrix.update({"size": size, size: rows, "n": np.array([m[2] for m in members]), "wanted": np.zeros(len(members), bool)})
                matrix["union", size], matrix["least"] = matrix[size].max(0), int(matrix["n"].min())

        def close() -> None:
            if not members:
                return
            ready()
            if len(members) > 1:
                for k, (name, _, n, own, query) in enumerate(members):
                    if query and partners(name, n, own):
                        matrix["wanted"][k] = True
            out.extend((members[k][0], key[0], members[k][1], True) for k in np.flatnonzero(matrix["wanted"]).tolist())

        for batch in batches:
            for gid, part, own, query, fp, rep, n, raw in zip(*[batch.column(k).to_pylist() for k in range(8)], strict=True):
                if (gid, part) != key:
                    close()
                    key, members, matrix = (gid, part), [], {}
                ranges = np.frombuffer(raw, "<u2")
                if own:
                    members.append((fp, rep, n, ranges, query))
                elif members:
                    ready()
                    if partners(fp, n, ranges):
                        out.append((fp, gid, rep, False))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(types)], schema=types)
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(types)], schema=types)

    return sent.mapInArrow(giving_back(bound), schema).distinct()


def _opened(documents: DataFrame, asked: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The links ``a, b`` (fingerprints) of a spanning forest inside each opened group."""
    spark = asked.sparkSession
    asked = settled(asked)
    spread = _spread(asked)
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), "text").filter(F.col("text").isNotNull())
    if asked.count() <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    sent = texts.join(spread, texts._id.eqNullSafe(spread.rep)).select("gid", "part", "own", "query", "fp", "text")
    sent = sent.repartition("gid", "part").sortWithinPartitions("gid", "part", F.desc("own"), "fp")
    schema = "a binary, b binary"
    types = arrow_types(documents, schema)
    ship(spark)

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, group, out, last = None, [], None, [], None
        for batch in _text_slices(batches):
            gids, parts, owns, queries, fps = (batch.column(k).to_pylist() for k in range(5))
            for gid, part, own, query, fp, found in zip(gids, parts, owns, queries, fps, shingles(batch.column(5).to_pylist(), size), strict=True):
                if blake2b(found.tobytes(), digest_size=16).digest() != fp or (gid, part, fp) == last:
                    continue  # another text under the same id, or the same row again
                last = (gid, part, fp)
                if (gid, part) != key:
                    out += closed(members, group)
                    key, members, group = (gid, part), [], None
                if own:
                    members.append((fp, found, query))
                elif members:
                    group = group or _Group([x[:2] for x in members], similarity)
                    out += group.links(fp, found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], schema=types)
            out = []
        out = closed(members, group)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], schema=types)

    def closed(members: list, group: _Group | None) -> list[tuple[bytes, bytes]]:
        """The links among the members themselves."""
        if len(members) < 2:
            return []
        group = group or _Group([x[:2] for x in members], similarity)
        return [link for fp, found, query in members if query for link in group.links(fp, found)]

    return sent.mapInArrow(giving_back(open_groups), schema)


def components(links: DataFrame) -> DataFrame:
    """``v, root`` of every end of the links ``a, b``; the root is the least of its
    component. Large-star and small-star rounds until nothing changes."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = settled(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def classes(documents: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    with small_batches(documents.sparkSession):
        signed = settled(signatures(documents, size, similarity))
        entries = settled(entries_of(signed))
        followed = settled(_families(documents, entries, size, similarity))
        grouped = settled(_grouped(entries, _roots(followed), similarity))
        found = settled(_opened(documents, _bounded(settled(_asked(grouped, similarity)), entries, similarity), size, similarity))
    forest = followed.unionByName(found)
    roots = components(forest)
    reps = signed.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    rooted = reps.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = rooted.join(smallest, "root").select("fp", "component_id")
    return signed.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(by_set, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("fp").isNull(), F.col("doc_id"))).alias("component_id"))


def keep_one(documents: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents with one of each component left, the one with the smallest id;
    documents without words and rows without an id all stay. Of rows that repeat the id
    that stays, one of each text does."""
    judged = settled(classes(documents, size, similarity))
    gone = judged.filter("n_shingles > 0 AND doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    twice = judged.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_gone"))
    gone = settled(gone)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = documents.join(gone, documents.doc_id == gone._gone, "left_anti")
    if twice.isEmpty():
        return kept
    # rows that repeat an id: one row of each text stays
    mark = f"_row_{uuid.uuid4().hex[:8]}"
    numbered = kept.withColumn(mark, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")))
    return numbered.filter((F.col(mark) == 1) | F.col("doc_id").isNull() | (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t-\\r]", "")) == 0)).drop(mark)
