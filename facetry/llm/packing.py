"""Best-fit packing by best-two-fit.

Documents are cut into pieces of at most ``capacity`` tokens and packed into as few
sequences as can be: a sequence is filled greedily with the longest pieces that fit;
then its smallest piece is replaced by two unpacked pieces if they fit the gap that
this opens more tightly, again and again while that helps.

The plan is made on the histogram of lengths, not on documents: a filled sequence is a
pattern of lengths that is repeated as often as the remaining counts allow, so the
driver holds at most ``capacity`` counts and a few patterns per length, whatever the
number of documents. Pieces find their place by their rank among pieces of the same
length: each task counts its own as it makes them, and a prefix sum over the tasks'
counts gives the rest, so no length is ranked in one place.

Edge cases: null and empty texts have one piece of one id (the end of text); very long
texts are tokenized whole and cut; lengths that fit equally well are taken longest first;
repeated rows are packed each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import arrow_types, giving_back, texts
from facetry.session import settled, ship

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a task remembers.
REMEMBERED = 500_000
#: Counts of tasks and lengths that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_ODD = re.compile("[\x1c-\x1f]|<\\|")
_MARKS = ".,;:!?&%$#*|"
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


def default_tokenizer() -> str:
    """The vocabulary file of the query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PairMerges:
    """Byte-pair merging of many words at once, by numpy.

    Words of one byte length form a matrix of symbols; in every round each row merges
    its leftmost pair of lowest rank, so the rows that go on keep one common width."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], model["merges"]
        suffix = model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges]
        self.base = max(vocabulary.values()) + 1
        self.keys = np.array([vocabulary[x] * self.base + vocabulary[y] for x, y in pairs], np.int64)
        self.made = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inside = np.array([vocabulary[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letter[b] + suffix] for b in range(256)], np.int64)
        self.none = len(pairs)
        self.keys = np.append(self.keys, -1)
        # a first table by one hash, a second by another for keys that met in the first
        self.bits, self.odd = 20, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        order = np.arange(self.none)
        slots = self._slot(self.keys[:-1], 0)
        self.tables = [np.full(1 << self.bits, self.none, np.int32)]
        self.tables[0][slots] = order
        rest = order[self.tables[0][slots] != order]
        while True:
            second = self._slot(self.keys[rest], 1)
            if len(np.unique(second)) == len(rest):
                break
            self.odd = (self.odd[0], self.odd[1] * 0x2545F4914F6CDD1D % 2**64 | 1)
        self.tables.append(np.full(1 << self.bits, self.none, np.int32))
        self.tables[1][second] = rest

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(self.odd[k])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        found = self.tables[0][self._slot(keys, 0)]
        missed = np.flatnonzero(self.keys[found] != keys)
        again = self.tables[1][self._slot(keys[missed], 1)]
        found[missed] = np.where(self.keys[again] == keys[missed], again, self.none)
        return found

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty) as little-endian unsigned 32-bit."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, rows in by_length.items():
            raw = np.frombuffer(b"".join([words[k] for k in rows]), np.uint8).reshape(-1, length)
            symbols = self.inside[raw]
            symbols[:, -1] = self.last[raw[:, -1]]
            places = np.array(rows)
            if length > 1:
                ranks = self._ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), length - 1)
            while True:
                width = symbols.shape[1]
                if width == 1:
                    self._store(out, places, symbols)
                    break
                at = ranks.argmin(axis=1)
                row = np.arange(len(at))
                best = ranks[row, at]
                ended = best == self.none
                if ended.any():
                    self._store(out, places[ended], symbols[ended])
                    on = ~ended
                    symbols, ranks, places, at, best = symbols[on], ranks[on], places[on], at[on], best[on]
                    row = np.arange(len(at))
                if not len(at):
                    break
                symbols[row, at] = self.made[best]
                keep = np.ones(symbols.shape, bool)
                keep[row, at + 1] = False
                symbols = symbols[keep].reshape(len(at), width - 1)
                keep = np.ones(ranks.shape, bool)
                keep[row, at] = False
                ranks = ranks[keep].reshape(len(at), width - 2)
                if width > 2:
                    some = np.flatnonzero(at > 0)
                    ranks[some, at[some] - 1] = self._ranks(symbols[some, at[some] - 1], symbols[some, at[some]])
                    some = np.flatnonzero(at < width - 2)
                    ranks[some, at[some]] = self._ranks(symbols[some, at[some]], symbols[some, at[some] + 1])
        return out

    @staticmethod
    def _store(out: list[bytes], places: np.ndarray, symbols: np.ndarray) -> None:
        raw, step = symbols.astype("<u4").tobytes(), 4 * symbols.shape[1]
        for k, place in enumerate(places.tolist()):
            out[place] = raw[k * step : (k + 1) * step]


class WordTokenizer:
    """Ids of whole texts by a vocabulary whose pre-tokens never cross white space, so
    ids of a text are those of its blank-separated words in turn. Words are encoded
    once and remembered; those of letters, with marks after them, are merged by
    :class:`PairMerges`, all others by the library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.merges = PairMerges(path)
        self.known: dict[str, bytes] = {}

    def ids(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [None if _ODD.search(x) else x.split() for x in batch]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        self._learn({w for words in cut if words for w in words if w not in known})
        out = []
        for text, words in zip(batch, cut, strict=True):
            if words is None:
                out.append(np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join([known[w] for w in words]))
        return out

    def _learn(self, new: set[str]) -> None:
        plain: dict[str, tuple[str, str]] = {}
        rest = []
        for word in new:
            core = word.rstrip(_MARKS)
            if core.isalpha() and "\u03a3" not in core and unicodedata.is_normalized("NFC", word):
                plain[word] = (core.lower(), word[len(core) :])
            else:
                rest.append(word)
        parts = list({x for pair in plain.values() for x in pair if x})
        got = dict(zip(parts, self.merges.ids([x.encode() for x in parts]), strict=True))
        got[""] = b""
        for word, (core, marks) in plain.items():
            self.known[word] = got[core] + got[marks]
        for at in range(0, len(rest), 8192):
            some = rest[at : at + 8192]
            for word, ids in zip(some, self.inner.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[word] = np.array(ids.ids, "<u4").tobytes()


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document with the checksum of their ids; ``with_ids`` adds
    the ids themselves (little-endian unsigned 32-bit)."""
    ship(documents.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")
    types = arrow_types(documents, schema)
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    rows: list[tuple] = []
                    for doc_id, ids in zip(batch.column(0).to_pylist(), encode.ids(texts(batch)), strict=True):
                        ids += end
                        for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                            part = ids[start : start + 4 * capacity]
                            row = (doc_id, k, start // 4, len(part) // 4, zlib.crc32(part))
                            rows.append(row + (part,) if with_ids else row)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
        finally:
            encode.known.clear()  # the worker goes on to other stages

    return documents.select("doc_id", "text").mapInArrow(giving_back(work), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, times), ...], repeats)`` that use up ``counts``."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a piece is empty or longer than a sequence")
    there = 0  # bit k: pieces of length k are left
    mirror = 0  # bit capacity - k
    for k in left:
        there |= 1 << k
        mirror |= 1 << (capacity - k)
    out = []

    def take(used: dict[int, int], k: int, times: int) -> None:
        nonlocal there, mirror
        used[k] = used.get(k, 0) + times
        if used[k] == left[k]:
            there &= ~(1 << k)
            mirror &= ~(1 << (capacity - k))

    def give(used: dict[int, int], k: int) -> None:
        nonlocal there, mirror
        used[k] -= 1
        if not used[k]:
            del used[k]
        there |= 1 << k
        mirror |= 1 << (capacity - k)

    def pair(room: int, over: int, used: dict[int, int]) -> tuple[int, int] | None:
        for total in range(room, over, -1):
            # bit a of both: lengths a and total - a are left
            both = there & (mirror >> (capacity - total) if total <= capacity else mirror << (total - capacity)) & ((1 << total) - 2)
            while both:
                a = both.bit_length() - 1
                b = total - a
                if a != b or left[a] - used.get(a, 0) >= 2:
                    return a, b
                both &= ~(1 << a)
        return None

    while there:
        used: dict[int, int] = {}
        gap = capacity
        while fits := there & ((1 << (gap + 1)) - 1):
            k = fits.bit_length() - 1
            times = min(gap // k, left[k] - used.get(k, 0))
            take(used, k, times)
            gap -= k * times
        while gap and used:
            smallest = min(used)
            found = pair(gap + smallest, smallest, used)
            if not found:
                break
            give(used, smallest)
            for k in found:
                take(used, k, 1)
            gap += smallest - sum(found)
        repeats = min(left[k] // times for k, times in used.items())
        out.append((sorted(used.items(), reverse=True), repeats))
        for k, times in used.items():
            left[k] -= times * repeats
            bit, seen = 1 << k, 1 << (capacity - k)
            there, mirror = (there | bit, mirror | seen) if left[k] else (there & ~bit, mirror & ~seen)
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length, rows ``(first rank, first sequence, times in a sequence, offset)``."""
    out: dict[int, list[tuple]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, repeats in patterns:
        offset = 0
        for length, times in pattern:
            first = given.get(length, 0)
            out.setdefault(length, []).append((first, sequence, times, offset))
            given[length] = first + times * repeats
            offset += length * times
        sequence += repeats
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _numbered(cut: DataFrame) -> DataFrame:
    """The pieces with ``task`` and their number ``within`` among those of their length in
    the task, from 0."""
    from pyspark import TaskContext

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", task int, within long"
    types, place = arrow_types(cut, schema), cut.columns.index("length")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column(place).to_numpy(zero_copy_only=False)
            within = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                first = seen.get(length, 0)
                within[own] = first + np.arange(len(own))
                seen[length] = first + len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(lengths), pa.int32()), pa.array(within)], schema=types)

    return cut.mapInArrow(giving_back(work), schema)


def packed(cut: DataFrame, capacity: int = CAPACITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    ship(spark)
    numbered = settled(_numbered(cut))
    by_task = settled(numbered.groupBy("length", "task").agg(F.count("*").alias("rows")))
    before = by_task.select("length", "task", (F.sum("rows").over(Window.partitionBy("length").orderBy("task")) - F.col("rows")).alias("before"))
    counts = {r["length"]: r["rows"] for r in by_task.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}  # at most capacity rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    if by_task.count() <= broadcast_rows:
        before = F.broadcast(before)
    ranked = numbered.join(before, ["length", "task"]).withColumn("rank", F.col("within") + F.col("before"))
    columns = [x for x in cut.columns]
    schema = ", ".join(f"{x} {cut.schema[x].dataType.simpleString()}" for x in columns) + ", sequence_id long, offset long"
    types = arrow_types(cut, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            lengths = batch.column(columns.index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                rows = table[int(length)]
                at = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                turn = ranks[own] - at[:, 0]
                sequence[own] = at[:, 1] + turn // at[:, 2]
                offset[own] = at[:, 3] + turn % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], schema=types)

    return ranked.select(*columns, "rank").mapInArrow(giving_back(work), schema)


def packed_documents(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents tokenized, cut and packed."""
    return packed(pieces(documents, vocabulary or default_tokenizer(), capacity), capacity)
