"""Language identification by prediction by partial matching.

For each language a context tree over bytes is counted on training texts. A byte's
probability comes from the longest context seen in training; where the byte is new
there, the tree pays an escape (method C: distinct successors over successors plus
distinct) and goes to the next shorter context, down to no context and at last to a
uniform 1/256. The statistics are frozen, so the code length of every (context, byte)
is fixed: it is worked out once per worker for all contexts and read off per byte of
a text, which gives exact code lengths of whole texts. The language with the shortest
code wins; the score is its share of probability with code lengths tempered by the
text's length.

Training reads, per language, at most ``SAMPLE_DOCUMENTS`` documents chosen by a hash
of their id and text, each whole; this bounded sample is the only thing that doesn't grow
with the table. Tasks count its byte runs; only those counts reach the driver.

Costs are kept for the (context, byte) pairs that some language has seen; any other pair
pays its contexts' escapes down to a shorter one that has, so memory grows with what was
seen and not with contexts x bytes x languages.

Edge cases: texts that are null or have no letter are ``und`` with score 0; very long
texts are coded whole, in parts that overlap by a context; without a language to learn
from all are ``und``; ties go to the language that sorts first; repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import arrow_types
from facetry.session import ship

ORDER = 3
SAMPLE_DOCUMENTS = 400
UNKNOWN = "und"
#: Numbers that the costs of the positions coded at once take at most.
ROOM = 1 << 22


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(documents: DataFrame, documents_each: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The bounded training sample ``lang, text``."""
    rows = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), "doc_id")
    # the first of each slot by hash, chosen by ids and hashes before any text moves
    chosen = rows.groupBy("lang", F.pmod(F.col("h"), F.lit(documents_each)).alias("slot")).agg(F.min(F.struct("h", "doc_id")).alias("first")).select("lang", F.col("first.h").alias("h"))
    return rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def byte_runs(raw: bytes) -> np.ndarray:
    """The code of every byte with the ``ORDER`` before it, base 257, the nearest lowest;
    256 stands for what is before the text."""
    symbols = np.concatenate([np.full(ORDER, 256, np.int64), np.frombuffer(raw, np.uint8).astype(np.int64)])
    code = np.zeros(len(raw), np.int64)
    for back in range(ORDER, -1, -1):
        code = code * 257 + symbols[ORDER - back : len(symbols) - back]
    return code


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and how often they come in all of the parts."""
    codes, index = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(index, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def counts_of(trained: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, the byte runs of ``lang, text`` rows with their counts."""
    ship(trained.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(byte_runs(text.encode("utf-8", "surrogatepass")), return_counts=True)
                total[lang] = merged_counts([total[lang], own]) if lang in total else own
        for lang, (codes, times) in total.items():
            for at in range(0, len(codes), 65536):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(codes[at : at + 65536]), "code": codes[at : at + 65536], "n": times[at : at + 65536]})

    summed = trained.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = (summed.column(k).to_numpy() for k in range(3))
    return {x: (code[lang == x], n[lang == x]) for x in sorted(set(lang.tolist()))}


class PartialMatching:
    """Frozen context trees of all languages over one alphabet of seen bytes.

    For each order, ``node[context]`` numbers the contexts that some language has seen (-1
    for others) and ``pair[node, byte]`` the pairs; ``bits[pair, language]`` is the code
    length of a pair in bits and ``escape[node, language]`` that of leaving a context."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        self.order = ORDER
        codes, times = (np.concatenate([counts[x][k] for x in self.languages]) for k in range(2))
        owner = np.repeat(np.arange(len(self.languages)), [len(counts[x][0]) for x in self.languages])
        seen = np.zeros(257, bool)
        seen[codes % 257] = True
        self.size = a = int(seen.sum()) + 1
        self.alphabet = np.zeros(257, np.int64)  # 0: never seen
        self.alphabet[np.flatnonzero(seen)] = np.arange(1, a)
        symbols = [self.alphabet[codes // 257**k % 257] for k in range(ORDER + 1)]  # the byte, then those before it
        self.node, self.pair, self.bits, self.escape = [], [], [], []
        for order in range(ORDER + 1):
            context = sum((symbols[k] * a ** (k - 1) for k in range(1, order + 1)), np.zeros(len(codes), np.int64))
            pairs, where = np.unique(context * a + symbols[0], return_inverse=True)
            contexts, of = np.unique(pairs // a, return_inverse=True)
            n = np.bincount(where * len(self.languages) + owner, times, len(pairs) * len(self.languages)).reshape(len(pairs), -1)
            total, distinct = np.zeros((2, len(contexts), len(self.languages)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                coded = -np.log2(n / (total + distinct)[of])
            # the same byte in the next shorter context is a pair as well
            below = self.bits[-1][self.pair[-1][self.node[-1][(pairs // a) % a ** (order - 1)], pairs % a]] if order else np.full(n.shape, 8.0)
            bits = np.where(n > 0, coded, escape[of] + below)
            node = np.full(a**order, -1, np.int32)
            node[contexts] = np.arange(len(contexts))
            pair = np.full((len(contexts) + 1, a), -1, np.int32)  # the last row is that of no context
            pair[of, pairs % a] = np.arange(len(pairs))
            self.node.append(node)
            self.pair.append(pair)
            # a last row of zeros for what isn't there, so that -1 finds it
            self.bits.append(np.vstack([bits, np.zeros((1, len(self.languages)))]))
            self.escape.append(np.vstack([escape, np.zeros((1, len(self.languages)))]))
        self.bits = [x.astype(np.float32) for x in self.bits]
        self.escape = [x.astype(np.float32) for x in self.escape]

    @classmethod
    def of(cls, trained: list[tuple[str, bytes]]) -> PartialMatching:
        """The model of ``(lang, text bytes)`` rows in memory."""
        names = sorted({x for x, _ in trained})
        return cls({x: merged_counts([np.unique(byte_runs(raw), return_counts=True) for lang, raw in trained if lang == x]) for x in names})

    def _coded(self, symbols: np.ndarray) -> np.ndarray:
        """Bits of each symbol from place ``self.order`` on, in each language."""
        context, byte = self._context(symbols, self.order), symbols[self.order :]
        node = self.node[self.order][context]
        row = self.pair[self.order][node, byte]
        out = self.bits[self.order][row]
        left = np.flatnonzero(row < 0)
        for order in range(self.order - 1, -1, -1):
            if not len(left):
                return out
            out[left] += self.escape[order + 1][node[left] if order + 1 == self.order else node]
            node = self.node[order][context[left] % self.size**order]
            row = self.pair[order][node, byte[left]]
            out[left] += self.bits[order][row]
            node, left = node[row < 0], left[row < 0]
        out[left] += self.escape[0][node] + 8.0
        return out

    def _context(self, symbols: np.ndarray, order: int) -> np.ndarray:
        """The contexts before each symbol from place ``self.order`` on; the nearest
        byte is the lowest digit."""
        key = np.zeros(len(symbols) - self.order, np.int64)
        for back in range(order, 0, -1):
            key = key * self.size + symbols[self.order - back : len(symbols) - back]
        return key

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(x) for x in texts])
        at, most = 0, self._most()
        while at < len(texts):  # some MB of costs at a time
            end, room = at, 0
            while end < len(texts) and (end == at or room + sizes[end] <= most):
                room += sizes[end]
                end += 1
            out[at:end] = self._some(texts[at:end], sizes[at:end])
            at = end
        return out

    def _most(self) -> int:
        return max(1 << 12, ROOM // len(self.languages))

    def _some(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        step, most = self.order, self._most()
        total = np.zeros((len(texts), len(self.languages)))
        if len(texts) == 1 and sizes[0] > most:  # a very long text, in parts that overlap by a context
            raw = np.frombuffer(texts[0], np.uint8)
            before = np.zeros(step, np.int64)
            for start in range(0, len(raw), most):
                symbols = np.concatenate([before, self.alphabet[raw[start : start + most]]])
                total[0] += self._coded(symbols).sum(0, dtype=np.float64)
                before = symbols[-step:]
            return total
        symbols = np.zeros(int(sizes.sum()) + step * (len(texts) + 1), np.int64)
        starts = np.cumsum(sizes + step) - sizes
        raw = self.alphabet[np.frombuffer(b"".join(texts), np.uint8)]
        inside = np.ones(len(symbols), bool)
        for back in range(1, step + 1):
            inside[starts - back] = False
        inside[len(symbols) - step :] = False
        symbols[inside] = raw
        bits = self._coded(symbols)
        bits[~inside[step:]] = 0
        some = np.flatnonzero(sizes > 0)
        if len(some):
            ends = np.add.reduceat(bits, starts[some] - step, axis=0, dtype=np.float64)
            total[some] = ends
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language with the shortest code, and its share."""
        bits = self.lengths(texts)
        sizes = np.maximum(1, np.array([len(x) for x in texts]))
        share = np.exp2(-np.minimum(60, (bits - bits.min(1, keepdims=True)) * np.minimum(1, 64 / sizes)[:, None]))
        best = bits.argmin(1)
        return [self.languages[k] for k in best], (1 / share.sum(1)).tolist()


_MODELS: dict[str, PartialMatching] = {}


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def identify(documents: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; learned from ``trained``
    (``lang, text`` rows), else from the documents' own sample."""
    spark = documents.sparkSession
    ship(spark)
    counts = counts_of(sample(documents) if trained is None else trained)
    name = uuid.uuid4().hex
    held = spark.sparkContext.broadcast(counts)  # the byte runs that the sample has
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    types = arrow_types(documents, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            if held.value and model is None:
                if name not in _MODELS:
                    _MODELS.clear()
                    _MODELS[name] = PartialMatching(held.value)
                model = _MODELS[name]
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                lettered = [_has_letter(x) for x in texts]
                if model:
                    names, scores = model.predict([x.encode("utf-8", "surrogatepass") for x in texts])
                    names = [n if ok else UNKNOWN for n, ok in zip(names, lettered, strict=True)]
                    scores = [s if ok else 0.0 for s, ok in zip(scores, lettered, strict=True)]
                else:
                    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=types)

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, schema)
