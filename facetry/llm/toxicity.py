"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the tokens of a clause. *Target*, *negation* and *reported speech*
mark the matches of a word list that they reach; a match may also promise a target among
the next tokens, on a path that ends where none comes. *Insult* and *threat* are character
automata of words and word stems (a stem takes any ending) that weigh tokens, each
followed by a machine that picks one match and emits the kind of clause that its marks
tell. ``compose`` makes one machine of the four that stand in a row, for insults and for
threats; the best path through it is the clause's strongest match, so the score is made
of matched clauses and not of words.

Stems and their weights (log odds of toxic documents) and the weight of each kind of
clause are learned from at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled documents,
each read whole; this bounded sample is all that doesn't grow with the table. The driver
sees the sample's distinct words and its clauses' weights, not its texts. Seed words have
prior counts, kinds of clause prior weights, so the grammar works without labels too.

Edge cases: null and empty texts get the score of a text without matches; very long texts
are read whole and all of their clauses count; of equally strong matches of a clause the
heavier word counts, then the first kind; repeated rows get repeated results; of rows that
repeat an id the sample has one, that with the least hash; several labels of one document
count as their maximum; an empty ``labels`` leaves the priors, an empty table gives an
empty result; further columns are ignored (``keep_clean`` passes them on).
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import arrow_types, giving_back
from facetry.session import settled, ship

SAMPLE_TOXIC = 2500
SAMPLE_CLEAN = 2500
#: Learned stems at most, their shortest and longest length, toxic sample documents that
#: must have one, and the share of its documents that must be toxic.
MAX_STEMS, STEM_FROM, STEM_TO, LEAST_SUPPORT, LEAST_PRECISION = 400, 3, 12, 4, 0.8
#: Tokens that a negation or target reaches.
REACH = 3

# Seed words of the grammar.
INSULTS = "idiot idiots moron morons scum trash loser losers pathetic worthless disgusting stupid clown dumb imbecile bastard arschloch trottel dummkopf abschaum connard crétin salaud ordure imbécil estúpido basura escoria".split()
THREATS = "kill hurt destroy stab shoot strangle murder töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your youre yourself u he she they them him her du dich dir ihr euch sie tu toi vous te usted tú ustedes ellos".split()
NEGATIONS = "not no never nobody isnt arent dont wont nicht kein keine nie ne pas jamais non nunca jamás ningún".split()
REPORTS = "said says say told tells claimed wrote called calls reported quoted sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()

KINDS = ("plain", "targeted", "negated", "reported")
#: Prior weights of a clause's evidence by kind, of insults and then of threats, and how
#: firmly they are held.
PRIOR = np.array([1.0, 1.2, 0.6, 0.6, 0.8, 1.4, 0.4, 0.4])
PRIOR_STRENGTH = 2.0
PRIOR_INTERCEPT = -1.5

#: What a token may be, and the marks of the transducers.
TARGET, NEGATION, REPORT, MATCH, TARGETED, NEGATED, REPORTED = (1 << k for k in range(7))

_APART = {ord(x): " " for x in "\t\n\r\v\f!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~«»“”„…¡¿–—"} | {ord("'"): None, ord("’"): None}
_CLAUSE = re.compile(r"[^.!?;:|\n…]+")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def plain(text: str) -> str:
    """Lower-cased words, each after one or more blanks."""
    return " " + text.lower().translate(_APART) + " "


class Transducer:
    """States from 0, the start; ``arcs[state, symbol]`` are ``(next, symbol out, kind)``,
    ``kind`` that of a picked match or -1. Symbols are sets of the bits above."""

    def __init__(self, arcs: dict[tuple[int, int], list[tuple[int, int, int]]], finals: frozenset[int]) -> None:
        self.arcs, self.finals = arcs, finals


def _transducer(states: Iterable[Hashable], final: Callable[[Hashable], bool], rule: Callable[[Hashable, int], list[tuple]], symbols: int) -> Transducer:
    """A machine whose ``rule(state, symbol)`` gives the arcs; the first state starts."""
    number = {s: k for k, s in enumerate(states)}
    arcs = {(k, x): [(number[n], out, kind) for n, out, kind in rule(s, x)] for s, k in number.items() for x in range(symbols)}
    return Transducer(arcs, frozenset(k for s, k in number.items() if final(s)))


def target_marks() -> Transducer:
    """Marks matches near a target. States are the tokens that the last target still
    reaches, the tokens among which none may come (an unmarked match denied one), and
    those among which one must (a marked match promised one), so of all paths of a clause
    only the true one lasts."""

    def rule(state: tuple[int, int, int], x: int) -> list[tuple[tuple[int, int, int], int, int]]:
        after, denied, promised = state
        marked = x | TARGETED if x & MATCH else x
        if x & TARGET:
            return [] if denied else [((REACH, 0, 0), marked, -1)]
        if after:
            return [((after - 1, 0, 0), marked, -1)]
        if promised == 1:
            return []
        denied, promised = max(denied - 1, 0), max(promised - 1, 0)
        if not x & MATCH:
            return [((0, denied, promised), x, -1)]
        return [((0, denied, promised or REACH), marked, -1)] + ([] if promised else [((0, REACH, 0), x, -1)])

    states = [(0, 0, 0), *((a, 0, 0) for a in range(1, REACH + 1)), *((0, d, q) for d in range(REACH + 1) for q in range(REACH + 1) if d or q)]
    return _transducer(states, lambda s: not s[2], rule, MATCH << 1)


def negation_marks() -> Transducer:
    """Marks matches up to some tokens after a negation."""

    def rule(state: int, x: int) -> list[tuple[int, int, int]]:
        near = REACH + 1 if x & NEGATION else state
        return [(max(near - 1, 0), x | NEGATED if near and x & MATCH else x, -1)]

    return _transducer(range(REACH + 1), lambda s: True, rule, TARGETED << 1)


def report_marks() -> Transducer:
    """Marks matches after a verb of speech."""

    def rule(state: int, x: int) -> list[tuple[int, int, int]]:
        said = int(state or x & REPORT > 0)
        return [(said, x | REPORTED if said and x & MATCH else x, -1)]

    return _transducer(range(2), lambda s: True, rule, NEGATED << 1)


def picked_match() -> Transducer:
    """Picks one match and emits the kind that its marks tell."""

    def rule(state: int, x: int) -> list[tuple[int, int, int]]:
        kind = 3 if x & REPORTED else 2 if x & NEGATED else 1 if x & TARGETED else 0
        return [(state, x, -1)] + ([(1, x, kind)] if x & MATCH and not state else [])

    return _transducer(range(2), lambda s: s == 1, rule, REPORTED << 1)


def compose(one: Transducer, two: Transducer) -> Transducer:
    """The machine that feeds what ``one`` puts out to ``two``."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    symbols = 1 + max(x for _, x in one.arcs)
    while todo:
        a, b = pair = todo.pop()
        for x in range(symbols):
            out = []
            for to_a, between, kind in one.arcs[a, x]:
                for to_b, last, other in two.arcs[b, between]:
                    to = (to_a, to_b)
                    if to not in number:
                        number[to] = len(number)
                        todo.append(to)
                    out.append((number[to], last, max(kind, other)))
            arcs[number[pair], x] = out
    return Transducer(arcs, frozenset(k for (a, b), k in number.items() if a in one.finals and b in two.finals))


def grammar_machine() -> Transducer:
    """Target, negation, reported speech and the pick in a row."""
    return compose(compose(compose(target_marks(), negation_marks()), report_marks()), picked_match())


MACHINE = grammar_machine()


class Lexicon:
    """A character automaton of weighted words (with a blank at their end) and stems."""

    def __init__(self, stems: dict[str, float]) -> None:
        import ahocorasick

        self.stems, self.machine = stems, ahocorasick.Automaton()
        for stem, weight in stems.items():
            self.machine.add_word(" " + stem, (len(stem) + 1, weight))
        if stems:
            self.machine.make_automaton()

    def found(self, said: str) -> bool:
        return bool(self.stems) and next(self.machine.iter(said), None) is not None

    def weights(self, said: str) -> dict[int, float]:
        """The weight of the match at each place (of the blank before a token)."""
        hits: dict[int, float] = {}
        if self.stems:
            for end, (size, weight) in self.machine.iter(said):
                start = end - size + 1
                hits[start] = max(hits.get(start, -math.inf), weight)
        return hits


class Grammar:
    """The composed machine over the lexicons of insults and threats."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float], kinds: np.ndarray = PRIOR, intercept: float = PRIOR_INTERCEPT) -> None:
        self.lexicons = (Lexicon(insults), Lexicon(threats))
        self.kinds, self.intercept = kinds, intercept
        self.role = {x: bit for bit, some in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for x in some}

    def clause(self, said: str, which: int) -> tuple[int, float] | None:
        """Kind and weight of the clause's strongest insult (0) or threat (1); ``said`` is
        as by ``plain``. The best path, token by token."""
        hits = self.lexicons[which].weights(said)
        if not hits:
            return None
        kinds, arcs, at = self.kinds[which * len(KINDS) :], MACHINE.arcs, 0
        best: dict[int, tuple] = {0: (0.0, 0.0, 1)}  # state: strength, weight and -kind of the pick
        for token in said.split():
            place = said.index(" " + token, at)
            at = place + len(token)
            weight, symbol = hits.get(place), self.role.get(token, 0)
            if weight is not None:
                symbol |= MATCH
            now: dict[int, tuple] = {}
            for state, value in best.items():
                for to, _, kind in arcs[state, symbol]:
                    new = value if kind < 0 else (float(kinds[kind]) * weight, weight, -kind)
                    if to not in now or new > now[to]:
                        now[to] = new
            best = now
        ends = [v for state, v in best.items() if state in MACHINE.finals]
        if not ends:
            return None
        _, weight, kind = max(ends)
        return -kind, weight

    def evidence(self, text: str) -> np.ndarray:
        """By insult and threat and kind, the weights of all matched clauses, the n-th
        strongest of its kind divided by n, so that clauses of one kind never push those of
        another down."""
        out = np.zeros(2 * len(KINDS))
        whole = plain(text)
        some = [which for which, lexicon in enumerate(self.lexicons) if lexicon.found(whole)]
        if not some:
            return out
        found = []
        for part in _CLAUSE.findall(text):
            said = plain(part)
            for which in some:
                if match := self.clause(said, which):
                    found.append((which * len(KINDS) + match[0], match[1]))
        ranks = [0] * len(out)
        for kind, weight in sorted(found, key=lambda x: -x[1]):
            ranks[kind] += 1
            out[kind] += weight / ranks[kind]
        return out

    def parts(self) -> tuple:
        """What makes the grammar again: at most ``MAX_STEMS`` stems and the seeds."""
        return (self.lexicons[0].stems, self.lexicons[1].stems, self.kinds, self.intercept)

    def score(self, text: str) -> float:
        """Probability that the text is toxic."""
        x = self.intercept + float(self.kinds @ self.evidence(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _features(words: Iterable[str]) -> set[str]:
    out = {w + " " for w in words}
    for w in words:
        out.update(w[:n] for n in range(STEM_FROM, min(len(w), STEM_TO) + 1))
    return out


def distinct_words(text: str) -> list[str]:
    return sorted(set(plain(text).split()))


def learn_stems(sample: list[tuple[list[str], int]]) -> Grammar:
    """A grammar with prior weights of kinds from ``(distinct words, toxic)`` rows."""
    total = (sum(1 for _, y in sample if y), sum(1 for _, y in sample if not y))
    seeds = {w + " ": 4.0 for w in INSULTS} | {w + " ": 2.0 for w in THREATS}
    # features are counted by their hashes first, so that only common ones are kept
    hashes = [np.array([hash(f) for f in _features(t)], np.int64) for t, y in sample if y]
    codes, times = np.unique(np.concatenate([*hashes, np.zeros(0, np.int64)]), return_counts=True)
    common = set(codes[times >= LEAST_SUPPORT].tolist())
    del hashes, codes, times
    place = {f: k for k, f in enumerate(seeds)}
    toxic, clean_parts = [], []
    for text, y in sample:
        if y:
            own = sorted(f for f in _features(text) if f in place or hash(f) in common)
            toxic.append(np.array([place.setdefault(f, len(place)) for f in own], np.int32))
    for text, y in sample:
        if not y:
            clean_parts.append(np.array([place[f] for f in _features(text) if f in place], np.int32))
    names = list(place)
    support = np.bincount(np.concatenate([*toxic, np.zeros(0, np.int32)]), minlength=len(names))
    clean = np.bincount(np.concatenate([*clean_parts, np.zeros(0, np.int32)]), minlength=len(names))
    prior = np.array([seeds.get(f, 0.0) for f in names])
    # log odds with the seeds' prior counts
    odds = np.log((support + prior + 0.5) / (total[0] + 1)) - np.log((clean + 0.5) / (total[1] + 1))
    ratio = max(1, total[0]) / max(1, total[1])
    good = (support >= LEAST_SUPPORT) & (support >= LEAST_PRECISION * (support + clean * ratio)) & (odds > 0)
    # stems one by one, each by what it adds; the longest of equally good ones
    stems: dict[str, float] = {}
    left = toxic
    while len(stems) < MAX_STEMS and left:
        now = np.bincount(np.concatenate(left), minlength=len(names))
        gain = np.where(good & (now >= LEAST_SUPPORT), now * odds, 0.0)
        if gain.max() <= 0:
            break
        best = max(np.flatnonzero(gain == gain.max()).tolist(), key=lambda k: (len(names[k]), names[k]))
        stems[names[best]] = float(odds[best])
        left = [own for own in left if not (own == best).any()]
    for f in seeds:
        if f not in stems and odds[place[f]] > 0:
            stems[f] = float(odds[place[f]])
    # a learned stem is a threat where it and a threat's seed begin with each other
    threats = {f for f in stems if any(w.startswith(f.strip()) or f.startswith(w) for w in THREATS)}
    return Grammar({f: w for f, w in stems.items() if f not in threats}, {f: w for f, w in stems.items() if f in threats})


def fit_kinds(grammar: Grammar, evidence: list[tuple[list[float], int]]) -> Grammar:
    """The grammar with weights of kinds fitted to ``(evidence, toxic)`` rows."""
    x = np.array([e for e, _ in evidence], float).reshape(-1, 2 * len(KINDS))
    y = np.array([t for _, t in evidence], float)
    if 0 < y.sum() < len(y):
        grammar.kinds, grammar.intercept = _fit(x, y)
    return grammar


def learn(sample: list[tuple[str, int]]) -> Grammar:
    """A grammar from ``(text, toxic)`` rows in memory."""
    grammar = learn_stems([(distinct_words(t), y) for t, y in sample])
    return fit_kinds(grammar, [(grammar.evidence(t).tolist(), y) for t, y in sample])


def trained(documents: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from the bounded sample of labelled documents; tasks read the texts."""
    rows = settled(sample(documents, labels))
    ship(documents.sparkSession)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"words": [" ".join(distinct_words(x or "")) for x in batch.column("text").to_pylist()], "toxic": batch.column("toxic").cast(pa.int32())})

    # in an order of its own, so that equally good stems are chosen alike in every run
    found = sorted((r["toxic"], r["words"]) for r in rows.mapInArrow(giving_back(words), "words string, toxic int").collect())
    grammar = learn_stems([(w.split(" ") if w else [], y) for y, w in found])
    del found
    held = documents.sparkSession.sparkContext.broadcast(grammar.parts())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"evidence": [own.evidence(x or "").tolist() for x in batch.column("text").to_pylist()], "toxic": batch.column("toxic").cast(pa.int32())})

    weighed = sorted((r["toxic"], list(r["evidence"])) for r in rows.mapInArrow(giving_back(weigh), "evidence array<double>, toxic int").collect())
    return fit_kinds(grammar, [(e, y) for y, e in weighed])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with the prior weights, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    prior, held = np.append(PRIOR, PRIOR_INTERCEPT), np.append(np.full(len(PRIOR), PRIOR_STRENGTH), 0.01)
    w = prior.copy()

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (held * (v - prior) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        slope = a.T @ (p - y) + held * (w - prior)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(held), slope)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample ``text, toxic``: labelled ids by hash, at most
    ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``, and one whole text of each."""
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    rows = marked.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    slots = F.when(F.col("toxic") == 1, SAMPLE_TOXIC).otherwise(SAMPLE_CLEAN)
    chosen = rows.groupBy("toxic", F.pmod(F.col("h"), slots).alias("slot")).agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id"))
    picked = chosen.select("doc_id", "toxic")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def scored(documents: DataFrame, grammar: Grammar, columns: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``columns`` of the documents with the score and the prediction, named ``names``."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(grammar.parts())
    # columns by place, as names may hold anything
    schema = "".join(f"c{k} {documents.schema[c].dataType.simpleString()}, " for k, c in enumerate(columns)) + "score double, predicted int"
    types = arrow_types(documents, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scores = [own.score(x or "") for x in batch.column(len(columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=types)

    placed = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col("text").alias("scored"))
    return placed.mapInArrow(giving_back(work), schema).toDF(*columns, *names)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    grammar = trained(documents, labels)
    return scored(documents, grammar, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns."""
    grammar = trained(documents, labels)
    names = tuple(f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("score", "predicted"))  # no column is called so
    return scored(documents, grammar, documents.columns, names).filter(f"{names[1]} = 0").drop(*names)
