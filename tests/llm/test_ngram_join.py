import random
import re
from collections import Counter

import numpy as np

from facetry.llm import ngram_join as nj


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Sizes and least reachable id by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                above[root(i)] = root(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ids, default=None) if sets[i] else k))
    return Counter(out)


def corpus(words):
    draw = random.Random(11)
    passage = [draw.choice(words) for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "two  WORDS"), (8, "two words"), (None, "one"), (None, "alone here now ok")]
    k = 10
    for _ in range(30):
        base = [draw.choice(words) for _ in range(draw.choice([5, 30, 120, 400]))] + passage * draw.randint(0, 1)
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows.append((k, " ".join(draw.choice(words) for _ in range(30000))))
    rows.append(rows[20])
    draw.shuffle(rows)
    return rows


def test_classes_by_brute_force(spark, frame, words):
    rows = corpus(words)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.classes(frame(rows)).collect())
    assert got == brute(rows)
    assert nj.classes(frame([])).count() == 0
    assert nj.classes(frame([(1, None)])).collect()[0]["component_id"] == 1


def test_split_groups_lose_nothing(spark, frame, words, monkeypatch):
    """Tiny groups and query parts give the same classes."""
    monkeypatch.setattr(nj, "GROUP_SIZE", 2)
    monkeypatch.setattr(nj, "QUERY_SIZE", 3)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(nj, "TOKEN_ROWS", 2)
    monkeypatch.setattr(nj, "TOKEN_PARTS", 3)
    rows = corpus(words)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.classes(frame(rows)).collect())
    assert got == brute(rows)


def test_keep_one(spark, frame, words):
    rows = corpus(words)
    kept = nj.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = Counter()
    for (k, text), (_, n, component) in {r: next(b for b in brute(rows) if b[0] == r[0] and b[1] == len(shingle_set(r[1]))) for r in rows}.items():
        if n == 0 or k is None or k == component:
            want[k, text] = 1
    assert got == want


def test_shingles_are_exact_sets(words):
    texts = [" ".join(words), "a b", "b a", "a", "", "A b C d", "x " * 1000]
    for text, found in zip(texts, nj.shingles(texts), strict=True):
        assert len(found) == len(shingle_set(text)) and (np.diff(found.astype(object)) > 0).all()
    assert not set(nj.shingles(["a b"])[0]) & set(nj.shingles(["b a"])[0])


def test_histogram_bound():
    draw = np.random.RandomState(0)
    a, b = (np.unique(draw.randint(0, 2**63, n).astype(np.uint64)) for n in (300, 900))
    b = np.unique(np.concatenate([b, a[:100]]))
    one, two = (np.frombuffer(nj.histogram(x), "<u2").astype(int) for x in (a, b))
    size = min(len(one), len(two))
    assert np.minimum(nj.folded(one, size), nj.folded(two, size)).sum() >= 100


def test_components(spark):
    links = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "f"), ("c", "g"), ("h", "g"), ("e", "d")]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in links], "a binary, b binary")
    got = {bytes(r["v"]).decode(): bytes(r["root"]).decode() for r in nj.components(df).collect()}
    assert got == {"b": "a", "c": "a", "g": "a", "h": "a", "e": "d"}
    assert nj.components(df.limit(0)).count() == 0


def test_size_and_similarity_are_parameters(spark, frame, words):
    """Five words and 0.8 by brute force, other than three words and 0.9."""
    draw = random.Random(3)
    rows = []
    for k in range(40):
        base = [draw.choice(words) for _ in range(draw.choice([4, 60, 200]))]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base + [draw.choice(words) for _ in range(len(base) * draw.choice([0, 5, 18, 24, 30]) // 100)])))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for _, t in rows)]
    want = {(k, rows[k & ~1][0] if 100 * len(sets[k] & sets[k & ~1]) >= 80 * len(sets[k] | sets[k & ~1]) else k) for k, _ in rows}
    got = {(r["doc_id"], r["component_id"]) for r in nj.classes(frame(rows), 5, (80, 100)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in nj.keep_one(frame(rows), size=5, similarity=(80, 100)).collect()}
    assert kept == {k for k, c in want if k == c} < {r["doc_id"] for r in nj.keep_one(frame(rows)).collect()}


def near_copies(words, count):
    """A text and copies of it with one or two words of their own, which link with the text
    and mostly not with each other; and texts apart."""
    draw = random.Random(count)
    base = [draw.choice(words) + str(k) for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, count):
        copy = list(base)
        for _ in range(draw.choice([1, 1, 2])):
            copy[draw.randrange(len(copy))] = f"own{k}x{draw.randrange(9)}"
        rows.append((k, " ".join(copy)))
    return rows + [(count + k, " ".join(draw.choice(words) for _ in range(90))) for k in range(20)]


def test_large_families(spark, frame, words, monkeypatch):
    """Twenty times GROUP_SIZE near copies: no group holds more, what is asked grows with
    the rows and not with their square, and the classes are whole."""
    monkeypatch.setattr(nj, "GROUP_SIZE", 64)
    similarity, asked, largest = (90, 100), [], []
    for count in (640, 1280):
        rows = near_copies(words, count)
        docs = frame(rows)
        entries = nj.settled(nj.entries_of(nj.signatures(docs, 3, similarity)))
        grouped = nj.settled(nj._grouped(entries, nj._roots(nj._families(docs, entries, 3, similarity)), similarity))
        largest.append(max(r["count"] for r in grouped.groupBy("gid").count().collect()))
        asked.append(nj._asked(grouped, similarity).count())
    assert max(largest) <= 64
    assert asked[0] <= 2 * 660 and asked[1] <= 2 * 1300
    got = {r["doc_id"]: r["component_id"] for r in nj.classes(docs).collect()}
    assert got == {k: 0 if k < count else k for k, _ in rows}


def test_memory_of_a_group():
    """An open group takes at most 48 bytes a shingle beside the members' own arrays."""
    import tracemalloc

    draw = np.random.default_rng(1)
    members = [(k.to_bytes(2, "big"), np.unique(draw.integers(0, 2**63, 500).astype(np.uint64))) for k in range(500)]
    tracemalloc.start()
    try:
        group = nj._Group(members, (90, 100))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(group.union) == 250_000
    assert most < 48 * 250_000


def test_texts_are_sent_in_small_batches(spark, monkeypatch):
    """All texts of a table of large rows never meet in one batch, and the session's own
    setting is as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, sign = spark.conf.get(name), [], nj.signatures
    monkeypatch.setattr(nj, "signatures", lambda *a: seen.append(spark.conf.get(name)) or sign(*a))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in nj.classes(docs).collect()} == {(1, 1), (2, 1)}
    assert seen == [str(4 << 20)] and spark.conf.get(name) == before
