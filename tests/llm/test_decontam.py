import hashlib
import re

from facetry.llm import decontam


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for k, text in docs:
        w, hit, found = words_of(text), set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((k, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def fixture(words):
    passage = " ".join(words[:40])
    items = [(1, passage), (2, " ".join(words[10:30])), (10, "Short, ITEM!"), (3, None), (4, "..."), (5, "Straße über 9")]
    docs = [(1, passage.upper()), (2, " ".join(words[100:300]) + ", " + " ".join(words[12:26]) + "! " + " ".join(words[300:399])), (3, None), (4, ""), (5, "a short-item b short item"), (6, " ".join(words[:12])), (7, " ".join(words[:13] * 3)), (1, passage), (None, "STRASSE straße ÜBER über 9"), (8, "x " * 30000 + passage), (9, "straße über 9"), (9, "straße über 9")]
    return docs, items


def test_contamination_by_brute_force(spark, frame, words):
    docs, items = fixture(words)
    bench = frame(items, "item_id long, text string")
    got = decontam.contamination(frame(docs), bench)
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()), key=repr)
    assert rows == brute(docs, items)
    assert decontam.contamination(frame([]), bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(frame(docs), bench.limit(0)).collect()} == {0}


def test_main_path_has_no_python(spark, frame, words):
    docs, items = fixture(words)
    plan = decontam.contamination(frame(docs), frame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shuffled_join_gives_the_same(spark, frame, words):
    docs, items = fixture(words)
    bench = frame(items, "item_id long, text string")
    got = decontam.contamination(frame(docs), bench, broadcast_bytes=-1)
    assert sorted(map(str, decontam.remove_contaminated(frame(docs), bench, broadcast_bytes=-1).collect())) == sorted(map(str, decontam.remove_contaminated(frame(docs), bench).collect()))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()), key=repr) == brute(docs, items)


def test_removal(spark, frame, words):
    docs, items = fixture(words)
    bench = frame(items, "item_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in decontam.remove_contaminated(frame(docs), bench).collect()}
    flagged = {(k, n) for k, n, _, _, _, bad in brute(docs, items) if bad}
    clean = {(k, t) for k, t in docs if (k, len(words_of(t))) not in flagged and not any(b[2] for b in brute([(k, t)], items))}
    assert clean <= kept
    rest = kept - clean
    assert sorted(k for k, _ in rest) == [2, 8] and not any(b[2] for b in brute(list(rest), items))
    assert dict(rest)[8].startswith("x x x") and dict(rest)[2].endswith(words[398])


def test_columns_of_any_name_pass_through(spark, frame, words):
    docs, items = fixture(words)
    names = ["_id", "_digest", "_text_digest", "_n_hit", "_spans", "start", "rows", "key", "at", "w", "m", "size", "window", "a.b"]
    wide = frame(docs)
    for k, name in enumerate(names):
        wide = wide.withColumn(name, wide.doc_id * 100 + k)
    bench = frame(items, "item_id long, text string")
    kept = decontam.remove_contaminated(wide, bench)
    assert kept.columns == wide.columns
    for row in kept.collect():
        assert [row[name] for name in names] == [None if row["doc_id"] is None else row["doc_id"] * 100 + k for k in range(len(names))]
    assert decontam.contamination(wide, bench).count() == len(docs)
