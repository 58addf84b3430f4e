import random
import zlib

import numpy as np

from facetry.llm import toxicity as tx


def corpus(words, n=400):
    draw = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(5, 40))]
        bad = draw.random() < 0.3
        if bad:
            text.insert(draw.randrange(len(text)), draw.choice(["idiot", "scum", "zorgab" + draw.choice(words)]))
        rows.append((k, " ".join(text) + "."))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, frame, words):
    rows, labels = corpus(words)
    docs = frame(rows + [(None, None), (5000, ""), (5001, "clean " * 30000), (5001, "clean " * 30000)])
    marks = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tx.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {k: y for k, _, y in labels}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    kept = tx.keep_clean(docs, marks)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {r["doc_id"] for r in got if r["predicted"]}
    assert tx.toxicity(docs.limit(0), marks).count() == 0
    assert tx.toxicity(docs, marks.limit(0)).count() == len(rows) + 4


def test_grammar_scores_clauses():
    g = tx.learn([])
    plain, negated, said = (g.score(x) for x in ("You idiot.", "He is not an idiot.", "She said idiot."))
    assert plain > 0.5 and plain > negated and plain > said
    assert g.score("idiotic") == g.score("") == g.score("all is well. here and there!")
    assert g.clause(tx.plain("you are an idiot"), 0)[0] == 1 and g.clause(tx.plain("idiot that"), 0)[0] == 0
    assert g.clause(tx.plain("they will kill him"), 1)[0] == 1 and g.clause(tx.plain("they will kill him"), 0) is None
    assert g.score("I will kill you") > 0.5 > g.score("she said nobody would kill")
    assert g.score("IDIOT\n\nidiot!") > g.score("idiot")


def test_stems_are_learned(words):
    rows, labels = corpus(words)
    g = tx.learn([(t, y) for (_, t), (_, _, y) in zip(rows, labels, strict=True)])
    assert any("zorgab".startswith(s) or s.startswith("zorgab") for s in g.lexicons[0].stems)
    assert g.score("zorgabnew ba ko") > 0.5


def test_all_matched_clauses_count():
    """Many reported matches hide no later one, and matches after the fiftieth count."""
    g = tx.learn([])
    many = "She said idiot. " * 60
    assert g.evidence(many + "You idiot.")[1] == g.evidence("You idiot.")[1] > 0
    assert abs(g.evidence("Idiot. " * 300)[0] / g.evidence("Idiot.")[0] - sum(1 / n for n in range(1, 301))) < 1e-9
    g.kinds = tx.PRIOR * [1, 1, 0, 0, 1, 1, 0, 0]
    assert g.score(many + "You idiot.") == g.score("You idiot.") > 0.5


def strongest(tokens, stems, kinds):
    """The strongest match of a clause by trying all of them."""
    found = []
    for k, token in enumerate(tokens):
        own = [w for s, w in stems.items() if (token == s[:-1] if s.endswith(" ") else token.startswith(s))]
        if not own:
            continue
        before = tokens[max(0, k - tx.REACH) : k + 1]
        if set(tokens[: k + 1]) & set(tx.REPORTS):
            kind = 3
        elif set(before) & set(tx.NEGATIONS):
            kind = 2
        elif set(before + tokens[k + 1 : k + 1 + tx.REACH]) & set(tx.TARGETS):
            kind = 1
        else:
            kind = 0
        found.append((kinds[kind] * max(own), max(own), -kind))
    return (-max(found)[2], max(found)[1]) if found else None


def test_best_paths_by_enumeration():
    draw = random.Random(11)
    insults, threats = {"idiot ": 2.0, "idi": 1.0, "scum": 3.0, "you ": 0.5}, {"kill": 2.5, "not ": 0.3}
    g = tx.Grammar(insults, threats)
    some = ["idiot", "idiom", "scummy", "kill", "killer", "you", "them", "not", "never", "said", "told", "the", "a", "x", "tree"]
    for _ in range(4000):
        g.kinds = np.array([draw.choice([0.0, 0.5, 1.0, 1.5]) for _ in range(8)])
        tokens = [draw.choice(some) for _ in range(draw.randint(0, 9))]
        for which, stems in enumerate((insults, threats)):
            assert g.clause(tx.plain(" ".join(tokens)), which) == strongest(tokens, stems, g.kinds[4 * which :])


def test_composition_is_of_all_machines():
    """The composed machine accepts what the machines accept one after the other."""
    draw = random.Random(3)
    parts = [tx.target_marks(), tx.negation_marks(), tx.report_marks(), tx.picked_match()]

    def paths(machine, word):
        ends = [(0, (), ())]
        for x in word:
            ends = [(to, out + (y,), kinds + ((k,) if k >= 0 else ())) for s, out, kinds in ends for to, y, k in machine.arcs[s, x]]
        return {(out, kinds) for s, out, kinds in ends if s in machine.finals}

    for _ in range(150):
        word = tuple(draw.randrange(16) for _ in range(draw.randint(1, 5)))
        row = {(word, ())}
        for part in parts:
            row = {(out, kinds + more) for x, kinds in row for out, more in paths(part, x)}
        assert paths(tx.MACHINE, word) == row


def test_whole_texts_are_learned(spark, frame, words):
    """Words beyond any prefix of a training text count; of rows of one id one counts."""
    filler = "filler " * 20_000
    rows = [(k, (filler if k % 2 else "") + words[k % 50] + (" qzorg." if k % 3 == 0 else " .")) for k in range(60)]
    rows += [(0, "another text of this id")] * 3
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    assert tx.sample(frame(rows), labels).count() == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(60))
    grammar = tx.trained(frame(rows), labels)
    assert any(s.startswith("qzo") for s in grammar.lexicons[0].stems)
