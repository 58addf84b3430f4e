import math
import random

import numpy as np

from facetry.llm import langid

SYLLABLES = {"aa": "the and ing on er ti".split(), "bb": "der ung sch ein ß ü".split(), "cc": "le eau oi é que ment".split()}


def corpus(n=300):
    draw = random.Random(2)
    out = []
    for k in range(n):
        lang = draw.choice(list(SYLLABLES))
        out.append((k, " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(10, 60))), lang))
    return out


def code_length(trained, lang, raw):
    """The definition, context by context."""
    counts: dict = {}
    for name, text in trained:
        if name == lang:
            for i in range(len(text)):
                for order in range(langid.ORDER + 1):
                    context = tuple([-1] * max(0, order - i)) + tuple(text[max(0, i - order) : i])
                    counts.setdefault(context, {}).setdefault(text[i], 0)
                    counts[context][text[i]] += 1
    seen = {b for _, t in trained for b in t}
    total = 0.0
    for i, b in enumerate(raw):
        def bits(order):
            if order < 0:
                return 8.0
            context = tuple([-1] * max(0, order - i)) + tuple(x if x in seen else -1 for x in raw[max(0, i - order) : i])
            own = counts.get(context)
            if not own:
                return bits(order - 1)
            n, distinct = sum(own.values()), len(own)
            return -math.log2(own[b] / (n + distinct)) if b in own else -math.log2(distinct / (n + distinct)) + bits(order - 1)

        total += bits(langid.ORDER)
    return total


def test_code_lengths_are_exact():
    trained = [(lang, text.encode()[:120]) for _, text, lang in corpus(12)]
    model = langid.PartialMatching.of(trained)
    texts = [b"the ung q", "ß eau 中".encode(), b"", b"x", b"theandtheand"]
    found = model.lengths(texts)
    for k, raw in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert abs(found[k, j] - code_length(trained, lang, raw)) < 1e-3, (raw, lang)


def test_held_out_accuracy(spark, frame):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (903, "the and " * 40000, "aa"), (None, "the ing", "aa"), (903, "the and " * 40000, "aa")]
    got = langid.identify(frame(rows + extra, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {k: lang for k, _, lang in rows}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 60 and all(r["lang_pred"] == truth[r["doc_id"]] for r in tested)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (900, 901, 902)}
    assert odd == {900: ("und", 0.0), 901: ("und", 0.0), 902: ("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = frame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).count() == 0
    assert langid.identify(frame([(1, "the", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"


def test_long_texts_in_parts():
    model = langid.PartialMatching.of([(lang, text.encode()) for _, text, lang in corpus(20)])
    text = ("the und eau " * 120_000).encode()
    whole = model.lengths([text])[0]
    cut = (1 << 20) - 7
    parts = model.lengths([text[:cut]])[0]
    assert len(text) > 1 << 20 and (parts < whole).all()
    assert np.allclose(whole / len(text), parts / cut, rtol=1e-3)


def test_sample_is_whole_texts(spark, frame):
    """A language that shows beyond any prefix is learned; counts equal those in memory."""
    rows = [(k, "x" * 30_000 + text, lang) for k, text, lang in corpus(40)]
    docs = frame(rows + rows[:5], "doc_id long, text string, lang string")
    picked = langid.sample(docs)
    texts = [(r["lang"], r["text"].encode()) for r in picked.collect()]
    assert max(len(t) for _, t in texts) > 30_000 and len(set(texts)) == len(texts)
    one, two = langid.counts_of(picked), {x: langid.merged_counts([np.unique(langid.byte_runs(t), return_counts=True) for lang, t in texts if lang == x]) for x in {lang for lang, _ in texts}}
    assert set(one) == set(two)
    for x, (codes, n) in one.items():
        order = np.argsort(codes)
        assert (codes[order] == two[x][0]).all() and (n[order] == two[x][1]).all()
