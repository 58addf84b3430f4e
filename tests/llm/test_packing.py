import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_all_and_overfills_none(counts):
    used = Counter()
    for pattern, repeats in packing.plan(counts, 64):
        assert repeats > 0 and sum(k * n for k, n in pattern) <= 64
        for k, n in pattern:
            used[k] += n * repeats
    assert used == Counter(counts)


def test_plan_replaces_the_smallest_by_two():
    # greedy takes 6 and 3; 2 + 2 fit the gap of 4 better than 3
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([(6, 1), (2, 2)], 1)
    bins = sum(n for _, n in packing.plan({k: 1000 for k in range(1, 41)}, 100))
    assert bins <= -(-sum(range(1, 41)) * 1000 // 100) + 2


def test_plan_refuses_long_pieces():
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_tokenizer_equals_the_library(words):
    own = packing.tokenizer(packing.default_tokenizer())
    texts = [" ".join(words), "it's <|endoftext|> ΑΣ İ é 中文 x\x1cy don't!!", "", "a  b\tc\n", "|%%% ***"]
    for text, ids in zip(texts, own.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.inner.encode(text, add_special_tokens=False).ids


def test_packed_documents_by_brute_force(spark, frame, words):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (5, " ".join(words * 40))] + [(10 + k, " ".join(words[: k * 5])) for k in range(40)]
    found = packing.packed_documents(frame(rows)).collect()
    own = packing.tokenizer(packing.default_tokenizer())
    want = Counter()
    for k, text in rows:
        ids = np.append(np.frombuffer(own.ids([text or ""])[0], "<u4"), 1).astype("<u4")
        for i, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[k, i, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in found) // 4096) + 1
    assert packing.packed_documents(frame([])).count() == 0


def test_workers_keep_no_words(spark, words):
    """Python workers go on to other stages without the words of the texts they packed."""
    import pyarrow as pa

    docs = spark.createDataFrame([(k, " ".join(words)) for k in range(8)], "doc_id long, text string")
    assert packing.pieces(docs, packing.default_tokenizer()).count() == 8

    def known(batches):
        yield pa.RecordBatch.from_pydict({"known": pa.array([sum(len(x.known) for x in packing._TOKENIZERS.values())], pa.int64())})

    held = [r["known"] for r in spark.range(0, 16, 1, 8).mapInArrow(known, "known long").collect()]
    assert len(held) == 8 and not any(held)
