import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_by_stages(spark, words, tmp_path):
    """Each stage's effect on a small corpus with planted cases."""
    draw = random.Random(9)
    base = {k: " ".join(draw.choice(words) for _ in range(80)) for k in range(150)}
    passage = " ".join(draw.choice(words) for _ in range(40))
    docs, labels = [], []
    for k, text in base.items():
        bad = k % 5 == 1
        docs.append((k, text + (" you idiot scum." if bad else ""), "en", "s", len(text)))
        labels.append((k, 1, int(bad)))
    docs += [(1000, base[0], "en", "s", 1), (1001, base[2] + " more", "en", "s", 1), (1002, base[3] + " " + passage, "en", "s", 1), (1003, "alone mail me at some.one@mail.example.com now", "en", "s", 1), (1004, None, "en", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r for r in frame.collect()}
        if name != "best_fit_packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {k for k in base if k % 5 == 1}
    assert set(seen["toxicity"]) == {d[0] for d in docs} - toxic
    assert set(seen["ngram_jaccard_join"]) == set(seen["toxicity"]) - {1000, 1001}
    assert set(seen["benchmark_decontamination"]) == set(seen["ngram_jaccard_join"]) - {1002}
    assert "some.one@" not in seen["pii"][1003]["text"] and seen["pii"][5]["text"] == base[5]
    assert set(seen["best_fit_packing"]) == set(seen["pii"])
    again = pipeline.run(spark, folder)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, again.collect())) == sorted(map(key, frame.collect()))


def test_stage_links_at_five_words_and_four_fifths(spark, words):
    draw = random.Random(4)
    base = [draw.choice(words) for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [draw.choice(words) for _ in range(18)])), (3, " ".join(base[:70]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_odd_rows_and_columns(spark, words, tmp_path):
    """Nulls, repeated rows, rows without ids, long texts and columns of any name go
    through all stages; empty tables give empty ones."""
    draw = random.Random(6)
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    same, long = text(50), text(30_000)
    rows = [(1, same), (1, same), (2, None), (3, ""), (None, text(40)), (None, None), (4, long), (2**62, text(60)), (-5, "one")]
    names = ["_id", "_gone", "_digest", "score", "fp", "gid", "own", "n", "rep", "spans", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in names:
        docs = docs.withColumn(name, docs.doc_id)
    folder = str(tmp_path)
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for frame, size in ((docs, len(rows) - 1), (docs.limit(0), 0)):
        for k, (name, stage) in enumerate(pipeline.STAGES):
            before, frame = frame, stage(spark, frame, folder)
            frame.write.mode("overwrite").parquet(f"{folder}/{size}-{name}")
            frame = spark.read.parquet(f"{folder}/{size}-{name}")
            if name != "best_fit_packing":
                assert frame.columns == before.columns
                for r in frame.collect():
                    assert {r[x] for x in names} == {r["doc_id"]}
        got = sorted((str(r["doc_id"]), r["piece"]) for r in frame.collect())
        assert len({k for k, _ in got}) == len({str(k) for k, _ in rows}) * bool(size)
        assert sum(p == 0 for _, p in got) == size
