import math

import numpy as np
import pytest

from facetry.plans import bootstrap
from facetry.plans import extractor as X
from facetry.plans.data import Data, order_statistics
from facetry.plans.registry import MEASURES


@pytest.fixture(scope="module")
def flowers(spark):
    """Three groups of rows in four columns, one of them of words."""
    draw = np.random.RandomState(4)
    rows = []
    for k in range(90):
        c = k % 3
        rows.append((k, float(draw.normal(c, 1)), float(abs(draw.normal(2 * c, 1))), ["red", "blue", "green"][(c + (draw.rand() < 0.2)) % 3], f"k{c}"))
    return spark.createDataFrame(rows, "id long, a double, b double, colour string, kind string")


def test_registry_is_complete():
    assert len(MEASURES) == 105
    sizes = {g: sum(x == g for x, _ in MEASURES) for g in X.GROUPS}
    assert sizes == {"general": 11, "statistical": 29, "info-theory": 8, "model-based": 14, "landmarking": 7, "clustering": 8, "complexity": 22, "itemset": 2, "concept": 4, "relative": 0}


def test_all_groups_extract(flowers):
    e = X.Extractor("all", summary=["mean", "sd"], random_state=3, suppress_warnings=True).fit(flowers, "kind", row_id="id")
    got = {r["name"]: r["value"] for r in e.extract().collect()}
    assert set(got) == set(e.extract_metafeature_names())
    assert got["nr_inst"] == 90 and got["nr_class"] == 3 and got["nr_num"] == 2 and got["nr_cat"] == 1
    pdf = flowers.toPandas()
    assert got["mean.mean"] == pytest.approx(np.mean([pdf.a.mean(), pdf.b.mean(), *[(pdf.colour == c).mean() for c in ("blue", "green", "red")]]))
    assert 0 < got["naive_bayes.mean"] <= 1 and got["one_nn.mean.relative"] in np.arange(1, 7.5, 0.5)
    failed = [k for k, v in got.items() if v is None or math.isnan(v)]
    assert all(k.split(".")[0] in ("sd_ratio", "cat_to_num", "g_mean", "h_mean", "skewness", "kurtosis", "f1v") or k.endswith(".sd") for k in failed), failed


def test_selection():
    assert X.check_groups("relative") == ("landmarking", "relative")
    with pytest.raises(ValueError):
        X.check_groups(["general", "nope"])
    with pytest.warns(UserWarning):
        X.Extractor("general", ["nr_inst", "nope"])
    with pytest.raises(ValueError):
        X.Extractor(summary=["nope"])
    with pytest.raises(NotImplementedError):
        X.Extractor(score="auc")
    with pytest.raises(ValueError):
        X.Extractor(lm_sample_frac=0.4)
    with pytest.raises(TypeError):
        X.Extractor().extract()
    assert "nr_inst" in X.valid_metafeatures("general") and len(X.valid_summary()) == 32
    assert X.parse_by_group("general", ["nr_inst", "cor.mean"]) == ["nr_inst"]
    assert all(d for *_, d in X.metafeature_description())


def test_unsupervised_and_raw_values(flowers):
    e = X.Extractor(["general", "statistical"], ["mean", "freq_class", "nr_attr"], summary=[], suppress_warnings=True).fit(flowers.drop("kind"), None, row_id="id", encode=None)
    got = {r["name"]: r["value"] for r in e.extract().collect()}
    assert set(got) == {"mean.a", "mean.b", "nr_attr"} and got["nr_attr"] == 3


def test_encodings_and_errors(flowers, spark):
    count = lambda kind: Data(flowers, "kind", row_id="id", encode=kind).d
    assert [count(k) for k in ("gray", "one-hot", "one-hot-full", None)] == [5, 4, 5, 2]
    with pytest.raises(ValueError):
        Data(flowers, encode="nope")
    with pytest.raises(ValueError):
        Data(flowers, rescale="nope")
    holes = spark.createDataFrame([(1, "a"), (2, None)], "id long, c string")
    with pytest.raises(ValueError):
        _ = Data(holes, None, row_id="id").numeric_names
    scaled = Data(flowers, "kind", row_id="id", rescale="standard", encode=None)
    assert all(abs(m["mean"]) < 1e-9 and abs(m["var"] - 1) < 1e-9 for m in scaled.moments.values())


def test_order_statistics(spark, monkeypatch):
    from facetry.plans import data as module

    draw = np.random.RandomState(0)
    x = np.concatenate([draw.normal(0, 1e6, 3000).round(2), np.zeros(500), [-0.0, 1e300, -1e300]])
    df = spark.createDataFrame([(float(v), float(abs(v)) if k % 7 else None) for k, v in enumerate(x)], "a double, b double")
    from pyspark.sql import functions as F

    shares = [0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1]
    kept = np.abs(x)[np.arange(len(x)) % 7 != 0]
    for bracket in (10**6, 5):
        monkeypatch.setattr(module, "BRACKET", bracket)
        got = order_statistics(df, {"a": F.col("a"), "b": F.col("b")}, shares)
        assert got["a"] == pytest.approx(np.quantile(x, shares)) and got["b"] == pytest.approx(np.quantile(kept, shares))


def test_bootstrap(flowers):
    e = X.Extractor("statistical", ["mean"], summary=["mean"], suppress_warnings=True, random_state=1).fit(flowers, "kind", row_id="id", attributes=["a"])
    rows = e.extract_with_confidence(sample_num=6, confidence=[0.5, 0.9]).collect()
    assert len(rows) == 2 and all(r["low"] <= r["high"] for r in rows)
    assert rows[0]["high"] - rows[0]["low"] <= rows[1]["high"] - rows[1]["low"]
    with pytest.raises(ValueError):
        e.extract_with_confidence(2, confidence=1.0)
    rows = bootstrap.numbered(e.data)
    n = bootstrap.replicate(rows, 90, "id", 1, 7)
    assert n.columns == flowers.columns and n.select("id").distinct().count() == n.count() == 90
    drawn = [r["a"] for r in n.collect()]
    assert set(drawn) < {r["a"] for r in flowers.collect()} and 40 < len(set(drawn)) < 75
    again = bootstrap.replicate(bootstrap.numbered(e.data.derive(flowers.repartition(5))), 90, "id", 1, 7)
    assert sorted(drawn) == sorted(r["a"] for r in again.collect())


def test_bootstrap_of_any_ids(spark):
    wide = spark.createDataFrame([(2**62 + k, float(k), "ab"[k % 2]) for k in range(12)] + [(-(2**62), 1.0, "a")], "id long, a double, kind string")
    e = X.Extractor("statistical", ["mean"], summary=["mean"], suppress_warnings=True).fit(wide, "kind", row_id="id")
    assert e.extract_with_confidence(sample_num=2).count() == 1


def test_bounds_are_no_missing_values(flowers, monkeypatch):
    from facetry.operators import complexity, modelbased
    from facetry.plans.registry import TooLarge

    monkeypatch.setattr(complexity, "MAX_TASK_ROWS", 10)
    monkeypatch.setattr(modelbased, "MAX_EXACT_ROWS", 10)
    for group, name in (("complexity", "n1"), ("complexity", "l1"), ("model-based", "leaves")):
        with pytest.raises(TooLarge):
            X.Extractor(group, [name], suppress_warnings=True).fit(flowers, "kind", row_id="id").extract()
    binned = X.Extractor("model-based", ["leaves"], suppress_warnings=True, hypparam_model_dt={"kind": "binned"}).fit(flowers, "kind", row_id="id")
    assert binned.extract().first()["value"] > 2


def test_output_forms(flowers, capsys):
    import pandas as pd

    e = X.Extractor("general", summary=["mean", "sd"], suppress_warnings=True).fit(flowers, "kind", row_id="id")
    names, found = e.extract(out_type=tuple)
    assert e.extract(out_type=dict) == {"name": names, "value": found} and len(names) == len(found) > 8
    wide = e.extract(out_type=pd.DataFrame)
    assert list(wide.columns) == names and wide.iloc[0].tolist() == pytest.approx(found)
    assert not capsys.readouterr().out
    e.extract(verbose=2)
    assert "100 %" in (said := capsys.readouterr().out) and "general.nr_inst" in said
    with pytest.raises(TypeError):
        e.extract(out_type=list)
    for kind in ("avg", "avg_summ", "total", "total_summ"):
        timed = X.Extractor("general", summary=["mean", "sd"], measure_time=kind, suppress_warnings=True).fit(flowers, "kind", row_id="id")
        parts = timed.extract(out_type=tuple)
        assert len(parts) == 3 and all(t >= 0 for t in parts[2])
    assert len(timed.extract_with_confidence(2, out_type=dict)) == 6
    with pytest.raises(ValueError):
        X.Extractor(measure_time="often")


def test_rescaling_arguments(flowers):
    of = lambda kind, **given: Data(flowers, "kind", row_id="id", encode=None, attributes=["a", "b"], rescale=kind, rescale_args=given)
    plain = Data(flowers, "kind", row_id="id", encode=None, attributes=["a", "b"]).moments["a"]
    moments = of("min-max", feature_range=(-2, 3)).moments
    assert all(m["min"] == pytest.approx(-2) and m["max"] == pytest.approx(3) for m in moments.values())
    assert of("standard", with_mean=False).moments["a"]["mean"] == pytest.approx(plain["mean"] / plain["var"] ** 0.5)
    assert of("standard", with_std=False).moments["a"]["var"] == pytest.approx(plain["var"])
    robust = of("robust", quantile_range=(10.0, 90.0))
    low, high = robust.quantiles((0.1, 0.9))["a"]
    assert high - low == pytest.approx(1)
    assert of("robust", with_scaling=False).quantiles((0.5,))["a"] == pytest.approx([0])
    with pytest.raises(ValueError):
        of("standard", feature_range=(0, 1))


def test_contingency(flowers, monkeypatch):
    """Counts of pairs of category columns, by pandas."""
    data = Data(flowers, "kind", row_id="id")
    pdf = flowers.toPandas()
    for c in ("a", "b"):
        pdf[c] = [str(int(sum(cut < v for cut in data.cuts[c]))) for v in pdf[c]]
    got = {(r["a"], r["b"], r["x"], r["y"]): r["n"] for r in data.contingency([("a", "b"), ("colour", "a"), ("b", None)]).collect()}
    want = {}
    for a, b, column in (("a", "b", "b"), ("colour", "a", "a"), ("b", None, "kind")):
        for (x, y), n in pdf.groupby([a, column]).size().items():
            want[a, b, x, y] = n
    assert got == want


def test_model_extraction(flowers):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(StringIndexer(inputCol="kind", outputCol="label").fit(flowers).transform(flowers))
    model = DecisionTreeClassifier(maxDepth=3).fit(rows)
    e = X.Extractor("model-based", summary=["mean"], suppress_warnings=True)
    got = {r["name"]: r["value"] for r in e.extract_from_model(model, flowers).collect()}
    assert got["leaves"] == got["nodes"] + 1 == (model.numNodes + 1) / 2
    with pytest.raises(TypeError):
        e.extract_from_model("tree")


def test_shared_jobs_ahead(flowers):
    e = X.Extractor(["general", "statistical", "clustering", "concept"], ["freq_class", "mean", "sil", "wg_dist"], summary=["mean"], suppress_warnings=True)
    lazy = e.fit(flowers, "kind", row_id="id").extract(out_type=dict)
    assert e.time_extract > 0 and e.time_total >= e.time_extract
    ahead = e.fit(flowers, "kind", precomp_groups="all", row_id="id")
    assert e.time_precomp > 0 and set(ahead.data.__dict__["_statistics"]) == {("euclidean", 2.0, False, None), ("euclidean", 2.0, True, (2.0, 1.0, 1e-9))}
    assert ahead.extract(out_type=dict) == lazy
    assert len(ahead.data.__dict__["_statistics"]) == 2  # one pass for each kind of distance
