import pytest
from pyspark.sql import functions as F

from facetry.functions.scoring import score_frame
from facetry.operators.relative import relative
from facetry.sources.arff import read_arff, write_table
from facetry.streaming import windows


def test_arff(spark, tmp_path):
    path = tmp_path / "x.arff"
    path.write_text("% comment\n@RELATION r\n@attribute 'a b' numeric\n@ATTRIBUTE kind {x, 'y z'}\n@data\n1.5, x\n?, 'y z'\n\n% end\n-2,x\n")
    rows = read_arff(spark, str(path))
    assert rows.columns == ["a b", "kind"] and rows.dtypes[0][1] == "double"
    assert sorted(map(tuple, rows.collect()), key=repr) == [(-2.0, "x"), (1.5, "x"), (None, "y z")]
    write_table(rows, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    with pytest.raises(ValueError):
        write_table(rows, str(tmp_path / "out"), "xls")


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("b", "a")], "y string, p string")
    assert score_frame(df, "y", "p") == pytest.approx(0.6)
    assert score_frame(df, "y", "p", "balanced-accuracy") == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert score_frame(df, "y", "p", "f1") == pytest.approx((2 * 2 * 1 / 4 + 3 * 2 * 2 / 6) / 5)
    with pytest.raises(NotImplementedError):
        score_frame(df, "y", "p", "kappa")


def test_relative(spark):
    df = spark.createDataFrame([("a.mean", 2.0), ("b.mean", 1.0), ("c.mean", 2.0), ("a.sd", 5.0)], "name string, value double")
    assert {r["name"]: r["value"] for r in relative(df).collect()} == {"a.mean.relative": 2.5, "b.mean.relative": 1.0, "c.mean.relative": 2.5, "a.sd.relative": 1.0}


def test_windows(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, made in (("m", windows.windowed_moments(stream, "ts", "v")), ("c", windows.windowed_class_counts(stream, "ts", "k")), ("e", windows.windowed_class_entropy(stream, "ts", "k", ["a", "b"]))):
        query = made.writeStream.outputMode("complete").format("memory").queryName(f"w_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    first = spark.table("w_m").orderBy("start").first()
    assert first["n"] == 60 and first["mean"] == pytest.approx(sum(k % 7 for k in range(60)) / 60)
    assert {r["n"] for r in spark.table("w_c").collect()} == {30, 10}
    assert all(r["entropy"] == pytest.approx(1) for r in spark.table("w_e").collect())
