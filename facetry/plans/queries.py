"""The registered queries: every measure on a driver table, the summaries, transforms,
relative ranks, bootstrap, streaming and extraction, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import summaries as S
from facetry.functions.scoring import SCORES, score_frame
from facetry.operators.relative import relative
from facetry.plans.data import Data
from facetry.plans.extractor import Extractor, as_frame
from facetry.plans.registry import MEASURES
from facetry.session import drop_folder, settled, shared_folder
from facetry.sources.tables import table
from facetry.streaming import windows

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
PART = ["p_size", "p_retailprice", "p_brand"]
DIMENSIONS = 64


def lineitem(spark: SparkSession, sf_dir: str, **options) -> Data:
    return Data(table(spark, sf_dir, "lineitem"), "l_returnflag", LINE, **options)


def part(spark: SparkSession, sf_dir: str, **options) -> Data:
    return Data(table(spark, sf_dir, "part"), "p_type", PART, "p_partkey", **options)


def embeddings(spark: SparkSession, sf_dir: str, **options) -> Data:
    df = table(spark, sf_dir, "embeddings")
    wide = df.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(DIMENSIONS)])
    return Data(wide, "label", [f"e{k}" for k in range(DIMENSIONS)], "vec_id", **options)


def rounded(x: Column) -> Column:
    """Few enough digits that the order of sums doesn't show; NaN as null."""
    y = F.when(F.abs(x) >= 1e6, F.round(x, 0)).when(F.abs(x) >= 100, F.round(x, 3)).when(F.abs(x) >= 1, F.round(x, 6)).otherwise(F.round(x, 9))
    return F.when(~F.isnan(x), y + F.lit(0.0))


def _measure(data: Callable, group: str, name: str, **hyper) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = as_frame(spark, MEASURES[group, name].function(data(spark, sf_dir), **hyper))
        return found.select("key", rounded(F.col("value")).alias("value"))

    return query


HOMES = {"general": lineitem, "statistical": lineitem, "info-theory": lineitem, "itemset": lineitem, "model-based": part, "landmarking": part, "clustering": embeddings, "concept": embeddings, "complexity": embeddings}
#: Measures that need row ids or more columns than the group's usual table has.
OTHER_HOMES = {("statistical", "nr_norm"): part}


def _summary(name: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("v"))
        return S.summarise(rows, [name]).select("name", rounded(F.col("value")).alias("value"))

    return query


def transform_discretise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-frequency code of every row and column."""
    data = part(spark, sf_dir)
    codes = {c: x for c, x in data.categories.items() if c in data.numeric}
    return data.long(codes, None, "_id").select(F.col("_id").alias("p_partkey"), "key", F.col("v").alias("code"))


def _encoding(kind: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The encoded value of every row and level."""
        data = part(spark, sf_dir, encode=kind)
        levels = {c: x for c, x in data.encoded.items() if "=" in c}
        return data.long(levels, None, "_id").select(F.col("_id").alias("p_partkey"), "key", F.col("v").alias("value"))

    return query


def _rescaling(kind: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = Data(table(spark, sf_dir, "part"), "p_type", ["p_size", "p_retailprice"], "p_partkey", rescale=kind)
        rows = data.N.select("_id", F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"x{k}").alias("v")) for k, c in enumerate(data.numeric_names)])).alias("p"))
        return rows.select(F.col("_id").alias("p_partkey"), "p.key", rounded(F.col("p.v")).alias("value"))

    return query


def relative_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of mean prices by brand: the ranking alone, on a plain table."""
    rows = table(spark, sf_dir, "part").groupBy(F.concat(F.col("p_brand"), F.lit(".mean")).alias("name")).agg(F.round(F.avg("p_size"), 1).alias("value"))
    return relative(rows)


def relative_landmarking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarking results of all learners as relative ranks."""
    found = Extractor(["relative"], suppress_warnings=True)
    found.data = part(spark, sf_dir)
    return found.extract().select("name", rounded(F.col("value")).alias("value"))


def extract_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default groups with the default summaries."""
    found = Extractor(random_state=1, suppress_warnings=True)
    found.data = part(spark, sf_dir, seed=1)
    return found.extract().select("name", rounded(F.col("value")).alias("value"))


def bootstrap_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the class frequencies and the means of the numeric columns, from the
    default number of replicates."""
    found = Extractor(["general", "statistical"], ["freq_class", "mean"], summary=["mean", "sd"], suppress_warnings=True, random_state=1)
    found.data = Data(table(spark, sf_dir, "part"), "p_type", ["p_size", "p_retailprice"], "p_partkey", seed=1)
    return found.extract_with_confidence(confidence=[0.9, 0.95])


def _score(kind: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The score of a plain rule for the return flag."""
        said = F.when(F.col("l_quantity") > 30, "R").when(F.col("l_linestatus") == "O", "N").otherwise("A")
        rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), said.alias("said"))
        return as_frame(spark, score_frame(rows, "truth", "said", kind)).select("key", rounded(F.col("value")).alias("value"))

    return query


def _streamed(spark: SparkSession, sf_dir: str, make: Callable, keys: list[str]) -> DataFrame:
    """Run a stream over ``events`` to its end and return the last state of each key.

    Updates are written to the shared folder batch by batch, so windows behind the
    watermark leave the state store and nothing is held by the driver."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/events.parquet*")
    state, updates = shared_folder(spark, "stream-state"), shared_folder(spark, "stream-updates")

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own folder again
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{updates}/batch={number}")

    try:
        query = make(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        written = spark.read.parquet(f"{updates}/batch=*")
        rest = [c for c in written.columns if c not in keys]
        last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
        return settled(last.select(*keys, *[F.col(f"_last.{c}") for c in rest if c != "_batch"]))
    finally:
        drop_folder(spark, state)
        drop_folder(spark, updates)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def streaming_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _streamed(spark, sf_dir, lambda s: windows.windowed_moments(s, "ts", "value", "event_type", "1 day"), ["start", "event_type"])
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd", "min", "max")])


def streaming_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _streamed(spark, sf_dir, lambda s: windows.windowed_class_counts(s, "ts", "event_type", "1 day"), ["start", "class"])
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("class").alias("event_type"), "n")


QUERIES: dict[str, Callable] = {}
for (_group, _name), _m in sorted(MEASURES.items()):
    _home = OTHER_HOMES.get((_group, _name), HOMES[_group])
    QUERIES[f"{_group.replace('-', '_')}_{_name}"] = _measure(_home, _group, _name)
for _name in S.SUMMARIES:
    QUERIES[f"summary_{_name}"] = _summary(_name)
QUERIES["transform_discretise"] = transform_discretise
for _kind in ("gray", "one-hot", "one-hot-full"):
    QUERIES[f"transform_{_kind.replace('-', '_')}"] = _encoding(_kind)
for _kind in ("standard", "min-max", "robust"):
    QUERIES[f"rescale_{_kind.replace('-', '_')}"] = _rescaling(_kind)
for _kind in SCORES:
    QUERIES[f"score_{_kind.replace('-', '_')}"] = _score(_kind)
for _f in (relative_ranks, relative_landmarking, extract_default, bootstrap_confidence, streaming_moments, streaming_class_counts):
    QUERIES[_f.__name__] = _f
