"""A reader for ARFF text: numeric and nominal attributes, the last one the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ARFF file with typed columns. Data lines are parsed by Spark; the
    header (lines before ``@data``) is read by the driver."""
    lines = spark.read.text(path)
    header = [r["value"].strip() for r in lines.filter(F.lower(F.trim("value")).startswith("@attribute")).collect()]
    names, kinds = [], []
    for line in header:
        rest = line.split(None, 1)[1].strip()
        if rest[0] in "'\"":
            name, _, kind = rest[1:].partition(rest[0])
        else:
            name, _, kind = rest.partition("{") if "{" in rest.split()[0] else rest.partition(rest.split()[0])[1:2] + ("", rest[len(rest.split()[0]) :])
        names.append(name.strip())
        kinds.append("double" if kind.strip().lower() in ("numeric", "real", "integer") else "string")
    body = lines.filter(~F.trim("value").rlike(r"^(@|%|$)")).select(F.from_csv(F.trim("value"), ", ".join(f"c{k} string" for k in range(len(names))), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    cell = lambda k: F.when(F.col(f"r.c{k}") != "?", F.col(f"r.c{k}"))
    return body.select(*[cell(k).cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))])


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result: parquet, csv, json or orc."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
