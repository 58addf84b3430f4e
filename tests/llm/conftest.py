import random

import pytest


@pytest.fixture(scope="session")
def words():
    """Invented words, always the same."""
    draw = random.Random(7)
    return ["".join(draw.choice(["ba", "ko", "mi", "ru", "te", "so", "lan", "pi"]) for _ in range(draw.randint(1, 4))) for _ in range(400)]


@pytest.fixture
def frame(spark):
    """``frame(rows)``: documents with an extra column of a clashing name."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, schema).withColumn("score", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))

    return make
