import pytest


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text), with columns whose names clash with the operators' own, in two partitions."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(1).alias(c) for c in ("fp", "digest", "own", "Key", "start", "h", "seed", "keep", "n", "tid", "owner", "spans", "score", "k", "t")])
        return df.repartition(2)

    return make
