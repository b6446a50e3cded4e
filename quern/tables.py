"""Table access: every query reads its inputs through here, so scans stay prunable Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, narrowed to ``columns`` when given (the names reach the Parquet ReadSchema)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Inputs up to this many bytes on disk may be spread by a shuffle; larger ones never are.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if they lie in few, small files; select the columns first.

    A file of one row group is one task however many cores wait, and work on texts costs far more than
    their transfer. Only inputs of at most ``SPREAD_BYTES`` in fewer files than half the cores are shuffled,
    so the shuffle is bounded; everything else is scanned in the splits that Spark makes. Results do not differ.
    """
    spark = df.sparkSession
    files, want = df.inputFiles(), spark.sparkContext.defaultParallelism
    if not files or 2 * len(files) > want:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return df.repartition(want) if size <= SPREAD_BYTES else df
