"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header row (types inferred unless a schema is given) or Parquet, by extension."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported file format: {path}")


def read_headerless(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV whose first row is data; columns are named col_0, col_1, ..."""
    if not path.endswith(".csv"):
        raise ValueError(f"unsupported file format: {path}")
    reader = spark.read.option("header", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[f"col_{i}" for i in range(len(df.columns))])


def write_predictions(df: DataFrame, path: str) -> None:
    """Scored table as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_leaderboard(df: DataFrame, path: str) -> None:
    """Leaderboard as CSV or Parquet, by extension."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)
