"""JSON-lines records as a source, and an append-only outbox as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record as it comes: one JSON object a line. Unknown members are left out, missing ones are null.
RECORD = T.StructType(
    [
        T.StructField("contract", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("record_kind", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("byte_start", T.LongType()),
        T.StructField("byte_end", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def read(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of JSON-lines files under a declared schema, damaged lines in `damaged`; nothing is inferred."""
    return spark.read.schema(T.StructType([*schema, T.StructField("damaged", T.StringType())])).option("columnNameOfCorruptRecord", "damaged").json(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType = RECORD, files: int = 16) -> DataFrame:
    """The same as a stream of a growing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def write(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls left out."""
    df.write.json(path)


def publish(df: DataFrame, path: str, kind: str, key: str) -> None:
    """Append one outbox row for each row: kind, key, body (canonical JSON) and its digest; readers drop repeats by digest."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    rows = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), body.alias("body"))
    rows.withColumn("digest", F.sha2(F.concat_ws("|", "kind", "key", "body"), 256)).write.mode("append").parquet(path)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """The outbox without repeats, whatever was appended twice."""
    return spark.read.parquet(path).dropDuplicates(["digest"])
