"""Text, JSON, CSV and log files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siltworks.functions import text as T


def register(spark: SparkSession) -> None:
    """Makes the archive and token-shard formats known to the session."""
    from siltworks.sources.npy import NpyDataSource
    from siltworks.sources.warc import WarcDataSource

    spark.dataSource.register(WarcDataSource)
    spark.dataSource.register(NpyDataSource)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``, one row per file, with line ends translated."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), T.universal_newlines("value").alias("text"))


def marked_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: strip, drop one end marker, strip, drop what is empty."""
    d = spark.read.text(path).select(T.strip("value").alias("t"))
    cut = F.when(F.endswith(F.col("t"), F.lit(T.EOT)), F.expr(f"substring(t, 1, length(t) - {len(T.EOT)})")).otherwise(F.col("t"))
    return d.select(T.strip(cut).alias("text")).where("text <> ''")


def json_lines(spark: SparkSession, path: str, schema: str | StructType = "text string") -> DataFrame:
    """Plain or gzipped JSON lines under a given schema; broken lines are dropped, missing texts empty."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).na.fill("", ["text"])


def csv_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV rows under a given schema, without headers repeated by appending runs."""
    t = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = t.fieldNames()
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    body = raw.where(~F.col(names[0]).eqNullSafe(F.lit(names[0])))
    return body.select(*[F.expr(f"try_cast({f.name} as {f.dataType.simpleString()})").alias(f.name) for f in t.fields])


def log_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    return spark.read.option("encoding", encoding).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def first_files(paths: DataFrame, n: int, col: str = "path") -> DataFrame:
    return paths.orderBy(col).limit(n)


def latest(files: DataFrame, time_col: str = "modified_at", n: int = 1) -> DataFrame:
    return files.orderBy(F.col(time_col).desc()).limit(n)


def url_type(x: str = "url") -> "F.Column":
    """The directory above the file."""
    return F.try_element_at(F.split(F.col(x), "/"), F.lit(-2))


def usable_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """URLs that do not name the excluded collections anywhere."""
    return df.where(~F.contains(F.col(col), F.lit("c4")) & ~F.contains(F.col(col), F.lit("cc")))


# --- sinks ---


def write_batches(df: DataFrame, path: str, rows: int = 10_000, text: str = "text") -> None:
    """Marked documents in files of at most ``rows``."""
    df.select(F.concat(F.col(text), F.lit(T.EOT)).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows).text(path)


def write_labels(df: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    df.select(T.label_line(label, text).alias("value")).write.mode("append").text(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """One folder per document, named by its id."""
    df.select(F.col(id_col), F.col(text).alias("value")).write.mode("overwrite").partitionBy(id_col).option("lineSep", "\n").text(path)


def write_split(df: DataFrame, path: str, split: str = "split", text: str = "value") -> None:
    """One folder per part of a split."""
    df.select(F.col(split), F.col(text).alias("value")).write.mode("overwrite").partitionBy(split).text(path)


def batch_name(stem: "F.Column", number: "F.Column") -> "F.Column":
    """``<stem>_batch_NNN.txt``."""
    return F.concat(stem, F.lit("_batch_"), F.lpad(number.cast("string"), 3, "0"), F.lit(".txt"))


def file_stem(path: "F.Column") -> "F.Column":
    """The file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def existing(df: DataFrame, listing: DataFrame, col: str = "path") -> DataFrame:
    """Rows whose file is in the listing."""
    return df.join(listing.select(col).distinct(), col, "left_semi")


def files_by_type(df: DataFrame, url: str = "url") -> DataFrame:
    """Number of files and first file per type of URL."""
    return df.withColumn("type", url_type(url)).groupBy("type").agg(F.count("*").alias("n"), F.min(url).alias("first"))


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON object, such as the counts and settings of a run."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """A JSON object from any file system that the session reaches."""
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()) or "{}")
