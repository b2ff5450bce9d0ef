"""Reading records: JSON arrays and lines, latest files, columns from paths, one key of a document, unions of directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.joins import require_present


def json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options) -> DataFrame:
    """Files that hold one JSON array (or object) each. Unknown fields are dropped, missing ones null."""
    return spark.read.schema(schema).options(multiLine=True, **options).json(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, constants: dict | None = None, **options) -> DataFrame:
    """One record a line; ``constants`` are added as columns, such as the task a file belongs to."""
    out = spark.read.schema(schema).options(**options).json(path)
    return out.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


def corrupt_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, record) of the lines that do not parse."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    bad = F.from_json("value", kept, {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"]
    return lines.select("file", bad.alias("record")).where(F.col("record").isNotNull())


def keyed_lines(spark: SparkSession, path: str, record: T.DataType) -> DataFrame:
    """(key, record columns) of lines that hold {key: record}."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    maps = lines.select(F.from_json("value", T.MapType(T.StringType(), record)).alias("m"))
    return maps.select(F.explode("m").alias("key", "r")).select("key", "r.*")


def one_key(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A single key of whole-file JSON documents, parsed alone."""
    texts = spark.read.option("wholetext", True).text(path)
    return texts.select(F.from_json(F.get_json_object("value", f"$.{key}"), schema).alias(key))


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files under ``root`` whose names match; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def latest_per_key(index: DataFrame, key: Column, by: str = "path") -> DataFrame:
    """(key, path): the last file of each key by name, or by ``modified`` with ties by name."""
    order = F.struct(by, "path") if by != "path" else F.col("path")
    return index.groupBy(key.alias("key")).agg(F.max_by("path", order).alias("path"))


def first_per_key(index: DataFrame, key: Column) -> DataFrame:
    return index.groupBy(key.alias("key")).agg(F.min("path").alias("path"))


def path_part_from_end(path: Column, i: int) -> Column:
    """The i-th component from the end of a path (1 is the file name); null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-i))


def checkpoint_step(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"checkpoint-([0-9]+)", 1), F.lit("")).cast("int")


def union_directories(spark: SparkSession, named: dict[str, list[str]], read) -> DataFrame:
    """Rows of all directories of each name, with the name as ``model``. Every directory of a name counts: a union, not the last one."""
    parts = [read(spark, d).withColumn("model", F.lit(name)) for name, dirs in named.items() for d in dirs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def validated(df: DataFrame, media: str, index: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows whose media exist (else an error that names up to ten), in a hash order of ``seed`` if given."""
    require_present(df, media, index, "path")
    return df if seed is None else df.orderBy(F.xxhash64(F.lit(seed), F.col(media)), media)
