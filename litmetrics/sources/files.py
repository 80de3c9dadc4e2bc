"""Files: CSV publication lists, JSON documents, JSON lines; routed and enriched output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profiles import first_per

#: texts that spreadsheet tools write for a missing value
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")

PROFILE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "abstract", "authors", "citationCount", "references", "venue", "year", "type")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, provenance: bool = False) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes. Without a schema all columns are text: types are the
    business of normalize(), not of inference. provenance adds SourceFile."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.when(~F.col(f"`{f.name}`").isin(*MISSING), F.col(f"`{f.name}`")))
    return df.withColumn("SourceFile", F.col("_metadata.file_name")) if provenance else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, field: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """JSON lines; with a field of the top level and wanted (one column of its values, as text) the first record of each
    wanted value, by file name and place in the file, however files are split.

    Only lines that a bitmap of the wanted values' hashes lets through are parsed as a whole.
    """
    if field is None or wanted is None:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    keys = wanted.select(F.col(f"`{wanted.columns[0]}`").cast("string").alias("_key")).filter("_key is not null").distinct()
    found = maybe_in(lines.withColumn("_key", F.get_json_object("value", f"$.{field}")), "_key", keys)
    # a part of a file is read by one task from its first line to its last
    found = first_per(found.join(keys, "_key", "left_semi"), ["_key"], F.col("_file"), F.col("_block"), F.col("_at"))
    return found.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("_r")).select("_r.*")


BITS = 1 << 26  # of the bitmap: 8 MB, whatever the number of values


def maybe_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose key may be in wanted (one column): all that are, and few others; nothing is shuffled but wanted."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    kept = wanted.select(place(F.col(wanted.columns[0])).alias("_h"))
    bits = kept.groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    marked = df.withColumn("_h", place(F.col(key)))
    joined = marked.join(F.broadcast(bits), F.bitmap_bucket_number("_h") == F.col("_bucket"))  # BITS bits at most
    at = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in its form."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Has write() fill a folder beside path and puts it in path's place when that is done.

    A job that fails leaves what was there, and a job may read the path that it replaces. Readers find the old table or
    the new one, or for the moment between two renames none, but never a part of one.
    """
    fs, target = _hadoop(spark, path)
    name = target.getName()
    fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{name}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    moved = False
    try:
        write(fresh.toString())
        moved = fs.exists(target)
        if moved and not fs.rename(target, old):
            moved = False
            raise OSError(f"{path} cannot be moved away")
        if not fs.rename(fresh, target):
            raise OSError(f"{path} cannot be put in place")
    except BaseException:
        if moved and not fs.exists(target):
            fs.rename(old, target)
        raise
    finally:
        for left in (fresh, old):
            if fs.exists(left) and (left is fresh or fs.exists(target)):
                fs.delete(left, True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV under path; overwriting swaps the whole table on success."""
    write = lambda to, how: df.write.mode(how).option("header", True).option("quote", '"').option("escape", '"').csv(to)
    if mode == "overwrite":
        swapped(df.sparkSession, path, lambda to: write(to, "errorifexists"))
    else:
        write(path, mode)


def write_routed(df: DataFrame, routes: dict[str, Column], mode: str = "overwrite") -> None:
    """Each route's rows to its own path, from one computation of df."""
    held = df.persist()
    try:
        for path, test in routes.items():
            write_csv(held.filter(test), path, mode)
    finally:
        held.unpersist()


def enrich_csv(spark: SparkSession, path: str, extra: DataFrame, key: str, column: str, default: str = "", out: str | None = None) -> None:
    """Adds or replaces a column by lookup (of several values of a key the smallest), in place unless `out` is given."""
    df = read_csv(spark, path)
    df = df.drop(column) if column in df.columns else df
    write_csv(df.join(first_per(extra.select(key, column), [key], F.col(column).asc_nulls_last()), key, "left").withColumn(column, F.coalesce(column, F.lit(default))), out or path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text to one file, wherever the path leads."""
    fs, target = _hadoop(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
