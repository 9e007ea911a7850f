"""Helpers shared by the training-data operators: shared storage and small column rules."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.session import scratch_path

# The white space that separates words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage).

    Inside :func:`own_tables` the table goes when the scope ends, unless ``keep``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table behind a frame that :func:`materialize` returned; other frames are left alone."""
    path = getattr(df, "stored_at", None)
    if path is not None:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def own_tables(spark: SparkSession):
    """A scope for work whose result is written when it ends: tables materialised inside are removed then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def own_row(docs: DataFrame) -> Column:
    """The whole input row as one struct, so that no name of ours can meet one of its columns (see :func:`unpacked`)."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(df: DataFrame, row: str = "row", **replaced: Column) -> DataFrame:
    """The columns of the struct ``row`` alone, those in ``replaced`` with a new value."""
    names = df.schema[row].dataType.names
    return df.select(*[replaced.get(n, F.col(row).getField(n)).alias(n) for n in names])


ID = ["no_id", "id0"]


def id_keys(doc_id: Column) -> list[Column]:
    """A document id as ``ID``: two columns without nulls, for plain equality joins that share their exchange."""
    doc_id = doc_id.cast("long")
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id0")]


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).alias("text_key")


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns; maps, which have no order, are hashed as sorted entries of their JSON."""
    def has_map(kind) -> bool:
        if isinstance(kind, T.StructType):
            return any(has_map(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return has_map(kind.elementType)
        return isinstance(kind, T.MapType)

    def hashable(f: T.StructField) -> Column:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.MapType):
            c = F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e))))
        return F.to_json(F.struct(c)) if has_map(f.dataType) and not isinstance(f.dataType, T.MapType) else c

    return F.xxhash64(*[hashable(f) for f in docs.schema.fields])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a Hadoop-style URI; plain and ``file:`` paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def open_new(folder: str, stem: str, suffix: str):
    """An output stream on a file name no other task attempt uses, and its URI.

    Readers only see files named in a manifest, so what a lost attempt left is never read.
    """
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{name}", compression=None), f"{folder.rstrip('/')}/{name}"


def open_read(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def sums_before(parts: DataFrame, by: list[str], order: list[str], value: str, out: str = "first",
                block: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` that come before in ``order``.

    ``block`` is a number that grows with the order: sums are taken block by block and inside blocks, so that no task
    orders all rows.
    """
    parts = parts.withColumn("block_", block if block is not None else F.lit(0).cast("long"))
    blocks = parts.groupBy(*by, "block_").agg(F.sum(value).alias("sum_"))
    over = Window.partitionBy(*by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("block_").alias("b_"),
                           F.coalesce(F.sum("sum_").over(over), F.lit(0)).alias("before_"))
    same = F.col("block_") == F.col("b_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    inside = Window.partitionBy(*by, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out_ = (F.col("before_") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(out)
    names = [c for c in parts.columns if c != "block_"]
    return parts.join(blocks, same).select(*names, out_)


def crowded(rows: DataFrame, keys: list[str], per_range: int, name: str) -> DataFrame | None:
    """(keys with a trailing "_", bits): groups of more than ``8 * per_range`` rows and the bits that number their
    sub-ranges of about ``per_range`` rows; None if there are none. One row per such group."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > 8 * per_range)
    many = materialize(many.select(*[F.col(c).alias(f"{c}_") for c in keys], F.ceil(F.log2(
        F.col("n_") / per_range)).cast("int").alias("bits_")), name)
    return None if many.isEmpty() else many


def top_bits(rows: DataFrame, many: DataFrame | None, keys: list[str], hash_: str, out: str) -> DataFrame:
    """Adds ``out``: the top bits of the 64-bit column ``hash_`` in the groups of ``many``, 0 in others."""
    if many is None:
        return rows.withColumn(out, F.lit(0).cast("long"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    sub = F.coalesce(F.expr(f"shiftrightunsigned({hash_}, 64 - bits_)"), F.lit(0).cast("long"))
    return rows.join(many, same, "left").select(*rows.columns, sub.alias(out))
