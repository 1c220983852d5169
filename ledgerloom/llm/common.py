"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends words, as a character class and as its characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Stands for a null id wherever ids are ordered: such rows act as one last document.
NULL_ID = 9223372036854775807


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own will do if driver and executors are one process; on a cluster it is
    an error, as executors would each write to disks of their own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="ledgerloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table of one run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run, written to the shared folder and read from there; all are deleted at the end.

    What is handed on from the run must not read them: give it away by ``cut``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.made, self.paths = spark, scratch_path(spark, name), 0, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and go on from there."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        return written

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            remove(self.spark, self.paths[id(t)])


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def lower_az(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, _UPPER, _UPPER.lower())


def strip_ws(col: Column) -> Column:
    return F.trim(col, F.lit(WS_CHARS))


def order_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long in which a null comes last. Ids that are no whole numbers raise a TypeError."""
    if id_type(docs, id_col) not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} is {id_type(docs, id_col)}; ids must be whole numbers")
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, changed until no column of ``docs`` has them."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def by_slices(make: Callable[..., pa.Array], *columns: pa.Array, rows: int = 500) -> pa.Array:
    """make(...) over a few rows at a time, so that a worker never holds a whole batch as Python objects."""
    parts = [make(*(c.slice(i, rows) for c in columns)) for i in range(0, len(columns[0]), rows)]
    out = pa.concat_arrays(parts) if parts else make(*columns)
    del parts
    pa.default_memory_pool().release_unused()  # workers are kept for later stages; what this one took should not be
    return out


#: Up to so many ids are broadcast (8 bytes each); more are joined by a shuffle.
IDS_SENT = 250_000


def wanted(ids: DataFrame) -> DataFrame:
    """``ids`` to join with, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= IDS_SENT else ids


def join_touched(docs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` left joined with ``found`` on the keys, the first of them an id. Where few ids are touched, the rows of
    the others are not shuffled."""
    ids = found.select(keys[0]).distinct()
    if ids.count() > IDS_SENT:
        return docs.join(found, keys, "left")
    few = F.broadcast(ids)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in keys]
    some = docs.join(few, keys[0], "left_semi").join(found, keys, "left")
    return some.unionByName(docs.join(few, keys[0], "left_anti").select("*", *nothing))
