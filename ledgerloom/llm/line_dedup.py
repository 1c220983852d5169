"""Line dedup over levelled sorted runs of line hashes.

The runs hold each line key seen so far with the first document that has it. A batch of documents merge-anti-joins
its own keys with the runs: keys found there lose their lines in this batch, the others make the batch's own run;
``fanout`` runs of a level are compacted into one of the next. Runs are bucketed by the hash and sorted within
buckets, one file to a bucket, and read in that order, so their side of the joins is neither shuffled nor sorted.

``dedup_lines`` deals a table into batches of ascending id over runs of its own. ``LineRuns`` with a folder keeps
its runs, and can be opened again for a later batch.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import WS_CHARS, Scratch, by_slices, cut, lower_az, order_id, remove, scratch_path, strip_ws, unused

_WS = WS_CHARS.encode()
_KEY = ["h1", "h2"]
_LINES = "doc long, h1 long, h2 long, batch int"
#: A key with more than this share of a batch's lines is joined by broadcast: there are no more than 1,000 such keys.
COMMON = 1 / 1000


def line_key(line: Column) -> Column:
    return strip_ws(lower_az(line))


@contextlib.contextmanager
def _in_bucket_order(spark: SparkSession) -> Iterator[None]:
    """Let scans of bucketed tables count as sorted: their buckets have one file each."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levels of sorted runs with (h1, h2, first_doc), each key in one run only.

    With a ``folder`` the runs stay there, listed in its ``levels`` table, and are found again by the next
    LineRuns of this folder; ``buckets`` is then what it was at first. Without one they go with ``drop``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2, folder: str | None = None) -> None:
        self.spark, self.fanout, self.kept = spark, fanout, folder is not None
        self.folder = folder or scratch_path(spark, "line_runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tables: dict[str, str] = {}
        if self.kept:
            self._open()

    def _open(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/levels")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return
        for r in sorted(self.spark.read.parquet(f"{self.folder}/levels").collect()):  # a row for each run
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            self.buckets = r["buckets"]
            self.levels[r["level"]].append(r["run"])

    def _save(self) -> None:
        if self.kept:
            rows = [(i, at, run, self.buckets) for i, level in enumerate(self.levels) for at, run in enumerate(level)]
            self.spark.createDataFrame(rows, "level int, at int, run string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/levels")

    def _table(self, run: str) -> DataFrame:
        if run not in self.tables:
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"create table {name} (h1 bigint, h2 bigint, first_doc bigint) using parquet "
                f"clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.folder}/{run}'"
            )
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def _write(self, df: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        self._table(run)
        df.select("h1", "h2", "first_doc").repartition(self.buckets, *_KEY).write.insertInto(self.tables[run])
        return run

    def _forget(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self.tables.pop(run, 'line_run_none')}")

    def runs(self) -> list[DataFrame]:
        return [self._table(run) for level in self.levels for run in level]

    def add(self, df: DataFrame) -> None:
        """Add a batch's keys as a run of level 0 and compact every level that is full."""
        run, level, old = self._write(df), 0, []
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                break
            full, self.levels[level] = self.levels[level], []
            merged = self._table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self._table(name))
            run, level, old = self._write(merged), level + 1, old + full
        self._save()
        for name in old:  # only now does no list name them
            self._forget(name)
            remove(self.spark, f"{self.folder}/{name}")

    def seen(self, mine: DataFrame, lines: int, add: bool = True) -> DataFrame:
        """(doc, h1): the lines of a batch (doc, h1, h2) whose key a run or a smaller doc of the batch has; ``lines`` is their number. The batch joins the runs."""
        own = mine.groupBy(*_KEY).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("held"))
        again = own.filter("last_doc > first_doc").select(*_KEY, "held", "first_doc")
        new = own.select(*_KEY, "first_doc")
        for run in self.runs():
            # A key of a run counts as that of a document before all of this batch.
            again = again.unionByName(own.join(run.select(*_KEY), _KEY, "left_semi").select(*_KEY, "held", F.lit(None).cast("long").alias("first_doc")))
            new = new.join(run, _KEY, "left_anti")
        first = again.groupBy(*_KEY).agg(F.max("held").alias("held"), F.max(F.col("first_doc").isNull()).alias("old"), F.max("first_doc").alias("first_doc"))
        with Scratch(self.spark, "line_keys") as s, _in_bucket_order(self.spark):
            first = s.table(first)
            common = first.filter(F.col("held") > max(1, lines * COMMON))
            rare = first.filter(F.col("held") <= max(1, lines * COMMON))
            late = F.col("old") | (F.col("doc") > F.col("first_doc"))
            by_task = mine.join(F.broadcast(common), _KEY).filter(late).select("doc", "h1")
            shuffled = mine.join(F.broadcast(common.select(*_KEY)), _KEY, "left_anti").join(rare, _KEY).filter(late).select("doc", "h1")
            hits = cut(by_task.unionByName(shuffled))
            if add:
                self.add(new)
        return hits

    def drop(self) -> None:
        """Forget the tables; delete the runs of no folder."""
        for run in list(self.tables):
            self._forget(run)
        if not self.kept:
            remove(self.spark, self.folder)


@arrow_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(text: pa.Array, dropped: pa.Array) -> pa.Array:
    """Each text without the lines whose key hash is in dropped."""
    return by_slices(_kept_lines, text, dropped)


def _kept_lines(text: pa.Array, dropped: pa.Array) -> pa.Array:
    kept, gone = [], []
    for t, hashes in zip(text.cast(pa.binary()).to_pylist(), dropped.to_pylist(), strict=True):
        bad = set(hashes)
        lines = t.split(b"\n")
        stay = [x for x in lines if (xxhash.xxh64_intdigest(x.strip(_WS).lower(), 42) + (1 << 63)) % (1 << 64) - (1 << 63) not in bad]
        kept.append(b"\n".join(stay).decode())
        gone.append(len(lines) - len(stay))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, pa.int64())], ["kept", "n_dropped"])


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, runs: LineRuns) -> DataFrame:
    """(doc, dropped): for each document that loses lines, the hashes of their keys. The batches join the runs."""
    spark = docs.sparkSession
    ids = docs.select(order_id(docs, id_col).alias("doc"), F.col(text_col).alias("text"))
    cuts = [i / batches for i in range(1, batches)]
    ends = ids.agg(F.percentile_approx("doc", cuts, 10000).alias("q")).head()["q"] if cuts else []
    batch = F.lit(0)
    for end in sorted(set(ends or [])):
        batch = batch + (F.col("doc") > F.lit(end)).cast("int")
    last = len(set(ends or []))
    with Scratch(spark, "lines") as s:
        keys = ids.select("doc", F.explode(F.split(lower_az(F.col("text")), "\n", -1)).alias("line")).select("doc", strip_ws(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
        path = f"{s.root}/lines"
        keys.select("doc", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), batch.alias("batch")).write.partitionBy("batch").parquet(path)
        lines = spark.read.schema(_LINES).parquet(path)
        sizes = {r["batch"]: r["count"] for r in lines.groupBy("batch").count().collect()}  # a row for each batch
        hits = None
        for i in sorted(sizes):
            found = runs.seen(lines.filter(F.col("batch") == i).select("doc", *_KEY), sizes[i], add=runs.kept or i < last)
            hits = found if hits is None else hits.unionByName(found)
        if hits is None:
            return spark.createDataFrame([], "doc long, dropped array<long>")
        return cut(hits.groupBy("doc").agg(F.collect_set("h1").alias("dropped")))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fanout: int = 2,
    runs: LineRuns | None = None,
) -> DataFrame:
    """``docs`` with lines removed that a document of smaller id has too, and ``n_lines``, ``n_dropped``.

    A line's key is the line without outer white space, A-Z lower-cased; keys shorter than ``min_chars``
    code points are left alone, and a key keeps all its lines in the first document that has it. With ``runs``
    of a folder, documents given to these runs before count as smaller, whatever their ids. A null
    or empty text is one empty line and comes out as an empty text. Ids are whole numbers (others raise a TypeError);
    rows of equal id count as one document, rows with a null id as one last document. An empty table gives no
    rows; all other columns are handed on, whatever their names, but one called n_lines or n_dropped is replaced."""
    doc, dropped, out = unused(docs, "doc", "dropped", "out")
    own = runs or LineRuns(docs.sparkSession, fanout=fanout)
    try:
        drops = repeated_lines(docs, id_col, text_col, min_chars, batches, own)
    finally:
        own.drop()
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.withColumn(doc, order_id(docs, id_col)).join(drops.toDF(doc, dropped), doc, "left")
    cleaned = joined.withColumn(out, F.when(F.col(dropped).isNotNull(), _without(text, F.coalesce(dropped, F.array().cast("array<long>")))))
    return (
        cleaned.withColumn("n_lines", F.size(F.split(text, "\n", -1)).cast("long"))
        .withColumn("n_dropped", F.coalesce(f"{out}.n_dropped", F.lit(0)).cast("long"))
        .withColumn(text_col, F.coalesce(f"{out}.kept", text))
        .drop(doc, dropped, out)
    )
