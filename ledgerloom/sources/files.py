"""Files as tables: workbooks, upload inventories, labelled CSV, OCR lines, JSON payloads; reports as files."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coerce_date, coerce_decimal

#: What may be uploaded, and how large.
SHEET_SUFFIXES, MAX_MB = ["xlsx", "xlsm", "xls"], 20
#: Names that stand for a payment method.
PAYMENT_ALIASES = ["naver_pay", "naverpay", "kakao_pay", "kakaopay", "toss_pay", "tosspay"]
CATEGORIES = ["식비", "간식비", "교통비", "인쇄비", "물품구입비", "행사비", "홍보비", "회의비", "장소대여비", "상품비", "기타"]


def file_inventory(files: DataFrame, max_mb: int = MAX_MB, suffixes: list[str] | None = None) -> DataFrame:
    """(path, suffix, reject_reason) from (path, length): null for files that are taken."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    bad = F.when(~suffix.isin(suffixes or SHEET_SUFFIXES), "suffix").when(F.col("length") == 0, "empty").when(F.col("length") > max_mb * 1024 * 1024, "too_large")
    return files.select("path", suffix.alias("suffix"), bad.alias("reject_reason"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is named, one of our own, but not on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Work:
    """Tables of one job, written to the shared folder and read from there; all are deleted at its end, or by ``close``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.made, self.paths = spark, scratch(spark, name), 0, {}

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        remove(self.spark, self.root)

    def path(self) -> str:
        """A new path of this job."""
        self.made += 1
        return f"{self.root}/{self.made}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and go on from there."""
        path = self.path()
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        return written

    def path_of(self, table: DataFrame) -> str:
        return self.paths[id(table)]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            remove(self.spark, self.paths.pop(id(t)))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; Spark's cleaner deletes it where that is on."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there, for results that outlive their job: a row takes a fraction of
    what it takes in a checkpoint. It is deleted at the session's end."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


_BAD_FILE = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError, zlib.error)


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a tag once it is complete; what has been read is let go, so one of them is held at a time."""
    with z.open(name) as stream:
        above: list[ElementTree.Element] = []
        for what, x in ElementTree.iterparse(stream, ("start", "end")):
            if what == "start":
                above.append(x)
                continue
            above.pop()
            if _local(x.tag) == tag:
                yield x
                if above:
                    above[-1].remove(x)


_LETTERS = re.compile("[A-Z]*")


def _sheet_rows(stream: io.BufferedIOBase) -> Iterator[tuple[str | None, list[tuple[str, str | None, str | None, str]]]]:
    """(number, cells) of each row of a worksheet as it is complete; a cell is (place, type, value, inline text)."""
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    done: list[tuple] = []
    depth = row_at = cell_at = 0
    number = cells = cell = value = texts = into = None

    def start(tag: str, attrs: dict[str, str]) -> None:
        nonlocal depth, row_at, cell_at, number, cells, cell, value, texts, into
        depth += 1
        into = None
        name = _local(tag)
        if cell_at:
            if name == "t":
                into = texts
            elif name == "v" and depth == cell_at + 1:
                into = value = []
        elif row_at:
            if name == "c" and depth == row_at + 1:
                cell_at, cell, value, texts = depth, attrs, None, []
        elif name == "row":
            row_at, number, cells = depth, attrs.get("r"), []

    def end(tag: str) -> None:
        nonlocal depth, row_at, cell_at, into
        into = None
        if depth == cell_at:
            cells.append((cell.get("r", ""), cell.get("t"), "".join(value) if value else None, "".join(texts)))
            cell_at = 0
        elif depth == row_at:
            done.append((number, cells))
            row_at = 0
        depth -= 1

    def text(data: str) -> None:
        if into is not None:
            into.append(data)

    def skipped(name: str, is_parameter: bool) -> None:
        raise ElementTree.ParseError(f"undefined entity {name}")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.SkippedEntityHandler = start, end, text, skipped
    last = False
    while not last:
        part = stream.read(1 << 14)
        last = not part
        try:
            p.Parse(part, last)
        except expat.ExpatError as e:
            raise ElementTree.ParseError(str(e)) from e
        yield from done
        done.clear()


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, value) of the first worksheet of an OOXML workbook, by tag names whatever their namespace.

    The sheet is parsed a row at a time, and no tree is built; only the file's bytes and its shared strings are held whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in _elements(z, "xl/sharedStrings.xml", "si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]), default=None)
        if sheet is None:
            return
        row, places = -1, {}
        with z.open(sheet) as stream:
            for number, cells in _sheet_rows(stream):
                row = int(row + 2 if number is None else number) - 1
                col = -1
                for at, kind, value, inline in cells:
                    letters = _LETTERS.match(at)[0]
                    if letters and letters not in places:
                        places[letters] = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters))) - 1
                    col = places[letters] if letters else col + 1
                    if kind == "inlineStr":
                        value = inline
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    if value:
                        yield row, col, value


#: Cells of a batch that goes back to Spark, and bytes of a workbook's batches that wait in memory.
CELLS, HELD = 20_000, 32 << 20
_GRID = "path string, row_idx int, col_idx int, value string, error string"


def cell_batches(content: bytes, size: int = CELLS) -> Iterator[list[tuple[int, int, str]]]:
    """The cells of a workbook, ``size`` of them at a time."""
    cells = sheet_cells(content)
    while batch := list(islice(cells, size)):
        yield batch


def sheet_grid(files: DataFrame) -> DataFrame:
    """(path, row_idx, col_idx, value, error): every cell of every workbook in (path, content), in batches of CELLS; a file
    that can't be read gives its error and no cells."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    form = pa.schema(list(zip(["path", "row_idx", "col_idx", "value", "error"], kinds, strict=True)))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, content = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                # Handed on once all of it has been read, so that no part of a bad file is; what is large waits in a file.
                with tempfile.SpooledTemporaryFile(max_size=HELD) as held:
                    try:
                        with pa.ipc.new_stream(held, form) as out:
                            for cells in cell_batches(content):
                                out.write_batch(made([(path, *c, None) for c in cells]))
                    except _BAD_FILE as e:
                        yield made([(path, None, None, None, type(e).__name__)])
                        continue
                    held.seek(0)
                    yield from pa.ipc.open_stream(held)

    return files.select("path", "content").mapInArrow(run, _GRID)


def sheet_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files_at_once: int = 1000) -> object:
    """Workbooks of a folder as they come: their cells under ``out``/cells, files that can't be read with their error
    under ``out``/unreadable. A batch that is repeated after a restart writes its folders anew. Returns the started query."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).load(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        grid = sheet_grid(batch).write
        root = f"{out}/grid/batch={batch_id}"
        grid.mode("overwrite").parquet(root)
        grid = batch.sparkSession.read.schema(_GRID).parquet(root)
        grid.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/cells/batch={batch_id}")
        grid.filter("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{out}/unreadable/batch={batch_id}")
        remove(batch.sparkSession, root)

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def workbooks(cells: DataFrame) -> DataFrame:
    """(path, content): one minimal workbook of inline strings per file of a cell grid (file_id, row_idx, col_idx, value)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts, row = ["<worksheet><sheetData>"], None
        for r, c, v in sorted(zip(*(t.column(n).to_pylist() for n in ("row_idx", "col_idx", "value")), strict=True)):
            if r != row:
                parts.append(f'<row r="{r + 1}">' if row is None else f'</row><row r="{r + 1}">')
                row = r
            parts.append(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        parts.append("</sheetData></worksheet>" if row is None else "</row></sheetData></worksheet>")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            z.writestr("xl/worksheets/sheet1.xml", "".join(parts).encode())
        return pa.table({"path": [f"{key[0].as_py()}.xlsx"], "content": pa.array([out.getvalue()], pa.binary())})

    return cells.filter("value is not null").groupBy("file_id").applyInArrow(run, "path string, content binary")


def clean_truth(raw: DataFrame) -> DataFrame:
    """Typed labels from text columns; rows without a file name or type are dropped, blanks are null."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    method = F.when(F.lower(text("expected_payment_method")).isin(PAYMENT_ALIASES), "online_payment").otherwise(text("expected_payment_method"))
    return raw.select(
        text("file_name").alias("file_name"), text("evidence_type").alias("evidence_type"), coerce_date(text("expected_date")).alias("expected_date"), text("expected_merchant_name").alias("expected_merchant_name"),
        coerce_decimal(text("expected_amount")).alias("expected_amount"), method.alias("expected_payment_method"), text("notes").alias("notes"), text("split").alias("split"), text("difficulty").alias("difficulty"),
    ).filter("file_name is not null and evidence_type is not null")


def ground_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels from a CSV file; a byte-order mark before the header is no part of the first name."""
    raw = spark.read.csv(path, header=True, multiLine=True)
    return clean_truth(raw.toDF(*(c.lstrip("﻿") for c in raw.columns)))


def ocr_lines_json(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(path, pos, text, confidence) from files with {"lines": [...]} or a bare list of lines; ``by_line`` where a file has
    such a document a line."""
    line = "array<struct<text:string,confidence:double>>"
    whole = spark.read.text(path, wholetext=not by_line).select(F.input_file_name().alias("path"), F.col("value"))
    lines = F.coalesce(F.from_json("value", f"struct<lines:{line}>")["lines"], F.from_json("value", line))
    return whole.select("path", F.posexplode(lines).alias("pos", "l")).select("path", "pos", "l.text", "l.confidence")


def ocr_output_flatten(raw: DataFrame, min_conf: float = 0.25) -> DataFrame:
    """(receipt_id, pos, text, confidence, top, left) from parallel arrays texts, scores, polys; lines below min_conf are dropped."""
    z = raw.select("receipt_id", F.inline(F.arrays_zip("texts", "scores", "polys"))).withColumn("confidence", F.coalesce("scores", F.lit(0.0)))
    placed = z.select("receipt_id", F.col("texts").alias("text"), "confidence", F.array_min(F.transform("polys", lambda p: p[1])).alias("top"), F.array_min(F.transform("polys", lambda p: p[0])).alias("left")).filter(F.col("confidence") >= min_conf)
    rows = placed.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("top", "left", "text", "confidence"))).alias("l"))
    return rows.select("receipt_id", F.posexplode("l").alias("pos", "x")).select("receipt_id", "pos", "x.text", "x.confidence", "x.top", "x.left")


_FIELD = "struct<text:string,formatted:struct<value:string,year:string,month:string,day:string>,confidenceScore:double>"
_RECEIPT = f"struct<images:array<struct<inferResult:string,message:string,receipt:struct<result:struct<storeInfo:struct<name:{_FIELD}>,paymentInfo:struct<date:{_FIELD}>,totalPrice:struct<price:{_FIELD}>>>>>>"


def receipt_json_extract(payloads: DataFrame) -> DataFrame:
    """(receipt_id, merchant_name, evidence_date, amount, confidence, error) from receipt-reader payloads (receipt_id, payload)."""
    x = payloads.select("receipt_id", F.get(F.from_json("payload", _RECEIPT)["images"], 0).alias("i"))
    name, day, price = (F.col(f"i.receipt.result.{p}") for p in ("storeInfo.name", "paymentInfo.date", "totalPrice.price"))
    text = lambda f: F.nullif(F.trim(F.coalesce(f["formatted"]["value"], f["text"])), F.lit(""))
    made = F.try_to_date(F.concat_ws("-", day["formatted"]["year"], day["formatted"]["month"], day["formatted"]["day"]), "yyyy-M-d")
    scores = F.array_compact(F.array(name["confidenceScore"], day["confidenceScore"], price["confidenceScore"]))
    mean = F.when(F.size(scores) > 0, F.round(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores), 6)).otherwise(F.lit(0.0))
    ok = F.coalesce(F.col("i.inferResult") == "SUCCESS", F.lit(False))
    return x.select(
        "receipt_id", F.when(ok, text(name)).alias("merchant_name"), F.when(ok, F.coalesce(made, coerce_date(F.coalesce(day["formatted"]["value"], day["text"])))).alias("evidence_date"),
        F.when(ok, coerce_decimal(text(price))).alias("amount"), F.when(ok, mean).otherwise(0.0).alias("confidence"), F.when(~ok, F.coalesce("i.message", F.lit("failed"))).alias("error"),
    )


def llm_json_extract(payloads: DataFrame, default_type: str = "receipt") -> DataFrame:
    """(receipt_id, evidence_type, evidence_date, merchant_name, amount, budget_category, is_refund, confidence) from replies
    (receipt_id, reply) that hold a JSON object, maybe in fences and prose."""
    bare = F.regexp_replace("reply", "```(json)?", "")
    fields = "struct<evidence_type:string,date:string,merchant:string,amount:string,category:string,is_refund:string>"
    x = payloads.select("receipt_id", F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), fields).alias("o"))
    kind = F.when(F.col("o.evidence_type").isin("receipt", "e_receipt", "bank_transfer_statement"), F.col("o.evidence_type")).otherwise(default_type)
    day, amount, name = coerce_date(F.col("o.date")), coerce_decimal(F.col("o.amount")), F.nullif(F.trim("o.merchant"), F.lit(""))
    category = F.when(F.col("o.category").isin(CATEGORIES), F.col("o.category")).when(F.col("o.category").isNotNull(), "기타")
    sure = F.when(amount.isNotNull(), 0.4).otherwise(0.0) + F.when(day.isNotNull(), 0.3).otherwise(0.0) + F.when(name.isNotNull(), 0.3).otherwise(0.0)
    return x.select("receipt_id", kind.alias("evidence_type"), day.alias("evidence_date"), name.alias("merchant_name"), amount.alias("amount"), category.alias("budget_category"), F.lower(F.coalesce("o.is_refund", F.lit("false"))).isin("true", "1", "yes", "y").alias("is_refund"), F.round(sure, 2).alias("confidence"))


def write_report(df: DataFrame, path: str, partition: str | None = None) -> None:
    """JSON lines under the path, one folder per value of ``partition`` where given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(path)


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


