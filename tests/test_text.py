"""Text normalisation against Python's, sign by sign, and workbooks in bounded batches."""

from __future__ import annotations

import io
import random
import re
import unicodedata
import zipfile

from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.sources import files

SIGNS = ["a", "é", "é", "ﬁ", "１", "②", "Ⅳ", "￦", "₩", "|", " ", "  ", "\t", "\u00a0", "\u3000", "\u2028", "\r\n", "\r", "\n", "\x0b", "\x1c", "\x85", "가", "\u1100\u1161", "が", "か\u3099", "…", "Å", "ß", "İ", "Σ", "\u0327", "日", "½", ".", "-", "\u200b", "𝔘", "ẛ̣"]


def lines(text: str) -> str:
    out = [re.sub(r"\s+", " ", x).strip(" \t|").replace("₩", "원") for x in unicodedata.normalize("NFKC", text).splitlines()]
    return "\n".join(x for x in out if x)


def test_normal_forms(spark):
    r = random.Random(3)
    given = ["", "\n", " | ", *SIGNS, *("".join(r.choices(SIGNS, k=r.randint(1, 12))) for _ in range(1500))]
    rows = spark.createDataFrame([(t,) for t in [*given, None]], "t string")
    got = rows.select("t", scalars.normalize_text(F.col("t")), scalars.nfkc(F.col("t")), scalars.match_text(F.col("t"))).collect()
    for t, clean, normal, match in got:
        if t is None:
            assert normal is None
            continue
        assert normal == unicodedata.normalize("NFKC", t)
        assert clean == lines(t), repr(t)
        assert match == "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum()), repr(t)


def test_stable_signs_stay_in_any_company():
    ranges = [tuple(int(x, 16) for x in m) for m in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", scalars.stable_class())]
    signs = [chr(c) for lo, hi in ranges for c in range(lo, hi + 1)]
    r = random.Random(1)
    assert len(signs) > 30_000
    for _ in range(300):
        text = "".join(r.choices(signs, k=400))
        assert unicodedata.normalize("NFKC", text) == text


def workbook(rows: int, cols: int, shared: bool) -> bytes:
    cell = (lambda r, c: f'<c r="{chr(65 + c)}{r + 1}" t="s"><v>{(r + c) % 7}</v></c>') if shared else (lambda r, c: f'<c r="{chr(65 + c)}{r + 1}"><v>{r * cols + c}</v></c>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")
        body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c) for c in range(cols)) + "</row>" for r in range(rows))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x:y"><sheetData>{body}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><r><t>s</t></r><r><t>{i}</t></r></si>" for i in range(7)) + "</sst>")
    return out.getvalue()


def test_cells_come_in_bounded_batches(spark):
    rows = [("a.xlsx", workbook(3000, 20, False)), ("b.xlsx", workbook(50, 3, True)), ("c.xlsx", b"no zip"), ("d.xlsx", None), ("e.xlsx", workbook(5, 2, False)[:-40])]
    got = files.sheet_grid(spark.createDataFrame(rows, "path string, content binary"))
    counts = {r.path: (r.n, r.bad) for r in got.groupBy("path").agg(F.count("value").alias("n"), F.count("error").alias("bad")).collect()}
    assert counts == {"a.xlsx": (60_000, 0), "b.xlsx": (150, 0), "c.xlsx": (0, 1), "d.xlsx": (0, 1), "e.xlsx": (0, 1)}
    assert {r.value for r in got.filter("path = 'b.xlsx' and row_idx = 1").collect()} == {"s1", "s2", "s3"}
    sizes = [len(b) for b in files.cell_batches(workbook(3000, 20, False), 1000)]
    assert max(sizes) == 1000 and sum(sizes) == 60_000


def test_a_stream_of_workbooks_sets_bad_files_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.xlsx", workbook(4, 2, False)), ("b.xlsx", b"no zip")):
        (tmp_path / "in" / name).write_bytes(data)
    run = lambda: files.sheet_stream(spark, f"file://{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    (tmp_path / "in" / "c.xlsx").write_bytes(workbook(2, 2, True))
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out/cells").count() == 12
    assert [(r.path.rsplit("/", 1)[-1], r.error) for r in spark.read.parquet(f"{tmp_path}/out/unreadable").collect()] == [("b.xlsx", "BadZipFile")]


def test_a_merchants_name_is_cleaned_once(spark):
    from ledgerloom.operators import layout

    texts = ["가맹점명: 가게7 본점", "상호 store - CU 구의", "  merchant|STORE: x  y ", "가게 사업자번호 1", "가게 123-45-67890 TEL 02-123-4567", "telescope", "합계 카페", "합계", "-", "", None]
    named = spark.createDataFrame([(x,) for x in texts], "text string").select(layout.merchant_clean(F.col("text")).alias("name"))
    assert [r.name for r in named.collect()] == ["가게7 본점", "CU 구의", "x y", "가게", "가게", "telescope", "합계 카페", None, None, None, None]
    assert named._jdf.queryExecution().analyzed().toString().count("매장명") == 2  # the look whether it is needed, and the step
