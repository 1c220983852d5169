from __future__ import annotations

import io
import json
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as N
from ledgerloom.operators import evaluate, extract, ingest, layout
from ledgerloom.sources import files
from ledgerloom.streaming import jobs

LINES = "receipt_id long, pos int, text string, confidence double, top double"


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t, 0.9, 30.0 * i) for i, t in enumerate(texts)], LINES)


@pytest.mark.parametrize(("texts", "amount", "source"), [
    (["아메리카노 2 9,000", "공급가액 13,182", "부가세 1,318", "합계금액 14,500"], 14500, "total"),
    (["주문합계 400,000", "받을금액 400,000", "과세 363,636", "영수금액 400,000"], 400000, "payment"),
    (["합계금액", "1", "854,500", "카드결제 234,500"], 234500, "payment"),
    (["합계금액", "부가세 500,000", "60,000"], 60000, "item"),
    (["", "없음"], None, None),
])
def test_payment_amount(spark, texts, amount, source):
    row = extract.payment_amount(lines(spark, *texts)).head()
    assert (row.amount, row.selected_from) == (amount, source)


def test_dates(spark):
    texts = ["2026.06.07 16:59:05", "2026/06/07 16:59", "2026.06.07", "2026-06-07 16:59:05", "2026-06-07T01:02:03", "2026-13-01", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", N.coerce_date(F.col("t")).alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == [date(2026, 6, 7)] * 5 + [None] * 3


def grid(spark, rows):
    return spark.createDataFrame([(1, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "file_id long, row_idx long, col_idx int, value string")


def test_type_and_amount_sheet(spark):
    rows = [["거래일시", "구분", "거래금액", "잔액", "거래명", "메모"], ["2026.06.07 16:59:05", "출금", "-15,000", "0", "편의점", ""], ["2026.06.07 16:59:05", "출금", "50,000", "0", "문구", ""], ["2026.06.08 10:00:00", "입금", "300,000", "0", "김철수", "모임회비"], ["합계", "", "", "", "", ""]]
    got = [(r.description, r.amount) for r in ingest.statement_rows(grid(spark, rows)).orderBy("row_idx").collect()]
    assert got == [("편의점", Decimal(-15000)), ("문구", Decimal(-50000)), ("김철수 (모임회비)", Decimal(300000))]


def test_deposit_only_sheet(spark):
    rows = [["거래일자", "적요", "출금액", "입금액"], ["2026-06-07", "a", "0", "50,000"], ["2026-06-08", "b", "-", "30,000"], ["2026-06-08", "c", "0", "0"]]
    assert [r.amount for r in ingest.statement_rows(grid(spark, rows)).orderBy("row_idx").collect()] == [Decimal(50000), Decimal(30000)]


def workbook(rows):
    shared, cells = [], []
    for i, r in enumerate(rows):
        cs = ""
        for j, v in enumerate(r):
            shared.append(v)
            cs += f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{len(shared) - 1}</v></c>'
        cells.append(f'<row r="{i + 1}">{cs}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="urn:x"><sheetData>{"".join(cells)}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_as_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["날짜", "금액"], ["2026-01-02", "5"]]))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    cells = files.sheet_grid(files.binary_files(spark, str(tmp_path))).collect()
    assert sorted((c.row_idx, c.col_idx, c.value) for c in cells if c.error is None) == [(0, 0, "날짜"), (0, 1, "금액"), (1, 0, "2026-01-02"), (1, 1, "5")]
    assert [c.error for c in cells if c.error] == ["BadZipFile"]


def test_labels_and_lines_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿file_name,evidence_type,expected_date,expected_merchant_name,expected_amount,expected_payment_method,notes,split,difficulty\na.jpg,receipt,2026-01-02, ,\"1,000\",naver_pay,,,\n,receipt,,,,,,,\n", encoding="utf-8")
    rows = files.ground_truth_csv(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.file_name, r.expected_date, r.expected_merchant_name, r.expected_amount, r.expected_payment_method) for r in rows] == [("a.jpg", date(2026, 1, 2), None, Decimal(1000), "online_payment")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"lines": [{"text": "x", "confidence": 0.5}]}))
    (tmp_path / "j" / "b.json").write_text(json.dumps([{"text": "y"}]))
    assert sorted((r.pos, r.text) for r in files.ocr_lines_json(spark, str(tmp_path / "j")).collect()) == [(0, "x"), (0, "y")]
    files.write_report(spark.createDataFrame([(1, "a")], "n int, k string"), str(tmp_path / "r"), "k")
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_failure_reasons(spark):
    truth = spark.createDataFrame([("s.jpg", date(2026, 4, 4), "CU 구의본점", Decimal(18800), "card", "많이 구겨진 영수증")], "file_name string, expected_date date, expected_merchant_name string, expected_amount decimal(12,2), expected_payment_method string, notes string")
    seen = spark.createDataFrame([("s.jpg", date(2016, 7, 9), "최근영수증발행 CU 구의", Decimal(98021), "online_payment")], "file_name string, evidence_date date, merchant_name string, amount decimal(12,2), payment_method string")
    rows = evaluate.evaluated(seen, truth).withColumn("raw_text", F.lit("사업자번호 116-07-98021\n서울 광진구 자양로\n최근영수증발행"))
    got = {r.reason for r in evaluate.failure_labels(rows).collect()}
    assert got == {"merchant_header_noise", "merchant_address_noise", "amount_business_number", "payment_false_online", "date_parse", "image_quality_low"}


def test_streams(spark, tmp_path):
    at = datetime(2026, 1, 1)
    actions = spark.createDataFrame([(1, 10, 5, "submit", at), (2, 10, 5, "publish", at), (3, 10, 6, "approve", at)], "event_id long, settlement_id long, actor_user_id long, action string, ts timestamp")
    actions.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, own = jobs.events_stream(spark, str(tmp_path / "in"), actions.schema), jobs.stateful_session(spark)
    q = jobs.lifecycle_stream(jobs.events_stream(own, str(tmp_path / "in"), actions.schema)).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.accepted, r.after) for r in own.table("replayed").collect()} == {(1, True, "submitted"), (2, False, "submitted"), (3, True, "approved")}
    settlements = spark.createDataFrame([(10, 1)], "settlement_id long, org_id long")
    members = spark.createDataFrame([(1, "auditor", 5), (1, "auditor", 7), (1, "treasurer", 8)], "org_id long, role string, user_id long")
    f = jobs.fanout_stream(stream, settlements, members, str(tmp_path / "out"), str(tmp_path / "c2"))
    f.awaitTermination(120)
    assert {(r.event_id, r.user_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 7), (2, 7), (2, 8), (3, 8)}


def parsed(spark, kind, *texts, boxes=None):
    """The fields of one receipt, of plain lines or of lines with (top, bottom)."""
    rows = [(1, i, t) for i, t in enumerate(texts)]
    found = layout.page_lines(spark.createDataFrame(rows, "receipt_id long, pos int, text string"))
    if boxes:
        found = spark.createDataFrame([(1, i, t, 0.0, float(a), 240.0, float(b)) for i, (t, (a, b)) in enumerate(zip(texts, boxes, strict=True))], "receipt_id long, pos int, text string, left double, top double, right double, bottom double")
    types = spark.createDataFrame([(1, kind)], "receipt_id long, evidence_type string")
    return layout.parse_receipt(found, types, 2026).head()


PHYSICAL, TRANSFER, ONLINE = "physical_receipt", "bank_transfer_statement", "e_receipt"


@pytest.mark.parametrize(("kind", "texts", "want"), [
    (TRANSFER, ["거래일시 2026-03-19 14:22", "받는분 학생식당", "이체금액 12,300원", "출금계좌 123-45-67890"], (date(2026, 3, 19), "학생식당", 12300, "bank_transfer", 1.0)),
    (ONLINE, ["네이버페이 주문", "결제일 2026.03.20", "판매처 캠퍼스문구", "결제금액 45,000원"], (date(2026, 3, 20), "캠퍼스문구", 45000, "online_payment", 1.0)),
    (PHYSICAL, ["CU 구의본점", "거래일시 2026.04.04 11:20", "현금결제", "받을금액 2,720원"], (date(2026, 4, 4), "CU 구의본점", 2720, "cash", 1.0)),
    (PHYSICAL, ["사업자번호 123-45-67890", "건국대 학생회관 1847카페", "승인일시 2026/03/21 13:22:11", "합계 5,500원 카드"], (date(2026, 3, 21), "건국대 학생회관 1847카페", 5500, "card", 1.0)),
    (PHYSICAL, ["원플레이 건대점 사업자번호 116-07-98021", "결제금액 18,800원 카드"], (None, "원플레이 건대점", 18800, "card", 0.75)),
    (PHYSICAL, ["건국대 학생회관 1847카페", "아메리카노 2,000원", "샌드위치 2,500원", "결제금액 4,500원", "카드"], (None, "건국대 학생회관 1847카페", 4500, "card", 0.75)),
    (PHYSICAL, ["합계 9500원"], (None, "합계 9500원", 9500, None, 0.3)),
])
def test_parsed_texts(spark, kind, texts, want):
    row = parsed(spark, kind, *texts)
    if texts == ["합계 9500원"]:  # a line of noise is no name
        want = (*want[:1], None, *want[2:])
    assert tuple(row[c] for c in ("evidence_date", "merchant_name", "amount", "payment_method", "confidence")) == want


def test_parsed_layouts(spark):
    assert parsed(spark, PHYSICAL, "판매시간 20260404 23:54:53", "합계 28,200원", "카드").evidence_date == date(2026, 4, 4)
    assert parsed(spark, PHYSICAL, "CU 구의본점", "결제금액", "6,360", "NO:3859 15:19", boxes=[(0, 18), (180, 198), (205, 223), (260, 278)]).amount == 6360
    assert parsed(spark, PHYSICAL, "Again", "CU 구의본점", "사업자등록번호 207-41-02918", boxes=[(0, 18), (24, 42), (50, 68)]).merchant_name == "CU 구의본점"
    assert parsed(spark, PHYSICAL, "거래일시", "2026/04/03 11:04", "2028-04-03 10:29", boxes=[(120, 138), (146, 164), (320, 338)]).evidence_date == date(2026, 4, 3)
    assert parsed(spark, PHYSICAL, "가게", "받은금액 10,000", "거스름돈 3,500").amount == 6500
    assert parsed(spark, PHYSICAL, "가게", "4,200", "합계").amount == 4200
    left = spark.createDataFrame([(1, 0, "합계", 0.0, 100.0, 60.0, 118.0), (1, 1, "7,700", 150.0, 103.0, 240.0, 119.0)], "receipt_id long, pos int, text string, left double, top double, right double, bottom double")
    assert [r.text for r in layout.merged_lines(left).collect()] == ["합계 7,700"]


def test_merged_attempts(spark):
    rows = [(1, "background_cropped", 0, PHYSICAL, None, "건국대 학생회관 1847카페", 4000, "card", 0.84, 2, 28), (1, "document_enhanced", 1, PHYSICAL, date(2026, 4, 3), None, 4000, "card", 0.81, 2, 38), (2, "original", 0, PHYSICAL, None, None, None, None, 0.5, 1, 4)]
    attempts = spark.createDataFrame(rows, "receipt_id long, attempt string, v int, evidence_type string, evidence_date date, merchant_name string, amount long, payment_method string, avg_confidence double, line_count int, text_len int")
    got = {r.field: r.value for r in extract.field_consensus(attempts).filter("receipt_id = 1").collect()}
    assert got == {"evidence_date": "2026-04-03", "merchant_name": "건국대 학생회관 1847카페", "amount": "4000", "payment_method": "card"}
    score = {r.attempt: r.score for r in extract.scored(attempts).collect()}
    assert score["background_cropped"] == round(30 + 32 + 12 + 0.84 * 15 + 2 + 28 / 60 + 3, 4)
    assert {r.receipt_id: r.confidence for r in extract.attempt_confidence(attempts).collect()}[2] == 0
    assert {r.receipt_id: r.attempt for r in extract.best_attempt(attempts).collect()}[1] == "background_cropped"


def test_header_words(spark):
    rows = [["거래일자", "비고", "금액"], ["2026-03-02", "회비", "1,000"], ["2026-03-03", "간식", ""]]
    assert [(r.description, r.amount) for r in ingest.statement_rows(grid(spark, rows)).collect()] == [("회비", Decimal(1000))]


def test_addresses(spark):
    texts = ["서울 광진구 자양로", "자양로", "12-34", "카페"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(N.looks_like_address(F.col("t"))).collect()] == [True, False, True, False]


def test_receipts_without_text_have_no_fields(spark):
    """Not even the method that their type would give; blank boxes beside text change nothing."""
    boxes = [(1, 0.0, "합계 5,000"), (1, 2.0, "  "), (2, 0.0, " "), (2, 20.0, ""), (3, 0.0, None), (4, 0.0, "현금 2024-03-05")]
    found = spark.createDataFrame([(i, 0.0, top, 50.0, top + 12, t) for i, top, t in boxes], "receipt_id long, left double, top double, right double, bottom double, text string")
    types = spark.createDataFrame([(1, "e_receipt"), (2, "e_receipt"), (3, "bank_transfer_statement")], "receipt_id long, evidence_type string")
    got = {r.receipt_id: (r.amount, r.payment_method, r.evidence_date, r.confidence) for r in layout.parse_receipt(found, types, 2024).collect()}
    assert got == {1: (5000, "online_payment", None, 0.45), 2: (None, None, None, 0.0), 3: (None, None, None, 0.0), 4: (2024, "cash", date(2024, 3, 5), 0.7)}
    assert layout.parse_receipt(found.filter("receipt_id > 9"), types, 2024).count() == 0
