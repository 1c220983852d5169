"""Monthly ledgers: ordered lines with running balances, subtotals, month totals; template sections and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_address, income_expense, normalize_header

MONEY = "decimal(18,2)"


def _dated(evidences: DataFrame) -> DataFrame:
    """Evidences with the calendar month of their ledger section; undated ones join the settlement's first section."""
    income, expense = income_expense(F.col("amount"), F.col("is_refund"))
    first = Window.partitionBy("settlement_id")
    month = F.month("evidence_date")
    return evidences.select("settlement_id", "evidence_id", "evidence_date", "group_name", "created_at", F.coalesce(month, F.min(month).over(first), F.lit(1)).alias("month"), income.alias("income"), expense.alias("expense"))


def ledger_lines(evidences: DataFrame) -> DataFrame:
    """Lines in block order: groups by first appearance, within a group by date and arrival. The group's name stands on
    its first line only; receipts are numbered through the month; the balance starts anew each month."""
    d = _dated(evidences)
    order = [F.asc_nulls_last("evidence_date"), "created_at", "evidence_id"]
    month = Window.partitionBy("settlement_id", "month")
    numbered = d.withColumn("ord", F.row_number().over(month.orderBy(*order)))
    block = numbered.withColumn("block", F.min("ord").over(Window.partitionBy("settlement_id", "month", "group_name")))
    w = month.orderBy("block", "ord")
    lines = block.withColumn("seq", F.row_number().over(w)).withColumn("balance", F.sum(F.col("income") - F.col("expense")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY))
    head = F.lag("block").over(w)
    label = F.when(head.isNull() | (head != F.col("block")), F.col("group_name"))
    return lines.select("settlement_id", "month", "seq", "evidence_id", "evidence_date", label.alias("label"), F.concat(F.col("month").cast("string"), F.lit("*"), F.col("seq").cast("string")).alias("receipt_no"), "income", "expense", "balance", "block", "group_name")


def ledger_totals(evidences: DataFrame) -> DataFrame:
    """Subtotals per (settlement, month, group) and totals per month; level 0 is a group's, 1 the month's."""
    d = _dated(evidences).withColumn("g", F.coalesce("group_name", F.lit("미분류")))
    sums = d.groupBy("settlement_id", "month", "g").agg(F.sum("income").cast(MONEY).alias("income"), F.sum("expense").cast(MONEY).alias("expense"))
    months = sums.groupBy("settlement_id", "month").agg(F.sum("income").cast(MONEY).alias("income"), F.sum("expense").cast(MONEY).alias("expense"))
    return sums.select("settlement_id", "month", F.col("g").alias("group_name"), F.lit(0).alias("level"), "income", "expense").unionByName(months.select("settlement_id", "month", F.lit(None).cast("string").alias("group_name"), F.lit(1).alias("level"), "income", "expense"))


def ledger_report(evidences: DataFrame) -> DataFrame:
    """Lines, group subtotals (in months that use any group) and month totals under one ordinal per month."""
    lines = ledger_lines(evidences)
    rows = lines.select("settlement_id", "month", "block", F.lit(0).alias("kind"), "seq", F.coalesce("label", F.lit("")).alias("text"), F.col("income").cast(MONEY).alias("income"), F.col("expense").cast(MONEY).alias("expense"))
    uses = Window.partitionBy("settlement_id", "month")
    sub = lines.withColumn("grouped", F.max(F.col("group_name").isNotNull()).over(uses)).filter("grouped")
    sub = sub.groupBy("settlement_id", "month", "block").agg(F.first("group_name", ignorenulls=True).alias("g"), F.sum("income").cast(MONEY).alias("income"), F.sum("expense").cast(MONEY).alias("expense"))
    sub = sub.select("settlement_id", "month", "block", F.lit(1).alias("kind"), F.lit(0).alias("seq"), F.concat(F.coalesce("g", F.lit("미분류")), F.lit(" 소계")).alias("text"), "income", "expense")
    total = lines.groupBy("settlement_id", "month").agg(F.sum("income").cast(MONEY).alias("income"), F.sum("expense").cast(MONEY).alias("expense"))
    total = total.select("settlement_id", "month", F.lit(1 << 30).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("seq"), F.concat(F.col("month").cast("string"), F.lit("월 합계")).alias("text"), "income", "expense")
    w = Window.partitionBy("settlement_id", "month").orderBy("block", "kind", "seq")
    return rows.unionByName(sub).unionByName(total).select("settlement_id", "month", F.row_number().over(w).alias("ordinal"), "kind", "text", "income", "expense")


#: Suffixes of files that a report is made of.
FILE_SUFFIXES = "(pdf|png|jpg|jpeg|webp)"


def artifact_manifest(evidences: DataFrame) -> DataFrame:
    """The files of each settlement's report in page order."""
    files = evidences.filter(F.lower("source_file_name").rlike(rf"\.{FILE_SUFFIXES}$"))
    w = Window.partitionBy("settlement_id").orderBy(F.asc_nulls_last("evidence_date"), "created_at", "evidence_id")
    return files.select("settlement_id", "evidence_id", "source_file_name", F.row_number().over(w).alias("page_order"))


def active_template(templates: DataFrame) -> DataFrame:
    """Each template with the time at which the next one of its organisation replaced it; only the newest is active."""
    w = Window.partitionBy("org_id").orderBy("created_at", "template_id")
    later = F.lead("created_at").over(w)
    return templates.select("template_id", "org_id", F.col("created_at").alias("valid_from"), later.alias("valid_to"), later.isNull().alias("is_active"))


def template_cells(mappings: DataFrame, specs: DataFrame, fields: list[str]) -> DataFrame:
    """(settlement_id, cell, field, value): what to write where. Bad addresses and unknown fields are dropped.

    ``mappings`` has (org_id, cell_map); ``specs`` one row per settlement with org_id and the fields."""
    long = specs.select("org_id", "settlement_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", "value"))
    cells = mappings.select("org_id", F.explode("cell_map").alias("cell", "field")).filter(F.col("cell").rlike("^[A-Z]{1,3}[1-9][0-9]*$"))
    return cells.join(long, ["org_id", "field"]).select("settlement_id", "cell", "field", "value")


def effective_mapping(detected: DataFrame, explicit: DataFrame) -> DataFrame:
    """(template_id, cell, field): detected cells, explicit ones in their place where both are given."""
    mine = explicit.select("template_id", "cell", F.col("field").alias("given"))
    return detected.join(mine, ["template_id", "cell"], "full").select("template_id", "cell", F.coalesce("given", "field").alias("field"))


#: What the labels of template fields hold, in order of precedence.
LABEL_RULES = [
    (("결산안제목", "결산안명", "결산제목", "제목"), "title"),
    (("학년도", "학년", "년도"), "academic_year"),
    (("학기",), "semester"),
    (("단과대학", "단과대"), "college_name"),
    (("학과", "학부", "전공"), "department_name"),
    (("단체명", "학생회", "조직명"), "organization_name"),
    (("총지출액", "총지출", "지출합계", "지출총액"), "total_evidence_amount"),
    (("증빙건수", "증빙수", "증빙자료건수"), "evidence_count"),
    (("거래내역건수", "거래건수", "은행거래건수"), "bank_transaction_count"),
    (("매칭건수", "일치건수", "대조일치"), "matched_count"),
    (("금액불일치", "금액불일치건수"), "amount_mismatch_count"),
    (("날짜불일치", "날짜불일치건수"), "date_mismatch_count"),
    (("거래내역누락", "거래누락"), "missing_bank_transaction_count"),
    (("증빙누락",), "missing_evidence_count"),
    (("제출일", "제출일시"), "submitted_at"),
    (("감사일", "감사일시", "승인일"), "audited_at"),
    (("공개일", "공개일시"), "published_at"),
]


def template_labels(cells: DataFrame, rows: int = 80) -> DataFrame:
    """(file_id, field, cell): each field's value cell, right of the first cell whose text holds the field's label."""
    text = F.regexp_replace(normalize_header(F.col("value")), ":", "")
    found = F.lit(None).cast("string")
    for labels, field in reversed(LABEL_RULES):
        found = F.when(text.rlike("|".join(labels)), field).otherwise(found)
    w = Window.partitionBy("file_id", "field").orderBy("row_idx", "col_idx")
    hits = cells.filter(F.col("row_idx") < rows).withColumn("field", found).filter("field is not null").withColumn("k", F.row_number().over(w)).filter("k = 1")
    return hits.select("file_id", "field", cell_address(F.col("row_idx"), F.col("col_idx") + 1).alias("cell"))


def ledger_sections(cells: DataFrame) -> DataFrame:
    """(file_id, month, open_row, header_row, close_row): blocks that a title opens, a header within 8 rows begins and a
    row of the same month within 40 rows closes."""
    flat = cells.withColumn("t", F.regexp_replace("value", r"\s+", ""))
    mark = lambda word: F.regexp_extract("t", rf"^(\d{{1,2}})월{word}", 1)
    opens = flat.filter(mark("결산") != "").groupBy("file_id", F.col("row_idx").alias("open_row")).agg(F.max(mark("결산")).cast("int").alias("month"))
    closes = flat.filter(mark("정산") != "").groupBy("file_id", F.col("row_idx").alias("close_row")).agg(F.max(mark("정산")).cast("int").alias("month"))
    heads = ledger_headers(cells).select("file_id", F.col("row_idx").alias("header_row"))
    with_head = opens.join(heads, "file_id").filter("header_row > open_row and header_row <= open_row + 8").groupBy("file_id", "month", "open_row").agg(F.min("header_row").alias("header_row"))
    return with_head.join(closes, ["file_id", "month"]).filter("close_row > header_row and close_row <= header_row + 40").groupBy("file_id", "month", "open_row", "header_row").agg(F.min("close_row").alias("close_row"))


#: The headers that a ledger row has.
LEDGER_HEADERS = ["날짜", "내용", "수입", "지출", "잔액"]


def ledger_headers(cells: DataFrame, rows: int = 120) -> DataFrame:
    """Rows that hold all headers of a ledger."""
    text = normalize_header(F.col("value"))
    flags = [F.max((F.instr(text, h) > 0).cast("int")).alias(f"h{i}") for i, h in enumerate(LEDGER_HEADERS)]
    every = " and ".join(f"h{i} = 1" for i in range(len(LEDGER_HEADERS)))
    return cells.filter(F.col("row_idx") < rows).groupBy("file_id", "row_idx").agg(*flags).filter(every).select("file_id", "row_idx")


def ledger_layout(cells: DataFrame) -> DataFrame:
    found = ledger_headers(cells).select("file_id").distinct().withColumn("f", F.lit(True))
    return cells.select("file_id").distinct().join(found, "file_id", "left").select("file_id", F.coalesce("f", F.lit(False)).alias("is_ledger"))
