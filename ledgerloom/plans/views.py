"""Bookkeeping tables derived from the star schema, in SQL that Spark and DuckDB both read.

Each view is one select over base tables (in braces) and other views; ``with_views`` puts the ones that a
statement needs before it as common table expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS: dict[str, str] = {
    "organizations": """
        select cast(n_nationkey as bigint) as org_id, concat('Council of ', n_name) as name, r_name as college_name, n_name as department_name,
            cast(date '2019-01-01' + cast(n_nationkey as int) as timestamp) as created_at
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "users": """
        select c_custkey as user_id, concat('u', cast(c_custkey as varchar(20)), '@example.org') as email, c_name as name,
            case when c_custkey % 13 = 0 then null else college_name end as college_name, case when c_custkey % 13 = 0 then null else department_name end as department_name
        from {customer} join organizations on org_id = c_nationkey""",
    "memberships": """
        select c_custkey as membership_id, cast(c_nationkey as bigint) as org_id, c_custkey as user_id,
            case c_mktsegment when 'AUTOMOBILE' then 'treasurer' when 'BUILDING' then 'auditor' when 'FURNITURE' then 'president' else 'student' end as role,
            c_custkey % 3 = 0 as is_primary, cast(date '2020-01-01' + cast(c_custkey % 1000 as int) as timestamp) as created_at
        from {customer} where c_custkey % 10 <> 9
        union all
        select c_custkey + 1000000000, cast((c_nationkey + 1) % 25 as bigint), c_custkey,
            case when c_custkey % 14 = 0 then 'auditor' else 'student' end, c_custkey % 21 = 0, cast(date '2021-01-01' + cast(c_custkey % 500 as int) as timestamp)
        from {customer} where c_custkey % 7 = 0 and c_custkey % 10 <> 9""",
    "lines_": """
        select l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as evidence_id,
            cast(l_shipdate as date) as d, cast(floor(l_extendedprice / 1000) * 1000 as decimal(12,2)) as amount, l_returnflag, l_partkey, l_orderkey,
            cast(c_nationkey as bigint) as org_id
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey""",
    "dated_": """
        select l.*, cast((evidence_id * 7 + floor(evidence_id / 1000)) % 10 as int) as m,
            cast(case when month(d) <= 2 then year(d) - 1 else year(d) end as int) as academic_year,
            case when month(d) between 3 and 6 then '1' when month(d) between 7 and 8 then 'summer' when month(d) between 9 and 12 then '2' else 'winter' end as semester,
            case when month(d) between 3 and 6 then 1 when month(d) between 9 and 12 then 2 when month(d) between 7 and 8 then 3 else 4 end as sem_no
        from lines_ l""",
    "periods_": """
        select distinct org_id, academic_year, semester, sem_no, org_id * 100000 + academic_year * 10 + sem_no as settlement_id,
            cast((org_id * 7 + academic_year * 3 + sem_no) % 8 as int) as k,
            make_date(academic_year, case sem_no when 1 then 3 when 2 then 9 when 3 then 7 else 12 end, 1) as since from dated_""",
    "settlements": """
        select settlement_id, org_id, academic_year, semester, concat('Settlement ', cast(settlement_id as varchar(20))) as title,
            case k when 0 then 'draft' when 1 then 'submitted' when 2 then 'under_audit' when 5 then 'rejected' when 6 then case when settlement_id % 2 = 0 then 'ready_for_review' else 'resubmitted' end else 'approved' end as status,
            case when k <> 0 then cast(since + 70 as timestamp) end as submitted_at,
            case when k in (3, 4, 5, 7) then cast(since + 80 as timestamp) end as audited_at,
            case when k in (4, 7) then cast(since + 90 as timestamp) end as published_at,
            cast((org_id * 31 + academic_year) % 50 as int) as view_count,
            cast(since as timestamp) as created_at, cast(since + cast(settlement_id % 60 as int) as timestamp) as updated_at
        from periods_""",
    "evidences": """
        select evidence_id, org_id * 100000 + academic_year * 10 + sem_no as settlement_id, org_id,
            case when evidence_id % 3 = 0 then 'receipt' when evidence_id % 3 = 1 then 'transfer' else 'e_receipt' end as evidence_type,
            case when evidence_id % 11 = 0 then 'failed' when evidence_id % 11 = 1 then 'extracting' when evidence_id % 11 = 2 then 'uploaded' when evidence_id % 11 = 3 then 'needs_review' else 'confirmed' end as status,
            case when evidence_id % 89 = 0 then null else d end as evidence_date, concat('Shop ', p_name) as merchant_name,
            case when evidence_id % 97 = 0 then null else amount end as amount,
            case when evidence_id % 4 = 0 then 'card' when evidence_id % 4 = 1 then 'cash' when evidence_id % 4 = 2 then 'bank_transfer' end as payment_method,
            p_type as budget_category, case when p_brand in ('Brand#1', 'Brand#4') then null else p_brand end as group_name,
            l_returnflag = 'R' as is_refund, concat('f', cast(evidence_id as varchar(20)), case when evidence_id % 5 = 0 then '.pdf' when evidence_id % 5 = 1 then '.xlsx' else '.JPG' end) as source_file_name,
            cast(d + cast(evidence_id % 5 as int) as timestamp) as created_at, m
        from dated_ join {part} on p_partkey = l_partkey""",
    "bank_tx": """
        select evidence_id as tx_id, org_id * 100000 + academic_year * 10 + sem_no as settlement_id, org_id * 100000 + academic_year * 10 + sem_no as upload_id,
            case when m = 7 then d + 3 else d end as transaction_date, concat('tx ', cast(evidence_id as varchar(20))) as description,
            cast(case when m = 6 then -amount - 2000 else -amount end as decimal(12,2)) as amount, cast(d as timestamp) as created_at
        from dated_ where m < 8
        union all
        select 1000000000000 + o_orderkey, s.settlement_id, s.settlement_id, cast(o_orderdate as date), concat('deposit ', cast(o_orderkey as varchar(20))), cast(o_totalprice as decimal(12,2)), cast(cast(o_orderdate as date) as timestamp)
        from {orders} join {customer} on o_custkey = c_custkey join periods_ s on s.org_id = c_nationkey
            and s.academic_year = case when month(o_orderdate) <= 2 then year(o_orderdate) - 1 else year(o_orderdate) end
            and s.sem_no = case when month(o_orderdate) between 3 and 6 then 1 when month(o_orderdate) between 9 and 12 then 2 when month(o_orderdate) between 7 and 8 then 3 else 4 end
        where o_orderkey % 10 = 0""",
    "uploads": """
        select settlement_id as upload_id, settlement_id, created_at from settlements""",
    "recon": """
        select settlement_id, evidence_id, case when m < 8 then evidence_id end as tx_id,
            case when evidence_id % 50 = 0 then 'manually_resolved' when m < 6 then 'matched' when m = 6 then 'amount_mismatch' when m = 7 then 'date_mismatch' else 'missing_bank_transaction' end as status
        from evidences where status not in ('failed', 'extracting')
        union all
        select settlement_id, null, tx_id, 'missing_evidence' from bank_tx where tx_id > 1000000000000""",
    "numbered_": """
        select settlement_id, org_id, row_number() over (order by settlement_id) - 1 as no from settlements""",
    "comments": """
        select conv_id * 1000 + turn as comment_id, n.settlement_id, a.membership_id as author_membership_id, text as comment,
            cast(date '2001-01-01' + cast((conv_id * 37 + turn) % 300 as int) as timestamp) as created_at
        from (select *, conv_id % (select count(*) from settlements) as no from {conversations}) c join numbered_ n on n.no = c.no
        join (select org_id, membership_id, row_number() over (partition by org_id order by membership_id) - 1 as i, count(*) over (partition by org_id) as c from memberships where role = 'auditor') a
            on a.org_id = n.org_id and a.i = turn % a.c
        where text is not null""",
    "actions": """
        select event_id, n.settlement_id, user_id as actor_user_id, case event_type when 'signup' then 'submit' when 'purchase' then 'approve' when 'error' then 'reject' when 'click' then 'resubmit' else 'publish' end as action, ts
        from (select *, user_id % (select count(*) from settlements) as no from {events}) e join numbered_ n on n.no = e.no""",
    "views": """
        select event_id, n.settlement_id, user_id, ts from (select *, (user_id * 7 + event_id) % (select count(*) from settlements) as no from {events} where event_type = 'view') e join numbered_ n on n.no = e.no""",
    "notifications": """
        select event_id as notification_id, user_id, event_type as notification_type, concat('note ', cast(event_id as varchar(20))) as title, ts as created_at,
            case when event_id % 3 = 0 then null else ts end as read_at from {events}""",
    "invitations": """
        select c_custkey as invitation_id, cast(c_nationkey as bigint) as org_id, concat('u', cast(c_custkey as varchar(20)), '@example.org') as invited_email,
            case c_custkey % 4 when 0 then 'role_transfer' when 1 then 'treasurer_invite' else 'auditor_invite' end as invitation_type,
            case when c_custkey % 5 = 0 then 'treasurer' when c_custkey % 5 = 1 then 'president' when c_custkey % 5 = 2 then 'auditor' else 'student' end as role,
            case when c_custkey % 3 = 0 then 'accepted' when c_custkey % 3 = 1 then 'pending' when c_custkey % 2 = 0 then 'revoked' else 'declined' end as status,
            cast(date '2024-01-01' + cast(c_custkey % 60 + 7 as int) as timestamp) as expires_at, cast(date '2024-01-01' + cast(c_custkey % 60 as int) as timestamp) as created_at, c_custkey as user_id
        from {customer}""",
    "amounts_": """
        select o_orderkey as receipt_id, o_orderkey % 7 as k, cast(o_orderdate as date) as d, 1000 + (o_orderkey * 37) % 900000 as a, 1000 + (o_orderkey * 53) % 500000 as b from {orders}""",
    "receipt_lines": """
        select receipt_id, case when slot < 9 then slot else slot - 1 end as pos, text,
            case slot when 0 then 0.97 when 1 then 0.95 when 2 then 0.9 when 3 then 0.9 when 4 then 0.92 when 5 then 0.96 when 6 then 0.96 when 7 then 0.94 when 8 then 0.5 when 9 then 0.9 when 10 then 0.93 else 0.91 end as confidence,
            case slot when 0 then 10.0 when 1 then 40.0 when 2 then 70.0 when 3 then 90.0 when 4 then 120.0 when 5 then 150.0 when 6 then 170.0 when 7 then 200.0 when 8 then 220.0 when 9 then 220.0 when 10 then 240.0 else 270.0 end as top
        from (select receipt_id, slot, case slot
            when 0 then concat(case when k = 1 then '상호: ' when k = 2 then '가맹점명 ' else '' end, '가게', cast(receipt_id % 50 as varchar(4)), ' 본점')
            when 1 then concat(case when k < 4 then '거래일시 ' else '' end, case k % 3 when 0 then concat(cast(year(d) as varchar(4)), '-', cast(month(d) as varchar(2)), '-', cast(day(d) as varchar(2))) when 1 then concat(cast(year(d) as varchar(4)), '.', cast(month(d) as varchar(2)), '.', cast(day(d) as varchar(2)))
                else concat(cast(year(d) as varchar(4)), '년 ', cast(month(d) as varchar(2)), '월 ', cast(day(d) as varchar(2)), '일') end)
            when 2 then concat('아메리카노 2 ', concat(cast(cast(floor(b / 1000) as int) as varchar(10)), ',', lpad(cast(b % 1000 as varchar(10)), 3, '0')))
            when 3 then case when k <> 3 then case receipt_id % 11 when 2 then '사업자번호 123-45-67890 TEL 02-123-4567' when 5 then '받은금액 950,000' when 8 then '서울 광진구 자양로 12' else '수량 3' end end
            when 4 then concat('부가세 ', concat(cast(cast(floor(b / 1000) as int) as varchar(10)), ',', lpad(cast(b % 1000 as varchar(10)), 3, '0')))
            when 5 then case when k <> 6 then concat('합계금액', case when k % 2 = 0 then concat(' ', concat(cast(cast(floor(a / 1000) as int) as varchar(10)), ',', lpad(cast(a % 1000 as varchar(10)), 3, '0'))) else '' end) end
            when 6 then case when k % 2 = 1 then concat(cast(cast(floor(a / 1000) as int) as varchar(10)), ',', lpad(cast(a % 1000 as varchar(10)), 3, '0')) end
            when 7 then case when k = 4 then '승인금액' when k in (2, 5) then concat('카드결제 ', concat(cast(cast(floor(a / 1000) as int) as varchar(10)), ',', lpad(cast(a % 1000 as varchar(10)), 3, '0'))) end
            when 8 then case when k = 4 then '1' end
            when 9 then case when k <> 4 then case receipt_id % 11 when 5 then '거스름돈 3,500' when 6 then concat('총액 ', cast(a as varchar(10)), '원') else concat('승인번호 ', cast(10000000 + receipt_id as varchar(20))) end end
            when 10 then case when k = 4 then concat(cast(cast(floor(a / 1000) as int) as varchar(10)), ',', lpad(cast(a % 1000 as varchar(10)), 3, '0')) end
            else case k when 0 then '[체크카드 승인]' when 1 then '네이버페이 주문' when 2 then '현금영수증' when 3 then '계좌이체 받는분 총무' when 4 then '   ' else '감사합니다' end end as text
            from amounts_ join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) as r(slot) on 1 = 1) x
        where text is not null""",
    "ocr_attempts": """
        select receipt_id, case v when 0 then 'adaptive_binary' when 1 then case when k < 3 then 'background_cropped' else 'document_enhanced' end else case when k % 2 = 0 then 'upscaled_enhanced' else 'sharpened' end end as attempt, v, case when k < 5 then 'physical_receipt' else 'e_receipt' end as evidence_type, case when receipt_id % 5 = v then null else case when (receipt_id + v) % 4 = 0 then d + 1 else d end end as evidence_date,
            case when receipt_id % 6 = v then null else concat('가게 ', case when (receipt_id + v) % 3 = 0 then cast(receipt_id % 50 as varchar(4)) else concat('-', cast(receipt_id % 50 as varchar(4))) end) end as merchant_name,
            cast(case when receipt_id % 7 = v then null else a + case when (receipt_id * 3 + v) % 5 = 0 then 100 else 0 end end as decimal(12,2)) as amount,
            case when (receipt_id + v) % 3 = 0 then 'card' when (receipt_id + v) % 3 = 1 then 'cash' end as payment_method, cast(0.5 + ((receipt_id * 13 + v * 7) % 50) / 100.0 as double) as avg_confidence, cast(5 + (receipt_id + v) % 20 as int) as line_count, cast(50 + (receipt_id * 11 + v) % 700 as int) as text_len
        from amounts_ join (select 0 as v union all select 1 as v union all select 2 as v) x on 1 = 1""",
    "ground_truth": """
        select concat('r', cast(receipt_id as varchar(20))) as file_name, receipt_id, case when k < 3 then 'physical_receipt' when k < 5 then 'bank_transfer_statement' else 'e_receipt' end as evidence_type, d as expected_date, concat('가게 ', cast(receipt_id % 50 as varchar(4))) as expected_merchant_name, cast(a as decimal(12,2)) as expected_amount,
            'card' as expected_payment_method, case when k = 3 then null when k < 3 then 'train' else 'test' end as split, case when k % 2 = 0 then 'easy' end as difficulty from amounts_""",
    "sheet_rows_": """
        select settlement_id as file_id, settlement_id % 3 as layout, row_number() over (partition by settlement_id order by tx_id) + 1 as row_idx, tx_id, transaction_date as d, amount, description from bank_tx""",
    "sheet_cells": """
        select file_id, case when slot < 4 then row_idx when slot = 4 then cast(0 as bigint) else cast(1 as bigint) end as row_idx, case when slot < 4 then slot when slot = 4 then 0 else slot - 5 end as col_idx,
            case slot
            when 0 then case when tx_id % 31 = 0 then '합계' when layout = 0 then concat(cast(year(d) as varchar(4)), '-', cast(month(d) as varchar(2)), '-', cast(day(d) as varchar(2))) when layout = 1 then concat(cast(year(d) as varchar(4)), '.', lpad(cast(month(d) as varchar(2)), 2, '0'), '.', lpad(cast(day(d) as varchar(2)), 2, '0'), ' 16:59:05') else concat(cast(year(d) as varchar(4)), '/', cast(month(d) as varchar(2)), '/', cast(day(d) as varchar(2))) end
            when 1 then description
            when 2 then case layout when 0 then concat(cast(amount as varchar(20)), '원') when 1 then cast(abs(amount) as varchar(20)) else case when amount < 0 then cast(-amount as varchar(20)) else '0' end end
            when 3 then case layout when 0 then case when tx_id % 4 = 0 then 'memo' end when 1 then case when amount < 0 then '출금' else '입금' end else case when amount > 0 then cast(amount as varchar(20)) else '-' end end
            when 4 then '거래 내역'
            when 5 then case layout when 0 then '거래 일자' when 1 then '거래일시' else '날짜' end
            when 6 then case layout when 0 then '적요' when 1 then '거래명' else '내용' end
            when 7 then case layout when 2 then '출금액' else '거래금액' end
            else case layout when 0 then '메모' when 1 then '구분' else '입금액' end end as value
        from sheet_rows_ join (values (0), (1), (2), (3), (4), (5), (6), (7), (8)) as r(slot) on 1 = 1 where slot < 4 or row_idx = 2""",
    "template_cells_": """
        select settlement_id as file_id, r.row_idx, r.col_idx, r.value from settlements join (values (0, 0, '단체명 :'), (0, 2, '학 과'), (1, 0, '학년도'), (1, 2, '학기'), (2, 0, '결산안 제목'), (2, 2, '증빙 건수'), (3, 0, '총지출'), (3, 3, '학생회'), (4, 0, '금액 불일치 건수'), (4, 2, '승인일'), (5, 0, '3월 결산'), (7, 0, '날 짜'), (7, 1, '내용'), (7, 2, '수입'), (7, 3, '지출'), (7, 4, '잔액'), (20, 0, '3월 정산'), (30, 0, '4월결산'), (60, 0, '4월 정산')) as r(row_idx, col_idx, value) on 1 = 1
        where settlement_id % 3 <> 0 or r.row_idx <> 7""",
    "templates": """
        select c_custkey as template_id, cast(c_nationkey as bigint) as org_id, cast(date '2023-01-01' + cast((c_custkey * 17) % 300 as int) as timestamp) as created_at from {customer}""",
}

_WORD = re.compile(r"\b[a-z_]+\b")


def needed(sql: str, known: tuple[str, ...] = (), kept: Collection[str] = ()) -> list[str]:
    """The views that a statement uses, each after the ones it uses itself; those ``kept`` use none."""
    out = list(known)
    for name in dict.fromkeys(_WORD.findall(sql)):
        if name in VIEWS and name not in out:
            for x in needed(VIEWS[name], tuple(out), kept) if name not in kept else ():
                if x not in out:
                    out.append(x)
            out.append(name)
    return out


def with_views(sql: str, kind: str = "", kept: Collection[str] = ()) -> str:
    ctes = [f"{v} as {kind}({'select * from {' + v + '}' if v in kept else VIEWS[v]})" for v in needed(sql, kept=kept)]
    body = sql.strip()
    if not ctes:
        return body
    if m := re.match(r"with\s+(recursive\s+)?", body):
        return f"with {m[1] or ''}{', '.join(ctes)}, {body[m.end() :]}"
    return f"with {', '.join(ctes)} {body}"


def duckdb_sql(sql: str) -> str:
    """The statement for DuckDB, base tables under their own names; a view that is read twice is made once."""
    text = with_views(sql, "materialized ")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


#: Orders that a task gets about, with their lines or receipts, and the keys by which these tables are dealt.
ORDERS = 25_000
DEALT = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


class Tables:
    """The views over one folder of Parquet tables, as attributes.

    Orders and their lines are dealt by order into as many tasks as their number asks for: the joins, windows and receipts
    of an order need no other exchange, and a task's share stays the same however large the tables are."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.kept = spark, sf_dir, {}

    def keep(self, name: str) -> None:
        """Make a small view once, for the views that read it; it is written, so their filters aren't tried on the rows it is made of."""
        if name not in self.kept:
            self.kept[name] = cut(getattr(self, name))

    def base(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.dealt(table, DEALT[name]) if name in DEALT else table

    @cached_property
    def tasks(self) -> int:
        least = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return max(least, math.ceil(self.spark.read.parquet(f"{self.sf_dir}/orders.parquet").count() / ORDERS))

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(self.tasks, key)

    def sql(self, sql: str) -> DataFrame:
        text = with_views(sql, kept=self.kept)
        used = {t: self.base(t) for t in TABLES if "{" + t + "}" in text} | {t: df for t, df in self.kept.items() if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"select * from {name}")
