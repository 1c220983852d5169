"""Findings of round 3: whole results by steps whose work and memory follow the input."""

from __future__ import annotations

import io
import random
import re
import zipfile
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import extract, layout, reconcile, rollup
from ledgerloom.plans import all_queries, views
from ledgerloom.sources import files
from ledgerloom.streaming import jobs


def test_candidates_are_counted_without_pairs(spark):
    rnd = random.Random(4)
    day = lambda: rnd.choice([None, *(date(2024, 1, 1) + timedelta(i) for i in range(3))])
    amount = lambda: rnd.choice([None, *map(Decimal, ("0", "-5", "5", "90", "-1000", "1005", "1006", "12000", "999999"))])
    ev = [(rnd.randrange(3), i, rnd.choice(["confirmed", "failed"]), day(), amount()) for i in range(150)]
    tx = [(rnd.randrange(3), 1000 + i, day(), amount()) for i in range(150)]
    e = spark.createDataFrame(ev, "settlement_id long, evidence_id long, status string, evidence_date date, amount decimal(12,2)")
    t = spark.createDataFrame(tx, "settlement_id long, tx_id long, transaction_date date, amount decimal(12,2)")
    want = {}
    for s, i, status, d, a in ev:
        if status == "failed" or d is None or a is None:
            continue
        tiers, ids, gaps, a = Counter(), 0, 0, abs(a)
        for s2, j, d2, b in tx:
            b = None if b is None else abs(b)
            same = d == d2 and (a == 0 or (b is not None and abs(b - a) <= max(10 * a, 1000)))
            if s == s2 and (same or a == b):
                tiers[1 if d == d2 and a == b else 2 if d == d2 else 3] += 1
                ids, gaps = ids + j, gaps + (0 if b is None else abs(a - b))
        want[i] = (tiers[1], tiers[2], tiers[3], ids, gaps)
    got = {r.evidence_id: (r.exact, r.near, r.dated, int(r.tx_ids), r.gaps) for r in reconcile.candidate_digest(e, t).collect()}
    assert got == want
    assert sum(v[0] for v in want.values()) and sum(v[1] for v in want.values()) and sum(v[2] for v in want.values())


def shape(df) -> str:
    """The physical plan with all its expressions, before adaptive execution changes it."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def plan(spark, sf_dir, name) -> str:
    return shape(all_queries()[name](spark, sf_dir)).split("== Physical Plan ==")[1]


def test_tasks_grow_with_the_orders(spark, sf_dir, monkeypatch):
    few = views.Tables(spark, sf_dir)
    assert few.tasks == 4
    monkeypatch.setattr(views, "ORDERS", 100)
    many = views.Tables(spark, sf_dir)
    assert many.tasks == 15
    for name in ("orders", "lineitem"):
        assert many.base(name).rdd.getNumPartitions() == 15
    assert many.receipt_lines.rdd.getNumPartitions() == 15


def test_a_merchant_needs_no_amounts_of_neighbours(spark, sf_dir):
    assert r"(?:\.\d{1,2})?(?!\d)" not in plan(spark, sf_dir, "extract_merchant")
    assert r"(?:\.\d{1,2})?(?!\d)" in plan(spark, sf_dir, "extract_amount")


def test_receipts_are_dealt_as_orders_before_their_lines_are_made(spark, sf_dir):
    """Not the lines, which are ten times as many."""
    for name in ("payment_amount", "line_merge", "extract_merchant"):
        assert "hashpartitioning(receipt_id" not in plan(spark, sf_dir, name), name
    assert "Union" not in plan(spark, sf_dir, "line_merge")


def test_ledgers_are_dealt_by_settlement(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "ORDERS", 100)
    assert "hashpartitioning(settlement_id#" in (text := plan(spark, sf_dir, "ledger_lines")) and ", 15), REPARTITION_BY_NUM" in text


def test_results_without_a_link_are_dealt_by_the_other(spark):
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        results = spark.createDataFrame([(1, i if i % 2 else None, None if i % 2 else i, "x") for i in range(200)] + [(1, 500, 501, "y"), (1, None, None, "z")], "settlement_id long, evidence_id long, tx_id long, status string")
        e = spark.createDataFrame([(i, f"m{i}") for i in range(0, 600)], "evidence_id long, merchant_name string")
        t = spark.createDataFrame([(i, f"d{i}") for i in range(0, 600)], "tx_id long, description string")
        rows = [(r.evidence_id, r.tx_id, r.merchant_name, r.description, r.p) for r in reconcile.with_labels(results, e, t).withColumn("p", F.spark_partition_id()).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 202
    assert all(m == (None if i is None else f"m{i}") and d == (None if j is None else f"d{j}") for i, j, m, d, _ in rows)
    assert len({p for i, j, _, _, p in rows if j is None and i is not None}) == 4


def test_recent_settlements_meet_users_as_the_newest_of_each_organisation(spark):
    rnd = random.Random(6)
    at = lambda: rnd.choice([None, *(datetime(2024, 1, 1 + i) for i in range(4))])
    settlements = [(i, rnd.randrange(3), "s", at(), at()) for i in range(60)]
    members = [(u, o, rnd.choice(["treasurer", "president", "student"])) for u in range(8) for o in range(3)] * 2
    s = spark.createDataFrame(settlements, "settlement_id long, org_id long, status string, submitted_at timestamp, created_at timestamp")
    m = spark.createDataFrame(members, "user_id long, org_id long, role string")
    out = rollup.recent_settlements(m, s)
    late = lambda t: (t is None, 0 if t is None else -t.timestamp())
    want = set()
    for u in range(8):
        orgs = {o for v, o, r in members if v == u and r != "student"}
        mine = sorted((x for x in settlements if x[1] in orgs), key=lambda x: (late(x[3]), late(x[4]), x[0]))
        want |= {(u, x[0], "s", k + 1) for k, x in enumerate(mine[:10])}
    assert {tuple(r) for r in out.collect()} == want
    assert not [x for x in shape(out).split("== Physical Plan ==")[1].splitlines() if "Window" in x and "user_id" in x]


def test_a_sheet_is_read_by_tags_without_a_tree():
    xml = '<x:worksheet xmlns:x="urn:x"><x:sheetData><x:row r="3"><x:c r="B3" t="s"><x:v>1</x:v></x:c><x:c t="inlineStr"><x:is><x:r><x:t>a&amp;</x:t></x:r><x:r><x:t>b</x:t></x:r></x:is></x:c><x:c><x:f>1+1</x:f><x:v>2</x:v></x:c><x:c r="AA3"><x:v/></x:c></x:row><x:row><x:c><x:v>9</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    book = lambda sheet: made({"xl/sharedStrings.xml": "<sst><si><t>no</t></si><si><r><t>y</t></r><r><t>es</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})

    def made(files_: dict) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in files_.items():
                z.writestr(k, v)
        return out.getvalue()

    assert list(files.sheet_cells(book(xml))) == [(2, 1, "yes"), (2, 2, "a&b"), (2, 3, "2"), (3, 0, "9")]
    for bad in (xml[:-60], xml.replace("&amp;", "&nothing;"), xml.replace("x:v>1<", "x:v>7<")):
        try:
            list(files.sheet_cells(book(bad)))
        except files._BAD_FILE:
            continue
        raise AssertionError(bad)
    assert [r for r, _ in files._sheet_rows(io.BytesIO(xml.encode()))] == ["3", None]


def test_receipts_are_judged_once(spark, sf_dir):
    for name in ("payment_amount", "payment_trace"):
        assert plan(spark, sf_dir, name).count("FileScan parquet") == 1, name


def test_labels_and_amounts_find_each_other(spark):
    rnd = random.Random(23)
    kinds = {"합계": "total", "부가세 1,000": "subtotal", "카드결제": "payment", "승인금액 7,000": "payment", "빵 2,000 3,000": "item", "물 500,000": "item", "안녕": "meta", "전화 1,234": "meta", " ": None, None: None}
    lines = [(r, p, rnd.choice(list(kinds))) for r in range(150) for p in range(rnd.randrange(1, 12))]
    want, chosen = {}, {}
    for r in range(150):
        mine = [[p, kinds[t], [int(x.replace(",", "")) for x in t.split() if "," in x]] for q, p, t in lines if q == r and kinds[t]]
        done = [x[:] for x in mine]
        for k, (_, kind, amounts) in enumerate(mine):
            if kind in ("meta", "item") or amounts:
                continue
            done[k][1] = "meta"
            for j in range(k + 1, min(k + 4, len(mine))):
                if mine[j][1] == "item":
                    done[k][1:], done[j][1:] = [kind, mine[j][2]], ["meta", []]
                if mine[j][1] != "meta":
                    break
        want |= {(r, p): (n + 1, kind, amounts) for n, (p, kind, amounts) in enumerate(done)}
        of = lambda name: [v for _, kind, a in done if kind == name for v in a]  # noqa: B023, E731
        chosen[r] = next(((f(v), name) for name, f in (("payment", lambda v: v[0]), ("total", max), ("item", max)) if (v := of(name))), (None, None))
    df = spark.createDataFrame(lines, "receipt_id long, pos int, text string")
    assert {(r.receipt_id, r.pos): (r.n, r.label, r.amounts) for r in extract.classified(df).collect()} == want
    assert {r.receipt_id: (r.amount, r.selected_from) for r in extract.payment_amount(df).collect()} == chosen
    trace = extract.payment_trace(df).collect()
    assert {r.receipt_id: (r.value, r.label) for r in trace if r.stage == 4} == chosen and sum(r.stage == 4 for r in trace) == 150
    assert Counter((r.receipt_id, r.pos, r.value, r.label) for r in trace if r.stage == 3) == Counter((*k, v, kind) for k, (_, kind, a) in want.items() if kind != "meta" for v in a)
    assert {(r.receipt_id, r.pos, r.label) for r in trace if r.stage == 2} == {(*k, kind) for k, (_, kind, _) in want.items()}
    assert sum(r.stage == 1 for r in trace) == sum(t.count(",") for _, _, t in lines if t)


def test_a_greedy_match_is_that_of_all_pairs():
    rnd = random.Random(12)
    order = lambda day, a, i, d, b: (1, 0, i) if d == day and b == a else (2, 0, i) if d == day and a == 0 else (2, abs(b - a), i) if d == day and b != reconcile.NO_AMOUNT and abs(b - a) <= max(10 * a, 100_000) else (3, 0, i) if b == a else None
    seen = Counter()
    for _ in range(300):
        some = lambda n: ([rnd.choice([reconcile.NO_DAY, 1, 2, 3]) for _ in range(n)], [rnd.choice([reconcile.NO_AMOUNT, 0, 100, 300, 500, 700, 90_000, 5_000_000]) for _ in range(n)])
        (days, amounts), (tx_days, tx_amounts) = some(rnd.randrange(30)), some(rnd.randrange(30))
        picks, tiers, free = [], [], set(range(len(tx_days)))
        for day, a in zip(days, amounts, strict=True):
            best = min((k for i in free if (k := order(day, a, i, tx_days[i], tx_amounts[i]))), default=None) if day != reconcile.NO_DAY and a != reconcile.NO_AMOUNT else None
            picks.append(best and best[2])
            tiers.append(best and best[0])
            free -= {best[2]} if best else set()
        assert reconcile.match(days, amounts, tx_days, tx_amounts) == (picks, tiers)
        seen.update(tiers)
    assert min(seen[k] for k in (1, 2, 3, None)) > 20


def test_a_settlement_of_one_part_is_not_dealt_by_parts(spark):
    """Its rows are looked at by kinds only; a settlement of several parts is dealt in as many groups as its size asks for."""
    day = date(2024, 1, 1)
    one = [(1, i, "confirmed", day, Decimal(5), datetime(2024, 1, 2)) for i in range(40)]
    many = [(2, 100 + i, "confirmed", day + timedelta(i), Decimal(1000 * i), datetime(2024, 1, 2)) for i in range(40)]
    e = spark.createDataFrame(one + many, "settlement_id long, evidence_id long, status string, evidence_date date, amount decimal(12,2), created_at timestamp")
    t = e.select("settlement_id", (F.col("evidence_id") + 1000).alias("tx_id"), F.col("evidence_date").alias("transaction_date"), "amount", "created_at")
    cut, out = reconcile.reconcile(e, t, split_over=10), reconcile.reconcile(e, t)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, out.collect()))
    parts = {s: cut.filter(F.col("settlement_id") == s).select(F.spark_partition_id()).distinct().count() for s in (1, 2)}
    assert parts[1] == 1 and parts[2] > 1
    assert "FlatMapGroupsInArrow" in shape(cut) and "CoGroups" not in shape(cut)


def test_formats_that_cannot_fit_are_not_tried(spark):
    parts = ["2024", "2024", "1", "05", "+2024", "-", "-", ".", "/", ":", " ", "T", "x", "20240105", "2024-1-5", "2024.01.05", "2024/1/5", " 1:2:3", " 01:02"]
    rnd = random.Random(14)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))) for _ in range(3000)] + ["2024-1-5", "2024.01.05 16:59:05", "2024/1/5 1:2", "20240105", "합계", ""]
    texts = [t for t in texts if not re.search(r"\d{9}|\d{6,}[-./]", t)]  # years that no timestamp holds are an error
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = df.select("t", *(F.try_to_timestamp("t", F.lit(f)).isNotNull().alias(f"got{i}") for i, f in enumerate(scalars.DATE_FORMATS)), *(scalars._may_fit(F.col("t"), f).alias(f"may{i}") for i, f in enumerate(scalars.DATE_FORMATS))).collect()
    assert sum(r[f"got{i}"] for r in hits for i in range(10)) > 100 and not [r.t for r in hits for i in range(10) if r[f"got{i}"] and not r[f"may{i}"]]
    assert [sum(r[f"may{i}"] for i in range(10)) for r in hits[-6:]] == [1, 1, 1, 1, 0, 0]


def test_sheets_are_read_once_in_as_many_tasks_as_are_asked_for(spark, sf_dir):
    rows, status = plan(spark, sf_dir, "statement_rows"), plan(spark, sf_dir, "upload_status")
    assert rows.count("FileScan parquet") == status.count("FileScan parquet") > 0
    for text in (rows, status):
        assert re.search(r"hashpartitioning\(file_id#\d+L?, 4\), REPARTITION_BY_NUM", text) and "filter(cells" not in text.replace("transform(filter(cells", "")


def test_a_file_may_have_a_document_a_line(spark, sf_dir, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"lines": [{"text": "x", "confidence": 0.5}, {"text": "y", "confidence": 1}]}\n[{"text": "z", "confidence": 0.1}]\n')
    got = files.ocr_lines_json(spark, str(tmp_path / "j"), by_line=True)
    assert sorted((r.pos, r.text, r.confidence) for r in got.collect()) == [(0, "x", 0.5), (0, "z", 0.1), (1, "y", 1.0)]


def test_periods_are_made_once(spark, sf_dir):
    """Of the lines only evidences and transactions are made again, and a settlement's filter isn't tried on lines."""
    assert plan(spark, sf_dir, "public_settlements").count("FileScan parquet [l_") == 1
    for name in ("auditor_worklist", "settlement_rollup"):
        assert plan(spark, sf_dir, name).count("FileScan parquet [l_") == 4, name  # evidences and transactions, and both for their links
    assert "make_date" not in plan(spark, sf_dir, "public_periods")


def test_an_invitation_decided_at_once_costs_one_look_at_its_state():
    calls, timers, state = [], set(), {}

    class Handle:
        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return state.get("due")

        def update(self, v):
            calls.append("update")
            state["due"] = v

        def clear(self):
            calls.append("clear")
            state.pop("due")

        def registerTimer(self, at):
            calls.append("register")
            timers.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            timers.remove(at)

    x = jobs.Expiry()
    x.init(Handle())
    at = lambda d: datetime(2024, 1, d)
    ms = lambda d: int(at(d).timestamp() * 1000) + 1
    row = lambda event, day, due=None: Row(event=event, ts=at(day), expires_at=due and at(due))
    told = lambda *rows: [r.status for r in x.handleInputRows((1,), iter(rows), None)]
    assert told(row("accepted", 2), row("created", 1, 9)) == ["pending", "accepted"] and calls == ["get"] and not timers
    assert told(row("created", 1, 9)) == ["pending"] and timers == {ms(9)} and state == {"due": (ms(9),)}
    assert told(row("created", 2, 12)) == ["pending"] and timers == {ms(12)}
    assert told(row("tick", 3), row("accepted", 20)) == [] and timers == {ms(12)}
    assert told(row("declined", 3)) == ["declined"] and not timers and not state


def test_candidates_are_pairs(spark, sf_dir):
    """Every pair is a row, and the digest's counts and sums are those of the pairs."""
    pairs, digest = (all_queries()[name](spark, sf_dir) for name in ("recon_candidates", "recon_candidate_digest"))
    assert pairs.columns == ["settlement_id", "evidence_id", "tx_id", "tier", "gap"]
    told = digest.agg(F.sum("exact"), F.sum("near"), F.sum("dated"), F.sum("tx_ids"), F.sum("gaps")).first()
    of = lambda k: F.count_if(F.col("tier") == k)
    assert pairs.agg(of(1), of(2), of(3), F.sum("tx_id").cast("decimal(38,0)"), F.sum("gap").cast("decimal(38,2)")).first() == told and min(told) > 0


def test_an_evidence_looks_for_its_day_in_few_classes(spark):
    e = spark.createDataFrame([(1, i, date(2024, 1, 1), Decimal(a)) for i, a in enumerate(("0", "5", "90", "50000", "9999999999.99"))], "settlement_id long, evidence_id long, evidence_date date, a decimal(12,2)")
    t = spark.createDataFrame([(1, i, date(2024, 1, 1), Decimal(2) ** k) for i, k in enumerate(range(34))], "settlement_id long, tx_id long, transaction_date date, b decimal(12,2)")
    met = reconcile.day_pairs(e, t, tasks=7)
    plan = shape(met)
    assert re.search(r"hashpartitioning\(settlement_id#\d+L?, evidence_date#\d+, class#\d+, 7\), REPARTITION_BY_NUM", plan) and "SortMergeJoin" in plan
    most = {r.evidence_id: (r.classes, r.most) for r in met.groupBy("evidence_id").agg(F.count_distinct("class").alias("classes"), F.max("b").alias("most")).collect()}
    assert {i: n for i, (n, _) in most.items()} == {0: 6, 1: 1, 2: 2, 3: 3, 4: 6} and most[3][1] < 32 * 550_000


def test_dates_are_looked_for_where_they_can_be(spark):
    """A receipt's date is that of a plain search in each line, alone and with the next; most lines have no text to search."""
    rnd = random.Random(11)
    parts = ["2024", "20240305", "24.3.5", "2024-13-01", "02-123-4567", "1999년", "3월", "31일", "2월 30일", "-", ".", "/", "5", "거래일시", "합계 9,000", "2024 . 2", "29", "가게"]
    receipts = {i: [(j, rnd.choice(["", " ", "  "]).join(rnd.choices(parts, k=rnd.randint(1, 3))), 20.0 * j if i % 3 else 60.0 * j) for j in range(rnd.randint(1, 5))] for i in range(400)}
    rows = [(i, j, text, 0.0, top, 100.0, top + 12) for i, lines in receipts.items() for j, text, top in lines]
    lines = spark.createDataFrame(rows, "receipt_id long, pos int, text string, left double, top double, right double, bottom double")
    types = spark.createDataFrame([(i, "e_receipt") for i in receipts], "receipt_id long, evidence_type string")

    def best(lines):
        found = []
        for j, text, top in lines:
            after = lines[j + 1] if j + 1 < len(lines) else None
            joined = [f"{text} {after[1]}"] if after and max(after[2] - top - 12, 0) <= layout.NEAR else []
            for ctx, t in enumerate([text, *joined]):
                word = any(w in t.lower() for w in extract.DICTIONARIES["date"])
                for way, pattern in enumerate(layout.DATES):
                    for k, (y, m, d) in enumerate(re.findall(pattern, t, re.ASCII)):
                        y = int(y) + 2000 if int(y) < 100 else int(y)
                        try:
                            day = date(y, int(m), int(d))
                        except ValueError:
                            continue
                        score = 50 + 22 * word - 0.8 * j + 6 * (top / (lines[-1][2] + 12) <= 0.35) - abs(y - 2024) * 4 - 12 * (y > 2025 or y < 2020)
                        found.append((round(score, 6), -j, -ctx, -way, -k, day))
        return max(found)[-1] if found else None

    want = {i: best(lines) for i, lines in receipts.items()}
    got = {r.receipt_id: r.evidence_date for r in layout.fields(lines, types, 2024).collect()}
    assert got == want and None in want.values() and len(set(want.values())) > 5
    text = shape(layout.fields(lines, types, 2024)).split("== Physical Plan ==")[1]
    assert text.count("regexp_extract_all") <= 5  # the amounts, and each pattern of a date once
    looked = layout.page(lines, types).select("text", layout.date_texts().alias("t")).collect()
    assert {len(r.t) if r.t else 0 for r in looked} == {0, 1, 2}


def test_rows_are_written_as_parquet_and_shuffled_once(spark, monkeypatch):
    rnd = random.Random(12)
    day = lambda: rnd.choice([None, *(date(2024, 1, 1) + timedelta(i) for i in range(40))])
    amount = lambda: rnd.choice([None, *(Decimal(1000 * i) for i in range(60))])
    made = lambda: datetime(2024, 1, 1) + timedelta(rnd.randrange(50))
    e = spark.createDataFrame([(i % 4, i, "confirmed", day(), amount(), made()) for i in range(160)], "settlement_id long, evidence_id long, status string, evidence_date date, amount decimal(12,2), created_at timestamp")
    t = spark.createDataFrame([(i % 4 if i % 9 else 7, 1000 + i, day(), amount(), made()) for i in range(160)], "settlement_id long, tx_id long, transaction_date date, amount decimal(12,2), created_at timestamp")
    rows = lambda d: sorted(map(str, d.collect()))
    whole, cut = reconcile.reconcile(e, t), reconcile.reconcile(e, t, split_over=20)
    for d in (whole, cut):
        text = shape(d).split("== Physical Plan ==")[1]
        assert text.count("Exchange hashpartitioning") == 1 and "FileScan parquet" in text and not re.search(r"Scan ExistingRDD\[[^]]*created_at", text)
    monkeypatch.setattr(reconcile, "BROADCAST_IDS", 0)
    shuffled = reconcile.reconcile(e, t, split_over=20)
    assert shape(shuffled).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") > 1
    assert rows(whole) == rows(cut) == rows(shuffled) and len(rows(whole)) > 200
