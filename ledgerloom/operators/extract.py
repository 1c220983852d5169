"""Fields of receipts from their text lines, for all receipts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import merchant_key

#: Words that label a line, in order of precedence.
META = ["사업자", "전화", "tel", "승인번호", "거래번호", "카드번호", "주문번호", "단말기", "가맹점번호", "사업자번호", "판매일자", "결제일시", "테이블"]
SUBTOTAL = ["과세물품가액", "과세", "공급가액", "거래금액", "면세물품가액", "면세", "부가세", "부가가치세", "세액", "봉사료", "소계", "할인", "포인트"]
PAYMENT = ["카드결제", "승인금액", "결제금액", "영수금액", "현금결제", "받은금액"]
TOTAL = ["합계금액", "합계", "총액", "총계", "청구금액", "판매합계", "주문합계", "받을금액"]

#: Keyword dictionaries of whole receipts.
DICTIONARIES = {
    "date": ["거래일시", "거래일자", "거래일", "결제일시", "결제일자", "승인일시", "승인일자", "판매일시", "판매시간", "일시", "날짜", "date"],
    "total": ["결제금액", "승인금액", "합계", "총계", "총액", "청구금액", "받을금액", "판매합계", "이체금액", "출금금액", "입금금액", "amount", "total", "paid"],
    "reject": ["사업자", "전화", "tel", "승인번호", "거래번호", "카드번호", "주문번호", "매출전표", "단말기", "가맹점번호"],
    "online": ["네이버페이", "naver pay", "naverpay", "카카오페이", "kakao pay", "kakaopay", "토스페이", "toss pay", "tosspay"],
    "cash": ["현금", "cash", "거스름돈", "받을금액", "현금영수증"],
    "card": ["카드", "신용", "체크", "승인번호", "승인", "visa", "master"],
    "bank": ["이체", "출금", "입금", "계좌", "송금", "받는분", "은행"],
    "noise": ["영수증", "조회", "발행", "고객용", "사업자", "전화", "주소", "대표자", "부가세", "공급가액", "면세", "과세", "합계", "총계", "총액", "포스", "pos"],
}

#: Numbers of businesses and phones, and amounts with grouped thousands.
BUSINESS_NUMBER = r"\d{2,3}\s*-\s*\d{2}\s*-\s*\d{4,5}"
PHONE = r"(\d{2,4}-\d{3,4}-\d{4})|(1[568]\d{2}-\d{4})"
GROUPED_AMOUNT = r"(?<![\d,])\d{1,3}(?:,\d{3})+(?!\d)"
LOOSE_AMOUNT = r"(?<!\d)(\d{1,3}(?:,\d{3})+|\d{3,9})(?:\.\d{1,2})?(?!\d)"

def any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def keyword_flags(lines: DataFrame) -> DataFrame:
    low = F.lower("text")
    return lines.select("receipt_id", "pos", *(any_of(low, w).alias(f"is_{k}") for k, w in DICTIONARIES.items()))


def amounts_of(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({GROUPED_AMOUNT})"), F.lit(1)), lambda x: F.translate(x, ",", "").cast("bigint"))
    return F.when(F.contains(text, F.lit(",")), found).otherwise(F.array().cast("array<bigint>"))


def amount_tokens(lines: DataFrame) -> DataFrame:
    """(receipt_id, pos, i, value): amounts with grouped thousands, in order."""
    return lines.select("receipt_id", "pos", F.posexplode(amounts_of(F.col("text"))).alias("i", "value"))


def amount_values(lines: DataFrame) -> DataFrame:
    """(receipt_id, pos, i, value): the looser pattern: grouped or of three to nine digits, decimals cut off, over 0."""
    values = F.filter(F.transform(F.regexp_extract_all("text", F.lit(LOOSE_AMOUNT), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("bigint")), lambda v: v > 0)
    return lines.select("receipt_id", "pos", F.posexplode(values).alias("i", "value"))


#: Lines after a label within which its amounts may stand.
WITHIN = 3


def holds(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words; those that hold another of them tell nothing more."""
    least = [w for w in dict.fromkeys(words) if not any(x in w for x in words if x != w)]
    return reduce(lambda c, w: c | F.contains(text, F.lit(w)), least[1:], F.contains(text, F.lit(least[0])))


def _judged(lines: DataFrame) -> DataFrame:
    """Lines as ``classified`` has them with ``tokens``, a line's own amounts; blank lines too, which are no part of it.

    A label looks three lines ahead and an amount three lines back, so one pass over a receipt's lines in order tells all."""
    text = F.trim("text")
    base = lines.select("receipt_id", "pos", "text", F.coalesce(text == "", F.lit(True)).alias("blank"), amounts_of(text).alias("tokens"), F.replace(text, F.lit(" "), F.lit("")).alias("flat"))
    flat, some = F.col("flat"), F.size("tokens") > 0
    label = F.when(holds(flat, META), "meta").when(holds(flat, SUBTOTAL), "subtotal").when(holds(flat, PAYMENT), "payment").when(holds(flat, TOTAL), "total").when(some, "item").otherwise("meta")
    named = base.select("receipt_id", "pos", "text", "blank", "tokens", label.alias("own"))
    # What a line is to its neighbours: an item with amounts to give, a label that lacks amounts, or one that has them.
    part = F.when(F.col("own") == "item", "item").when(F.col("own") != "meta", F.when(some, "label").otherwise("gets"))
    w = Window.partitionBy("receipt_id", "blank").orderBy("pos")
    near = [k for k in range(-WITHIN, WITHIN + 1) if k]
    row = named.withColumn("part", part).withColumns({"n": F.row_number().over(w), **{f"part{k}": F.lead("part", k).over(w) for k in near}, **{f"tokens{k}": F.lead("tokens", k).over(w) for k in near if k > 0}})
    # The first neighbour that is no meta line decides.
    after = F.coalesce(*(F.when(F.col(f"part{k}").isNotNull(), F.struct(F.col(f"part{k}").alias("part"), F.col(f"tokens{k}").alias("tokens"))) for k in near if k > 0))
    gets = F.col("part") == "gets"
    given = F.when(gets & (after["part"] == "item"), after["tokens"])
    gives = (F.col("part") == "item") & (F.coalesce(*(F.col(f"part{-k}") for k in range(1, WITHIN + 1))) == "gets")
    no = F.array().cast("array<bigint>")
    found = row.withColumns({"given": given, "gives": F.coalesce(gives, F.lit(False)), "gets": F.coalesce(gets, F.lit(False))})
    return found.select(
        "receipt_id", "pos", "n", "text", "blank", "tokens",
        F.when((F.col("gets") & F.col("given").isNull()) | F.col("gives"), "meta").otherwise(F.col("own")).alias("label"),
        F.when(F.col("gets"), F.coalesce("given", no)).when(F.col("gives"), no).otherwise(F.col("tokens")).alias("amounts"),
    )


def classified(lines: DataFrame) -> DataFrame:
    """Non-empty lines, numbered, with a label and amounts; a label's line without amounts has the first amounts that
    follow within three lines and before the next label; one that finds none is no label."""
    return _judged(lines).filter("not blank").select("receipt_id", "pos", "n", "text", "label", "amounts")


def _chosen() -> tuple[Column, Column, Column]:
    """Over a receipt's judged lines: the first payment, the largest total, the largest item."""
    of = lambda label, value: F.when((F.col("label") == label) & ~F.col("blank") & (F.size("amounts") > 0), value)
    return F.min_by(of("payment", F.get("amounts", F.lit(0))), of("payment", F.col("n"))), F.max(of("total", F.array_max("amounts"))), F.max(of("item", F.array_max("amounts")))


def _decision() -> tuple[Column, Column]:
    """(amount, selected_from) of ``p``, ``t`` and ``m``, the three that may be chosen."""
    return F.coalesce("p", "t", "m"), F.when(F.col("p").isNotNull(), "payment").when(F.col("t").isNotNull(), "total").when(F.col("m").isNotNull(), "item")


def payment_amount(lines: DataFrame) -> DataFrame:
    """(receipt_id, amount, selected_from): the first payment, else the largest total, else the largest item."""
    got = _judged(lines).groupBy("receipt_id").agg(*(c.alias(name) for c, name in zip(_chosen(), "ptm", strict=True)))
    amount, source = _decision()
    return got.select("receipt_id", amount.alias("amount"), source.alias("selected_from"))


def payment_trace(lines: DataFrame) -> DataFrame:
    """The stages in one table: (receipt_id, stage, pos, i, value, label). 1 tokens, 2 lines, 3 candidates, 4 decision.

    Lines are judged once: each gives its rows of the first three stages, and a receipt's first line the decision too."""
    whole = Window.partitionBy("receipt_id")
    order = whole.orderBy("blank", "pos")
    rows = _judged(lines).withColumns({"first": F.row_number().over(order) == 1, **{name: c.over(whole) for c, name in zip(_chosen(), "ptm", strict=True)}})
    null = lambda kind: F.lit(None).cast(kind)

    def row(stage: int, i: Column, value: Column, label: Column, pos: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), pos.alias("pos"), i.cast("int").alias("i"), value.cast("bigint").alias("value"), label.cast("string").alias("label"))

    pos, kept = F.col("pos"), ~F.col("blank")
    amount, source = _decision()
    none = F.array().cast(f"array<struct<stage:int,pos:{rows.schema['pos'].dataType.simpleString()},i:int,value:bigint,label:string>>")
    tokens = F.transform("tokens", lambda v, i: row(1, i, v, null("string"), pos))
    taken = F.when(F.col("label") != "meta", F.transform("amounts", lambda v, i: row(3, i, v, F.col("label"), pos))).otherwise(none)
    of_line = F.when(kept, F.concat(tokens, F.array(row(2, null("int"), null("bigint"), F.col("label"), pos)), taken)).otherwise(none)
    decided = F.when(F.col("first"), F.array(row(4, null("int"), amount, source, null(rows.schema["pos"].dataType)))).otherwise(none)
    return rows.select("receipt_id", F.inline(F.concat(of_line, decided)))


def payment_method(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(receipt_id, payment_method) from all of a receipt's text: online, then transfer, cash, card, then the type's default."""
    text = lines.groupBy("receipt_id").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")).alias("t")).join(types, "receipt_id", "left")
    has = lambda k: any_of(F.col("t"), DICTIONARIES[k])
    method = F.when(has("online"), "online_payment").when((F.col("evidence_type") == "bank_transfer_statement") | has("bank"), "bank_transfer").when(has("cash"), "cash").when(has("card"), "card").when(F.col("evidence_type") == "e_receipt", "online_payment")
    return text.select("receipt_id", method.alias("payment_method"))


def context_lines(lines: DataFrame) -> DataFrame:
    """Each line with its neighbours, the gap to the next, its place on the page and whether it is of the last five."""
    w = Window.partitionBy("receipt_id").orderBy("pos")
    page = Window.partitionBy("receipt_id")
    return lines.select(
        "receipt_id", "pos", F.lag("text").over(w).alias("previous_text"), F.lead("text").over(w).alias("next_text"), (F.lead("top").over(w) - F.col("top")).cast("double").alias("gap"),
        F.round(F.col("top") / F.max("top").over(page), 4).cast("double").alias("normalized_y"), (F.count("*").over(page) - F.row_number().over(w) < 5).alias("in_last_five"),
    )


def line_merge(boxes: DataFrame, all_receipts: bool = False) -> DataFrame:
    """(receipt_id, row, text, left, top, right, bottom) from boxes (receipt_id, top, left, height, text, and right and
    bottom if they are known): boxes whose centre lies near the mean centre of the row so far join it. With ``all_receipts``
    boxes of null text are in no row, and a receipt of no others has one line of nulls.

    The state is the row's running mean, so each receipt's boxes fold in one array, in one aggregate."""
    if "bottom" not in boxes.columns:
        boxes = boxes.withColumn("bottom", F.col("top") + F.col("height")).withColumn("right", F.col("left"))
    kind = "struct<top:double,left:double,c:double,text:string,right:double,bottom:double>"
    sized = boxes.withColumn("c", F.col("top") + F.col("height") / 2)
    box = F.struct(*(F.col(c).cast("string" if c == "text" else "double").alias(c) for c in ("top", "left", "c", "text", "right", "bottom")))
    here = F.col("text").isNotNull() if all_receipts else F.lit(True)
    rows = sized.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.when(here, box))).alias("b"), F.greatest(F.lit(12.0), 0.7 * F.median(F.when(here, F.col("height")))).alias("reach"))
    fold = F.expr(f"""aggregate(b, cast(array() as array<struct<n:int,sum:double,boxes:array<{kind}>>>),
        (rows, x) -> if(size(rows) > 0 and abs(x.c - element_at(rows, -1).sum / element_at(rows, -1).n) <= reach,
            concat(slice(rows, 1, size(rows) - 1), array(named_struct('n', element_at(rows, -1).n + 1, 'sum', element_at(rows, -1).sum + x.c, 'boxes', concat(element_at(rows, -1).boxes, array(x))))),
            concat(rows, array(named_struct('n', 1, 'sum', x.c, 'boxes', array(x))))))""")
    row = rows.select("receipt_id", (F.posexplode_outer if all_receipts else F.posexplode)(fold).alias("row", "r")).select("receipt_id", "row", F.col("r.boxes").alias("b"))
    words = F.transform(F.array_sort("b", lambda x, y: F.when(x["left"] < y["left"], -1).when(x["left"] > y["left"], 1).otherwise(0)), lambda x: x["text"])
    ends = [(F.array_min if c in ("left", "top") else F.array_max)(F.col(f"b.{c}")).alias(c) for c in ("left", "top", "right", "bottom")]
    return row.select("receipt_id", "row", F.array_join(words, " ").alias("text"), *ends)


#: What a preprocessing adds to an attempt's score, for any receipt or for physical ones, and to a field's.
ANY_BONUS = {"upscaled_enhanced": 3.0, "sharpened": 2.0}
PHYSICAL_BONUS = {"adaptive_binary": 4.0, "background_cropped": 3.0}
FIELD_BONUS = {
    "merchant_name": {"perspective_corrected": 6.0, "background_cropped": 6.0, "upscaled_enhanced": 5.0, "sharpened": 4.0},
    "amount": {"adaptive_binary": 2.0, "upscaled_enhanced": 1.0, "sharpened": 1.0},
    "evidence_date": {"document_enhanced": 3.0, "upscaled_enhanced": 3.0},
    "payment_method": {},
}
#: Fields on which attempts vote.
VOTED = ["evidence_date", "merchant_name", "amount"]
FIELDS = ["evidence_date", "merchant_name", "amount", "payment_method"]


def _bonus(table: dict[str, float]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("attempt")], F.lit(0.0)) if table else F.lit(0.0)


def attempt_score() -> Column:
    """A field-weighted completeness of an attempt, with its confidence, lines, text and preprocessing."""
    has = lambda c, w: F.when(F.col(c).isNotNull(), float(w)).otherwise(0.0)
    fields = has("evidence_date", 18) + has("merchant_name", 30) + has("amount", 32) + has("payment_method", 12)
    made = F.when(F.col("evidence_type") == "physical_receipt", _bonus(PHYSICAL_BONUS)).otherwise(0.0) + _bonus(ANY_BONUS)
    return F.round(fields + 15 * F.col("avg_confidence") + F.least(F.col("line_count"), F.lit(12)) + F.least(F.col("text_len"), F.lit(600)) / 60 + made, 4)


def scored(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("score", attempt_score())


def best_attempt(attempts: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("attempt", "score"), F.struct("score", "avg_confidence", F.negative("v").alias("v"))).alias("b")
    return scored(attempts).groupBy("receipt_id").agg(best).select("receipt_id", "b.attempt", "b.score")


def field_scores(attempts: DataFrame) -> DataFrame:
    """(receipt_id, attempt, v, field, value, score): each attempt's fields with the score of each field there."""
    base = F.col("score") + F.col("avg_confidence") * 10
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (base + _bonus(FIELD_BONUS[f])).alias("field_score")) for f in FIELDS))
    long = scored(attempts).select("receipt_id", "attempt", "v", F.inline(fields)).filter("value <> ''")
    return long.withColumn("score", F.round("field_score", 6)).drop("field_score")


def field_fusion(attempts: DataFrame) -> DataFrame:
    """Per receipt and field the value of the attempt that scores best for it; the first of equals."""
    best = F.max_by(F.struct("value", "attempt", "score"), F.struct("score", F.negative("v").alias("v"))).alias("b")
    return field_scores(attempts).groupBy("receipt_id", "field").agg(best).select("receipt_id", "field", "b.value", "b.attempt", F.round("b.score", 4).alias("score"))


def field_consensus(attempts: DataFrame) -> DataFrame:
    """(receipt_id, field, value, votes, score): a value with two votes or more, the most first, in the attempt that scores
    best for the field; else the best-scored value. Merchants vote by their key; on the payment method nobody votes."""
    vote = F.when(F.col("field") == "merchant_name", merchant_key(F.col("value"))).otherwise(F.col("value"))
    votes = Window.partitionBy("receipt_id", "field", "key")
    counted = field_scores(attempts).withColumn("key", vote).withColumn("votes", F.count("*").over(votes)).withColumn("first", F.min("v").over(votes))
    two = (F.col("votes") >= 2) & F.col("field").isin(VOTED)
    w = Window.partitionBy("receipt_id", "field").orderBy(two.desc(), F.when(two, F.col("votes")).desc_nulls_last(), F.when(two, F.col("first")).asc_nulls_last(), F.desc("score"), "v")
    return counted.withColumn("k", F.row_number().over(w)).filter("k = 1").select("receipt_id", "field", "value", "votes", "score")


def attempt_confidence(attempts: DataFrame) -> DataFrame:
    """(receipt_id, confidence) of the merged fields: the mean of their scores over 100, 1 at most; 0 without a field."""
    mean = field_consensus(attempts).groupBy("receipt_id").agg(F.avg("score").alias("mean"))
    every = attempts.select("receipt_id").distinct().join(mean, "receipt_id", "left")
    return every.select("receipt_id", F.round(F.least(F.coalesce("mean", F.lit(0.0)) / 100, F.lit(1.0)), 4).alias("confidence"))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    n = attempts.groupBy("receipt_id").agg(F.countDistinct("attempt").alias("variant_count"), F.count("*").alias("attempt_count"))
    merged = field_consensus(attempts).groupBy("receipt_id").pivot("field", FIELDS).agg(F.first("value"))
    return n.join(best_attempt(attempts).select("receipt_id", F.col("attempt").alias("best_attempt")), "receipt_id").join(merged, "receipt_id", "left")


def apply_extraction(evidences: DataFrame, results: DataFrame) -> DataFrame:
    """Evidences after extraction: found fields filled in, a hand-set category kept; a failed extraction marks its row."""
    j = evidences.join(results, "evidence_id", "left")
    ok = F.col("ok")
    return j.select(
        "evidence_id", F.when(ok, "needs_review").when(~ok, "failed").otherwise(F.col("status")).alias("status"), F.when(ok, F.coalesce("new_amount", "amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(ok, F.coalesce("budget_category", "new_category")).otherwise(F.col("budget_category")).alias("budget_category"), F.when(~ok, F.col("error")).alias("error"),
    )
