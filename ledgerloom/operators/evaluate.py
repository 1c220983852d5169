"""Extraction quality against labelled receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import match_text, sequence_ratio

#: What hints at a header or an address in a merchant's name, and at a bad image in the notes.
HEADER_HINTS, ADDRESS_HINTS, IMAGE_HINTS = ["영수증", "조회", "발행"], ["서울", "경기", "광진구", "자양로"], ["구겨", "어두", "흐림", "그림자"]


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(*(F.instr(F.lower(F.coalesce(text, F.lit(""))), w) for w in words)) > 0


def evaluated(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per labelled file: expected and predicted fields and which of them match."""
    j = truth.join(predictions, "file_name", "left")
    e, p = match_text(F.coalesce("expected_merchant_name", F.lit(""))), match_text(F.coalesce("merchant_name", F.lit("")))
    j = j.withColumn("_e", e).withColumn("_p", p)
    merchant = (F.col("_e") != "") & (F.col("_p") != "") & ((F.instr("_e", F.col("_p")) > 0) | (F.instr("_p", F.col("_e")) > 0))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = j.withColumn("date_ok", same("expected_date", "evidence_date")).withColumn("merchant_ok", merchant).withColumn("amount_ok", same("expected_amount", "amount")).withColumn("payment_ok", same("expected_payment_method", "payment_method"))
    return out.withColumn("similarity", F.when((F.col("_e") != "") & (F.col("_p") != ""), sequence_ratio(F.col("_e"), F.col("_p")))).withColumn("overall_pass", F.col("date_ok") & F.col("merchant_ok") & F.col("amount_ok") & F.col("payment_ok")).drop("_e", "_p")


def eval_summary(rows: DataFrame) -> DataFrame:
    """Pass rate and accuracy by field: overall, by split and by difficulty (null: unspecified)."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c.replace("_ok", "_accuracy").replace("overall_pass", "overall_pass_rate"))
    named = rows.withColumn("s", F.coalesce("split", F.lit("unspecified"))).withColumn("d", F.coalesce("difficulty", F.lit("unspecified")))
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("split").alias("kind"), F.col("s").alias("name")), F.struct(F.lit("difficulty").alias("kind"), F.col("d").alias("name")))
    return named.select("*", F.inline(kinds)).groupBy("kind", "name").agg(F.count("*").alias("samples"), *(rate(c) for c in ("overall_pass", "date_ok", "merchant_ok", "amount_ok", "payment_ok")))


def failure_labels(rows: DataFrame) -> DataFrame:
    """(file_name, reason): why a failed row failed; a row may have several reasons."""
    name, raw = F.coalesce("merchant_name", F.lit("")), F.coalesce("raw_text", F.lit(""))
    header, address = _any(name, HEADER_HINTS), _any(F.concat(name, F.lit("\n"), raw), ADDRESS_HINTS)
    bad_m = ~F.col("merchant_ok")
    digits = F.regexp_replace(F.col("amount").cast("decimal(12,0)").cast("string"), r"\D", "")
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"(\d{2,3}\s*-\s*\d{2}\s*-\s*\d{4,5})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    business = F.coalesce(F.exists(numbers, lambda x: F.instr(x, digits) > 0), F.lit(False))
    item = F.coalesce(F.col("expected_amount") - F.col("amount") >= 1000, F.lit(False))
    bad_a, bad_p, bad_d = ~F.col("amount_ok"), ~F.col("payment_ok"), ~F.col("date_ok")
    count = sum((c.cast("int") for c in (bad_m, bad_a, bad_p, bad_d)), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(bad_m & header, "merchant_header_noise"), F.when(bad_m & address, "merchant_address_noise"), F.when(bad_m & ~header & ~address, "merchant_parse"),
        F.when(bad_a & business, "amount_business_number").when(bad_a & item, "amount_line_item_selected").when(bad_a, "amount_parse"),
        F.when(bad_p & F.coalesce(F.col("payment_method") == "online_payment", F.lit(False)), "payment_false_online").when(bad_p, "payment_parse"),
        F.when(bad_d, "date_parse"), F.when((count >= 2) & _any(F.col("notes"), IMAGE_HINTS), "image_quality_low"),
    ))
    return rows.filter(~F.col("overall_pass")).select("file_name", F.explode(reasons).alias("reason"))


def failure_reasons(rows: DataFrame) -> DataFrame:
    return failure_labels(rows).groupBy("reason").agg(F.count("*").alias("n"))
