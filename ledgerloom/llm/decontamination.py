"""Benchmark decontamination by template windows.

Texts are made canonical word by word: numbers, names (capitals within a sentence) and units after
numbers become typed placeholders. Windows of canonical words of the benchmark are joined by hash with
those of all documents. Where placeholders stand in matched windows, the words behind them are compared:
a re-parameterised question puts one word in the place of each of the item's words throughout, and text
that only looks alike does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, strip_ws, unused

#: Units that count as such after a number.
UNITS = (
    "mm|cm|m|km|inch|inches|ft|feet|foot|yard|yards|mile|miles|meter|meters|metre|metres|kilometers|kilometres|"
    "mg|g|kg|lb|lbs|oz|gram|grams|kilogram|kilograms|pound|pounds|ton|tons|"
    "ml|l|liter|liters|litre|litres|gallon|gallons|cup|cups|"
    "s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|"
    "percent|cent|cents|dollar|dollars|euro|euros|usd|eur|degrees|mph|kmh|watts|volts"
)

_WS = r"[\x20\x09-\x0D]"
#: Rows or windows up to this number are broadcast; beyond, the join is shuffled.
SENT = 1_000_000


def raw_words(text: Column) -> Column:
    """The words of a text; none for a null or blank one."""
    return F.filter(F.split(strip_ws(F.coalesce(text, F.lit(""))), _WS + "+"), lambda w: w != "")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"""[.,;:!?"')\]](?<=\S.)[.,;:!?"')\]]*(?=\s|$)""", "")


def canonical_words(text: Column, units: str = UNITS) -> Column:
    """As many words as raw_words has, in canonical form."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}[\p{L}'’-]*", "<name>")
    t = F.regexp_replace(F.lower(t), r"[$€£]?\d[\d.,:/]*%?", "<num>")
    t = F.regexp_replace(t, rf"<num>( ?)(?:{units})(?![\p{{L}}])", "<num>$1<unit>")
    return raw_words(_plain(t))


def spaced(text: Column) -> Column:
    """The text with each sign of a script without spaces between words as a word of its own."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u0E00-\x{3FFFF}&&[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]]", " $0 ")


def literal_words(text: Column) -> Column:
    """As many words as raw_words has, lower-cased and without punctuation behind them."""
    return raw_words(_plain(F.lower(F.coalesce(text, F.lit("")))))


def hashed(df: DataFrame) -> DataFrame:
    """``df`` with ``c`` and ``r``, canonical and literal words, as arrays of hashes: equal where a word is literal."""
    return df.withColumn("c", F.zip_with("c", "r", lambda c, r: F.when(c == r, F.xxhash64(r)).otherwise(F.xxhash64(c, F.lit(1))))).withColumn("r", F.transform("r", lambda r: F.xxhash64(r)))


def windows(words: str, size: int | Column) -> Column:
    """array<hash>: each window of ``size`` words, in their order."""
    n = F.size(words) - size + 1
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<bigint>"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 8,
    least_words: int = 4,
    share: float = 0.3,
    run: int = 13,
    literal: float = 0.6,
    units: str = UNITS,
) -> DataFrame:
    """(id, item, n_windows, coverage, n_slots, n_changed) for each document and item that it leaks.

    A window of the item is found verbatim, whatever its words, or as a template, if a share of ``literal`` of its words
    at least are literal: with fewer, placeholders alone would make texts alike. ``units`` are those told after numbers. ``coverage`` is the share of the item's windows found, or that of those which can be found as
    templates if it is greater, at least ``share``, or less where ``run`` words on end are found verbatim. Items of fewer than ``size`` words are one window, of fewer
    than ``least_words`` are found verbatim only. In scripts without spaces each sign is a word. ``n_slots`` are
    the item's words behind placeholders in the matched windows, ``n_changed`` those that the document has
    otherwise; where one of them stands for several words of the document, a match counts without the windows that
    hold it, other than verbatim ones. Null texts and ids are found nowhere; repeated rows count once.
    Several texts of one item are looked for one by one, and the one with the most coverage is given. An empty table on
    either side gives no rows; other columns are not looked at, whatever their names."""
    items = cut(
        benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).filter("item is not null").distinct()
        .withColumn("s", spaced(F.col("t")))
        .select("item", F.xxhash64("t").alias("th"), literal_words(F.col("s")).alias("i_raw"), canonical_words(F.col("s"), units).alias("i_words"))
        .withColumn("size", F.least(F.size("i_words"), F.lit(size))).filter("size > 0")
        .withColumn("slot", F.zip_with("i_words", "i_raw", lambda c, r: c != r))
    )
    made = hashed(items.withColumn("c", F.col("i_words")).withColumn("r", F.col("i_raw"))).select("item", "th", "size", "slot", F.posexplode(F.arrays_zip(windows("c", F.col("size")).alias("c"), windows("r", F.col("size")).alias("r"))).alias("i_at", "w"))
    literals = F.col("size") - F.size(F.filter(F.slice("slot", F.col("i_at") + 1, F.col("size")), lambda x: x))
    made = made.select("item", "th", "size", "i_at", "w", (literals < F.col("size")).alias("slotted"), ((literals >= F.ceil(F.col("size") * literal - 1e-9)) & ((F.col("size") >= least_words) | (literals == F.col("size")))).alias("open"))
    ways = F.filter(F.array(F.struct(F.col("w.r").alias("hash"), F.lit(True).alias("verbatim")), F.struct(F.col("w.c").alias("hash"), F.lit(False).alias("verbatim"))), lambda x: x.verbatim | (F.col("slotted") & F.col("open")))
    filed = made.select("item", "th", "size", "i_at", "slotted", "open", F.inline(ways))
    whole = made.groupBy("item", "th").agg(F.count("*").alias("of"), F.sum(F.col("open").cast("int")).alias("of_open"))
    filed = cut(filed.join(whole, ["item", "th"]))
    small = filed.count() <= SENT
    sizes = [r["size"] for r in filed.select("size").distinct().collect()] or [size]  # as many values as ``size`` at most
    worded = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), spaced(F.col(text_col)).alias("s"))
    worded = hashed(worded.select("doc", canonical_words(F.col("s"), units).alias("c"), literal_words(F.col("s")).alias("r")))
    found = None
    for s in sorted(sizes):
        mine = filed.filter(F.col("size") == s).drop("size")
        looked = worded.select("doc", F.posexplode(F.arrays_zip(windows("c", s).alias("c"), windows("r", s).alias("r"))).alias("d_at", "w"))
        looked = looked.select("doc", "d_at", F.explode(F.when(F.col("w.c") == F.col("w.r"), F.array("w.r")).otherwise(F.array("w.c", "w.r"))).alias("hash"))
        hit = looked.join(F.broadcast(mine) if small else mine, "hash").select("doc", "item", "th", "of", "of_open", "d_at", "i_at", "slotted", "open", "verbatim", F.lit(s).alias("size"))
        found = hit if found is None else found.unionByName(hit)
    found = found.groupBy("doc", "item", "th", "of", "of_open", "d_at", "i_at", "slotted", "open", "size").agg(F.max("verbatim").alias("verbatim"))
    found = cut(found.withColumn("shift", F.col("d_at") - F.col("i_at")))
    key, at_shift = ["doc", "item", "th"], ["doc", "item", "th", "shift"]
    counts = [F.countDistinct("i_at").alias("n_windows"), F.countDistinct(F.when(F.col("open"), F.col("i_at"))).alias("n_open"), F.first("of").alias("of"), F.first("of_open").alias("of_open")]
    coverage = F.greatest(F.col("n_windows") / F.col("of"), F.when(F.col("of_open") > 0, F.col("n_open") / F.col("of_open")).otherwise(0.0))
    enough = coverage >= share
    need = F.greatest(F.lit(run) - F.col("size") + 1, F.lit(1))
    on_end = F.exists(F.transform("ats", lambda x, k: F.get("ats", k + need - 1) - x == need - 1), lambda v: F.coalesce(v, F.lit(False)))
    runs = cut(found.filter("verbatim").groupBy(*at_shift, "size").agg(F.sort_array(F.collect_set("i_at")).alias("ats")).filter(on_end).select(*key).distinct())
    likely = cut(found.join(found.groupBy(*key).agg(*counts).filter(enough).select(*key).union(runs).distinct(), key))

    slotted = likely.filter("slotted")
    ids = cut(slotted.select("doc").distinct())
    few = F.broadcast(ids) if ids.count() <= SENT else ids
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).join(few, "doc", "left_semi")
    texts = texts.select("doc", literal_words(spaced(F.col("t"))).alias("d_raw"))
    at = F.explode(F.filter(F.sequence(F.col("i_at"), F.col("i_at") + F.col("size") - 1), lambda i: F.get("slot", i)))
    slots = (
        slotted.select(*at_shift, "i_at", "size").join(items.select("item", "th", "slot", "i_raw"), ["item", "th"])
        .select(*at_shift, "i_raw", at.alias("i")).distinct()
        .join(texts, "doc")
        .select(*at_shift, "i", F.get("i_raw", F.col("i")).alias("of_item"), F.get("d_raw", F.col("i") + F.col("shift")).alias("of_doc"))
        .groupBy(*at_shift, "of_item").agg(F.countDistinct("of_doc").alias("kinds"), F.max((F.col("of_doc") != F.col("of_item")).cast("int")).alias("changed"), F.collect_set("i").alias("places"))
        .groupBy(*at_shift).agg(F.collect_list(F.when(F.col("kinds") == 1, F.struct("places", "changed"))).alias("good"), F.flatten(F.collect_list(F.when(F.col("kinds") > 1, F.col("places")))).alias("bad"))
    )
    void = F.coalesce(F.exists("bad", lambda i: (i >= F.col("i_at")) & (i < F.col("i_at") + F.col("size"))), F.lit(False))
    sound = likely.join(slots, at_shift, "left").filter(F.col("verbatim") | ~void)
    reached = F.array_distinct(F.flatten(F.transform(F.collect_set("i_at"), lambda x: F.sequence(x, x + F.first("size") - 1))))
    per_shift = sound.groupBy(*at_shift).agg(reached.alias("reached"), F.first("good").alias("good"))
    seen = F.filter("good", lambda g: F.arrays_overlap(g.places, "reached"))
    per_shift = per_shift.select(*key, seen.alias("seen")).groupBy(*key).agg(F.max(F.coalesce(F.size("seen"), F.lit(0)).cast("long")).alias("n_slots"), F.max(F.coalesce(F.size(F.filter("seen", lambda g: g.changed == 1)), F.lit(0)).cast("long")).alias("n_changed"))
    judged = sound.groupBy(*key).agg(*counts).join(per_shift, key)
    best = F.max(F.struct(F.round(coverage, 6).alias("coverage"), "n_windows", "n_slots", "n_changed")).alias("b")
    kept = judged.join(runs.withColumn("run", F.lit(True)), key, "left").filter(enough | F.col("run")).groupBy("doc", "item").agg(best)
    return kept.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.n_windows", "b.coverage", "b.n_slots", "b.n_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """``docs`` less the documents that leak an item; rows with a null id stay, and so does every row where the benchmark
    is empty. An empty table gives no rows; all columns are handed on, whatever their names."""
    (name,) = unused(docs, "bad")
    bad = cut(leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(name)).distinct())
    few = F.broadcast(bad) if bad.count() <= SENT else bad
    return docs.join(few, docs[id_col] == F.col(name), "left_anti")
