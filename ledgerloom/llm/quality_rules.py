"""Quality rules whose thresholds come from mergeable quantile sketches.

A sketch is a log-linear histogram: values below 32 have a bucket each, larger ones 32 buckets per
power of two, so a quantile is off by 1/32 of its value at most. Sketches merge by adding counts,
which rollup() does for (language, source), language and everything; a stratum with few rows falls
back on the sketch above it. Word length is held against fences around its stratum's quartiles. The
other measures are 0 for most documents, so that their quartiles say nothing. Their sketches tell the
zeros from the rest, and the share of zeros gives the rate at which a stratum's texts have such
events. A document is beyond if its share lies above a fence set by the median and the ninth decile,
and its events are more than its length explains at that rate. What is allowed so grows with the
text, and all of it comes from the sketches. The thresholds are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Measures per document as whole numbers: means of word length in hundredths, shares in parts of 10,000.
MEASURES = ("m_length", "m_symbols", "m_dup_lines", "m_repeats")
LOW_SIDED = ("m_length",)

#: Measures that are 0 for most documents: what they count, of how many, and how much of it one event is. A repeated
#: window of three words is six words, as it is there twice.
TAILED = {"m_symbols": ("n_symbols", "word_chars", 1), "m_dup_lines": ("n_dup_lines", "n_lines", 1), "m_repeats": ("n_repeat_words", "n_words", 6)}

#: Up to so many strata's thresholds are broadcast; more are joined by a shuffle.
STRATA_SENT = 100_000

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    window = ids[:n]
    for k in range(1, size):  # renamed at each step, so that keys never overflow
        window = window * len(known) + ids[k : n + k]
        if k < size - 1 and len(known) ** 3 >= 1 << 62:
            window = np.unique(window, return_inverse=True)[1]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : n + k] |= again
    return int(covered.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        rows = np.zeros((len(texts), len(COUNTS)), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            words = t.split()
            raw = np.frombuffer(t, np.uint8)
            starts = (raw & 0xC0) != 0x80  # one for each code point
            lines = [x for x in t.split(b"\n") if x.strip()]
            chars = int(starts.sum()) - int(_WS[raw].sum())
            rows[i] = (len(words), chars, int(_SYMBOL[raw].sum()), len(lines), len(lines) - len(set(lines)), repeated_words(words))
        counts = [pa.array(rows[:, k]) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*batch.schema.names[:-1], *COUNTS])


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number of 0 or more."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.when(v < 32, v).otherwise(shift * 32 + F.expr("0") + F.call_function("shiftright", v, shift)).cast("int")


def bucket_floor(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.floor((b - 32) / 32)
    return F.when(b < 32, b.cast("long")).otherwise(F.call_function("shiftleft", (b - shift * 32).cast("long"), shift.cast("int")))


def sketches(measured: DataFrame, strata: list[str]) -> DataFrame:
    """(strata..., level, measure, b, n, size) for every stratum and all that it rolls up into: shares and lengths, and the
    counts behind the shares with the sum of what they are counted of."""
    values = [F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b"), F.lit(0).cast("long").alias("size")) for m in MEASURES]
    values += [F.struct(F.lit(c).alias("measure"), bucket(F.col(c)).alias("b"), F.col(of).alias("size")) for c, of, _ in TAILED.values()]
    long = measured.select(*strata, F.explode(F.array(*values)).alias("x")).select(*strata, "x.*")
    counts = long.groupBy(*strata, "measure", "b").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    levels = [
        counts.select(*(F.col(c) if i < k else F.lit(None).cast("string").alias(c) for i, c in enumerate(strata)), F.lit(k).alias("level"), "measure", "b", "n", "size")
        for k in range(len(strata), -1, -1)
    ]
    merged = levels[0]
    for x in levels[1:]:
        merged = merged.unionByName(x)
    return merged.groupBy(*strata, "level", "measure", "b").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


#: What thresholds() gives for a measure: fences of its values; or for a count the rate of events and the bar.
FENCES, RATES = ("low", "high"), ("rate", "bar")


def thresholds(sketch: DataFrame, strata: list[str], reach: float, tail_reach: float, chance: float) -> DataFrame:
    """(strata..., level, measure, n, low, high, rate, bar).

    Fences lie ``reach`` quartile ranges beyond the quartiles, or, for measures in TAILED, ``tail_reach`` times the way from
    the median to the ninth decile beyond the latter; and the sketch's error. Of counts, ``rate`` is the one at which events
    by chance would leave as many documents without any, and ``bar`` the logarithm above which less than ``chance``
    documents of the stratum would come by chance."""
    at = Window.partitionBy(*strata, "level", "measure")
    seen = sketch.withColumn("upto", F.sum("n").over(at.orderBy("b"))).withColumn("all", F.sum("n").over(at))
    quantile = lambda k, of: F.min(F.when(F.col("upto") * of >= F.col("all") * k, bucket_floor(F.col("b"))))
    table = seen.groupBy(*strata, "level", "measure").agg(
        F.max("all").alias("n"), quantile(1, 4).alias("q1"), quantile(1, 2).alias("q2"), quantile(3, 4).alias("q3"), quantile(9, 10).alias("d9"), F.sum("size").alias("size"),
        F.greatest(F.sum(F.when(F.col("b") == 0, F.col("n"))), F.lit(1)).alias("without"),
    )
    error = lambda q: F.floor(F.col(q) / 32)
    width = F.floor((F.col("q3") - F.col("q1")) * reach)
    tail = F.col("d9") + F.floor((F.col("d9") - F.col("q2")) * tail_reach) + error("d9")
    low = F.when(F.col("measure").isin(*LOW_SIDED), F.col("q1") - width - error("q1"))
    high = F.when(F.col("measure").isin(*TAILED), tail).otherwise(F.col("q3") + width + error("q3"))
    rate = F.ln(F.col("n") / F.col("without")) * F.col("n") / F.greatest(F.col("size"), F.lit(1))
    return table.select(*strata, "level", "measure", "n", low.alias("low"), high.alias("high"), rate.alias("rate"), F.ln(F.col("n") / chance).alias("bar"))


def inexplicable(events: Column, size: Column, rate: Column, bar: Column) -> Column:
    """Whether so many events have a probability under exp(-bar) where rate * size are to be expected (Chernoff's bound)."""
    mean = rate * size
    return F.coalesce((events > mean) & (F.round(events * F.ln(events / mean) - events + mean - bar, 6) > 0), F.lit(False))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata: tuple[str, ...] = ("lang", "source"),
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_rows: int = 200,
    reach: float = 3.0,
    tail_reach: float = 9.0,
    chance: float = 0.01,
) -> DataFrame:
    """The id, strata, counts, measures, ``base_failed`` and ``kept`` of every document.

    A null text counts as empty and fails the base rule; a null stratum is a stratum of its own.
    Repeated lines are a share of the lines with a word, symbols one of the characters in words, repeated words one of
    the words. Where a tenth or more of a stratum is junk of one kind, that kind shapes its fence and stays. ``chance`` is
    the number of documents of a stratum that may be beyond a rate by chance.
    Rows that fail the base rule shape no threshold. A stratum with fewer than ``min_rows`` rows takes
    the thresholds of the level above it. Repeated rows count as often as they occur; an empty table
    gives no rows; other columns are not looked at."""
    names = list(strata)
    source = docs.select(F.col(id_col).alias("_id"), *(F.col(c).cast("string").alias(f"_s{i}") for i, c in enumerate(names)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = ", ".join([f"_id {docs.schema[id_col].dataType.simpleString()}", *(f"_s{i} string" for i in range(len(names))), *(f"{c} long" for c in COUNTS)])
    counted = source.mapInArrow(_measure, kinds)
    words = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    keys = [f"_s{i}" for i in range(len(names))]
    measured = cut(
        counted.select(
            "_id",
            *(F.coalesce(F.concat(F.lit("="), c), F.lit("null")).alias(c) for c in keys),
            *COUNTS,
            failed.alias("base_failed"),
            F.floor(100 * F.col("word_chars") / words).alias("m_length"),
            F.floor(10000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("m_symbols"),
            F.floor(10000 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("m_dup_lines"),
            F.floor(10000 * F.col("n_repeat_words") / words).alias("m_repeats"),
        )
    )
    fences = thresholds(sketches(measured.filter(~F.col("base_failed")), keys), keys, reach, tail_reach, chance)
    fence_of = {f"{side}_{m}": (m, side) for m in MEASURES for side in FENCES} | {f"{side}_{c}": (c, side) for c, _, _ in TAILED.values() for side in RATES}
    fence_cols = list(fence_of)
    wide = fences.groupBy(*keys, "level").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col(side))).alias(name) for name, (m, side) in fence_of.items()))
    # The thresholds of every stratum, from the lowest level with enough rows; the whole table's sketch counts at any size.
    chosen = measured.select(*keys).distinct()
    picked = []
    for k in range(len(keys), -1, -1):
        level = wide.filter((F.col("level") == k) & ((F.col("n") >= min_rows) | (F.lit(k) == 0))).select(*keys[:k], F.struct(*fence_cols).alias(f"_l{k}"))
        chosen = chosen.join(level, keys[:k], "left") if k else chosen.join(level, F.lit(True), "left")  # level 0: one row
        picked.append(f"_l{k}")
    chosen = cut(chosen.select(*keys, F.coalesce(*picked).alias("_f")))
    if chosen.count() <= STRATA_SENT:
        chosen = F.broadcast(chosen)
    odd = F.lit(False)
    for m in MEASURES:
        beyond = F.col(m) > F.col(f"_f.high_{m}")
        if m in TAILED:
            count, size, unit = TAILED[m]
            beyond = beyond & inexplicable(F.floor(F.col(count) / unit), F.col(size), *(F.col(f"_f.{side}_{count}") for side in RATES))
        odd = odd | beyond
        if m in LOW_SIDED:
            odd = odd | (F.col(m) < F.col(f"_f.low_{m}"))
    judged = measured.join(chosen, keys, "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return judged.select(
        F.col("_id").alias(id_col),
        *(F.when(F.col(k) != "null", F.substring(k, 2, 1 << 30)).alias(c) for k, c in zip(keys, names, strict=True)),
        *COUNTS, *MEASURES, "base_failed", "kept",
    )
