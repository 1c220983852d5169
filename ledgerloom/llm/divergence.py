"""How far sources of a language differ in their words, by pairs of sources and by words.

Terms are counted within tasks before they are shuffled. A language keeps terms of enough documents; they get ids within
blocks of about ``BLOCK`` terms, dealt by hash. A group (language and source) is then a sorted array of (term id, count)
a block. A pair task has one block of two groups: the arrays are co-grouped, the shorter gallops through the longer, and
terms of both, of one and of the other are priced; terms that neither has cost the same each, so they are counted in
at the end. One task serves a pair both ways, as the price has no direction.

All arithmetic is on whole numbers: a price is 1 + floor(10^9 (count + 5) / (N + 5 V)), divided out in three steps of
10^3 so that nothing leaves 64 bits while N + 5 V is under 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, wanted

#: Terms in a block, about.
BLOCK = 16_384
#: Entries of a task's counts before they are handed on.
HELD = 200_000
#: Bytes of which terms are made, A-Z lower-cased; all others part terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
UNIT, EXTRA = 1_000_000_000, 5


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + EXTRA) / (total + EXTRA * terms)), exact; null without terms."""
    below = F.when(terms > 0, total + EXTRA * terms)
    left, out = count + EXTRA, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + F.call_function("div", left, below), left % below
    return out + 1


def prices(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for an array of counts."""
    below = total + EXTRA * terms
    left, out = count.astype(np.int64) + EXTRA, np.zeros(len(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // below, left % below
    return out + 1


def gallop(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the ascending ``a`` its place in the ascending ``b``, or -1. Every search starts where its share of b
    would be, doubles its stride until it has passed its value, and halves what is left."""
    if not len(a) or not len(b):
        return np.full(len(a), -1, np.int64)
    n = len(b)
    low = high = np.arange(len(a)) * n // len(a)
    stride, up, down = 1, b[low] < a, b[low] > a
    while up.any() or down.any():  # low and high are the nearest places known on both sides
        high = np.where(up, np.minimum(high + stride, n), high)
        low = np.where(down, np.maximum(low - stride, -1), low)
        up = up & (high < n) & (b[np.minimum(high, n - 1)] < a)
        down = down & (low >= 0) & (b[np.maximum(low, 0)] > a)
        stride *= 2
    low, high = np.maximum(low, 0), np.minimum(high, n - 1)
    while (low < high).any():
        mid = (low + high) // 2
        right = b[mid] < a
        low, high = np.where(right, np.minimum(mid + 1, high), low), np.where(right, high, mid)
    return np.where(b[low] == a, low, -1)


def merged(ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], terms: int) -> int:
    """The sum over the terms that either group has of |p - q| less the price of a term that neither has."""
    short = 0 if len(ids[0]) <= len(ids[1]) else 1
    at = gallop(ids[short], ids[1 - short])
    p = prices(counts[short], totals[short], terms)
    q = prices(counts[1 - short], totals[1 - short], terms)
    none = [int(prices(np.zeros(1, np.int64), t, terms)[0]) for t in (totals[short], totals[1 - short])]
    absent = abs(none[0] - none[1])
    met = at >= 0
    alone = np.ones(len(q), bool)
    alone[at[met]] = False
    parts = [np.abs(p[met] - q[at[met]]), np.abs(p[~met] - none[1]), np.abs(none[0] - q[alone])]
    return sum(int((x - absent).sum()) for x in parts)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows of the table that have it), summed within tasks; an empty term
    stands for each row's group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        having: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in counts.items():
                words, h = [*c], having[lang, source]
                for lo in range(0, len(words), 50_000):
                    some = words[lo : lo + 50_000]
                    cols = [[lang] * len(some), [source] * len(some), pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[w] for w in some], pa.int64()), pa.array([h[w] for w in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) if isinstance(x, list) else x for x in cols], ["lang", "source", "term", "n", "docs"])
            counts.clear()
            having.clear()

        held = 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    mine, own = Counter(text.translate(_TERMS).split()), counts[lang, source]
                    before = len(own)
                    own.update(mine)
                    own[b""] += 1
                    having[lang, source].update(mine.keys())
                    held += len(own) - before
                    if held > HELD:
                        yield from handed_on()
                        held = 0
        yield from handed_on()

    return texts.mapInArrow(go, "lang string, source string, term string, n bigint, docs bigint")


def _one_row(df: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair`` has a row for every other source of the language, valued by the sum of |p - q| over all its kept terms
    (0 if it keeps none); part ``term`` a group's terms with p > q, q the whole language's price, to rank ``top``. Ranks
    go by value, highest first, then by item in UTF-8.

    Takes text, lang and source; other columns are left out. A null counts as empty, an empty source is one like others.
    Every row is a document, repeated ones too. Groups without terms are there; an empty table gives no rows."""
    lang, group = ["lang"], ["lang", "source"]
    with Scratch(docs.sparkSession, "divergence") as scratch:
        counted = term_counts(docs).repartition("lang", "term").groupBy(*group, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        counted = scratch.table(counted.withColumns({"all_docs": F.sum("docs").over(of_term), "all": F.sum("n").over(of_term)}).filter((F.col("all_docs") >= least_docs) | (F.col("term") == "")))
        kept = counted.filter("term <> ''")

        vocabulary = kept.groupBy("lang", "term").agg(F.first("all").alias("all"))
        languages = cut(vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total")))
        # Every group with its N; its language's V and N. Groups and languages without kept terms have noughts.
        groups = counted.groupBy(*group).agg(F.sum(F.when(F.col("term") != "", F.col("n")).otherwise(0)).alias("own"))
        groups = cut(groups.join(languages, "lang", "left").select(*group, "own", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "total")]))

        blocks = F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1))
        dealt = vocabulary.join(wanted(languages), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"))
        ids = dealt.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
        placed = kept.select(*group, "term", "n").join(ids, ["lang", "term"])
        arrays = scratch.table(
            placed.groupBy(*group, "block").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("a"))
            .join(wanted(groups), group).select(*group, "block", F.col("a.id").alias("ids"), F.col("a.n").alias("counts"), "own", "terms")
        )

        others = groups.select("lang", F.col("source").alias("other"), F.col("own").alias("other_own"))
        facing = arrays.join(wanted(others), "lang").filter("source <> other")
        side = ["lang", "a", "b", "block", "ids", "counts", "own", "other_own", "terms"]
        one = facing.filter("source < other").select("lang", "source", "other", *side[3:]).toDF(*side)
        two = facing.filter("source > other").select("lang", "other", "source", *side[3:]).toDF(*side)
        task = ["lang", "a", "b", "block"]

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            some = left if left.num_rows else right
            key = {k: some[k][0].as_py() for k in ("lang", "a", "b")}
            own, other, terms = (some[k][0].as_py() for k in ("own", "other_own", "terms"))
            totals = (own, other) if some is left else (other, own)
            ids, counts = (tuple(np.asarray(t[k].combine_chunks().flatten()) if t.num_rows else np.zeros(0, np.int64) for t in (left, right)) for k in ("ids", "counts"))
            return pa.table({k: pa.array([v], pa.string()) for k, v in key.items()} | {"value": pa.array([merged(ids, counts, totals, terms)], pa.int64())})

        priced = one.groupBy(*task).cogroup(two.groupBy(*task)).applyInArrow(pair, "lang string, a string, b string, value bigint")
        sums = cut(_one_row(priced, ["lang", "a", "b"], value="value"))

        mine = [F.col(c).alias(f"_{c}") for c in ("lang", "source", "own")]
        pairs = groups.join(wanted(groups.select(*mine)), (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("_source")))
        pairs = pairs.withColumns({"a": F.least("source", "_source"), "b": F.greatest("source", "_source")}).join(sums, ["lang", "a", "b"], "left")
        nothing = F.lit(0).cast("long")
        absent = F.abs(price(nothing, F.col("own"), F.col("terms")) - price(nothing, F.col("_own"), F.col("terms")))
        by_value = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        pairs = pairs.select(*group, F.lit("pair").alias("part"), F.col("_source").alias("item"), F.coalesce(F.col("terms") * absent + F.coalesce("value", nothing), nothing).alias("value"))
        pairs = pairs.withColumn("rank", F.row_number().over(by_value))

        over = price(F.col("n"), F.col("own"), F.col("terms")) - price(F.col("all"), F.col("total"), F.col("terms"))
        words = kept.join(wanted(groups), group).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).filter("value > 0")
        words = words.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
        return cut(pairs.unionByName(words))
