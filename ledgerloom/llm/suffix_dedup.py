"""Suffix-array dedup: repeated strings of bytes, found by suffix sorting in shards.

A text loses each byte covered by a string of ``span`` bytes that also starts anywhere else. Such strings
are dealt by their anchor (see anchors.py), so that equal ones meet: the strings of one anchor in one text are
a block, and blocks whose anchor occurs once need not be looked at. Blocks with equal contents are one text of a
shard with their number as its weight. An anchor with more contents than a shard has room for is cut into
parts, and each two parts meet in a shard, so a shard's size is bounded whatever a passage's popularity.

In a shard, the contents are parsed once into phrases that end at one of a few rare byte values. No phrase is a
prefix of another, so the suffixes of the phrase sequence stand in the order of the bytes; they are sorted
by Lyndon groups (suffix_groups.py). A string that begins within a phrase is that phrase's rest and a suffix
at the phrase border: strings with equal rests are put in the order of those suffixes, and one occurs
twice if it shares its first ``span`` bytes with a neighbour in that order, or its content has a weight over 1.
Shared bytes are counted on the bytes themselves; rests are grouped by hash, and every group is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .anchors import blocks, mix
from .common import Scratch, cut, join_touched, order_id, unused, wanted
from .suffix_groups import suffix_order

GRAM = 32
#: Bytes of a shard. Two parts of an anchor have no more; shards of several anchors are closed when they reach it.
SHARD_BYTES = 1_000_000
#: The bytes that end phrases make up about this share of a shard.
ENDS = 1 / 24

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, np.uint64(base))
        p[:1] = 1
        return np.cumprod(p, dtype=np.uint64)


class Strings:
    """Hashes of the strings of one sequence of bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.back = powers(_BACK, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * powers(_BASE, n), dtype=np.uint64)])

    def of(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mix((self.sums[to] - self.sums[at]) * self.back[at])


class Eights:
    """The bytes of a sequence, eight at a time from any place on."""

    def __init__(self, raw: np.ndarray, span: int) -> None:
        n = len(raw) + span + 8
        padded = np.zeros(n + 8, np.uint64)
        padded[: len(raw)] = raw
        self.at = padded[:n].copy()
        for k in range(1, 8):
            self.at |= padded[k : n + k] << np.uint64(8 * k)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from a and from b on are equal, up to most."""
        out, live, k = most.copy(), np.flatnonzero(most > 0), 0
        while len(live):
            apart = self.at[a[live] + k] ^ self.at[b[live] + k]
            ended = apart != 0
            bit = apart[ended] & (~apart[ended] + np.uint64(1))
            equal = (np.frexp(bit.astype(np.float64))[1] - 1) >> 3
            out[live[ended]] = np.minimum(k + equal, most[live[ended]])
            k += 8
            live = live[~ended & (most[live] > k)]
        return out


def range_least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for each pair; lo < hi."""
    table = [x]
    while 2 << (len(table) - 1) <= len(x):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), x.dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << int(k))])
    return out


def repeated_strings(texts: list[bytes], span: int, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text and each string of span bytes in it: does the string start at another place too? A text of weight
    over 1 stands for as many equal ones."""
    lens = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(lens) - lens
    # The bytes that end phrases: from the rarest up, to about ENDS of the shard; one at least.
    counts = np.bincount(raw, minlength=256)
    rare = np.argsort(np.where(counts, counts, len(raw) + 1), kind="stable")
    few = rare[: max(1, int(np.searchsorted(np.cumsum(counts[rare]), len(raw) * ENDS, side="right")))]
    ends = np.isin(raw, few)
    ends[starts + lens - 1] = True
    stops = np.flatnonzero(ends) + 1
    begins = np.concatenate([[0], stops[:-1]])
    whole = raw.tobytes()
    phrases = [whole[i:j] for i, j in zip(begins.tolist(), stops.tolist(), strict=True)]
    rank = {p: i for i, p in enumerate(sorted(set(phrases)), 2)}
    named = np.fromiter(map(rank.__getitem__, phrases), np.int64, len(phrases))
    text_of = np.searchsorted(starts, begins, side="right") - 1
    # 1 after each text, 0 at the very end.
    last = np.flatnonzero(np.concatenate([text_of[1:] != text_of[:-1], [True]]))
    seq = np.insert(named, last + 1, 1)
    seq = np.concatenate([seq, [0]])
    place = np.insert(begins, last + 1, starts + lens)  # of each symbol in the bytes; a 1 stands at its text's end
    limit = np.insert((starts + lens)[text_of], last + 1, starts + lens)
    order = suffix_order(seq)
    order = order[order < len(place)]
    rank_of = np.empty(len(place), np.int64)
    rank_of[order] = np.arange(len(order))
    strings, eights = Strings(raw), Eights(raw, span)
    at = place[order]
    shared = np.zeros(len(order), np.int64)
    shared[1:] = eights.common(at[:-1], at[1:], np.minimum(span, np.minimum((limit[order] - at)[:-1], (limit[order] - at)[1:])))

    n_windows = np.maximum(lens - span + 1, 0)
    s = np.concatenate([np.arange(i, i + k) for i, k in zip(starts, n_windows, strict=True)])
    phrase = np.searchsorted(stops, s, side="right")  # the phrase that holds s
    border = stops[phrase]
    size = np.minimum(border - s, span)
    # The symbol at the border: the next phrase, or the end of the text; texts before it have put in one symbol each.
    symbol = phrase + 1 + text_of[phrase]
    r = rank_of[symbol]
    r[size >= span] = 0  # the rest is the whole string

    def by_rests(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((r, key))
        near = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        return by[near], by[near + 1]

    one, two = by_rests(strings.of(s, s + size) ^ mix(size.astype(np.uint64)))
    if (size[one] != size[two]).any() or (eights.common(s[one], s[two], size[one]) < size[one]).any():
        number: dict[bytes, int] = {}  # different rests have one hash: number the rests themselves
        key = np.fromiter((number.setdefault(whole[i : i + j], len(number)) for i, j in zip(s.tolist(), size.tolist(), strict=True)), np.int64, len(s))
        one, two = by_rests(key)
    same = np.zeros(len(s), bool)
    lo, hi, need = r[one], r[two], span - size[one]
    enough = need <= 0
    apart = np.flatnonzero(hi > lo)
    enough[apart] |= range_least(shared, lo[apart] + 1, hi[apart] + 1) >= need[apart]
    same[one[enough]] = True
    same[two[enough]] = True
    if weights is not None:
        same |= np.repeat(weights > 1, n_windows)
    return np.split(same, np.cumsum(n_windows)[:-1])


def _batch(cols: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) for c, k in kinds.items()], list(kinds))


_BLOCK = {"a": pa.int64(), "c": pa.int64(), "doc": pa.int64(), "th": pa.int64(), "first": pa.int64(), "n": pa.int64()}
_REPORT = {"a": pa.int64(), "c": pa.int64(), "off": pa.int64(), "n": pa.int64()}


def block_rows(span: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                out: dict[str, list] = {c: [] for c in _BLOCK}
                for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if not text or len(text) < span:
                        continue
                    a, first, n = blocks(np.frombuffer(text, np.uint8), span, GRAM)
                    ends = first + n + span - 1
                    out["a"] += a.view(np.int64).tolist()
                    out["c"] += np.array([xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64).tolist()
                    out["doc"] += [doc] * len(a)
                    out["th"] += [th] * len(a)
                    out["first"] += first.tolist()
                    out["n"] += n.tolist()
                yield _batch(out, _BLOCK)

    return run


def block_texts(span: int) -> object:
    """The bytes of the listed blocks of each text."""
    kinds = {"a": pa.int64(), "c": pa.int64(), "times": pa.int64(), "of": pa.int32(), "bytes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                out: dict[str, list] = {c: [] for c in kinds}
                for r in whole.slice(lo, 100).to_pylist():
                    text = r["text"].encode()
                    for x in r["blocks"]:
                        out["bytes"].append(text[x["first"] : x["first"] + x["n"] + span - 1])
                        for c in ("a", "c", "times", "of"):
                            out[c].append(x[c])
                yield _batch(out, kinds)

    return run


def reported_spans(span: int) -> object:
    """Over rows (a, lo, hi, c, times, bytes) in the order of a, lo, hi: the spans of repeated strings of each content."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in _REPORT}
        found = repeated_strings([r[5] for r in rows], span, np.array([r[4] for r in rows]))
        for (a, _, _, c, _, _), flags in zip(rows, found, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            out["a"] += [a] * (len(edges) // 2)
            out["c"] += [c] * (len(edges) // 2)
            out["off"] += edges[::2].tolist()
            out["n"] += (edges[1::2] - edges[::2]).tolist()
        return _batch(out, _REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if held >= SHARD_BYTES and r[:3] != rows[-1][:3]:
                        yield shard(rows)
                        rows, held = [], 0
                    rows.append(r)
                    held += len(r[5])
        if rows:
            yield shard(rows)
        pa.default_memory_pool().release_unused()

    return run


def repeated_spans(base: DataFrame, span: int) -> DataFrame:
    """(doc, th, firsts, counts): the spans of each text's strings that start anywhere else too.

    ``base`` has (doc, th, text), th a checksum of the text. Null and short texts have no strings; repeated rows are
    each other's elsewhere; an empty table gives no rows."""
    spark = base.sparkSession
    with Scratch(spark, "suffix") as s:
        rows = s.table(base.mapInArrow(block_rows(span), "a long, c long, doc long, th long, first long, n long"))
        kinds = s.table(rows.groupBy("a", "c").agg(F.count("*").alias("times"), F.min(F.struct("doc", "th", "first", "n")).alias("head")))
        of = F.ceil(F.sum(F.col("head.n") + span) * 2 / SHARD_BYTES).cast("int")  # two parts meet in a shard
        met = kinds.groupBy("a").agg(F.sum("times").alias("all"), of.alias("of")).filter("all > 1").select("a", "of")
        listed = kinds.join(met, "a").select("a", "c", "times", "of", "head.*")
        listed = s.table(listed.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "c", "times", "of", "first", "n")).alias("blocks")))
        s.drop(kinds)
        few = base.join(wanted(listed.select("doc").distinct()), "doc", "left_semi").dropDuplicates(["doc", "th"])
        texts = few.join(listed, ["doc", "th"]).select("text", "blocks").mapInArrow(block_texts(span), "a long, c long, times long, of int, bytes binary")
        mine = F.pmod(F.col("c"), F.col("of")).cast("int")
        other = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least(mine, k).alias("lo"), F.greatest(mine, k).alias("hi")))
        met = F.when(F.col("of") > 1, F.filter(other, lambda t: t["lo"] < t["hi"])).otherwise(other)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = texts.withColumn("t", F.explode(met)).select("a", "t.lo", "t.hi", "c", "times", "bytes")
        dealt = dealt.repartition(parts, "a", "lo", "hi").sortWithinPartitions("a", "lo", "hi")
        reports = s.table(dealt.mapInArrow(reported_spans(span), "a long, c long, off long, n long").distinct())
        found = rows.drop("n").join(reports, ["a", "c"]).select("doc", "th", (F.col("first") + F.col("off")).alias("first"), "n")
        return cut(found.groupBy("doc", "th").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("counts")))


def removal(span: int) -> object:
    @arrow_udf("struct<kept:binary,n_bytes:bigint,n_removed:bigint,spans:array<struct<at:bigint,length:bigint>>>")
    def run(text: pa.Array, firsts: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for t, first, count in zip(text.cast(pa.binary()).to_pylist(), firsts.to_pylist(), counts.to_pylist(), strict=True):
            t = t or b""
            spans = []
            kept = t
            if first:
                hit = np.zeros(len(t) + 1, np.int64)
                np.add.at(hit, np.array(first), 1)
                np.add.at(hit, np.array(first) + np.array(count) + span - 1, -1)
                gone = np.cumsum(hit[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                spans = [{"at": i, "length": j - i} for i, j in zip(edges[::2], edges[1::2], strict=True)]
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            out.append({"kept": kept, "n_bytes": len(t), "n_removed": len(t) - len(kept), "spans": spans})
        return pa.array(out, pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())])))]))

    return run


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """``docs`` with ``kept_bytes`` (binary: the bytes left, joined), ``n_bytes``, ``n_removed`` and ``spans``
    (array of at, length: the removed runs of bytes).

    ``span`` is over 64 bytes. A null text is empty. Ids are whole numbers (others raise a TypeError). Repeated rows
    are each other's elsewhere, whatever their ids, null ids too, so their long enough texts are removed whole. An
    empty table gives no rows; all other columns are handed on, whatever their names, but columns of the four new
    names are replaced."""
    doc, th, firsts, counts, out = unused(docs, "doc", "th", "firsts", "counts", "out")
    keyed = docs.withColumn(doc, order_id(docs, id_col)).withColumn(th, F.xxhash64(text_col))
    base = keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(text_col).alias("text"))
    joined = join_touched(keyed, repeated_spans(base, span).toDF(doc, th, firsts, counts), [doc, th])
    none = F.array().cast("array<bigint>")
    cleaned = joined.withColumn(out, removal(span)(F.col(text_col), F.coalesce(firsts, none), F.coalesce(counts, none)))
    for new, c in (("kept_bytes", "kept"), ("n_bytes", "n_bytes"), ("n_removed", "n_removed"), ("spans", "spans")):
        cleaned = cleaned.withColumn(new, F.col(f"{out}.{c}"))
    return cleaned.drop(doc, th, firsts, counts, out)
