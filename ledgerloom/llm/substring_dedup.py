"""Substring dedup over windows of words, with a compressed FM-index per shard.

A document loses each word that lies in a window of ``span`` words which also starts in a document of
smaller id. Windows are dealt by their anchor (see anchors.py), so equal windows meet: the windows of one
anchor in one document are a block, and blocks whose anchor only one document has need not be looked at.

Of the blocks with equal contents the one of the least id stands for all. These contents are the shards' texts:
a shard's words become a Burrows-Wheeler transform in a wavelet matrix of packed bits, with two bit vectors that
mark where suffixes part within ``span`` words. Contents are streamed through the shards of their anchor by
backward search, all at once and a word at a time. A match of ``span`` words is reported as an interval, and
so as the least id that has the window; then its last word is forgotten by widening the interval to its parent.
The reports of a content hold for every block that has it.

An anchor with more contents than a shard has room for gets several shards, and its contents are streamed
through each of them, so a shard's size is bounded whatever a passage's popularity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .anchors import blocks
from .common import Scratch, cut, join_touched, order_id, unused, wanted

GRAM = 8
#: Words of a shard. An anchor's own shards have no more; shards of several anchors are closed when they reach it.
SHARD_WORDS = 600_000


def top_bit(w: np.ndarray) -> np.ndarray:
    """The place of the highest bit of words that are not 0."""
    high = w >> np.uint64(32)
    upper = high > 0
    return np.frexp(np.where(upper, high, w).astype(np.float64))[1] - 1 + 32 * upper


class Bits:
    """A packed bit vector with rank, and the nearest set bit on either side."""

    def __init__(self, flags: np.ndarray) -> None:
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The set bits before i."""
        at = i >> 6
        return self.counts[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def link(self) -> None:
        """Make ready for ``last`` and ``next``."""
        full, at = self.words != 0, np.arange(len(self.words), dtype=np.int32)
        self.before = np.maximum.accumulate(np.where(full, at, 0))
        self.after = np.minimum.accumulate(np.where(full, at, len(at) - 1)[::-1])[::-1]

    def last(self, i: np.ndarray) -> np.ndarray:
        """The last set bit at i or before; there is one."""
        at = i >> 6
        w = self.words[at] & (~np.uint64(0) >> (np.uint64(63) - (i & 63).astype(np.uint64)))
        at = np.where(w != 0, at, self.before[np.maximum(at - 1, 0)])
        return 64 * at + top_bit(np.where(w != 0, w, self.words[at]))

    def next(self, i: np.ndarray) -> np.ndarray:
        """The first set bit after i; there is one."""
        at = (i + 1) >> 6
        w = self.words[at] & (~np.uint64(0) << ((i + 1) & 63).astype(np.uint64))
        at = np.where(w != 0, at, self.after[np.minimum(at + 1, len(self.after) - 1)])
        w = np.where(w != 0, w, self.words[at])
        return 64 * at + top_bit(w & (~w + np.uint64(1)))


class FmIndex:
    """Wavelet matrix over the BWT of a sequence of numbers below ``top``, for patterns of up to ``span`` (62 at most).

    Beside it only bit vectors: where the suffixes, in their order, part within span - 1 and within span."""

    def __init__(self, seq: np.ndarray, top: int, span: int) -> None:
        n = len(seq)
        self.n, self.bits = n, max(1, int(top - 1).bit_length())
        width = max(1, min(62 // self.bits, span // 2))  # as many symbols as fit into a number are sorted at once
        rank = np.zeros(n, np.int64)
        for k in range(width):
            rank <<= self.bits
            rank[: n - k] |= seq[k:]
        order = np.argsort(rank)
        rank = self._ranked(rank, order)
        while width <= span:
            far = np.zeros(n, np.int64)
            far[:-width] = rank[width:] + 1
            if width < span <= 2 * width:
                near = rank, width
            far += rank * (n + 1)
            order = np.argsort(far)
            rank = self._ranked(far, order)
            width *= 2
        self.shorter, self.whole = (Bits(self._parts(*near, order, length)) for length in (span - 1, span))
        self.shorter.link()
        self.order = order  # given up once the owner has read the documents in it
        bwt = seq[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top))])
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.start = self._down(np.arange(top), np.zeros(top, np.int64))

    @staticmethod
    def _ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        arranged = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (arranged[1:] != arranged[:-1]).astype(np.int64)]))
        return rank

    @staticmethod
    def _parts(rank: np.ndarray, width: int, order: np.ndarray, length: int) -> np.ndarray:
        """Flags of the places in the order whose suffix differs from the one before within ``length``, and of the end."""
        far = np.zeros(len(rank), np.int64)
        far[: len(rank) - (length - width)] = rank[length - width :] + 1
        a, b = rank[order], far[order]
        return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[k].rank(i)
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with c put before them."""
        down = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first[c] - self.start[c]
        return down[: len(c)] + base, down[len(c) :] + base


class Shard:
    """Indexed texts (sequences of words) and the least document of each window; other texts stream through it."""

    def __init__(self, texts: list[list[bytes]], docs: list[int], span: int) -> None:
        self.span, self.number = span, {}
        seqs = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in t], np.int64) for t in texts]
        parts = [p for x in seqs for p in (x, np.zeros(1, np.int64))]  # 0 ends each sequence
        self.unknown = len(self.number) + 1  # what no indexed text holds
        self.index = FmIndex(np.concatenate(parts), self.unknown + 1, span)
        owner = np.repeat(np.array(docs, np.int64), [len(x) + 1 for x in seqs])
        edges = np.flatnonzero(np.unpackbits(self.index.whole.words.view(np.uint8), bitorder="little")[: self.index.n])
        self.least = np.minimum.reduceat(owner[self.index.order], edges)
        del self.index.order

    def least_docs(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text and each of its windows the least document that has it, the greatest long where none has."""
        index, span = self.index, self.span
        seqs = [np.array([self.number.get(w, self.unknown) for w in t], np.int64) for t in texts]
        lens = np.array([len(x) for x in seqs])
        flat = np.concatenate(seqs)
        starts = np.cumsum(lens) - lens
        # A stream runs leftwards; lo, hi is the interval of the words from p to e, fewer than span of them.
        p, e = lens.copy(), lens.copy()
        lo, hi = np.zeros(len(seqs), np.int64), np.full(len(seqs), index.n, np.int64)
        out = np.full(len(flat), np.iinfo(np.int64).max)
        live = np.flatnonzero(e >= span)
        while len(live):
            p[live] -= 1
            a, b = index.step(flat[starts[live] + p[live]], lo[live], hi[live])
            full = (a < b) & (e[live] - p[live] == span)
            at = live[full]  # span words are matched: report the interval, then forget its last word
            out[starts[at] + p[at]] = self.least[index.whole.rank(a[full] + 1) - 1]
            a[full], b[full] = index.shorter.last(a[full]), index.shorter.next(a[full])
            e[at] -= 1
            lost = a >= b  # no such words in the shard: begin again a word further left
            at = live[lost]
            e[at] -= 1
            p[at] = e[at]
            a[lost], b[lost] = 0, index.n
            lo[live], hi[live] = a, b
            live = live[e[live] >= span]
        return [out[i : i + max(0, n - span + 1)] for i, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _emit(cols: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) for c, k in kinds.items()], list(kinds))


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


_BLOCK = {"a": pa.int64(), "c": pa.int64(), "doc": pa.int64(), "th": pa.int64(), "first": pa.int64(), "n": pa.int64()}
_REPORT = {"a": pa.int64(), "c": pa.int64(), "off": pa.int64(), "n": pa.int64(), "least": pa.int64()}


def block_rows(span: int) -> object:
    """Each block: its anchor, the hash of its content, the document and where its windows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                if len(known) > 300_000:
                    known.clear()
                out: dict[str, list] = {c: [] for c in _BLOCK}
                for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    words = text.split() if text else []
                    if len(words) < span:
                        continue
                    x = _hashes(words, known)
                    a, first, n = blocks(x, span, GRAM)
                    raw = memoryview(x.tobytes())
                    ends = first + n + span - 1
                    out["a"] += _signed(a)
                    out["c"] += _signed(np.array([xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)], np.uint64))
                    out["doc"] += [doc] * len(a)
                    out["th"] += [th] * len(a)
                    out["first"] += first.tolist()
                    out["n"] += n.tolist()
                yield _emit(out, _BLOCK)

    return run


def reported_spans(span: int, room: int) -> object:
    """Over rows (a, k, c, doc, last, indexed, words) in the order of a, k, indexed ones first: the spans of windows with
    one least doc, where it is below ``last``.

    Small groups (a, k) share a shard. Of a group with more than ``room`` words the indexed rows make a shard, through
    which the others stream in slices of that many words, so a task never holds all of a group."""

    def report(shard: Shard, rows: list[tuple]) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in _REPORT}
        for (a, _, c, _, last, _, _), least in zip(rows, shard.least_docs([r[6] for r in rows]), strict=True):
            edges = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            n = np.diff(np.concatenate([edges, [len(least)]]))
            use = least[edges] < last
            out["a"] += [a] * int(use.sum())
            out["c"] += [c] * int(use.sum())
            out["off"] += edges[use].tolist()
            out["n"] += n[use].tolist()
            out["least"] += least[edges[use]].tolist()
        return _emit(out, _REPORT)

    def built(rows: list[tuple]) -> Shard | None:
        own = [r for r in rows if r[5]]
        return Shard([r[6] for r in own], [r[3] for r in own], span) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        shard: Shard | None = None
        sliced = None  # the group that is streamed in slices
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                for r in zip(*(x.to_pylist() for x in whole.slice(lo, 100).columns), strict=True):
                    words = r[6].split()
                    if rows and held >= room and (r[:2] != rows[-1][:2] or not r[5]):
                        if sliced is None:
                            shard = built(rows)
                        if shard:
                            yield report(shard, rows)
                        sliced = r[:2] if r[:2] == rows[-1][:2] else None
                        rows, held = [], 0
                    elif sliced is not None and r[:2] != sliced:
                        if shard and rows:
                            yield report(shard, rows)
                        rows, held, sliced = [], 0, None
                    rows.append((*r[:6], words))
                    held += len(words) + 1
        if rows:
            shard = shard if sliced is not None else built(rows)
            if shard:
                yield report(shard, rows)
        pa.default_memory_pool().release_unused()

    return run


def block_texts(span: int) -> object:
    """The words of the listed blocks of each document."""
    kinds = {"a": pa.int64(), "c": pa.int64(), "doc": pa.int64(), "last": pa.int64(), "of": pa.int32(), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                out: dict[str, list] = {c: [] for c in kinds}
                for r in whole.slice(lo, 100).to_pylist():
                    words = r["text"].encode().split()
                    for x in r["blocks"]:
                        out["doc"].append(r["doc"])
                        out["words"].append(b" ".join(words[x["first"] : x["first"] + x["n"] + span - 1]))
                        for c in ("a", "c", "last", "of"):
                            out[c].append(x[c])
                yield _emit(out, kinds)

    return run


def earlier_spans(base: DataFrame, span: int, shard_words: int | None = None) -> DataFrame:
    """(doc, th, first, n): spans of windows of a document that start in a document of smaller id too.

    ``base`` has (doc, th, text), th a checksum of the text; rows of equal doc count as one document. Null and short
    texts have no windows; an empty table gives no rows."""
    spark = base.sparkSession
    with Scratch(spark, "substring") as s:
        rows = s.table(base.mapInArrow(block_rows(span), "a long, c long, doc long, th long, first long, n long"))
        kinds = s.table(rows.groupBy("a", "c").agg(F.min(F.struct("doc", "th", "first", "n")).alias("head"), F.max("doc").alias("last")))
        room = shard_words or SHARD_WORDS
        met = kinds.groupBy("a").agg(F.min("head.doc").alias("lo"), F.max("last").alias("hi"), F.ceil(F.sum(F.col("head.n") + span) / room).cast("int").alias("of"))
        listed = kinds.join(met.filter("lo < hi").select("a", "of"), "a").select("a", "c", "last", "of", "head.*")
        listed = s.table(listed.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "c", "last", "of", "first", "n")).alias("blocks")))
        s.drop(kinds)
        few = base.join(wanted(listed.select("doc").distinct()), "doc", "left_semi")
        texts = few.join(listed, ["doc", "th"]).select("doc", "text", "blocks").mapInArrow(block_texts(span), "a long, c long, doc long, last long, of int, words binary")
        # Rows of one id with one text give a block twice, from the same place: the same content.
        texts = texts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumn("indexed", F.pmod(F.col("c"), F.col("of")) == F.col("k"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = texts.select("a", "k", "c", "doc", "last", "indexed", "words").repartition(parts, "a", "k").sortWithinPartitions("a", "k", F.desc("indexed"))
        reports = s.table(dealt.mapInArrow(reported_spans(span, room), "a long, c long, off long, n long, least long"))
        found = rows.drop("n").join(reports, ["a", "c"]).filter("doc > least").select("doc", "th", (F.col("first") + F.col("off")).alias("first"), "n")
        return cut(found.groupBy("doc", "th").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("counts")))


def removal(span: int) -> object:
    @arrow_udf("struct<kept:string,n_words:bigint,n_removed:bigint>")
    def run(text: pa.Array, firsts: pa.Array, counts: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        for t, first, count in zip(text.cast(pa.binary()).to_pylist(), firsts.to_pylist(), counts.to_pylist(), strict=True):
            words = t.split() if t else []
            gone = 0
            if first:
                hit = np.zeros(len(words) + 1, np.int64)
                np.add.at(hit, np.array(first), 1)
                np.add.at(hit, np.minimum(np.array(first) + np.array(count) + span - 1, len(words)), -1)
                stay = np.cumsum(hit[:-1]) == 0
                gone = len(words) - int(stay.sum())
                n_words.append(len(words))
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                n_words.append(len(words))
            kept.append(b" ".join(words).decode())
            n_removed.append(gone)
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept", "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50) -> DataFrame:
    """``docs`` with ``kept_text`` (the words left, joined by one space), ``n_words`` and ``n_removed``.

    ``span`` is 16 to 62 words. A null or blank text has no words. Ids are whole numbers (others raise a TypeError).
    Rows of equal id count as one document, so they remove nothing from each other; rows with a null id count as
    one last document. An empty table gives no rows; all other columns are handed on, whatever their names, but
    columns of the three new names are replaced."""
    doc, th, firsts, counts, out = unused(docs, "doc", "th", "firsts", "counts", "out")
    keyed = docs.withColumn(doc, order_id(docs, id_col)).withColumn(th, F.xxhash64(text_col))
    base = keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(text_col).alias("text"))
    joined = join_touched(keyed, earlier_spans(base, span).toDF(doc, th, firsts, counts), [doc, th])
    none = F.array().cast("array<bigint>")
    cleaned = joined.withColumn(out, removal(span)(F.col(text_col), F.coalesce(firsts, none), F.coalesce(counts, none)))
    for new, c in (("kept_text", "kept"), ("n_words", "n_words"), ("n_removed", "n_removed")):
        cleaned = cleaned.withColumn(new, F.col(f"{out}.{c}"))
    return cleaned.drop(doc, th, firsts, counts, out)
