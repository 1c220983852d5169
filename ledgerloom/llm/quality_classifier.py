"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are binned measures of the line and of the lines beside it; the
chain adds a weight for each pair of neighbouring labels. The field is fitted by gradient ascent on the
likelihood of the lines' labels, for which lines take the label of their document. A document's score is
the mean of its lines' probabilities of being good (forward-backward), weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import by_slices

#: Upper bounds of the bins of each measure of a line; a value over the last one has a bin of its own.
BINS: dict[str, list[float]] = {
    "words": [0, 1, 3, 7, 15, 31, 63],
    "symbols": [0, 0.01, 0.03, 0.1, 0.25],
    "repeats": [0, 0.1, 0.25, 0.5, 0.75],
    "word_length": [2, 3, 4, 5, 6, 8, 11],
    "digits": [0, 0.05, 0.2],
    "capitals": [0, 0.05, 0.3],
    "marks": [0, 0.02, 0.06, 0.15],
    "short_words": [0, 0.1, 0.25, 0.5],
    "stops": [0],
    "seen": [0],
}
#: Measures of the previous and the next line that are features too; an end of the text is a further bin.
BESIDE = ("words", "symbols", "repeats", "seen")

_KIND = np.zeros(256, np.int64)  # 1 symbol, 2 digit, 3 capital, 4 other mark
_KIND[33:128] = [4 if not chr(x).isalnum() else 0 for x in range(33, 128)]
_KIND[list(b"#*$%&|<>")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3

_NAMES = list(BINS)
_SIZES = [len(b) + 1 for b in BINS.values()] + [len(BINS[m]) + 2 for m in BESIDE for _ in range(2)]
_OFFSET = np.concatenate([[0], np.cumsum(_SIZES)])
WEIGHTS = int(_OFFSET[-1]) + 1  # and a bias

#: Scores from here on are good.
THRESHOLD = 0.3


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features) places of weights, and the lines' lengths in bytes."""
    lines = text.split(b"\n")
    n = len(lines)
    raw = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    length = np.diff(np.concatenate([[-1], ends])) - 1
    kind = _KIND[raw]
    upto = np.concatenate([np.zeros((4, 1), np.int64), np.stack([np.cumsum(kind == k) for k in (1, 2, 3, 4)])], axis=1)
    symbols, digits, capitals, marks = upto[:, ends] - upto[:, np.concatenate([[0], ends[:-1] + 1])]
    words, distinct, short, stop, seen = (np.zeros(n) for _ in range(5))
    before: set[bytes] = set()
    for i, x in enumerate(lines):
        w = x.split()
        words[i], distinct[i] = len(w), len(set(w))
        short[i] = sum(map((4).__gt__, map(len, w)))
        stop[i] = x[-1:] in b".!?" and len(w) > 0
        if w:
            seen[i] = x in before
            before.add(x)
    full, chars = np.maximum(words, 1), np.maximum(length, 1)
    value = {
        "words": words, "symbols": symbols / chars, "repeats": 1 - distinct / full, "word_length": (length - words + 1) / full,
        "digits": digits / chars, "capitals": capitals / chars, "marks": marks / chars, "short_words": short / full, "stops": stop, "seen": seen,
    }
    bins = {m: np.searchsorted(BINS[m], v, side="left") for m, v in value.items()}
    bins["repeats"][words == 0] = 0
    cols = [bins[m] for m in _NAMES]
    for m in BESIDE:
        end = [len(BINS[m]) + 1]
        cols += [np.concatenate([end, bins[m][:-1]]), np.concatenate([bins[m][1:], end])]
    return np.stack(cols, axis=1) + _OFFSET[:-1], length


def chains(u: np.ndarray, lens: np.ndarray, trans: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains that lie one after the other: P(good) of each line, the expected number
    of each pair of neighbouring labels (0 if not to be ``counted``), and the log of the partition functions' product.

    ``u`` is a line's weight for good over bad; trans[a, b] the weight of a before b. Chains are cut into blocks
    of about the root of the longest chain's lines. A block acts on what comes in as one 2 x 2 matrix, so the
    messages first pass from block to block and then along all blocks at once; the result is that of the whole chains."""
    n = len(u)
    pot = np.exp(trans)
    e = np.stack([np.where(u > 0, np.exp(-np.abs(u)), 1.0), np.where(u > 0, 1.0, np.exp(-np.abs(u)))], axis=1)
    total = float(np.maximum(u, 0).sum())
    if not n:
        return np.zeros(0), np.zeros((2, 2)), total
    room = max(16, int(np.ceil(np.sqrt(lens.max()))))
    held = -(-lens // room)  # blocks of each chain
    chain = np.repeat(np.arange(len(lens)), held)
    nth = np.arange(len(chain)) - (np.cumsum(held) - held)[chain]
    start = (np.cumsum(lens) - lens)[chain] + nth * room
    size = np.minimum(lens[chain] - nth * room, room)
    # A step from a line to the next; into a chain's first line every step weighs 1.
    step = pot[None] * e[:, None, :]
    step[start[nth == 0]] = e[start[nth == 0]][:, None, :]

    by_size = np.argsort(-size, kind="stable")
    longer = [by_size[: int(np.searchsorted(-size[by_size], -t, side="left"))] for t in range(int(size.max()))]  # blocks of over t lines
    by_nth = np.argsort(nth, kind="stable")
    of_nth = np.split(by_nth, np.cumsum(np.bincount(nth))[:-1])

    whole = np.broadcast_to(np.eye(2), (len(start), 2, 2)).copy()
    for t, live in enumerate(longer):
        m = whole[live] @ step[start[live] + t]
        whole[live] = m / m.sum(axis=(1, 2), keepdims=True)
    into, after = np.full((len(start), 2), 0.5), np.full((len(start), 2), 0.5)
    for on in of_nth[1:]:
        v = (into[on - 1][:, None, :] @ whole[on - 1])[:, 0]
        into[on] = v / v.sum(axis=1, keepdims=True)
    for on in of_nth[:0:-1]:
        v = (whole[on] @ after[on][:, :, None])[:, :, 0]
        after[on - 1] = v / v.sum(axis=1, keepdims=True)

    fwd, bwd = np.empty_like(e), np.empty_like(e)
    for t, live in enumerate(longer):
        at = start[live] + t
        a = ((into[live] if t == 0 else fwd[at - 1])[:, None, :] @ step[at])[:, 0]
        norm = a.sum(axis=1, keepdims=True)
        total += float(np.log(norm).sum())
        fwd[at] = a / norm
    bwd[start + size - 1] = after
    for t in range(len(longer) - 2, -1, -1):
        at = start[longer[t + 1]] + t
        b = (step[at + 1] @ bwd[at + 1][:, :, None])[:, :, 0]
        bwd[at] = b / b.sum(axis=1, keepdims=True)

    pairs = np.zeros((2, 2))
    if counted:
        first = np.zeros(n, bool)
        first[start[nth == 0]] = True
        on = np.flatnonzero(~first[1:])  # lines with a next one
        both = fwd[on][:, :, None] * step[on + 1] * bwd[on + 1][:, None, :]
        pairs = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = fwd * bwd
    return p[:, 1] / p.sum(axis=1), pairs, total


@dataclass
class LineField:
    """The fitted weights. All zero (every score 0.5) where there was nothing to fit on."""

    weights: np.ndarray
    trans: np.ndarray
    line: float = 0.3  # the mean of marginals that parts the fitted documents best

    def lines(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[feats].sum(axis=1) + self.weights[-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        got = [line_features(t) for t in texts]
        if not got:
            return np.zeros(0)
        lens = np.array([len(x) for _, x in got])
        good, _, _ = chains(self.lines(np.concatenate([f for f, _ in got])), lens, self.trans, counted=False)
        weight = np.concatenate([x for _, x in got]) + 1e-9  # lines of no length count only where there are no others
        first = np.cumsum(lens) - lens
        mean = np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)
        # Stretched so that the line comes to lie at THRESHOLD; the order of documents stays.
        return np.where(mean < self.line, THRESHOLD * mean / self.line, 1 - (1 - THRESHOLD) * (1 - mean) / (1 - self.line))


def fit(feats: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Gradient ascent on the likelihood of whole chains."""
    w, trans = np.zeros(WEIGHTS), np.zeros((2, 2))
    if not feats:
        return LineField(w, trans)
    x = np.concatenate(feats)
    lens, y = np.array([len(f) for f in feats]), np.array(labels)
    lines_y = np.repeat(y, lens)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y, y), lens - 1)
    m1, m2 = np.zeros(WEIGHTS + 4), np.zeros(WEIGHTS + 4)
    for i in range(1, rounds + 1):
        p, pairs, _ = chains(w[x].sum(axis=1) + w[-1], lens, trans)
        miss = lines_y - p
        grad = np.concatenate([np.bincount(x.ravel(), np.repeat(miss, x.shape[1]), WEIGHTS), (seen - pairs).ravel()])
        grad[WEIGHTS - 1] = miss.sum()
        grad = grad / len(lines_y) - decay * np.concatenate([w, trans.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
        w, trans = w + step[:WEIGHTS], trans + step[WEIGHTS:].reshape(2, 2)
    return LineField(w, trans)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
        got = [line_features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
        feats, weights = [f.astype(np.uint8).tobytes() for f, _ in got], [x.astype(np.int64).tobytes() for _, x in got]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(feats, pa.binary()), pa.array(weights, pa.binary())], ["label", "feats", "weight"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 4000) -> LineField:
    """Fit on at most ``fit_rows`` labelled documents (those of the smallest checksums), whole texts.

    Held-out ids, null labels and null ids are left out. Of several labels of an id the smallest counts."""
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col)).cast("int").alias("_label"))
        .orderBy(F.crc32(F.encode(F.concat(F.lit("fit"), F.col("_id").cast("string")), "UTF-8")), "_id").limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")  # fit_rows rows at most
    rows = texts.select("_label", "_text").mapInArrow(_features, "label int, feats binary, weight binary").collect()
    width = len(_SIZES)
    rows = sorted((r["label"], bytes(r["feats"]), r["weight"]) for r in rows)
    feats, labels = [np.frombuffer(f, np.uint8).reshape(-1, width).astype(np.int64) for _, f, _ in rows], [y for y, _, _ in rows]
    field = fit(feats, labels)
    if len(set(labels)) > 1:
        lens = np.array([len(f) for f in feats])
        good, _, _ = chains(field.lines(np.concatenate(feats)), lens, field.trans, counted=False)
        weight = np.concatenate([np.frombuffer(w, np.int64) for _, _, w in rows]) + 1e-9
        first = np.cumsum(lens) - lens
        field.line = best_line(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), np.array(labels))
    return field


def best_line(means: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between two documents that, as a line, puts the fewest on the wrong side."""
    order = np.argsort(means, kind="stable")
    m, y = np.concatenate([[0.0], means[order], [1.0]]), labels[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    wrong = np.where(np.diff(m) > 0, wrong, len(y) + 1)
    k = int(np.argmin(wrong))
    return float(np.clip((m[k] + m[k + 1]) / 2, 0.01, 0.99))


def score(text: Column, model: LineField) -> Column:
    """The score of a text, 0 to 1; a null text counts as empty, which is one line without words."""

    @arrow_udf("double")
    def run(t: pa.Array) -> pa.Array:
        return by_slices(lambda part: pa.array(model.scores([x or b"" for x in part.cast(pa.binary()).to_pylist()]), pa.float64()), t)

    return run(text)


def classify(docs: DataFrame, model: LineField, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from the threshold on). All columns are handed on, but
    ones of these two names are replaced. Repeated rows are each scored; an empty table gives no rows."""
    return docs.withColumn("score", F.round(score(F.col(text_col), model), 9)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
