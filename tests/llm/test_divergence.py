"""Source divergence against a plain count of everything, and its parts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence as D

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """lang, source, part, item, value, rank of (lang, source, text) rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(g or "", s or "", LETTERS.findall((t or "").translate(lower))) for g, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for _, _, ws in mine for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        whole = Counter(w for _, _, ws in mine for w in ws if w in kept)
        by = {s: Counter(w for _, x, ws in mine for w in ws if x == s and w in kept) for s in {r[1] for r in mine}}

        def p(c: Counter, w: str, kept=kept) -> int:
            return 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in by.items():
            pairs = [(sum(abs(p(c, w) - p(o, w)) for w in kept), x) for x, o in by.items() if x != s]
            words = [(p(c, w) - p(whole, w), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, upto in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked[:upto], 1)]
    return sorted(out)


def rows(n: int) -> list[tuple]:
    r = random.Random(11)
    words = ["The", "the", "Été", "été", "x", "日本", "naïve", "don't", "a_b", "ß", "ẞ", "z9z", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    made = [(r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S3", None, "é"]), " ".join(r.choices(words, k=r.randint(0, 60)))) for _ in range(n)]
    return [*made, ("only", "a", "rare words"), ("only", "b", ""), ("only", "c", None), ("en", "quiet", "12 34 !"), (None, None, None), ("one", "a", "x " * 50_000)]


def agree(spark, given: list[tuple], least: int, top: int) -> None:
    docs = spark.createDataFrame(given, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "docs", "block", "own", "value")})
    got = sorted(tuple(r) for r in D.divergence(docs.repartition(3), least_docs=least, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(given, least, top)


def test_counted_plainly(spark):
    agree(spark, rows(300), 30, 50)


def test_small_blocks_and_small_counts(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    monkeypatch.setattr(D, "HELD", 20)
    agree(spark, rows(120), 5, 3)


def test_empty_tables(spark):
    assert D.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    agree(spark, [("en", "a", None)] * 3, 1, 5)


@pytest.mark.parametrize("seed", range(20))
def test_galloping(seed):
    r = np.random.default_rng(seed)
    a, b = (np.unique(r.integers(0, 400, r.integers(0, n))) for n in (30, 300))
    want = [int(np.flatnonzero(b == x)[0]) if x in b else -1 for x in a]
    assert D.gallop(a, b).tolist() == want
    skewed = np.concatenate([np.arange(200), [10**9]])
    assert D.gallop(np.array([0, 199, 10**9]), skewed).tolist() == [0, 199, 200]


def test_prices_are_exact(spark):
    cases = [(0, 0, 1), (3, 10, 2), (9 * 10**12, 10**13, 10**6), (10**15, 10**15 + 7, 3), (7, 9 * 10**14, 10**8)]
    table = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in table.select(D.price(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert [int(D.prices(np.array([c]), n, v)[0]) for c, n, v in cases] == got
