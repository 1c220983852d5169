"""Matching blocks against the standard library's matcher."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import blocks
from ledgerloom.functions.scalars import sequence_ratio


def want(x: str | None, y: str | None) -> float:
    return round(difflib.SequenceMatcher(None, x, y).ratio(), 4) if x and y else 0.0


@pytest.mark.parametrize(("signs", "longest"), [("ab", 30), ("가나다라 abc", 25), ("abcdefghij 123", 330), ("ab", 300)])
def test_random_pairs(signs, longest):
    r = random.Random(longest)
    made = lambda: "".join(r.choices(signs, k=r.randint(0, longest)))
    first, second = [made() for _ in range(150)], [made() for _ in range(150)]
    for k in range(0, 150, 3):  # near copies
        at = r.randint(0, len(first[k]))
        second[k] = first[k][:at] + r.choice(signs) + first[k][at + r.randint(0, 3) :]
    assert blocks.ratios(first, second).tolist() == [want(x, y) for x, y in zip(first, second, strict=True)]


def test_popular_signs_and_narrow_sweeps(monkeypatch):
    monkeypatch.setattr(blocks, "ROOM", 40)
    pairs = [("xayb" * 60, "aybx" * 70), ("the cat sat " * 20, "a cat sits on the mat " * 15), ("a" * 250, "a" * 260), ("𝔘b", "b𝔘"), ("x", "y"), (None, "x"), ("", "x")]
    assert blocks.ratios(*map(list, zip(*pairs, strict=True))).tolist() == [want(*p) for p in pairs]


def test_in_spark(spark):
    rows = [("스타벅스", "스타벅스 강남"), (None, "x"), ("ab", "ba")]
    got = spark.createDataFrame(rows, "x string, y string").select(sequence_ratio(F.col("x"), F.col("y")).alias("r")).collect()
    assert [r.r for r in got] == [want(*p) for p in rows]
    assert spark.createDataFrame([], "x string, y string").select(sequence_ratio(F.col("x"), F.col("y"))).collect() == []
