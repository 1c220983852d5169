from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerloom.llm.near_dedup import shingles


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 120").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "near dedup", "decontamination", "encoding"]

    kept = stages["quality classifier"](spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = docs.join(labels, "doc_id").join(kept.select("doc_id", F.lit(1).alias("in")), "doc_id", "left").collect()
    assert sum((r["in"] == 1) == (r.quality == 1) for r in judged) >= 0.95 * len(judged)

    lines = stages["line dedup"](spark, kept, sf_dir).cache()
    assert lines.columns == docs.columns
    first = defaultdict(set)
    for r in kept.collect():
        for x in r.text.split("\n"):
            first[x.strip(" \t\n\x0b\x0c\r").lower()].add(r.doc_id)
    for r in lines.collect():
        assert all(len(k) < 10 or len(first[k]) < 2 or min(first[k]) == r.doc_id for x in r.text.split("\n") if (k := x.strip(" \t\n\x0b\x0c\r").lower()) in first)
        assert r.n_chars == len(r.text)

    near = stages["near dedup"](spark, lines, sf_dir).cache()
    sets = {r.doc_id: set(shingles(r.text.encode(), 5, {}).tolist()) for r in lines.collect()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in near.collect()} == {i for i in ids if root[i] == i}

    clean = stages["decontamination"](spark, near, sf_dir).cache()
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(x in " ".join(r.text.split()) for r in clean.collect() for x in items)

    coded = stages["encoding"](spark, clean, sf_dir)
    assert sorted(r.doc_id for r in coded.collect()) == sorted(r.doc_id for r in clean.collect())
    assert all(r.n_tokens == len(r.token_ids) for r in coded.collect())
