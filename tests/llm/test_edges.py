"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, url_filters
from ledgerloom.llm.queries import URL_RULES, tokenizer_path

LONG = " ".join(f"word{i % 977} x{i}" for i in range(30000))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG), (5, LONG), (6, "a b c\na b c"), (None, "null id"), (None, None), (7, "naïve ☃ 日本 text"), (8, "a b c\na b c")]
EXTRA = {"n_words": "clash", "kept": 1, "id": 2, "doc": 3, "_doc": 4, "score": "s", "a": 0, "th": 0, "out": 5, "firsts": 6, "counts": 7, "dropped": 8, "doc_": 9, "_th": 10, "_out": 11, "bad": 12}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()}).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")


OPS = {
    "rules": lambda d, lab: quality_rules.quality_rules(d),
    "substring": lambda d, lab: substring_dedup.dedup_substrings(d),
    "bpe": lambda d, lab: bpe.encode_documents(d, tokenizer_path()),
    "suffix": lambda d, lab: suffix_dedup.dedup_strings(d),
    "sharding": lambda d, lab: sharding.shard_rows(d),
    "near": lambda d, lab: near_dedup.near_duplicates(d),
    "lines": lambda d, lab: line_dedup.dedup_lines(d),
    "classifier": lambda d, lab: quality_classifier.classify(d, quality_classifier.fit_on(d, lab)),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_a_row_for_every_row(docs, labels, name):
    assert len(OPS[name](docs, labels).collect()) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_tables(docs, labels, name):
    assert OPS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_copies(docs):
    left = substring_dedup.dedup_substrings(docs).filter("doc_id in (4, 5)").select("doc_id", "n_removed").collect()
    assert sorted((r.doc_id, r.n_removed) for r in left) == [(4, 0), (5, 60000), (5, 60000)]
    gone = suffix_dedup.dedup_strings(docs).filter("doc_id in (4, 5)").select("n_bytes", "n_removed").collect()
    assert all(r.n_bytes == r.n_removed for r in gone)
    near = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert {(4, 4, True), (5, 4, False), (6, 6, True), (8, 6, False), (1, 1, True), (2, 2, True), (None, None, True)} <= near


def test_shards_are_even_and_gapless(docs):
    rows = sharding.shard_rows(docs, shards=4, vnodes=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [2, 3, 3, 3]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_null_benchmark_and_no_labels(spark, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g h i j")], "item_id long, text string")
    assert decontamination.leaks(docs, bench).collect() == []
    assert decontamination.without_leaks(docs, bench).count() == len(ROWS)
    none = quality_classifier.fit_on(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.predicted for r in quality_classifier.classify(docs, none).collect()} == {1}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/1?x=://y", "http://m.example.com/en/2", "http://a.net/es/1", "http://a.org/x", "http://a.org/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filters.filter_urls(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[5].rule, got[5].verdict, got[6].rule) == ("example.com/en/", "block", "net/es/")
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None)
    assert url_filters.filter_urls(pages.limit(0), URL_RULES).collect() == []


@pytest.mark.parametrize("name", ["substring", "suffix", "lines", "classifier"])
def test_other_columns_are_handed_on(docs, labels, name):
    out = OPS[name](docs, labels)
    new = {"substring": ["n_words"], "classifier": ["score"]}.get(name, [])
    kept = [c for c in EXTRA if c not in new]
    assert set(kept) <= set(out.columns)
    assert {tuple(r) for r in out.select(*kept).collect()} == {tuple(EXTRA[c] for c in kept)}


def test_documents_without_leaks_keep_their_columns(spark, docs):
    bench = spark.createDataFrame([(1, "null id")], "item_id long, text string")
    assert decontamination.without_leaks(docs, bench).columns == docs.columns


@pytest.mark.parametrize("name", ["substring", "suffix", "lines"])
def test_ids_that_are_no_numbers(spark, name):
    with pytest.raises(TypeError):
        OPS[name](spark.createDataFrame([("x", "text")], "doc_id string, text string"), None)


def test_long_lines_and_long_words(spark):
    word, line = "w" * 300_000, " ".join(["same"] * 60_000)
    rows = [(1, word), (2, word), (3, line), (4, line + "\n" + word)]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(long).collect()} == {1: 0, 2: 1, 3: 0, 4: 2}
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(long).collect()} == {1: 0, 2: 0, 3: 0, 4: 60_000}
    assert all(r.n_removed == r.n_bytes or r.doc_id == 4 for r in suffix_dedup.dedup_strings(long).collect())


STAGE_ROWS = [(1, None), (2, ""), (3, "x"), (4, "a line of plain words here.\nand one more line"), (4, "a line of plain words here.\nand one more line"), (5, "a line of plain words here.\nand one more line"), (None, "a text of no id at all")]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    text = "doc_id long, text string, lang string, source string, n_chars long"
    full = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in STAGE_ROWS], text).withColumn("bad", F.lit(1)).withColumn("doc", F.lit(2))
    spark.createDataFrame([(3, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never found in any text of these documents here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, full, str(tmp_path))
        assert stage(spark, full.limit(0), str(tmp_path)).collect() == []
        if name != "encoding":
            assert got.columns == corpus_pipeline.COLUMNS
        ids = [r.doc_id for r in got.collect()]
        assert None in ids or name == "quality classifier"
        if name in ("line dedup", "decontamination", "encoding"):
            assert len(ids) == len(STAGE_ROWS)
        if name == "near dedup":
            assert 5 not in ids
