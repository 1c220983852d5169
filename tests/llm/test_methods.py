"""The methods against brute force, on small inputs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, common, decontamination, line_dedup, near_dedup, quality_classifier, substring_dedup, suffix_dedup, url_filters
from ledgerloom.llm.anchors import blocks
from ledgerloom.llm.common import Scratch
from ledgerloom.llm.decontamination import leaks
from ledgerloom.llm.quality_rules import quality_rules
from ledgerloom.llm.queries import op3_bpe, op8_quality_classifier, op9_decontamination, op10_url_filters, tokenizer_path
from ledgerloom.llm.suffix_groups import suffix_order


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffixes_by_lyndon_groups(xs):
    seq = [*xs, 0]
    assert suffix_order(np.array(seq)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


@pytest.mark.parametrize("seed", range(8))
def test_repeated_strings(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab cd") for _ in range(400))
    texts = []
    for _ in range(8):
        i = rng.randrange(300)
        texts.append(base[i : i + rng.randrange(20, 100)] + bytes(rng.choice(b"ab cd") for _ in range(rng.randrange(30))))
    span = 17
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], []).append((k, i))
    want = [[len(seen[t[i : i + span]]) > 1 for i in range(len(t) - span + 1)] for t in texts]
    assert [x.tolist() for x in suffix_dedup.repeated_strings(texts, span)] == want


@pytest.mark.parametrize("seed", range(8))
def test_windows_of_earlier_documents(seed):
    rng = random.Random(seed)
    base = [rng.randrange(5) for _ in range(200)]
    seqs = []
    for _ in range(9):
        i = rng.randrange(150)
        seqs.append(np.array(base[i : i + rng.randrange(16, 45)] + [rng.randrange(5) for _ in range(rng.randrange(9))], np.uint64))
    seqs = [x.astype(np.int64) + 1 for x in seqs]
    docs = np.array([rng.randrange(6) for _ in seqs])
    indexed = np.array([seed % 2 == 0 or rng.random() < 0.6 for _ in seqs])
    span = 16 + seed % 3
    first = {}
    for s, d in zip((x for x, i in zip(seqs, indexed, strict=True) if i), docs[indexed], strict=True):
        for i in range(len(s) - span + 1):
            k = tuple(s[i : i + span].tolist())
            first[k] = min(first.get(k, 99), int(d))
    none = np.iinfo(np.int64).max
    want = [[first.get(tuple(s[i : i + span].tolist()), none) for i in range(len(s) - span + 1)] for s in seqs]
    texts = [[b"%d" % x for x in s] for s in seqs]
    shard = substring_dedup.Shard([t for t, i in zip(texts, indexed, strict=True) if i], docs[indexed].tolist(), span)
    assert [x.tolist() for x in shard.least_docs(texts)] == want


@pytest.mark.parametrize("room", [100, 1_000])
def test_a_task_never_holds_all_of_a_group(monkeypatch, room):
    """A group of twenty times the room streams in slices, and gives what one shard of all gives."""
    rng = random.Random(2)
    base = [b"w%d" % rng.randrange(40) for _ in range(60)]
    rows = []
    for c in range(room // 2):
        i = rng.randrange(20)
        rows.append((1, 0, c, c, 10**6, c < 3, b" ".join(base[i : i + 40])))
    small = [(a, 0, c, c, 10**6, True, b" ".join(base[:20] + [b"x%d" % a])) for a in (0, 2) for c in range(2)]
    held = []
    own = substring_dedup.Shard.least_docs
    monkeypatch.setattr(substring_dedup.Shard, "least_docs", lambda self, texts: held.append(sum(map(len, texts))) or own(self, texts))
    given = [*small[:2], *rows, *small[2:]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*given, strict=True)], list("akcdliw"))

    def found(room):
        return [r for b in substring_dedup.reported_spans(16, room)(iter([batch])) for r in b.to_pylist()]

    sliced = found(room)
    assert max(held) <= room + 200 and len(held) >= 15
    assert sliced == found(10**9)


def test_bit_vectors():
    rng = np.random.default_rng(4)
    flags = rng.random(700) < 0.02
    flags[[0, 699]] = True
    bits = substring_dedup.Bits(flags)
    bits.link()
    at, i = np.flatnonzero(flags), np.arange(699)
    assert (bits.rank(i) == np.searchsorted(at, i)).all()
    assert (bits.last(i) == at[np.searchsorted(at, i, side="right") - 1]).all()
    assert (bits.next(i) == at[np.searchsorted(at, i, side="right")]).all()


@pytest.mark.parametrize(("room", "sent"), [(600_000, 250_000), (30, 0)])
def test_removed_words_against_all_windows(spark, monkeypatch, room, sent):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", room)  # 30: several shards to an anchor
    monkeypatch.setattr(common, "IDS_SENT", sent)
    rng = random.Random(7)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    p, r, edges = words(90), words(60), [words(30) for _ in range(4)]
    q = edges[0] + p + edges[1]
    other = edges[2] + r + edges[3]
    rows = [
        (1, words(9) + p + words(9)), (2, words(5) + q + words(20) + q + words(7) + q),  # copies in one document
        (3, r), (4, words(8) + other), (4, other + words(3)), (4, other + words(3)),  # rows of equal id
        (5, words(40)), (None, words(3) + edges[2] + p + edges[3]), (None, edges[2] + p + edges[3] + words(3)), (None, r + r),
    ]
    rows[-4] = (5, rows[-4][1] + q[10:140])
    span, first = 16, {}
    key = lambda d: 10**9 if d is None else d
    for d, x in rows:
        for i in range(len(x) - span + 1):
            w = tuple(x[i : i + span])
            first[w] = min(first.get(w, 10**9), key(d))
    want = []
    for d, x in rows:
        gone = {k for i in range(len(x) - span + 1) if first[tuple(x[i : i + span])] < key(d) for k in range(i, i + span)}
        want.append((str(d), " ".join(w for k, w in enumerate(x) if k not in gone)))
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")
    got = substring_dedup.dedup_substrings(docs, span=span).collect()
    assert sorted((str(x.doc_id), x.kept_text) for x in got) == sorted(want)


@pytest.mark.parametrize(("room", "sent"), [(1_000_000, 250_000), (900, 0)])
def test_removed_bytes_against_all_strings(spark, monkeypatch, room, sent):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", room)  # 900: several parts to an anchor
    monkeypatch.setattr(common, "IDS_SENT", sent)
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("abcdé ,.\n") for _ in range(n))

    p, q = text(150), text(220)
    texts = [text(60), text(30) + p + text(50), p + text(9) + p, text(80) + q[20:], q, q, text(10) + q[:140] + text(4) + p[30:], "", None, "x" * 300]
    rows = list(zip([1, 2, 3, 4, 5, 6, 6, 7, 8, None], texts, strict=True)) + [(None, q), (20, text(40) + q)]
    span, seen = 70, {}
    raw = [(t or "").encode() for _, t in rows]
    for t in raw:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    want = []
    for (d, _), t in zip(rows, raw, strict=True):
        gone = {k for i in range(len(t) - span + 1) if seen[t[i : i + span]] > 1 for k in range(i, i + span)}
        want.append((str(d), len(gone), sum(k - 1 not in gone for k in gone), bytes(x for k, x in enumerate(t) if k not in gone)))
    got = suffix_dedup.dedup_strings(spark.createDataFrame(rows, "doc_id long, text string"), span=span)
    assert sorted((str(r.doc_id), r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in got.collect()) == sorted(want)


def test_rests_of_one_hash(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Strings, "of", lambda self, at, to: np.zeros(len(at), np.uint64))
    test_repeated_strings(3)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 9, 120)
    a, b = (np.concatenate([rng.integers(0, 9, k), shared, rng.integers(0, 9, 30)]) for k in (17, 40))

    def anchors(x):
        h, first, n = blocks(x, 50, 8)
        return np.repeat(h, n)

    assert (anchors(a)[17 : 17 + 71] == anchors(b)[40 : 40 + 71]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(text):
    coder, library = bpe.tokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert coder.encode([text.encode("utf-8", "ignore")]).to_pylist()[0] == library.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


def test_bpe_of_odd_words():
    coder, library = bpe.tokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("<|startoftext|>Hi<|endoftext|> <|x", "ΣΑΣ ΟΔΟΣ", "don't WE'LL", "a" * 300, "x!y" * 40, "é\x1c\x85　z"):
        got = coder.encode([text.encode()])
        want = library.encode(text, add_special_tokens=False).ids
        assert got.to_pylist()[0] == want
        import pyarrow as pa

        assert bpe.joined(got, pa.array(coder.tokens)).to_pylist()[0] == library.decode(want, skip_special_tokens=False)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(5)
    u, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    p, pairs, _ = quality_classifier.chains(u, np.array([5]), trans)
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        w = np.exp(sum(a for a, b in zip(u, y, strict=True) if b) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    assert np.allclose(p, good / total)
    assert np.isclose(pairs.sum(), 4)


def test_forward_backward_of_long_chains():
    rng = np.random.default_rng(6)
    for lens in ([1], [1, 1, 2], [16, 17, 15, 33], [700, 1, 300, 2], [257] * 3, [5000, 3]):
        u, trans = rng.normal(0, 3, sum(lens)), rng.normal(0, 2, (2, 2))
        p, pairs, total = quality_classifier.chains(u, np.array(lens), trans)
        want_p, want_pairs, want_total, at = [], np.zeros((2, 2)), 0.0, 0
        for n in lens:  # line by line, in logarithms
            x = np.stack([np.zeros(n), u[at : at + n]], axis=1)
            fwd, bwd = x.copy(), np.zeros((n, 2))
            for t in range(1, n):
                fwd[t] += np.logaddexp.reduce(fwd[t - 1][:, None] + trans, axis=0)
            for t in range(n - 2, -1, -1):
                bwd[t] = np.logaddexp.reduce(trans + (x[t + 1] + bwd[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(fwd[-1])
            want_p += np.exp(fwd + bwd - z)[:, 1].tolist()
            for t in range(1, n):
                want_pairs += np.exp(fwd[t - 1][:, None] + trans + (x[t] + bwd[t])[None] - z)
            want_total += z
            at += n
        assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    with Scratch(spark, "test") as s:
        got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), s).collect()}
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_shared_counts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 80)
    sets = [np.unique(np.concatenate([rng.choice(base, 60), rng.integers(0, 300, 20)]).astype(np.uint64)) for _ in range(9)]
    counts = near_dedup.shared_counts(sets)
    assert all(counts(i)[j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def near_corpus() -> list[tuple[int, str | None]]:
    """A large group of near copies of one text, some beyond the threshold, smaller groups, and texts of their own."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(150)]
    for i in range(140):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            copy[rng.randrange(150)] = f"new{rng.randrange(9999)}"
        rows.append(" ".join(copy))
    for _ in range(12):
        small = [rng.choice(words) for _ in range(rng.choice([3, 40, 90]))]
        rows += [" ".join(small), " ".join([*small, "more"]), " ".join(small[1:])]
    rows += [None, "", "one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def near_components(rows: list[tuple[int, str | None]], percent: int) -> dict[int, int]:
    sets = {i: set(near_dedup.shingles((t or "").encode(), 5, {}).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a + 1, len(rows)):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("errors", "percent", "blocks"), [(0, 85, None), (1, 85, None), (1, 80, (16, 1500)), (2, 85, (16, 1500))])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, errors, percent, blocks):
    if blocks:
        monkeypatch.setattr(near_dedup, "SIGNATURES", blocks[0])
        monkeypatch.setattr(near_dedup, "SHINGLES", blocks[1])
    rows = near_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent=percent, errors=errors).collect()}
    assert got == near_components(rows, percent)


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (9, c), (9, None), (11, ""), (None, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False), (9, 9, True), (9, 9, True), (11, 11, True), (None, None, True)]
    assert sorted([(r.doc_id, r.component_id, r.kept) for r in got], key=str) == sorted(want, key=str)


def test_near_duplicates_without_broadcast_and_with_text_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "IDS_SENT", 0)
    rows = near_corpus()
    docs = spark.createDataFrame([(f"{i:04}", t) for i, t in rows], "doc_id string, text string")
    got = {int(r.doc_id): int(r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == near_components(rows, 85)


def test_radius_and_chunks():
    for percent in (50, 80, 85, 95):
        r = near_dedup.radius_for(percent)
        differs = 1 - percent / 100
        beyond = sum(math.comb(96, k) * differs**k * (1 - differs) ** (96 - k) for k in range(r + 1, 97))
        assert beyond <= near_dedup.LOSS < beyond + math.comb(96, r) * differs**r * (1 - differs) ** (96 - r)
        for errors in (0, 1, 2):
            chunks = near_dedup.chunk_symbols(r, errors)
            assert sorted(sum(chunks, [])) == list(range(96))
            assert len(chunks) * (errors + 1) > r


def test_line_runs_are_sorted_and_can_be_opened_again(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    folder = f"{tmp_path}/runs"
    first = batch([(1, "the first line\nof one here"), (2, "the first line\nanother one")])
    runs = line_dedup.LineRuns(spark, buckets=3, fanout=2, folder=folder)
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(first, batches=2, runs=runs).collect()} == {1: 0, 2: 1}
    again = line_dedup.LineRuns(spark, folder=folder)
    assert again.buckets == 3
    assert sum(run.count() for run in again.runs()) == 3
    second = batch([(0, "The first line\nnew in two  "), (5, "new in two of it\nanother one"), (6, "new in two")])
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(second, batches=1, runs=again).collect()} == {0: 1, 5: 1, 6: 1}
    third = line_dedup.LineRuns(spark, folder=folder)
    assert sum(run.count() for run in third.runs()) == 5
    own = spark.createDataFrame([(1, 2)], "h1 long, h2 long")
    with line_dedup._in_bucket_order(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = own.join(third.runs()[0], ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1
    third.drop()


def test_lines_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(40), "\n".join(rng.choice([" Common line of all ", "rare line %d" % rng.randrange(30), "short", ""]) for _ in range(6))) for _ in range(60)]
    first = {}
    for i, t in sorted(rows):
        for x in t.split("\n"):
            first.setdefault(x.strip().lower(), i)
    want = sorted((i, "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == i)) for i, t in rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=5)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want


def test_templates(spark):
    docs = spark.createDataFrame([(1, "so then Tom has 7 apples and Bob gives her 7 more apples so how many apples are there"), (2, "so then Tom has 7 apples and Bob gives her 9 more apples so how many apples are there"), (3, "nothing of the kind is here at all in this text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Now then Anna has 5 apples and Bob gives her 5 more apples so how many apples are there")], "item_id long, text string")
    assert [(r.doc_id, r.n_changed) for r in leaks(docs, bench).collect()] == [(1, 2)]


def reparameterised() -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Items with numbers, names and units, and documents that hold them verbatim, in part, with other values, and with values
    that don't fit together."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("gra", "lo", "mi", "ten", "ur") for b in ("ba", "ko", "ly", "sen", "vi", "zo")]
    items, docs = [], []
    for item in range(12):
        parts = [rng.choice(words) for _ in range(rng.randrange(14, 30))]
        for k in range(2, len(parts) - 1, rng.choice([3, 4, 5])):
            parts[k] = rng.choice(["{n}", "{n} kg", "{m}", "Anna", "{n}"])
        made = lambda n, m, name, parts=parts: " ".join(parts).replace("{n}", str(n)).replace("{m}", str(m)).replace("Anna", name)
        items.append((item, made(5, 17, "Anna")))
        pad = lambda: " ".join(rng.choice(words) for _ in range(7))
        whole = made(8, 23, "Tom")
        mixed = whole.replace("8", "9", 1)
        for text in (items[-1][1], whole, mixed, " ".join(whole.split()[: len(whole.split()) // 2]), pad()):
            docs.append((len(docs), f"{pad()} {text} {pad()}"))
    return docs, items


def test_templates_against_all_windows(spark):
    docs, items = reparameterised()
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").select("id", decontamination.canonical_words(F.col("text")).alias("c"), decontamination.literal_words(F.col("text")).alias("r")).collect()
    want = {}
    for d in frame(docs):
        for i in frame(items):
            size, of = 8, len(i.c) - 7
            slot = [a != b for a, b in zip(i.c, i.r, strict=True)]
            opened = [5 <= size - sum(slot[at : at + size]) for at in range(of)]
            met = []
            for at in range(of):
                for x in range(len(d.c) - size + 1):
                    verbatim = i.r[at : at + size] == d.r[x : x + size]
                    if verbatim or (opened[at] and any(slot[at : at + size]) and i.c[at : at + size] == d.c[x : x + size]):
                        met.append((x - at, at, verbatim))
            runs = any(all((shift, at + k, True) in met for k in range(6)) for shift, at, _ in met)

            def coverage(met, of=of, opened=opened):
                ats = {at for _, at, _ in met}
                return len(ats), max(len(ats) / of, len({at for at in ats if opened[at]}) / sum(opened) if any(opened) else 0.0)

            if not met or not (runs or coverage(met)[1] >= 0.3):
                continue
            sound = []
            for shift in {m[0] for m in met}:
                here = [m for m in met if m[0] == shift]
                at_slots = {k for _, at, _ in here for k in range(at, at + size) if slot[k]}
                stands = {}
                for k in at_slots:
                    stands.setdefault(i.r[k], set()).add(d.r[k + shift])
                bad = {k for k in at_slots if len(stands[i.r[k]]) > 1}
                sound += [m for m in here if m[2] or not bad & set(range(m[1], m[1] + size))]
            n, share = coverage(sound)
            if sound and (runs or share >= 0.3):
                want[d.id, i.id] = (n, round(share, 6))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_windows, r.coverage) for r in got.collect()} == want
    assert len(want) >= 30


def test_url_models_against_brute_force(spark):
    rng = random.Random(12)
    rules = [("allow", "com", "/"), ("block", "net", "/")]
    hosts = [("news", "com"), ("shop", "com"), ("casino", "net"), ("win", "net"), ("blog", "org"), ("casino", "org")]
    urls = [f"http://{h}{rng.randrange(30)}.{tld}/{rng.choice(['a', 'read', 'bet', 'bonus'])}/{rng.randrange(99)}" for h, tld in (rng.choice(hosts) for _ in range(160))] + ["http://x.com/a"] * 3
    texts = {u: "^^^" + "".join("0" if c.isdigit() else c if c.isascii() and c.isalpha() or c in "./-?" else "~" for c in u.split("://")[1].lower()) for u in urls}
    given = {u: "allow" if u.split("/")[2].endswith(".com") else "block" if u.split("/")[2].endswith(".net") else None for u in urls}
    held = {u: zlib.crc32(u.encode()) % 5 == 0 for u in urls}
    seen = {v: Counter() for v in ("allow", "block")}
    for u in urls:
        if given[u] and not held[u]:
            t = texts[u]
            seen[given[u]].update(t[k - n : k + 1] for k in range(3, len(t)) for n in range(4))
    contexts = {v: Counter() for v in seen}
    kinds = {v: Counter() for v in seen}
    for v, counts in seen.items():
        for g, n in counts.items():
            contexts[v][g[:-1], len(g)] += n
            kinds[v][g[:-1], len(g)] += 1

    def p(v: str, gram: str) -> float:
        out = 1 / 32
        for n in range(1, 5):
            g = gram[4 - n :]
            c = contexts[v][g[:-1], n]
            if c:
                out = (seen[v][g] + kinds[v][g[:-1], n] * out) / (c + kinds[v][g[:-1], n])
        return out

    score = {u: round(float(np.mean([math.log(p("allow", t[k : k + 4])) - math.log(p("block", t[k : k + 4])) for k in range(len(t) - 3)])), 6) for u, t in texts.items()}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filters.filter_urls(pages, rules).collect()}
    assert all(abs(rows[i].score - score[u]) < 2e-6 for i, u in enumerate(urls))
    bins = lambda x: max(-200, min(200, math.floor(x / 0.02 + 1e-9)))
    held_out = [(bins(score[u]), given[u]) for u in urls if held[u] and given[u]]
    loss = lambda b: round(sum(x < b for x, v in held_out if v == "allow") / sum(v == "allow" for _, v in held_out) + 1 - sum(x < b for x, v in held_out if v == "block") / sum(v == "block" for _, v in held_out), 9)
    line = min((loss(b), abs(b), b) for b in {b for b, _ in held_out})[2] * 0.02
    for i, u in enumerate(urls):
        assert rows[i].verdict == (given[u] or ("allow" if score[u] >= round(line, 2) else "block"))


def test_repeated_items(spark):
    first, second = ("the quick brown fox jumps over the lazy dog near a quiet river bank", " ".join(f"other{chr(97 + k)}" for k in range(20)))
    docs = spark.createDataFrame([(1, f"as told here {first} and so on"), (2, f"then {second} again")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, first)] * 5 + [(2, first), (2, second), (2, " ".join(f"third{chr(97 + k)}" for k in range(20)))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_windows, r.coverage) for r in leaks(docs, bench).collect())
    assert got == [(1, 1, 7, 1.0), (1, 2, 7, 1.0), (2, 2, 13, 1.0)]


def test_verbatim_items_of_any_words(spark):
    items = [
        (1, "1, 2, 4, 8, 16, 32, 64, 128: what comes next?"), (2, "zeta quotient lemma"), (3, "日本の首都はどこですか教えてください"),
        (4, "if <a> and <b> or <c> then <d> else <e> end of <f> here"), (5, "not in any of these documents at all, is it"),
    ]
    docs = spark.createDataFrame([(i, f"it was said that {t} by all of them") for i, t in items[:2]] + [(3, "問題。日本の首都はどこですか教えてください。以上"), (4, f"code: {items[3][1]} and more"), (6, "1, 2, 3, 5, 8, 13, 21, 34: what is this?")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]


def test_passages_of_long_items(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    docs = spark.createDataFrame([(1, "as in " + " ".join(words[150:250]) + " it says"), (2, "as in " + " ".join(words[7:20]) + " it says"), (3, "as in " + " ".join(words[7:19]) + " it says")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_windows, r.coverage) for r in leaks(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect())
    assert got == [(1, 93, round(93 / 393, 6)), (2, 6, round(6 / 393, 6))]


def test_one_slot_for_two_words(spark):
    def text(numbers):
        return " ".join(f"w{chr(97 + k)}x w{chr(97 + k)}y w{chr(97 + k)}z {n}" for k, n in enumerate(numbers))

    docs = spark.createDataFrame([(1, text([*range(31, 41), 7, 9])), (2, text([*range(31, 41), 7, 7]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text([*range(11, 21), 5, 5]))], "item_id long, text string")
    got = sorted((r.doc_id, r.n_windows, r.n_slots, r.n_changed) for r in leaks(docs, bench).collect())
    assert got == [(1, 36, 10, 10), (2, 41, 11, 11)]


def test_leaks_against_a_search(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, sf_dir).collect()}
    docs = {r.doc_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole <= got
    assert all(any(" ".join(items[i].split()[k : k + 8]) in docs[d] for k in range(len(items[i].split()) - 7)) for d, i in got)


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = op8_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_urls_follow_the_training_rules(spark, sf_dir):
    rows = op10_url_filters(spark, sf_dir).collect()
    assert {r.verdict for r in rows} <= {"allow", "block"}
    assert all(r.verdict == "block" for r in rows if r.rule == "example.com/en/")


def test_fences_follow_the_stratum(spark):
    """The same documents are odd in a source without symbols or repeated lines, and not in one where they are common."""
    rng = random.Random(3)
    prose = lambda: " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
    code = lambda k: prose() + " " + " ".join(["{" + "$" * k + "}"] * 2 + [f"x{rng.randrange(10**6)}"])
    lines = lambda: prose() + "\nend" * 6 + "\n" + prose()
    rows = [(i, prose(), "prose") for i in range(300)] + [(300 + i, code(5 + i % 20), "code") for i in range(300)] + [(600 + i, lines() if i % 3 else prose(), "log") for i in range(300)]
    rows += [(1000, code(12), "prose"), (1001, code(12), "code"), (1002, lines(), "prose"), (1003, lines(), "log"), (1004, code(12), "new"), (1005, code(1), "prose")]
    rows += rows[-6:]  # repeated rows, and ties of every measure
    judged = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))).collect()
    assert len(judged) == len(rows) and not any(r.base_failed for r in judged)
    kept = {r.doc_id: r.kept for r in judged}
    assert [kept[i] for i in range(1000, 1006)] == [False, True, False, True, True, True]
    assert all(kept[i] for i in range(900))


def test_recall_of_items_with_every_name_and_number_changed(spark):
    rng = random.Random(8)
    names = "Tom Ann Bob Sue Maria Peter Olga Ivan Lena Karl Nina Paul".split()
    places = ["from the market near the old bridge", "at the corner shop behind the school", "on the way to the river", "with the help of a neighbour", "before the rain starts in the evening", "while the others wait outside the gate"]
    frames = ["{N} {v} {x} {t} {e}.", "In the morning {N} {v} {x} {t} {e}.", "Then {N} walks {x} {u} {e}.", "Each of the {t} costs {x} dollars {e}, says {N}.", "How many {t} does {N} have after {x} {u} {e}?"]
    pick = lambda words: rng.choice(words.split())
    items = [[{"frame": rng.choice(frames), "v": pick("buys finds sells counts packs"), "t": pick("apples pears stamps coins books"), "e": rng.choice(places), "u": pick("km kg hours days liters")} for _ in range(k)] for k in (1, 2, 3, 5) for _ in range(25)]
    told = lambda item: " ".join(s["frame"].format(N=rng.choice(names), x=rng.randrange(2, 900), **{k: s[k] for k in "vteu"}) for s in item)
    bench = spark.createDataFrame([(i, told(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"It is told here. {told(x)} That is all.") for i, x in enumerate(items)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert sum((i, i) in found for i in range(len(items))) >= 0.95 * len(items)


def test_token_query_against_the_library(spark, sf_dir):
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op3_bpe(spark, sf_dir).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
