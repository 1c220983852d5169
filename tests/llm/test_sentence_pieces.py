"""The piece coder against the library: ids, spans, decoded texts, and other character maps than the file's own."""

from __future__ import annotations

import hashlib
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import sentence_pieces
from ledgerloom.llm.queries import pieces_path, queries

sentencepiece = pytest.importorskip("sentencepiece")

PARTS = [" ", "  ", "a", "th", "the ", "\n", "\t", "é", "é", "ß", "日", "本", "☃", "▁", "\0", "1", "23", ".", ",", "<s>", "</s>", "<unk>", "<0x0A>", "Ä", "𝔘", "�", "　", "ing", " " * 18, "ﬁ", "Ⅳ", "한글", "한", "̈", "​", "Ａ"]


def texts(n: int) -> list[str]:
    r = random.Random(5)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 50))) for _ in range(n)]
    return ["", " ", "\n", "   ", "x" * 300, " " * 500, "ab" * 2000, " the" * 3000, "▁▁ ▁", "日本" * 100, *made]


def number(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def packed(field: int, data: bytes) -> bytes:
    return number(field << 3 | 2) + number(len(data)) + data


def with_rule(rule: str, prefix: bool, squeeze: bool) -> bytes:
    """The file's model with another normaliser."""
    with open(pieces_path(), "rb") as f:
        fields = [*sentence_pieces.message(f.read())]
    spec = next(v for k, v in sentence_pieces.message(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3)
    blob = dict(sentence_pieces.message(spec))[2]
    norm = packed(1, rule.encode()) + packed(2, blob) + b"\x18" + bytes([prefix]) + b"\x20" + bytes([squeeze])
    return b"".join(packed(k, v) for k, v in fields if k in (1, 2)) + packed(3, norm)


def agree(ours: sentence_pieces.PieceModel, theirs, given: list[str]) -> None:
    ids, starts, ends = ours.encode([t.encode() for t in given])
    decoded = ours.decode(ids).to_pylist()
    for t, i, a, b, d in zip(given, ids.to_pylist(), starts.to_pylist(), ends.to_pylist(), decoded, strict=True):
        want = theirs.encode(t, return_type="proto").pieces
        assert i == [1, *(p.id for p in want), 2], t
        assert [*zip(a, b)][1:-1] == [(p.begin, p.end) for p in want], t
        assert d == theirs.decode(i), t


def test_ids_spans_and_texts_are_the_librarys():
    agree(sentence_pieces.PieceModel(pieces_path()), sentencepiece.SentencePieceProcessor(model_file=pieces_path()), texts(1500))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_other_character_maps(tmp_path, rule, prefix, squeeze):
    data = with_rule(rule, prefix, squeeze)
    path = tmp_path / "other.model"
    path.write_bytes(data)
    agree(sentence_pieces.PieceModel(str(path)), sentencepiece.SentencePieceProcessor(model_proto=data), texts(700))


def test_decoding_any_ids():
    r = random.Random(7)
    rows = [[r.randrange(32000) if r.random() < 0.6 else r.randrange(259) for _ in range(r.randint(1, 12))] for _ in range(3000)]
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    got = sentence_pieces.PieceModel(pieces_path()).decode(pa.array([*rows, []], pa.list_(pa.int32()))).to_pylist()
    assert got == [*(theirs.decode(x) for x in rows), ""]


def test_a_forgetful_coder_gives_the_same(monkeypatch):
    given = [t.encode() for t in texts(300)]
    whole = sentence_pieces.PieceModel(pieces_path()).encode(given)
    monkeypatch.setattr(sentence_pieces, "CHUNKS_KEPT", 10)
    monkeypatch.setattr(sentence_pieces, "SLICE", 100)
    assert sentence_pieces.PieceModel(pieces_path()).encode(given) == whole


def test_bytes_that_are_no_text():
    got, at = sentence_pieces.PieceModel(pieces_path()).normalise(b"a\xe2\x96b\xff")
    assert (got.decode(), at.tolist()) == (" a��b�", [0, 0, 1, 1, 1, 2, 2, 2, 3, 4, 4, 4, 5])


def test_other_models_are_refused(tmp_path):
    with open(pieces_path(), "rb") as f:
        fields = [*sentence_pieces.message(f.read())]
    path = tmp_path / "unigram.model"
    path.write_bytes(b"".join(packed(k, v) for k, v in fields if k in (1, 3)))
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(str(path))


def test_the_query(spark, sf_dir):
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op11_sentencepiece"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        ids = theirs.encode(text[r.doc_id] or "", add_bos=True, add_eos=True)
        data = b"".join(struct.pack("<I", i) for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
        assert r.n_spanned == len((text[r.doc_id] or "").encode())


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " a b", "x"), (3, " a b", "x"), (None, "naïve ☃", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts string").withColumn("kept", F.lit(1))
    out = sentence_pieces.encode_pieces(docs, pieces_path())
    assert out.columns == ["doc_id", "text", "kept", "token_ids", "starts", "ends", "decoded"]
    got = sorted((str(r.doc_id), r.decoded, r.starts, r.ends) for r in out.collect())
    assert [g[:2] for g in got] == [("1", ""), ("2", ""), ("3", " a b"), ("3", " a b"), ("None", "naïve ☃")]
    assert got[0][2:] == ([0, 0], [0, 0]) and got[2][2:] == ([0, 0, 0, 2, 4], [0, 0, 2, 4, 4])
    assert sentence_pieces.encode_pieces(docs.limit(0), pieces_path()).collect() == []
    back = out.select("decoded", sentence_pieces.decode(F.col("token_ids"), pieces_path()).alias("again")).collect()
    assert all(r.decoded == r.again for r in back)
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert none.select(sentence_pieces.decode(F.col("ids"), pieces_path()), sentence_pieces.packed(F.col("ids"))).collect() == [("", b"")]
