"""Column functions: amounts, dates, labels, text keys. All stay in the JVM but for NFKC and sequence_ratio."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .blocks import ratios


def signed_amount(amount: Column, is_refund: Column) -> Column:
    return F.when(is_refund, -F.abs(amount)).otherwise(F.abs(amount))


def income_expense(amount: Column, is_refund: Column) -> tuple[Column, Column]:
    value = F.coalesce(F.abs(amount), F.lit(0).cast("decimal(12,2)"))
    zero = F.lit(0).cast("decimal(12,2)")
    return F.when(is_refund, value).otherwise(zero), F.when(is_refund, zero).otherwise(value)


#: Date formats in order of trial, after the ISO form with a T.
DATE_FORMATS = ["yyyy-M-d", "yyyy.M.d", "yyyy/M/d", "yyyyMMdd", "yyyy-M-d H:m:s", "yyyy.M.d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d H:m", "yyyy.M.d H:m", "yyyy/M/d H:m"]


def _may_fit(t: Column, form: str) -> Column:
    """False for texts that can't have a format, as they lack its signs; a failed trial costs many times this look."""
    if form == "yyyyMMdd":
        return t.rlike("^[+-]?[0-9]+$")
    colons = form.count(":")
    fits = ~F.contains(t, F.lit(":")) if not colons else F.contains(t, F.lit(":")) & (t.like("%:%:%") if colons == 2 else ~t.like("%:%:%"))
    return F.contains(t, F.lit(form[4])) & fits


def coerce_date(text: Column) -> Column:
    t = F.trim(text)
    t = F.when(F.contains(t, F.lit("T")) & t.rlike("^[0-9./-]+T"), F.regexp_extract(t, "^([^T]*)", 1)).otherwise(t)
    return F.coalesce(*(F.when(_may_fit(t, f), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f in DATE_FORMATS))


def coerce_decimal(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, "[,₩원\\s]", ""))
    return F.when((t == "") | (t == "-"), None).otherwise(t).try_cast("decimal(12,2)")


def normalize_header(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


#: Blocks whose code points are looked at for ones that NFKC leaves alone wherever they stand; Latin to Cyrillic, kana, Han, Hangul syllables.
_BLOCKS = [(0x09, 0x0D), (0x20, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x204F), (0x20A0, 0x20BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]


def stable_class() -> str:
    """The insides of a character class: code points that NFKC keeps and that never combine with what is before them."""
    kept = [c for lo, hi in _BLOCKS for c in range(lo, hi + 1) if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and unicodedata.category(chr(c)) != "Cn"]
    ranges: list[list[int]] = []
    for c in kept:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


_UNSTABLE = f"[^{stable_class()}]"
#: What most texts are made of, told at once.
_USUAL = r"[^\x00-\x7f가-힣]"


def _normalized(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


#: Said to be non-deterministic only so that filters on its result aren't copied below it, where it would run again.
_nfkc = arrow_udf(_normalized, T.StringType()).asNondeterministic()


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form. Texts of code points that it leaves alone, as nearly all are, stay in the JVM; only others meet Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(_USUAL) & text.rlike(_UNSTABLE), text)), text)


#: Ends of lines, and white space, as Unicode has them.
_LINE_ENDS = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normalize_text(text: Column) -> Column:
    """NFKC; the white space of each line collapsed, blanks and bars stripped, the won sign spelt, empty lines gone."""
    clean = F.transform(F.split(nfkc(text), _LINE_ENDS), lambda x: F.trim(F.regexp_replace(x, _SPACES, " "), F.lit(" \t|")))
    return F.array_join(F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.replace(x, F.lit("₩"), F.lit("원"))), "\n")


def match_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]", "")


def merchant_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s·\-_.,()（）]", ""))


def merchant_similarity(a: Column, b: Column) -> Column:
    """1 for equal keys, 0.85 where one holds the other, else the share of a's signs that b has."""
    x, y = merchant_key(a), merchant_key(b)
    signs = F.filter(F.split(x, ""), lambda c: c != "")
    common = F.size(F.filter(signs, lambda c: F.instr(y, c) > 0))
    longest = F.greatest(F.length(x), F.length(y))
    near = F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).when(x == y, F.lit(1.0)).when((F.instr(x, y) > 0) | (F.instr(y, x) > 0), F.lit(0.85)).otherwise(common / longest)
    return F.when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(near)


@arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matching-blocks ratio of two texts to four decimals; 0 with a missing one."""
    parts = [ratios(a.slice(i, 2000).to_pylist(), b.slice(i, 2000).to_pylist()) for i in range(0, len(a), 2000)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())


#: Semesters in order.
SEMESTERS = ["1", "2", "summer", "winter"]


def normalize_semester(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.isin(SEMESTERS), s)


def semester_order(semester: Column) -> Column:
    return F.when(semester == "1", 1).when(semester == "2", 2).when(semester == "summer", 3).when(semester == "winter", 4).otherwise(99)


#: What a semester is called.
SEMESTER_LABELS = {"1": "1학기", "2": "2학기", "summer": "여름학기", "winter": "겨울학기"}


def period_label(year: Column, semester: Column, long: bool = False) -> Column:
    name = F.coalesce(*(F.when(semester == k, v) for k, v in SEMESTER_LABELS.items()), semester)
    return F.concat(year.cast("string"), F.lit("학년도 " if long else "-"), name)


def semester_period(year: Column, semester: Column) -> tuple[Column, Column]:
    first = F.when(semester == "1", F.make_date(year, F.lit(3), F.lit(2))).when(semester == "2", F.make_date(year, F.lit(9), F.lit(1)))
    last = F.when(semester == "1", F.make_date(year, F.lit(6), F.lit(22))).when(semester == "2", F.make_date(year + 1, F.lit(2), F.lit(28)))
    return first, last


#: What students read for a status; an approved settlement reads by whether it is published.
STATUS_LABELS = {"draft": "작성 중", "ready_for_review": "검토 준비", "submitted": "감사 중", "resubmitted": "감사 중", "rejected": "반려"}
NO_SETTLEMENT, PUBLISHED, APPROVED = "미제출", "공개 완료", "승인 완료"


def status_label(status: Column, published_at: Column) -> Column:
    """What students read: fixed wording per status; a status without one stands as it is."""
    label = F.when(status.isNull(), NO_SETTLEMENT).when((status == "approved") & published_at.isNotNull(), PUBLISHED).when(status == "approved", APPROVED)
    for name, words in STATUS_LABELS.items():
        label = label.when(status == name, words)
    return label.otherwise(status)


def settlement_label(org: Column, year: Column, semester: Column, title: Column) -> Column:
    return F.trim(F.concat(F.coalesce(org, F.lit("")), F.lit(" "), year.cast("string"), F.lit("-"), semester, F.lit("학기 · "), title))


def ledger_date(d: Column) -> Column:
    return F.date_format(d, "yy. MM. dd.")


def korean_date(d: Column) -> Column:
    return F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월 "), F.day(d), F.lit("일"))


def column_index(letters: Column) -> Column:
    """0 for A, 25 for Z, 26 for AA; null for what isn't letters."""
    signs = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    value = F.aggregate(signs, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1
    return F.when(letters.rlike("^[A-Za-z]+$"), value)


def cell_address(row: Column, col: Column) -> Column:
    """A1 style, from 0-based places of up to 702 columns."""
    tail = F.char(65 + col % 26)
    head = F.when(col >= 26, F.char(64 + F.floor(col / 26))).otherwise("")
    return F.concat(head, tail, (row + 1).cast("string"))


def last_activity(settlements: DataFrame) -> Column:
    return F.greatest("updated_at", "submitted_at", "audited_at", "published_at")


#: Words that mark a text as an address.
ADDRESS_HINTS = [
    "서울", "경기", "인천", "부산", "대구", "대전", "광주", "울산", "세종", "충북", "충남", "전북", "전남", "경북", "경남", "강원", "제주",
    "광진구", "송파구", "강남구", "자양로", "능동로", "로 ", "길 ", "층",
]


def looks_like_address(text: Column) -> Column:
    hints = sum(((F.instr(text, h) > 0).cast("int") for h in ADDRESS_HINTS), F.lit(0))
    return (hints >= 2) | text.rlike(r"\d{1,4}-\d{1,4}")


def alpha_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(letters / F.length(text))


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")
