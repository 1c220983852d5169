"""BPE encoding and decoding by speculation and verification.

A word's proposal is its greedy longest match over the tokens that encode to themselves. A proposal is
the word's encoding just when every two neighbours keep their border, which is checked for all
neighbours of a batch of new words at once: the two tokens are taken apart in the reverse order of
their merges, and at no time may a merge over the border come before the next merge beside it. Words
with a failing border are merged exactly, lowest rank first.

A task keeps the encodings of the words it has met, up to ``WORDS_KEPT`` of them.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

WORDS_KEPT = 300_000
#: Rows of a batch that goes back to Spark: ids and tokens are several times as large as the text.
ROWS_OUT = 250
#: Bytes of texts that are split into words at a time; a longer text is a slice of its own.
SLICE = 4_000_000
#: The tokenizer's white space (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that are no letters or numbers in any version of Unicode, whatever the pattern library makes of them.
_BEYOND = regex.compile("[\U000323b0-\U0010ffff]")
_NEVER = 1 << 40
#: Marks a word's end here; no byte sign is a line feed.
_END = "\n"


def byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder of a word-level BPE file: NFC, lower case, white space dropped, byte signs, word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", _SPACE))
        self.signs = byte_signs()

        ids = self.vocab
        size = len(self.tokens)
        self.size = size
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[ids[a], ids[b]] = (r, ids[a + b])
        keys = np.fromiter((a * size + b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair = {int(k): r for k, (r, _) in zip(keys.tolist(), self.rank.values(), strict=True)}
        self.merged = {r: t for r, t in self.rank.values()}
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter((r for r, _ in self.rank.values()), np.int64, len(self.rank))[order]

        # How each token is last merged, and which tokens encode to themselves.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.greedy: dict[str, int] = {}
        for text, i in ids.items():
            token = text.removesuffix(self.end) + _END if self.end and text.endswith(self.end) and text != self.end else text
            last: list[tuple[int, int, int]] = []
            if self.merge(self.start(token), last) == [i]:
                self.greedy[token] = i
                if last:
                    self.made[i], self.left[i], self.right[i] = last[-1]
        self.longest: dict[str, int] = {}  # of the tokens that begin with the same two signs
        for token in self.greedy:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 0), len(token))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.met: dict[str, tuple[int, ...]] = {}  # tuples of numbers are no work for the garbage collector
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def forget(self) -> None:
        """With too many words kept, forget all but those met first, among which the common ones are."""
        if len(self.known) > WORDS_KEPT:
            for kept in (self.known, self.met):
                while len(kept) > WORDS_KEPT // 2:
                    kept.popitem()
            self.at = self.at[: len(self.known) + 1]
            self.flat = self.flat[: self.at[-1]]

    def start(self, word: str) -> list[int]:
        """The ids of a word's signs; the last one carries the word end. Signs that the vocabulary lacks are dropped."""
        signs = [*word[:-1]]
        if word[-1:] == _END and signs:
            signs[-1] += self.end
        else:
            signs = [*word]
        return [self.vocab[s] for s in signs if s in self.vocab]

    def merge(self, ids: list[int], last: list[tuple[int, int, int]] | None = None) -> list[int]:
        """Exact merging: again and again the pair of lowest rank, the leftmost of equals."""
        n = len(ids)
        ids, after, before = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(self.rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            if last is not None:
                last.append((r, a, b))
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], x, *p))
        return [x for x in ids if x >= 0]

    def merge_short(self, ids: list[int]) -> list[int]:
        """The same for words of few signs, where looking over all pairs is quicker than a heap."""
        size, get, merged = self.size, self.pair.get, self.merged
        ranks = [get(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != _NEVER:
            i = ranks.index(r)
            t = merged[r]
            ids[i : i + 2] = [t]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + t, _NEVER)
            if i < len(ranks):
                ranks[i] = get(t * size + ids[i + 1], _NEVER)
        return ids

    def exact(self, word: str) -> list[int]:
        ids = self.start(word)
        return self.merge_short(ids) if len(ids) <= 48 else self.merge(ids)

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where no token fits."""
        out, at, n, greedy, longest = [], 0, len(word), self.greedy, self.longest
        while at < n:
            to = min(n, at + longest.get(word[at : at + 2], 1))
            while to > at and (to == n - 1 or word[at:to] not in greedy):
                to -= 1
            if to == at:
                return None
            out.append(greedy[word[at:to]])
            at = to
        return out

    def borders_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of neighbouring tokens: does the border between them outlast all merges?"""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        next_a, next_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            keys = a * self.size + b
            i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[i] == keys, self.pair_ranks[i], _NEVER)
            # Of equal ranks the left one merges first.
            breaks = (r < next_a) & (r <= next_b)
            ok[live[breaks]] = False
            go = ~breaks & ((self.made[a] >= 0) | (self.made[b] >= 0))
            live, a, b, next_a, next_b = live[go], a[go], b[go], next_a[go], next_b[go]
            undo_a = self.made[a] > self.made[b]
            next_a, next_b = np.where(undo_a, self.made[a], next_a), np.where(undo_a, next_b, self.made[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def pieces(self, chunk: bytes) -> list[str | int]:
        """A chunk without ASCII white space as words in byte signs, and ids of special tokens."""
        out: list[str | int] = []
        if chunk.isalpha():  # ASCII letters, as most are
            return [chunk.decode().lower() + _END]
        if chunk[-1:] in (b".", b",") and chunk[:-1].isalpha():
            return [chunk[:-1].decode().lower() + _END, chunk[-1:].decode() + _END]
        text = chunk.decode("utf-8")
        if text.isascii() and text.isprintable() and "<" not in text:  # such signs stand for themselves
            return [w + _END for w in self.words.findall(text.lower())]
        for part in self.split_special.split(text) if self.split_special and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # sign by sign: no final sigma
            seen = _BEYOND.sub("\ue000", part)
            out += ["".join([self.signs[x] for x in part[m.start() : m.end()].encode()]) + _END for m in self.words.finditer(seen)]
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that are new, all borders of their proposals at once."""
        split = [self.pieces(c) for c in chunks]
        words = list({w for p in split for w in p if isinstance(w, str) and w not in self.met})
        tried = [self.propose(w) for w in words]
        a = np.array([x for t in tried if t for x in t[:-1]], np.int64)
        b = np.array([x for t in tried if t for x in t[1:]], np.int64)
        good = self.borders_hold(a, b)
        ends = np.cumsum([0, *(len(t) - 1 if t else 0 for t in tried)])
        bad = np.concatenate([[0], np.cumsum(~good)])
        fails = bad[ends[1:]] - bad[ends[:-1]] > 0
        self.met.update((w, tuple(self.exact(w) if t is None or f else t)) for w, t, f in zip(words, tried, fails, strict=True))
        ids = [[x for w in p for x in ([w] if isinstance(w, int) else self.met[w])] for p in split]
        first = len(self.at) - 1
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
        self.flat = np.concatenate([self.flat, np.array([y for x in ids for y in x], np.int32)])

    def encode(self, texts: list[bytes | None]) -> pa.ListArray:
        """The ids of each text; a null text is empty. Texts are taken together up to SLICE bytes."""
        ids, counts, i = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= SLICE):
                size += len(texts[j] or b"")
                j += 1
            split = [t.split() if t else [] for t in texts[i:j]]
            i = j
            self.forget()
            if new := [c for c in set().union(*split) if c not in self.known]:
                self.learn(new)
            k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
            lo = self.at[k]
            n = self.at[k + 1] - lo
            upto = np.concatenate([[0], np.cumsum(n)])
            ids.append(self.flat[np.arange(upto[-1]) + np.repeat(lo - upto[:-1], n)])
            counts.append(np.diff(upto[np.cumsum([0, *map(len, split)])]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(ids)))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def joined(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list of ids, joined by a space: what the file's own decoder gives, special tokens too."""
    return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), pc.take(tokens, ids.flatten())), " ")


def decode(ids: Column, path: str) -> Column:
    """The text of ids; null ids are an empty text."""

    @arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        x = pa.array([y or [] for y in x.to_pylist()], pa.list_(pa.int32())) if x.null_count else x
        return joined(x, pa.array(tokenizer(path).tokens, pa.string()))

    return run(ids)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) and ``decoded`` (string).

    All columns are handed on, but ones of these two names are replaced. A null text counts as empty:
    no ids and an empty string. Repeated rows are each encoded; an empty table gives no rows. The path
    has to be readable on every executor."""
    names = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    source, at = docs.select(*names), names.index(text_col)
    new = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        tokens = pa.array(coder.tokens, pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_OUT):
                b = whole.slice(lo, ROWS_OUT)
                ids = coder.encode(b.column(at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, ids, joined(ids, tokens)], [*names, "token_ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *new]))
