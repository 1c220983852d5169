"""SentencePiece encoding and decoding that keeps source offsets.

A text is normalised by the longest prefixes that the model's compiled character map (a double array trie) knows;
every byte of the normalised text records the source byte it comes from, so each piece has a span of source bytes.
The trie is walked from all positions of a text at once. Merging goes by piece scores, best first and leftmost of
equals, within chunks over whose borders no piece reaches; a task keeps the encodings of the chunks it has met, up to
``CHUNKS_KEPT`` of them. Signs without a piece fall back to bytes.

Inside, the sign for white space (U+2581) is a blank, which no piece holds otherwise.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

CHUNKS_KEPT = 300_000
#: Rows of a batch that goes back to Spark: ids and spans are several times as large as the text.
ROWS_OUT = 250
#: Bytes of texts that are cut into chunks at a time; a longer text is a slice of its own.
SLICE = 4_000_000
#: Chunks of more signs are merged one by one, with a heap; under _WIDE.
LONG = 48
_BLANK = "▁"
_NEVER = 1 << 40
_WIDE = 64

# Fixed values of the model file's format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and value as a number or bytes."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class CharMap:
    """A compiled character map: sequences of bytes and what each becomes, in a double array trie."""

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.becomes = np.frombuffer(blob, np.uint8, offset=4 + size)
        ends = np.flatnonzero(self.becomes == 0)
        self.length = np.zeros(len(self.becomes) + 1, np.int64)  # of the string that begins at each place
        self.length[: len(self.becomes)] = ends[np.searchsorted(ends, np.arange(len(self.becomes)))] - np.arange(len(self.becomes))

    def _below(self, unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of ``text`` the length of the longest entry that begins there (0: none), and the place of what it becomes."""
        length, value = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        live = np.arange(len(text))
        node = np.full(len(text), self._below(self.units[:1])[0])
        depth = 0
        while len(live):
            byte = text[live + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            on = (node < len(self.units)) & ((unit & (1 << 31 | 255)) == byte)
            live, node, unit = live[on], node[on], unit[on]
            node = node ^ self._below(unit)
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]] = depth + 1
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
            depth += 1
            on = live + depth < len(text)
            live, node = live[on], node[on]
        return length, value


def _slot(key: np.ndarray, room: int) -> np.ndarray:
    return ((key ^ (key >> 21)) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) % room


class PieceModel:
    """Coder of a SentencePiece model file of merges with byte fallback; other kinds of models raise a ValueError."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            fields = [*message(f.read())]
        trainer, norm = (dict(chain.from_iterable(message(v) for k, v in fields if k == n)) for n in (2, 3))
        self.prefix, self.squeeze, blob = bool(norm.get(3, 1)), bool(norm.get(4, 1)), norm.get(2, b"")
        self.map = CharMap(blob) if blob else None
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for _, v in (x for x in fields if x[0] == 1):
            piece = dict(message(v))
            self.pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            self.kinds.append(piece.get(3, NORMAL))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not norm.get(5, 1) or {USER_DEFINED, UNUSED} & {*self.kinds}:
            raise ValueError(f"{path}: only models of merges with byte fallback and without pieces of the user's own are read")

        place = {s: r for r, s in enumerate(sorted({*scores}, reverse=True))}
        normal = [(i, p.replace(_BLANK, " ")) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL]
        self.ids = {p: i for i, p in normal}
        self.rank = {p: place[scores[i]] for i, p in normal}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        named = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == CONTROL}
        self.begin, self.end = (named[trainer.get(n, d).decode()] for n, d in ((46, b"<s>"), (47, b"</s>")))

        # Symbols of merging: pieces by their ids, then every other sign. The pairs that make a piece are kept by open addressing.
        self.symbols = len(self.pieces) + 0x110000
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + len(self.pieces)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.piece_width = np.array([len(p.replace(_BLANK, " ").encode()) for p in self.pieces])
        pairs = [(a * self.symbols + b, self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := self.symbol(p[:k])) is not None and (b := self.symbol(p[k:])) is not None]
        key, rank, made = np.array(pairs, np.int64).reshape(-1, 3).T
        room = 4 * len(pairs) + 1
        self.slots, self.slot_rank, self.slot_made = np.full(room, -1, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
        slot, todo = _slot(key, room), np.arange(len(key))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            took = free[first]
            for table, value in ((self.slots, key), (self.slot_rank, rank), (self.slot_made, made)):
                table[slot[took]] = value[took]
            todo = np.setdiff1d(todo, took, assume_unique=True)
            slot[todo] = (slot[todo] + 1) % room

        # Chunks: a blank after another sign is a border if no piece holds the two, as is any side of a sign that no piece holds.
        held = set().union(*self.ids)
        lone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in held)
        if any(" " in p.lstrip(" ") for p in self.ids):
            lone, self.chunks = "", re.compile(rb"(?s).+")
        else:
            none = lone.encode("latin-1")
            self.chunks = re.compile(rb" +[^ %b]*|[^ %b]+" % (none, none) + (rb"|[%b]" % none if lone else b""))

        unknown = trainer.get(44, " ⁇ ".encode())
        seen = [p.replace(_BLANK, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else unknown if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.seen_at = np.cumsum([0, *map(len, seen)])
        self.seen = np.frombuffer(b"".join(seen), np.uint8)
        self.silent = np.array(self.kinds) == CONTROL
        self.blank_first = np.array([k == NORMAL and s[:1] == b" " for s, k in zip(seen, self.kinds, strict=True)])
        self.is_byte = np.array(self.kinds) == BYTE
        self.clear()

    def symbol(self, piece: str) -> int | None:
        return self.ids.get(piece, int(self.symbol_of[ord(piece)]) if len(piece) == 1 else None)

    # Normalising

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The normalised text and, for each of its bytes and its end, the place in the source; None where that is its
        own place less the blank put before it. Bytes that are no UTF-8 become U+FFFD one by one."""
        if not text:
            return b"", np.zeros(1, np.int64)
        try:
            text.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        if good and self.map is None and not self.squeeze and _BLANK.encode() not in text:
            return (b" " + text, None) if self.prefix else (text, np.arange(len(text) + 1))
        signs = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
        bad = (signs >= 0xDC80) & (signs <= 0xDCFF)
        size = np.where(bad, 1, 1 + (signs > 0x7F) + (signs > 0x7FF) + (signs > 0xFFFF)).astype(np.int64)
        start = np.cumsum(size) - size
        raw = np.frombuffer(text, np.uint8)
        extra = np.frombuffer("� ".encode(), np.uint8)
        parts = [raw, extra] if self.map is None else [raw, extra, self.map.becomes]
        source, own = np.concatenate(parts), len(raw)
        take, n = np.where(bad, own, start), np.where(bad, 3, size)
        keep = np.ones(len(start), bool)
        if self.map is not None:
            length, value = self.map.longest(raw)
            known = length[start] > 0
            take = np.where(known, own + len(extra) + value[start], take)
            n = np.where(known, self.map.length[value[start]], n)
            # An entry of several signs takes those after its first, unless it begins inside an earlier one.
            upto, end = 0, start + size
            for i in np.flatnonzero(length[start] > size):
                if start[i] >= upto:
                    upto = start[i] + length[start[i]]
                    end[i] = upto
            reach = np.maximum.accumulate(np.concatenate([[0], end]))[:-1]
            keep = start >= reach
        take, n, start = take[keep], n[keep], start[keep]
        upto = np.cumsum(n)
        out = source[np.repeat(take - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        at = np.repeat(start, n)
        out, at = self._blanks(out, at, len(text))
        return out.tobytes(), at

    def _blanks(self, out: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """U+2581 as a blank, extra blanks taken out, a blank put first."""
        b = _BLANK.encode()
        if b in (flat := out.tobytes()):
            first = np.array([m.start() for m in re.finditer(b, flat)])
            out = out.copy()
            out[first] = 32
            keep = np.ones(len(out), bool)
            keep[first + 1] = keep[first + 2] = False
            # U+2581 of the source is no blank to the rule of extra blanks.
            literal = np.zeros(len(out), bool)
            literal[first] = True
            out, at, literal = out[keep], at[keep], literal[keep]
        else:
            literal = np.zeros(len(out), bool)
        last, head = size, 0
        if self.squeeze:
            blank = (out == 32) & ~literal
            if blank.all():
                return out[:0], np.full(1, size)
            head = at[np.flatnonzero(~blank)[0]]
            # A blank goes that follows one, but within what one entry becomes only those at its front.
            gone = blank & np.concatenate([[True], blank[:-1]])
            for i in np.flatnonzero(gone[1:] & (at[1:] == at[:-1])) + 1:
                gone[i] = gone[i - 1]
            out, at = out[~gone], at[~gone]
        if self.prefix:
            out, at = np.concatenate([[np.uint8(32)], out]), np.concatenate([[head], at])
        if self.squeeze and len(out) and out[-1] == 32:
            n = len(out.tobytes().rstrip(b" "))
            last = at[n]
            out, at = out[:n], at[:n]
        return out, np.concatenate([at, [last]])

    # Merging

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.width, self.at = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, signs: list[str]) -> list[str]:
        """Again and again the pair whose piece has the best score, the leftmost of equals."""
        get, n = self.rank.get, len(signs)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(signs, signs[1:])) if (r := get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if signs[i] != a or j >= n or signs[j] != b:
                continue
            signs[i], signs[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(signs[x] + signs[y])) is not None:
                    heapq.heappush(heap, (r, x, signs[x], signs[y]))
        return [s for s in signs if s]

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of the piece that each two symbols make; where they make none the rank is _NEVER."""
        key = a * self.symbols + b
        slot = _slot(key, len(self.slots))
        met = self.slots[slot]
        while len(miss := np.flatnonzero((met != key) & (met >= 0))):
            slot[miss] = (slot[miss] + 1) % len(self.slots)
            met[miss] = self.slots[slot[miss]]
        return np.where(met == key, self.slot_rank[slot], _NEVER), self.slot_made[slot]

    def merge_all(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many words at once: given their symbols one after another and the number of each, what is left of
        both. A round merges one pair of every word that still has one. Words have LONG symbols at most."""
        size, out, stays, place = size.copy(), sym.copy(), np.ones(len(sym), bool), np.arange(len(sym))
        live, word = np.arange(len(size)), np.repeat(np.arange(len(size)), size)
        rank, made = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
        two = np.flatnonzero(word[1:] == word[:-1])
        rank[two], made[two] = self.pair(sym[two], sym[two + 1])
        while len(live):
            n = size[live]
            first = np.cumsum(n) - n
            best = np.minimum.reduceat(rank * _WIDE + (np.arange(len(rank)) - np.repeat(first, n)), first)
            go = best < _NEVER * _WIDE
            i = (first + best % _WIDE)[go]
            sym[i] = made[i]
            out[place[i]], stays[place[i + 1]] = made[i], False
            on = np.repeat(go, n)  # words that are done leave, and so do the right halves of pairs
            on[i + 1] = False
            i = np.cumsum(on)[i] - 1
            sym, rank, made, place = sym[on], rank[on], made[on], place[on]
            live = live[go]
            size[live] -= 1
            ends = np.cumsum(size[live])
            rank[i] = _NEVER
            x = np.concatenate([i[i > ends - size[live]] - 1, i[i < ends - 1]])
            rank[x], made[x] = self.pair(sym[x], sym[x + 1])
        return out[stays], size

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that are new, all short ones at once."""
        text = [(c.decode(), c) for c in chunks]
        short, long = [x for x in text if len(x[0]) <= LONG], [x for x in text if len(x[0]) > LONG]
        signs = np.frombuffer("".join(t for t, _ in short).encode("utf-32-le"), "<u4")
        sym, left = self.merge_all(self.symbol_of[signs].astype(np.int64), np.array([len(t) for t, _ in short], np.int64))
        apart = [[self.symbol(p) for p in self.merge([*t])] for t, _ in long]
        sym = np.concatenate([sym, np.array([*chain.from_iterable(apart)], np.int64)])
        left = np.concatenate([left, np.array([*map(len, apart)], np.int64)])
        # A piece is one id; another sign is its bytes, of which the last has the span.
        others = np.unique(sym[sym >= len(self.pieces)])
        raw = [chr(c).encode() for c in others - len(self.pieces)]
        ids = np.concatenate([np.arange(len(self.pieces)), np.array([self.byte_ids[x] for r in raw for x in (r if r != b" " else _BLANK.encode())], np.int64)])
        width = np.concatenate([self.piece_width, np.array([w for r in raw for w in ([0] * (len(r) - 1) + [len(r)] if r != b" " else [0, 0, 1])], np.int64)])
        count = np.concatenate([np.ones(len(self.pieces), np.int64), np.array([len(r) if r != b" " else 3 for r in raw], np.int64)])
        at = np.cumsum(count) - count
        sym = np.where(sym >= len(self.pieces), len(self.pieces) + np.searchsorted(others, sym), sym)
        upto = np.concatenate([[0], np.cumsum(count[sym])])
        gather = np.arange(upto[-1]) + np.repeat(at[sym] - upto[:-1], count[sym])
        first = len(self.at) - 1
        self.known.update(zip((c for _, c in [*short, *long]), range(first, first + len(chunks)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + upto[np.cumsum(left)]])
        self.flat = np.concatenate([self.flat, ids[gather].astype(np.int32)])
        self.width = np.concatenate([self.width, width[gather].astype(np.int32)])

    def encode(self, texts: list[bytes | None]) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
        """Ids, starts and ends of their source spans for each text; texts are taken together up to SLICE bytes."""
        found, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= SLICE):
                size += len(texts[j] or b"")
                j += 1
            found.append(self._encode([t or b"" for t in texts[i:j]]))
            i = j
        count, ids, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 4
        offsets = pa.array(np.cumsum(np.concatenate([[0], count])), pa.int32())
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, starts, ends))

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        norms = [self.normalise(t) for t in texts]
        split = [self.chunks.findall(n) for n, _ in norms]
        if len(self.known) > CHUNKS_KEPT:
            self.clear()
        if new := [c for c in set().union(*split) if c not in self.known]:
            self.learn(new)
        k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        lo = self.at[k]
        n = self.at[k + 1] - lo
        upto = np.concatenate([[0], np.cumsum(n)])
        gather = np.arange(upto[-1]) + np.repeat(lo - upto[:-1], n)
        inner, ends = self.flat[gather], np.cumsum(self.width[gather], dtype=np.int64)
        starts = ends - self.width[gather]
        border = upto[np.cumsum([0, *map(len, split)])]  # of the texts' pieces
        base = np.cumsum([0, *(len(x) for x, _ in norms)])
        count = np.diff(border)
        row = np.repeat(np.arange(len(texts)), count)
        starts, ends = starts - base[row], ends - base[row]
        plain = np.array([a is None for _, a in norms])[row]
        starts, ends = np.where(plain, np.maximum(starts - 1, 0), starts), np.where(plain, np.maximum(ends - 1, 0), ends)
        for t, (_, at) in enumerate(norms):
            if at is not None and count[t]:
                s = slice(border[t], border[t + 1])
                starts[s], ends[s] = at[starts[s]], at[ends[s]]
        # The ids of begin and end stand around each text's.
        first = np.arange(len(texts)) * 2 + border[:-1]
        last = first + count + 1
        whole = len(inner) + 2 * len(texts)
        mid = np.arange(len(inner)) + 2 * row + 1
        out = [np.zeros(whole, np.int32) for _ in range(3)]
        for x, y in zip(out, (inner, starts, ends), strict=True):
            x[mid] = y
        out[0][first], out[0][last] = self.begin, self.end
        out[1][last] = out[2][last] = [len(t) for t in texts]
        return count + 2, *out

    # Decoding

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids. Ids of control are silent; bytes that make no UTF-8 become U+FFFD one by one."""
        at = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy()[at[0] : at[-1]].astype(np.int64)
        at = at - at[0]
        lo, n = self.seen_at[flat], self.seen_at[flat + 1] - self.seen_at[flat]
        if self.prefix or self.squeeze:  # the blank at the front of the first piece that is heard is left out
            heard = np.append(np.flatnonzero(~self.silent[flat]), len(flat))
            lo, n, place, end = lo.copy(), n.copy(), np.searchsorted(heard, at[:-1]), at[1:]
            while len(place):
                on = (heard[place] < end) & self.blank_first[flat[np.minimum(heard[place], len(flat) - 1)]] if len(flat) else np.zeros(len(place), bool)
                first, place, end = heard[place[on]], place[on], end[on]
                lo[first] += 1
                n[first] -= 1
                # Where extra blanks were taken out before, pieces that are but a blank don't end the search.
                on = (n[first] == 0) & self.squeeze
                place, end = place[on] + 1, end[on]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = self.seen[np.arange(upto[-1]) + np.repeat(lo - upto[:-1], n)]
        ends = upto[at]
        starts = ends[:-1][ends[:-1] < ends[1:]]
        flat_out = out.tobytes()
        # Ids of control between bytes part them.
        parting = np.flatnonzero(self.silent[flat[1:]] & self.is_byte[flat[:-1]]) + 1
        parting = parting[~np.isin(parting, at - 1)]
        try:
            flat_out.decode()
            good = not len(parting) and not np.any((out[starts] & 0xC0) == 0x80)
        except UnicodeDecodeError:
            good = False
        if not good:
            cuts = np.concatenate([[0], upto[parting], [len(flat_out)], ends])
            cuts = np.unique(cuts)
            runs = [flat_out[a:b].decode("utf-8", "surrogateescape") for a, b in zip(cuts, cuts[1:])]
            runs = [re.sub("[\udc80-\udcff]", "\ufffd", r) for r in runs]
            row = np.searchsorted(cuts, ends)
            return pa.array(["".join(runs[a:b]) for a, b in zip(row, row[1:])], pa.string())
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat_out))


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _no_nulls(x: pa.Array) -> pa.Array:
    return pa.array([y or [] for y in x.to_pylist()], pa.list_(pa.int32())) if x.null_count else x


def decode(ids: Column, path: str) -> Column:
    """The text of ids; null ids are an empty text."""

    @arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return model(path).decode(_no_nulls(x))

    return run(ids)


def packed(ids: Column) -> Column:
    """Ids as little-endian 32-bit numbers one after another; null ids are none."""

    @arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        x = _no_nulls(x)
        at = x.offsets.to_numpy()
        values = x.values.to_numpy()[at[0] : at[-1]].astype("<u4")
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((at - at[0]).astype(np.int32) * 4), pa.py_buffer(values.tobytes())])

    return run(ids)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``starts`` and ``ends`` (array<int>: for each id its source bytes, the end not among
    them) and ``decoded`` (string), with the ids of begin and end around each text's.

    Of a sign that falls back to bytes the last byte has the span; begin and end have empty ones. All columns are handed
    on, but ones of these four names are replaced. A null text counts as empty: the two ids of begin and end, an empty
    string. Repeated rows are each encoded; an empty table gives no rows. The path has to be readable on every executor."""
    new = ["token_ids", "starts", "ends", "decoded"]
    names = [c for c in docs.columns if c not in new]
    source, at = docs.select(*names), names.index(text_col)
    kinds = [T.ArrayType(T.IntegerType())] * 3 + [T.StringType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_OUT):
                b = whole.slice(lo, ROWS_OUT)
                ids, starts, ends = coder.encode(b.column(at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, ids, starts, ends, coder.decode(ids)], [*names, *new])
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]))
