"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has ``HASHES`` symbols of 16 bits, one from each minimum over its shingles. The
radius is the number of unequal symbols that a pair at the threshold exceeds with a probability of at most
``loss``. A signature is split into chunks, so many that two signatures within the radius have, by the
pigeonhole principle, a chunk with no more than ``errors`` unequal symbols. Each chunk is filed under every
key that leaves ``errors`` of its symbols out, so each pair within the radius meets under a key.

A key's documents are not paired with each other. The document that shares most keys with most others is
the key's hub; each document is first compared with its best hub, on signatures and then on full sets, and
the links found make components. Where all of a key's documents are in one component nothing is left to
find. The documents of the other keys meet, hub by hub, in tiles of two blocks of bounded size: first their
signatures, which tell the documents with a partner within the radius in another component, then the full
sets of these alone, as differences from what most of the tile shares. A tile returns no more than a forest
of links. No pair that could join two components is left out, whatever the size of a key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, id_type, wanted

HASHES = 96
#: Symbols of a chunk that may differ.
ERRORS = 1
#: A pair at the threshold lies beyond the radius with this probability at most.
LOSS = 1e-8
#: Signatures and shingles of a block; a tile has two blocks.
SIGNATURES, SHINGLES = 4096, 1_000_000

_rng = np.random.default_rng(20240601)
_MULT = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ROW = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def radius_for(percent: int, loss: float = LOSS) -> int:
    """The least radius that a pair of just this similarity exceeds with a probability of ``loss`` at most."""
    differs, beyond = 1 - percent / 100, 0.0
    for r in range(HASHES, 0, -1):
        beyond += math.comb(HASHES, r) * differs**r * (1 - differs) ** (HASHES - r)
        if beyond > loss:
            return r
    return 0


def chunk_symbols(radius: int, errors: int) -> list[list[int]]:
    """The symbols of each chunk: radius // (errors + 1) + 1 chunks, as equal in size as can be."""
    chunks = radius // (errors + 1) + 1
    cuts = [HASHES * i // chunks for i in range(chunks + 1)]
    return [list(range(a, b)) for a, b in itertools.pairwise(cuts)]


def chunk_keys(radius: int, errors: int) -> Column:
    """The keys of a signature: each chunk with each choice of ``errors`` symbols left out."""
    keys = []
    for c, symbols in enumerate(chunk_symbols(radius, errors)):
        for left_out in itertools.combinations(symbols, min(errors, len(symbols))):
            kept = [F.substring("sig", 2 * i + 1, 2) for i in symbols if i not in left_out]
            keys.append(F.xxhash64(F.lit(c), F.lit(",".join(map(str, left_out))), *kept))
    return F.array(*keys)


def shingles(text: bytes | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text; known: hashes of words met before."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(ids) - size + 1)
    h = np.full(n, min(len(ids), size), np.uint64)
    for k in range(min(size, len(ids))):
        h = (h ^ ids[k : n + k]) * _ROW
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """The symbols: 16 bits of each smallest permuted shingle. Long sets are taken in pieces."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, ((s[None, i : i + 4096] ^ _XOR[:, None]) * _MULT[:, None]).min(axis=1))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _each(size: int, make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                if len(known) > 300_000:
                    known.clear()
                yield make(b, [shingles(t, size, known) for t in b.column(1).cast(pa.binary()).to_pylist()])

    return run


def _signed(b: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    sig = [signature(s).tobytes() if len(s) else None for s in sets]
    cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["id", "n", "set_key", "sig"])


def _as_sets(b: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def unequal_symbols(a: str, b: str) -> Column:
    parts = " + ".join(f"if(substring({a}, {2 * i + 1}, 2) = substring({b}, {2 * i + 1}, 2), 0, 1)" for i in range(HASHES))
    return F.expr(parts)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, s: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    kind = id_type(docs, "id")
    ids = s.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = s.table(docs.join(wanted(ids), "id", "left_semi").select("id", "text").mapInArrow(_each(size, _as_sets), f"id {kind}, shingles binary"))
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("q")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("p")), "a")
    links = s.table(both.select("a", "b", "p", "q").mapInArrow(_linked(percent), f"a {kind}, b {kind}").distinct())
    s.drop(ids, sets)
    return links


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """(id, component) for every id of the edges (a, b): the smallest id that can be reached.

    Large-star and small-star rounds until nothing changes; each is two joins on the edges."""

    def hashed(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    e = s.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = hashed(e)
    while before[0]:
        two_way = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two_way.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = two_way.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = s.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        s.drop(e)
        e, after = now, hashed(now)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def in_tiles(rows: DataFrame, weight: str, room: int, make: Callable, schema: str) -> DataFrame:
    """make(ids, components, sizes, payloads) for every two blocks of each hub's rows (hub, id, c, n, payload).

    A block holds rows of about ``room`` in all by ``weight``. A worker holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def tile() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, comps, sizes = (t.column(c) for c in ("id", "c", "n"))
            _, colour = np.unique(np.array(comps.to_pylist()), return_inverse=True)
            return make(ids, colour, sizes.to_numpy(), t.column("payload"))

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("hub", "lo", "hi")), strict=True))
            start = 0
            for i, k in enumerate(keys):
                if k != key:
                    if start < i:
                        held.append(b.slice(start, i - start))
                    if held:
                        yield tile()
                    held, key, start = [], k, i
            held.append(b.slice(start))
        if held:
            yield tile()

    of = rows.groupBy("hub").agg(F.ceil(F.sum(F.expr(weight)) / room).cast("int").alias("of"))
    blocks = rows.join(of, "hub").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    # A block meets each other block; an only block meets itself.
    other = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least(F.col("mine"), k).alias("lo"), F.greatest(F.col("mine"), k).alias("hi")))
    met = F.when(F.col("of") > 1, F.filter(other, lambda t: t["lo"] < t["hi"])).otherwise(other)
    tiles = blocks.withColumn("t", F.explode(met)).select("hub", "t.lo", "t.hi", "id", "c", "n", "payload")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, "hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi").mapInArrow(run, schema)


def main_colour(colour: np.ndarray) -> int:
    return int(np.bincount(colour).argmax())


def near_signatures(percent: int, radius: int) -> Callable:
    """Over a tile of signatures: the ids that have a partner of another component within the radius."""

    def make(ids: pa.ChunkedArray, colour: np.ndarray, sizes: np.ndarray, payload: pa.ChunkedArray) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(payload.to_pylist()), np.uint16).reshape(-1, HASHES)
        active = np.zeros(len(sig), bool)
        for i in np.flatnonzero(colour != main_colour(colour)).tolist():
            alike = (colour != colour[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            other = np.flatnonzero(alike)
            near = other[(sig[other] != sig[i]).sum(axis=1) <= radius]
            active[near] = True
            active[i] |= len(near) > 0
        return pa.RecordBatch.from_arrays([ids.combine_chunks().filter(pa.array(active))], ["id"])

    return make


class Postings:
    """Lists of rows by column, of (row, column) pairs in the order of rows."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int) -> None:
        self.n, self.cols = n_rows, cols
        self.row_at = np.searchsorted(rows, np.arange(n_rows + 1))
        self.rows = rows[np.argsort(cols, kind="stable")]
        self.col_at = np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=n_cols))])

    def common(self, row: int) -> np.ndarray:
        """How many columns each row shares with this one."""
        mine = self.cols[self.row_at[row] : self.row_at[row + 1]]
        at, count = self.col_at[mine], self.col_at[mine + 1] - self.col_at[mine]
        places = np.repeat(at - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return np.bincount(self.rows[places], minlength=self.n)


def shared_counts(sets: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """A function that gives, for a set's number, how many shingles it shares with each set.

    Shingles that most sets have are counted by the sets that lack them."""
    m, lens = len(sets), np.array([len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), lens)
    most = 2 * times > m
    base = np.cumsum(most) - 1
    has = np.zeros((m, int(most.sum())), bool)
    common = most[col]
    has[row[common], base[col[common]]] = True
    lack_row, lack_col = np.nonzero(~has)
    lacking = Postings(lack_row, lack_col, m, has.shape[1])
    lacks = np.bincount(lack_row, minlength=m)
    rest = ~common & (times[col] > 1)  # a shingle of one set is shared by none
    having = Postings(row[rest], col[rest], m, len(times))
    return lambda i: has.shape[1] - lacks[i] - lacks + lacking.common(i) + having.common(i)


def set_links(percent: int, kind: pa.DataType) -> Callable:
    """Over a tile of full sets: links that join components, no more than a forest of them."""

    def make(ids: pa.ChunkedArray, colour: np.ndarray, sizes: np.ndarray, payload: pa.ChunkedArray) -> pa.RecordBatch:
        links: list[tuple[int, int]] = []
        root = list(range(int(colour.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if len(root) > 1:
            counts = shared_counts([np.frombuffer(x.as_buffer(), np.uint64) for x in payload])
            parts = len(root)
            for i in np.flatnonzero(colour != main_colour(colour)).tolist():
                if parts == 1:
                    break
                both = counts(i)
                close = (100 * both >= percent * (sizes + sizes[i] - both)) & (colour != colour[i])
                for c, j in zip(*(x.tolist() for x in np.unique(np.where(close, colour, -1), return_index=True)), strict=True):
                    if c >= 0 and find(c) != find(int(colour[i])):
                        root[find(c)] = find(int(colour[i]))
                        links.append((i, j))
                        parts -= 1
        named = ids.to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([named[i] for i, _ in links], kind), pa.array([named[j] for _, j in links], kind)], ["a", "b"])

    return make


def border_links(rows: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, radius: int, s: Scratch) -> DataFrame:
    """Links (a, b) that join components within each hub's rows (hub, id, c)."""
    kind, arrow = id_type(docs, "id"), pa.int64()
    rows = s.table(rows)
    signed = rows.join(reps.select("id", "n", F.col("sig").alias("payload")), "id")
    active = s.table(in_tiles(signed, "1", SIGNATURES, near_signatures(percent, radius), f"id {kind}").distinct())
    sets = docs.join(wanted(active), "id", "left_semi").select("id", "text").mapInArrow(_each(size, _as_sets), f"id {kind}, shingles binary")
    sets = s.table(sets.select("id", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.col("shingles").alias("payload")))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    found = in_tiles(rows.join(sets, "id"), "n", SHINGLES, set_links(percent, arrow), f"a {kind}, b {kind}")
    links = s.table(found.distinct())
    s.drop(rows, active, sets)
    return links


def same_documents(known: DataFrame, reps: DataFrame, s: Scratch) -> DataFrame:
    """Links (a, b) between the first ids of the different texts that one id has, all to the least of them."""
    several = s.table(known.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("id"))
    first = known.join(wanted(several), "id", "left_semi").select("id", "set_key").distinct().join(reps.select("set_key", F.col("id").alias("a")), "set_key")
    first = s.table(first.select("id", "a"))
    return first.join(first.groupBy("id").agg(F.min("a").alias("b")), "id").filter("a <> b").select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 85,
    errors: int = ERRORS,
    loss: float = LOSS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept: its id is its component's smallest.

    Ids are whole numbers or strings, ordered as Spark orders them. Words are lower-cased A-Z; fewer words than
    a shingle are one shingle. Texts that are null or have no words are linked with nothing. Rows of equal id are
    one document, linked with whatever one of its texts is; a row with a null id has a null component and is kept. An empty table gives no rows; other
    columns are not looked at. The radius follows from ``percent`` and ``loss``."""
    kind, radius = id_type(docs, id_col), radius_for(percent, loss)
    if kind in ("smallint", "tinyint"):
        docs, kind = docs.withColumn(id_col, F.col(id_col).cast("int")), "int"
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "near") as s:
        signed = s.table(base.mapInArrow(_each(shingle, _signed), f"id {kind}, n long, set_key binary, sig binary"))
        known = signed.filter("set_key is not null and id is not null")
        reps = s.table(known.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))

        filed = reps.select("id", F.explode(chunk_keys(radius, errors)).alias("key"))
        held = filed.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
        shared = s.table(filed.join(held, "key"))
        weights = shared.groupBy("id").agg(F.sum("held").alias("weight"))
        weighted = s.table(shared.join(weights, "id").select("key", "id", "weight"))
        s.drop(shared)
        hubs = weighted.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("hub"))
        placed = s.table(weighted.join(hubs, "key").select("key", "id", F.col("hub.id").alias("hub"), F.col("hub.weight").alias("weight")))
        s.drop(weighted)

        best = placed.filter("id <> hub").groupBy("id").agg(F.max(F.struct("weight", "hub")).alias("best"))
        pairs = best.select(F.col("best.hub").alias("a"), F.col("id").alias("b"))
        one, two = (reps.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
        near_size = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        close = s.table(pairs.join(two, "b").join(one, "a").filter(near_size).filter(unequal_symbols("sig_a", "sig_b") <= radius).select("a", "b").distinct())
        links = confirmed(close, base, shingle, percent, s).unionByName(same_documents(known, reps, s))
        found = components(links, s)

        coloured = s.table(placed.join(found.withColumnRenamed("component", "c"), "id", "left").select("key", "id", "hub", F.coalesce("c", "id").alias("c")))
        s.drop(placed)
        split = coloured.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
        border = coloured.join(split, "key").select("hub", "id", "c").distinct()
        more = border_links(border, reps, base, shingle, percent, radius, s)
        s.drop(coloured)
        if more.head(1):
            found = components(links.unionByName(more), s)

        named = reps.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("c"))
        judged = signed.select("id", "n", "set_key").join(named, "set_key", "left")
        # A row without words belongs where its id's other rows are.
        wordless = signed.filter("set_key is null and id is not null").select("id").distinct()
        elsewhere = known.join(wanted(wordless), "id", "left_semi").join(named, "set_key").groupBy("id").agg(F.min("c").alias("other"))
        judged = judged.join(wanted(s.table(elsewhere)), "id", "left").withColumn("c", F.coalesce("c", "other"))
        component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
        kept = F.coalesce(component == F.col("id"), F.lit(True))
        return cut(judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept")))
