"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints are the bit-wise majority of the XXH64 values of a text's word
shingles.  Two fingerprints link when at most `bits` of 64 bits differ.  Links
are searched among distinct fingerprints: the 64 bits are cut into blocks of
which linked fingerprints agree on all but `bits`, and each bucket of equal
blocks gets a hierarchical index: its fingerprints are sorted
by Gray rank, runs of FANOUT of them are factored into nodes that keep the
bits all members share, and so on upwards.  A pair of nodes is pruned as a
whole when the shared bits already differ too much, taken as a whole when even
the bits that are not shared can't exceed the bound, and skipped when all its
members are in one component already.

Buckets of any size are split by range of the Gray rank into tiles; tile pairs
that their shared bits don't prune are compared in tasks of their own.  Every
bucket gives real links that make a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import components, join_counted, kind_of, materialise

FANOUT = 16
#: Fingerprints of a bucket that one task compares at most.
TILE = 1 << 15
_CHUNK = 1 << 18


#: For each value of a byte its bits, each in a byte of its own.
_LANES = np.array([sum((v >> k & 1) << 8 * k for k in range(8)) for v in range(256)], np.uint64)
#: Shingles whose bits are summed in lanes of one byte.
_RUN = 255


def shingles(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word shingle (fewer words than a shingle: of all of them),
    and how many each text has."""
    w = kernel.Words(texts, lower=True)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end + 1] -= 1  # one blank goes with each word
    inside = np.cumsum(inside[:-1]) > 0
    place = np.cumsum(inside) - 1
    flat = np.where(kernel._SPACE[w.buf], np.uint8(32), w.buf)[inside]
    start, end = place[w.start], place[w.end]
    span = np.minimum(w.count, shingle)
    number = np.where(w.count > 0, w.count - span + 1, 0)
    first = np.repeat(w.at[:-1] - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
    return kernel.xxh64(flat, start[first], end[first + np.repeat(span, number) - 1], seed), number


def fingerprints(texts: list[bytes], shingle: int = 4, seed: int = 42, rounds: int = 1) -> np.ndarray:
    """64-bit fingerprints, texts x rounds; no word: 0; fewer words than a
    shingle: the whole sequence is the one shingle.  Rounds after the first hash
    the shingles' hashes anew."""
    return majorities(*shingles(texts, shingle, seed), rounds)


def majorities(h: np.ndarray, number: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Bit-wise majority of each text's hashes.  Eight bits at a time are summed
    as the bytes of one integer, over runs too short for a byte to overflow."""
    out = np.zeros((len(number), rounds), np.uint64)
    some = np.flatnonzero(number)
    if not len(some):
        return out
    runs = -(-number[some] // _RUN)
    first_run = np.cumsum(runs) - runs
    begin = np.repeat((np.cumsum(number) - number)[some] - first_run * _RUN, runs) + np.arange(runs.sum()) * _RUN
    for r in range(rounds):
        turn = h if not r else kernel.mix(h + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)))
        byte = np.ascontiguousarray(turn.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        ones = np.empty((len(some), 64), np.int64)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[byte[k]], begin).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes, first_run, axis=0, dtype=np.int64)
        out[some, r] = np.packbits(2 * ones > number[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Sets:
    """Union-find over positions, with whole arrays of edges at a time; made
    holds the edges that joined two sets."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.made: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            go = low != high
            if not go.any():
                return
            a, b, low, high = a[go], b[go], low[go], high[go]
            np.minimum.at(self.of, high, low)
            hooked, edge = np.unique(high, return_index=True)
            best = np.flatnonzero(self.of[high] == low)
            edge[np.searchsorted(hooked, high[best])] = best
            self.made.append((a[edge], b[edge]))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def _index(f: np.ndarray) -> list[tuple]:
    """Levels of nodes (bits that are 1 in all members, bits that are 0 in all,
    first member, one past the last); level 0 has the fingerprints."""
    n = len(f)
    levels = [(f, ~f, np.arange(n), np.arange(n) + 1)]
    while len(levels[-1][0]) > FANOUT:
        ones, zeros, lo, hi = levels[-1]
        cut = np.arange(0, len(ones), FANOUT)
        levels.append((np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut), lo[cut], hi[np.minimum(cut + FANOUT, len(ones)) - 1]))
    return levels


def forest(f: np.ndarray, bits: int, side: np.ndarray | None = None, wide: np.ndarray | None = None, total: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ends of links that make a spanning forest of all links
    among fingerprints; if side is given, of those between its two values.
    With wide (fingerprints of all rounds), links also differ in at most total
    bits over those."""
    if side is None:
        place = np.argsort(gray_rank(f), kind="stable")
        f = f[place]
        levels, tops = _index(f), None
    else:
        parts = [np.flatnonzero(side == s) for s in (0, 1)]
        parts = [p[np.argsort(gray_rank(f[p]), kind="stable")] for p in parts]
        both = [_index(f[p]) for p in parts]
        place = np.concatenate(parts)
        f = f[place]
        depth = max(map(len, both))
        for x in both:
            while len(x) < depth:  # one node may be its own parent
                x.append(x[-1])
        tops = [len(x[-1][0]) for x in both]
    wide = None if wide is None else wide[place]
    sets = _Sets(len(f))
    if side is None:
        top = len(levels) - 1
        a, b = np.triu_indices(len(levels[top][0]))
        get = lambda k, which: (levels[k], 0)
    else:
        top = depth - 1
        a, b = (x.ravel() for x in np.meshgrid(np.arange(tops[0]), np.arange(tops[1]), indexing="ij"))
        get = lambda k, which: (both[which][k], len(parts[0]) if which else 0)
    def fans(k: int) -> list[int]:
        """Children of a node of level k + 1 on either side; one that is its own parent has itself."""
        return [1 if k == top or len(get(k, s)[0][0]) == len(get(k + 1, s)[0][0]) else FANOUT for s in (0, 1)]

    # pairs of nodes wait unopened: the pairs of their children are a few hundred times as many
    stack = [(top, a, b, False)]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while stack:
        k, x, y, closed = stack.pop()
        (one_a, zero_a, lo_a, hi_a), off_a = get(k, 0)
        (one_b, zero_b, lo_b, hi_b), off_b = get(k, 1)
        fan_a, fan_b = fans(k)
        if closed:
            x = np.repeat(x * fan_a, fan_a * fan_b) + np.tile(np.repeat(np.arange(fan_a), fan_b), len(x))
            y = np.repeat(y * fan_b, fan_a * fan_b) + np.tile(np.arange(fan_b), len(y) * fan_a)
            go = (x < len(one_a)) & (y < len(one_b))
            if side is None:
                go &= x <= y
            x, y = x[go], y[go]
        least = np.bitwise_count((one_a[x] & zero_b[y]) | (zero_a[x] & one_b[y])).astype(np.int64)
        go = least <= bits
        x, y, least = x[go], y[go], least[go]
        if k == 0:
            x, y = x + off_a, y + off_b
            if wide is not None:
                go = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64) <= total
                x, y = x[go], y[go]
            sets.join(x, y)
            continue
        most = least + np.bitwise_count(full ^ ((one_a[x] | zero_a[x]) & (one_b[y] | zero_b[y]))) if wide is None else np.full(len(x), bits + 1)
        for i in np.flatnonzero(most <= bits):
            p = np.arange(lo_a[x[i]], hi_a[x[i]]) + off_a
            q = np.arange(lo_b[y[i]], hi_b[y[i]]) + off_b
            sets.join(np.concatenate([p, np.full(len(q), p[0])]), np.concatenate([np.full(len(p), q[0]), q]))
        go = most > bits
        x, y = x[go], y[go]
        if not len(x):
            continue
        la, lb = sets.of[lo_a[x] + off_a], sets.of[lo_b[y] + off_b]
        low_a, high_a = (np.array(g) for g in _spread(sets.of[off_a : off_a + hi_a[-1]], lo_a))
        low_b, high_b = (low_a, high_a) if side is None else (np.array(g) for g in _spread(sets.of[off_b : off_b + hi_b[-1]], lo_b))
        go = ~((low_a[x] == high_a[x]) & (low_b[y] == high_b[y]) & (la == lb))
        x, y = x[go], y[go]
        fan_a, fan_b = fans(k - 1)
        step = max(1, _CHUNK // (fan_a * fan_b))
        for s in range(0, len(x), step):
            stack.append((k - 1, x[s : s + step], y[s : s + step], True))
    if not sets.made:
        return place[:0], place[:0]
    return tuple(place[np.concatenate(x)] for x in zip(*sets.made, strict=True))


def _spread(of: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(of, lo), np.maximum.reduceat(of, lo)


def masks(bits: int, n: int) -> list[int]:
    """Masks of which one at least covers only equal bits of any two linked
    fingerprints: the bits are cut into blocks, and all but `bits` blocks make
    a mask.  More fingerprints take more blocks, hence longer masks."""
    for blocks in range(bits + 1, 2 * bits + 1):
        if n >> (64 * (blocks - bits) // blocks) < TILE // 32:
            break
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << hi) - (1 << lo) for lo, hi in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - bits)]


def bands(width: int = 16) -> list[int]:
    """Masks of the 64 / width blocks of `width` bits."""
    return [((1 << width) - 1) << lo for lo in range(0, 64 - width + 1, width)]


_TILES = "a long, b long, bucket long, tile long, fp long, wide array<long>"
_TILE_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("a", "b", "bucket", "tile", "fp")), ("wide", pa.list_(pa.int64()))])


def _tiles(bits: int, tile: int, rounds: int, total: int):
    def out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _TILE_SCHEMA], schema=_TILE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Forest edges (a, b) of each tile; the members (a) of buckets that may have further tiles."""
        part = TaskContext.get().partitionId() << 32
        number = 0
        keys, fps, nodes, wide = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, rounds), np.uint64)
        opened = True  # the bucket may begin in an earlier partition
        made: list[list[np.ndarray]] = [[], []]

        def flush(bucket: int, at: slice, shared: bool):
            nonlocal number
            f, names = fps[at], nodes[at]
            if len(f) > 1:
                for side, x in zip(made, forest(f, bits, None, wide[at] if rounds > 1 else None, total), strict=True):
                    side.append(names[x])
            if shared:
                full = lambda v: pa.array(np.full(len(f), v, np.int64))
                more = {"wide": kernel.lists(wide[at].ravel().view(np.int64), np.full(len(f), rounds), pa.int64())} if rounds > 1 else {}
                yield out(len(f), a=pa.array(names), bucket=full(bucket), tile=full(part + number), fp=pa.array(f.view(np.int64)), **more)
                number += 1

        def groups(last: bool):
            nonlocal keys, fps, nodes, wide, opened
            edge = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
            done = 0
            for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                tail = hi == len(keys)
                if tail and not last and hi - lo < tile:
                    break
                for s in range(lo, hi, tile):
                    yield from flush(int(keys[lo]), slice(s, min(s + tile, hi)), opened or tail or hi - lo > tile)
                opened = tail  # if more of it comes, that is a further tile
                done = hi
            keys, fps, nodes, wide = keys[done:], fps[done:], nodes[done:], wide[done:]

        for batch in batches:
            keys = np.concatenate([keys, batch.column("bucket").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            if rounds > 1:
                wide = np.concatenate([wide, batch.column("wide").flatten().to_numpy().view(np.uint64).reshape(-1, rounds)])
            else:
                wide = np.zeros((len(keys), 1), np.uint64)
            yield from groups(False)
        yield from groups(True)
        if made[0]:
            yield out(sum(map(len, made[0])), a=pa.array(np.concatenate(made[0])), b=pa.array(np.concatenate(made[1])))

    return run


def links(found: DataFrame, keys: list[int], bits: int = 4, tile: int = TILE, rounds: int = 1, total: int = 0, banded: int = 1) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints as all links do; at most
    a forest for each tile or pair of tiles.

    found has node (the name of a fingerprint) and wide (its value in each
    round).  Fingerprints meet where, in one of the first `banded` rounds, they
    agree on one of the masks `keys`; they link if they differ in at most `bits`
    bits in that round and, with rounds > 1, in at most `total` over it and the
    rounds that follow, `rounds` in all."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    near = lambda r: F.array(*[F.col("wide")[(r + k) % banded] for k in range(rounds)]) if rounds > 1 else F.lit(None).cast("array<long>")
    cells = [F.struct(F.xxhash64(F.lit(r), F.lit(i), F.col("wide")[r].bitwiseAND(F.lit(signed(m)))).alias("bucket"), F.col("wide")[r].alias("fp"), near(r).alias("wide")) for r in range(banded) for i, m in enumerate(keys)]
    rows = found.select("node", F.explode(F.array(*cells)).alias("cell")).select("node", "cell.*").withColumn("gray", F.expr(_GRAY))
    n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(n, "bucket", "gray").sortWithinPartitions("bucket", "gray").select("bucket", "fp", "node", "wide")
    made = materialise(dealt.mapInArrow(_tiles(bits, tile, rounds, total), _TILES))
    edges = made.where("b is not null").select("a", "b")
    members = made.where("tile is not null").select("bucket", "tile", "fp", F.col("a").alias("node"), "wide")
    node = members.groupBy("bucket", "tile").agg(F.expr("bit_and(fp)").alias("ones"), F.expr("bit_and(~fp)").alias("zeros"))
    x, y = (node.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "ones", "zeros")]) for s in "xy")
    pairs = x.join(y, "bucket").where("tile_x < tile_y").where(F.expr(f"bit_count((ones_x & zeros_y) | (zeros_x & ones_y)) <= {bits}")).select("bucket", "tile_x", "tile_y")
    sides = [members.join(pairs.withColumn("tile", F.col(f"tile_{s}")), ["bucket", "tile"]).select("tile_x", "tile_y", "bucket", "fp", "node", "wide", F.lit(k).alias("side")) for k, s in enumerate("xy")]

    def across(group):
        import pandas as pd

        w = np.array(group.wide.tolist(), np.int64).view(np.uint64) if rounds > 1 else None
        a, b = forest(group.fp.to_numpy().view(np.uint64), bits, group.side.to_numpy(), w, total)
        names = group.node.to_numpy()
        return pd.DataFrame({"a": names[a], "b": names[b]})

    return edges.unionByName(sides[0].unionByName(sides[1]).groupBy("bucket", "tile_x", "tile_y").applyInPandas(across, "a long, b long"))


#: Reflected Gray rank of fp, with the sign bit turned so that it sorts as unsigned.
_GRAY = "fp"
for _s in (1, 2, 4, 8, 16, 32):
    _GRAY = f"transform(array({_GRAY}), x -> x ^ shiftrightunsigned(x, {_s}))[0]"
_GRAY = f"({_GRAY}) ^ shiftleft(1L, 63)"


def _wide(rows: DataFrame, shingle: int, rounds: int) -> DataFrame:
    """rows (doc_id, th, text) with the fingerprints of all rounds in place of the text, written."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("wide", pa.list_(pa.int64()))])

    def make(batch, texts):
        wide = fingerprints(texts, shingle, rounds=rounds)
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "wide": kernel.lists(wide.ravel().view(np.int64), np.full(len(wide), rounds), pa.int64())}

    return materialise(rows.mapInArrow(kernel.over_texts(make, schema), f"doc_id {kind_of(rows, 'doc_id')}, th long, wide array<long>"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id that links reach, its own included).

    Null or empty text, and text of blanks only: fingerprint zero, linked like
    any other.  Rows with a null doc_id get their fingerprint; they link, but
    count as larger than any doc_id, so a component of such rows alone has
    component_id null.  Repeated rows stay; an empty table gives none; an id may
    be of any type.  Other columns are not read.
    """
    known = _wide(_rows(docs, doc_id, text), shingle, 1).withColumn("node", F.col("wide")[0])
    distinct = materialise(known.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("wide").alias("wide"), F.count("*").alias("rows")))
    groups = components(links(distinct, masks(bits, distinct.count()), bits, tile))
    named = distinct.drop("wide").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least, "component").select("node", "component_id", "rows"))
    found = join_counted(known.select("doc_id", "node"), named, "node", "rows")
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


#: Rounds of fingerprints of the near-dedup stage, all of which give candidates, and how many
#: of them a candidate is judged by in the index.
ROUNDS, JUDGED = 12, 3
#: Differing bits of a candidate: in its own round, and over the judged ones.  At a similarity of
#: 0.8, 0.15 of the bits differ: 10 of 64 (deviation 3) and 29 of 192 (deviation 5).
OWN_BITS, JUDGED_BITS = 20, 41
#: Of all rounds' bits: pairs of fewer are similar beyond doubt, pairs of more are not; between
#: them the shingles decide.  At 0.8, 116 of 768 differ (deviation 10).
SURE_BITS, MOST_BITS = 84, 150


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th) of every row of docs, and links (a, b) between hashes of
    texts that connect the distinct texts with a Jaccard similarity of `least`
    or more over their sets of shingles.

    A 64-bit fingerprint tells a similarity of 0.8 apart only roughly, so twelve
    rounds are taken.  The index of each round's 16-bit bands gives candidates;
    a candidate that all rounds together don't decide is verified on its sets of
    shingles.  Texts without words have nothing in common with any other text.
    """
    known = _wide(_rows(docs, doc_id, text), shingle, ROUNDS)
    some = known.where(F.exists("wide", lambda x: x != 0))
    distinct = materialise(some.groupBy(F.col("th").alias("node")).agg(F.first("wide").alias("wide")))
    edges = links(distinct, bands(), OWN_BITS, tile, JUDGED, JUDGED_BITS, ROUNDS)
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: distinct.select(F.col("node").alias(s), F.col("wide").alias(f"wide_{s}"))
    bits = F.expr("aggregate(zip_with(wide_a, wide_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    judged = materialise(edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", bits.alias("bits")).where(F.col("bits") <= MOST_BITS))
    sure, open_ = judged.where(F.col("bits") <= SURE_BITS).select("a", "b"), judged.where(F.col("bits") > SURE_BITS).select("a", "b")
    # a pair that is connected already needs no verification
    of = components(sure)
    name = lambda s: of.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    open_ = open_.join(name("a"), "a", "left").join(name("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    open_ = materialise(open_)
    ends = open_.select(F.col("a").alias("th")).unionByName(open_.select(F.col("b").alias("th"))).distinct()
    texts = _rows(docs, doc_id, text).select("th", "text").join(ends, "th", "left_semi").dropDuplicates(["th"])
    schema = pa.schema([("th", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def make(batch, texts):
        h, number = shingles(texts, shingle)
        at = np.concatenate([[0], np.cumsum(number)])
        sets = [np.unique(h[x:y]).view(np.int64) for x, y in zip(at, at[1:], strict=False)]
        return {"th": batch.column("th"), "grams": kernel.lists(np.concatenate([*sets, np.zeros(0, np.int64)]), np.array([len(x) for x in sets], np.int64), pa.int64())}

    sets = materialise(texts.mapInArrow(kernel.over_texts(make, schema), "th long, grams array<long>"))
    grams = lambda s: sets.select(F.col("th").alias(s), F.col("grams").alias(f"grams_{s}"))
    both = open_.join(grams("a"), "a").join(grams("b"), "b").withColumn("shared", F.size(F.array_intersect("grams_a", "grams_b")))
    verified = both.where(F.col("shared") >= F.lit(float(least)) * (F.size("grams_a") + F.size("grams_b") - F.col("shared"))).select("a", "b")
    return known.select("doc_id", "th"), materialise(sure.unionByName(verified))


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that come first in their group of similar texts
    (smallest doc_id, null last, then hash of the text); of repeated rows one
    stays (of rows that tie in id and text and differ elsewhere, any).  Columns stay.

    Equal texts are similar, those without words too; null texts are similar to
    each other.  An id may be of any type.
    """
    found, edges = similar(docs, shingle, least, doc_id, text)
    groups = components(edges)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    one = materialise(found.groupBy("th").agg(F.min(order).alias("first"), F.count("*").alias("rows")))
    named = one.join(groups.withColumnRenamed("node", "th"), "th", "left").withColumn("component", F.coalesce("component", "th"))
    best = named.groupBy("component").agg(F.min(F.struct("first", "th")).alias("best"))
    keep = best.select(F.col("best.th").alias("__th"), F.col("best.first.id").alias("__id"))
    keep = materialise(keep)
    on = docs[doc_id].eqNullSafe(keep["__id"]) & (F.xxhash64(docs[text].cast("string")) == keep["__th"])
    repeated = materialise(found.join(keep, found["doc_id"].eqNullSafe(keep["__id"]) & (found["th"] == keep["__th"])).groupBy("__id", "__th").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    again = docs[doc_id].eqNullSafe(repeated["__id"]) & (F.xxhash64(docs[text].cast("string")) == repeated["__th"])
    once = docs.join(keep, on, "left_semi").join(repeated, again, "left_anti")
    return once.unionByName(docs.join(repeated, again).dropDuplicates(["__id", "__th"]).select(*docs.columns))
