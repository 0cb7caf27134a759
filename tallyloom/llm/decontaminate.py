"""Benchmark decontamination: n-gram seeds, then Smith-Waterman scores.

Test items are taken in blocks of bounded size against all documents.  Every
item n-gram is a seed, however many documents hold it; an item of fewer words
is a seed as a whole.  A pass looks the seeds up in each document and aligns the passage around each hit with the item
(local alignment over words), unless the words that item and passage share
can't give the threshold.  The score is the alignment's share of the score of
an exact copy.

If a bound on the seeds is asked for, a first pass counts in how many documents
each item n-gram occurs; an item's seeds are then its n-grams of low document
frequency, and always its rarest ones.  Copies without such a seed are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel
from .common import kind_of, materialise

#: Words of a seed; the least number of an item's rarest n-grams taken anyway, if seeds are bounded.
SEED_WORDS = 3
RAREST = 12
#: Share of an exact copy's score from which a passage counts as a copy.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that one pass over the documents handles.
BLOCK_WORDS = 4_000_000
#: Pairs of a hit and an item that are looked at together.
PAIRS = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of letters, digits and characters
    beyond ASCII), where each text's words begin, and each word's text."""
    w = kernel.Words([t.decode("utf-8", "replace").lower().encode() for t in texts], keep=_WORD)
    return w.hashes(), w.at, w.doc


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage."""
    out = np.zeros(len(items), np.int64)
    order = np.argsort([len(x) for x in items], kind="stable")
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        rows, cols = max(len(items[i]) for i in some), max(len(passages[i]) for i in some)
        if not rows or not cols:
            continue
        text = np.zeros((len(some), cols), np.uint64)
        item = np.ones((len(some), rows), np.uint64)  # 0 and 1 never meet: padding matches nothing
        for k, i in enumerate(some):
            text[k, : len(passages[i])], item[k, : len(items[i])] = passages[i] | np.uint64(2), items[i] | np.uint64(2)
        slope = -GAP * np.arange(cols, dtype=np.int32)
        last, best = np.zeros((len(some), cols + 1), np.int32), np.zeros(len(some), np.int32)
        for r in range(rows):
            here = np.maximum(last[:, :-1] + np.where(text == item[:, r, None], MATCH, MISMATCH).astype(np.int32), last[:, 1:] + GAP)
            here = np.maximum(here, 0)
            here = np.maximum.accumulate(here + slope, axis=1) - slope
            last[:, 1:] = here
            best = np.maximum(best, here.max(axis=1))
        out[some] = best
    return out


def bound(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """A score that no local alignment of an item with its passage exceeds: an
    item's word matches only if the passage holds it, and costs if left out."""
    size = np.array([len(x) for x in items], np.int64)
    if not size.sum():
        return np.zeros(len(items), np.int64)
    pair = np.repeat(np.arange(len(items)), size)
    salted = lambda words, of: kernel.mix(words + kernel.mix(of.astype(np.uint64)))
    there = salted(np.concatenate(passages), np.repeat(np.arange(len(passages)), [len(x) for x in passages]))
    gain = np.where(np.isin(salted(np.concatenate(items), pair), there), MATCH, max(MISMATCH, GAP))
    # the best run of each item: the running sum less its least value so far, which a lift per item keeps apart
    total = np.concatenate([[0], np.cumsum(gain)])[:-1]
    lift = (MATCH - GAP - MISMATCH) * (len(gain) + 1)
    start = np.minimum.accumulate(total - pair * lift) + pair * lift
    return np.maximum.reduceat(total + gain - start, np.concatenate([[0], np.cumsum(size)[:-1]]))


class _Seeds:
    """The n-grams of one size of a block's items as sorted arrays."""

    def __init__(self, h: np.ndarray, at: np.ndarray, n: int, items: np.ndarray):
        self.n = n
        g, first = kernel.grams(h, at, n)
        item = np.searchsorted(at, first, "right") - 1
        go = items[item]
        g, first, item = g[go], first[go], item[go]
        order = np.argsort(g, kind="stable")
        self.gram, self.item, self.place = g[order], item[order], (first - at[item])[order]
        self.only()

    def only(self, keep: np.ndarray | None = None) -> None:
        if keep is not None:
            self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.gram >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of the documents that are grams of items, and each one's first word."""
        g, first = kernel.grams(h, at, self.n)
        go = np.flatnonzero(self.maybe[(g >> np.uint64(42)).astype(np.int64)])
        if not len(self.gram) or not len(go):
            return g[:0], first[:0]
        spot = np.minimum(np.searchsorted(self.gram, g[go]), len(self.gram) - 1)
        go = go[self.gram[spot] == g[go]]
        return g[go], first[go]


class _Block:
    """A block of items and its seeds, small enough to send to every task."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.ids = ids
        h, at, _ = tokens([t.encode() for t in texts])
        self.words = [h[a:b] for a, b in zip(at, at[1:], strict=False)]
        size = np.diff(at)
        made = [_Seeds(h, at, k, size == k if k < n else size >= n) for k in range(1, n + 1) if (size == k if k < n else size >= n).any()]
        self.seeds = made


def _count(seeds: _Seeds):
    schema = pa.schema([("gram", pa.int64()), ("docs", pa.int64())])

    def make(_, texts):
        h, at, doc = tokens(texts)
        g, first = seeds.hits(h, at)
        one = np.unique(np.stack([g, doc[first].astype(np.uint64)]), axis=1)[0] if len(g) else g
        gram, docs = np.unique(one, return_counts=True)
        return {"gram": gram.view(np.int64), "docs": docs.astype(np.int64)}

    return kernel.over_texts(make, schema), "gram long, docs long"


def _score(block: _Block, threshold: float, item_type: pa.DataType):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", item_type), ("score", pa.float64())])
    sizes = np.array([len(x) for x in block.words], np.int64)

    def met(seeds: _Seeds, h: np.ndarray, at: np.ndarray, doc: np.ndarray, best: dict[tuple[int, int], float]) -> None:
        g, first = seeds.hits(h, at)
        lo, hi = np.searchsorted(seeds.gram, g, "left"), np.searchsorted(seeds.gram, g, "right")
        part = np.cumsum(hi - lo) // PAIRS
        for k in np.unique(part):
            n, low, word = (hi - lo)[part == k], lo[part == k], first[part == k]
            pick = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            d, item = np.repeat(doc[word], n), seeds.item[pick]
            cell = (np.repeat(word, n) - seeds.place[pick]) // sizes[item]  # hits that start nearly alike share a passage
            d, item, cell = np.unique(np.stack([d, item, cell]), axis=1)
            size = sizes[item]
            slack = np.maximum(np.ceil((1 - threshold) * MATCH * size / -GAP), 0).astype(np.int64)  # words that an alignment at the threshold can skip
            lo_, hi_ = np.maximum(cell * size - slack, at[d]), np.minimum((cell + 2) * size + slack, at[d + 1])
            items, passages = [block.words[i] for i in item], [h[a:b] for a, b in zip(lo_, hi_, strict=True)]
            go = np.flatnonzero(bound(items, passages) >= threshold * MATCH * size)
            score = align([items[i] for i in go], [passages[i] for i in go]) / (MATCH * size[go])
            go, score = go[score >= threshold], score[score >= threshold]
            for key, s in zip(zip(d[go].tolist(), item[go].tolist(), strict=True), score.tolist(), strict=True):
                best[key] = max(s, best.get(key, 0.0))

    def make(batch, texts):
        h, at, doc = tokens(texts)
        best: dict[tuple[int, int], float] = {}
        for seeds in block.seeds:
            met(seeds, h, at, doc, best)
        rows = pa.array([k[0] for k in best], pa.int64())
        return {"doc_id": batch.column("doc_id").take(rows), "th": batch.column("th").take(rows), "item_id": pa.array([block.ids[k[1]] for k in best], item_type), "score": pa.array(list(best.values()), pa.float64())}

    return kernel.over_texts(make, schema)


def _rarest(rows: DataFrame, block: _Seeds, rare: int, rarest: int) -> np.ndarray:
    """Which of the seeds occur, in at most `rare` documents or as one of their item's rarest."""
    counted = rows.select("text").mapInArrow(*_count(block)).groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas()
    known = dict(zip(counted["gram"].to_numpy(np.int64).view(np.uint64).tolist(), counted["docs"].tolist(), strict=True))
    docs_of = np.array([known.get(g, 0) for g in block.gram.tolist()], np.int64)
    there = np.flatnonzero(docs_of)  # the rarest are taken among those that occur
    item, docs_of = block.item[there], docs_of[there]
    order = np.lexsort((block.place[there], docs_of, item))
    rank = np.empty(len(order), np.int64)
    edge = np.flatnonzero(np.diff(item[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order))))
    return there[(docs_of <= rare) | (rank < rarest)]


def blocks(items: DataFrame, item_id: str, text: str, words: int) -> Iterator[list[tuple]]:
    """The items in blocks of about `words` words; only one block is held at a time by each use."""
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.size(F.split("t", " ")))).first()[0] or 0
    n = total // words + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t").collect()
        if part:
            yield [(r.i, r.t) for r in part]


def contaminated(docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, rare: int | None = None, rarest: int = RAREST, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, th, item_id, score) for each document and item that align with
    at least the threshold; th is the hash of the text.

    Null or empty texts and items align with nothing, and empty tables give no
    row; rows with a null doc_id are searched and give a null doc_id; items with
    a null id are left out; ids may be of any type.  Repeated rows, and items
    that tie in id, give a result each.  Items shorter than a seed are seeds as
    a whole, so only their exact copies are found.  Every trigram of an item is a seed; with rare,
    only those in at most so many documents and the item's rarest.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    ddl = f"doc_id {kind_of(docs, doc_id)}, th long, item_id {kind_of(items, item_id)}, score double"
    item_type = to_arrow_type(items.select(F.col(item_id)).schema[0].dataType)
    out = None
    for part in blocks(items, item_id, item_text, block_words):
        block = _Block([i for i, _ in part], [t for _, t in part], seed_words)
        if rare is not None:
            for seeds in block.seeds:
                seeds.only(_rarest(rows, seeds, rare, rarest))
        found = rows.mapInArrow(_score(block, threshold, item_type), ddl)
        out = found if out is None else out.unionByName(materialise(found))
    return spark.createDataFrame([], ddl) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no copy of an item; columns stay.

    Null and empty texts hold none and stay.  Of rows that tie in doc_id those
    go whose text holds a copy; repeated rows go or stay together.
    """
    hit = materialise(contaminated(docs, items, doc_id=doc_id, text=text, **options)).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["__id"]) & (F.xxhash64(docs[text].cast("string")) == hit["__th"]), "left_anti")
