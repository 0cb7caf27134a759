"""Similar documents by token sets, and similar vectors, against a set of queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words: hashes of the distinct lower-cased words); null texts have none."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    return df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")).alias("words"))


def jaccard_top(docs: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.0, key: str = "doc_id", text: str = "text", rows: int = 8_000) -> DataFrame:
    """(query, doc_id, jaccard, rank): the k documents most like each query by
    Jaccard index of lower-cased words, those above `least` only; ties by key.

    Queries are a stated set and go to all tasks in blocks of about `rows`, so
    that no word, however frequent, gathers rows in a task.  A task counts the
    words that its documents share with all queries of the block: those of many
    queries by a matrix product, the others by lists of queries.  It spares
    documents whose size alone puts them below the best k so far, looks closer
    at those only that may be among them, and gives k rows for each query."""
    q, d = _tokens(queries, key, text), _tokens(docs, key, text)
    n, parts = queries.count() // rows + 1, []
    for i in range(n):
        block = q.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toPandas()
        if len(block):
            parts.append(d.mapInArrow(_alike(block["key"].to_numpy(np.int64), [np.asarray(w, np.int64) for w in block["words"]], k, least), "query long, key long, jaccard double"))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"query long, `{key}` long, jaccard double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("jaccard"), "key")
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query", F.col("key").alias(key), "jaccard", "rank")


#: Documents that are compared at once, the first time and later, and words of theirs in lists of queries.
_TILES, _MET = (64, 512), 1 << 21
#: A word of one query in so many, or more, is a column of a matrix.
_DENSE = 16


def _alike(ids: np.ndarray, words: list[np.ndarray], k: int, least: float):
    by_size = np.argsort([len(w) for w in words], kind="stable")
    ids, words = ids[by_size], [words[i] for i in by_size]
    size, n = np.array([len(w) for w in words]), len(ids)
    known, place, held = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), size)
    # words of many queries are columns of a matrix, the others lists of queries
    many = held * _DENSE >= n
    column = np.where(many, np.cumsum(many) - 1, -1)
    wide = int(many.sum())
    listed = ~many[place]
    order = np.argsort(place[listed], kind="stable")
    lists, length = of[listed][order].astype(np.int32), np.where(many, 0, held)
    begin = np.cumsum(length) - length

    def run(batches):
        dense = np.zeros((n, wide), np.float32)
        dense[of[~listed], column[place[~listed]]] = 1
        best, which = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        tile = _TILES[0]
        for batch in batches:
            keys, inside = batch.column("key").to_numpy(), batch.column("words").flatten().to_numpy()
            number = batch.column("words").value_lengths().to_numpy().astype(np.int64)
            spot = np.minimum(np.searchsorted(known, inside), max(len(known) - 1, 0))
            go = known[spot] == inside if len(known) else np.zeros(len(inside), bool)
            doc, word = np.repeat(np.arange(len(keys)), number)[go], spot[go]
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(keys)))])
            ranked = np.argsort(number, kind="stable")
            total = np.concatenate([[0], np.cumsum(length[word])])[at]
            heavy = np.cumsum((total[1:] - total[:-1])[ranked])
            first = 0
            while first < len(keys):
                end = np.searchsorted(heavy, (heavy[first - 1] if first else 0) + _MET, "right")
                docs = ranked[first : max(first + 1, min(first + tile, end))]
                first, tile, few = first + len(docs), _TILES[1], len(docs)
                low, high = number[docs[0]], number[docs[-1]]
                # the sizes alone bound the index; queries that may gain are between two sizes
                bar = best[:, -1]
                may = np.flatnonzero(np.minimum(size, high) / np.maximum(np.maximum(size, low), 1) >= bar - 1e-8)
                if not len(may):
                    continue
                lo, hi = may[0], may[-1] + 1
                met = at[docs + 1] - at[docs]
                pick = np.repeat(at[docs] - (np.cumsum(met) - met), met) + np.arange(met.sum())
                here, w = np.repeat(np.arange(few), met), word[pick]
                common = np.zeros((hi - lo, few), np.float32)
                if wide:
                    go = column[w] >= 0
                    side = np.zeros((few, wide), np.float32)
                    side[here[go], column[w[go]]] = 1
                    np.matmul(dense[lo:hi], side.T, out=common)
                times = length[w]
                query = lists[np.repeat(begin[w] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                here = np.repeat(here, times)
                go = (query >= lo) & (query < hi)
                common += np.bincount((query[go] - lo) * np.int64(few) + here[go], minlength=common.size).reshape(common.shape)
                share = np.maximum(bar[lo:hi], 0)
                share /= 1 + share
                # a little less than the common words that would equal the last of the best k
                need = np.where(share > 0, share * size[lo:hi] * (1 - 1e-5) - 0.01, 0.5 if least >= 0 else 0).astype(np.float32)[:, None]
                row, col = np.nonzero(common >= need + (np.maximum(share, 0) * (1 - 1e-5)).astype(np.float32)[:, None] * number[docs].astype(np.float32))
                shared = common[row, col].astype(np.float64)
                row, key, total = row + lo, keys[docs[col]], size[row + lo] + number[docs[col]]
                alike = np.round(shared / np.maximum(total - shared, 1), 9)
                go = (alike > least) & (alike >= bar[row]) & (ids[row] != key)
                row, key, alike = row[go], key[go], alike[go]
                if not len(row):
                    continue
                old = np.unique(row)
                row, key, alike = (np.concatenate(x) for x in ((np.repeat(old, k), row), (which[old].ravel(), key), (best[old].ravel(), alike)))
                order = np.lexsort((key, -alike, row))
                rank = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
                top, rank = order[rank < k], rank[rank < k]
                best[row[top], rank], which[row[top], rank] = alike[top], key[top]
        row, col = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(which[row, col]), pa.array(best[row, col])], names=["query", "key", "jaccard"])

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.5, key: str = "vec_id", vector: str = "embedding", rows: int = 10_000) -> DataFrame:
    """(query, vec_id, cosine, rank): the k nearest vectors of each query by
    cosine, ties by key.  Queries are a stated set and go to all tasks in blocks
    of at most `rows`; each Arrow batch is one matrix product and keeps k rows
    for each query.  Null and zero vectors are like nothing."""
    n = queries.count() // rows + 1
    q = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("u")).where(F.col("u").isNotNull())
    v = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    parts = []
    for i in range(n):
        block = q.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i).toPandas()
        if len(block):
            parts.append(v.mapInArrow(_nearest(block["query"].to_numpy(np.int64), np.stack(block["u"].to_list()), k, least), "query long, key long, cosine double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query long, `{key}` long, cosine double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query", F.col("key").alias(key), "cosine", "rank")


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, np.nan)


def _nearest(ids: np.ndarray, u: np.ndarray, k: int, least: float):
    unit = _unit(u)

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            column = batch.column("v")
            if not len(keys):
                continue
            cos = np.round(unit @ _unit(column.flatten().to_numpy().reshape(len(keys), -1)[order]).T, 9)
            keys = keys[order]
            cos[(ids[:, None] == keys[None, :]) | ~(cos >= least)] = -np.inf
            top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            row, col = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
            go = np.isfinite(cos[row, col])
            row, col = row[go], col[go]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[col]), pa.array(cos[row, col])], names=["query", "key", "cosine"])

    return run
