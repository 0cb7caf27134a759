"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is met by whole documents: every document is taken as
often as the target holds the source in full; for the rest of the budget the
documents are counted by exact length, each length gives the same share of its
documents, and what is still missing is filled by a bounded-knapsack dynamic
program over the documents left of each length.  Which documents of a length
are taken is decided by a seeded hash.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, discard, materialise, small_side

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 17
#: Bits that the tables of the dynamic program may take: 128 MB.
BITS = 1 << 30


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> dict[str | None, float]:
    """Target words of each source: sources in order share the sum of all sizes
    by the repeating weights; what exceeds `most` times a source's size is
    shared again among the others until none is above."""
    share = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(sizes)}
    size = dict(sizes)
    left, open_, out = float(sum(size.values())), [s for s, _ in sizes], {}
    while open_:
        total = sum(share[s] for s in open_)
        full = [s for s in open_ if left * share[s] / total > most * size[s]]
        if not full:
            return out | {s: left * share[s] / total for s in open_}
        for s in full:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, bits: int = BITS) -> list[int]:
    """How many documents of each length to take so that the sum of lengths is
    as near below the budget as can be found: an equal share of each length,
    then a bounded knapsack over the documents left.  If that doesn't fill the
    budget exactly, ever more of the share is given back to the knapsack, until
    it has all documents (and finds the best sum there is) or its tables would
    exceed `bits`."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    share = [c * budget // total for c in counts]
    best, back = None, 0
    while True:
        first = [max(t - back, 0) for t in share]
        take, left, whole = _fill(lengths, counts, first, budget, bits)
        if best is None or left < best[1]:
            best = take, left
        if not left or not whole or not any(first):
            return best[0]
        back = 4 * back + 1


def _fill(lengths: list[int], counts: list[int], first: list[int], budget: int, bits: int) -> tuple[list[int], int, bool]:
    """first and what a knapsack adds, the words still missing, and whether the
    knapsack had all of them to fill."""
    take = list(first)
    missing = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])

    def pieces() -> list[tuple[int, int]]:
        """(length's position, documents) in powers of two, so that any number can be made."""
        out = []
        for i in order:
            spare, step = min(counts[i] - take[i], missing // lengths[i]), 1
            while spare > 0:
                out.append((i, min(step, spare)))
                spare -= step
                step *= 2
        return out

    whole = missing * len(pieces()) <= bits
    if not whole:  # long documents first, until the tables fit
        for i in order:
            over = missing - bits // max(len(order), 1) // 8
            more = min(counts[i] - take[i], missing // lengths[i], -(-over // lengths[i]))
            if more > 0:
                take[i] += more
                missing -= more * lengths[i]
    # reach[k]: sums that the first k pieces make
    items, reach, mask = [], [1], (1 << (missing + 1)) - 1
    for i, n in pieces():
        items.append((i, n))
        reach.append((reach[-1] | reach[-1] << n * lengths[i]) & mask)
        if reach[-1] >> missing & 1:
            break
    best = reach[-1].bit_length() - 1
    left = missing - best
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> best & 1:
            i, n = items[k - 1]
            take[i] += n
            best -= n * lengths[i]
    return take, left, whole


def _plan(group):
    """One source: how many documents of each length get one more copy."""
    import pandas as pd

    first = group.iloc[0]
    full = int(Decimal(first.target) // first.source_size) if first.source_size else 0
    budget = round(first.target - full * first.source_size)
    lengths, counts = group["size"].tolist(), group["n"].tolist()
    return pd.DataFrame({"src": first.src, "size": lengths, "full": full, "extra": fit(lengths, counts, budget)})


def _source(c: Column) -> Column:
    """A text by which sources sort by code point, null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def _chosen(rows: DataFrame, by: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of which `some` of each group `by` are to be chosen, the first by
    key: those that are decided (more: 1 or 0), and those of the one key in each
    group that the cut goes through, with what is left to choose among them.
    Only counts of keys meet in a task, not a group's rows."""
    cells = rows.groupBy(*by, *key).agg(F.first("some").alias("want"), F.count("*").alias("m"))
    upto = Window.partitionBy(*by).orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("before", F.sum("m").over(upto) - F.col("m"))
    cells = cells.select(*by, *key, F.greatest(F.lit(0).cast("long"), F.least("m", F.col("want") - F.col("before"))).alias("now"), "m")
    dealt = rows.drop("some").join(cells.hint("merge"), [*by, *key])
    sure = dealt.where("now = 0 or now = m").withColumn("more", (F.col("now") > 0).cast("long")).drop("now", "m")
    return sure, dealt.where("now > 0 and now < m").withColumnRenamed("now", "some").drop("m")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken,
    source.  taken is a multiple of size, at most `most` times.

    Null text has size 0; a null source is a source of its own and the last;
    an empty table gives no row.  An id may be of any type, null too.  Equal
    (source, size, hash of doc_id) tie, and are told apart by the hash of the
    text; rows that tie in both are repeated rows, of which as many are taken as
    fit.  Other columns are not read.
    """
    return _taken(docs, weights, most, seed, doc_id, text, source).drop("th", "src", "row")


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    spark = docs.sparkSession
    rank = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))
    words = F.coalesce(F.size(F.regexp_extract_all(F.col(text).cast("string"), F.lit(BLANKS), F.lit(0))), F.lit(0))
    words = F.when(F.col(text).isNull(), F.lit(0)).otherwise(words)
    sized = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _source(F.col(source)).alias("src"), words.cast("long").alias("size"), rank.alias("rank"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.monotonically_increasing_id().alias("row")))
    by_length = materialise(sized.groupBy("src", "size").agg(F.count("*").alias("n")))
    by_source = [(r.src, r.words) for r in by_length.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words")).orderBy("src").collect()]
    goal = targets(by_source, weights, most)
    sizes = spark.createDataFrame([(s, n, float(goal[s])) for s, n in by_source], "src string, source_size long, target double")
    few = small_side(sizes, len(by_source))
    sizes = sizes if few is None else few
    plan = by_length.join(sizes, "src").groupBy("src").applyInPandas(_plan, "src string, size long, full long, extra long")
    plan = materialise(plan)
    discard(by_length)
    # The `extra` smallest of each (src, size), by part of the rank, then by rank and text, then by the partition
    # that wrote the row, then by row: no group meets in one task.
    group = ["src", "size"]
    rows = sized.withColumn("part", F.shiftrightunsigned("rank", 52).cast("int"))
    cells = rows.groupBy(*group, "part").agg(F.count("*").alias("m"))
    upto = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("before", F.sum("m").over(upto) - F.col("m")).join(plan.hint("merge"), group)
    cells = cells.select(*group, "part", "full", F.greatest(F.lit(0).cast("long"), F.least("m", F.col("extra") - F.col("before"))).alias("some"), "m")
    dealt = rows.join(cells.hint("merge"), [*group, "part"])
    sure = [dealt.where("some = 0 or some = m").withColumn("more", (F.col("some") > 0).cast("long")).drop("some", "m")]
    open_ = materialise(dealt.where("some > 0 and some < m").drop("m").withColumn("writer", F.shiftright("row", 33)))
    by = [*group, "part"]
    for key in (["rank", "th"], ["writer"]):
        decided, open_ = _chosen(open_, by, key)
        sure.append(decided.drop("writer"))
        open_ = materialise(open_)
        by += key
    place = F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    sure.append(open_.withColumn("more", (place <= F.col("some")).cast("long")).drop("some", "writer"))
    out = sure[0]
    for part in sure[1:]:
        out = out.unionByName(part)
    return out.join(sizes, "src").select("doc_id", "size", "source_size", "target", ((F.col("full") + F.col("more")) * F.col("size")).alias("taken"), "source", "th", "src", "row")


def select(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with all their columns and
    mix_size, mix_target (words its source is to give) and mix_times (how often the document is taken).

    Documents without words (null, empty and blank texts) are never taken.  Of
    repeated rows (equal id, text and source) one stays, with the sum of their
    times.  Rows that differ in other columns alone are repeated rows too, and
    the one of them that stays is any.  Columns of docs named like the new ones
    are replaced.
    """
    plan = _taken(docs, weights, most, seed, doc_id, text, source).where("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("src").alias("__src")).agg(F.first("size").alias("__size"), F.first("target").alias("__target"), F.sum(F.expr("taken div size")).alias("__times"), F.count("*").alias("__n"))
    plan = materialise(plan)
    on = docs[doc_id].eqNullSafe(plan["__id"]) & (F.xxhash64(docs[text].cast("string")) == plan["__th"]) & (_source(docs[source]) == plan["__src"])
    joined = docs.join(plan, on)
    once = joined.where("__n = 1")
    more = joined.where("__n > 1").dropDuplicates(["__id", "__th", "__src"])
    new = {"mix_size": "__size", "mix_target": "__target", "mix_times": "__times"}
    return once.unionByName(more).select(*[c for c in docs.columns if c not in new], *[F.col(c).alias(n) for n, c in new.items()])
