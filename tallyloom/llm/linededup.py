"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Edits are counted in words: two lines are near copies when one word inserted,
deleted or replaced makes them equal (edit distance of at most 1 over words,
after folding case and collapsing blanks).  The bound is one edit in five
words, so a line of fewer words has equal lines only: one edit turns any word
into any other.  A line goes if an equal line or a near copy stands earlier in
the corpus (by doc_id, then by hash of the text and line number).  Lines
without a word stay.

1. Equal lines are counted as one, at their first place.
2. A pair within the bound agrees on its first or on its last half.  Lines
   that share neither half with another line are done.
3. The others emit the hash of every variant with one word deleted, and of the
   line as it is.  Hashes are XORs of position-salted word hashes, so that all
   variants of a line cost two running XORs.
4. Lines with an equal variant meet.  Within the lines that lost a word at the
   same position all are near copies of each other, and an undeleted line is
   one of all that lost a word to become it; the earliest of either is found by
   aggregation, never by listing the pairs of a group.
5. The pairs of a line and its earliest mate are verified on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, materialise

#: Words from which a line may differ by one edit; shorter lines must be equal.
NEAR_WORDS = 5
#: Lines of more words get their running XORs from a window, not from an array.
LONG_WORDS = 1024


def _exploded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(none, id, th, line_no, line) with lines in lower case and single blanks,
    without empty ones; none: the id is null, so that it comes last."""
    body = F.lower(F.col(text).cast("string"))
    odd = F.lit(False)
    for c in "\t\v\f\r":
        odd = odd | body.contains(c)
    body = F.when(odd, F.translate(body, "\t\v\f\r", "    ")).otherwise(body)
    # hashed before the lines are taken apart, else once for each line
    rows = docs.select(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), body.alias("body"))
    rows = rows.select("none", "id", "th", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line")).where("line <> ''")
    rows = rows.select("none", "id", "th", "line_no", F.trim(F.when(F.col("line").contains("  "), F.regexp_replace("line", " +", " ")).otherwise(F.col("line"))).alias("line"))
    return rows.where("line <> ''")


#: Words of a line with single blanks.
_SIZE = "(length(line) - length(replace(line, ' ', '')) + 1)"


def _name() -> list[Column]:
    """Two hashes that name a line."""
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")]


def _halves() -> Column:
    """Hashes of the first and of the last half of a line of n words, the halves
    of its neighbours in size included."""
    front = [f"xxhash64('f', substring_index(line, ' ', {p}))" for p in ("n div 2", "(n - 1) div 2")]
    back = [f"xxhash64('b', substring_index(line, ' ', -{q}))" for q in ("(n - n div 2)", "(n - 1 - (n - 1) div 2)")]
    return F.array_distinct(F.array(*map(F.expr, [*front, *back])))


#: Bits of the filter of line hashes that is sent to every task: 2 MB.
_FILTER_BITS = 24


def _kept_by_filter(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of lines whose k1 may be among keys' k1: a bitmap of fixed size
    over the first bits of the hash.  It spares most lines the exact join."""
    place = F.shiftrightunsigned("k1", 64 - _FILTER_BITS)
    cells = keys.groupBy(F.shiftright(place, 6).cast("int").alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(k1, {64 - _FILTER_BITS}) & 63 AS INT)))").alias("bits"))
    filled = keys.sparkSession.range(1 << (_FILTER_BITS - 6)).select(F.col("id").cast("int").alias("i")).join(cells, "i", "left")
    bitmap = filled.agg(F.expr("transform(array_sort(collect_list(struct(i, coalesce(bits, 0L) AS bits))), x -> x.bits)").alias("bitmap"))
    with_map = lines.crossJoin(F.broadcast(materialise(bitmap)))
    return with_map.where(F.expr(f"(shiftrightunsigned(bitmap[CAST(shiftrightunsigned(k1, {64 - _FILTER_BITS + 6}) AS INT)], CAST(shiftrightunsigned(k1, {64 - _FILTER_BITS}) & 63 AS INT)) & 1) = 1")).drop("bitmap")


def _variants(lines: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(k1, k2, key, at): at is the deleted position, 0 for the line as it is."""
    short = lines.where(F.size("words") <= long_words)
    running = lambda h: f"aggregate({h}, array(0L), (s, x) -> array_append(s, element_at(s, -1) ^ x))"
    here = short.withColumn("a", F.expr(running("transform(words, (w, i) -> xxhash64(w, i + 1))"))).withColumn("b", F.expr(running("transform(words, (w, i) -> xxhash64(w, i))")))
    keys = F.expr("transform(sequence(0, size(words)), i -> if(i = 0, element_at(a, -1), a[i - 1] ^ b[i] ^ element_at(b, -1)))")
    out = here.select("k1", "k2", F.posexplode(keys).alias("at", "key"))
    long = lines.where(F.size("words") > long_words).select("k1", "k2", F.posexplode("words").alias("i", "w"))
    long = long.select("k1", "k2", (F.col("i") + 1).alias("at"), F.expr("xxhash64(w, i + 1)").alias("x"), F.expr("xxhash64(w, i)").alias("y"))
    line = Window.partitionBy("k1", "k2")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = long.select("k1", "k2", "at", "x", F.expr("bit_xor(x)").over(upto).alias("a"), F.expr("bit_xor(y)").over(upto).alias("b"), F.expr("bit_xor(y)").over(line).alias("total"))
    cut = long.select("k1", "k2", "at", F.expr("a ^ x ^ b ^ total").alias("key"))
    whole = long.groupBy("k1", "k2").agg(F.lit(0).alias("at"), F.expr("bit_xor(x)").alias("key"))
    return out.select("k1", "k2", "at", "key").unionByName(cut).unionByName(whole)


def duplicate_lines(docs: DataFrame, near_words: int = NEAR_WORDS, doc_id: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, th, line_no, keep_doc_id, keep_line_no, exact) for each line
    that goes: its place (line_no from 0; th is the hash of the text), and the
    earliest equal line (exact) or else the earliest near copy.

    Null and empty texts have no lines to remove, and lines of blanks stay; an
    empty table gives no row.  An id may be of any type; a null doc_id stands
    after all others and is returned as null.  Rows with equal doc_id and text
    are one document; documents that tie in doc_id alone follow the hash of
    their text.  Other columns are not read.
    """
    lines = _exploded(docs, doc_id, text)
    first = F.struct("none", "id", "th", "line_no")
    # lines that are too short for an edit have no halves
    placed = materialise(lines.withColumn("n", F.expr(_SIZE)).select("none", "id", "th", "line_no", *_name(), F.when(F.col("n") >= near_words, _halves()).alias("halves")))
    distinct = materialise(placed.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.min("halves").alias("halves")))
    half = distinct.select("k1", "k2", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("half")
    near = half.join(shared, "half", "left_semi").select("k1", "k2").distinct()
    firsts = distinct.join(near, ["k1", "k2"], "left_semi").select("k1", "k2", "first.*")
    firsts = materialise(firsts)
    # written out, as the optimiser would move the join below the filter
    found = materialise(_kept_by_filter(lines.select("th", "line_no", *_name(), "line"), firsts.select("k1")))
    texts = found.join(firsts.select("k1", "k2", "th", "line_no"), ["k1", "k2", "th", "line_no"], "left_semi").dropDuplicates(["k1", "k2"])
    texts = materialise(texts.select("k1", "k2", F.split("line", " ").alias("words")))
    discard(found)
    cut = materialise(_variants(texts.select("k1", "k2", "words"), long_words))
    met = cut.groupBy("key").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("key")
    me = F.struct("none", "id", "line_no", "k1", "k2").alias("me")
    rows = materialise(cut.join(met, "key", "left_semi").join(firsts.select("k1", "k2", me), ["k1", "k2"]).select("key", "at", "me"))
    discard(cut, firsts)
    same = rows.where("at > 0").groupBy("key", "at").agg(F.min("me").alias("mate"))
    base = rows.where("at = 0").groupBy("key").agg(F.min("me").alias("mate"))
    less = rows.where("at > 0").groupBy("key").agg(F.min(F.struct("me", "at")).alias("m")).select("key", F.col("m.me").alias("mate"), F.col("m.at").alias("mate_at"))
    zero = F.lit(0)
    pairs = (
        rows.join(same, ["key", "at"]).select("me", "mate", "at", F.col("at").alias("mate_at"))
        .unionByName(rows.where("at > 0").join(base, "key").select("me", "mate", "at", zero.alias("mate_at")))
        .unionByName(rows.where("at = 0").join(less, "key").select("me", "mate", zero.alias("at"), "mate_at"))
        .where("mate < me")
    )
    words = lambda side: texts.select(*[F.col(c).alias(f"{side}_{c}") for c in ("k1", "k2", "words")])
    both = pairs.join(words("x"), F.expr("me.k1 = x_k1 AND me.k2 = x_k2")).join(words("y"), F.expr("mate.k1 = y_k1 AND mate.k2 = y_k2"))
    left = lambda w, at: f"if({at} = 0, {w}, concat(slice({w}, 1, {at} - 1), slice({w}, {at} + 1, size({w}))))"
    sure = both.where(F.expr(f"{left('x_words', 'at')} = {left('y_words', 'mate_at')}")).groupBy("me.k1", "me.k2").agg(F.min(F.struct("mate.none", "mate.id", "mate.line_no")).alias("mate"))
    going = materialise(distinct.join(sure, ["k1", "k2"], "left").where("n > 1 OR mate IS NOT NULL").select("k1", "k2", "first", "mate"))
    discard(distinct, texts, rows)
    out = join_hot(placed.drop("halves"), going, ["k1", "k2"]).withColumn("exact", first != F.col("first")).where("exact OR mate IS NOT NULL")
    keep = F.when(F.col("exact"), F.struct("first.id", "first.line_no")).otherwise(F.struct("mate.id", "mate.line_no"))
    return out.withColumn("keep", keep).select(F.col("id").alias("doc_id"), "th", "line_no", F.col("keep.id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), "exact").distinct()


def drop_duplicate_lines(docs: DataFrame, near_words: int = NEAR_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the duplicate lines taken out of the text; every row and
    column stays, n_chars (if there) is counted anew.

    Null and empty texts stay as they are; a text of which all lines go is
    empty.  Repeated rows are one document, so all of them keep the lines that
    one keeps.  Ids may be null or of any type.
    """
    gone = duplicate_lines(docs, near_words, doc_id, text).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("line_no").alias("__gone"))
    on = docs[doc_id].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text].cast("string")) == gone["__th"])
    out = docs.join(gone, on, "left")
    left = F.expr(f"array_join(filter(split(`{text}`, '\n', -1), (x, i) -> NOT array_contains(__gone, i)), '\n')")
    out = out.withColumn(text, F.when(F.col("__gone").isNotNull(), left).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
