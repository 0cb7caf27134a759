"""Quality rules: base counts, and the frequency of lines across documents.

A line is normalised (A-Z folded, digits read as 0, blanks collapsed) and
hashed.  For every host the distinct documents that hold a line are counted;
lines above the limit are boilerplate, and a document that consists of
boilerplate by more than a given share of its words is depleted.

Copies of a document must not turn its own lines into boilerplate, so two
documents count as one when they have the same set of lines, told by the sum
of the lines' mixed hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import BLANKS, join_hot, kind_of, materialise

SYMBOLS = b"#*$%&|<>"
#: A line in more distinct documents of a host is removed.
LINE_LIMIT = 20
#: A document that loses a larger share of its words is rejected.
LOST_SHARE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_PLAIN = kernel._LOWER.copy()
_PLAIN[0x30:0x3A] = 0x30

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINE = pa.struct([("line", pa.int64()), ("rest", pa.int64()), ("words", pa.int32())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("th", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("base_failed", pa.bool_()), ("lines", pa.list_(_LINE))])
_DDL = f"host string, th long, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, lines array<struct<line:long,rest:long,words:int>>"


def _measure(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
    w = kernel.Words(texts)
    n = len(texts)
    space = kernel._SPACE[w.buf]
    out = {c: batch.column(c) for c in ("doc_id", "host", "th")}
    out["n_words"] = w.count
    out["word_chars"] = w.per_doc(~space & w.points())
    out["n_symbols"] = w.per_doc(_SYMBOL[w.buf])
    g, first = kernel.grams(w.hashes(), w.at, 3)
    twice, _ = kernel.repeated(g, w.doc[first])
    marked = np.zeros(len(w.start) + 2, bool)
    for k in range(3):
        marked[first[twice] + k] = True
    out["n_repeat_words"] = np.bincount(w.doc, marked[: len(w.start)], n).astype(np.int64) if len(w.doc) else np.zeros(n, np.int64)
    ends = np.flatnonzero(w.buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    words = np.bincount(np.searchsorted(starts, w.start, "right") - 1, minlength=len(starts)) if len(w.start) else np.zeros(len(starts), np.int64)
    full = words > 0
    starts, ends, words = starts[full], ends[full], words[full]
    doc = np.searchsorted(w.first, starts, "right") - 1
    _, later = kernel.repeated(w.hashes(starts, ends), doc)
    out["n_dup_lines"] = np.bincount(doc, later, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    out["base_failed"] = (w.count < 50) | (100 * out["n_repeat_words"] > 50 * w.count)
    plain = _PLAIN[w.buf].tobytes()
    md5 = hashlib.md5
    line = np.frombuffer(b"".join(md5(b" ".join(plain[s:e].split())).digest()[:8] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), ">u8").astype(np.uint64)
    _, again = kernel.repeated(line, doc)
    every = np.zeros(n, np.uint64)
    np.add.at(every, doc[~again], kernel.mix(line[~again]))
    rest = every[doc] - kernel.mix(line)  # the document's other lines
    flat = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(words.astype(np.int32))], fields=list(_LINE))
    out["lines"] = kernel.lists(flat, np.bincount(doc, minlength=n), _LINE)
    return out


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts and hashed lines of every row of docs, written once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(kernel.over_texts(_measure, _SCHEMA), f"doc_id {kind_of(rows, 'doc_id')}, {_DDL}"))


def frequent_lines(measured: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, line) held by more than `limit` distinct documents of the host."""
    each = measured.select("host", F.inline("lines")).select("host", "line", "rest").distinct()
    counted = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return counted.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line")


def verdicts(docs: DataFrame, limit: int = LINE_LIMIT, lost: float = LOST_SHARE, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> tuple[DataFrame, DataFrame]:
    """One row for each row of docs (counts, lost_words, kept), and the frequent lines."""
    measured = measure(docs, doc_id, text, host)
    often = materialise(frequent_lines(measured, limit))
    lines = measured.select("doc_id", "th", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode(F.expr("array_distinct(transform(lines, x -> x.line))")).alias("line"))
    hits = join_hot(lines, often, ["host", "no_host", "line"]).groupBy("doc_id", "th", "host", "no_host").agg(F.collect_set("line").alias("gone"))
    m = measured.alias("m")
    h = hits.alias("h")
    on = F.col("m.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("m.th") == F.col("h.th")) & (F.coalesce("m.host", F.lit("")) == F.col("h.host")) & (F.col("m.host").isNull() == F.col("h.no_host"))
    joined = m.join(h, on, "left").select("m.*", "h.gone")
    gone = F.coalesce(F.expr("aggregate(filter(lines, x -> array_contains(gone, x.line)), 0L, (s, x) -> s + x.words)"), F.lit(0).cast("long"))
    out = joined.withColumn("lost_words", F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(gone))
    kept = ~F.col("base_failed") & (F.col("lost_words") <= F.lit(float(lost)) * F.col("n_words"))
    return out.withColumn("kept", kept), often


def quality(docs: DataFrame, limit: int = LINE_LIMIT, lost: float = LOST_SHARE, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, lost_words, kept.

    Null text counts as empty and fails; a null host is a host of its own;
    rows with a null doc_id are judged like others; repeated rows are all
    judged, and count as one document, as do all with the same set of lines; an
    empty table gives no row.  An id may be of any type.  Other columns are not read.
    """
    out, _ = verdicts(docs, limit, lost, doc_id, text, host)
    return out.select("doc_id", *_COUNTS, "base_failed", "lost_words", "kept")


def apply_quality(docs: DataFrame, limit: int = LINE_LIMIT, lost: float = LOST_SHARE, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that are kept, with boilerplate lines taken out of the
    text; all columns stay, n_chars (if there) is counted anew.

    Rows with null or empty text go, as they have too few words.  Repeated rows
    and rows that tie in doc_id are judged each by their own text."""
    out, _ = verdicts(docs, limit, lost, doc_id, text, host)
    plain = r"translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"
    words = plain.replace("(x,", r"(array_join(regexp_extract_all(x, '" + BLANKS.replace("\\", "\\\\") + r"', 0), ' '),")
    verdict = out.where("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.coalesce("host", F.lit("")).alias("__host"), F.col("host").isNull().alias("__none"), F.transform("gone", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))).alias("__gone")).dropDuplicates(["__id", "__th", "__host", "__none"])
    on = docs[doc_id].eqNullSafe(verdict["__id"]) & (F.xxhash64(docs[text].cast("string")) == verdict["__th"]) & (F.coalesce(docs[host].cast("string"), F.lit("")) == verdict["__host"]) & (docs[host].isNull() == verdict["__none"])
    kept = docs.join(verdict, on)
    clean = F.expr(f"array_join(filter(split(`{text}`, '\n', -1), x -> NOT array_contains(__gone, substring(md5({words}), 1, 16))), '\n')")
    kept = kept.withColumn(text, F.when(F.col("__gone").isNotNull(), clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
