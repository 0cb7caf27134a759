"""Personal data, and the terms that reveal it.

Base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers.  Their values in normal form that stand beside each other in enough
documents belong to one protected entity.  From the corpus it is estimated how
strongly a term reveals an entity: the pointwise mutual information of the
term's occurrence in a document and the entity's occurrence beside the term, as
a share of the entity's own information content,

    disclosure(t, e) = log(c(t, e) N / (c(e) d(t))) / log(N / c(e)),

with c(e) the documents in which terms stand beside e, c(t, e) those in which t
does, d(t) the documents that hold t, and N all documents.  A term counts if it
was seen beside the entity in enough documents and if chance is no explanation:
with m = c(e) d(t) / N expected, the probability of c(t, e) or more is at most
m ** c(t, e) / c(t, e)!, which must not exceed a given level.  Such a term is
generalised from one threshold of disclosure on and removed from a higher one,
wherever it occurs.

All counts are of distinct documents: rows with the same text (told by its
hash) are one, so copies are no further evidence and don't dilute what there is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import components, discard, join_hot, kind_of, materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "removed", "generalised")
#: Words on either side of an entity that make its context.
WINDOW_WORDS = 6
#: Distinct documents in which a term stands beside an entity, or two values beside each other;
#: probability of a chance finding; disclosure to generalise and to remove.
LEAST_CONTEXTS = 2
CHANCE = 1e-4
GENERALISE = 0.6
REMOVE = 0.8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed; positions in code points.

    Each kind is matched leftmost and without overlap, as its pattern says, in
    time linear in the text."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                out.append(("email", begin, m.end()))
                last = m.end()
    for m in _DOTTED.finditer(text):
        part = m[0].split(".")
        at = m.start()
        for k in range(0, len(part) - 3, 4):
            four = part[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _terms(texts: list[bytes]) -> tuple[kernel.Words, np.ndarray, np.ndarray]:
    """Words of letters and digits, their hashes, and which of them are terms: those without digits."""
    w = kernel.Words(texts, lower=True, keep=_TERM)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.buf])])
    return w, w.hashes(), digits[w.end] == digits[w.start]


def normal(kind: str, value: str) -> str:
    """One form for all spellings of a value."""
    if kind == "email":
        return value.lower()
    if kind == "ip":
        return ".".join(p.lstrip("0") or "0" for p in value.split("."))
    return re.sub(r"[^0-9]", "", value)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN_DDL = "array<struct<kind:string,start:int,end:int>>"
_NEAR = pa.struct([("entity", pa.int64()), ("term", pa.int64())])
_BESIDE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _find(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
    plain = [t.decode("utf-8", "replace") for t in texts]
    digits = _digits(texts)
    found = [base_spans(t) if "@" in t or d else [] for t, d in zip(plain, digits, strict=True)]
    near: list[list[dict]] = [[] for _ in texts]
    beside: list[list[dict]] = [[] for _ in texts]
    some = [i for i, x in enumerate(found) if x]
    if some:
        w, h, good = _terms([texts[i] for i in some])
        point = np.concatenate([[0], np.cumsum(w.points())])
        for k, i in enumerate(some):
            words = slice(w.at[k], w.at[k + 1])
            begin, end = point[w.start[words]] - point[w.first[k]], point[w.end[words]] - point[w.first[k]]
            hs, ok = h[words], good[words].copy()
            for _, s, e in found[i]:
                ok &= (end <= s) | (begin >= e)
            before = None
            for kind, s, e in found[i]:
                entity = int(kernel.Words([f"{kind}:{normal(kind, plain[i][s:e])}".encode()]).hashes()[0].view(np.int64))
                left, right = np.searchsorted(end, s, "right"), np.searchsorted(begin, e)
                pick = np.arange(max(0, left - WINDOW_WORDS), min(len(hs), right + WINDOW_WORDS))
                near[i] += [{"entity": entity, "term": t} for t in np.unique(hs[pick[ok[pick]]]).view(np.int64).tolist()]
                if before and left - before[1] <= WINDOW_WORDS and before[0] != entity:
                    beside[i].append({"a": min(before[0], entity), "b": max(before[0], entity)})
                before = entity, right
    spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found]
    return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "spans": pa.array(spans, pa.list_(_SPAN)), "near": pa.array(near, pa.list_(_NEAR)), "beside": pa.array(beside, pa.list_(_BESIDE))}


def _digits(texts: list[bytes]) -> np.ndarray:
    """Which texts have two digits with at most one byte between them (every base pattern but e-mail needs that)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)
    d = _DIGIT[buf]
    at = np.flatnonzero(d[:-2] & (d[1:-1] | d[2:]) | d[:-2] & (buf[1:-1] != 10) & ~d[1:-1] & ((buf[1:-1] == 32) | (buf[1:-1] == 40) | (buf[1:-1] == 41) | (buf[1:-1] == 45) | (buf[1:-1] == 46)))
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(first, at, "right") - 1] = True
    return out


_SLOTS = 22  # bits of a hash that index the filter sent to every task: 4 MB


def _filter(terms: DataFrame, column: str = "term") -> np.ndarray:
    """Which 22-bit prefixes the hashes of a column have."""
    slots = terms.select(F.shiftrightunsigned(column, 64 - _SLOTS).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    out = np.zeros(1 << _SLOTS, bool)
    out[slots] = True
    return out


#: Counts of terms that a task holds before it hands them on.
_HELD = 1 << 21


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, None, np.ndarray]:
    term, of = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
    return term, None, np.bincount(of, np.concatenate([n for _, n in held]), len(term))


def _documents(docs: DataFrame, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, docs): in how many distinct texts of docs each of the terms (and
    of a few others that the filter of terms lets pass) occurs.

    Texts that a filter of copied texts (column th) doesn't hold occur once, so
    their terms are counted where they are; only the terms of the others meet
    by text."""
    maybe, twice = _filter(terms), _filter(copied, "th")
    schema = pa.schema([("term", pa.int64()), ("th", pa.int64()), ("n", pa.int64())])

    def rows(term: np.ndarray, th: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        text = pa.nulls(len(term), pa.int64()) if th is None else pa.array(th.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), text, pa.array(n.astype(np.int64))], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch, texts in kernel.pieces(batches, "text"):
            w, h, good = _terms(texts)
            go = good & maybe[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
            th = batch.column("th").to_numpy(zero_copy_only=False).view(np.uint64)
            term, doc = np.unique(np.stack([h[go], w.doc[go].astype(np.uint64)]), axis=1)
            text = th[doc.astype(np.int64)]
            again = twice[(text >> np.uint64(64 - _SLOTS)).astype(np.int64)]
            if again.any():
                yield rows(term[again], text[again], np.zeros(again.sum()))
            held.append(np.unique(term[~again], return_counts=True))
            size += len(held[-1][0])
            if size >= _HELD:  # one row a term and task, or as many terms as a task may hold
                yield rows(*_summed(held))
                held, size = [], 0
        if held:
            yield rows(*_summed(held))

    held = docs.select("th", "text").mapInArrow(run, "term long, th long, n long").groupBy("term", "th").agg(F.sum("n").alias("n"))
    return held.groupBy("term").agg((F.sum("n") + F.count("th")).alias("docs"))


def _places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end) of the occurrences of the terms."""
    maybe = _filter(terms)
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def make(batch, texts):
        w, h, good = _terms(texts)
        go = np.flatnonzero(good & maybe[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)])
        point = np.concatenate([[0], np.cumsum(w.points())])
        doc = w.doc[go]
        row = pa.array(doc)
        zero = point[w.first[doc]]
        return {"doc_id": batch.column("doc_id").take(row), "th": batch.column("th").take(row), "term": h[go].view(np.int64), "start": (point[w.start[go]] - zero).astype(np.int32), "end": (point[w.end[go]] - zero).astype(np.int32)}

    hits = docs.mapInArrow(kernel.over_texts(make, schema), f"doc_id {kind_of(docs, 'doc_id')}, th long, term long, start int, end int")
    return join_hot(hits, terms.select("term", "kind"), ["term"])


def entities(found: DataFrame, least: int = LEAST_CONTEXTS) -> DataFrame:
    """(th, entity, term): the terms beside each entity of each distinct text;
    values that stand beside each other in `least` texts are one entity."""
    near = found.select("th", F.inline("near")).distinct()
    pairs = found.select("th", F.inline("beside")).distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b")
    pairs = materialise(pairs)
    if pairs.isEmpty():
        return near
    of = components(pairs).withColumnRenamed("node", "entity")
    return near.join(of, "entity", "left").select("th", F.coalesce("component", "entity").alias("entity"), "term").distinct()


def disclosing(found: DataFrame, docs: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE, chance: float = CHANCE) -> DataFrame | None:
    """(term, disclosure, kind) of the terms that reveal an entity; None if no
    term has enough documents."""
    near = materialise(entities(found, least))
    together = materialise(near.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= least))
    if together.isEmpty():
        return None
    alone = near.groupBy("entity").agg(F.countDistinct("th").alias("own"))
    texts = materialise(found.groupBy("th").agg(F.count("*").alias("rows")))
    n = float(texts.count())

    def passing(counted: DataFrame) -> DataFrame:
        """Pairs that pass if their term is in as many texts as counted says; more texts only make it less likely."""
        joined = together.join(alone, "entity").join(counted, "term").withColumn("expected", F.col("own") * F.col("docs") / n)
        # a factorial of more than 20 doesn't fit; that of 20 makes the bound on the probability only larger
        luck = F.col("both") * F.log("expected") - F.log(F.factorial(F.least(F.col("both"), F.lit(20)).cast("int")).cast("double"))
        share = F.log(F.col("both") / F.col("expected")) / F.log(F.lit(n + 1) / F.col("own"))
        return joined.where(luck <= float(np.log(chance))).withColumn("disclosure", share).where(F.col("disclosure") >= generalise)

    # the texts in which a term stands beside any entity are the least it is in: frequent words go here
    open_ = materialise(passing(near.groupBy("term").agg(F.countDistinct("th").alias("docs"))).select("term").distinct())
    if open_.isEmpty():
        return None
    seen = materialise(_documents(docs, open_, texts.where("rows > 1")))
    terms = passing(seen).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    terms = materialise(terms.withColumn("kind", F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")))
    discard(near, together, seen, texts, open_)
    return terms


def find(docs: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE, doc_id: str = "doc_id", text: str = "text", chance: float = CHANCE) -> DataFrame:
    """(doc_id, th, spans: array of kind, start, end) for each row of docs, by
    start, then kind; th is the hash of the text.

    Null or empty text: no spans.  Rows with a null doc_id and repeated rows
    give a row each, an empty table none; an id may be of any type.  Rows with
    the same text count as one document.  Terms inside base spans aren't
    reported.  Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("spans", pa.list_(_SPAN)), ("near", pa.list_(_NEAR)), ("beside", pa.list_(_BESIDE))])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    ddl = f"doc_id {kind_of(docs, doc_id)}, th long, spans {_SPAN_DDL}, near array<struct<entity:long,term:long>>, beside array<struct<a:long,b:long>>"
    found = materialise(rows.mapInArrow(kernel.over_texts(_find, schema), ddl))
    terms = disclosing(found, rows, least, generalise, remove, chance)
    if terms is None:
        return found.select("doc_id", "th", "spans")
    more = _places(rows, terms).groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left")
    free = "filter(coalesce(more, array()), m -> NOT exists(spans, s -> s.start < m.end AND m.start < s.end))"
    rank = f"array_position(array({', '.join(repr(k) for k in KINDS)}), %s.kind)"
    order = f"(x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE CAST({rank % 'x'} - {rank % 'y'} AS INT) END"
    return both.select("doc_id", "th", F.expr(f"array_sort(concat(spans, {free}), {order})").alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with base spans replaced by their kind in brackets, generalised
    terms by [term], and removed terms left out; all columns stay.

    Null and empty texts stay as they are; repeated rows and rows that tie in
    doc_id are each changed by their own text.
    """
    found = find(docs, doc_id=doc_id, text=text, **options).where("size(spans) > 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__th"])
    out = docs.join(found, docs[doc_id].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text].cast("string")) == found["__th"]), "left")
    said = "CASE s.kind WHEN 'removed' THEN '' WHEN 'generalised' THEN '[term]' ELSE concat('[', s.kind, ']') END"
    # spans of different kinds may overlap: what an earlier one covers isn't written again
    step = f"(a, s) -> named_struct('out', concat(a.out, substring(`{text}`, a.at + 1, greatest(s.start - a.at, 0)), if(s.start >= a.at, {said}, '')), 'at', greatest(a.at, s.end))"
    body = f"aggregate(__spans, named_struct('out', '', 'at', 0), {step}, a -> concat(a.out, substring(`{text}`, a.at + 1)))"
    return out.withColumn(text, F.when(F.col("__spans").isNotNull(), F.expr(body)).otherwise(F.col(text))).select(*docs.columns)
