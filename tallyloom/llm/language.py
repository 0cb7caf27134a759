"""Language identification by error-correcting output codes.

Every language gets a codeword (a row of a Sylvester-Hadamard matrix, so any
two differ in half of the bits).  For each bit a binary classifier over hashed
byte trigrams gives a margin; decoding picks the codeword with the least sum of
logistic losses, each bit weighted by how well its classifier separates the
training rows, and flags the choice as ambiguous if the runner-up is close.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BUCKET_BITS = 14
#: Labelled rows of one language that the classifiers are fitted on, about.
SAMPLE_ROWS = 2_000
#: Difference of posterior weight below which a choice is ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1; columns that are the same for all are left out."""
    order = 8
    while order < n + 1:
        order *= 2
    i, j = np.arange(1, n + 1)[:, None], np.arange(1, order)[None, :]
    code = np.where(np.bitwise_count(i & j) % 2, 1, -1)
    return code[:, np.abs(code.sum(axis=0)) < n]


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of letters and word edges, each one's text, and
    whether a text has a letter."""
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    raw = [t.encode() for t in low]
    buf = np.frombuffer(b"\n".join(raw) + b"\n\n\n", np.uint8)
    letter = _LETTER[buf]
    flat = np.where(letter, buf, np.uint8(32)).astype(np.uint32)
    gram = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    at = np.flatnonzero(letter[1:-1])
    bucket = (gram[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])])
    doc = np.searchsorted(first, at + 1, "right") - 1
    has = np.zeros(len(texts), bool)
    ascii_letter = letter & (buf < 0x80)
    has[np.searchsorted(first, np.flatnonzero(ascii_letter), "right") - 1] = True
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in low[i])
    return bucket.astype(np.int64), doc, has


def _count(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
    """Rows (lang, row, bucket, n) with n the trigram's share of its text."""
    bucket, doc, _ = _trigrams(texts)
    size = 1 << BUCKET_BITS
    cell, n = np.unique(doc * size + bucket, return_counts=True)
    doc, bucket = cell // size, cell % size
    total = np.bincount(doc, n, len(texts))
    lang = batch.column("lang").take(pa.array(doc))
    return {"lang": lang, "bucket": bucket, "n": n / total[doc]}


class Model:
    """languages; code (languages x bits); weight (bits x buckets); trust of
    each bit: how far apart its classifier puts the training rows of its two
    sides on average, in relation to the other bits."""

    def __init__(self, languages: list[str], code: np.ndarray, weight: np.ndarray, apart: np.ndarray):
        self.languages, self.code, self.weight = languages, code, weight.astype(np.float32)
        self.trust = apart / max(apart.sum(), 1e-9) * len(apart)

    def margins(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bucket, doc, has = _trigrams(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        n = np.bincount(doc, minlength=len(texts))
        some = np.flatnonzero(n)
        if len(some):
            begin = (np.cumsum(n) - n)[some]
            for b in range(out.shape[1]):
                out[some, b] = np.add.reduceat(self.weight[b][bucket], begin, dtype=np.float64) / n[some]
        return out, has

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, posterior weight of the choice, its lead over the runner-up."""
        if len(self.languages) == 1 or not len(margins):
            return np.zeros(len(margins), int), np.ones(len(margins)), np.ones(len(margins))
        z = 4.0 * margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -z) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        best = np.take_along_axis(p, order[:, :2], axis=1)
        return order[:, 0], best[:, 0], best[:, 0] - best[:, 1]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on about sample_rows rows of each language, chosen by a hash of the key."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).cast("string").alias("key"))
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return None
    languages = sorted(have)
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_rows / have[name]))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) < rate[F.col("lang")] * F.lit(1 << 30))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.float64())])
    counted = chosen.select("lang", "text").mapInArrow(kernel.over_texts(_count, schema), "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    share = np.full((len(languages), 1 << BUCKET_BITS), 1e-6)
    index = {name: i for i, name in enumerate(languages)}
    np.add.at(share, ([index[x] for x in counted["lang"]], counted["bucket"].to_numpy()), counted["n"].to_numpy())
    share += 1e-5 * share.sum(axis=1, keepdims=True)
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weight = np.zeros((code.shape[1], share.shape[1]))
    apart = np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weight[b] = np.log(one) - np.log(other)
        apart[b] = ((one - other) * weight[b]).sum()
    return Model(languages, code, weight, apart)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, ambiguous, and the columns of keep.

    `und` with score 0 where the text is null, empty or has no letter, or
    nothing was learned.  Rows with a null doc_id and repeated rows give a row
    each.  Only doc_id, text and the columns of keep are read, and only the
    text decides.
    """
    names = ["doc_id", *keep]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("text"))
    ddl = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches):
        for batch, texts in kernel.pieces(batches, "text"):
            if model is None:
                name, score, lead = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                margins, has = model.margins(texts)
                best, p, lead = model.decode(margins)
                name = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, has, strict=True)]
                score = np.where(has, p, 0.0)
                lead = np.where(has, lead, 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(name, pa.string()), pa.array(score), pa.array(lead < AMBIGUOUS)], names=[*names, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, ddl)


def learned_and_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, out_fold: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score,
    ambiguous.  Fitted on the rows whose crc32(doc_id as text) modulo folds
    isn't out_fold and whose language and text aren't null.

    A null doc_id is never held out; an id may be of any type.  Null and empty
    texts, and texts without a letter, are `und`.  Repeated rows are learned
    from and predicted each; a tie between languages goes to the first by name.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == out_fold, F.lit(False))
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held_out"))
    model = fit(marked.where(~F.col("held_out")), "lang", "text", "doc_id")
    return identify(marked, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
