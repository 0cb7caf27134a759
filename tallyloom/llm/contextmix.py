"""Language-model scores by online logistic context mixing.

A text is a sequence of symbols: the bytes of its words in lower case, a blank
after each word, and one end.  Every symbol is a path of binary decisions in a
Huffman tree.  Predictors with hashed contexts (the two, four and seven symbols
before, across words; the beginning of the word; the same with the word before)
keep counts of both outcomes of every decision over the whole training corpus.
Their log-odds are mixed logistically, with weights chosen by the place in the
word.  Weights are refined online: every text begins with the same weights, and
each decision moves those that it was predicted with along the gradient of its
loss, before the next decision is read.  Texts are read side by side, so that a
step is one decision of many texts.  A text of more than SEGMENT symbols is read
in parts that begin with the first weights again, but see the symbols before.

A last predictor takes contexts of whole words: at every word with three words
before it in its text, it is first decided whether the word is the one that
followed them most often in the training corpus, with the odds of its count
there; if so, it isn't spelled: none of its decisions is made and no weight
moves.  These contexts number as the corpus does and never meet in one place.
Texts are dealt to buckets by a hash; a bucket sends each distinct pair of a
context and the word after it once, sorted, as differences, to the task of the
context's range of hashes, which answers with the loss of that decision.  What
a few contexts of very many words hold is counted by key and sent to every task.

The base score is a unigram model with exact counts.  Counts of frequent words
(at most 2**18, as their count is at least that share of all tokens) are sent
to every task; the others are asked for by hash, as the pairs are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import discard, kind_of, materialise

#: Bytes of text that are read side by side.
PIECE = 1 << 20
#: Symbols after which a text's weights begin anew.
SEGMENT = 1024
#: Symbols before a decision that are contexts; two more are the beginning of the word (its last eight
#: symbols and the place in it), alone and with the word before.
ORDERS = (2, 4, 7)
INPUTS = len(ORDERS) + 3  # the two of words, and a constant
#: Slots of each predictor's hashed table, as a power of two.
SLOT_BITS = (18, 21, 21, 21, 21)
GATES = 4
#: First weight of each predictor, and how far a decision moves the weights.
FIRST_WEIGHTS = (0.25, 0.25, 0.25, 0.25, 0.25, 0.0)
RATE = 0.02
#: Words of a whole-word context.
BEFORE = 3
#: Bytes of text of a bucket, of a task that counts pairs or scores, and of one that counts outcomes.
BUCKET, SHARE, LEARN = 1 << 21, 1 << 25, 1 << 28
#: Words after which a whole-word context is counted by key, and those in a piece from which it is looked for.
HOT, MANY = 1 << 20, 256
#: Words of pieces whose counts a task merges before it hands them on.
_MERGED = 1 << 21
FREQUENT_BITS = 18
_STOP, _END = 0x20, 0x0A
_CHUNK = 4096
_SCALE = 16.0
_FIRST = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
#: Decisions that are taken together from the inputs, and symbols whose decisions are looked up together.
_BLOCK, _MANY = 1 << 14, 1 << 13


class Code:
    """Huffman code of the 256 byte values: first[s] .. first[s + 1] are the
    positions in step of the decisions of symbol s, each 2 * node + outcome."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, int] = {}
        for k in range(255):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = 2 * k, 2 * k + 1
            heapq.heappush(heap, (a + b, 256 + k))
        step, first = [], [0]
        for s in range(256):
            path, at = [], s
            while at in up:
                path.append(up[at])
                at = 256 + up[at] // 2
            step += reversed(path)
            first.append(len(step))
        self.step, self.first = np.array(step, np.int16), np.array(first, np.int32)
        self.size = np.diff(self.first)

    def decisions(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each decision its symbol's position, and 2 * node + outcome; and how many each symbol has."""
        n = self.size[symbol]
        begin = np.cumsum(n, dtype=np.int32) - n
        spot = np.repeat(self.first[symbol] - begin, n)
        spot += np.arange(len(spot), dtype=np.int32)
        return np.repeat(np.arange(len(n), dtype=np.int32), n), self.step[spot], n


class Vocabulary:
    """Distinct words of a piece: hash, of (each token's word), and count."""

    def __init__(self, texts: list[bytes]):
        self.words = w = kernel.Words(texts, lower=True)
        self.token = w.hashes()
        self.hash, self.of, self.count = np.unique(self.token, return_inverse=True, return_counts=True)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        return _anchors(self.words, self.token)


def _anchors(words: kernel.Words, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with a whole-word context, and its hash."""
    ctx, first = kernel.grams(token, words.at, BEFORE)
    at = first + BEFORE
    go = at < words.at[words.doc[first] + 1]
    return at[go], ctx[go]


def _member(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are among the sorted values, and where."""
    if not len(of):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    spot = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[spot] == x, spot


def _in_order(key: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and low, and which are the first of equal ones there."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    both = np.cumsum(new) << 16 | low[order]
    again = np.argsort(both, kind="stable")  # nearly sorted
    both = both[again]
    new[1:] = both[1:] != both[:-1]
    return order[again], new


class Pairs:
    """The distinct pairs of a whole-word context and the word after it, but for
    the contexts in hot: key (48 bits of the context, 16 of the word) and low (16
    more of the word), in order; at, ctx: tokens with a context, and it; cold:
    which of them are in pairs, and of: in which."""

    def __init__(self, words: kernel.Words, token: np.ndarray, hot: np.ndarray):
        self.at, self.ctx = _anchors(words, token)
        self.cold = ~_member(self.ctx, hot)[0]
        word = token[self.at[self.cold]]
        key = self.ctx[self.cold] >> np.uint64(16) << np.uint64(16) | word >> np.uint64(48)
        low = (word >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16)
        order, new = _in_order(key, low)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.key, self.low = key[order[new]], low[order[new]]


def _ranges(key: np.ndarray, parts: int) -> np.ndarray:
    """Where each of so many ranges of hashes begins in the sorted ones, and the end."""
    return np.searchsorted((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


_ZSTD = pa.Codec("zstd", 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """The bytes of the arrays, those of one place in the number beside each other."""
    return _ZSTD.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), asbytes=True)


def _unpack(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    width = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(_ZSTD.decompress(raw, n * sum(width), asbytes=True), np.uint8).reshape(-1, n)
    cut = np.cumsum([0, *width])
    return [np.ascontiguousarray(planes[lo:hi].T).view(k).ravel() for k, lo, hi in zip(kinds, cut, cut[1:], strict=False)]


#: Zeros before each text, so that its contexts hold nothing of the one before.
_PAD = 8


class Stream:
    """The symbols of texts one after the other, each after _PAD zeros: symbol;
    first, last: where each text begins, and one past its end; begin: each
    word's first symbol."""

    def __init__(self, words: kernel.Words, token: np.ndarray | None = None):
        w, n = words, len(words.count)
        size = w.end - w.start
        self.begin = np.cumsum(size + 1) - (size + 1) + w.doc * (_PAD + 1) + _PAD
        total = np.concatenate([[0], np.cumsum(size + 1)])[w.at]
        self.first = total[:-1] + np.arange(n) * (_PAD + 1) + _PAD
        self.last = total[1:] + np.arange(n) * (_PAD + 1) + _PAD + 1
        symbol = np.full(self.last[-1], _STOP, np.uint8)
        for k in range(_PAD):
            symbol[self.first - 1 - k] = 0
        symbol[self.last - 1] = _END
        inside = symbol == _STOP
        inside[self.begin + size] = False
        symbol[inside] = w.buf[~kernel._SPACE[w.buf]]
        self.symbol = symbol
        # the end of a text is a word of its own, and so is what is between the texts
        start = np.concatenate([self.begin, self.last - 1, self.first - _PAD])
        before = np.zeros(len(start), np.uint64)
        token = w.hashes() if token is None else token
        before[1 : len(token)] = token[:-1]
        some = w.count > 0
        before[w.at[:-1][some]] = 0
        before[len(token) : len(token) + n][some] = token[w.at[1:][some] - 1]
        order = np.argsort(start, kind="stable")
        start, self._before = start[order], before[order]
        self._size = np.diff(np.append(start, len(symbol)))
        self.place = np.arange(len(symbol), dtype=np.int32) - np.repeat(start.astype(np.int32), self._size)

    def positions(self) -> np.ndarray:
        """Where the texts' symbols are, without what is between them."""
        size = self.last - self.first
        return np.arange(size.sum(), dtype=np.int32) + np.repeat((self.first - (np.cumsum(size) - size)).astype(np.int32), size)

    def contexts(self, at: np.ndarray | None = None) -> list[np.ndarray]:
        """For each predictor the slot, less the part of the decision, at every symbol or those at the positions."""
        raw = np.concatenate([np.zeros(_PAD, np.uint8), self.symbol])
        before = np.repeat(kernel.mix(self._before + np.uint64(11)), self._size)
        n = len(self.symbol)
        whole, place = np.ndarray(n, "<u8", raw, strides=(1,)), self.place  # the eight symbols before each
        if at is not None:
            whole, place, before = whole[at], place[at], before[at]
        out = [np.empty(len(place), np.int32) for _ in SLOT_BITS]
        for i in range(0, len(place), _BLOCK):  # blocks stay in the cache
            here = slice(i, i + _BLOCK)
            eight = whole[here].copy()
            for k, bits, to in zip(ORDERS, SLOT_BITS, out, strict=False):
                to[here] = _slot(eight >> np.uint64(64 - 8 * k), bits)
            inside = np.minimum(place[here], 8).astype(np.uint64)
            prefix = eight >> (np.uint64(63) - inside * np.uint64(8) + (inside > 0))
            prefix *= inside > 0
            prefix += np.minimum(place[here], 40).astype(np.uint64) << np.uint64(58)
            out[-2][here] = _slot(kernel.mix(prefix), SLOT_BITS[-2])
            prefix += before[here]
            out[-1][here] = _slot(kernel.mix(prefix), SLOT_BITS[-1])
        return out


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


class Model:
    """code; table: log-odds in sixteenths for every slot of each predictor.

    The slot of a decision is its context's, by exclusive or with its node (less
    than 256): the nodes of one context have slots of their own, near each other."""

    def __init__(self, code: Code, table: np.ndarray, weights: tuple[float, ...] = FIRST_WEIGHTS, rate: float = RATE):
        self.code, self.weights, self.rate = code, weights, rate
        self.tables = [table[lo:hi] for lo, hi in zip(_FIRST, _FIRST[1:], strict=False)]

    def _inputs(self, symbol: np.ndarray, contexts: list[np.ndarray], many: int) -> np.ndarray:
        """Eight bytes for each decision of the symbols: the predictors' log-odds, a constant, and the outcome."""
        out = np.zeros((many, 8), np.int8)
        out[:, INPUTS - 1] = _SCALE / 4
        done = 0
        # a symbol's decisions in one context are beside each other in a table
        for i in range(0, len(symbol), _MANY):
            at, step, _ = self.code.decisions(symbol[i : i + _MANY])
            at, node = at.astype(np.intp), (step >> 1).astype(np.intp)
            part = out[done : done + len(at)]
            part[:, -1] = step & 1
            for k, (table, context) in enumerate(zip(self.tables, contexts, strict=True)):
                slot = context[i : i + _MANY].astype(np.intp).take(at)
                slot ^= node
                part[:, k] = table.take(slot)
            done += len(at)
        return out.view(np.int64).ravel()

    def losses(self, stream: Stream, segment: int = SEGMENT, spelled: np.ndarray | None = None) -> np.ndarray:
        """Minus the log-probability of each symbol, given those before it (0 between texts).

        Of symbols that aren't spelled (all between texts, if given) no decision is made; parts are of those that are.

        The weights of a gate are moved by that gate's decisions alone, so the
        decisions of each text (or part of one) and gate are a lane of their
        own, and a step takes the next decision of every lane."""
        if spelled is None:
            position, size = stream.positions(), stream.last - stream.first
        else:
            position = np.flatnonzero(spelled).astype(np.int32)
            size = np.searchsorted(position, stream.last) - np.searchsorted(position, stream.first)
        out = np.zeros(len(stream.symbol), np.float32)
        if not len(position):
            return out
        parts = -(-size // segment)
        gone = np.cumsum(size) - size
        lane = (np.arange(len(position), dtype=np.int32) - np.repeat(gone.astype(np.int32), size)) // np.int32(segment)
        lane += np.repeat((np.cumsum(parts) - parts).astype(np.int32), size)
        lane = lane * np.int32(GATES) + np.minimum(stream.place[position], GATES - 1)
        lanes = int(parts.sum()) * GATES
        order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
        position, lane = position[order], lane[order]
        symbol = stream.symbol[position]
        n = self.code.size[symbol]
        look = self._inputs(symbol, stream.contexts(position), int(n.sum()))
        length = np.bincount(lane, n, lanes).astype(np.int64)
        start = np.cumsum(length) - length
        # the longest come first, so that those still read are the first ones
        first = np.argsort(-length, kind="stable")
        start, length = start[first].astype(np.int32), length[first]
        longest = int(length[0])
        live = np.searchsorted(-length, -np.arange(longest), "left")  # lanes longer than each step
        # log-odds stay in sixteenths, so weights are in sixteenths too, and moves in their squares;
        # weights and their sums are halves, as a probability is half of 1 + tanh of that
        weight = np.repeat(np.array(self.weights, np.float32)[:, None], live[0], axis=1) / np.float32(2 * _SCALE)
        rate = np.float32(self.rate / _SCALE**2 / 4)
        tanh, multiply, subtract, add, sums = np.tanh, np.multiply, np.subtract, np.add, np.einsum
        last = 0
        moved = np.empty_like(weight)
        loss = np.empty(len(look), np.float32)
        t = 0
        while t < longest:
            stop = min(longest, t + max(1, _BLOCK // int(live[t])))
            many = live[t:stop].tolist()
            here = np.concatenate([start[:m] + np.int32(k) for k, m in zip(range(t, stop), many, strict=True)])
            seen = look.take(here).view(np.int8).reshape(-1, 8).T
            x = seen[:INPUTS].astype(np.float32, order="C")
            one = seen[-1].astype(np.float32)
            goal = (2 * one - 1) * rate
            half = np.empty(len(here), np.float32)
            lo = 0
            for m in many:
                hi = lo + m
                if m != last:
                    w, move, last = weight[:, :m], moved[:, :m], m
                part, z = x[:, lo:hi], half[lo:hi]
                sums("kd,kd->d", w, part, out=z)
                np.minimum(z, 6, out=z)
                np.maximum(z, -6, out=z)
                error = tanh(z)
                multiply(error, rate, out=error)
                subtract(goal[lo:hi], error, out=error)
                multiply(part, error, out=move)
                add(w, move, out=w)
                lo = hi
            odds = half * (2 - 4 * one)
            np.exp(odds, out=odds)
            odds += 1
            loss[here] = np.log(odds, out=odds)
            t = stop
        out[position] = np.add.reduceat(loss, np.cumsum(n) - n)
        return out


def _held(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _counts(many: int):
    def run(batches):
        """(kind, key, n): 0 tokens of a word hash, 1 symbols, 2 ends, 3 words after a whole-word context that has many in a piece."""
        held: list[tuple] = []
        symbols, ends, size = np.zeros(256, np.int64), 0, 0

        def emit():
            hashes, of = np.unique(np.concatenate([h for h, *_ in held]), return_inverse=True)
            count = np.zeros(len(hashes), np.int64)
            np.add.at(count, of, np.concatenate([c for _, c, *_ in held]))
            ctx, times = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            kind = np.repeat(np.arange(4, dtype=np.int8), [len(hashes), 256, 1, len(ctx)])
            key = np.concatenate([hashes.view(np.int64), np.arange(256), [0], ctx.view(np.int64)])
            n = np.concatenate([count, symbols, [ends], times]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(n)], names=["kind", "key", "n"])

        for _, texts in kernel.pieces(batches, "text", PIECE):
            v = Vocabulary(texts)
            buf, space = v.words.buf, kernel._SPACE[v.words.buf]
            symbols += np.bincount(buf[~space], minlength=256)
            symbols[_STOP] += len(v.token)
            symbols[_END] += len(texts)
            ends += len(texts)
            ctx = np.sort(v.anchors()[1])
            begin = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])[: len(ctx)])
            times = np.diff(begin, append=len(ctx))
            go = times >= many
            held.append((v.hash, v.count, ctx[begin[go]], times[go]))
            size += len(v.hash)
            if size >= _MERGED:
                yield emit()
                held, size, ends = [], 0, 0
                symbols[:] = 0
        if held:
            yield emit()

    return run


def _after(hot: np.ndarray):
    """(ctx, word, n): words after the contexts in hot."""

    def run(batches):
        for _, texts in kernel.pieces(batches, "text", PIECE):
            v = Vocabulary(texts)
            at, ctx = v.anchors()
            go = _member(ctx, hot)[0]
            ctx, word = ctx[go], v.token[at[go]]
            _, one, n = np.unique(kernel.mix(ctx + kernel.mix(word)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ctx[one].view(np.int64)), pa.array(_signed(word[one])), pa.array(n.astype(np.int64))], names=["ctx", "word", "n"])

    return run


def _signed(word: np.ndarray) -> np.ndarray:
    """Numbers in the same order."""
    return (word ^ np.uint64(1 << 63)).view(np.int64)


def _loss(hits: np.ndarray, times: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The loss of the decision for a whole word, less than 0 if it isn't the best one, 0 if there is none."""
    p = (hits + 0.4) / (times + 0.8)
    return np.where(times > 0, np.where(best, -np.log(p), np.log1p(-p)), 0.0).astype(np.float32)


def _gather(batches):
    """(bucket, rows): the rows of each bucket in a batch, as an Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
        rest, out = batch.drop_columns(["bucket"]), []
        for lo, hi in zip(begin, np.append(begin[1:], len(bucket)), strict=True):
            part = rest.take(pa.array(order[lo:hi]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                writer.write_batch(part)
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(out, pa.binary())], names=["bucket", "rows"])
    batch = rest = part = None
    kernel.release()


def _rows(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The rows of a bucket, and their texts (null: empty)."""
    rows = pa.concat_tables([pa.ipc.open_stream(raw).read_all() for raw in table.column("rows").to_pylist()])
    return rows, [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]


def _asked(parts: int, hot: np.ndarray, frequent: np.ndarray):
    """(part, bucket, n, sent): for each range of contexts a bucket's pairs, and how often each is
    learned (part 0 to parts - 1), and for each range of words its words that aren't frequent (parts and more)."""

    def run(table: pa.Table) -> pa.Table:
        rows, texts = _rows(table)
        v = Vocabulary(texts)
        learned = ~rows.column("held_out").to_numpy()[v.words.doc]
        pairs = Pairs(v.words, v.token, hot)
        n = np.bincount(pairs.of[learned[pairs.at[pairs.cold]]], minlength=len(pairs.key)).astype(np.uint32)
        rare = ~_member(v.hash, frequent)[0]
        word, times = v.hash[rare], np.bincount(v.of[learned], minlength=len(v.hash))[rare].astype(np.uint32)
        part, many, raw = [], [], []
        for first, key, more in ((0, pairs.key, (pairs.low, n)), (parts, word, (times,))):
            bound = _ranges(key, parts).tolist()
            for k, (lo, hi) in enumerate(zip(bound, bound[1:], strict=False)):
                if lo < hi:
                    part.append(first + k)
                    many.append(hi - lo)
                    raw.append(_pack(np.diff(key[lo:hi], prepend=np.uint64(0)), *(x[lo:hi] for x in more)))
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array(part, pa.int32()), pa.array([bucket] * len(part), pa.int64()), pa.array(many, pa.int32()), pa.array(raw, pa.binary())], names=["part", "bucket", "n", "sent"])

    return run


def _answered(parts: int):
    """(bucket, part, n, told): what is decided of the pairs, and the counts of the words."""

    def run(table: pa.Table) -> pa.Table:
        many, raw = table.column("n").to_pylist(), table.column("sent").to_pylist()
        if table.column("part")[0].as_py() < parts:
            sent = [_unpack(x, n, "<u8", "<u2", "<u4") for x, n in zip(raw, many, strict=True)]
        else:
            sent = [_unpack(x, n, "<u8", "<u4") for x, n in zip(raw, many, strict=True)]
        key = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent])
        learned = np.concatenate([x[-1] for x in sent]).astype(np.int64)
        if len(sent[0]) == 3:
            told = _decided(key, np.concatenate([x[1] for x in sent]), learned)
        else:
            _, of = np.unique(key, return_inverse=True)
            total = np.zeros(of.max() + 1, np.int64)
            np.add.at(total, of, learned)
            told = total[of]
        told = [_pack(x) for x in np.split(told, np.cumsum(many)[:-1])]
        return pa.table([table.column("bucket"), table.column("part"), table.column("n"), pa.array(told, pa.binary())], names=["bucket", "part", "n", "told"])

    return run


def _decided(key: np.ndarray, low: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """For each pair that was sent one number, small for small counts: of times t and hits h of
    its context t (t + 1) / 2 + h, twice, and one more if its word is the best one."""
    order, new = _in_order(key, low)
    begin = np.flatnonzero(new)
    n = np.add.reduceat(learned[order], begin)
    ctx = key[order[begin]] >> np.uint64(16)
    first = np.concatenate([[True], ctx[1:] != ctx[:-1]])
    of, first = np.cumsum(first) - 1, np.flatnonzero(first)
    times, hits = np.add.reduceat(n, first), np.maximum.reduceat(n, first)
    best = np.zeros(len(first), np.int64)
    np.maximum.at(best, of, np.where(n == hits[of], np.arange(len(n)), 0))
    number = (times * (times + 1) + 2 * hits)[of]
    number += best[of] == np.arange(len(n))
    out = np.empty(len(key), np.int64)
    out[order] = number[np.cumsum(new) - 1]
    return out


def _losses(number: np.ndarray) -> np.ndarray:
    """The losses of the decisions that the numbers tell of."""
    both = number >> 1
    times = ((np.sqrt(8.0 * both + 1) - 1) / 2).astype(np.int64)
    times -= times * (times + 1) // 2 > both
    times += (times + 1) * (times + 2) // 2 <= both
    return _loss(both - times * (times + 1) // 2, times, (number & 1).astype(bool))


def _told(answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The losses of a bucket's pairs and the counts of its words, in order."""
    numbers, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, n, raw in sorted(zip(*(answers.column(k).to_pylist() for k in ("part", "n", "told")), strict=True)):
        (numbers if part < parts else counts).append(_unpack(raw, n, "<i8")[0])
    return _losses(np.concatenate(numbers)), np.concatenate(counts)


#: Decisions after which a task hands on its counts, before they could exceed 32 bits.
_MOST = 1 << 30


def _add(total: np.ndarray, code: Code, stream: Stream) -> int:
    """Add the outcomes of the symbols' decisions to the table of counts; how many there are.

    Symbols that are alike in slot are counted first, and their decisions added once."""
    real = stream.positions()
    between = np.ones(len(stream.symbol), bool)
    between[real] = False
    steps = [code.step[lo:hi].tolist() for lo, hi in zip(code.first, code.first[1:], strict=False)]
    most = max(SLOT_BITS)
    symbol = stream.symbol.astype(np.uint32) << np.uint32(most)
    for context, lo, hi in zip(stream.contexts(), _FIRST, _FIRST[1:], strict=False):
        key = symbol | context.view(np.uint32)
        key[between] = 0xFFFFFFFF  # greater than any other
        key.sort()
        key = key[: len(real)]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        times = np.diff(begin, append=len(key)).astype(np.int32)
        key = key[begin]
        edge = np.searchsorted(key, np.arange(257, dtype=np.uint64) << np.uint64(most)).tolist()
        slot = (key & np.uint32((1 << most) - 1)).astype(np.intp)
        slot += slot
        part = total[2 * lo : 2 * hi]
        for s in np.flatnonzero(np.diff(edge)).tolist():
            here, n = slot[edge[s] : edge[s + 1]], times[edge[s] : edge[s + 1]]
            for step in steps[s]:
                np.add.at(part, here ^ step, n)
    return int(code.size[stream.symbol[real]].sum())


def _outcomes(code: Code):
    def run(batches):
        """(chunk, plane, counts) of the outcomes of all decisions of a
        partition: the counts of a chunk of slots, one byte of them a plane."""
        total = np.zeros(2 * _FIRST[-1], "<i4")
        seen = 0

        def emit():
            bytes_ = total.view(np.uint8).reshape(-1, _CHUNK, 4)
            for plane in range(4):
                for i in range(0, len(bytes_), 256):
                    part = np.ascontiguousarray(bytes_[i : i + 256, :, plane])
                    go = np.flatnonzero(part.any(axis=1)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([i + c for c in go], pa.int32()), pa.array([plane] * len(go), pa.int32()), pa.array([part[c].tobytes() for c in go], pa.binary())], names=["chunk", "plane", "counts"])

        for _, texts in kernel.pieces(batches, "text", 2 * PIECE):  # the more, the more symbols are alike
            stream = Stream(kernel.Words(texts, lower=True))
            seen += _add(total, code, stream)
            if seen >= _MOST:
                yield from emit()
                total[:], seen = 0, 0
        if seen:
            yield from emit()

    return run


def _odds(batches):
    """(chunk, odds): each chunk's log-odds in sixteenths."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, plane, raw in zip(*(batch.column(k).to_pylist() for k in ("chunk", "plane", "counts")), strict=True):
            part = np.frombuffer(raw, np.uint8).astype(np.int64) << 8 * plane
            total[c] = total[c] + part if c in total else part
    for c, x in total.items():
        odds = np.log((x[1::2] + 0.4) / (x[0::2] + 0.4))
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.clip(np.round(odds * _SCALE), -127, 127).astype(np.int8).tobytes()], pa.binary())], names=["chunk", "odds"])


def train(rows: DataFrame, symbols: np.ndarray, size: int) -> Model:
    """The model of the texts of rows (column text), which have size bytes at most."""
    code = Code(symbols)
    # every task hands on a table of its own, so they are no more than the cores unless that is too much text
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("text").coalesce(cores * max(1, -(-size // (LEARN * cores)))).mapInArrow(_outcomes(code), "chunk int, plane int, counts binary")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = np.zeros(_FIRST[-1], np.int8)
    # one byte for each slot of the tables, however large the corpus
    for r in parts.repartition(n, "chunk").mapInArrow(_odds, "chunk int, odds binary").collect():
        table[r.chunk * _CHUNK // 2 :][: _CHUNK // 2] = np.frombuffer(r.odds, np.int8)
    return Model(code, table)


def _score(model: Model, frequent: np.ndarray, counts: np.ndarray, hot: np.ndarray, after: np.ndarray, parts: int, id_type: str):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, texts = _rows(table)
        v = Vocabulary(texts)
        w, n = v.words, len(texts)
        pairs = Pairs(w, v.token, hot)
        told, rare = _told(answers, parts)
        often, spot = _member(v.hash, frequent)
        if len(told) != len(pairs.key) or len(rare) != len(v.hash) - often.sum():
            raise RuntimeError("the table changed while it was read")
        c = np.empty(len(v.hash), np.int64)
        c[often], c[~often] = counts[spot[often]], rare
        base = np.bincount(w.doc, np.log10(c + 1.0)[v.of], n).astype(np.float64)  # integers where there are no words
        known = np.bincount(w.doc, (c > 0)[v.of], n).astype(np.int64)
        whole = np.empty(len(pairs.at), np.float32)
        whole[pairs.cold] = told[pairs.of]
        at, spot = pairs.at[~pairs.cold], _member(pairs.ctx[~pairs.cold], hot)[1]
        if len(at):
            whole[~pairs.cold] = _loss(after["hits"][spot], after["times"][spot], after["best"][spot] == _signed(v.token[at]))
        stream = Stream(w, v.token)
        spelled = np.ones(len(stream.symbol), bool)
        at = pairs.at[whole > 0]
        size = (w.end - w.start)[at] + 1
        spelled[np.arange(size.sum()) + np.repeat(stream.begin[at] - (np.cumsum(size) - size), size)] = False
        nats = np.bincount(w.doc[pairs.at], np.abs(whole), n).astype(np.float64)
        for k in range(_PAD):
            spelled[stream.first - 1 - k] = False
        position = np.flatnonzero(spelled)
        first, last = np.searchsorted(position, stream.first), np.searchsorted(position, stream.last)
        # texts of about PIECE spelled symbols are read side by side; each has one, its end
        group = (last - 1) // PIECE
        for g in np.unique(group).tolist():
            here = np.flatnonzero(group == g)
            lo, hi = first[here[0]], last[here[-1]]
            go = np.zeros(len(spelled), bool)
            go[position[lo:hi]] = True
            loss = model.losses(stream, spelled=go)[position[lo:hi]]
            nats[here] += np.add.reduceat(loss, first[here] - lo, dtype=np.float64)
        ids = rows.column("doc_id")
        if pa.types.is_timestamp(ids.type) and ids.type.tz:  # the same instants, as Spark takes them back
            ids = ids.cast(pa.timestamp("us", "UTC"))
        return pa.table(
            [ids, rows.column("held_out"), pa.array(w.count + 1), pa.array(stream.last - stream.first), pa.array(base), pa.array(known), pa.array(nats)],
            names=["doc_id", "held_out", "n_tokens", "n_bytes", "base", "known", "nats"],
        )

    return run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_bytes long, base double, known long, nats double"


def _hot_words(learned: DataFrame, hot: np.ndarray) -> np.ndarray:
    """times, hits and best word of each of the contexts."""
    out = np.zeros(len(hot), [("times", np.int64), ("hits", np.int64), ("best", np.int64)])
    if len(hot):
        pairs = learned.select("text").mapInArrow(_after(hot), "ctx long, word long, n long").groupBy("ctx", "word").agg(F.sum("n").alias("n"))
        for r in pairs.groupBy("ctx").agg(F.sum("n").alias("times"), F.max(F.struct("n", "word")).alias("top")).collect():
            out[np.searchsorted(hot, np.array([r.ctx], np.int64).view(np.uint64))] = r.times, r.top.n, r.top.word
    return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte (of the bytes that are
    predicted: words, one blank after each, and the end).

    Learned are the rows whose crc32(doc_id as text) modulo 7 isn't 2; a null
    doc_id is learned from; an id may be of any type.  Null or empty text is its
    end alone.  Repeated rows count and are scored each; an empty table gives
    none.  With nothing to learn from, all counts are zero and every decision is
    even.  Words are told apart by 64-bit hashes, whole-word contexts by 48 bits
    and the words after one by 32 bits, contexts of the mixed predictors by their
    slot.  Contexts that are followed by more than hot words are counted by key.
    Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", _held("doc_id"))
    learned = rows.where(~F.col("held_out"))
    counted = materialise(learned.select("text").mapInArrow(_counts(min(MANY, hot)), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counted.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    total = counted.where("kind in (0, 2)").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, distinct = total.n or 0, total.v
    symbols = np.zeros(256, np.int64)
    for r in counted.where("kind = 1").collect():
        symbols[r.key] = r.n
    ends = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-n >> FREQUENT_BITS))
    often = words.where(F.col("c") >= least).toPandas()
    h = often["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    frequent, counts = h[order], often["c"].to_numpy(np.int64)[order]
    # at most one context for every `hot` words of the corpus
    heavy = np.sort(np.array([r.key for r in counted.where(F.col("n") > hot).where("kind = 3").collect()], np.int64).view(np.uint64))
    discard(counted)
    after = _hot_words(learned, heavy)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(learned.select("text"), symbols, size)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(-(-size // BUCKET) + 1)).alias("bucket")
    dealt = rows.select("doc_id", "text", "held_out", bucket).mapInArrow(_gather, "bucket long, rows binary").repartition(parts, "bucket")
    asked = dealt.groupBy("bucket").applyInArrow(_asked(2 * parts, heavy, frequent), "part int, bucket long, n int, sent binary").repartition(parts, "part")
    answers = asked.groupBy("part").applyInArrow(_answered(2 * parts), "bucket long, part int, n int, told binary").repartition(parts, "bucket")
    found = materialise(dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(*_score(model, frequent, counts, heavy, after, 2 * parts, kind_of(docs, doc_id))))
    unit = float(np.log10(n + distinct + 1))
    end = float(np.log10(ends + 1))
    nats = F.col("nats")
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + end - F.col("n_tokens") * unit).alias("base_score"),
        (-nats / float(np.log(10))).alias("score"),
        (nats / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
