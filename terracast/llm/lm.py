"""Language-model scoring with a log-bilinear network trained by noise-contrastive estimation.

Tokens are blank-separated words, A-Z lower-cased, and an end for each text. Counts of all training words
come from one shuffle. The most frequent words, `GROWTH` times the square root of the training tokens if seen `FLOOR`
times, have vectors of their own, as context and as target: the tables grow with the input, and more slowly than
it. All words fall into `CLASSES` classes by their last bytes and length; the words with vectors, in order of class
and falling count, are cut into groups of about the square root of their number.
The network first predicts the most frequent words, the groups, and the rest of each class; then the word
inside the group:

    P(word | context) = P(symbol | context) * P(word | symbol, context)

The second factor is 1 for the most frequent words and a softmax over the words of a group. In the rest of a
class, words without vectors, it is (count + 1) / (tokens of the rest + words of the rest + 1), with one share
for all words not seen. The network is log-bilinear: position matrices map the vectors of the last `CONTEXT`
words into a predicted vector, whose product with a target vector, plus a bias, is the score. Training tells
true symbols from noise of the unigram distribution, and true words from noise in their group, in numpy, each
task on its own documents, in rounds whose parameters are averaged; every training document takes part once.
Scoring normalises over all symbols, and over the group, with batched matrix products, so the shares of all
known words and the unknown ones sum to one.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracast.llm import words as wd
from terracast.llm.storage import first_uid, reliable_cut

OWN = 128
CLASSES = 128
SYMBOLS = OWN + CLASSES
CONTEXT = 5
WIDTH = 16
NOISE = 24
INSIDE = 6  # noise words of a group for each token
GROWTH = 3  # words with vectors, as a multiple of the square root of the training tokens
FLOOR = 20  # a word with vectors has been seen as often
BLOCK = 4096  # rows of a table that tasks average together
BATCH = 4096
SCORED = 1024  # the logits of a batch stay in the processor's cache
RATE = 0.05
HEAD = 1 << 18
STEPS = 8  # from the first word of a range on; past that a search by halves
#: parts of the training documents in each round
ROUNDS = (1, 3, 12)
END = np.uint64(0x0E4D0E4D0E4D0E4D)


def word_class(w: wd.Words) -> np.ndarray:
    """Class of each word from its last two bytes and whether it is long."""
    last = w.data[w.end - 1].astype(np.int64)
    size = w.end - w.start
    prior = np.where(size > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + prior * 17 + (size >= 8)) % CLASSES


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, text) of the tokens of each text in order; an end has the hash END and class 0."""
    w = wd.split(data, at, wd.SPACED)
    place = np.arange(len(w.row)) + w.row
    n = len(w.row) + w.rows
    h, c, r = np.full(n, END, dtype=np.uint64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    h[place], c[place], r[place] = w.hashes(), word_class(w), w.row
    ends = np.ones(n, dtype=bool)
    ends[place] = False
    r[ends] = np.arange(w.rows)
    return h, c, r


@dataclass
class Vocabulary:
    """What tasks need of the counts: the most frequent words, symbols, classes.

    Symbols: the most frequent words (below OWN), the rest of each class (below SYMBOLS), SYMBOLS for "before
    the text", then the words of the groups.
    """

    total: int
    distinct: int
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    own: np.ndarray  # sorted hashes of words with a symbol of their own
    own_symbol: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    unigram: np.ndarray = field(default_factory=lambda: np.full(SYMBOLS, 1 / SYMBOLS))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first word of each group, and their number

    def symbols(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = np.minimum(self._own_place(h), len(self.own) - 1)
        return np.where(self.own.take(at) == h, self.own_symbol.take(at), OWN + c)

    def _own_place(self, h: np.ndarray) -> np.ndarray:
        """np.searchsorted(own, h), from the first place of each range of the leading bits."""
        if not hasattr(self, "_first"):
            bits = int(len(self.own)).bit_length() + 3
            self._shift = np.uint64(64 - bits)
            self._first = np.searchsorted(self.own, np.arange(1 << bits, dtype=np.uint64) << self._shift)
            self._limit = np.append(self.own, np.uint64(2**64 - 1))
        at = self._first.take((h >> self._shift).astype(np.int64))
        behind = np.flatnonzero(self._limit.take(at) < h)
        for _ in range(STEPS):
            if not len(behind):
                return at
            at[behind] += 1
            behind = behind[self._limit.take(at.take(behind)) < h.take(behind)]
        at[behind] = np.searchsorted(self.own, h.take(behind))
        return at

    def count_by_symbol(self) -> np.ndarray:
        """Count of the word of each symbol; 0 for the rest of a class and a word that isn't in `hashes`."""
        out = np.zeros(SYMBOLS + 1 + int(self.begin[-1]), dtype=np.int64)
        out[self.own_symbol] = self.lookup(self.own)
        return out

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Count of each hash, 0 if it isn't in `hashes`."""
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes.take(at) == h, self.counts.take(at), 0)


def count_words(texts: DataFrame) -> DataFrame:
    """hash, cls, n of every token of the column `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for _, _, data, at in wd.runs(b.column(0)):
                h, c, _ = tokens(data, at)
                held.append(_merged([(h, c, np.ones(len(h), dtype=np.int64))]))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield _count_rows(*held[0])
                        held, size = [], 0
        if held:
            yield _count_rows(*_merged(held))

    partial = texts.mapInArrow(count, "hash bigint, cls int, n bigint")
    return partial.groupBy("hash").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def _merged(held: list[tuple]) -> tuple:
    """(hash, class, count) of the distinct hashes; equal hashes have equal classes."""
    h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h = h.take(order)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), dtype=bool), h[1:] != h[:-1]]))
    return h[first], c[order[first]], np.add.reduceat(n.take(order), first) if len(h) else n


def _count_rows(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], names=["hash", "cls", "n"])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the stored counts. The driver gets HEAD words, or those with vectors if they are more, and one row per class."""
    end = int(END.view(np.int64))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("hash") == end, F.col("n"))), F.lit(0))).first()
    modelled = OWN + int(GROWTH * np.sqrt(sums[0]))
    top = counts.orderBy(F.desc("n"), "hash").limit(max(HEAD, modelled)).toArrow()
    h, c, n = (top.column(k).to_numpy() for k in ("hash", "cls", "n"))
    order = np.lexsort((h, -n))
    h, c, n = h[order], c[order], n[order]
    h = h.view(np.uint64) if len(h) else np.zeros(0, np.uint64)
    words = np.flatnonzero(h != END)
    words, more = words[: OWN - 1], words[OWN - 1: modelled]
    more = more[n[more] >= FLOOR]
    more, begin = grouped(more, c[more])
    own = np.concatenate([[END], h[words], h[more]]).astype(np.uint64)
    symbol = np.concatenate([np.arange(len(words) + 1), SYMBOLS + 1 + np.arange(len(more))])
    by_class = counts.where(F.col("hash") != end).groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).collect()
    tokens_in, words_in = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k, a, b in by_class:
        tokens_in[k], words_in[k] = a, b
    vectors = np.concatenate([words, more])
    np.subtract.at(tokens_in, c[vectors], n[vectors])
    np.subtract.at(words_in, c[vectors], 1)
    own_counts = np.concatenate([[sums[2]], n[words], np.zeros(OWN - 1 - len(words), np.int64)])
    in_groups = np.add.reduceat(n[more], begin[:-1]) if len(more) else np.zeros(0, np.int64)
    unigram = np.concatenate([own_counts, tokens_in, in_groups]) + 1.0
    order, by_hash = np.argsort(own), np.argsort(h)
    return Vocabulary(int(sums[0]), int(sums[1]), h[by_hash], n[by_hash], own[order], symbol[order], tokens_in, words_in, unigram / unigram.sum(), begin)


def grouped(words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words by group, first of each group and their number): the words in order of class, about the square root of all in a group."""
    size = max(32, int(np.ceil(np.sqrt(len(words)))))
    return words[np.argsort(classes, kind="stable")], np.append(np.arange(0, len(words), size), len(words))


class LogBilinear:
    """Vectors of the words as context (with one for "before the text"), position matrices, vectors and biases of the symbols, and of the words in groups, as target."""

    def __init__(self, unigram: np.ndarray, seed: int = 5, begin: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.noise = unigram
        self.begin = np.zeros(1, np.int64) if begin is None else begin
        sizes = np.diff(self.begin)
        words = int(self.begin[-1])
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.symbol = np.concatenate([np.arange(SYMBOLS + 1), SYMBOLS + self.group])
        self.params = [
            rng.normal(0, 0.1, (SYMBOLS + 1 + words, WIDTH)), np.stack([np.eye(WIDTH) / CONTEXT + rng.normal(0, 0.02, (WIDTH, WIDTH)) for _ in range(CONTEXT)]),
            rng.normal(0, 0.1, (len(unigram), WIDTH)), np.log(unigram), np.concatenate([rng.normal(0, 0.1, (words, WIDTH)), np.zeros((words, 2))], axis=1),
        ]
        self.params = [p.astype(np.float32) for p in self.params]
        #: how often each row of the word tables took part in training
        self.part = {k: np.zeros(len(self.params[k]), dtype=np.float32) for k in (0, 4)}

    def copy(self) -> LogBilinear:
        other = LogBilinear.__new__(LogBilinear)
        other.noise, other.begin, other.group, other.symbol = self.noise, self.begin, self.group, self.symbol
        other.params = [p.copy() for p in self.params]
        other.part = {k: np.zeros_like(p) for k, p in self.part.items()}
        return other

    def tables(self) -> np.ndarray:
        """(CONTEXT * WIDTH, WIDTH): the position matrices one below the other."""
        return self.params[1].reshape(-1, WIDTH)

    def train(self, context: np.ndarray, target: np.ndarray, state: list, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive AdaGrad steps over tokens in random order."""
        shift = np.log(NOISE * self.noise).astype(np.float32)
        symbols = len(self.noise)
        share = np.cumsum(self.noise)
        order = rng.permutation(len(target))
        for first in range(0, len(order), BATCH):
            some = order[first:first + BATCH]
            goal = target.take(some)
            ctx, y = context.take(some, axis=0).ravel(), self.symbol.take(goal)
            r, c, q, b, inner = self.params
            table = self.tables()
            seen = r.take(ctx, axis=0).reshape(len(some), -1)
            made = seen @ table
            z = np.minimum(np.searchsorted(share, rng.random(NOISE)), symbols - 1)
            qy = q.take(y, axis=0)
            level, qz = b - shift, q[z]
            up = _sigmoid(np.einsum("nk,nk->n", made, qy) + level.take(y)) - 1
            down = _sigmoid(made @ qz.T + level[z])
            n = np.float32(len(some))
            back = up[:, None] * qy + down @ qz
            gq, gb = _scatter(y, up[:, None] * made, symbols), np.bincount(y, up, minlength=symbols)
            np.add.at(gq, z, down.T @ made)
            np.add.at(gb, z, down.sum(0))
            inside = np.flatnonzero(goal > SYMBOLS)
            if len(inside):
                j = goal[inside] - SYMBOLS - 1
                low = self.begin[self.group[j]]
                size = self.begin[self.group[j] + 1] - low
                j = np.concatenate([j[:, None], low[:, None] + (rng.random((len(j), INSIDE), dtype=np.float32) * size[:, None]).astype(np.int64)], axis=1)
                at, rows = made.take(inside, axis=0), inner.take(j, axis=0)
                towards = rows[:, :, :WIDTH]
                off = _sigmoid(np.einsum("njk,nk->nj", towards, at) + rows[:, :, WIDTH] - np.log(INSIDE / size).astype(np.float32)[:, None])
                off[:, 0] -= 1
                back[inside] += np.einsum("nj,njk->nk", off, towards)
                wide = np.concatenate([at, np.ones((len(at), 1), np.float32), np.zeros((len(at), 1), np.float32)], axis=1)
                self._step(4, state, j.ravel(), wide, off.ravel())
            grads = {1: (seen.T @ back / n).reshape(c.shape), 2: gq / n, 3: gb / n}
            self._step(0, state, ctx, (back @ table.T).reshape(-1, WIDTH))
            for k, g in grads.items():
                state[k] += g**2
                self.params[k] = (self.params[k] - RATE * g / (np.sqrt(state[k]) + 1e-6)).astype(np.float32)

    def _step(self, k: int, state: list, index: np.ndarray, grads: np.ndarray, times: np.ndarray | None = None) -> None:
        """AdaGrad on the rows of a word table that a batch has met; grads, `times` factors if given, are summed by row."""
        ids, start, g = _sums(index, grads, times)
        self.part[k][ids] += np.diff(np.append(start, len(index)))
        s = state[k].take(ids, axis=0)
        s += g * g
        state[k][ids] = s
        np.sqrt(s, out=s)
        s += np.float32(1e-6)
        g *= np.float32(-RATE)
        g /= s
        g += self.params[k].take(ids, axis=0)
        self.params[k][ids] = g

    def log10(self, context: np.ndarray, target: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each target."""
        out, symbol = np.empty(len(target)), self.symbol[target]
        r, _, q, b, inner = self.params
        # a last column of ones meets the biases, so that one product gives the logits
        predicted = np.ones((len(target), WIDTH + 1), dtype=np.float32)
        vectors = np.ascontiguousarray(np.concatenate([q, b[:, None]], axis=1).T, dtype=np.float32)
        held, ones = np.empty((SCORED, len(b)), dtype=np.float32), np.ones(len(b), dtype=np.float32)
        bound, bias = float(np.sqrt((q * q).sum(1).max())), float(np.abs(b).max())
        for first in range(0, len(target), SCORED):
            ctx, y = context[first:first + SCORED], symbol[first:first + SCORED]
            made = r.take(ctx.ravel(), axis=0).reshape(len(y), -1) @ table
            predicted[first:first + SCORED, :WIDTH] = made
            logits = np.matmul(predicted[first:first + SCORED], vectors, out=held[:len(y)])
            top = np.float32(0)
            if bound * np.sqrt(np.einsum("nk,nk->n", made, made).max()) + bias > 60:  # else exp() can't overflow
                top = logits.max(1, keepdims=True)
                logits -= top
            chosen = logits[np.arange(len(y)), y]
            out[first:first + SCORED] = chosen - np.log(np.exp(logits, out=logits) @ ones)
        inside = np.flatnonzero(target > SYMBOLS)
        small = np.uint16 if len(b) <= 1 << 16 else np.int64  # sorted by digits
        inside = inside[np.argsort(symbol[inside].astype(small), kind="stable")]
        group = symbol[inside] - SYMBOLS
        inner_bound = float(np.sqrt((inner * inner).sum(1).max())) if len(inner) else 0.0
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            low, high = self.begin[group[first]], self.begin[group[first] + 1]
            for at in range(first, end, SCORED):
                some = inside[at:min(at + SCORED, end)]
                made = predicted.take(some, axis=0)
                logits = made @ inner[low:high, :WIDTH + 1].T
                if inner_bound * np.sqrt(np.einsum("nk,nk->n", made, made).max()) > 60:
                    logits -= logits.max(1, keepdims=True)
                chosen = logits[np.arange(len(some)), target[some] - SYMBOLS - 1 - low]
                out[some] += chosen - np.log(np.exp(logits, out=logits) @ ones[:1].repeat(high - low))
        return out / np.log(10)

    def change(self, start: LogBilinear, seen: int) -> Iterator[tuple]:
        """(table, block, rows, change of each row, weight of each row) since `start`: all of the small tables, of the word tables what took part."""
        for k, p in enumerate(self.params):
            if k not in self.part:
                yield k, 0, np.arange(1), (p - start.params[k]).reshape(1, -1), np.array([seen])
                continue
            met = np.flatnonzero(self.part[k])
            for block in np.unique(met // BLOCK):
                rows = met[met // BLOCK == block]
                yield k, int(block), rows, p[rows] - start.params[k][rows], self.part[k][rows]

    def add(self, k: int, rows: np.ndarray, change: np.ndarray) -> None:
        if k in self.part:
            self.params[k][rows] += change.reshape(len(rows), -1)
        else:
            self.params[k] += change.reshape(self.params[k].shape)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), written over x."""
    np.maximum(x, -30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)  # of a large x: 0
    x += 1
    return np.reciprocal(x, out=x)


def _sums(index: np.ndarray, rows: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first place of each in order, sums of rows by id); rows have an even number of columns.

    With `times`, a row stands for as many equal places one after another as there are factors to it, each times its factor.
    """
    # one sort of (index, place), and sums of the columns in pairs, as complex numbers
    key = np.sort((index.astype(np.int64) << 32) | np.arange(len(index)))
    ids, order = key >> 32, key & 0xFFFFFFFF
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    if times is None:
        met = rows.astype(np.float32, copy=False).take(order, axis=0)
    else:
        met = rows.astype(np.float32, copy=False).take(order // (len(times) // len(rows)), axis=0)
        met *= times.take(order)[:, None]
    return ids[start], start, np.add.reduceat(met.view(np.complex64), start, axis=0).view(np.float32)


def _scatter(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by index."""
    ids, _, sums = _sums(index, rows)
    out = np.zeros((size, rows.shape[1]), dtype=np.float32)
    out[ids] = sums
    return out


def contexts(symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(tokens, CONTEXT): the symbols before each token, SYMBOLS where the text hasn't begun."""
    out = np.full((len(symbol), CONTEXT), SYMBOLS, dtype=np.int32)
    for i in range(1, min(CONTEXT, len(symbol) - 1) + 1):
        same = row[i:] == row[:-i]
        out[i:, i - 1][same] = symbol[:-i][same]
    return out


def fit(texts: DataFrame, vocab: Vocabulary, seed: int = 5) -> LogBilinear:
    """Train on the column `text`; `part` (0 to sum(ROUNDS) - 1) says which round a row belongs to.

    A task starts from the last round's parameters and returns what it changed, each row of a word table weighted
    by how often it took part, the small tables by the task's tokens. Changes are averaged by blocks of rows, so
    the driver gets the tables once a round however many tasks there are.
    """
    model = LogBilinear(vocab.unigram, seed, vocab.begin)
    spark, first = texts.sparkSession, 0
    kind = "table int, block int, at binary, total binary, weight binary"
    for share in ROUNDS:
        rows = texts.where(F.col("part").between(first, first + share - 1)).select("text")
        first += share
        shared = spark.sparkContext.broadcast((vocab, model))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, start = shared.value
            own = start.copy()
            state = [np.full(p.shape, 1e-4, dtype=np.float32) for p in own.params]
            rng, seen = np.random.default_rng(seed), 0
            for b in batches:
                for _, _, data, at in wd.runs(b.column(0)):
                    h, c, r = tokens(data, at)
                    y = vocab.symbols(h, c)
                    own.train(contexts(y, r), y, state, rng)
                    seen += len(y)
            if seen:
                for k, block, at, change, weight in own.change(start, seen):
                    # half precision is ample for a change; sums take double
                    yield _block(k, block, at.astype(np.int32), change.astype(np.float16), weight.astype(np.float32))

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, dict] = {}
            for b in batches:
                for k, block, at, x, w in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    w = np.frombuffer(w, np.float32).astype(np.float64)
                    x = np.frombuffer(x, np.float16).reshape(len(w), -1)
                    rows = np.frombuffer(at, np.int32) % BLOCK
                    if (k, block) not in held:
                        size = 1 if k not in (0, 4) else BLOCK
                        held[k, block] = (np.zeros((size, x.shape[1])), np.zeros(size))
                    total, weight = held[k, block]
                    total[rows] += w[:, None] * x
                    weight[rows] += w
            for (k, block), (total, weight) in held.items():
                met = np.flatnonzero(weight)
                yield _block(k, block, (met + block * BLOCK).astype(np.int32), (total[met] / weight[met, None]).astype(np.float32), weight[met])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        means = rows.mapInArrow(learn, kind).repartition(n, "table", "block").mapInArrow(mean, kind).select("table", "at", "total").collect()
        model = model.copy()
        for k, at, x in means:
            model.add(k, np.frombuffer(bytes(at), np.int32), np.frombuffer(bytes(x), np.float32))
    return model


def _block(k: int, block: int, at: np.ndarray, total: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([k], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at, total, weight))]
    return pa.RecordBatch.from_arrays(values, names=["table", "block", "at", "total", "weight"])


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row, learned, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    learn says which rows the counts and the network come from. base_score is the unigram with one added to
    each count. A null or empty text is one end. Without any training row nothing is known, base_score is 0
    and the network is uniform. Repeated rows each get a row; other columns don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), learn.alias("learned"))
    training = rows.where("learned").select("text", F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(sum(ROUNDS))).alias("part"))
    counts = reliable_cut(count_words(training.select("text")), "word-counts")
    vocab = vocabulary(counts)
    model = fit(training, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        table, uid, by_symbol = model.tables(), first_uid(), vocab.count_by_symbol()
        in_class = np.log10(vocab.class_tokens + vocab.class_words + 1.0)
        for b in batches:
            for first, end, data, at in wd.runs(b.column(1)):
                n = end - first
                h, c, r = tokens(data, at)
                y = vocab.symbols(h, c)
                part = model.log10(contexts(y, r), y, table)
                rest = (y >= OWN) & (y < SYMBOLS)
                part[rest] -= in_class[y[rest] - OWN]
                times = by_symbol.take(y)
                open_ = np.flatnonzero(times == 0)
                times[open_] = vocab.lookup(h[open_])
                head = times > 0
                log = np.log10(times + 1.0)
                part += np.where(rest, log, 0)
                bound = np.searchsorted(r[~head], np.arange(n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(bound), pa.array(h[~head].view(np.int64)))
                add = lambda x: np.bincount(r, x, minlength=n)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, n), pa.array(np.arange(uid, uid + n)), b.column(2).slice(first, n), pa.array(np.bincount(r, minlength=n)), pa.array(add(head).astype(np.int64)), pa.array(add(log)), pa.array(add(part)), tail,
                ], names=["doc_id", "row", "learned", "n_tokens", "known", "log", "part", "tail"])
                uid += n

    schema = f"doc_id {kind}, row bigint, learned boolean, n_tokens bigint, known bigint, log double, part double, tail array<bigint>"
    rated = reliable_cut(rows.mapInArrow(rate, schema), "rated")
    tail = rated.select("row", F.explode("tail").alias("hash")).join(counts.select("hash", "n"), "hash")
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_log"))
    out = rated.drop("tail").join(tail, "row", "left").fillna({"more": 0, "more_log": 0.0})
    n_all = float(np.log10(vocab.total + vocab.distinct + 1.0))
    return out.select(
        "doc_id", "row", "learned", "n_tokens", (F.col("known") + F.col("more")).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("log") + F.col("more_log") - F.col("n_tokens") * n_all).alias("base_score"), (F.col("part") + F.col("more_log")).alias("score"),
    )
