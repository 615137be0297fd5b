"""Phrases whose words occur together more often than their parts suggest, found by partitioning (SON).

The documents are dealt over a fixed number of shards. If a phrase occurs `support` times in all, then in some shard
it occurs at least as often as that shard's part of the text, times support; so each shard is mined completely
at its proportional support, and the phrases that are frequent in a shard are the candidates. They are then
counted over all documents, by their words. A shard is a set of rows, not a task: its counts are combined
per task and shuffled, whatever its size.

Longer phrases are mined level by level: only where both shorter ones inside are candidates. Between passes candidates
travel as bit tables of fixed size (`BITS`), which let some others pass; the exact count removes those.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracast.llm import words as wd
from terracast.llm.bits import BitTable
from terracast.llm.joins import spread_join
from terracast.llm.storage import arrow_rows, reliable_cut

SUPPORT = 10
LONGEST = 3
SHARDS = 4
INSIDE = 50
TOP = 2000
SCALE = 1_000_000
BITS = 1 << 27
#: bytes of text looked at together, and bytes whose counts are added up before they leave a task
RUN = 500_000
WINDOW = 3_000_000
SOME = 50_000
#: documents handed to a Python worker at once
ROWS = 2_000

# fixed values: pieces end at these bytes, words at blanks and at pieces' ends
ENDS = np.zeros(256, dtype=bool)
ENDS[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
LETTERS = ~ENDS
LETTERS[[0x20, 0x09]] = False


def _pieces(data: np.ndarray, at: np.ndarray):
    """Words of a run of texts, their hashes, and the number of each word's piece."""
    w = wd.split(data, at, LETTERS)
    return w, w.hashes(), np.cumsum(ENDS[data])[w.start] + w.row


def _keys(h: np.ndarray, piece: np.ndarray, row: np.ndarray, seed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of each phrase of `size` words; a key belongs to the words and the language."""
    first, key = wd.shingles(h, piece, size)
    return first, wd.mix(key ^ seed[row[first]])


def _parts_held(held: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Of phrases of one word more than those marked in `held` (by first word): both phrases inside are marked."""
    mark = np.zeros(n + 1, dtype=bool)
    mark[held] = True
    return mark[first] & mark[first + 1]


def _mine(sizes: range, known):
    """Local counts of phrases per key and shard; phrases longer than two words only where `known` may hold their parts."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, shards, supports = (b.column(i).to_numpy() for i in (1, 2, 3))
            for lo, hi, data, at in wd.runs(b.column(0), RUN):
                w, h, piece = _pieces(data, at)
                if not len(h):
                    continue
                seed, shard, support = seeds[lo:hi].view(np.uint64), shards[lo:hi], supports[lo:hi]
                for size in sizes:
                    first, key = _keys(h, piece, w.row, seed, size)
                    if size > 2:
                        shorter, inner = _keys(h, piece, w.row, seed, size - 1)
                        some = _parts_held(shorter[known.value.may_hold(inner)], first, len(h))
                        first, key = first[some], key[some]
                    row = w.row[first]
                    _, at_, n = np.unique(key ^ wd.mix(shard[row].astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
                    own = row[at_]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at_].view(np.int64)), pa.array(shard[own]), pa.array(support[own]), pa.array(n.astype(np.int32))], names=["hash", "shard", "support", "n"])

    return mine


def _count(known, longest: int):
    """Counts per language of the phrases that `known` may hold, by their words, and of all words (size 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = _Window()
        total: Counter = Counter()
        for b in batches:
            seeds, langs = b.column(1).to_numpy(), b.column(2).to_pylist()
            for lo, hi, data, at in wd.runs(b.column(0), RUN):
                w, h, piece = _pieces(data, at)
                if not len(h):
                    continue
                for row, n in enumerate(w.counts().tolist()):
                    total[langs[lo + row]] += n
                seed = seeds[lo:hi].view(np.uint64)
                window.open(w, langs[lo:hi])
                for size in range(1, longest + 1):
                    first, key = _keys(h, piece, w.row, seed, size)
                    some = known.value.may_hold(key)
                    key, at_, n = np.unique(key[some], return_index=True, return_counts=True)
                    window.add(key, n, first[some][at_], w.row, size)
                if window.bytes > WINDOW:
                    yield from window.close()
        yield from window.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "size", "phrase", "n"])

    return count


class _Window:
    """Phrases of some runs of text, added up before they are written out as words."""

    def __init__(self):
        self.bytes = self.words = 0
        self.texts, self.entries, self.langs = [], [], {}

    def open(self, w: wd.Words, langs: list[str]) -> None:
        self.base, self.codes = self.words, np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], dtype=np.int32)
        self.texts.append((w.data, (w.start + self.bytes).astype(np.int32), (w.end + self.bytes).astype(np.int32)))
        self.bytes += len(w.data)
        self.words += len(w.start)

    def add(self, key: np.ndarray, n: np.ndarray, first: np.ndarray, row: np.ndarray, size: int) -> None:
        self.entries.append((size, key, n.astype(np.int32), (first + self.base).astype(np.int32), self.codes[row[first]]))

    def close(self) -> Iterator[pa.RecordBatch]:
        """The sums, some phrases of one size at a time. The window is empty then."""
        texts, entries, self.texts, self.entries, self.bytes, self.words = self.texts, self.entries, [], [], 0, 0
        langs = pa.array(list(self.langs), pa.string())
        data, start, end = (np.concatenate(x) for x in zip(*texts, strict=True)) if texts else (None,) * 3
        for size in sorted({e[0] for e in entries}):
            key, n, first, lang = (np.concatenate(x) for x in list(zip(*(e for e in entries if e[0] == size), strict=True))[1:])
            _, at, same = np.unique(key, return_index=True, return_inverse=True)
            total = np.zeros(len(at), dtype=np.int64)
            np.add.at(total, same, n)
            for i in range(0, len(at), SOME):
                own = first[at[i:i + SOME]]
                phrase = pc.binary_join_element_wise(*[_strings(data, start[own + k], end[own + k]) for k in range(size)], " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at[i:i + SOME]])), pa.array(np.full(len(own), size, dtype=np.int32)), phrase, pa.array(total[i:i + SOME])], names=["lang", "size", "phrase", "n"])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between the given places as strings."""
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(offsets[-1], dtype=np.int32) + np.repeat((start - offsets[:-1]).astype(np.int32), end - start)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """lang, size, phrase, n of every phrase of up to `longest` words that occurs `support` times or more in its language, stored.

    Size 0 (phrase '') holds the number of all words of a language. Texts are lower-cased (A-Z), cut into pieces at
    `.,;:!?` and line ends, and those into words at blanks and tabs; phrases lie within a piece, and
    overlapping occurrences count. Null texts are empty, a null language is `und`.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(lang).alias("seed"), F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"), lang.alias("lang")).where("text != ''")
    # a shard's support: its part of the language's bytes, times support, rounded up
    sizes = reliable_cut(texts.groupBy("lang", "seed", "shard").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "shards")
    whole = sizes.groupBy("seed").agg(F.sum("bytes").alias("all"))
    local = F.expr(f"cast((cast(bytes as decimal(20,0)) * {support} + all - 1) div all as int)")
    sizes = reliable_cut(sizes.join(whole, "seed").select("seed", "shard", local.alias("support")), "supports")
    dealt = texts.join(sizes, ["seed", "shard"]).select("text", "seed", "shard", "support")

    frequent, known = None, None
    for level in (range(1, 3), *(range(s, s + 1) for s in range(3, longest + 1))):
        mined = dealt.mapInArrow(_mine(level, known), "hash bigint, shard int, support int, n int")
        mined = mined.groupBy("hash", "shard", "support").agg(F.sum("n").alias("n")).where("n >= support").select("hash")
        with arrow_rows(spark, ROWS):
            mined = reliable_cut(mined.distinct(), "frequent")
        frequent = mined if frequent is None else frequent.unionByName(mined)
        known = spark.sparkContext.broadcast(BitTable(frequent, BITS))
    counted = texts.select("text", "seed", "lang").mapInArrow(_count(known, longest), "lang string, size int, phrase string, n bigint")
    counted = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= support) | (F.col("size") == 0))
    with arrow_rows(spark, ROWS):
        return reliable_cut(counted, "phrases")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, inside: int = INSIDE, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language.

    A candidate has 2 to `longest` words and a = f(phrase) >= support. Cut after its first k words it has l and r, the
    counts of both parts, and the score floor(SCALE * a * a / (l * r)); the lowest-scoring cut counts (ties: the
    smallest k). A candidate inside a longer one that occurs in `inside` percent of its places or more goes. Order: score, a
    (both descending), phrase in byte order. Products are taken in 38-digit decimals. Null texts are empty, a null
    language is `und`; equal rows count each; an empty table gives an empty result.
    """
    counts = phrase_counts(docs, id_col, text_col, lang_col, longest, support, shards)
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2")
    joined = lambda k, n: F.array_join(F.slice(words, k, n), " ")
    cuts = candidates.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = reliable_cut(cuts.select("*", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")), "cuts")
    part = lambda side, n: counts.where("size >= 1").select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = reliable_cut(spread_join(cuts, part("left", "l"), ["lang", "left"], spread=["phrase"], how="inner"), "cuts")
    cuts = spread_join(cuts, part("right", "r"), ["lang", "right"], spread=["phrase"], how="inner")
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    within = candidates.where("size > 2").select("lang", "size", F.col("n").alias("longer"), words.alias("w"))
    within = within.select("lang", "longer", "w", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m")).select("lang", "longer", "w", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("s"))
    within = within.select("lang", F.array_join(F.expr("slice(w, s, m)"), " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(within, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a").drop("longer")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each part, then the first of those: no language is sorted in one task
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", "n")
    return left.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
