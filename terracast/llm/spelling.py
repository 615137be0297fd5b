"""Spelling variants: words one edit apart, by a bit-sliced position index.

For a set of words the index holds, for each position and letter, the set of words with that letter there, one
bit a word. A word is looked up by recurrences over whole sets: words that agree so far (no error), and words
that agree but for one replaced, one added or one missing letter (one error, the last two read the index at a
position shifted by one). One machine operation serves 64 words.

Words meet in blocks, so that no set is the whole vocabulary. A block belongs to a base length b and holds
words of b and b + 1 letters that agree outside one segment; two words one edit apart agree outside one half of
the shorter one. A crowded block is halved again, down to segments of one letter, where the alphabet bounds it.
The first place where two words differ lies in one segment only, so a pair is counted in one block.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast.llm.storage import reliable_cut

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
#: words of a block beyond which it is halved, and rows that are looked up together
CROWD = 1024
TOGETHER = 2048
FLUSH = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop_every: int | None = None) -> DataFrame:
    """word, n of all words with enough letters and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With `drop_every` k, a run
    loses a letter where k divides h, the crc32 of `<id>:<run>` (a null id is an empty text): the letter h modulo
    the run's length. Null and empty texts have no words; equal rows count each; other columns are not read.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")  # a letter lost never makes a word longer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Counter(run.findall(text.encode().lower().decode()))  # lower() of bytes knows A-Z only
                if drop_every:
                    front = f"{doc}:".encode()
                    for word, n in own.items():
                        h = zlib.crc32(front + word.encode())
                        if h % drop_every:
                            total[word] += n
                        elif len(word) > least_letters:
                            at = h % len(word)
                            total[word[:at] + word[at + 1:]] += n
                else:
                    total.update(own)
                if len(total) > FLUSH:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string").alias("text")).where("text != ''")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of the blocks that the halves of the segment [lo, hi) make; a segment of one letter stays."""
    middle = F.expr("lo + (hi - lo) div 2").cast("int")
    part = lambda lo, hi: F.struct(F.col(lo).alias("lo") if isinstance(lo, str) else lo.alias("lo"), F.col(hi).alias("hi") if isinstance(hi, str) else hi.alias("hi"))
    parts = F.when(F.col("hi") - F.col("lo") <= 1, F.array(part("lo", "hi"))).otherwise(F.array(part("lo", middle), part(middle, "hi")))
    cut = rows.select("word", "n", "base", F.explode(parts).alias("p")).select("word", "n", "base", "p.*")
    around = [F.expr("substring(word, 1, lo)"), F.expr("right(word, base - hi)")]
    return cut.withColumn("key", F.xxhash64("base", "lo", "hi", *around))


def blocks(words: DataFrame, crowd: int = CROWD) -> list[DataFrame]:
    """Stored rows (word, n, base, lo, hi, key) of all blocks with two words or more; each level halves the crowded ones of the one before."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("base")).where("base > 0")
    rows = _halved(rows.select("*", F.lit(0).alias("lo"), F.col("base").alias("hi")))
    out = []
    while rows is not None:
        rows = reliable_cut(rows, "blocks")
        sizes = reliable_cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "block-sizes")
        sized = rows.join(sizes, "key")
        crowded = (F.col("size") > crowd) & (F.col("hi") - F.col("lo") > 1)
        out.append(reliable_cut(sized.where(~crowded).drop("size"), "blocks"))
        again = sized.where(crowded)
        rows = None if sizes.where(F.col("size") > crowd).isEmpty() or again.isEmpty() else _halved(again)
    return out


def _packed(flags: np.ndarray) -> np.ndarray:
    """Bits of a matrix of flags whose width is a multiple of 64."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def look_up(table: pa.Table) -> pa.Table:
    """word, n_near, best {minus n, form} of each row with near words in its block."""
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))  # the first bit of a set is its best word
    words, n = [words[i] for i in order], [n[i] for i in order]
    base, lo, hi = (table.column(c).to_numpy()[order] for c in ("base", "lo", "hi"))
    rows, width = len(words), -(-len(words) // 64) * 64
    length = np.array([len(w) for w in words])
    ends = length - (base - hi)
    middle = [w[a:b] for w, a, b in zip(words, lo, ends, strict=True)]
    letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(middle))))}
    size = ends - lo
    longest = int(size.max())
    codes = np.zeros((width, longest), dtype=np.uint32)
    for i, m in enumerate(middle):
        codes[i, :len(m)] = [letters[c] for c in m]

    ids: dict[tuple, int] = {}
    block = np.array([ids.setdefault((b, a, h, w[:a], w[e:]), len(ids)) for w, b, a, h, e in zip(words, base.tolist(), lo.tolist(), hi.tolist(), ends.tolist(), strict=True)])
    present = np.arange(width) < rows
    wide = lambda x, fill: np.concatenate([x, np.full(width - rows, fill)])
    of_block = _packed(np.arange(len(ids))[:, None] == wide(block, -1)[None, :])
    sizes, kind = np.unique(size, return_inverse=True)
    of_size = np.vstack([_packed((sizes[:, None] == wide(size, -1)[None, :]) & present), np.zeros((1, width // 64), np.uint64)])
    find = {int(s): i for i, s in enumerate(sizes)}
    sized = lambda s: of_size[[find.get(int(x), len(sizes)) for x in s]]

    alphabet = np.arange(len(letters) + 1, dtype=np.uint32)[:, None]

    def index(position: int) -> np.ndarray:
        """Set of words per letter at a position; letter 0 is none."""
        if not 0 <= position < longest:
            return np.zeros((len(alphabet), width // 64), np.uint64)
        found = _packed(codes[:, position][None, :] == alphabet)
        found[0] = 0
        return found

    asked = np.argsort(-size, kind="stable")  # the queries that are still read come first
    same = of_block[block[asked]]
    replaced, added, missing = (np.zeros_like(same) for _ in range(3))
    agreed = same.copy()  # same after the whole segment of the base word
    shorter_by_one = (base != length)[asked]
    before, here, after = index(-1), index(0), index(1)
    for i in range(longest):
        live = int(np.searchsorted(-size[asked], -i, "left"))
        letter = codes[asked[:live], i]
        z, s, a, m = same[:live], replaced[:live], added[:live], missing[:live]
        now = here[letter]
        agreed[:live] = np.where(shorter_by_one[:live, None] & (size[asked[:live]] == i + 1)[:, None], z, z & now)
        m[:] = m & before[letter] | z
        a[:] = (a | z) & after[letter]
        s[:] = s & now | z & ~now
        z[:] = z & now
        before, here, after = here, after, index(i + 2)
    own = size[asked]
    near = np.where(shorter_by_one[:, None], missing & sized(own - 1), replaced & sized(own) | (added | same) & sized(own + 1))
    near &= np.where((hi < base)[asked][:, None], ~agreed, ~np.uint64(0))
    n_near = np.bitwise_count(near).sum(axis=1).astype(np.int64)
    some = np.flatnonzero(n_near)
    chunk = (near[some] != 0).argmax(axis=1)
    first = near[some, chunk]
    best = chunk * 64 + np.bitwise_count((first & (~first + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    form = pa.StructArray.from_arrays([pa.array([-n[i] for i in best], pa.int64()), pa.array([words[i] for i in best], pa.string())], names=["less", "form"])
    return pa.table({"word": pa.array([words[i] for i in asked[some]], pa.string()), "n_near": pa.array(n_near[some]), "best": form})


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a table (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one from the other. A word's form is
    the near word of largest n (ties: the smallest in code-point order) if that is `ratio` times the word's n at
    least, else null; root follows forms to the last one and is the word itself where it has none. Rows of one
    word are added up; null and empty words are left out; an empty table gives an empty result.
    """
    words = reliable_cut(words.where("word != ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    found = None
    for part in blocks(words, crowd):
        buckets = -(-part.count() // TOGETHER)
        if buckets:
            part = part.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(look_up, "word string, n_near bigint, best struct<less bigint, form string>")
            found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.lit(None).cast("string")
        return words.select("word", none.alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    near = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    near = reliable_cut(near, "near-words")
    roots = _roots(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root by doubling: n grows tenfold at each step, so paths and rounds are few. Each round is written."""
    now, open_ = reliable_cut(forms.withColumnRenamed("form", "root"), "roots"), True
    while open_:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reliable_cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        open_ = not step.where("moved").isEmpty()
        now = step.drop("moved")
    return now
