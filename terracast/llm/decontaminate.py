"""Benchmark decontamination as a prefix-filtered set join of item windows with documents.

A window is a run of `size` item words (a shorter item is one window) and a set of word shingles. A
document contains a window only if it holds all of its shingles, so for exact containment the necessary
prefix is one shingle: the rarest in the documents. Three steps follow:

1. count the shingles of the items over all documents (partial counts per task, then a shuffle);
2. join the rarest shingle of each window with the document positions that hold it; a window longer than
   the document (length bound) or reaching over an end of it (positional bound) is no candidate;
3. verify the words of every candidate one by one.

A bit table of fixed size (`FILTER_BITS`) made from the item shingles tells tasks which positions may
matter. It lets some others pass, which the joins remove, and never loses one.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracast.llm import words as wd
from terracast.llm.storage import first_uid, reliable_cut

WINDOW = 13
SHINGLE = 3
FILTER_BITS = 1 << 24


def _tables(data: np.ndarray, at: np.ndarray, shingle: int):
    """Words of a run, and per shingle size up to `shingle` (position, hash)."""
    w = wd.split(data, at, wd.ALNUM)
    h = w.hashes()
    return w, [wd.shingles(h, w.row, k) for k in range(1, shingle + 1)]


def item_windows(items: DataFrame, item_id: str, text_col: str, size: int, shingle: int) -> DataFrame:
    """item_id, words (array) of each distinct window of each item, its hash, and its shingles (offset, hash)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, _, data, at in wd.runs(b.column(1)):
                w, by_size = _tables(data, at, shingle)
                bound = np.searchsorted(w.row, np.arange(w.rows + 1))
                find = [dict(zip(p.tolist(), h.view(np.int64).tolist(), strict=True)) for p, h in by_size]
                out = {k: [] for k in ("item_id", "words", "parts")}
                for r in range(w.rows):
                    lo, hi = int(bound[r]), int(bound[r + 1])
                    own = [w.word(i) for i in range(lo, hi)]
                    n = min(size, hi - lo)
                    k = min(shingle, n)
                    for s in range(hi - lo - n + 1) if n else ():
                        out["item_id"].append(ids[first + r])
                        out["words"].append(own[s:s + n])
                        out["parts"].append([{"at": j, "hash": find[k - 1][lo + s + j]} for j in range(n - k + 1)])
                part = pa.struct([("at", pa.int32()), ("hash", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["words"], pa.list_(pa.string())), pa.array(out["parts"], pa.list_(part))], names=list(out))

    rows = items.select(F.col(item_id).cast("string"), F.col(text_col).cast("string")).where(f"`{item_id}` is not null")
    return rows.mapInArrow(cut, "item_id string, words array<string>, parts array<struct<at int, hash bigint>>").distinct()


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits of all values in the column `hash`: FILTER_BITS / 64 words reach the driver at most."""
    mask = FILTER_BITS - 1
    slot = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))).alias("slot"))
    words = slot.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for word, bits in words:
        table[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return table


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _slots(h)
    hit = lambda s: table[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)
    return (hit(one) & hit(two)).astype(bool)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: `doc_id`, `row`, `n_words`, `n_hit`, `items` (sorted ids as strings), `spans` (first and last word of each hit run).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A document word inside
    an occurrence of a window is hit. Null and empty texts have no words; items without words or id hold no
    window; repeated document rows count each on its own; no items means no hits. Only the id and text
    columns are read, whatever else is there.
    """
    spark = docs.sparkSession
    windows = reliable_cut(item_windows(items, item_id, item_text, size, shingle), "windows")
    parts = windows.select("words", F.explode("parts").alias("p")).select("words", "p.at", "p.hash").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    # 1. how often each item shingle occurs in the documents
    every = spark.sparkContext.broadcast(bit_table(parts.select("hash").distinct()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for _, _, data, at in wd.runs(b.column(0)):
                for _, h in _tables(data, at, shingle)[1]:
                    values, n = np.unique(h[may_hold(every.value, h)].view(np.int64), return_counts=True)
                    total.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
                if len(total) > 200_000:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    seen = texts.select("text").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct("n", "hash", "at")).alias("r")
    # a window with a shingle that no document holds occurs nowhere
    prefix = parts.join(seen, "hash", "left").groupBy("words").agg(rarest, F.count("n").alias("held"), F.count(F.lit(1)).alias("parts"))
    prefix = reliable_cut(prefix.where("held = parts").select("words", "r.hash", "r.at"), "prefix")

    # 2. positions of the rarest shingles, with the words around them
    chosen = spark.sparkContext.broadcast(bit_table(prefix.select("hash").distinct()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = first_uid()
        for b in batches:
            for first, end, data, at in wd.runs(b.column(1)):
                w, by_size = _tables(data, at, shingle)
                bound = np.searchsorted(w.row, np.arange(w.rows + 1))
                found: list[list[dict]] = [[] for _ in range(w.rows)]
                for p, h in by_size:
                    some = may_hold(chosen.value, h)
                    for pos, value in zip(p[some].tolist(), h[some].view(np.int64).tolist(), strict=True):
                        r = int(w.row[pos])
                        lo, hi = max(int(bound[r]), pos - size + 1), min(int(bound[r + 1]), pos + size)
                        found[r].append({"pos": pos - int(bound[r]), "hash": value, "back": pos - lo, "around": [w.word(i) for i in range(lo, hi)]})
                shape = pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64()), ("back", pa.int32()), ("around", pa.list_(pa.string()))]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(np.arange(uid, uid + w.rows)), pa.array(w.counts()), pa.array(found, shape)], names=["doc_id", "row", "n_words", "found"])
                uid += w.rows

    probed = texts.mapInArrow(probe, f"doc_id {kind}, row bigint, n_words bigint, found array<struct<pos bigint, hash bigint, back int, around array<string>>>")
    probed = reliable_cut(probed, "probed")
    places = probed.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    near = places.join(prefix, "hash").withColumn("first", F.col("pos") - F.col("at")).withColumn("end", F.col("first") + F.size("words"))
    near = near.where("at <= back and end <= n_words")

    # 3. the same words?
    hits = near.where("slice(around, back - at + 1, size(words)) = words").select("row", "first", "end", "words")
    hits = reliable_cut(hits, "hits")
    spans = hits.select("row", "first", "end").distinct()
    earlier = Window.partitionBy("row").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("end").over(earlier))
    opens = F.when(F.col("reached").isNull() | (F.col("first") > F.col("reached")), 1).otherwise(0)
    spans = spans.withColumn("run", F.sum(opens).over(Window.partitionBy("row").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "run").agg(F.min("first").alias("first"), (F.max("end") - 1).alias("last"))
    spans = spans.groupBy("row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    owners = hits.select("row", "words").distinct().join(windows.select("words", "item_id"), "words")
    owners = owners.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = probed.select("doc_id", "row", "n_words").join(spans, "row", "left").join(owners, "row", "left")
    return out.select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["hash", "n"])


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
