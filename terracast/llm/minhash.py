"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles (64-bit hashes). Documents with equal sets form a class. Signatures of
`BANDS * ROWS` minimum hashes are cut into bands; classes that share a band are candidates. A candidate is
compared batch of hashes by batch of hashes: with m of n equal, its similarity has the posterior
Beta(m + 1, n - m + 1) under a uniform prior, and it is pruned once the chance of reaching the threshold
falls below `MISS`. Survivors are verified on their full sets.

A group of thousands of copies has no use for all its pairs. First every class is held against the smallest
class of each of its bands (a star, linear in the rows). What those links connect needs no further pair;
then all pairs of a band whose classes still lie in different components are compared, hot bands split
into blocks. So no link that joins two components is lost to the order of work.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast.llm import words as wd
from terracast.llm.components import components
from terracast.llm.storage import bucketed_by, first_uid, reliable_cut

BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
BATCH = 16
MISS = 1e-6
BLOCK = 1 << 20
SEED = np.uint64(0x51ED270B9F3C7A11)


@lru_cache
def least_equal(threshold: float, miss: float = MISS, size: int = SIZE, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared hashes a pair goes on only with at least m equal ones.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is the binomial chance of at most m successes in n + 1.
    """
    out = []
    for n in range(batch, size + 1, batch):
        reach = lambda m: sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))  # noqa: E731, B023
        out.append((n, next(m for m in range(n + 1) if reach(m) >= miss)))
    return tuple(out)


def text_shingles(w: wd.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text; a text with fewer words is one shingle. Sorted."""
    h = w.hashes()
    at, value = wd.shingles(h, w.row, size)
    row = w.row[at]
    n = w.counts()
    first = np.searchsorted(w.row, np.arange(w.rows))
    for k in range(1, size):
        some = np.flatnonzero(n == k)
        if len(some):
            total = np.full(len(some), np.uint64(k), dtype=np.uint64)
            for j in range(k):
                total = (total ^ h[first[some] + j]) * wd.ODD[j % len(wd.ODD)]
                total ^= total >> np.uint64(29)
            row, value = np.concatenate([row, some]), np.concatenate([value, wd.mix(total)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """(rows, SIZE) minimum hashes; every row must have a shingle."""
    start = np.searchsorted(row, np.arange(rows))
    out = np.empty((rows, SIZE), dtype=np.uint32)
    for k in range(SIZE):
        seed = np.uint64((int(SEED) * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
        hashed = ((value ^ seed) * (seed | np.uint64(1))) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(hashed.astype(np.uint32), start)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, others: list[str] = ()) -> DataFrame:
    """row, doc_id, text, n_shingles, set_key (128 bits of the sorted set), signature (binary; null for an empty set), given (a struct of the columns `others`)."""
    import hashlib

    given = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.lit(True).alias("there"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), given.alias("given"))
    kinds = [f"{c} {t}" for c, t in rows.dtypes]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = first_uid()
        for b in batches:
            for first, end, data, at in wd.runs(b.column(1)):
                w = wd.split(data, at, wd.SPACED)
                row, value = text_shingles(w, shingle)
                n = np.bincount(row, minlength=w.rows)
                full = np.flatnonzero(n)
                sigs = signatures(np.searchsorted(full, row), value, len(full)) if len(full) else np.zeros((0, SIZE), np.uint32)
                bound = np.concatenate([[0], np.cumsum(n)])
                keys, texts = [None] * w.rows, [None] * w.rows
                for i, r in enumerate(full):
                    keys[r] = hashlib.blake2b(value[bound[r]:bound[r + 1]].tobytes(), digest_size=16).digest()
                    texts[r] = sigs[i].tobytes()
                ids = b.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + w.rows)), ids, b.column(1).slice(first, end - first), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(texts, pa.binary()), b.column(2).slice(first, end - first)], names=["row", "doc_id", "text", "n_shingles", "set_key", "signature", "given"])
                uid += w.rows

    return rows.mapInArrow(sketch, f"row bigint, {kinds[0]}, {kinds[1]}, n_shingles bigint, set_key binary, signature binary, {kinds[2]}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIZE)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the signature pairs that no batch prunes."""
    left, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for n, least in least_equal(threshold):
        equal += (a[left, n - BATCH:n] == b[left, n - BATCH:n]).sum(axis=1)
        some = equal >= least
        left, equal = left[some], equal[some]
    return left


def _plausible(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes that Bayesian verification of their signatures lets through."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                keep = pa.array(survivors(_matrix(b.column(2)), _matrix(b.column(3)), threshold))
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    left = signed.select(F.col("class").alias("a"), F.col("signature").alias("sig_a"))
    right = signed.select(F.col("class").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| of their full sets. texts: class, text."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                found = []
                for a, other, text_a, text_b in zip(*(b.column(k) for k in range(4)), strict=True):
                    if (a := a.as_py()) != last:
                        last, held = a, _set(text_a, shingle)
                    mine = _set(text_b, shingle)
                    if _near(mine, held, percent):
                        found.append((a, other.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint")


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets; sizes that rule it out come first."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < percent * len(b) or not len(a):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _set(text: pa.Scalar, shingle: int) -> np.ndarray:
    data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
    return text_shingles(wd.split(data, np.array([0, len(data)]), wd.SPACED), shingle)[1]


def _cross_links(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different components, verified where the members of a band meet; a spanning forest of each meeting.

    members: band_key, band, n_blocks, class, component, signature, text. A band with more than BLOCK
    shingles in all is cut into blocks by hash, and each pair of blocks is a group of its own, so a group
    holds two blocks. A pair is looked at in the first band it shares only. Pairs that no batch of hashes
    prunes are verified on their full sets at once: no pair is handed on but those that join something.
    """
    threshold = percent / 100
    dealt = members.withColumn("own", F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("low"), F.greatest(x, F.col("own")).alias("high")))
    dealt = dealt.withColumn("block", F.explode(met)).select("band_key", "band", "block.low", "block.high", "own", "class", "component", "signature", "text")

    def meet(table: pa.Table) -> pa.Table:
        band, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
        own, ids, comp = (table.column(c).to_numpy() for c in ("own", "class", "component"))
        sig = _matrix(table.column("signature"))
        bands = sig.reshape(len(sig), BANDS, ROWS)
        texts, sets = table.column("text").combine_chunks(), {}
        found = []
        part = np.unique(comp, return_inverse=True)[1]
        mine, others = np.flatnonzero(own == low), np.flatnonzero(own == high)
        for i in mine:
            rest = others[(ids[others] > ids[i]) if low == high else slice(None)]
            rest = rest[part[rest] != part[i]]
            if not len(rest):
                continue
            rest = rest[survivors(np.broadcast_to(sig[i], (len(rest), SIZE)), sig[rest], threshold)]
            if band:
                rest = rest[~(bands[rest, :band] == bands[i, :band]).all(axis=2).any(axis=1)]
            for j in rest:
                if part[i] != part[j] and _near(_held(sets, texts, i, shingle), _held(sets, texts, j, shingle), percent):
                    found.append((int(ids[i]), int(ids[j])))
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return dealt.groupBy("band_key", "low", "high").applyInArrow(meet, "a bigint, b bigint")


def _held(sets: dict, texts: pa.Array, i: int, shingle: int) -> np.ndarray:
    if i not in sets:
        sets[i] = _set(texts[int(i)], shingle)
    return sets[i]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: row, doc_id, n_shingles, set_key, component_id, kept.

    Words are runs without ASCII blanks, A-Z lower-cased; documents link when 100 * |intersection| >=
    percent * |union| of their distinct shingles. component_id is the smallest doc_id reachable, kept says
    that the row is that document (the first of repeated rows). Null, empty and blank texts have no
    shingles and link with nothing: component_id is their own id. A row with a null id links like others but
    never names a component unless all its members are null. Other columns don't matter. docs should read
    stored tables, as rows are numbered in the order they come.
    """
    return _grouped(bucketed_by(sketches(docs, id_col, text_col, shingle), "row", "sketches"), shingle, percent)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns: one of each group, and all without words."""
    others = [c for c in docs.columns if c != text_col]
    drawn = bucketed_by(sketches(docs, id_col, text_col, shingle, others), "row", "sketches")
    kept = drawn.join(_grouped(drawn, shingle, percent).where("kept").select("row"), "row", "left_semi")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"given.c{others.index(c)}").alias(c) for c in docs.columns])


def _grouped(drawn: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The result of near_duplicates from stored sketches."""
    threshold = percent / 100
    # equal sets: the class is named by its first row
    classes = drawn.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("class"), F.min("doc_id").alias("least_id"))
    classes = reliable_cut(classes, "classes")
    # sketches are bucketed by row, which is the class of the first row of a set: joins on it move the other side only
    signed = drawn.select(F.col("row").alias("class"), "n_shingles", "signature")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                b = batch.slice(i, 8192)
                sig = _matrix(b.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * SEED, sig.shape[:2]).copy()
                for k in range(ROWS):
                    key = wd.mix((key ^ sig[:, :, k]) * wd.ODD[k])
                n = len(sig)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band_key", "band", "class"])

    heads = signed.join(classes.select("class"), "class", "left_semi")
    bands = heads.select("class", "signature").mapInArrow(cut, "band_key bigint, band int, class bigint")
    shared = bands.groupBy("band_key").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    bands = reliable_cut(bands.join(shared, "band_key"), "bands")

    texts = drawn.select(F.col("row").alias("class"), "text")
    # a star in every band
    star = bands.where("class != first").select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    star = reliable_cut(_plausible(star, signed, threshold), "star")
    links = reliable_cut(_verified(star, texts, shingle, percent), "links")
    joined = components(links)
    # all pairs of a band between components
    place = bands.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    place = place.join(signed.select("class", "n_shingles"), "class")
    blocks = F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("n_blocks")
    open_bands = place.groupBy("band_key").agg(F.min("component").alias("low"), F.max("component").alias("high"), blocks).where("low < high").select("band_key", "n_blocks")
    place = reliable_cut(place.join(open_bands, "band_key"), "open")
    members = drawn.select(F.col("row").alias("class"), "signature", "text")
    cross = _cross_links(place.join(members, "class"), shingle, percent)
    joined = components(links.unionByName(cross))

    named = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = reliable_cut(named, "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    member = named.join(least, "component").select("set_key", "component", "component_id")
    rows = drawn.select("row", "doc_id", "n_shingles", "set_key").join(member, "set_key", "left")
    rows = rows.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    # of repeated rows of the kept document the first is kept
    first = rows.where("set_key is not null and doc_id <=> component_id").groupBy("component").agg(F.min("row").alias("keeper"))
    rows = rows.join(first, "component", "left")
    kept = F.when(F.col("set_key").isNull(), F.lit(True)).otherwise(F.col("row") == F.col("keeper"))
    return rows.select("row", "doc_id", "n_shingles", "set_key", "component_id", F.coalesce(kept, F.lit(False)).alias("kept"))
