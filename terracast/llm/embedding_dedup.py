"""Embedding near-duplicates by collision-counting projections.

For unit vectors a cosine of at least c means a distance of at most d = sqrt(2 - 2c), and on a random
gaussian direction the two projections differ by a normal with deviation d at most. So:

* each of L tables sorts one projection and opens a window of +-Z*d around every query. For windows to hold
  few vectors however many there are, a table sorts within cells: the signs of K further projections, K
  growing with the logarithm of the number of vectors;
* for every pair met in a window, the windows of all M projections in which it collides are counted; M and
  the least count are set so that a pair at the threshold is missed with `MISS` chance at most, by the
  tables and by the count alike;
* pairs that pass are verified by cosine in double precision.

A pair is counted by the first table in which it meets, so links add up without listing pairs. A task
returns links per vector and a spanning tree of what it has joined, linear in its rows. Cells with more
than `BLOCK` vectors (a group of near copies) are split into blocks that meet two by two.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast.llm.components import components
from terracast.llm.storage import reliable_cut

Z = 2.2
MISS = 1e-4
CELL = 256
BLOCK = 1024
LEAST_PROJECTIONS = 24
ROWS = 64


@dataclass(frozen=True)
class Setting:
    cosine: float
    signs: int  # K
    tables: int  # L
    projections: int  # M
    least: int
    window: float


def calibrate(n: int, cosine: float, miss: float = MISS) -> Setting:
    """Tables, projections and least count for n vectors."""
    inside = math.erf(Z / math.sqrt(2))
    signs = max(0, int(math.log2(max(n, 1) / CELL)))
    found = inside * (1 - math.acos(cosine) / math.pi) ** signs
    tables = max(1, math.ceil(math.log(miss) / math.log(1 - found)))
    m = max(tables, LEAST_PROJECTIONS)
    below, least = 0.0, 0
    while (below := below + math.comb(m, least) * inside**least * (1 - inside) ** (m - least)) <= miss:
        least += 1
    return Setting(cosine, signs, tables, m, least, Z * math.sqrt(2 - 2 * cosine))


@lru_cache(maxsize=8)
def directions(dim: int, setting: Setting, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, setting.projections)), rng.standard_normal((dim, setting.tables * setting.signs))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, proj: np.ndarray, codes: np.ndarray, own: np.ndarray, table: int, low: int, high: int, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows that this table is the first to meet and whose cosine reaches the threshold.

    Within one block (low == high) all pairs of its rows, else pairs across the two blocks.
    """
    order = np.argsort(proj[:, table], kind="stable")
    p = proj[order]
    line, mine = p[:, table], own[order]
    out = []
    for first in range(0, len(order), ROWS):
        end = min(first + ROWS, len(order))
        reach = int(np.searchsorted(line, line[end - 1] + s.window, "right"))
        i, j = np.nonzero(np.abs(line[first:end, None] - line[None, first:reach]) <= s.window)
        keep = (j > i) & ((mine[first + i] != mine[first + j]) if low != high else True)
        i, j = first + i[keep], first + j[keep]
        for k in range(0, len(i), 200_000):
            a, b = i[k:k + 200_000], j[k:k + 200_000]
            count = np.zeros(len(a), dtype=np.int16)
            for m in range(s.projections):
                count += np.abs(p[a, m] - p[b, m]) <= s.window
            some = count >= s.least
            out.append(np.stack([order[a[some]], order[b[some]]]))
    a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    near = np.concatenate([np.zeros(0, bool), *((x[a[k:k + 50_000]] * x[b[k:k + 50_000]]).sum(axis=1) >= s.cosine for k in range(0, len(a), 50_000))])
    a, b = a[near], b[near]
    for t in range(table):
        later = ~((codes[a, t] == codes[b, t]) & (np.abs(proj[a, t] - proj[b, t]) <= s.window))
        a, b = a[later], b[later]
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, seed: int = 17) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of
    different dimensions don't link. Equal vectors form a class that is compared once; its size counts in
    n_links. component_id is the smallest id reachable (null ids name none unless there is no other), kept
    says id = component_id. Repeated rows count each; other columns don't matter.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    e = F.col("e")
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("e"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h1", F.when(F.col("fine"), F.xxhash64("e"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(1), "e")))
    classes = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("size"), F.first("e").alias("e"))
    classes = reliable_cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    s = calibrate(classes.count(), cosine)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray([len(v) for v in batch.column(2)])
            for dim in np.unique(sizes):
                b = batch.filter(pa.array(sizes == dim))
                raw = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = unit(raw)
                sort, sign = directions(int(dim), s, seed)
                bits = (x @ sign > 0).reshape(len(x), s.tables, s.signs)
                codes = (bits * (1 << np.arange(s.signs))).sum(axis=2).astype(np.int64)
                proj = (x @ sort).astype("<f4")
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array(np.full(len(x), dim, np.int32)), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in proj], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64())),
                ], names=["class", "size", "dim", "x", "proj", "codes"])

    keyed = classes.select("class", "size", "e").mapInArrow(project, "class bigint, size bigint, dim int, x binary, proj binary, codes array<bigint>")
    keyed = reliable_cut(keyed, "projected")

    # cells beyond BLOCK vectors, and in how many blocks each is split
    cells = keyed.select("class", "dim", F.posexplode("codes").alias("t", "code"))
    large = cells.groupBy("dim", "t", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    split = cells.join(large, ["dim", "t", "code"]).groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("t", "blocks"))).alias("split"))
    dealt = keyed.join(split, "class", "left").select("class", "size", "dim", "x", "proj", "codes", F.posexplode("codes").alias("t", "code"), "split")
    dealt = dealt.withColumn("blocks", F.coalesce(F.get(F.array(F.try_element_at("split", F.col("t"))), F.lit(0)), F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("low"), F.greatest(i, F.col("own")).alias("high")))
    dealt = dealt.withColumn("m", F.explode(met)).select("dim", "t", "code", "m.low", "m.high", "own", "class", "size", "x", "proj", "codes")

    def compare(table: pa.Table) -> pa.Table:
        t, low, high = (table.column(c)[0].as_py() for c in ("t", "low", "high"))
        ids, sizes, own = (table.column(c).to_numpy() for c in ("class", "size", "own"))
        n = len(ids)
        x = unit(np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=kind).reshape(n, -1))
        proj = np.frombuffer(b"".join(table.column("proj").to_pylist()), dtype="<f4").reshape(n, -1)
        codes = table.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        a, b = linked_pairs(x, proj, codes, own, t, low, high, s)
        links = np.bincount(a, sizes[b], minlength=n) + np.bincount(b, sizes[a], minlength=n)
        some = np.flatnonzero(links)
        return pa.table({"class": ids[some], "links": links[some].astype(np.int64), "root": ids[_roots(n, a, b)[some]]})

    found = dealt.groupBy("dim", "t", "code", "low", "high").applyInArrow(compare, "class bigint, links bigint, root bigint")
    found = reliable_cut(found, "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "h1", "h2", "size", "least_id").join(links, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    named = reliable_cut(named.withColumn("component", F.coalesce("component", "class")), "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    member = named.join(least, "component").select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("component_id").cast(id_type).alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(member, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
