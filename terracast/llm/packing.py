"""Best-fit packing of token sequences by large-item matching.

Only the histogram of lengths is planned: a plan for `capacity` lengths covers any number of documents.
Pieces above one third of the capacity pair at most twice to a bin, longest first, each with the longest
other large piece that still fits (greedy matching). Smaller pieces, longest first, go to the fullest bin
that has room (best fit). Bins of like content are handled as one group, so the plan is a bounded list of
runs: "ranks a to b of length l go k to a bin from bin s on, at this offset". Spark ranks the pieces of
each length and looks the place up.
"""
from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracast.llm.storage import first_uid, reliable_cut
from terracast.llm.tokens import default_tokenizer, encoder, text_groups

CAPACITY = 2048
END_ID = 0
RANK_ROWS = 100_000


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces per bin, offset in the bin).

    At most three runs of large pieces per length, and then at most two new groups of bins per length, each
    with at most sqrt(2 * capacity) different lengths: the plan's size depends on the capacity alone.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # gap -> groups (first bin, bins)
    bins = 0

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + count, first, each, offset))
        used[length] += count
        left[length] -= count

    def open_gap(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in room:
                heapq.heappush(gaps, gap)
            room.setdefault(gap, []).append((first, count))

    gaps: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    partners = list(large)
    for length in reversed(large):
        while left[length]:
            while partners and not left[partners[-1]]:
                partners.pop()
            at = bisect.bisect_right(partners, capacity - length) - 1
            while at >= 0 and not left[partners[at]]:
                partners.pop(at)
                at -= 1
            if at < 0:
                count = left[length]
                put(length, count, bins, 1, 0)
                open_gap(capacity - length, bins, count)
            elif (other := partners[at]) == length:
                pairs, odd = divmod(left[length], 2)
                count = pairs + odd
                if pairs:
                    put(length, 2 * pairs, bins, 2, 0)
                    open_gap(capacity - 2 * length, bins, pairs)
                if odd:
                    put(length, 1, bins + pairs, 1, 0)
                    rest = capacity - length
                    at = bisect.bisect_left(partners, length) - 1
                    while at >= 0 and not left[partners[at]]:
                        at -= 1
                    if at >= 0:
                        put(partners[at], 1, bins + pairs, 1, length)
                        rest -= partners[at]
                    open_gap(rest, bins + pairs, 1)
            else:
                count = min(left[length], left[other])
                put(length, count, bins, 1, 0)
                put(other, count, bins, 1, length)
                open_gap(capacity - length - other, bins, count)
            bins += count
    fits = sorted(room)
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(fits, length)
            if at == len(fits):  # no bin has room: new ones
                fits.append(capacity)
                need = -(-left[length] // (capacity // length))
                room[capacity] = [(bins, need)]
                bins += need
            gap = fits[at]
            first, count = room[gap].pop()
            if not room[gap]:
                del room[gap], fits[at]
            each = gap // length
            full = min(count, left[length] // each)
            states = []
            if full:
                put(length, full * each, first, each, capacity - gap)
                states.append((gap - each * length, first, full))
            if full < count:
                some = left[length] if left[length] < each else 0
                if some:
                    put(length, some, first + full, some, capacity - gap)
                    states.append((gap - some * length, first + full, 1))
                states.append((gap, first + full + bool(some), count - full - bool(some)))
            for rest, start, number in states:
                if rest and number:
                    if rest not in room:
                        bisect.insort(fits, rest)
                    room.setdefault(rest, []).append((start, number))
    return plan


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, `ids` (binary, little-endian unsigned 32-bit), `row` (number of the document's row).

    A document is the ids of its text and then id 0; only documents above the capacity are cut.
    A null text counts as empty; repeated rows are documents of their own.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = encoder(path), first_uid()
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                source, out = [], {f: [] for f in fields[1:]}
                for i, ids in enumerate(coder.encode(texts)):
                    ids += np.asarray([END_ID], dtype="<u4").tobytes()
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        source.append(first + i)
                        for f, v in zip(fields[1:], (uid + i, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            out[f].append(v)
                uid += len(texts)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(out[f], k) for f, k in zip(fields[1:], kinds, strict=True))], names=fields)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def pack(pieces: DataFrame, length_col: str = "length", keys: tuple[str, ...] = ("row", "piece"), capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """pieces with `sequence_id` and `offset`, in as few sequences of at most `capacity` as the heuristic finds.

    pieces is read several times: hand over a written table. `keys` tell its rows apart. Pieces of one
    length, however many, are ranked in buckets by hash: counts per (length, bucket) give each bucket's
    first rank, and only a bucket is sorted. The driver gets one count per length.
    """
    n = pieces.count()
    buckets = max(1, -(-n // rank_rows))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(length_col, "bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy(length_col).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first_rank", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).drop("n_rows")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    assert all(0 < k <= capacity for k in histogram), "a piece is empty or longer than the capacity"
    plan = np.array(sorted(plan_bins(histogram, capacity)), dtype=np.int64).reshape(-1, 6)
    span = n + 1  # one sortable number for (length, rank)
    begins = plan[:, 0] * span + plan[:, 1]
    where = pieces.sparkSession.sparkContext.broadcast((begins, plan))
    inner = Window.partitionBy(length_col, "bucket").orderBy(*keys)
    ranked = rows.join(starts, [length_col, "bucket"]).withColumn("rank", F.col("first_rank") + F.row_number().over(inner) - 1)
    ranked = ranked.select(*[f"`{c}`" for c in pieces.columns], "rank")
    length_at, rank_at = ranked.columns.index(length_col), len(ranked.columns) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts_at, runs = where.value
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (length_at, rank_at))
            run = runs[np.searchsorted(starts_at, size * span + rank, "right") - 1]
            nth = rank - run[:, 1]
            bins, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bins), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their ids and place: `sequence_id`, `offset` (gapless from 0 in each sequence).

    Null and empty texts give one piece with the end id. Other columns of docs don't matter. The pieces
    are written once to the shared folder; the ids stay there while places are worked out.
    """
    pieces = reliable_cut(token_pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    places = pack(pieces.select("row", "piece", "length"), capacity=capacity)
    return pieces.join(places.drop("length"), ["row", "piece"]).drop("row")
