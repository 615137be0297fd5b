from collections import Counter

import numpy as np
import pytest
from helpers import NASTY, crc, empty, nasty

from terracast.llm import packing, sharding
from terracast.llm.tokens import default_tokenizer


def whole_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_pieces_hold_the_ids_of_whole_texts(spark):
    got = packing.token_pieces(nasty(spark), capacity=64).collect()
    back = {}
    for r in sorted(got, key=lambda r: (r.row, r.piece)):
        assert r.start == len(back.setdefault((r.doc_id, r.row), []))
        assert r.length <= 64 and r.ids_crc32 == crc(r.ids)
        back[r.doc_id, r.row] += np.frombuffer(r.ids, "<u4").tolist()
    want = Counter((i, *whole_ids(t), 0) for i, t, *_ in NASTY)
    assert Counter((i, *v) for (i, _), v in back.items()) == want


def placed(lengths, capacity):
    plan = sorted(packing.plan_bins(Counter(lengths), capacity))
    bins = {}
    for length, lo, hi, first, each, offset in plan:
        for k in range(hi - lo):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills_bins_without_gaps(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 700).tolist() if seed % 3 else (np.minimum(100, rng.lognormal(3, 1, 900).astype(int) + 1)).tolist()
    bins = placed(lengths, 100)
    assert sorted(bins) == list(range(len(bins)))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 100 and sum(3 * n > 100 for _, n in b) <= 2
    assert len(bins) <= 1.05 * max(-(-sum(lengths) // 100), sum(2 * n > 100 for n in lengths)) + 1


def test_plan_of_one_length_and_of_nothing():
    assert len(placed([40] * 9, 100)) == 5 and len(placed([33] * 9, 100)) == 3 and placed([], 100) == {}


def test_packed_documents(spark):
    rows = packing.pack_documents(nasty(spark), capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.pack_documents(empty(spark)).count() == 0


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([7, 0, 100, 33], 6, 1)
    assert m.sum(1).tolist() == [7, 0, 100, 33] and max(m.sum(0)) - min(m.sum(0)) <= 1
    mean = np.mean([sharding.communication_matrix([10, 10], 2, s)[0, 0] for s in range(600)])
    assert abs(mean - 5) < 0.2


def test_shards_are_exact_and_shuffled(spark):
    df = nasty(spark)
    got = sharding.shuffle_into_shards(df, 4, block_rows=3).collect()
    assert len(got) == len(NASTY)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((i, t) for i, t, *_ in NASTY), key=key)
    assert sharding.shuffle_into_shards(empty(spark), 4).count() == 0
    big = spark.range(6000)
    order = [r.id for r in sharding.shuffle_into_shards(big, 3, block_rows=500).orderBy("shard", "slot").collect()]
    assert abs(np.corrcoef(order, range(6000))[0, 1]) < 0.06


def test_rejection_draws_follow_the_hypergeometric_law():
    from math import comb

    rng = np.random.default_rng(11)
    for good, bad, n in [(30, 50, 20), (3, 900, 40), (500, 5, 60), (20_000, 30_000, 90)]:
        draws = np.array([sharding.rejection_draw(rng, good, bad, n) for _ in range(20_000)])
        law = {k: comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(good, n) + 1)}
        likely = [k for k, p in law.items() if p * len(draws) >= 20]
        chi2 = sum(((draws == k).sum() - law[k] * len(draws)) ** 2 / (law[k] * len(draws)) for k in likely)
        assert chi2 < len(likely) + 5 * (2 * len(likely)) ** 0.5
        assert set(draws) <= set(law)


def test_draws_from_pools_beyond_numpy():
    rng = np.random.default_rng(12)
    for good, bad, n in [(10**11, 23 * 10**11, 50_000), (4 * 10**8, 10**10, 10**9), (2 * 10**9, 5, 10**9), (7, 10**12, 100)]:
        pool = good + bad
        draws = np.array([sharding._draw(rng, good, bad, n) for _ in range(3000)], dtype=float)
        mean, var = n * good / pool, n * (good / pool) * (bad / pool) * (pool - n) / (pool - 1)
        assert abs(draws.mean() - mean) <= 5 * (var / len(draws)) ** 0.5 + 1e-9
        assert abs(draws.var() - var) <= 0.15 * var + 1e-2
        assert draws.min() >= max(0, n - bad) and draws.max() <= min(good, n)


def test_matrix_of_very_large_blocks_keeps_its_margins():
    sizes = [3 * 10**9 + k for k in range(5)]
    m = sharding.communication_matrix(sizes, 24, 1)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
