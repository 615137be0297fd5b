from collections import Counter

import numpy as np
import pytest
from helpers import NASTY, crc, empty, nasty
from test_pack_shard import whole_ids

from terracast.llm import decontaminate, records
from terracast.llm.storage import reliable_cut


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    written = reliable_cut(records.write_documents(nasty(spark), folder, files=4), "files")
    got = records.read_documents(written, folder).orderBy("start").collect()
    want = Counter((i, *whole_ids(t), 1) for i, t, *_ in NASTY)
    assert Counter((r.doc_id, *np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, crc(r.ids))
        at += r.n_tokens
    shuffled = records.read_shuffled(spark, written, folder, seed=3).collect()
    assert Counter((r.doc_id, r.ids) for r in shuffled) == Counter((r.doc_id, r.ids) for r in got)
    with_damage = next(p for p in sorted((tmp_path / "set").iterdir()) if p.suffix == ".rec")
    data = bytearray(with_damage.read_bytes())
    data[-6] ^= 1
    with_damage.write_bytes(data)
    with pytest.raises(Exception, match="payload of a record"):
        records.read_documents(written, folder).collect()


def test_empty_set(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    written = reliable_cut(records.write_documents(empty(spark), folder), "files")
    assert records.read_documents(written, folder).count() == 0 and records.read_shuffled(spark, written, folder, 1).count() == 0


def brute(text, items, size):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, own = find(text), set(), set()
    for item_id, t in items:
        w = find(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n and item_id is not None else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[s:s + n]:
                    hit |= set(range(p, p + n))
                    own.add(str(item_id))
    return len(words), len(hit), sorted(own)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"W{i}" for i in range(6)] + ["é", "ÄB", "The"]
    line = lambda n: " ".join(rng.choice(words, n))
    items = [(i, line(int(rng.integers(1, 9)))) for i in range(30)] + [(30, None), (31, ""), (None, "W1 W2"), (32, "W1, w2."), (33, "W1 W2"), (33, "W1 W2")]
    docs = [(i, " ".join(line(3) for _ in range(int(rng.integers(0, 30)))) + "!") for i in range(60)] + [(60, None), (61, ""), (3, "W1-W2 W1 W2"), (None, "w1 w2 x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as row", "2 as n_words", "3 as items").repartition(3)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(df, table, size=4).collect())
    want = Counter((i, n, h, tuple(o)) for i, t in docs for n, h, o in [brute(t, items, 4)])
    assert got == want
    for r in decontaminate.contamination(df, table, size=4).where("n_hit > 0").collect():
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_hit


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.contamination(empty(spark), items).count() == 0
    rows = decontaminate.contamination(nasty(spark), items.where("false")).collect()
    assert len(rows) == len(NASTY) and not any(r.n_hit for r in rows)
