import re
import zlib
from collections import Counter

import numpy as np
from helpers import NASTY, empty, nasty
from pyspark.sql import functions as F

from terracast.llm import licenses, lm, quality


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["the", "house", "Stands,", "by", "river.", "old", "green", "every", "morning"], 60))
    bad = lambda: " ".join([str(rng.choice(["Buy", "NOW!!", "$$$", "a|b"]))] * int(rng.integers(20, 60)))
    rows = [(i, bad() if i % 5 == 3 else good()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 != 3)) for i in range(0, 600, 2)] + [(None, 1), (2, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= quality.THRESHOLD) == (i % 5 != 3) for i in held]) > 0.97
    assert {r[0] for r in docs.where(quality.held_out()).select("doc_id").collect()} == set(held)
    extra = quality.scored(nasty(spark), model).collect()
    assert len(extra) == len(NASTY) and all(0 <= r.score <= 1 for r in extra)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.train(nasty(spark), none) is None
    assert {r.score for r in quality.scored(nasty(spark), None).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.train(empty(spark), one) is None and quality.scored(empty(spark), None).count() == 0


def test_features_see_the_whole_text():
    a, b = b"word " * 5000 + b"end", b"word " * 5000 + b"end!!!!"
    x = quality.features(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
    assert x.shape == (2, quality.N_FEATURES) and (x[0] != x[1]).any() and np.isfinite(x).all()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + ["\n"]


def test_lm_counts_and_base(spark):
    rows = [(i, t) for i, t, *_ in NASTY]
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    got = lm.score(nasty(spark), learn).collect()
    c = Counter(w for i, t in rows if i is None or i % 2 == 0 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(words(t)), sum(w in c for w in words(t)), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    bare = lm.score(nasty(spark), F.lit(False)).collect()
    assert len(bare) == len(NASTY) and all(r.base_score == 0 and r.n_known == 0 for r in bare)
    assert lm.score(empty(spark), F.lit(True)).count() == 0


def test_network_learns_and_normalises():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.integers(1, 3, 60_000)) % 40  # the next symbol is one or two on
    unigram = np.bincount(y, minlength=lm.SYMBOLS) + 1.0
    unigram /= unigram.sum()
    model = lm.LogBilinear(unigram)
    ctx = lm.contexts(y, np.zeros(len(y), np.int64))
    state = [np.full(p.shape, 1e-4, dtype=np.float32) for p in model.params]
    for _ in range(6):
        model.train(ctx, y, state, rng)
    assert model.log10(ctx, y, model.tables()).mean() > np.log10(unigram[y]).mean() + 0.4
    every = np.arange(lm.SYMBOLS)
    total = (10.0 ** model.log10(np.repeat(ctx[77:78], lm.SYMBOLS, 0), every, model.tables())).sum()
    assert abs(total - 1) < 1e-4


def test_contexts_stay_in_their_text():
    ctx = lm.contexts(np.array([1, 2, 3, 4]), np.array([0, 0, 1, 1]))
    assert ctx[:, 0].tolist() == [lm.SYMBOLS, 1, lm.SYMBOLS, 3] and ctx[1, 1] == lm.SYMBOLS


def test_licences(spark):
    mit, apache = licenses.TEMPLATES[2][1], licenses.TEMPLATES[4][1]
    wrapped = "\n".join(re.findall(r".{1,60}(?:\s|$)", mit))
    rows = [(1, "code\n\n" + wrapped + "\n\nmore code here"), (2, "released under THE mit licence"), (3, "Released under the MIT License!"), (4, apache), (5, "a plain text about licenses of the state"), (6, None), (7, ""), (8, "x\nLicensed under CC BY-NC 4.0.\ny\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as matches", "2 as row")
    got = {r.doc_id: [(m.license, m.kind) for m in r.matches] for r in licenses.scan(df).collect()}
    assert got == {1: [("MIT", "paragraph"), ("MIT", "text")], 2: [], 3: [("MIT", "line")], 4: [("Apache-2.0", "line")], 5: [], 6: [], 7: [], 8: [("CC-BY-NC-4.0", "line"), ("MIT", "line")]}
    span = licenses.scan(df).where("doc_id = 8").first().matches[1]
    assert rows[7][1].encode()[span.start:span.end] == b"Released under the MIT License"
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(nasty(spark)).count() == len(NASTY)


def test_words_beyond_the_most_frequent_are_modelled(spark):
    rng = np.random.default_rng(4)
    names = [f"{a}{b}{c}word" for a in "bdfg" for b in "aeiou" for c in "klmnprst"]  # 160 words of one ending and length class
    step = lambda: "".join(f"{names[i]} {names[(i + 1) % 160]} " for i in rng.integers(0, 160, 250))
    docs = spark.createDataFrame([(i, step()) for i in range(160)], "doc_id bigint, text string").repartition(2)
    counts = lm.count_words(docs.select("text"))
    vocab = lm.vocabulary(counts)
    assert len(vocab.own) == 161 and vocab.begin[-1] == 33 and vocab.class_words.sum() == 0  # the end and all words; not only 128
    model = lm.fit(docs.selectExpr("text", "cast(doc_id % 16 as int) part"), vocab)
    every = np.concatenate([np.arange(lm.SYMBOLS), np.arange(lm.SYMBOLS + 1, lm.SYMBOLS + 34)])
    ctx = np.repeat(lm.contexts(vocab.own_symbol[5:8], np.zeros(3, np.int64))[2:], len(every), 0)
    assert abs((10.0 ** model.log10(ctx, every, model.tables())).sum() - 1) < 1e-4
    inside = np.arange(lm.SYMBOLS + 1, lm.SYMBOLS + 34)  # as context, words of groups differ from each other
    one = np.full((33, lm.CONTEXT), lm.SYMBOLS, np.int32)
    one[:, 0] = inside
    assert len(np.unique(np.round(model.log10(one, np.full(33, 3), model.tables()), 6))) == 33


def test_score_is_the_sum_over_the_tokens_computed_one_by_one(spark):
    """Each token's share by plain sums over the model's tables: softmax over symbols, softmax in the group, or the count's share of the rest."""
    rng = np.random.default_rng(8)
    names = [f"{a}{b}{c}" for a in "bdfgkm" for b in "aeiou" for c in "klmnprst"]  # 240 words
    weights = 1 / np.arange(1, 241)
    rows = [(i, " ".join([*rng.choice(names, 200, p=weights / weights.sum()), f"once{i}", f"Twice{i // 2}"])) for i in range(96)] + [(96, ""), (97, "unseen words only"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    learn = F.col("doc_id") < 90
    got = {r.doc_id: r for r in lm.score(docs, learn).collect()}
    training = docs.where(learn).select("text", F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(sum(lm.ROUNDS))).alias("part"))
    vocab = lm.vocabulary(lm.count_words(training.select("text")))
    model = lm.fit(training, vocab)
    assert vocab.begin[-1] > 20 and vocab.class_words.sum() > 0  # all three kinds of words
    r, tables, q, b, inner = (np.asarray(p, np.float64) for p in model.params)
    times = Counter(w for i, t in rows if i < 90 for w in words(t))
    place = dict(zip(vocab.own.tolist(), vocab.own_symbol.tolist(), strict=True))
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        h, cls, _ = lm.tokens(data, np.array([0, len(data)]))
        symbols = [place.get(int(x), lm.OWN + int(k)) for x, k in zip(h, cls, strict=True)]
        total = 0.0
        for at, (y, w) in enumerate(zip(symbols, words(t), strict=True)):
            made = sum(r[symbols[at - k] if at >= k else lm.SYMBOLS] @ tables[k - 1] for k in range(1, lm.CONTEXT + 1))
            logits = q @ made + b
            group = np.searchsorted(vocab.begin, y - lm.SYMBOLS - 1, "right") - 1 if y > lm.SYMBOLS else None
            first = y if group is None else lm.SYMBOLS + group
            total += logits[first] - np.log(np.exp(logits).sum())
            if group is not None:
                low, high = vocab.begin[group:group + 2]
                near = inner[low:high, :lm.WIDTH] @ made + inner[low:high, lm.WIDTH]
                total += near[y - lm.SYMBOLS - 1 - low] - np.log(np.exp(near).sum())
            elif y >= lm.OWN:
                k = y - lm.OWN
                total += np.log((times[w] + 1) / (vocab.class_tokens[k] + vocab.class_words[k] + 1))
        assert abs(got[i].score - total / np.log(10)) < 1e-3 * max(1, len(symbols) / 10), (i, got[i].score, total / np.log(10))


def test_words_of_a_group_are_learned_from_their_context():
    rng = np.random.default_rng(0)
    y = lm.SYMBOLS + 1 + np.cumsum(rng.integers(1, 3, 60_000)) % 64  # all words lie in two groups
    unigram = np.full(lm.SYMBOLS + 2, 1 / (lm.SYMBOLS + 2))
    model = lm.LogBilinear(unigram, begin=np.array([0, 32, 64]))
    ctx = lm.contexts(y, np.zeros(len(y), np.int64))
    state = [np.full(p.shape, 1e-4, dtype=np.float32) for p in model.params]
    for _ in range(4):
        model.train(ctx, y, state, rng)
    assert model.log10(ctx, y, model.tables()).mean() > np.log10(1 / 64) + 0.4


def test_licences_inside_longer_lines(spark):
    head = licenses.TEMPLATES[6][1]
    wrapped = "\n".join("// " + x for x in re.findall(r".{1,60}(?:\s|$)", head))
    code = "\n".join(f"int f{i}(int x) {{ return x * {i} + y{i}; }}" for i in range(12))
    rows = [
        (1, "Code is licensed under the MIT License."), (2, "All rights reserved. Released under the MIT License. See below."), (3, wrapped + "\n" + code), (4, "nothing to see"),
        (5, "we like it. This work is licensed under the GNU General Public License, version 2. And more words, as Licensed under CC BY 4.0. too"),
        (6, "released under the mit"), (7, "our text is released under the"), (8, "license of the work"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r.matches for r in licenses.scan(df).collect()}
    got = {k: [(m.license, m.kind) for m in v] for k, v in found.items()}
    assert got[1] == got[2] == [("MIT", "window")] and got[3] == [("GPL-3.0", "window")] and got[4] == []
    assert got[5] == [("GPL-2.0", "window"), ("CC-BY-4.0", "window")] and got[7] == got[8] == []
    assert rows[1][1].encode()[found[2][0].start:found[2][0].end] == b"Released under the MIT License"


def test_places_of_words_from_their_leading_bits():
    """Ranges found from the leading bits give the places of a binary search, for crowded ranges and both ends too."""
    from terracast.llm import lm

    rng = np.random.default_rng(3)
    top = np.uint64(2**64 - 1)
    spread_out = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    crowded = np.arange(100, dtype=np.uint64) + np.uint64(7 << 60)  # more words in one range than steps are made
    for own in (np.unique(np.concatenate([spread_out, crowded, [np.uint64(0), top]])), crowded, crowded[:1]):
        v = lm.Vocabulary(1, 1, own, own, own, np.arange(len(own)), np.zeros(1), np.zeros(1))
        asked = np.concatenate([own, own + np.uint64(1), own - np.uint64(1), rng.integers(0, 2**64, 5000, dtype=np.uint64), [np.uint64(0), top]])
        assert (v._own_place(asked) == np.searchsorted(own, asked)).all()


def test_sums_of_rows_times_factors():
    """Rows multiplied after they are put in order have the sums of rows multiplied before."""
    from terracast.llm import lm

    rng = np.random.default_rng(4)
    rows, times, index = rng.normal(size=(300, 6)).astype(np.float32), rng.normal(size=2100).astype(np.float32), rng.integers(0, 40, 2100)
    ids, start, got = lm._sums(index, rows, times)
    old_ids, old_start, old = lm._sums(index, (times.reshape(300, 7, 1) * rows[:, None, :]).reshape(-1, 6))
    assert (ids == old_ids).all() and (start == old_start).all() and (got == old).all()
