from collections import Counter

import corpus_pipeline
import pytest
from helpers import NASTY, SCHEMA, empty, nasty

from terracast.llm import minhash, packing
from terracast.session import reliable_cut as stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_rows(spark, k):
    out = corpus_pipeline.STAGES[k][1](spark, nasty(spark), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    rows = Counter((r.doc_id, r.text) for r in out.collect())
    given = Counter((i, t) for i, t, *_ in NASTY)
    if k != 1:
        assert not rows - given
    assert corpus_pipeline.STAGES[k][1](spark, empty(spark), SF).count() == 0


def test_stages_leave_foreign_tables_alone(spark):
    lazy = minhash.near_duplicates(nasty(spark), shingle=4, percent=80)
    kept = stored(corpus_pipeline.keep_one_of_near_copies(spark, nasty(spark), SF), "stage")
    corpus_pipeline.drop_contaminated(spark, kept, SF).count()
    assert lazy.count() == len(NASTY)


def test_near_copies_keep_one_row_each(spark):
    out = corpus_pipeline.keep_one_of_near_copies(spark, nasty(spark), SF).collect()
    assert sum((r.text or "").startswith("one two three four") for r in out) == 1
    assert sum(r.text is None or not r.text.strip() for r in out) == 3


def test_lines_drop_emptied_documents_only(spark):
    rows = [(1, "a first line of words\nand a second one here", "en", "s", 44), (2, "and a second one here", "en", "s", 21), (3, "", "en", "s", 0), (4, None, "en", "s", None), (5, "a first line of words\nnew", "en", "s", 25)]
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert out == {1: (rows[0][1], 44), 3: ("", 0), 4: (None, None), 5: ("new", 3)}


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name.replace(" ", "-"))
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left and 0 < len(left) < 200
    assert all(r.offset + r.length <= packing.CAPACITY for r in out)
