import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, columns = {r["doc_id"] for r in docs.collect()}, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF))
        now = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and now <= ids
        ids = now
    assert len(ids) > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == ids


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("aehinorst") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."
    copy = prose(120)
    rows = [(20_000 + i, prose(90), "en", "s1") for i in range(12)]
    rows += [(30_000, None, None, None), (30_001, "", "en", "s1"), (30_002, prose(40_000), "en", "s2"), (20_000, rows[0][1], "en", "s1"), (30_004, copy, "en", "s3"), (30_003, copy, "de", "s4")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __id string, row string")


@pytest.mark.parametrize("k", range(5))
def test_a_stage_on_odd_rows_and_on_none(spark, odd, k):
    _, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF)
    ids = [r["doc_id"] for r in got.collect()]
    assert {30_002, *range(20_000, 20_012)} <= set(ids)  # clean prose stays, however long
    if k < 4:
        assert got.columns == odd.columns
    if k == 3:  # of copies the smallest id, of equal rows one, of texts without words one
        assert sorted(ids) == sorted([*range(20_000, 20_012), 30_000, 30_002, 30_003])
    if k in (1, 2, 4):
        assert set(ids) == {r["doc_id"] for r in odd.collect()}
    assert stage(spark, odd.where("false"), SF).count() == 0
