"""The pipeline's rows against plain versions of its stages, on the small tables."""

import pytest

import corpus_pipeline as cp
from rowloom.llm import quality_mcd
from rowloom.llm._shared import stored
from rowloom.llm.text_stats import count_text
from tests.llm.test_minmax_dedup import brute
from tests.llm.test_pii_boost import base


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return [{r["doc_id"]: r for r in df.collect()} for df in out]


def test_columns_and_subsets(stages):
    for before, after in zip(stages[:4], stages[1:5]):
        assert set(after) <= set(before) and after
        assert all(list(r.asDict()) == cp.COLUMNS for r in after.values())


def test_quality_stage(spark, sf, stages):
    verdict = {r["doc_id"]: r["kept"] for r in quality_mcd.op7_quality_mcd(spark, sf).collect()}
    assert set(stages[1]) == {i for i, k in verdict.items() if k}
    assert all(count_text(r["text"])[0] >= 50 for r in stages[1].values())


def test_dedup_stage(stages):
    rows = [(i, r["text"]) for i, r in stages[1].items()]
    assert set(stages[2]) == {i for i, _, c in brute(rows, 5, 80) if i == c}


def test_personal_data_stage(stages):
    for i, r in stages[3].items():
        before = stages[2][i]["text"]
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(before) and "[SECRET]" not in r["text"]:
            assert r["text"] == before


def test_mixing_stage(stages):
    tokens = lambda rows: sum(len(r["text"].encode().split()) for r in rows.values())
    assert 0.5 < tokens(stages[4]) / tokens(stages[3]) <= cp.MIX_SHARE


def test_encoding_stage(spark, sf, stages):
    assert set(stages[5]) == set(stages[4]) and all(r["exact"] for r in stages[5].values())
    assert {r["doc_id"]: r["ids"] for r in cp.run(spark, sf).collect()} == {i: r["ids"] for i, r in stages[5].items()}


def test_odd_documents_pass_every_stage(spark, sf, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows and clashing columns, from the first stage to the last."""
    for docs in (odd_docs, no_docs):
        for at in range(len(cp.STAGES)):  # each stage on the odd rows themselves
            assert cp.STAGES[at][1](spark, docs, sf).count() <= docs.count()
        out = docs
        for name, stage in cp.STAGES:
            out = stored(stage(spark, out, sf), name.replace(" ", "-"))
        assert out.columns == ["doc_id", "n_tokens", "ids", "exact"]
    kept = cp.STAGES[0][1](spark, odd_docs, sf)
    assert kept.columns == cp.COLUMNS and {r["doc_id"] for r in kept.collect()} <= {1, 5, 6, 7, 10, 11, None}
