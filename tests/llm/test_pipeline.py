from collections import Counter

import __spark_entry__
import corpus_pipeline
import odd
import pytest
from opalgrid.llm import mixing
from test_dedup import brute_force, groups_of
from test_mix_pack import check_pieces


def test_stages(spark, tiny):
    """Every stage against a plain version of itself on what the one before it kept."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, tiny)
        rows = docs.collect()
        kept[name] = len(rows)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
            ids = {r.doc_id for r in rows}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in ids for i in good) >= 0.97 * len(good) and len(rows) < len(before)
        if name == "exact_dedup":
            assert sorted(r.doc_id for r in rows) == sorted(max(g) for g in groups_of([(r.doc_id, r.text) for r in before]).values())
        if name == "near_dedup":
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n, c in brute_force([(r.doc_id, r.text) for r in before]) if i == c)
        if name == "mixing":
            taken, sizes = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(r.text.split())
            for r in rows:
                taken[r.source] += len(r.text.split())
            target = mixing.source_targets(dict(sizes))
            assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 5 for s in target)
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
        if name == "packing":
            tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
            texts = {r.doc_id: r.text for r in before}
            copies = Counter(r.doc_id for r in before)
            assert Counter(r.doc_id for r in rows if r.piece == 0) == copies
            once = [i for i in texts if copies[i] == 1]
            check_pieces([r for r in rows], [(i, texts[i]) for i in once], tokenizer)
    assert kept["exact_dedup"] < kept["quality"] and kept["near_dedup"] < kept["exact_dedup"]


def test_run_is_registered(spark, tiny):
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    assert corpus_pipeline.run(spark, tiny).columns[0] == "doc_id"


@pytest.fixture
def folder(spark, tmp_path):
    """Labels for the odd documents, as a folder of tables."""
    labels = [(1, 1, 0), (2, 0, 0), (6, 1, 0), (7, 0, 1), (7, None, 1), (None, 1, 1), (10, 1, None), (12, 0, 0), (14, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_rows_and_keep_all_columns(spark, folder, stage):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with dots, quotes and the names that operators use."""
    name, run = stage
    docs = odd.clashing(spark)
    out = run(spark, docs, folder)
    rows = out.collect()
    assert len(rows) > 0
    if name == "packing":
        return
    assert out.columns == docs.columns
    given = Counter(map(str, docs.collect()))
    got = Counter(map(str, rows))
    assert set(got) <= set(given) and all(r["kept"] == f"kept of {'none' if r.doc_id is None else r.doc_id}" for r in rows)
    if name != "mixing":
        assert all(got[r] <= given[r] for r in got)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_empty_tables(spark, folder, stage):
    name, run = stage
    docs = odd.clashing(spark).limit(0)
    out = run(spark, docs, folder)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_odd_rows_go_through_all_stages(spark, folder):
    docs = odd.clashing(spark)
    for _, run in corpus_pipeline.STAGES:
        docs = run(spark, docs, folder)
    assert docs.count() > 0


def test_all_operators_have_a_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
