"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import collections
import os

import duckdb
import pytest

import corpus_pipeline
from quillframe.llm import langid, pii, registry

DIR = "/root/testdata/sf0.001"


def clean(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = df.select(cols).collect()
    assert clean(got) == clean(con.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]}) q").fetchall())


def test_pipeline(spark, tmp_path):
    from test_near_copies import brute_roots
    from test_operators import exact_reference

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    frozen = tuple(sorted(model.items()))
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if not langid.classify(t, frozen)[2]}
    exact = exact_reference(kept.values(), kept.keys())
    kept = {i: t for i, t in kept.items() if exact[i][0] == i}
    ids = sorted(kept)
    kept = {ids[r]: kept[ids[r]] for r in brute_roots([kept[i] for i in ids])}
    stage = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stage, DIR).write.parquet(str(tmp_path / str(k)))
        stage = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert set(stage.columns) == set(docs.columns)
        if name == "pii":
            assert {r.doc_id: r.text for r in stage.collect()} == {i: pii.masked(t, pii.find(t)) for i, t in kept.items()}
    packed = collections.defaultdict(int)
    for r in stage.collect():
        packed[r.sequence_id] += r.length
    assert {r.doc_id for r in stage.collect()} == set(kept) and max(packed.values()) <= 2048
    whole = corpus_pipeline.run(spark, DIR).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.ids_crc32) for r in stage.collect()}
    assert os.path.exists(corpus_pipeline.__file__)


def test_stages_on_odd_rows(spark):
    """Nulls, repeated ids and rows, clashing columns, and no rows at all."""
    from test_operators import ODD

    rows = [(i, t, "en", "s", 1, True) for i, t in enumerate(ODD)] + [(None, "some words of it, said twice", None, None, None, None)] * 2
    rows += [(3, "quite another text with the id of three", "en", "s", 1, False), (3, None, "fr", "s", 0, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        got = out.collect()
        if name == "packing":
            assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.piece == 0 for r in got) == len(rows)
        else:
            assert set(out.columns) == set(docs.columns) and len(got) <= len(rows)
        if name == "pii":
            assert len(got) == len(rows)
        if name in ("exact_dedup", "near_dedup"):
            assert sum(r.text == "some words of it, said twice" for r in got) == 1 and sum(r.doc_id == 3 and r.text and "three" in r.text for r in got) == 1
        assert stage(spark, docs.limit(0), DIR).count() == 0
