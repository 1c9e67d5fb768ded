"""The queries over texts see whole documents, in Spark and in their SQL."""

import duckdb

from quillframe.plans import catalogue, fixtures

DIR = "/root/testdata/sf0.001"


def test_texts_are_whole_documents(spark):
    whole = {1000000 + r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    con = duckdb.connect()
    for t in ("part", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    assert max(len(t or "") for t in whole.values()) > 60
    got = {r.id: r.text for r in fixtures.Inputs(spark, DIR).texts().where("id >= 1000000").collect()}
    assert got == whole
    assert dict(con.execute(f"select id, text from ({fixtures.DUCK['texts']}) q where id >= 1000000").fetchall()) == whole
    longest = max(whole, key=lambda i: len(whole[i] or ""))
    out = catalogue.queries()["visible_length"](spark, DIR).where(f"id = {longest}").first()[1]
    assert out == len(whole[longest].replace(" ", ""))
