"""The pipeline against a brute-force version of its stages, and the queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from cueline.llm import queries, sharding
from cueline.llm.oracles import ORACLES
from tests.llm.test_operators import components, maglev, plain_fingerprint, plain_marks


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, sf)
        got = out.collect()
        ids = {r.doc_id for r in got}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert not [i for i in ids if labels.get(i) == 1] and {i for i, t in labels.items() if t == 0} <= ids
        elif name == "near_duplicates":
            want = components({r.doc_id: plain_fingerprint(r.text) for r in rows})
            assert ids == set(want.values()) and len(got) == len(ids)
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            marks = plain_marks([(r.doc_id, r.text) for r in rows], bench)
            assert ids == {i for i, m in marks.items() if not m[-1]}
        elif name == "mixing":
            assert ids == {r.doc_id for r in rows} and len(got) >= len(rows)
        else:
            table = maglev(sharding.shard_names(), sharding.TABLE_SIZE)
            assert len(got) == len(rows) and all(table[r.slot] == r.shard for r in got)
        if name != "sharding":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        from cueline.llm.common import materialise

        docs = materialise(out, "test")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.sql(ORACLES[name])
    places = [list(found.columns).index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in places)) for r in found.fetchall())
