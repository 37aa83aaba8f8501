"""run() against plain Python (and DuckDB for mixing), stage by stage."""

import duckdb

import corpus_pipeline
from crosspath.llm import mixing, quality, sharding

from .helpers import SF, documents
from .test_decontaminate import naive as naive_contamination
from .test_quality import naive_counts
from .test_rest import check_shards
from .test_shingles import naive_kept


def test_run_matches_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in documents.collect()}
    outliers = {r.doc_id for r in quality.verdicts(documents).where("not base_failed and not kept").collect()}      # tested on its own
    rows = {i: t for i, t in rows.items() if not naive_counts(t)[-1] and i not in outliers}
    rows = {i: rows[i] for i in naive_kept(list(rows.items()))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r[0]: rows[r[0]] for r in naive_contamination(list(rows.items()), items) if not r[-1]}
    con = duckdb.connect()
    con.sql(f"create table survivors as select * from '{SF}/documents.parquet' where doc_id in ({', '.join(map(str, rows))})")
    rows = {i: rows[i] for i, in con.sql(f"select doc_id from ({mixing.sql('survivors')}) where kept").fetchall()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 20
    check_shards(got, list(rows.items()), sharding.SHARDS)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "sharding" or out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
