"""Every registered query on the smallest tables, and the stages against what they promise."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from shopfront.llm import near_dup
from shopfront.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    from __spark_entry__ import queries

    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", ["op3_quoted_replies", "op7_licenses", "op10_nearest"])
def test_queries_cover_their_tables(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).count()
    table = {"op3_quoted_replies": "conversations", "op7_licenses": "documents"}.get(name)
    assert rows == (spark.read.parquet(f"{sf_dir}/{table}.parquet").count() if table else 25 * 20)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_agree_with_sql(spark, sf_check, name):
    duck = duckdb.connect()
    for file in Path(sf_check).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    table, answer = QUERIES[name](spark, sf_check), duck.sql(ORACLE_SQL[name])
    columns = sorted(table.columns)
    assert sorted(answer.columns) == columns
    expected = answer.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(tuple, table.select(*columns).collect())) == sorted(expected) and expected


def test_stages(spark, sf_check):
    sf_dir = sf_check
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.stage(step(spark, before, sf_dir), f"test-{name}")
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
            assert len(gone & toxic) >= 0.9 * len(toxic)
        elif name == "near_duplicates":
            linked = near_dup.link(before).collect()
            assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in linked})
        elif name == "decontamination":
            assert not any(b in " ".join(r.text.split()) for r in after.collect() for b in bench)
        elif name == "personal_data":
            assert after.count() == before.count()
            assert not after.where("text RLIKE '[a-z]@mail'").count()
        else:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
        before = after
