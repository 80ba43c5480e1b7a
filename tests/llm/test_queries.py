"""Registered queries of the subpackage against their SQL, and the pipeline stage by stage."""

import re
from collections import Counter

import pytest
from edge import SCHEMA, edge_rows
from oracle_check import compare, duck
from pyspark.sql import functions as F
from test_near_copies import brute_least

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from terrafold.llm.oracle import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ok, note = compare(spark, duck(SF), queries()[name], oracle_sql()[name], SF)
    assert ok, note


def test_names():
    names = {n for n in queries() if re.match(r"op\d+_", n)}
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in queries()


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what its predecessor wrote; its decisions against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.toPandas())
    scored, lines, single, mixed, coded = seen
    assert 120 < len(scored) < 200 and set(lines["doc_id"]) == set(scored["doc_id"])
    want = {c for _, _, c in brute_least([(r.doc_id, r.text) for r in lines.itertuples()], 5, 80)}
    assert sorted(single["doc_id"]) == sorted(want)
    assert (lines["n_chars"] == lines["text"].str.len()).all()
    texts = dict(zip(single["doc_id"], single["text"]))
    words = {i: Counter(t.split()) for i, t in texts.items()}
    for i, part in mixed.groupby("doc_id"):
        assert len(part) <= 2
        for text in part["text"]:
            assert not Counter(text.split()) - words[i]
    assert len(coded) == len(mixed) and Counter(coded["doc_id"]) == Counter(mixed["doc_id"])
    run = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(map(tuple, run.values.tolist())) == Counter(map(tuple, coded.values.tolist()))


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows, ids with two texts and columns with the operators' own names."""
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert docs.filter(F.col("block") == 6).count() == docs.count() > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
