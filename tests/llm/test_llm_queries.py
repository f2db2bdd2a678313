"""Registered queries: SQL where there is some, and the pipeline's stages, on the smallest tables."""

import os
import random
import sys

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from flowsieve.llm import queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(E.__file__)), "tools"))
from oracle_check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    columns, want = rows_of(con.execute(queries.ORACLE[name]).df())
    names, got = rows_of(queries.QUERIES[name](spark, SF).toPandas())
    assert names == columns and sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= n, name
            n = docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() and "ids" in out.columns
    assert out.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_decodes_what_it_encodes(spark):
    docs = spark.createDataFrame([(1, "one two é😀", "en", "a", 10), (2, None, "en", "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    # the tokenizer's file names no decoder: token texts joined by spaces
    assert out[1].decoded.startswith("one</w> two</w> ") and len(out[1].ids) == out[1].n_tokens > 0 and out[2].decoded == ""


@pytest.mark.parametrize("rows", ["none", "awkward"])
def test_pipeline_stages_on_awkward_rows(spark, rows):
    """Nulls in every column, empty texts, ties, repeated rows, no rows: each stage returns rows of
    its input (or copies), and the last one tokens."""
    text = "one two three four five six " * 20
    some = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, text, "en", "a", 560), (3, text, "en", "a", 560),
            (4, text, None, "b", 560), (5, text + "mail a@b.cd now", "en", "b", None), (6, "you idiot", "en", "c", 9), (None, text, "en", "c", 1)]
    docs = spark.createDataFrame(some if rows == "awkward" else [], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.schema.names == docs.schema.names, name
        if name in ("toxicity", "simhash near-dedup"):
            assert out.exceptAll(docs).count() == 0, name
        docs = out
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
    if rows == "awkward":
        assert "a@b.cd" not in " ".join(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("times", [1, 3])
def test_pii_counts_repeated_rows_as_its_sql_does(spark, tmp_path, times):
    """A name that stands next to one address discloses it, however often the rows are repeated."""
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(12))
    told = [(i, f"Please contact Zorblax Quimby at q.zorblax@mail.example.org about {filler()}") for i in range(4)] * times
    rows = told + [(100 + i, filler()) for i in range(40)] + [(None, told[0][1]), (200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns, want = rows_of(con.execute(queries.ORACLE["op4_pii_sanitise"]).df())
    names, got = rows_of(queries.QUERIES["op4_pii_sanitise"](spark, str(tmp_path)).toPandas())
    assert names == columns and sorted(map(repr, got)) == sorted(map(repr, want))
    assert all("term:" in r.spans for r in queries.QUERIES["op4_pii_sanitise"](spark, str(tmp_path)).where("n_email > 0").collect())
    from flowsieve.llm import pii
    clean = [r.text or "" for r in pii.sanitise(docs).collect()]
    assert len(clean) == len(rows) and not any("Zorblax" in t or "Quimby" in t or "zorblax" in t for t in clean)
