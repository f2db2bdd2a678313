"""The registered queries of the training-data operators: thin views over the operators."""

from __future__ import annotations

from flowsieve.llm import (bitsliced, bpe, collocations, language, licenses, maxsketch, mixing, oracles, parsing, pii, quality,
                           simhash, suffixes, toxicity)
from flowsieve.llm.common import documents

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_mix_sources(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


@query
def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op6_bpe_encode_decode(spark, sf_dir):
    import public_tokenizers

    return bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query
def op3_bit_sliced_top_k(spark, sf_dir):
    return bitsliced.top_inner_products(documents(spark, sf_dir, "embeddings"))


ORACLE["op3_bit_sliced_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query
def op9_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


ORACLE["op9_license_scan"] = oracles.license_scan()


@query
def op4_pii_sanitise(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


ORACLE["op4_pii_sanitise"] = oracles.pii_find()


@query
def op10_document_fingerprints(spark, sf_dir):
    return parsing.edited_fingerprints(documents(spark, sf_dir))


@query
def op2_quality_cnn(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op5_toxicity_chain(spark, sf_dir):
    return toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(documents(spark, sf_dir))


@query
def op11_language_id(spark, sf_dir):
    return language.identify(documents(spark, sf_dir))


@query
def op12_phrase_collocations(spark, sf_dir):
    return collocations.mine(documents(spark, sf_dir))


ORACLE["op12_phrase_collocations"] = oracles.collocations()


@query
def op13_max_sketch_search(spark, sf_dir):
    return maxsketch.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


ORACLE["op13_max_sketch_search"] = oracles.ranked_search()
