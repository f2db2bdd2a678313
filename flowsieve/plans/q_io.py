"""Source and sink (2.2) queries as write -> read round trips.

Each query writes data derived from the driver tables into a fresh folder under the
shared checkpoint directory, reads it back with the operator under test, and returns
rows that the oracle computes straight from the parquet tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.util import md5_u32, qcol
from flowsieve.operators import metrics as M
from flowsieve.operators import reports as R
from flowsieve.operators import stats as ST
from flowsieve.operators.sampling import hash_sample, sample_exact_per_group
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import FLOWS_SQL, flows, sql
from flowsieve.plans.common import BASE_CTES, RULE_PAIRS_SQL, prepare, rule_pairs, rule_prediction
from flowsieve.plans.q_eval import _nb_sql_ctes, nb_predictions
from flowsieve.plans.q_reports import TEXTS_SQL, _parsed_sql, result_rows, result_texts
from flowsieve.plans.registry import register
from flowsieve.schema import ATTACK_MAPPING_V1
from flowsieve.session import scratch_path, shuffles_freed
from flowsieve.sinks import writers as W
from flowsieve.sources import flows as FS
from flowsieve.sources import texts as TX

q = sqlgen.q
WRITE_COLS = ["Flow ID", "Source IP", "Destination IP", "Timestamp", "Protocol", "Packets", "Bytes", "Discount",
              "Tax", "Size", "Retail Price", "Flow Bytes/s", "SimillarHTTP", "Inbound", "Label", "chunk_id"]


def _flows_csv(spark, sf_dir, line_breaks: bool = False, complete: bool = False):
    """Flow CSVs in two layouts below one folder: padded headers; and the columns the other way
    round, without ``Tax`` (unless ``complete``), with a column of their own and one name twice.
    ``line_breaks`` puts some into a quoted text column."""
    path = scratch_path(spark, "flows-csv")
    f = flows(spark, sf_dir)
    if line_breaks:
        f = f.withColumn("SimillarHTTP", F.when(F.col("Inbound") == 1, F.lit("GET /\nHost: a, b")).otherwise(F.col("SimillarHTTP")))
    FS.write_flow_csv(f.where("Protocol = 6").select(*WRITE_COLS, "source_file"), f"{path}/export-1", partition_by="source_file")
    other = [c for c in reversed(WRITE_COLS) if complete or c != "Tax"]
    f = f.where("Protocol <> 6").select(F.lit("n/a").alias("Note"), *[qcol(c) for c in other], F.col("Bytes").alias(" Bytes"), "source_file")
    FS.write_flow_csv(f, f"{path}/export-2", pad="", partition_by="source_file")
    return path


def _stem_sql():
    return "regexp_extract(source_file, '^(.*)\\.csv$', 1)"


@register("scan_flow_csv", sql(FLOWS_SQL, body=f"""
SELECT "Flow ID", nullif("Source IP", '') AS "Source IP", "Protocol", "Flow Bytes/s", "Label", {_stem_sql()} AS file
FROM flows"""))
def q_scan_flow_csv(spark, sf_dir):
    df = FS.read_flow_csv(spark, _flows_csv(spark, sf_dir))
    return df.select("Flow ID", "Source IP", "Protocol", "Flow Bytes/s", "Label", FS.file_stem().alias("file"))


@register("trim_column_names", sql(FLOWS_SQL, body="""
SELECT "Flow ID", "Packets", "Bytes", CASE WHEN "Protocol" <> 6 THEN CAST("Bytes" AS VARCHAR) END IS NOT NULL AS twice, "Label"
FROM flows"""))
def q_trim_column_names(spark, sf_dir):
    df = FS.read_flow_csv(spark, _flows_csv(spark, sf_dir))
    return df.select("Flow ID", "Packets", "Bytes", qcol("Bytes.1").isNotNull().alias("twice"), "Label")


@register("dtype_override", sql(FLOWS_SQL, body='SELECT "Flow ID", "SimillarHTTP", "Protocol" FROM flows'))
def q_dtype_override(spark, sf_dir):
    df = FS.read_flow_csv(spark, _flows_csv(spark, sf_dir), string_columns=["SimillarHTTP"])
    return df.select("Flow ID", "SimillarHTTP", "Protocol")


CHUNK_ROWS = 1000  # rows of a chunk; the tables here have some thousand rows a file


def _ordered_csv(spark, sf_dir, *columns, line_breaks: bool = False):
    """One folder of part files for each source file, its rows in the order of their ids."""
    path = scratch_path(spark, "flows-ordered")
    f = flows(spark, sf_dir).select("source_file", "Flow ID", *columns)
    if line_breaks:
        f = f.withColumn("SimillarHTTP", F.when(md5_u32(F.col("Flow ID")) % 3 == 0, F.lit('GET /\n"Host": a, b')).otherwise(F.col("SimillarHTTP")))
    f = f.repartitionByRange("source_file", "Flow ID").sortWithinPartitions("source_file", "Flow ID")
    with shuffles_freed(spark):
        FS.write_flow_csv(f.select("Flow ID", *columns, "source_file"), path, partition_by="source_file")
    return path


@register("scan_chunked", sql(FLOWS_SQL, body=f"""
SELECT file, "Flow ID", "SimillarHTTP", position, CAST(position // {CHUNK_ROWS} AS INTEGER) AS chunk_id FROM (
  SELECT {_stem_sql()} AS file, "Flow ID", CASE WHEN crc = 0 THEN 'GET /' || chr(10) || '"Host": a, b' ELSE "SimillarHTTP" END AS "SimillarHTTP",
         CAST(row_number() OVER (PARTITION BY source_file ORDER BY "Flow ID") - 1 AS BIGINT) AS position FROM (SELECT *, {sqlgen.md5_u32('"Flow ID"')} % 3 AS crc FROM flows))"""))
def q_scan_chunked(spark, sf_dir):
    """Chunks of consecutive rows of each file; some rows hold line breaks in quotes."""
    df = FS.read_flow_csv(spark, _ordered_csv(spark, sf_dir, "SimillarHTTP", line_breaks=True), multiline=True, positions=True)
    return FS.with_chunks(df, CHUNK_ROWS).select(FS.file_stem().alias("file"), "Flow ID", "SimillarHTTP", "position", "chunk_id")


_CHUNKED_SQL = f"""
chunked AS (SELECT * REPLACE (CAST((row_number() OVER (PARTITION BY source_file ORDER BY "Flow ID") - 1) // {CHUNK_ROWS} AS INTEGER) AS chunk_id) FROM flows)"""


def _chunked_flows(spark, sf_dir):
    """Flows read from CSV, with the file and the chunk of consecutive rows that each stands in."""
    columns = [c for c in WRITE_COLS if c not in ("Flow ID", "SimillarHTTP", "chunk_id")]
    df = FS.with_chunks(FS.read_flow_csv(spark, _ordered_csv(spark, sf_dir, *columns), positions=True), CHUNK_ROWS)
    return df.withColumn("source_file", F.concat(FS.file_stem(), F.lit(".csv")))


_rc, _rb = sqlgen.summary_metrics_sql("pairs", ["source_file", "chunk_id"])


@register("metrics_by_row_chunk", sql(FLOWS_SQL, _CHUNKED_SQL, sqlgen.prepared_cte(src="chunked"), RULE_PAIRS_SQL, _rc, body=_rb))
def q_metrics_by_row_chunk(spark, sf_dir):
    """Metrics of every chunk of consecutive rows of a file, the unit over which a run's metrics are averaged."""
    pairs = prepare(_chunked_flows(spark, sf_dir), ["source_file", "chunk_id"]).select("source_file", "chunk_id", "y", rule_prediction().alias("p"))
    return M.summary_metrics(pairs, "y", "p", by=["source_file", "chunk_id"])


@register("sample_per_row_chunk", sql(FLOWS_SQL, _CHUNKED_SQL, body=f"""
SELECT source_file, chunk_id, "Flow ID" FROM (
  SELECT source_file, chunk_id, "Flow ID", count(*) OVER w AS cnt, row_number() OVER (w ORDER BY {sqlgen.md5_u32('"Flow ID"')}, "Flow ID") AS r
  FROM chunked WINDOW w AS (PARTITION BY source_file, chunk_id)) WHERE r <= greatest(1, floor(cnt / 30))"""))
def q_sample_per_row_chunk(spark, sf_dir):
    """A thirtieth of every chunk of consecutive rows."""
    f = _chunked_flows(spark, sf_dir).select("source_file", "chunk_id", "Flow ID").withColumn("chunk", F.concat_ws("#", "source_file", "chunk_id"))
    return sample_exact_per_group(f, "chunk", "Flow ID", 1 / 30, minimum=1, levels=26, many_groups=True).select("source_file", "chunk_id", "Flow ID")


@register("label_from_filename", sql(FLOWS_SQL, body=f"""
SELECT "Flow ID", {sqlgen.map_label(_stem_sql())} AS file_label, NULL AS skipped_file, NULL::BIGINT AS skipped_rows FROM flows
WHERE {sqlgen.map_label(_stem_sql())} IS NOT NULL
UNION ALL SELECT NULL, NULL, {_stem_sql()}, CAST(count(*) AS BIGINT) FROM flows
WHERE {sqlgen.map_label(_stem_sql())} IS NULL GROUP BY 3"""))
def q_label_from_filename(spark, sf_dir):
    kept, skipped = FS.read_labelled(spark, _flows_csv(spark, sf_dir), ATTACK_MAPPING_V1)
    report = skipped.select(F.col("file").alias("skipped_file"), F.col("rows").alias("skipped_rows"))
    return kept.select("Flow ID", "file_label").unionByName(report, allowMissingColumns=True)


@register("rows_per_file", sql(FLOWS_SQL, body=f"""
SELECT {_stem_sql()} AS file, CAST(count(*) AS BIGINT) AS rows FROM flows GROUP BY 1"""))
def q_rows_per_file(spark, sf_dir):
    return FS.count_per_file(spark, _flows_csv(spark, sf_dir, line_breaks=True))


HEAD_N = 5000


@register("head_per_file", sql(FLOWS_SQL, body=f"""
SELECT file, "Flow ID" FROM (SELECT {_stem_sql()} AS file, "Flow ID",
  row_number() OVER (PARTITION BY source_file ORDER BY "Flow ID") AS r FROM flows) WHERE r <= {HEAD_N}"""))
def q_head_per_file(spark, sf_dir):
    df = FS.head_rows(spark, _ordered_csv(spark, sf_dir, "Label"), HEAD_N)
    return df.select(FS.file_stem().alias("file"), "Flow ID")


@register("scan_parquet", sql(FLOWS_SQL, body="""
SELECT "Flow ID", "Packets", "Bytes" FROM flows WHERE "Label" = 'Syn'"""))
def q_scan_parquet(spark, sf_dir):
    path = scratch_path(spark, "flows-parquet")
    flows(spark, sf_dir).write.mode("overwrite").parquet(path)
    # the Label predicate and the 3-column projection reach the parquet reader
    return spark.read.parquet(path).where(qcol("Label") == "Syn").select("Flow ID", "Packets", "Bytes")


@register("scan_stream", sql(FLOWS_SQL, body='SELECT "Flow ID", "Label", "Packets" FROM flows'))
def q_scan_stream(spark, sf_dir):
    from flowsieve.streaming.flows import read_output, stream_flow_csv_to_parquet
    src = _flows_csv(spark, sf_dir)
    out = stream_flow_csv_to_parquet(spark, src, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"),
                                     ["Flow ID", "Label", "Packets"])
    return read_output(spark, out)


def _wholetext_sql(where=""):
    h = R.HEADER_PATTERN
    return sql(TEXTS_SQL, _parsed_sql(), body=f"""
SELECT coalesce(CASE WHEN regexp_matches(p.text, '{h}') THEN trim(regexp_extract(p.text, '{h}', 1)) END, r.model) AS model,
       coalesce(CASE WHEN regexp_matches(p.text, '{h}') THEN trim(regexp_extract(p.text, '{h}', 2)) END, r.attack) AS attack,
       p.total_samples, p.num_chunks, p.accuracy_percent, p.f1, p.mre, p.mra, p.total_time_s
FROM parsed p JOIN (SELECT model, attack, '/results/' || CASE WHEN variant % 2 = 0 THEN 'hmi-a' ELSE 'hmi-b' END
                    || '/run' || run || '/' || model || '_' || attack || '.txt' AS path FROM runs) r ON p.path = r.path {where}""")


def _write_reports(spark, sf_dir):
    t = result_texts(spark, sf_dir)
    path = scratch_path(spark, "reports")
    TX.write_texts(t.select("text", "run", "model", "attack"), path, ["run", "model", "attack"])
    return path


@register("scan_wholetext", _wholetext_sql())
def q_scan_wholetext(spark, sf_dir):
    back = TX.read_whole_texts(spark, _write_reports(spark, sf_dir))
    p = R.parse_result_text(back, "text", "path")
    return p.select("model", "attack", "total_samples", "num_chunks", "accuracy_percent", "f1", "mre", "mra",
                    "total_time_s")


@register("parse_result_folder", _wholetext_sql(
    "WHERE coalesce(p.total_samples, p.num_chunks, p.accuracy_percent, p.f1, p.mre, p.mra, p.total_time_s) IS NOT NULL"))
def q_parse_result_folder(spark, sf_dir):
    back = TX.read_whole_texts(spark, _write_reports(spark, sf_dir))
    p = R.drop_rows_without_metrics(R.parse_result_text(back, "text", "path"))
    return p.select("model", "attack", "total_samples", "num_chunks", "accuracy_percent", "f1", "mre", "mra",
                    "total_time_s")


@register("sink_report", sql(TEXTS_SQL, body="SELECT CAST(run AS VARCHAR) AS run, model, attack, text FROM texts"))
def q_sink_report(spark, sf_dir):
    back = TX.read_whole_texts(spark, _write_reports(spark, sf_dir))
    # each written file is the text plus the line terminator of the text writer
    return back.select(F.regexp_extract("path", r"/run=([^/]+)/", 1).alias("run"),
                       F.regexp_extract("path", r"/model=([^/]+)/", 1).alias("model"),
                       F.regexp_extract("path", r"/attack=([^/]+)/", 1).alias("attack"),
                       F.when(F.col("text").endswith("\n"), F.expr("substring(text, 1, length(text) - 1)"))
                       .otherwise(F.col("text")).alias("text"))


def _name_sql(c):
    return f"CASE {c} " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in ATTACK_MAPPING_V1.items()) + f" ELSE CAST({c} AS VARCHAR) END"


@register("sink_predictions", sql(*BASE_CTES, _nb_sql_ctes(), f"""
prob AS (SELECT flow_id, exp(s - max(s) OVER (PARTITION BY flow_id)) AS e FROM scored),
tops AS (SELECT flow_id, list_reverse_sort(list(e / t)) AS top FROM (
  SELECT flow_id, e, sum(e) OVER (PARTITION BY flow_id) AS t FROM prob) GROUP BY flow_id)""", body=f"""
SELECT CAST(row_number() OVER (ORDER BY flow_id) - 1 AS BIGINT) AS idx, flow_id, y, p, {_name_sql('y')} AS true_name,
       {_name_sql('p')} AS predicted_name, y = p AS correct, round(top[1], 3) + 0.0 AS top1, round(top[2], 3) + 0.0 AS top2,
       round(top[3], 3) + 0.0 AS top3, 'gaussian_nb' AS model FROM nbpred JOIN tops USING (flow_id)"""))
def q_sink_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    scored = nb_predictions(spark, sf_dir, keep_scores=True)
    W.write_predictions(W.prediction_output(scored, "flow_id", "y", "p", "_nb_scores", "gaussian_nb"), path)
    columns = "flow_id string, y int, p int, true_name string, predicted_name string, correct boolean, top1 double, top2 double, top3 double, idx bigint"
    return W.read_csv(spark, path, columns + ", model string")


_mc, _mb = sqlgen.summary_metrics_sql("pairs", ["chunk_id"])


@register("sink_metrics", sql(*BASE_CTES, RULE_PAIRS_SQL, _mc, body=_mb))
def q_sink_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    W.write_csv(M.summary_metrics(rule_pairs(spark, sf_dir), "y", "p", by=["chunk_id"]), path)
    return W.read_csv(spark, path, "chunk_id int, samples bigint, accuracy double, f1_weighted double, mre double, "
                                   "mra double")


@register("sink_sample", sql(FLOWS_SQL, body=f"""
SELECT "Flow ID", "Label" FROM flows WHERE {sqlgen.md5_u32('"Flow ID"')} < {int(4294967296 / 600)}"""))
def q_sink_sample(spark, sf_dir):
    path = scratch_path(spark, "sample")
    W.write_csv(hash_sample(flows(spark, sf_dir), qcol("Flow ID"), 1 / 600).select("Flow ID", "Label"), path)
    return W.read_csv(spark, path, "`Flow ID` string, Label string")


@register("sink_two_tables", sql(TEXTS_SQL, _parsed_sql(), body=f"""
SELECT model, attack, CAST(count(*) AS BIGINT) AS count_files,
       {sqlgen.round6('avg(accuracy_percent)')} AS mean_accuracy, {sqlgen.round6('median(accuracy_percent)')} AS median_accuracy,
       {sqlgen.round6('avg(f1)')} AS mean_f1, {sqlgen.round6('median(f1)')} AS median_f1, CAST(count(*) AS BIGINT) AS raw_rows
FROM rows GROUP BY model, attack"""))
def q_sink_two_tables(spark, sf_dir):
    raw = result_rows(spark, sf_dir)
    summary = ST.summary_by_group(raw, ["model", "attack"], {"accuracy": "accuracy_percent", "f1": "f1"})
    rp, sp = W.write_two_tables(raw, summary, scratch_path(spark, "two-tables"))
    raw_back = spark.read.parquet(rp).groupBy("model", "attack").agg(F.count(F.lit(1)).cast("bigint").alias("raw_rows"))
    return spark.read.parquet(sp).join(raw_back, ["model", "attack"])


def _bucket_sql():
    return f"CAST({sqlgen.md5_u32('\"Flow ID\"')} % 20 AS INTEGER)"


@register("rechunk", sql(FLOWS_SQL, body=f"SELECT {_bucket_sql()} AS bucket, CAST(count(*) AS BIGINT) AS rows "
                                        "FROM flows GROUP BY 1"))
def q_rechunk(spark, sf_dir):
    path = scratch_path(spark, "rechunk")
    W.rechunk(flows(spark, sf_dir).select("Flow ID", "Label"), qcol("Flow ID"), path, 20)
    return spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


@register("split_holdout_buckets", sql(FLOWS_SQL, body=f"""
SELECT "Flow ID", {_bucket_sql()} AS bucket FROM flows WHERE {_bucket_sql()} >= 15"""))
def q_split_holdout_buckets(spark, sf_dir):
    path = scratch_path(spark, "rechunk")
    W.rechunk(flows(spark, sf_dir).select("Flow ID"), qcol("Flow ID"), path, 20)
    return W.read_buckets(spark, path, 15, 19).select("Flow ID", "bucket")

