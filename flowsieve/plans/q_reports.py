"""Report-parsing queries and result summaries (2.7 / 2.9 on result rows).

Result texts are generated from ``orders``: orders are grouped into (model, attack, customer
range) runs, so their number grows with the table, and each run's counts become a result text
in one of four layouts (Vietnamese, English, headerless, decimal-comma / en-dash numbers) or a
text without results (empty, stray log). All numbers are built from
integer arithmetic so every engine renders identical text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.util import round6
from flowsieve.operators import reports as R
from flowsieve.operators import stats as ST
from flowsieve.operators.clean import row_index
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import sql, table
from flowsieve.plans.registry import register
from flowsieve.schema import ATTACK_MAPPING_V1
from flowsieve.session import scratch_path

MODELS = ["knn_model", "logistic_regression_model", "naive_bayes_model", "random_forest_model", "svm_model"]
ATTACKS = list(ATTACK_MAPPING_V1)[:10]


def _pick(values, idx):
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v))
    return out


def _fixed(v, scale: int):
    """Integer v / 10**scale rendered with exactly ``scale`` decimals (sign kept)."""
    a = F.abs(v)
    d = 10 ** scale
    body = F.concat((a / F.lit(d)).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((a % F.lit(d)).cast("string"), scale, "0"))
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), body)


def result_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.groupBy((F.col("o_custkey") % 5).cast("int").alias("mi"), (F.col("o_orderkey") % 10).cast("int").alias("ai"),
                  F.expr("o_custkey div 100").cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("correct"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("f1n"),
        F.sum(F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("low"),
        F.sum(F.floor("o_totalprice")).alias("price"))
    return g.select(
        _pick(MODELS, F.col("mi")).alias("model"), _pick(ATTACKS, F.col("ai")).alias("attack"),
        ((F.col("mi") + F.col("ai") + F.col("run")) % 9).alias("variant"), "run", "total",
        ((F.col("total") + 99) / 100).cast("bigint").alias("chunks"),
        (F.col("correct") * 10000 / F.col("total")).cast("bigint").alias("acc_bp"),
        (F.col("f1n") * 10000 / F.col("total")).cast("bigint").alias("f1_e4"),
        (F.col("low") * 50000 / F.col("total")).cast("bigint").alias("mre_e4"),
        (F.col("price") % 100000).cast("bigint").alias("time_cs"))


def result_texts(spark, sf_dir):
    r = result_runs(spark, sf_dir)
    v, model, attack = F.col("variant"), F.col("model"), F.col("attack")
    numbers = [F.col("total").cast("bigint"), F.col("chunks"), F.col("acc_bp") / 100, F.col("f1_e4") / 10000, F.col("mre_e4") / 10000,
               (F.lit(10000) - F.col("mre_e4")) / 10000, F.col("time_cs") / 100]
    en, vi = (R.result_text(layout, model, attack, *numbers) for layout in ("en", "vi"))
    headerless = R.result_text("vi", F.lit(None).cast("string"), attack, *numbers)
    comma = F.regexp_replace(F.regexp_replace(vi, r"(Accuracy TB: \d+)\.", "$1,"), "(MRA TB: )-", "$1–")
    text = (F.when(v == 0, en).when(v == 1, headerless).when(v == 2, comma).when(v == 7, F.lit(""))
            .when(v == 8, F.lit("run stopped, see the log")).otherwise(vi))
    path = F.concat(F.lit("/results/"), F.when(v % 2 == 0, F.lit("hmi-a")).otherwise(F.lit("hmi-b")), F.lit("/run"),
                    F.col("run").cast("string"), F.lit("/"), model, F.lit("_"), attack, F.lit(".txt"))
    # written once: the texts are the input of the queries, not part of their plans
    out = scratch_path(spark, "result-texts")
    r.select(path.alias("path"), text.alias("text"), "model", "attack", "run").write.parquet(out)
    return spark.read.parquet(out)


def _pick_sql(values, idx):
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _fixed_sql(v, scale):
    d = 10 ** scale
    return (f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(abs({v}) // {d} AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({v}) % {d} AS VARCHAR), {scale}, '0'))")


TEXTS_SQL = f"""
runs AS (
  SELECT {_pick_sql(MODELS, 'mi')} AS model, {_pick_sql(ATTACKS, 'ai')} AS attack, (mi + ai + run) % 9 AS variant, run, total,
         (total + 99) // 100 AS chunks, correct * 10000 // total AS acc_bp, f1n * 10000 // total AS f1_e4,
         low * 50000 // total AS mre_e4, 10000 - low * 50000 // total AS mra_e4, price % 100000 AS time_cs
  FROM (SELECT CAST(o_custkey % 5 AS INTEGER) AS mi, CAST(o_orderkey % 10 AS INTEGER) AS ai, CAST(o_custkey // 100 AS INTEGER) AS run, count(*) AS total,
               sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS correct,
               sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS f1n,
               sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low,
               CAST(sum(floor(o_totalprice)) AS BIGINT) AS price
        FROM orders GROUP BY 1, 2, 3)),
texts AS (
  SELECT '/results/' || CASE WHEN variant % 2 = 0 THEN 'hmi-a' ELSE 'hmi-b' END || '/run' || run || '/' || model || '_' || attack || '.txt' AS path,
    CASE WHEN variant = 7 THEN '' WHEN variant = 8 THEN 'run stopped, see the log' WHEN variant = 0 THEN hdr || 'Total samples: ' || total || chr(10) || 'Number of chunks: ' || chunks || chr(10)
           || 'Accuracy: ' || {_fixed_sql('acc_bp', 2)} || '%' || chr(10) || 'F1: ' || {_fixed_sql('f1_e4', 4)} || chr(10)
           || 'MRE: ' || {_fixed_sql('mre_e4', 4)} || chr(10) || 'MRA: ' || {_fixed_sql('mra_e4', 4)} || chr(10)
           || 'Total time: ' || {_fixed_sql('time_cs', 2)} || 's' || chr(10)
         ELSE CASE WHEN variant = 1 THEN '' ELSE hdr END
           || 'Tổng mẫu: ' || total || chr(10) || 'Số chunk: ' || chunks || chr(10) || 'Accuracy TB: '
           || CASE WHEN variant = 2 THEN replace({_fixed_sql('acc_bp', 2)}, '.', ',') ELSE {_fixed_sql('acc_bp', 2)} END
           || '%' || chr(10) || 'F1 TB: ' || {_fixed_sql('f1_e4', 4)} || chr(10) || 'MRE TB: ' || {_fixed_sql('mre_e4', 4)}
           || chr(10) || 'MRA TB: '
           || CASE WHEN variant = 2 THEN replace({_fixed_sql('mra_e4', 4)}, '-', '–') ELSE {_fixed_sql('mra_e4', 4)} END
           || chr(10) || 'Tổng thời gian: ' || {_fixed_sql('time_cs', 2)} || 's' || chr(10) END AS text,
    model, attack, run
  FROM (SELECT *, '=== ' || model || ' (' || attack || ') ===' || chr(10) AS hdr FROM runs))"""


def _re_first(text, pat):
    return f"(CASE WHEN regexp_matches({text}, '{pat}') THEN regexp_extract({text}, '{pat}', 1) END)"


def _clean_sql(raw):
    s = f"replace(replace(trim({raw}), '%', ''), '–', '-')"
    return (f"TRY_CAST(trim(CASE WHEN regexp_full_match({s}, '-?[0-9]+,[0-9]+') THEN replace({s}, ',', '.') "
            f"ELSE replace({s}, ',', '') END) AS DOUBLE)")


def _metric_sql(k):
    raw = _re_first("text", R.METRIC_PATTERNS[k])
    if k in R.ENGLISH_FALLBACKS:
        raw = f"coalesce({raw}, {_re_first('text', R.ENGLISH_FALLBACKS[k])})"
    return _clean_sql(raw)


def _parsed_sql():
    h, lh = R.HEADER_PATTERN, R.LOOSE_HEADER_PATTERN
    hm = _re_first("text", h)
    ha = f"(CASE WHEN regexp_matches(text, '{h}') THEN regexp_extract(text, '{h}', 2) END)"
    lm = _re_first("text", lh)
    la = f"(CASE WHEN regexp_matches(text, '{lh}') THEN regexp_extract(text, '{lh}', 2) END)"
    stem = "regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)"
    known = lambda part: "CASE " + " ".join(f"WHEN starts_with({stem}, '{m}_') THEN {part(m)}" for m in MODELS) + " END"
    km, ka = known(lambda m: f"'{m}'"), known(lambda m: f"substr({stem}, {len(m) + 2})")
    model = f"coalesce(CASE WHEN {hm} IS NOT NULL THEN trim({hm}) END, trim({lm}), {km}, {stem}.string_split_regex('[_-]')[1])"
    sm = f"regexp_extract({stem}, '^([^_-]*)[_-](.*)$', 2)"
    attack = (f"coalesce(CASE WHEN {hm} IS NOT NULL THEN nullif(trim({ha}), '') ELSE trim({la}) END, "
              f"{ka}, CASE WHEN regexp_matches({stem}, '[_-]') THEN {sm} END)")
    return f"""
parsed AS (SELECT path, text, {model} AS model, {attack} AS attack,
  CAST({_metric_sql('total_samples')} AS BIGINT) AS total_samples, CAST({_metric_sql('num_chunks')} AS INTEGER) AS num_chunks,
  {_metric_sql('accuracy')} AS accuracy_percent, {_metric_sql('f1')} AS f1, {_metric_sql('mre')} AS mre,
  {_metric_sql('mra')} AS mra, {_metric_sql('total_time')} AS total_time_s FROM texts),
rows AS (SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS folder, regexp_extract(path, '([^/]+)$', 1) AS file,
  model, attack, {sqlgen.map_label('attack')} AS attack_id, total_samples, num_chunks, accuracy_percent, f1, mre, mra,
  total_time_s FROM parsed WHERE coalesce(total_samples, num_chunks, accuracy_percent, f1, mre, mra, total_time_s) IS NOT NULL)"""


def result_rows(spark, sf_dir):
    """parse_result_folder over the generated texts: folder/file + parsed metrics + attack id."""
    t = result_texts(spark, sf_dir).select("path", "text")
    p = R.drop_rows_without_metrics(R.parse_result_text(t, "text", "path", MODELS))
    return p.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
                    F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                    "model", "attack", "attack_id", "total_samples", "num_chunks", "accuracy_percent", "f1",
                    "mre", "mra", "total_time_s")


ROW_COLS = "folder, file, model, attack, attack_id, total_samples, num_chunks, accuracy_percent, f1, mre, mra, total_time_s"


@register("parse_result_text", sql(TEXTS_SQL, _parsed_sql(), body=f"SELECT {ROW_COLS} FROM rows"))
def q_parse_result_text(spark, sf_dir):
    return result_rows(spark, sf_dir)


@register("split_stem", sql(TEXTS_SQL, body="""
SELECT path, string_split_regex(stem, '[_-]')[1] AS model,
       CASE WHEN regexp_matches(stem, '[_-]') THEN regexp_extract(stem, '^([^_-]*)[_-](.*)$', 2) END AS rest
FROM (SELECT path, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem
      FROM texts)"""))
def q_split_stem(spark, sf_dir):
    from flowsieve.functions.numbers import split_stem
    t = result_texts(spark, sf_dir)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    parts = split_stem(stem)
    return t.select("path", parts.getItem(0).alias("model"),
                    F.try_element_at(parts, F.lit(2)).alias("rest"))


@register("summary_by_model_attack", sql(TEXTS_SQL, _parsed_sql(), body=f"""
SELECT model, attack, CAST(count(*) AS BIGINT) AS count_files,
       {sqlgen.round6('avg(accuracy_percent)')} AS mean_accuracy, {sqlgen.round6('median(accuracy_percent)')} AS median_accuracy,
       {sqlgen.round6('avg(f1)')} AS mean_f1, {sqlgen.round6('median(f1)')} AS median_f1
FROM rows GROUP BY model, attack"""))
def q_summary_by_model_attack(spark, sf_dir):
    return ST.summary_by_group(result_rows(spark, sf_dir), ["model", "attack"],
                               {"accuracy": "accuracy_percent", "f1": "f1"})


@register("comparison_matrix", sql(TEXTS_SQL, _parsed_sql(), body="SELECT attack, " + ", ".join(
    f"coalesce({sqlgen.round6(f'avg(accuracy_percent) FILTER (WHERE model = {chr(39)}{m}{chr(39)})')}, 0.0) AS {m}" for m in MODELS)
    + " FROM rows GROUP BY attack"))
def q_comparison_matrix(spark, sf_dir):
    return ST.comparison_matrix(result_rows(spark, sf_dir), "attack", "model", "accuracy_percent")


@register("diff_within_group", sql(TEXTS_SQL, _parsed_sql(), body="""
SELECT model, folder, file, num_chunks, CAST(coalesce(num_chunks - lag(num_chunks) OVER (PARTITION BY model
       ORDER BY num_chunks NULLS LAST, folder, file), num_chunks) AS INTEGER) AS chunk_real FROM rows"""))
def q_diff_within_group(spark, sf_dir):
    r = result_rows(spark, sf_dir)
    out = ST.diff_within_group(r, "model", ["num_chunks", "folder", "file"], "num_chunks", "chunk_real")
    return out.select("model", "folder", "file", "num_chunks", F.col("chunk_real").cast("int").alias("chunk_real"))


@register("sort_nulls_last", sql(TEXTS_SQL, _parsed_sql(), body="""
SELECT CAST(row_number() OVER (ORDER BY model NULLS LAST, num_chunks NULLS LAST, folder, file) AS INTEGER) AS pos, model,
       num_chunks, folder, file FROM rows"""))
def q_sort_nulls_last(spark, sf_dir):
    r = result_rows(spark, sf_dir).select("model", "num_chunks", "folder", "file")
    # a range sort; the position shows its order
    s = row_index(r, [F.col("model").asc_nulls_last(), F.col("num_chunks").asc_nulls_last(), F.col("folder"), F.col("file")], "pos")
    return s.withColumn("pos", (F.col("pos") + 1).cast("int"))


@register("throughput", sql(TEXTS_SQL, _parsed_sql(), body=f"""
SELECT model, CAST(sum(total_samples) AS BIGINT) AS rows, {sqlgen.round6('sum(total_time_s)')} AS seconds,
       {sqlgen.round6('sum(total_samples) / sum(total_time_s)')} AS rows_per_s FROM rows GROUP BY model"""))
def q_throughput(spark, sf_dir):
    t = R.throughput(result_rows(spark, sf_dir), "model")
    return t.select("model", "rows", round6("seconds").alias("seconds"), round6("rows_per_s").alias("rows_per_s"))


# Metric names in a metric-line text.
_METRIC_NAMES = ["Accuracy", "F1-score (weighted)", "MRE", "MRA"]


def metric_line_texts(spark, sf_dir):
    r = result_runs(spark, sf_dir)
    prefix = F.when(F.col("variant") % 2 == 0, F.lit("CNN")).otherwise(F.lit("RNN"))
    text = F.concat(F.lit("Accuracy: "), _fixed(F.col("acc_bp"), 4), F.lit("\nF1-score (weighted): "),
                    _fixed(F.col("f1_e4"), 4), F.lit("\nMRE: "), _fixed(F.col("mre_e4"), 4), F.lit("\nMRA: "),
                    _fixed(F.greatest(F.col("mre_e4"), F.lit(0)), 4), F.lit("\n"))
    return r.select(F.concat(prefix, F.lit("_"), F.col("attack"), F.lit("_"), F.col("model"),
                             F.lit("_run"), F.col("run").cast("string"), F.lit("_result.txt")).alias("fname"), text.alias("text"))


@register("parse_metric_lines", sql(f"""
runs AS (SELECT {_pick_sql(MODELS, 'mi')} AS model, {_pick_sql(ATTACKS, 'ai')} AS attack, (mi + ai + run) % 9 AS variant, run,
                correct * 10000 // total AS acc_bp, f1n * 10000 // total AS f1_e4, low * 50000 // total AS mre_e4
  FROM (SELECT CAST(o_custkey % 5 AS INTEGER) AS mi, CAST(o_orderkey % 10 AS INTEGER) AS ai, CAST(o_custkey // 100 AS INTEGER) AS run, count(*) AS total,
               sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS correct,
               sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS f1n,
               sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low FROM orders GROUP BY 1, 2, 3))""", body=f"""
SELECT CASE WHEN variant % 2 = 0 THEN 'CNN' ELSE 'RNN' END AS model_family, attack || '_' || model || '_run' || run AS attack,
       CAST({_fixed_sql('acc_bp', 4)} AS DOUBLE) AS "Accuracy", CAST({_fixed_sql('f1_e4', 4)} AS DOUBLE) AS "F1-score (weighted)",
       CAST({_fixed_sql('mre_e4', 4)} AS DOUBLE) AS "MRE", CAST({_fixed_sql('greatest(mre_e4, 0)', 4)} AS DOUBLE) AS "MRA"
FROM runs"""))
def q_parse_metric_lines(spark, sf_dir):
    t = metric_line_texts(spark, sf_dir)
    fam = F.regexp_extract("fname", r"^(CNN|RNN)_", 1)
    att = F.regexp_extract("fname", r"^(?:CNN|RNN)_(.*)_result\.txt$", 1)
    p = R.parse_metric_lines(t.select(fam.alias("model_family"), att.alias("attack"), "text"), "text", _METRIC_NAMES)
    return p.drop("text")
