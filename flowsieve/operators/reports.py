"""Parsing of per-(model, attack) result texts into metric rows, and result summaries.

All parsing is ``regexp_extract`` + ``coalesce`` over a text column, so a folder of
millions of small result files parses as an ordinary distributed projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.labels import map_label
from flowsieve.functions.numbers import clean_number

# ---------------------------------------------------------------------------
# Result-text patterns that must equal the original tool's so the
# same texts parse to the same numbers (Vietnamese labels first, English fallbacks).
HEADER_PATTERN = r"={2,}\s*([^\s(]+)\s*\(?([A-Za-z0-9_+-]*)\)?\s*={2,}"
LOOSE_HEADER_PATTERN = r"([^\s(]+)\s*\(\s*([A-Za-z0-9_+-]+)\s*\)"
METRIC_PATTERNS = {
    "total_samples": r"(?i)Tổng mẫu[:\s]*([0-9,.-]+)",
    "num_chunks": r"(?i)Số chunk[:\s]*([0-9,.-]+)",
    "accuracy": r"(?i)Accuracy(?: TB)?[:\s]*([-–]?[0-9.,]+)%?",
    "f1": r"(?i)F1(?: TB)?[:\s]*([-–]?[0-9.,]+)",
    "mre": r"(?i)MRE(?: TB)?[:\s]*([-–]?[0-9.,]+)",
    "mra": r"(?i)MRA(?: TB)?[:\s]*([-–]?[0-9.,]+)",
    "total_time": r"(?i)Tổng thời gian[:\s]*([-–]?[0-9.,]+)s",
}
ENGLISH_FALLBACKS = {
    "total_samples": r"(?i)Total samples[:\s]*([0-9,.-]+)",
    "num_chunks": r"(?i)Number of chunk[s]*[:\s]*([0-9,.-]+)",
    "accuracy": r"(?i)Accuracy[:\s]*([-–]?[0-9.,]+)%",
    "total_time": r"(?i)Total time[:\s]*([-–]?[0-9.,]+)s",
}
# ---------------------------------------------------------------------------

# Lines of a result text in order, with their number formats.
LAYOUTS = {
    "vi": [("Tổng mẫu", "%d"), ("Số chunk", "%d"), ("Accuracy TB", "%.2f%%"), ("F1 TB", "%.4f"), ("MRE TB", "%.4f"),
           ("MRA TB", "%.4f"), ("Tổng thời gian", "%.2fs")],
    "en": [("Total samples", "%d"), ("Number of chunks", "%d"), ("Accuracy", "%.2f%%"), ("F1", "%.4f"), ("MRE", "%.4f"),
           ("MRA", "%.4f"), ("Total time", "%.2fs")],
}

OUTPUT_NAMES = {"total_samples": "total_samples", "num_chunks": "num_chunks", "accuracy": "accuracy_percent",
                "f1": "f1", "mre": "mre", "mra": "mra", "total_time": "total_time_s"}


def _extract(text, pattern: str, group: int = 1):
    """First match of a group, or null when the pattern does not occur: one pass."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def _known_model(stem, models) -> tuple:
    """(model, attack) of a file stem ``<model>_<attack>`` whose model name is known; names may hold
    the separators themselves, so the longest that fits wins."""
    model = attack = None
    for m in sorted(models, key=len):
        fits = stem.rlike(f"^{re.escape(m)}[_-]")
        rest = F.substring(stem, len(m) + 2, 1_000)
        model = F.when(fits, F.lit(m)) if model is None else F.when(fits, F.lit(m)).otherwise(model)
        attack = F.when(fits, rest) if attack is None else F.when(fits, rest).otherwise(attack)
    return model, attack


def parse_result_text(df: DataFrame, text: str = "text", path: str | None = None, models=()) -> DataFrame:
    """Rows of (model, attack, attack_id, metrics...). Model/attack come from the header,
    else a loose ``name (attack)`` match, else Spark partition folders ``model=/attack=``
    in the path, else the file stem: split after a known model name, else once on '_' or '-'.

    Two projections: the matches, then their cleaning, so each pattern runs once a text."""
    t = F.col(text)
    raw = {}
    for k, pat in METRIC_PATTERNS.items():
        raw[k] = _extract(t, pat)
        if k in ENGLISH_FALLBACKS:
            raw[k] = F.coalesce(raw[k], _extract(t, ENGLISH_FALLBACKS[k]))
    heads = {"_hm": _extract(t, HEADER_PATTERN), "_ha": _extract(t, HEADER_PATTERN, 2),
             "_lm": _extract(t, LOOSE_HEADER_PATTERN), "_la": _extract(t, LOOSE_HEADER_PATTERN, 2)}
    if path is not None:
        heads["_stem"] = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
        heads["_pm"] = F.nullif(F.regexp_extract(path, r"/model=([^/]+)/", 1), F.lit(""))
        heads["_pa"] = F.nullif(F.regexp_extract(path, r"/attack=([^/]+)/", 1), F.lit(""))
    found = df.select(*df.columns, *[c.alias(n) for n, c in heads.items()], *[F.trim(c).alias(f"_r_{k}") for k, c in raw.items()])
    model = F.coalesce(F.trim("_hm"), F.trim("_lm"))
    attack = F.when(F.col("_hm").isNotNull(), F.nullif(F.trim("_ha"), F.lit(""))).otherwise(F.trim("_la"))
    if path is not None:
        parts = F.split("_stem", "[_-]", 2)
        km, ka = _known_model(F.col("_stem"), models) if models else (F.lit(None).cast("string"), F.lit(None).cast("string"))
        model = F.coalesce(model, F.col("_pm"), km, parts.getItem(0))
        attack = F.coalesce(attack, F.col("_pa"), ka, F.try_element_at(parts, F.lit(2)))
    m = {k: clean_number(f"_r_{k}") for k in METRIC_PATTERNS}
    return found.select(
        *df.columns, model.alias("model"), attack.alias("attack"), map_label(attack).alias("attack_id"),
        m["total_samples"].cast("bigint").alias("total_samples"), m["num_chunks"].cast("int").alias("num_chunks"),
        m["accuracy"].alias("accuracy_percent"), m["f1"].alias("f1"), m["mre"].alias("mre"),
        m["mra"].alias("mra"), m["total_time"].alias("total_time_s"))


def result_text(layout: str, model, attack, total_samples, num_chunks, accuracy_percent, f1, mre, mra, total_time_s):
    """Metric columns -> the text of a result file, in the layout ``vi`` or ``en``; ``model`` null
    leaves the header out. ``parse_result_text`` reads it back."""
    body = F.concat(*[F.format_string(f"{label}: {form}\n", c) for (label, form), c in zip(
        LAYOUTS[layout], (total_samples, num_chunks, accuracy_percent, f1, mre, mra, total_time_s), strict=True)])
    return F.concat(F.coalesce(F.concat(F.lit("=== "), model, F.lit(" ("), attack, F.lit(") ===\n")), F.lit("")), body)


def drop_rows_without_metrics(df: DataFrame) -> DataFrame:
    """Texts that carry no metric at all (e.g. stray logs) are not result rows."""
    return df.where(F.coalesce(*[F.col(c).cast("double") for c in OUTPUT_NAMES.values()]).isNotNull())


def parse_metric_lines(df: DataFrame, text: str, metrics: list[str]) -> DataFrame:
    """``<Metric>: <number>`` lines -> one column per metric (escaped names, first match)."""
    t = F.col(text)
    out = [F.col(c) for c in df.columns]
    for m in metrics:
        pat = re.escape(m) + r":\s*([0-9.]+)"
        out.append(_extract(t, pat).cast("double").alias(m))
    return df.select(*out)


def throughput(df: DataFrame, by: str = "model") -> DataFrame:
    """Rows per second from recorded samples and elapsed seconds."""
    return df.groupBy(by).agg(F.sum("total_samples").cast("bigint").alias("rows"),
                              F.sum("total_time_s").alias("seconds")) \
        .select(by, "rows", "seconds", (F.col("rows") / F.col("seconds")).alias("rows_per_s"))
