"""DuckDB-dialect SQL fragments mirroring the Spark expressions (oracle side only)."""

from __future__ import annotations

from flowsieve.functions.ipv4 import IPV4_PATTERN
from flowsieve.plans.adapters import FEATURES, IP_COLUMNS
from flowsieve.schema import ATTACK_MAPPING_V1


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def md5_u32(expr: str) -> str:
    return f"(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT)"


def bucket100(expr: str) -> str:
    return f"({md5_u32(expr)} % 100)"


def ipv4_strict(expr: str) -> str:
    parts = " + ".join(f"CAST(split_part({expr}, '.', {i + 1}) AS BIGINT) * {m}"
                       for i, m in enumerate([16777216, 65536, 256, 1]))
    return f"(CASE WHEN regexp_full_match({expr}, '{IPV4_PATTERN}') THEN {parts} END)"


def ipv4_null0(expr: str) -> str:
    return f"coalesce({ipv4_strict(expr)}, 0)"


def ipv4_safe(expr: str) -> str:
    num = f"TRY_CAST(trim(CAST({expr} AS VARCHAR)) AS DOUBLE)"
    return (f"coalesce({ipv4_strict(expr)}, CASE WHEN {num} IS NOT NULL AND NOT isnan({num}) "
            f"AND abs({num}) < 9.2e18 THEN CAST(trunc({num}) AS BIGINT) END, 0)")


def inf_to_zero(expr: str) -> str:
    return (f"(CASE WHEN {expr} IS NULL OR isnan({expr}) OR isinf({expr}) THEN 0.0 "
            f"ELSE CAST({expr} AS DOUBLE) END)")


def inf_to_sentinel(expr: str, s: float = 1e10) -> str:
    return (f"(CASE WHEN {expr} = 'inf'::DOUBLE THEN {s} WHEN {expr} = '-inf'::DOUBLE THEN -{s} "
            f"ELSE {expr} END)")


def map_label(expr: str, mapping: dict | None = None) -> str:
    mapping = mapping or ATTACK_MAPPING_V1
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {expr} {whens} END AS INTEGER)"


def round6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


# Prepared flow features: IPs as integers (null -> 0), inf/NaN/null -> 0, label id.
PREP_FEATURES = FEATURES + IP_COLUMNS


def prepared_cte(name: str = "prepared", src: str = "flows") -> str:
    feats = ",\n    ".join(f"{inf_to_zero(q(f))} AS {q(f)}" for f in FEATURES)
    ips = ",\n    ".join(f"CAST({ipv4_null0(q(c))} AS DOUBLE) AS {q(c)}" for c in IP_COLUMNS)
    return f"""
{name} AS (
  SELECT "Flow ID" AS flow_id, {map_label('"Label"')} AS y, "Protocol", source_file, chunk_id,
    {feats},
    {ips}
  FROM {src}
  WHERE {map_label('"Label"')} IS NOT NULL
)"""


def report_sql(pairs: str, y: str = "y", p: str = "p", labels_cte: str | None = None) -> tuple[str, str]:
    """CTEs + final SELECT of a classification report over ``pairs(y, p)``."""
    universe = (f"SELECT c FROM {labels_cte}" if labels_cte else
                "SELECT y AS c FROM cc UNION SELECT p AS c FROM cc")
    ctes = f"""
cc AS (SELECT {y} AS y, {p} AS p, count(*) AS n FROM {pairs} GROUP BY 1, 2),
u AS ({universe}),
tp AS (SELECT y AS c, sum(n) AS tp FROM cc WHERE y = p GROUP BY y),
sup AS (SELECT y AS c, sum(n) AS support FROM cc GROUP BY y),
prd AS (SELECT p AS c, sum(n) AS predicted FROM cc GROUP BY p),
st AS (SELECT u.c, coalesce(tp.tp, 0) AS tp, coalesce(sup.support, 0) AS support,
              coalesce(prd.predicted, 0) AS predicted
       FROM u LEFT JOIN tp ON u.c = tp.c LEFT JOIN sup ON u.c = sup.c LEFT JOIN prd ON u.c = prd.c),
pc AS (SELECT c, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec,
              CASE WHEN support + predicted > 0 THEN CAST(2 * tp AS DOUBLE) / (support + predicted) ELSE 0.0 END AS f1,
              support, tp FROM st),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf,
               sum(prec * support) AS wp, sum(rec * support) AS wr, sum(f1 * support) AS wf FROM pc
       HAVING sum(support) IS NOT NULL)"""
    body = f"""
SELECT CAST(c AS VARCHAR) AS label, {round6('prec')} AS "precision", {round6('rec')} AS recall,
       {round6('f1')} AS f1_score, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, {round6('CASE WHEN n > 0 THEN tp / n ELSE 0.0 END')}, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', {round6('mp')}, {round6('mr')}, {round6('mf')}, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', {round6('CASE WHEN n > 0 THEN wp / n ELSE 0.0 END')},
       {round6('CASE WHEN n > 0 THEN wr / n ELSE 0.0 END')}, {round6('CASE WHEN n > 0 THEN wf / n ELSE 0.0 END')},
       CAST(n AS BIGINT) FROM tot"""
    return ctes, body


def summary_metrics_sql(pairs: str, by: list[str]) -> tuple[str, str]:
    """CTEs + SELECT of (by..., samples, accuracy, f1_weighted, mre, mra) over ``pairs(by.., y, p)``."""
    b = ", ".join(by)
    bsel = (b + ", ") if by else ""
    on = " AND ".join(f"x.{k} = z.{k}" for k in by) or "TRUE"
    ctes = f"""
scc AS (SELECT {bsel}y, p, count(*) AS n FROM {pairs} GROUP BY ALL),
stp AS (SELECT {bsel}y AS c, sum(n) AS tp FROM scc WHERE y = p GROUP BY ALL),
ssup AS (SELECT {bsel}y AS c, sum(n) AS support FROM scc GROUP BY ALL),
sprd AS (SELECT {bsel}p AS c, sum(n) AS predicted FROM scc GROUP BY ALL),
suni AS (SELECT {bsel}c FROM ssup UNION SELECT {bsel}c FROM sprd),
sst AS (SELECT {', '.join('u.' + k for k in by) + ', ' if by else ''}u.c, coalesce(stp.tp, 0) AS tp,
               coalesce(ssup.support, 0) AS support, coalesce(sprd.predicted, 0) AS predicted
        FROM suni u
        LEFT JOIN stp ON u.c = stp.c {''.join(f' AND u.{k} = stp.{k}' for k in by)}
        LEFT JOIN ssup ON u.c = ssup.c {''.join(f' AND u.{k} = ssup.{k}' for k in by)}
        LEFT JOIN sprd ON u.c = sprd.c {''.join(f' AND u.{k} = sprd.{k}' for k in by)}),
sf1 AS (SELECT {bsel}sum((CASE WHEN support + predicted > 0 THEN CAST(2 * tp AS DOUBLE) / (support + predicted)
               ELSE 0.0 END) * support) / sum(support) AS f1w FROM sst GROUP BY ALL),
sbase AS (SELECT {bsel}sum(n) AS samples, sum(CASE WHEN y = p THEN n ELSE 0 END) AS correct,
                 sum(CASE WHEN y <> 0 THEN abs((CAST(y AS DOUBLE) - p) / y) * n END) AS rel_sum,
                 sum(CASE WHEN y <> 0 THEN n ELSE 0 END) AS nz FROM scc GROUP BY ALL)"""
    mre = "(CASE WHEN x.nz > 0 THEN x.rel_sum / x.nz ELSE 0.0 END)"
    body = f"""
SELECT {', '.join('x.' + k for k in by) + ', ' if by else ''}CAST(x.samples AS BIGINT) AS samples,
       {round6('x.correct / x.samples')} AS accuracy, {round6('z.f1w')} AS f1_weighted,
       {round6(mre)} AS mre, {round6('1.0 - ' + mre)} AS mra
FROM sbase x JOIN sf1 z ON {on}"""
    return ctes, body
