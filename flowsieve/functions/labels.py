"""Label expressions: fixed mapping, inverse mapping and rule-based label inference.

All are CASE expressions over literals (the mappings have a fixed, tiny size), so they
stay inside whole-stage codegen and need neither a join nor a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.util import as_col
from flowsieve.schema import ATTACK_MAPPING_V1, ATTACK_MAPPING_V4, LABEL_ALIASES


def _case(c: Column, pairs, default=None) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(default if default is not None else F.lit(None))


def _map_literal(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def with_aliases(mapping: dict) -> dict:
    """The mapping with the other spellings of its names."""
    return mapping | {alias: mapping[name] for alias, name in LABEL_ALIASES.items() if name in mapping}


def map_label(c, mapping: dict | None = None) -> Column:
    """name or alias -> id via a fixed mapping; unknown names -> null (one lookup in a map literal)."""
    mapping = with_aliases(mapping or ATTACK_MAPPING_V1)
    return F.try_element_at(_map_literal(mapping), as_col(c)).cast("int")


def map_label_inverse(c, mapping: dict | None = None) -> Column:
    """id -> name; ids outside the mapping fall back to their decimal text."""
    mapping = mapping or ATTACK_MAPPING_V1
    c = as_col(c)
    inv = {v: k for k, v in mapping.items()}
    return F.coalesce(F.try_element_at(_map_literal(inv), c), c.cast("string"))


def known_label(c, mapping: dict | None = None) -> Column:
    return as_col(c).isin(list(with_aliases(mapping or ATTACK_MAPPING_V1)))


def infer_label(c, file_label, mapping: dict | None = None) -> Column:
    """Rule-based class id for free-text labels (12-class mapping, BENIGN = 0).

    Rules, first match wins: null/blank -> file label; contains BENIGN -> 0; contains
    a mapping name (case-insensitive, in mapping order) -> its id; numeric text whose
    truncated value is a known id -> that id; anything else -> file label.
    """
    mapping = mapping or ATTACK_MAPPING_V4
    c = as_col(c).cast("string")
    fl = as_col(file_label) if not isinstance(file_label, int) else F.lit(file_label)
    s = F.trim(c)
    up = F.upper(s)
    num = s.try_cast("double")
    trunc = F.when(num.isNotNull() & ~F.isnan(num) & (F.abs(num) < F.lit(1e9)), num.cast("int"))
    ids = sorted(set(mapping.values()))
    out = F.when(c.isNull() | (s == F.lit("")), fl).when(up.contains("BENIGN"), F.lit(0))
    for name, idx in mapping.items():
        if name == "BENIGN":
            continue
        out = out.when(up.contains(name.upper()), F.lit(idx))
    out = out.when(trunc.isin(ids), trunc)
    return out.otherwise(fl).cast("int")
