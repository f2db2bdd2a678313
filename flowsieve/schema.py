"""Fixed values shared by every operator: label mappings and the flow schema."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original tool's for identical results.
# Attack label mapping, version 1 (11 classes, ids 0..10).
ATTACK_MAPPING_V1 = {
    "DrDoS_DNS": 0, "DrDoS_LDAP": 1, "DrDoS_MSSQL": 2, "DrDoS_NetBIOS": 3,
    "DrDoS_NTP": 4, "DrDoS_SNMP": 5, "DrDoS_SSDP": 6, "DrDoS_UDP": 7,
    "Syn": 8, "TFTP": 9, "UDPLag": 10,
}
# Attack label mapping, version 4 (BENIGN is 0, attacks 1..11, 12 classes).
ATTACK_MAPPING_V4 = {
    "BENIGN": 0,
    "DrDoS_DNS": 1, "DrDoS_LDAP": 2, "DrDoS_MSSQL": 3, "DrDoS_NetBIOS": 4,
    "DrDoS_NTP": 5, "DrDoS_SNMP": 6, "DrDoS_SSDP": 7, "DrDoS_UDP": 8,
    "Syn": 9, "TFTP": 10, "UDPLag": 11,
}
# Other spellings of the attack names.
LABEL_ALIASES = {"UDP-lag": "UDPLag"}
# Identifier / text columns that are never features.
NON_FEATURE_COLUMNS = ["Label", "Flow ID", "Timestamp", "SimillarHTTP", "Inbound"]
# Replacement for +/- infinity in the sentinel policy.
INF_SENTINEL = 1e10
# Soft-vote weights of the two score models.
VOTE_WEIGHTS = (0.6, 0.4)
# ---------------------------------------------------------------------------


def mapping_rows(version: int = 1) -> list[tuple[str, int]]:
    m = ATTACK_MAPPING_V1 if version == 1 else ATTACK_MAPPING_V4
    return sorted(m.items(), key=lambda kv: kv[1])


def mapping_df(spark, version: int = 1):
    """Small (11/12-row) mapping table; its size is fixed, so broadcasting it is safe."""
    schema = T.StructType([T.StructField("name", T.StringType(), False),
                           T.StructField("id", T.IntegerType(), False)])
    return spark.createDataFrame(mapping_rows(version), schema)
