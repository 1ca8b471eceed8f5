"""Rule tables: attack types, campaign types, threat levels, malware families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attack type names and the codes used for rule-made campaigns.
ATTACK_TYPE_CODES = {
    "C2_Beaconing": 0,
    "Data_Exfiltration": 1,
    "Horizontal_PortScan": 2,
    "IoT_Malware": 3,
    "Unknown": 4,
    "Vertical_PortScan": 5,
    "Known_Botnet_C2": 6,
}

# Campaign type -> technique id, technique name, tactic, page.
TECHNIQUES = [
    ("Reconnaissance / Scanning", "T1046", "Network Service Discovery", "Discovery",
     "https://attack.mitre.org/techniques/T1046/"),
    ("Botnet C2 Communication", "T1071", "Application Layer Protocol (C2)", "Command and Control",
     "https://attack.mitre.org/techniques/T1071/"),
    ("DDoS / Flood", "T1499", "Endpoint Denial of Service", "Impact",
     "https://attack.mitre.org/techniques/T1499/"),
    ("Data Exfiltration", "T1041", "Exfiltration Over C2 Channel", "Exfiltration",
     "https://attack.mitre.org/techniques/T1041/"),
    ("Benign / Unknown", "N/A", "N/A", "N/A", "N/A"),
]

# Sub-label keyword -> family and technique ids; first match wins.
FAMILY_KEYWORDS = [
    ("HorizontalPortScan", "Scanner", ["T1046"]),
    ("PortScan", "Scanner", ["T1046"]),
    ("Okiru", "Okiru/Bashlite", ["T1498", "T1571"]),
    ("Mirai", "Mirai", ["T1498", "T1021", "T1078"]),
    ("Torii", "Torii", ["T1573", "T1033"]),
    ("Hakai", "Hakai", ["T1498", "T1190"]),
    ("DDoS", "DDoS Bot", ["T1498"]),
    ("C&C", "C2 Implant", ["T1071", "T1573"]),
    ("FileDownload", "Dropper", ["T1105"]),
]
UNKNOWN_FAMILY = "Unknown IoT"


def attack_type(
    cov: Column, asymmetry: Column, entropy: Column, affinity: Column,
    horizontal: Column, vertical: Column, vt_score: Column | None = None,
) -> Column:
    """Ordered attack rules on unrounded features; the first match decides."""
    vt = vt_score if vt_score is not None else F.lit(0)
    return (
        F.when((cov < 0.3) & (asymmetry < 0.5), F.lit("C2_Beaconing"))
        .when((entropy > 3.5) & horizontal, F.lit("Horizontal_PortScan"))
        .when(vertical, F.lit("Vertical_PortScan"))
        .when(affinity > 0.6, F.lit("IoT_Malware"))
        .when(asymmetry > 10, F.lit("Data_Exfiltration"))
        .when((cov < 0.3) & (vt > 5), F.lit("Known_Botnet_C2"))
        .otherwise(F.lit("Unknown"))
    )


def attack_code(attack: Column) -> Column:
    pairs = [F.lit(v) for kv in ATTACK_TYPE_CODES.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), attack)


def campaign_type(scan: Column, burst: Column, conn: Column, avg_bytes: Column, src_ratio: Column) -> Column:
    """Campaign type from mean normalised features, first match decides."""
    return (
        F.when(scan > 0.5, F.lit("Reconnaissance / Scanning"))
        .when(burst > 0.6, F.lit("Botnet C2 Communication"))
        .when((conn > 0.7) & (avg_bytes < 0.3), F.lit("DDoS / Flood"))
        .when(src_ratio > 0.7, F.lit("Data Exfiltration"))
        .otherwise(F.lit("Benign / Unknown"))
    )


def threat_level(vt_malicious: Column, vt_suspicious: Column, abuse: Column) -> Column:
    points = (
        F.when(vt_malicious > 3, 2).otherwise(0)
        + F.when(vt_suspicious > 0, 1).otherwise(0)
        + F.when(abuse > 50, 2).otherwise(0)
        + F.when(abuse > 20, 1).otherwise(0)
    )
    return (
        F.when(points >= 4, F.lit("CRITICAL"))
        .when(points >= 2, F.lit("HIGH"))
        .when(points >= 1, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def technique(campaign_type_col: Column) -> Column:
    """Technique struct of a campaign type; an unlisted type reads as N/A."""
    fields = ("technique_id", "technique_name", "tactic", "mitre_url")

    def entry(values: tuple[str, ...]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, values)])

    pairs = [c for row in TECHNIQUES for c in (F.lit(row[0]), entry(row[1:]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), campaign_type_col), entry(("N/A",) * 4))


def family(sublabel: Column) -> Column:
    """struct<iot_family, ttps> of a sub-label, first keyword wins."""
    s = F.lower(F.trim(F.coalesce(sublabel, F.lit(""))))

    def entry(name: str, ttps: list[str]) -> Column:
        ids = F.array(*[F.lit(t) for t in ttps]).cast("array<string>")
        return F.struct(F.lit(name).alias("iot_family"), ids.alias("ttps"))

    out = None
    for keyword, name, ttps in FAMILY_KEYWORDS:
        hit = s.contains(keyword.lower())
        out = F.when(hit, entry(name, ttps)) if out is None else out.when(hit, entry(name, ttps))
    return out.otherwise(entry(UNKNOWN_FAMILY, []))
