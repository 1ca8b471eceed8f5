"""Address, time and label helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window_start(ts: Column | str, width: str) -> Column:
    """Floor a timestamp to a tumbling window, keeping its type."""
    return F.window(_col(ts), width).getField("start")


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def subnet24(ip: Column | str) -> Column:
    """First three octets, or '' unless all three are digits."""
    return F.regexp_extract(_col(ip), r"^(\d+\.\d+\.\d+)(?:\.|$)", 1)


def subnet24_lenient(ip: Column | str) -> Column:
    """First three dotted parts; the text itself when it has fewer."""
    return F.substring_index(_col(ip), ".", 3)


def last_octets(ip: Column | str) -> Column:
    """Last two dotted parts for display; the first 12 characters when undotted."""
    c = _col(ip)
    return F.when(c.contains("."), F.substring_index(c, ".", -2)).otherwise(F.left(c, F.lit(12)))


def asn_key(asn: Column | str) -> Column:
    """Upper-cased first token of an 'AS…' text, else ''."""
    up = F.upper(F.coalesce(_col(asn), F.lit("")))
    return F.when(up.startswith("AS"), F.regexp_extract(up, r"^(\S+)", 1)).otherwise(F.lit(""))


def protocol_code(proto: Column | str, codes: dict[str, int], other: int) -> Column:
    pairs = [F.lit(v) for kv in codes.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(proto)), F.lit(other))


def malicious_text(label: Column | str) -> Column:
    """1 when a free-text flow label names hostile traffic."""
    # The hostile label words, any case.
    hit = _col(label).rlike("(?i)Botnet|Attack|Malicious|PortScan|C&C|C2")
    return F.coalesce(hit, F.lit(False)).cast("int")


def malicious_exact(label: Column | str) -> Column:
    """1 when a sensor label is exactly 'malicious'."""
    return F.coalesce(F.lower(F.trim(_col(label))) == "malicious", F.lit(False)).cast("int")


def malicious_cic(label: Column | str) -> Column:
    """1 when a flow-meter label holds one of its hostile words."""
    # The hostile words of this format.
    return F.coalesce(F.lower(_col(label)).rlike("malicious|attack|bot"), F.lit(False)).cast("int")


def malicious_profile(label: Column | str) -> Column:
    """Per-address profile test for a hostile label."""
    # The hostile words of the per-address profile.
    return F.coalesce(F.lower(_col(label)).rlike("botnet|malicious|attack"), F.lit(False))


def simple_label(label: Column | str) -> Column:
    """Readable form of a raw flow label: 'type (detail)', or a 32-character cut."""
    c = _col(label)
    # Fixed value: the label grammar.
    pattern = r"flow=(?:To-|From-)?(\w+?)(?:-V\d+)?(?:-([\w-]+))?$"
    kind, detail = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unknown"))
        .when(kind != "", F.concat(kind, F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("")))
        .when(F.length(c) > 32, F.concat(F.left(c, F.lit(32)), F.lit("…")))
        .otherwise(c)
    )


def attack_category(attack: Column | str) -> Column:
    """Display category of an attack type, first matching keyword wins."""
    # Keywords and category names.
    s = F.lower(F.coalesce(_col(attack), F.lit("")))
    return (
        F.when(s.rlike("mirai|bot"), F.lit("bot"))
        .when(s.rlike("c2|beacon"), F.lit("c2"))
        .when(s.contains("scan"), F.lit("scan"))
        .otherwise(F.lit("other"))
    )


def event_class(attack: Column | str) -> Column:
    """Event name of a replay-feed row."""
    # Keywords and event names.
    c = _col(attack)
    s = F.lower(F.coalesce(c, F.lit("")))
    plain = F.when(s == "", F.lit("Flow")).otherwise(F.left(c, F.lit(16)))
    return (
        F.when(s.rlike("bot|mirai"), F.lit("Botnet"))
        .when(s.rlike("c2|beacon"), F.lit("C2"))
        .when(s.contains("scan"), F.lit("Scanner"))
        .otherwise(plain)
    )


def confidence_band(pct: Column | str, low: float = 50, high: float = 75, mid: str = "mid") -> Column:
    c = _col(pct)
    return F.when(c < low, F.lit("low")).when(c < high, F.lit(mid)).otherwise(F.lit("high"))


def severity_tier(confidence: Column | str) -> Column:
    c = _col(confidence)
    return F.when(c >= 0.8, F.lit("high")).when(c >= 0.5, F.lit("medium")).otherwise(F.lit("low"))


def beacon_strength(score: Column | str) -> Column:
    # Thresholds and names.
    c = F.coalesce(_col(score), F.lit(0.0))
    return F.when(c > 0.2, F.lit("Strong")).when(c > 0.08, F.lit("Moderate")).otherwise(F.lit("Weak"))
