"""Timestamps, CVSS, severities, risks and other score expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.versions import _stripped, apply_sql, bind, let, strip

# The base-metric weights of the published CVSS v3.1 specification (table 8.4) and the label orders.
CVSS_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "UI": {"N": 0.85, "R": 0.62},
    "S": {"U": 0.0, "C": 1.0},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CVSS_PRIVILEGES_SCOPE_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}
SEVERITY_ALIASES = {"MODERATE": "MEDIUM", "IMPORTANT": "HIGH", "NONE": "LOW", "INFORMATIONAL": "LOW", "INFO": "LOW"}
ADVISORY_LABELS = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW"}
RISK_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "UNKNOWN": 1, "NONE": 0}
RISK_VIEW_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "NONE": 4, "UNKNOWN": 5}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null for other keys (a constant map, one evaluation of the key)."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def parse_osv_timestamp(text: Column) -> Column:
    """ISO 8601 with up to nine fraction digits to a timestamp; null when unparsable; no zone means UTC."""
    iso = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(\.\d{1,6})?\d*)?(Z|z|[+-]\d{2}:?\d{2})?$"
    bare = strip(text)
    day, minute = F.regexp_extract(bare, iso, 1), F.regexp_extract(bare, iso, 2)
    second, fraction = F.regexp_extract(bare, iso, 3), F.regexp_extract(bare, iso, 4)
    zone = F.regexp_replace(F.regexp_extract(bare, iso, 5), "[Zz]", "+00:00")
    full = F.concat(
        day,
        F.lit(" "),
        F.when(minute == "", F.lit("00:00")).otherwise(minute),
        F.when(second == "", F.lit(":00")).otherwise(second),
        fraction,
        F.when(zone == "", F.lit("+00:00")).otherwise(F.regexp_replace(zone, r"^(...)(\d\d)$", "$1:$2")),
    )
    return F.when(bare.rlike(iso), full.try_cast("timestamp"))


def _parse_cvss_sql() -> str:
    pairs = (
        f"transform(filter(split(upper(_b), '/'), _x -> _x <> ''), _x -> named_struct("
        f"'key', {_stripped('substring_index(_x, ":", 1)')}, 'value', {_stripped("regexp_replace(_x, '^[^:]*:?', '')")}))"
    )
    known = " AND ".join(
        f"exists(_q, _m -> _m.key = '{metric}' AND _m.value IN ({', '.join(repr(v) for v in weights)}))"
        for metric, weights in CVSS_WEIGHTS.items()
    )
    sound = (
        f"NOT exists(_q, _m -> _m.key = '' OR _m.value = '') AND {known} "
        "AND size(array_distinct(transform(_q, _m -> _m.key))) = size(_q)"
    )
    parsed = let("_b", "substring(_v, 10)", let("_q", pairs, f"CASE WHEN {sound} THEN map_from_entries(_q) END"))
    return let("_v", _stripped(":v"), f"CASE WHEN _v RLIKE r'(?i)^CVSS:3\\.[01]/' THEN {parsed} END")


CVSS_METRICS = _parse_cvss_sql()


def parse_cvss_v3(vector: Column) -> Column:
    """Metric map of a CVSS v3.0/3.1 vector; null on a wrong prefix, duplicate, missing or unknown metric."""
    return apply_sql(CVSS_METRICS, v=vector)


def cvss_roundup(value: Column) -> Column:
    """Smallest number with one decimal that is not below ``value``, in integer arithmetic."""
    whole = F.bround(value * 100000, 0).cast("bigint")
    return F.when(whole % 10000 == 0, whole / 100000.0).otherwise((F.floor(whole / 10000) + 1) / 10.0)


def _base_score_sql() -> str:
    def weight(metric: str, table: dict | None = None) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {w}D" for k, w in (table or CVSS_WEIGHTS[metric]).items())
        return f"CASE _m['{metric}'] {cases} END"

    def roundup(x: str) -> str:
        whole = f"cast(bround({x} * 100000, 0) AS bigint)"
        return let("_w", whole, "CASE WHEN _w % 10000 = 0 THEN _w / 100000.0D ELSE (floor(_w / 10000) + 1) / 10.0D END")

    changed = "_m['S'] = 'C'"
    privileges = f"CASE WHEN {changed} THEN {weight('PR', CVSS_PRIVILEGES_SCOPE_CHANGED)} ELSE {weight('PR')} END"
    iss = f"1.0D - (1.0D - {weight('C')}) * (1.0D - {weight('I')}) * (1.0D - {weight('A')})"
    impact = let(
        "_s", iss, f"CASE WHEN {changed} THEN 7.52D * (_s - 0.029D) - 3.25D * pow(_s - 0.02D, 15.0D) ELSE 6.42D * _s END"
    )
    exploit = f"8.22D * {weight('AV')} * {weight('AC')} * ({privileges}) * {weight('UI')}"
    total = f"CASE WHEN {changed} THEN 1.08D * (_i + {exploit}) ELSE _i + {exploit} END"
    score = let("_i", impact, f"CASE WHEN _i <= 0 THEN 0.0D ELSE {roundup(f'least({total}, 10.0D)')} END")
    return let("_m", CVSS_METRICS, f"CASE WHEN _m IS NOT NULL THEN {score} END")


BASE_SCORE = _base_score_sql()


def cvss_v3_base_score(vector: Column) -> Column:
    """C11: CVSS v3 base score, null for an invalid vector."""
    return apply_sql(BASE_SCORE, v=vector)


def severity_from_score(score: Column) -> Column:
    """Bands; 0.0 is LOW; NaN, null and values outside 0-10 are UNKNOWN."""
    return (
        F.when(score.isNull() | F.isnan(score) | (score < 0.0) | (score > 10.0), "UNKNOWN")
        .when(score >= 9.0, "CRITICAL")
        .when(score >= 7.0, "HIGH")
        .when(score >= 4.0, "MEDIUM")
        .otherwise("LOW")
    )


def pick_severity(label: Column, score: Column) -> Column:
    """C14: the advisory's own label when it is a known one, else the band of the score."""
    return F.coalesce(lookup(ADVISORY_LABELS, F.upper(strip(label))), severity_from_score(score))


def _number_text(raw: Column) -> Column:
    return F.when(~F.lower(strip(raw)).isin("true", "false"), strip(raw).try_cast("double"))


def pick_cvss_entry(entries: Column) -> Column:
    """struct(vector, score) of the first V3 vector, else a V3 number, else the V4 vector or number.

    Entries are ``array<struct<type, score>>`` with the score as text. A number listed before the first V3 vector
    is replaced by the score of that vector.
    """

    def usable(kind: str, prefix: str) -> Column:
        typed = F.filter(entries, lambda e: F.upper(e["type"]) == kind)
        vector = F.get(F.filter(typed, lambda e: F.upper(e["score"]).startswith(prefix)), F.lit(0))["score"]
        number = F.try_element_at(
            F.filter(F.transform(typed, lambda e: _number_text(e["score"])), lambda n: n.isNotNull()), F.lit(-1)
        )
        return F.struct(strip(vector).alias("vector"), number.alias("number"))

    def choose(v3: Column, v4: Column) -> Column:
        v3_score = F.when(v3["vector"].isNotNull(), cvss_v3_base_score(v3["vector"])).otherwise(v3["number"])
        return F.when(
            v3["vector"].isNotNull() | v3["number"].isNotNull(),
            F.struct(v3["vector"].alias("vector"), v3_score.alias("score")),
        ).otherwise(F.struct(v4["vector"].alias("vector"), v4["number"].alias("score")))

    return bind(usable("CVSS_V3", "CVSS:3"), lambda v3: bind(usable("CVSS_V4", "CVSS:4"), lambda v4: choose(v3, v4)))


def pick_reference_url(references: Column) -> Column:
    """struct(url, urls): first ADVISORY, else first WEB, else first URL; every URL kept."""
    named = F.filter(references, lambda r: F.coalesce(r["url"], F.lit("")) != "")

    def first(kind: str) -> Column:
        return F.get(F.filter(named, lambda r: F.upper(r["type"]) == kind), F.lit(0))["url"]

    return F.struct(
        F.coalesce(first("ADVISORY"), first("WEB"), F.get(named, F.lit(0))["url"]).alias("url"),
        F.transform(named, lambda r: r["url"]).alias("urls"),
    )


def normalise_severity(label: Column) -> Column:
    """C17: any spelling of a severity; unknown words are UNKNOWN."""
    cases = {**{name: name for name in SEVERITY_RANK}, **SEVERITY_ALIASES}
    return bind(F.upper(strip(label)), lambda text: F.coalesce(lookup(cases, text), F.lit("UNKNOWN")))


def severity_rank(label: Column) -> Column:
    """CRITICAL 4 down to UNKNOWN 0."""
    return lookup(SEVERITY_RANK, normalise_severity(label))


def normalise_risk_level(label: Column) -> Column:
    """Stored risk text; unknown words are UNKNOWN."""
    return bind(F.upper(strip(label)), lambda text: F.when(text.isin(*RISK_RANK), text).otherwise("UNKNOWN"))


def risk_rank(label: Column) -> Column:
    """CRITICAL 5 … UNKNOWN 1, NONE 0."""
    return lookup(RISK_RANK, normalise_risk_level(label))


def risk_view_rank(label: Column) -> Column:
    """Display order, UNKNOWN after NONE, no label last (I8)."""
    return F.coalesce(lookup(RISK_VIEW_RANK, F.upper(label)), F.lit(6))


def identifier_tier(identifier: Column) -> Column:
    """C20: GHSA 0, CVE 1, everything else 2."""
    upper = F.upper(identifier)
    return F.when(upper.startswith("GHSA-"), 0).when(upper.startswith("CVE-"), 1).otherwise(2)


def validate_confidence(value: Column) -> Column:
    """A finite number in [0, 1], else null; nothing is clamped."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), number)


def job_duration(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps, never negative."""
    seconds = (end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double"))
    return F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint")


def score_advisories(advisories: DataFrame) -> DataFrame:
    """C10-C14 as one table job: score, severity and rank next to each advisory (columns cvss_vector, label)."""
    return (
        advisories.withColumn("cvss_score", cvss_v3_base_score(F.col("cvss_vector")))
        .withColumn("severity", pick_severity(F.col("label"), F.col("cvss_score")))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
    )
