"""O1: the version and score functions by name in SQL. Catalyst inlines their bodies, no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetlens.functions import scores as S
from fleetlens.functions import versions as V


def _body(text: str, **names: str) -> str:
    for placeholder, parameter in names.items():
        text = text.replace(f":{placeholder}", parameter)
    return text


def functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body)"""
    pair = "v STRING, e STRING"
    band = (
        "CASE WHEN s IS NULL OR isnan(s) OR s < 0 OR s > 10 THEN 'UNKNOWN' WHEN s >= 9 THEN 'CRITICAL' "
        "WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END"
    )
    return {
        "fl_normalize_package_name": (
            "n STRING, e STRING",
            "STRING",
            f"CASE WHEN e = '{V.PYPI}' THEN lower(regexp_replace(n, r'[-_.]+', '-')) ELSE trim(BOTH '{V.WHITE_SPACE}' FROM n) END",
        ),
        "fl_version_key": (pair, "STRING", _body(V.VERSION_KEY, v="v", e="e")),
        "fl_is_prerelease": (pair, "BOOLEAN", _body(V.PRERELEASE, v="v", e="e")),
        "fl_major_of": (pair, "DECIMAL(38,0)", _body(V.MAJOR, v="v", e="e")),
        "fl_cvss_v3_base_score": ("vector STRING", "DOUBLE", _body(S.BASE_SCORE, v="vector")),
        "fl_severity_from_score": ("s DOUBLE", "STRING", band),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions in the session; returns their names."""
    for name, (parameters, result, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(functions())
