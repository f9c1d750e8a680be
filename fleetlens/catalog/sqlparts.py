"""Pieces of DuckDB SQL shared by the checks: an independent spelling of the basic rules."""

from __future__ import annotations


def norm(name: str = "package_name", eco: str = "ecosystem") -> str:
    return f"CASE WHEN {eco} = 'PyPI' THEN lower(regexp_replace({name}, '[-_.]+', '-', 'g')) ELSE trim({name}) END"


def valid(v: str = "version") -> str:
    """Validity of the versions of the dependency, advisory and release bindings (n.n.n or n.n.n-rc.n)."""
    return f"coalesce(regexp_full_match({v}, '\\d+\\.\\d+\\.\\d+(-rc\\.\\d+)?'), false)"


def vkey(v: str = "version") -> str:
    """Order key of those versions as a list of numbers, null when invalid."""
    part = [f"CAST(split_part(split_part({v}, '-', 1), '.', {i}) AS BIGINT)" for i in (1, 2, 3)]
    rc = f"CASE WHEN {v} LIKE '%-rc.%' THEN 0 ELSE 1 END"
    n = f"coalesce(TRY_CAST(regexp_extract({v}, '-rc\\.(\\d+)$', 1) AS BIGINT), 0)"
    return f"CASE WHEN {valid(v)} THEN [{', '.join(part)}, {rc}, {n}] END"


def major(v: str = "version") -> str:
    return f"CASE WHEN {valid(v)} THEN CAST(split_part({v}, '.', 1) AS BIGINT) END"


SEV_RANK = "CASE {} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
RISK_RANK = (
    "CASE {} WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 "
    "WHEN 'NONE' THEN 0 ELSE 1 END"
)
RISK_NORM = (
    "CASE WHEN upper(trim({0})) IN ('CRITICAL','HIGH','MEDIUM','LOW','UNKNOWN','NONE') "
    "THEN upper(trim({0})) ELSE 'UNKNOWN' END"
)


def band(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN 'UNKNOWN' WHEN {score} >= 9 THEN 'CRITICAL' WHEN {score} >= 7 THEN 'HIGH' "
        f"WHEN {score} >= 4 THEN 'MEDIUM' ELSE 'LOW' END"
    )


def cvss(vector: str = "cvss_vector") -> str:
    """Base score by the published formula, spelled with list lookups."""

    def m(metric: str) -> str:
        return f"regexp_extract({vector}, '/{metric}:([A-Z])', 1)"

    def w(metric: str, weights: dict) -> str:
        return f"CASE {m(metric)} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END"

    cia = {"H": 0.56, "L": 0.22, "N": 0.0}
    changed = f"({m('S')} = 'C')"
    pr = f"CASE {m('PR')} WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE WHEN {changed} THEN 0.68::DOUBLE ELSE 0.62::DOUBLE END ELSE CASE WHEN {changed} THEN 0.5::DOUBLE ELSE 0.27::DOUBLE END END"
    iss = f"(1.0::DOUBLE - (1.0::DOUBLE - {w('C', cia)}) * (1.0::DOUBLE - {w('I', cia)}) * (1.0::DOUBLE - {w('A', cia)}))"
    impact = f"(CASE WHEN {changed} THEN 7.52::DOUBLE * ({iss} - 0.029::DOUBLE) - 3.25::DOUBLE * pow({iss} - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * {iss} END)"
    av = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
    expl = f"(8.22::DOUBLE * {w('AV', av)} * {w('AC', {'L': 0.77, 'H': 0.44})} * {pr} * {w('UI', {'N': 0.85, 'R': 0.62})})"
    total = f"least(CASE WHEN {changed} THEN 1.08::DOUBLE * ({impact} + {expl}) ELSE {impact} + {expl} END, 10.0::DOUBLE)"
    whole = f"CAST(round_even({total} * 100000, 0) AS BIGINT)"
    return f"CASE WHEN {impact} <= 0 THEN 0.0::DOUBLE WHEN {whole} % 10000 = 0 THEN {whole} / 100000.0::DOUBLE ELSE (floor({whole} / 10000.0::DOUBLE) + 1) / 10.0::DOUBLE END"


# matches of dependency versions with advisory intervals: one row per (dependency row, advisory)
HITS = f"""hits AS (
 SELECT d.analysis_id, d.ecosystem, d.package_name, d.norm_name, d.version, d.source_file, d.scope, a.identifier, a.alias, a.cvss_vector, a.introduced, a.fixed
 FROM (SELECT *, {norm()} AS norm_name, {vkey()} AS k FROM fx_dependencies) d
 JOIN (SELECT *, {norm()} AS norm_name, {vkey('introduced')} AS ki, {vkey('fixed')} AS kf FROM fx_advisories) a
   ON d.ecosystem = a.ecosystem AND d.norm_name = a.norm_name AND d.k >= a.ki AND (a.kf IS NULL OR d.k < a.kf))"""
