"""Queries of the file readers (A1-A3) and the text, path, JSON, date and score functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.sqlparts import RISK_NORM, RISK_RANK, SEV_RANK, band, cvss
from fleetlens.functions import scores as S
from fleetlens.functions import text as T
from fleetlens.plans.bindings import ctes, fixture, table
from fleetlens.sources.files import scan_files

GROUP = Group()
query = GROUP.query


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---------------------------------------------------------------- A1-A3


@query("scan_files")
def _scan(spark, d):
    # the table directory itself is the tree: paths, sizes and the read / too-large decision
    return scan_files(spark, d, max_depth=3).select("path", "length", "is_too_large")


@query("decode_text", "SELECT doc_id, md5(text) AS digest, length(text) AS n_chars FROM documents")
def _decode(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    mark = F.pmod("doc_id", F.lit(4))
    raw = (
        F.when(mark == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(mark == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(mark == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    out = docs.select("doc_id", T.decode_text(raw).alias("t"))
    return out.select("doc_id", F.md5("t").alias("digest"), F.char_length("t").cast("bigint").alias("n_chars"))


_DIRS = "string_split(regexp_replace(path, '/?[^/]*$', ''), '/')"


@query(
    "prune_paths",
    ctes("fx_paths")
    + f""" SELECT list_name, count(*) AS kept FROM (
 SELECT 'extractor' AS list_name, path FROM fx_paths WHERE NOT list_has_any({_DIRS}, {_list(T.EXTRACTOR_IGNORED)})
 UNION ALL SELECT 'scanner', path FROM fx_paths WHERE NOT list_has_any({_DIRS}, {_list(T.SCANNER_IGNORED)})
 UNION ALL SELECT 'profiler', path FROM fx_paths WHERE NOT list_has_any({_DIRS}, {_list(T.PROFILER_IGNORED)}) AND len(list_filter({_DIRS}, lambda x: x LIKE '.%' AND x <> '.github')) = 0) u GROUP BY 1""",
)
def _prune(spark, d):
    paths = fixture(spark, d, "fx_paths").select("path")
    kept = (
        T.prune_paths(paths, T.EXTRACTOR_IGNORED)
        .select(F.lit("extractor").alias("list_name"))
        .unionByName(T.prune_paths(paths, T.SCANNER_IGNORED).select(F.lit("scanner").alias("list_name")))
        .unionByName(
            T.prune_paths(paths, T.PROFILER_IGNORED, keep_hidden=T.PROFILER_HIDDEN_KEPT).select(
                F.lit("profiler").alias("list_name")
            )
        )
    )
    return kept.groupBy("list_name").agg(F.count("*").alias("kept"))


# ---------------------------------------------------------------- C1-C8

_URL_SQL = r"regexp_replace({}, '([A-Za-z][A-Za-z0-9+.-]*://)[^/\s@]+@', '\1***@', 'g')"
_KV_SQL = (
    r"regexp_replace({}, '(?i)(^|[^A-Za-z0-9_])((?:_authToken|_auth|_password|password|passwd|secret|api[_-]?key|"
    r"access[_-]?token|auth[_-]?token|token)\s*[=:]\s*)([^\s,;\"''=][^\s,;\"'']*)', '\1\2***', 'g')"
)
_TOKEN_SQL = r"regexp_replace({}, '\b(?:gh[pousr]_[A-Za-z0-9]{{20,}}|AKIA[0-9A-Z]{{16}})\b', '***', 'g')"
_REDACT_SQL = _TOKEN_SQL.format(_KV_SQL.format(_URL_SQL.format("text")))


@query("redact_secrets", ctes("fx_texts") + f" SELECT doc_id, md5({_REDACT_SQL}) AS digest FROM fx_texts")
def _redact(spark, d):
    df = T.redact_table(fixture(spark, d, "fx_texts"), ["text"])
    return df.select("doc_id", F.md5("text").alias("digest"))


@query(
    "contains_secret",
    f"SELECT doc_id, {_REDACT_SQL} <> text AS has_secret FROM (SELECT doc_id, replace(text, '= \"', '= ') AS text FROM documents) r",
)
def _contains(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit('= "'), F.lit("= ")).alias("text"))
    return docs.select("doc_id", T.contains_secret(F.col("text")).alias("has_secret"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS short FROM documents",
)
def _truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_text(F.col("text"), 120).alias("short"))


@query(
    "explode_lines",
    "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, md5(unnest(l)) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) s",
)
def _explode_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return T.explode_lines(docs).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("text").alias("digest"))


@query(
    "logical_lines",
    ctes("fx_manifest_texts")
    + r""", phys AS (SELECT repository_id, path, unnest(range(1, len(l) + 1)) AS n, rtrim(unnest(l)) AS line FROM (SELECT repository_id, path, string_split(content, chr(10)) AS l FROM fx_manifest_texts) s),
 flagged AS (SELECT *, line LIKE '%\' AND ltrim(line) NOT LIKE '#%' AS cont FROM phys),
 starts AS (SELECT *, CASE WHEN coalesce(lag(cont) OVER w, false) THEN 0 ELSE 1 END AS first FROM flagged WINDOW w AS (PARTITION BY repository_id ORDER BY n)),
 grp AS (SELECT *, sum(first) OVER (PARTITION BY repository_id ORDER BY n) AS g FROM starts),
 joined AS (SELECT repository_id, path, min(n) AS line_no, string_agg(CASE WHEN cont THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY n) AS t FROM grp GROUP BY repository_id, path, g)
 SELECT repository_id, path, line_no, md5(text) AS digest FROM (SELECT repository_id, path, line_no, trim(regexp_replace(t, '(^|\s)#.*$', '')) AS text FROM joined) j WHERE text <> ''""",
)
def _logical(spark, d):
    out = T.logical_lines(fixture(spark, d, "fx_manifest_texts"))
    return out.select(
        "repository_id", "path", F.col("line_no").cast("bigint").alias("line_no"), F.md5("text").alias("digest")
    )


@query(
    "normalise_path",
    ctes("fx_paths")
    + " SELECT file_id, regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'common/base.txt' AS target FROM fx_paths",
)
def _normalise_path(spark, d):
    paths = fixture(spark, d, "fx_paths")
    return paths.select("file_id", T.normalise_path(F.col("path"), F.lit("../common/./x/..//base.txt")).alias("target"))


@query(
    "is_requirements_file",
    ctes("fx_paths")
    + " SELECT file_id, path, lower(path) LIKE '%.txt' AND (regexp_matches(split_part(lower(path), '/', -1), '^requirements([-_].*)?\\.txt$') OR (path LIKE '%/%' AND split_part(lower(path), '/', -2) = 'requirements')) AS is_requirements FROM fx_paths",
)
def _is_req(spark, d):
    return fixture(spark, d, "fx_paths").select("file_id", "path", T.is_requirements_file(F.col("path")).alias("is_requirements"))


@query(
    "is_dev_requirements_file",
    ctes("fx_paths")
    + f" SELECT file_id, path, len(list_filter(string_split_regex(regexp_replace(lower(split_part(path, '/', -1)), '\\.txt$', ''), '[-_.]+'), lambda t: (t LIKE '%dev%' OR t LIKE '%test%') AND NOT list_contains({_list(T.NOT_DEV_TOKENS)}, t))) > 0 AS is_dev FROM fx_paths",
)
def _is_dev(spark, d):
    return fixture(spark, d, "fx_paths").select("file_id", "path", T.is_dev_requirements_file(F.col("path")).alias("is_dev"))


# ---------------------------------------------------------------- C9-C16


@query("parse_osv_timestamp", "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS micros FROM events")
def _timestamp(spark, d):
    events = table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    return events.select("event_id", F.unix_micros(S.parse_osv_timestamp(text)).alias("micros"))


@query(
    "parse_cvss_v3",
    ctes("fx_advisories")
    + " SELECT identifier, list_aggregate(list_sort(string_split(substr(cvss_vector, 10), '/')), 'string_agg', ',') AS metrics FROM fx_advisories",
)
def _parse_cvss(spark, d):
    parsed = S.parse_cvss_v3(F.concat(F.col("cvss_vector"), F.lit("/")))
    pairs = F.transform(F.map_entries(parsed), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return fixture(spark, d, "fx_advisories").select("identifier", F.array_join(F.array_sort(pairs), ",").alias("metrics"))


@query("cvss_v3_base_score", ctes("fx_advisories") + f" SELECT identifier, {cvss()} AS score FROM fx_advisories")
def _score(spark, d):
    return fixture(spark, d, "fx_advisories").select("identifier", S.cvss_v3_base_score(F.col("cvss_vector")).alias("score"))


@query(
    "cvss_roundup",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN w % 10000 = 0 THEN w / 100000.0::DOUBLE ELSE (floor(w / 10000.0::DOUBLE) + 1) / 10.0::DOUBLE END AS rounded FROM (SELECT *, CAST(round_even(l_quantity * l_discount * 100000, 0) AS BIGINT) AS w FROM lineitem) s",
)
def _roundup(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        S.cvss_roundup(F.col("l_quantity") * F.col("l_discount")).alias("rounded"),
    )


@query(
    "severity_from_score",
    f"SELECT l_quantity, {band('s').replace('WHEN s IS NULL', 'WHEN s IS NULL OR s > 10')} AS severity, count(*) AS n FROM (SELECT l_quantity, round(l_quantity * 0.24::DOUBLE, 1) AS s FROM lineitem) q GROUP BY 1, 2",
)
def _band(spark, d):
    score = F.round(F.col("l_quantity") * F.lit(0.24), 1)
    df = table(spark, d, "lineitem").select("l_quantity", S.severity_from_score(score).alias("severity"))
    return df.groupBy("l_quantity", "severity").agg(F.count("*").alias("n"))


_LABEL = "CASE p % 5 WHEN 0 THEN 'moderate' WHEN 1 THEN ' High ' WHEN 2 THEN 'unheard-of' WHEN 3 THEN 'CRITICAL' END"


@query(
    "pick_severity",
    ctes("fx_advisories")
    + f" SELECT identifier, CASE p % 5 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE {band('score')} END AS severity FROM (SELECT identifier, CAST(split_part(identifier, '-', 2) AS BIGINT) AS p, {cvss()} AS score FROM fx_advisories) s",
)
def _severity(spark, d):
    df = fixture(spark, d, "fx_advisories").withColumn("p", F.substring_index("identifier", "-", -1).cast("bigint"))
    scored = S.score_advisories(df.withColumn("label", F.expr(_LABEL)))
    return scored.select("identifier", "severity")


@query(
    "pick_cvss_entry",
    ctes("fx_advisories")
    + f" SELECT identifier, CASE WHEN p % 3 = 2 THEN 'CVSS:4.0/AV:N' ELSE cvss_vector END AS vector, CASE p % 3 WHEN 2 THEN NULL ELSE {cvss()} END AS score FROM (SELECT *, CAST(split_part(identifier, '-', 2) AS BIGINT) AS p FROM fx_advisories) s",
)
def _pick_cvss(spark, d):
    df = fixture(spark, d, "fx_advisories").withColumn("p", F.substring_index("identifier", "-", -1).cast("bigint"))

    def entry(kind, score):
        return F.struct(F.lit(kind).alias("type"), score.alias("score"))

    v4 = entry("CVSS_V4", F.lit("CVSS:4.0/AV:N"))
    entries = (
        F.when(F.col("p") % 3 == 0, F.array(v4, entry("cvss_v3", F.col("cvss_vector"))))
        .when(F.col("p") % 3 == 1, F.array(entry("CVSS_V3", F.lit("7.5")), entry("CVSS_V3", F.col("cvss_vector"))))
        .otherwise(F.array(entry("CVSS_V3", F.lit("true")), v4))
    )
    return df.select("identifier", S.pick_cvss_entry(entries).alias("e")).select("identifier", "e.vector", "e.score")


@query(
    "pick_reference_url",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/web' WHEN 2 THEN url || '/git' END AS url, CASE WHEN page_id % 4 = 3 THEN 0 ELSE 2 END AS n_urls FROM pages",
)
def _reference(spark, d):
    pages = table(spark, d, "pages")

    def ref(kind, url):
        return F.struct(F.lit(kind).alias("type"), url.alias("url"))

    url = F.col("url")
    git, web = ref("GIT", F.concat(url, F.lit("/git"))), ref("web", F.concat(url, F.lit("/web")))
    kind = F.col("page_id") % 4
    refs = (
        F.when(kind == 0, F.array(web, ref("ADVISORY", url)))
        .when(kind == 1, F.array(git, web, ref("ADVISORY", F.lit(""))))
        .when(kind == 2, F.array(git, ref("PACKAGE", url)))
        .otherwise(F.array(ref("WEB", F.lit(None).cast("string"))))
    )
    picked = pages.select("page_id", S.pick_reference_url(refs).alias("r"))
    return picked.select("page_id", "r.url", F.size("r.urls").cast("bigint").alias("n_urls"))


# ---------------------------------------------------------------- C17-C24

_SEV_NORM = "CASE upper(trim(judged_risk)) WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'LOW' THEN 'LOW' WHEN 'NONE' THEN 'LOW' ELSE 'UNKNOWN' END"


@query(
    "normalise_severity",
    ctes("fx_verdicts") + f" SELECT analysis_id, slot, {_SEV_NORM} AS severity FROM fx_verdicts",
)
def _norm_severity(spark, d):
    return fixture(spark, d, "fx_verdicts").select("analysis_id", "slot", S.normalise_severity(F.col("judged_risk")).alias("severity"))


@query(
    "severity_rank",
    ctes("fx_verdicts") + f" SELECT analysis_id, max({SEV_RANK.format(_SEV_NORM)}) AS worst FROM fx_verdicts GROUP BY 1",
)
def _sev_rank(spark, d):
    return fixture(spark, d, "fx_verdicts").groupBy("analysis_id").agg(F.max(S.severity_rank(F.col("judged_risk"))).alias("worst"))


@query(
    "normalise_risk_level",
    ctes("fx_verdicts")
    + f" SELECT analysis_id, slot, {RISK_NORM.format('judged_risk')} AS risk_level, {RISK_RANK.format(RISK_NORM.format('judged_risk'))} AS rank FROM fx_verdicts",
)
def _norm_risk(spark, d):
    level = F.col("judged_risk")
    return fixture(spark, d, "fx_verdicts").select(
        "analysis_id", "slot", S.normalise_risk_level(level).alias("risk_level"), S.risk_rank(level).alias("rank")
    )


@query(
    "identifier_tier",
    ctes("fx_advisories") + " SELECT identifier, CASE split_part(identifier, '-', 1) WHEN 'GHSA' THEN 0 WHEN 'CVE' THEN 1 ELSE 2 END AS tier FROM fx_advisories",
)
def _tier(spark, d):
    return fixture(spark, d, "fx_advisories").select("identifier", S.identifier_tier(F.col("identifier")).alias("tier"))


@query(
    "dependency_label",
    ctes("fx_dependencies") + " SELECT DISTINCT CASE WHEN version IS NULL THEN package_name ELSE package_name || '@' || version END AS label FROM fx_dependencies",
)
def _label(spark, d):
    return fixture(spark, d, "fx_dependencies").select(T.dependency_label(F.col("package_name"), F.col("version")).alias("label")).distinct()


@query(
    "graph_node_id",
    ctes("fx_components") + " SELECT 'Component:' || repository_id || ':' || path AS node_id, 'Component:' || path AS label FROM fx_components",
)
def _node_id(spark, d):
    node_id = T.graph_node_id("Component", F.col("repository_id"), F.col("path"))
    return fixture(spark, d, "fx_components").select(node_id.alias("node_id"), T.node_label(node_id, F.col("path")).alias("label"))


_CONF = "CASE l_suppkey % 8 WHEN 0 THEN '0.5' WHEN 1 THEN '90' WHEN 2 THEN 'NaN' WHEN 3 THEN '-0.1' WHEN 4 THEN '1' WHEN 5 THEN 'high' WHEN 6 THEN '0' END"


@query(
    "validate_confidence",
    f"SELECT raw, CASE raw WHEN '0.5' THEN 0.5::DOUBLE WHEN '1' THEN 1.0::DOUBLE WHEN '0' THEN 0.0::DOUBLE END AS confidence, count(*) AS n FROM (SELECT {_CONF} AS raw FROM lineitem) s GROUP BY 1, 2",
)
def _confidence(spark, d):
    df = table(spark, d, "lineitem").select(F.expr(_CONF).alias("raw"))
    return df.withColumn("confidence", S.validate_confidence(F.col("raw"))).groupBy("raw", "confidence").agg(F.count("*").alias("n"))


@query(
    "job_duration",
    "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, date_diff('second', o_orderdate, l_shipdate)) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _duration(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return items.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.job_duration(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds")
    )
