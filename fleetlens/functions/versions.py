"""Version and package-name expressions.

A version is turned into an order-preserving *string* key: Spark compares strings byte by byte, so ``<``, ``min_by``,
``ORDER BY`` and joins work on one plain column with no UDT, struct comparison or Python. Numbers are written as
length + digits, which keeps integers of any size exact. Keys are only comparable inside one ecosystem.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PYPI = "PyPI"
NPM = "npm"

# The published SemVer 2.0 grammar (plus its loose form), the PEP 440 grammar of the public
# specification, and the npm specifier kinds.
SEMVER = (
    r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
)
SEMVER_LOOSE = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?$"
PEP440 = (
    r"(?i)^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]+)?)?"
    r"(?:(-)([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
EXACT_SPEC = (
    r"^\s*=?\s*v?((?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)\s*$"
)
UNRESOLVABLE_PREFIXES = [
    "file:", "link:", "workspace:", "npm:", "git+", "git:", "github:", "gitlab:", "bitbucket:",
    "gist:", "http://", "https://", "ssh://", "portal:", "patch:",
]
GITHUB_SHORTHAND = r"(?U)^[A-Za-z0-9][\w.-]*/[\w.-]+(#.*)?$"

# every white-space character of Unicode, what "strip" means for manifest text
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Both ends without any white space (``trim`` only knows the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The long expressions below are SQL text: one parse instead of hundreds of calls from Python to the JVM, and the
# same text is the body of the SQL functions of ``functions.sqlfuncs``.


def let(name: str, value: str, body: str) -> str:
    """SQL text that evaluates ``value`` once under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def apply_sql(body: str, **arguments: Column) -> Column:
    """A Column of SQL text over named arguments."""
    packed = F.array(F.struct(*[column.alias(name) for name, column in arguments.items()]))
    for name in arguments:
        body = body.replace(f":{name}", f"_a.{name}")
    return F.element_at(F.call_function("transform", packed, F.expr(f"_a -> {body}")), 1)


def _number(digits: str) -> str:
    """Order-preserving text of a non-negative integer; '' counts as 0."""
    plain = f"coalesce(nullif(trim(LEADING '0' FROM {digits}), ''), '0')"
    return let("_d", plain, "concat(lpad(cast(length(_d) AS string), 3, '0'), _d)")


def _stripped(text: str) -> str:
    return f"trim(BOTH '{WHITE_SPACE}' FROM {text})"


def normalize_package_name(name: Column, ecosystem: Column) -> Column:
    """B1: PyPI names lower-cased with runs of ``-_.`` as one dash, npm names trimmed."""
    return F.when(ecosystem == PYPI, F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(strip(name))


# ---------------------------------------------------------------- SemVer


def _semver_fields(version: str) -> str:
    """[major, minor, patch, prerelease] as text, null when invalid."""
    return let(
        "_t",
        _stripped(version),
        f"CASE WHEN _t RLIKE r'{SEMVER}' THEN split(regexp_replace(_t, r'{SEMVER}', '$1|$2|$3|$4'), r'\\|') "
        f"WHEN _t RLIKE r'{SEMVER_LOOSE}' THEN split(regexp_replace(_t, r'{SEMVER_LOOSE}', '$1|$2|$3|'), r'\\|') END",
    )


def _semver_key(version: str) -> str:
    # numeric identifiers before alphanumeric ones; "!" sorts below every identifier character
    identifier = f"CASE WHEN _i RLIKE r'^[0-9]+$' THEN concat('0', {_number('_i')}, '!') ELSE concat('1', _i, '!') END"
    pre = f"CASE WHEN _p[3] = '' THEN '~' ELSE concat('-', array_join(transform(split(_p[3], r'\\.'), _i -> {identifier}), '')) END"
    key = f"concat({_number('_p[0]')}, {_number('_p[1]')}, {_number('_p[2]')}, {pre})"
    return let("_p", _semver_fields(version), f"CASE WHEN _p IS NOT NULL THEN {key} END")


def semver_parse(version: Column) -> Column:
    """B2: struct(major, minor, patch, pre[]); strict form first, then ``4`` and ``4.17``; a number above 38 digits is null."""
    number = "try_cast(coalesce(nullif({}, ''), '0') AS decimal(38,0))"
    fields = ", ".join(f"'{n}', {number.format(f'_p[{i}]')}" for i, n in enumerate(["major", "minor", "patch"]))
    pre = "CASE WHEN _p[3] = '' THEN cast(array() AS array<string>) ELSE split(_p[3], r'\\.') END"
    body = f"CASE WHEN _p IS NOT NULL THEN named_struct({fields}, 'pre', {pre}) END"
    return apply_sql(let("_p", _semver_fields(":v"), body), v=version)


SEMVER_KEY = _semver_key(":v")


def semver_key(version: Column) -> Column:
    """Order key; a release sorts after its prereleases, build metadata does not count."""
    return apply_sql(SEMVER_KEY, v=version)


# ---------------------------------------------------------------- PEP 440


def _pep440_fields(version: str) -> str:
    """[epoch, release, pre letter, pre n, "-", post n, post word, post n, dev, dev n, local] as lower-case text."""
    order = "|".join(f"${i}" for i in range(1, 12))
    return let(
        "_t",
        _stripped(version),
        f"CASE WHEN _t RLIKE r'{PEP440}' THEN split(lower(regexp_replace(_t, r'{PEP440}', '{order}')), r'\\|') END",
    )


def _pep440_key(version: str) -> str:
    release = "regexp_replace(_p[1], r'(?:\\.0+)+$', '')"
    segments = f"array_join(transform(split({release}, r'\\.'), _s -> concat('1', {_number('_s')})), '')"
    pre = (
        "CASE WHEN _p[2] IN ('a', 'alpha') THEN '1' WHEN _p[2] IN ('b', 'beta') THEN '2' WHEN _p[2] <> '' THEN '3' "
        "WHEN _p[4] = '' AND _p[6] = '' AND _p[8] <> '' THEN '0' ELSE '4' END"
    )
    post = f"CASE WHEN _p[4] <> '' OR _p[6] <> '' THEN concat('1', {_number('concat(_p[5], _p[7])')}) ELSE '0' END"
    dev = f"CASE WHEN _p[8] <> '' THEN concat('0', {_number('_p[9]')}) ELSE '1' END"
    part = f"CASE WHEN _l RLIKE r'^[0-9]+$' THEN concat('11', {_number('_l')}) ELSE concat('10', _l, '!') END"
    local = f"CASE WHEN _p[10] = '' THEN '' ELSE array_join(transform(split(_p[10], r'[-_.]'), _l -> {part}), '') END"
    key = f"concat({_number('_p[0]')}, {segments}, '0', {pre}, {_number('_p[3]')}, {post}, {dev}, {local})"
    return let("_p", _pep440_fields(version), f"CASE WHEN _p IS NOT NULL THEN {key} END")


PEP440_KEY = _pep440_key(":v")


def pep440_key(version: Column) -> Column:
    """Order key of epoch, release without trailing zeros, pre, post, dev and local parts."""
    return apply_sql(PEP440_KEY, v=version)


# ---------------------------------------------------------------- both ecosystems


VERSION_KEY = f"CASE :e WHEN '{PYPI}' THEN {PEP440_KEY} WHEN '{NPM}' THEN {SEMVER_KEY} END"


def version_key(version: Column, ecosystem: Column) -> Column:
    """Order key under the ecosystem's rule; null when the version does not parse."""
    return apply_sql(VERSION_KEY, v=version, e=ecosystem)


def is_valid_version(version: Column, ecosystem: Column) -> Column:
    """Parses under the ecosystem's rule (a null or empty version does not)."""
    text = strip(version)
    return F.coalesce(
        F.when(ecosystem == PYPI, text.rlike(PEP440)).when(
            ecosystem == NPM, text.rlike(SEMVER) | text.rlike(SEMVER_LOOSE)
        ),
        F.lit(False),
    )


def compare_versions(a: Column, b: Column, ecosystem: Column) -> Column:
    """-1, 0 or 1; null when either side does not parse."""
    return bind(
        F.struct(version_key(a, ecosystem).alias("a"), version_key(b, ecosystem).alias("b")),
        lambda k: F.when(k["a"] < k["b"], -1).when(k["a"] > k["b"], 1).when(k["a"] == k["b"], 0),
    )


PRERELEASE = (
    "CASE :e WHEN '" + PYPI + "' THEN " + let("_p", _pep440_fields(":v"), "_p[2] <> '' OR _p[8] <> ''")
    + " WHEN '" + NPM + "' THEN " + let("_p", _semver_fields(":v"), "_p[3] <> ''") + " END"
)
MAJOR = (
    "try_cast(CASE :e WHEN '" + PYPI + "' THEN " + let("_p", _pep440_fields(":v"), "split(_p[1], r'\\.')[0]")
    + " WHEN '" + NPM + "' THEN " + let("_p", _semver_fields(":v"), "_p[0]") + " END AS decimal(38,0))"
)


def is_prerelease(version: Column, ecosystem: Column) -> Column:
    """Null when unparsable; PEP 440 counts development releases too."""
    return apply_sql(PRERELEASE, v=version, e=ecosystem)


def major_of(version: Column, ecosystem: Column) -> Column:
    """First release number as decimal; null when unparsable or above 38 digits (the order keys have no such bound)."""
    return apply_sql(MAJOR, v=version, e=ecosystem)


def _keyed(versions: Column, ecosystem: Column) -> Column:
    """array<struct(key, position, version)> of the parsable entries."""
    return F.filter(
        F.transform(
            versions,
            lambda v, i: F.struct(version_key(v, ecosystem).alias("key"), i.alias("pos"), v.alias("v")),
        ),
        lambda s: s["key"].isNotNull(),
    )


def sort_versions(versions: Column, ecosystem: Column) -> Column:
    """Ascending and stable, unparsable entries dropped."""
    return F.transform(F.array_sort(_keyed(versions, ecosystem)), lambda s: s["v"])


def min_version_at_least(versions: Column, floor: Column, ecosystem: Column, allow_prerelease: bool = False) -> Column:
    """Smallest entry that is not below ``floor``, prereleases only on request."""

    def pick(floor_key: Column) -> Column:
        fits = F.filter(
            _keyed(versions, ecosystem),
            lambda s: (s["key"] >= floor_key)
            & (F.lit(True) if allow_prerelease else ~is_prerelease(s["v"], ecosystem)),
        )
        return F.array_min(fits)["v"]

    return bind(version_key(floor, ecosystem), pick)


def max_version(versions: Column, ecosystem: Column, allow_prerelease: bool = False) -> Column:
    """Highest entry, prereleases only on request."""
    kept = versions if allow_prerelease else F.filter(versions, lambda v: ~is_prerelease(v, ecosystem))
    return F.array_max(_keyed(kept, ecosystem))["v"]


# ---------------------------------------------------------------- specifiers


def exact_version(spec: Column) -> Column:
    """``1.2.3``, ``=1.2.3`` and ``v1.2.3`` name a version; ranges and tags do not."""
    return F.nullif(F.regexp_extract(spec, EXACT_SPEC, 1), F.lit(""))


def unresolvable_kind(spec: Column) -> Column:
    """Which kind of non-registry specifier this is, null for a registry one."""
    text = strip(F.coalesce(spec, F.lit("")))
    lowered = F.lower(text)
    chain = F.when(lowered.startswith(UNRESOLVABLE_PREFIXES[0]), F.lit(UNRESOLVABLE_PREFIXES[0]))
    for prefix in UNRESOLVABLE_PREFIXES[1:]:
        chain = chain.when(lowered.startswith(prefix), F.lit(prefix))
    return chain.when(text.rlike(GITHUB_SHORTHAND), F.lit("github shorthand"))


def range_base(spec: Column) -> Column:
    """``^1.2.3`` and ``>=1.2.3`` have the base ``1.2.3``; anything composed has none."""
    base = F.regexp_replace(strip(spec), r"^[\s=v^~<>!]*", "")
    return F.when((base != "") & ~base.rlike(r"[ ,|<>=&]"), base)


def same_version(a: Column, b: Column, ecosystem: Column) -> Column:
    """Equal text or equal under the ecosystem's order."""
    return F.coalesce(
        (strip(a) == strip(b)) | (version_key(a, ecosystem) == version_key(b, ecosystem)), F.lit(False)
    )


def _bare(version: Column) -> Column:
    return F.regexp_replace(
        strip(F.coalesce(version, F.lit(""))), r"^(?:==\s*)?(?:=\s*)?(?:v\s*)?(?:V\s*)?", ""
    )


def match_allowed_version(proposed: Column, allowed: Column) -> Column:
    """The allowed spelling of a proposed version, tolerating ``v``, ``=`` and ``==`` in front."""
    return bind(
        _bare(proposed),
        lambda wanted: F.get(F.filter(allowed, lambda a: (wanted != "") & (_bare(a) == wanted)), F.lit(0)),
    )
