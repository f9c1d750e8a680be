"""Text, path and label expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.versions import WHITE_SPACE, bind, strip

REDACTED = "***"

# Credential shapes and placeholders that are no secrets, directory names never scanned, and the
# file-name words of requirement files.
PLACEHOLDER = r"\$\{[^}@/\s,;\"']*\}|\$[A-Za-z_][A-Za-z0-9_]*|%[A-Za-z_][A-Za-z0-9_]*%"
CREDENTIAL_KEYS = (
    r"_authToken|_auth|_password|password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|token"
)
TOKEN_SHAPES = (
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|pypi-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,}"
)
EXTRACTOR_IGNORED = [
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "dist", "build", "__pycache__", "site-packages",
    ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".eggs",
]
SCANNER_IGNORED = [
    ".git", "node_modules", ".venv", "venv", "env", "dist", "build", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".tox", "site-packages", "coverage", ".next", ".cache", ".ruff_cache", ".eggs", ".idea", ".vscode", ".svn", ".hg",
]
PROFILER_IGNORED = [
    ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", ".tox", ".mypy_cache",
]
PROFILER_HIDDEN_KEPT = [".github"]
DEV_FILE_MARKERS = ["dev", "test"]
NOT_DEV_TOKENS = ["latest", "greatest", "fastest", "attest", "contest", "detest", "protest"]
LINE_BREAK = r"\r\n|\r|\n"
WIDE_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

_URL_USERINFO = rf"(?U)([A-Za-z][A-Za-z0-9+.-]*://)(?!(?:{PLACEHOLDER})@)[^/\s@]+@"
_KEY_VALUE = (
    rf"(?iU)((?<![A-Za-z0-9_])(?:{CREDENTIAL_KEYS})\s*[=:](?!=)\s*)"
    rf"(?!(?:{PLACEHOLDER})(?:[\s,;\"']|$))[^\s,;\"']+"
)
_TOKEN = rf"(?U)\b(?:{TOKEN_SHAPES})\b"
# what a text must contain for the last two to match: one of these in any case, or one of those as it is
_KEY_PARTS = ["auth", "passw", "secret", "api", "token"]
_TOKEN_PARTS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "pypi-", "npm_", "AKIA", "xox"]


def decode_text(content: Column) -> Column:
    """A2: bytes to text by byte-order mark, UTF-8 without one; undecodable bytes become the replacement sign.

    UTF-16 and UTF-32 need ``sources.files.read_text_files`` for the replacing; UTF-8 does not.
    """
    mark = F.hex(F.substring(content, 1, 4))

    def after(n: int, charset: str) -> Column:
        return F.decode(F.substring(content, F.lit(n + 1), F.length(content)), charset)

    return (
        F.when(mark.startswith("EFBBBF"), _utf8(F.substring(content, F.lit(4), F.length(content))))
        .when(mark.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32"))  # this charset reads the mark itself
        .when(mark.startswith("FFFE"), after(2, "UTF-16LE"))
        .when(mark.startswith("FEFF"), after(2, "UTF-16BE"))
        .otherwise(_utf8(content))
    )


def _utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def redact_secrets(text: Column) -> Column:
    """URL credentials, credential assignments and known token shapes become ``***``; lines stay lines.

    Environment placeholders are kept. A credential word inside a kept ``${…}`` placeholder is still masked. Most texts
    contain no part of any pattern; a few substring searches find that out, and the patterns run over the others only.
    """

    def masked(t: Column) -> Column:
        url = F.regexp_replace(t, _URL_USERINFO, r"$1***@")
        return F.when(~_may_hold_secret(t), t).otherwise(F.regexp_replace(F.regexp_replace(url, _KEY_VALUE, r"$1***"), _TOKEN, REDACTED))

    return bind(text, masked)


def _may_hold_secret(text: Column) -> Column:
    """False only where none of the three patterns can match; letters beyond ASCII may be case variants, so such a text may."""
    found = (F.octet_length(text) != F.char_length(text)) | (text.contains("://") & text.contains("@"))
    for part in _TOKEN_PARTS:
        found = found | text.contains(part)
    return found | bind(F.lower(text), lambda low: reduce(Column.__or__, [low.contains(p) for p in _KEY_PARTS]))


def contains_secret(text: Column) -> Column:
    """Would ``redact_secrets`` change the text."""
    return F.coalesce(
        text.rlike(_URL_USERINFO) & (redact_secrets(text) != text)
        | text.rlike(_KEY_VALUE) & (redact_secrets(text) != text)
        | text.rlike(_TOKEN),
        F.lit(False),
    )


def redact_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """C1 on every named column of a table, one projection."""
    return df.withColumns({c: redact_secrets(F.col(c)) for c in columns})


def truncate_text(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(
        text
    )


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """C4: one row per line (CRLF, CR and LF only), numbered from 1."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(F.split(F.col(content), LINE_BREAK)).alias("_pos", "text")).select(
        *rest, (F.col("_pos") + 1).alias("line_no"), "text"
    )


# two Unicode non-characters: by definition never part of interchanged text
_NUMBER_END, _JOINED = "﷐", "﷑"


def logical_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Requirement lines with continuations joined and comments and blanks dropped.

    Works inside the row: the physical lines are numbered in place, joined where one ends in a backslash and split
    again, so no file is ever collected by a window and nothing is shuffled. ``line_no`` is the first physical line.
    """
    rest = [c for c in files.columns if c != content]
    edge = F.lit(WHITE_SPACE)

    def tag(line: Column, i: Column) -> Column:
        cut = F.rtrim(line, edge)
        joined = cut.endswith("\\") & ~F.ltrim(cut, edge).startswith("#")
        end = F.when(joined, F.concat(F.substring(cut, F.lit(1), F.length(cut) - 1), F.lit(_JOINED))).otherwise(
            F.concat(cut, F.lit("\n"))
        )
        # only a line with a backslash can go on; white space at the end of the others goes with that of the whole line
        end = F.when(line.contains("\\"), end).otherwise(F.concat(line, F.lit("\n")))
        return F.concat((i + 1).cast("string"), F.lit(_NUMBER_END), end)

    chunks = F.split(F.array_join(F.transform(F.split(F.col(content), WIDE_LINE_BREAK), tag), ""), "\n")

    def cleaned(body: Column) -> Column:
        # inner line numbers of a joined line, and the mark of a continuation at the end of the file
        whole = F.when(body.contains(_JOINED), F.regexp_replace(body, rf"{_JOINED}(?:\d+{_NUMBER_END})?", "")).otherwise(body)
        return bind(whole, lambda w: strip(F.when(w.contains("#"), F.regexp_replace(w, r"(?U)(^|\s)#.*$", "")).otherwise(w)))

    def line(chunk: Column) -> Column:
        return bind(
            F.substring_index(chunk, _NUMBER_END, 1),
            lambda n: F.struct(
                n.try_cast("int").alias("line_no"),
                cleaned(F.substring(chunk, F.length(n) + 2, F.length(chunk))).alias("text"),
            ),
        )

    # the lines leave the generator finished: a filter on ``text`` then reads a column and repeats none of the work
    lines = F.filter(F.transform(chunks, line), lambda x: x["text"] != "")
    return files.select(*rest, F.inline(lines))


def normalise_path(base: Column, argument: Column) -> Column:
    """``argument`` relative to the directory of ``base`` with ``.`` and ``..`` resolved inside the root."""
    directory = F.regexp_replace(base, r"[^/]*$", "")
    joined = F.when(argument.startswith("/"), argument).otherwise(F.concat(directory, argument))
    return F.array_join(
        F.aggregate(
            F.split(joined, "/"),
            F.array().cast("array<string>"),
            lambda stack, part: F.when(part.isin("", "."), stack)
            .when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part))),
        ),
        "/",
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path, '' at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def prune_paths(files: DataFrame, ignored: list[str], path: str = "path", keep_hidden: list[str] | None = None):
    """A3: files without an ignored directory above them.

    With ``keep_hidden`` every other hidden directory is ignored as well (the profiler's rule).
    """
    dirs = F.split(parent_dir(F.col(path)), "/")
    kept = files.filter(~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ignored])))
    if keep_hidden is not None:
        allowed = F.array(*[F.lit(d) for d in keep_hidden])
        kept = kept.filter(~F.exists(dirs, lambda d: d.startswith(".") & ~F.array_contains(allowed, d)))
    return kept


def is_requirements_file(path: Column) -> Column:
    """``requirements.txt``, ``requirements-*.txt``, ``requirements_*.txt``, ``requirements/*.txt``."""
    lowered = F.lower(path)
    return lowered.rlike(r"(^|/)requirements(\.txt|[-_][^/]*\.txt)$") | lowered.rlike(r"(^|/)requirements/[^/]*\.txt$")


def is_dev_requirements_file(path: Column) -> Column:
    """A word of the file name contains ``dev`` or ``test``, ordinary words like ``latest`` aside."""
    stem = F.regexp_replace(F.lower(base_name(path)), r"\.txt$", "")
    ordinary = F.array(*[F.lit(t) for t in NOT_DEV_TOKENS])
    return F.exists(
        F.split(stem, r"[-_.]+"),
        lambda t: t.rlike("|".join(DEV_FILE_MARKERS)) & ~F.array_contains(ordinary, t),
    )


def dependency_label(name: Column, version: Column) -> Column:
    """``pkg@version``, only ``pkg`` when the version is unknown."""
    shown = F.coalesce(name, F.lit("?"))
    return F.when(F.coalesce(version, F.lit("")) == "", shown).otherwise(F.concat(shown, F.lit("@"), version))


def graph_node_id(label: str, *key: Column) -> Column:
    """``Label:key:key`` from the natural key of a graph node."""
    return F.concat_ws(":", F.lit(label), *[k.cast("string") for k in key])


def node_label(node_id: Column, name: Column) -> Column:
    """Caption of a node, its kind and what it is called."""
    return F.concat(F.substring_index(node_id, ":", 1), F.lit(":"), name)


def ancestors(directory: Column) -> Column:
    """All directories from ``directory`` up to the root, nearest first; the root is ''."""

    def prefixes(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
        )

    return F.when(directory == "", F.array(F.lit(""))).otherwise(bind(F.split(directory, "/"), prefixes))
