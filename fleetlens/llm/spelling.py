"""Spelling variants: the vocabulary's acceptor, a one-edit transducer and the acceptor again, composed and enumerated."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import crc32_sql, shared_folder, stored

RUNS = r"[A-Za-zÀ-ÿ]{%d,}"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least this many times as often as the word it stands for.
FORM_RATIO = 10
#: Deletion mark of the query's contract: one run in 31 loses a code point.
DELETE_MOD = 31
#: Words of an initial-state partition before it is parted again by further letters.
GROUP = 20_000
SALTS = 32
_CAPITALS = "".join(map(chr, range(65, 91)))


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH, delete_mod: int | None = DELETE_MOD) -> DataFrame:
    """(word) of every run of letters of at least ``least`` code points after A-Z went to lower case.

    With ``delete_mod`` a run whose crc32 (of ``<doc_id>:<run>``, a null id being empty) it divides loses the code point at
    crc32 modulo length. Shorter runs cannot give a word of that length, so they are not even cut out.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS % least), F.lit(0))).alias("run"))
    low = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", _CAPITALS, _CAPITALS.lower())).otherwise(F.lower("run"))
    runs = runs.select("doc_id", low.alias("run"))
    if delete_mod is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % delete_mod == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.char_length("word") >= least)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough; counts are combined before their shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _parted(rows: DataFrame) -> DataFrame:
    """Every row of (…, span, lo, hi, g) in two partitions: by the first and by the last half of what its ``span`` leaves open.

    ``span`` is the length of the shorter word of a pair; its ``lo`` first and ``hi`` last letters are known to be shared. An
    edit lies behind one half of the open letters or before the other, so one of the two partitions holds the pair.
    """
    open_ = F.col("span") - F.col("lo") - F.col("hi")
    half = F.floor(open_ / 2).cast("int")
    size = F.char_length("word")
    left = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.substring(F.col("word"), F.col("lo") + 1, half).alias("piece"), F.lit("<").alias("side"))
    right = F.struct(
        F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi"), F.substring(F.col("word"), size - F.col("hi") - half + 1, half).alias("piece"), F.lit(">").alias("side")
    )
    parted = rows.withColumn("to", F.explode(F.array(left, right)))
    return parted.select(
        "word", "n", "span", F.col("to.lo").alias("lo"), F.col("to.hi").alias("hi"), F.concat("path", "to.side").alias("path"), F.xxhash64("g", "span", "path", "to.side", "to.piece").alias("g")
    )


def partitions(words: DataFrame, folder: str, least: int = LEAST_LENGTH, group: int = GROUP) -> DataFrame:
    """(word, n, span, lo, hi, path, g): the words by the initial states of the composition.

    A pair one edit apart starts from the states behind its shared first letters, or ends in those before its shared last
    ones. A word goes to the partitions of pairs whose shorter word has its length, and one less. A partition with more than
    ``group`` words is parted again by the same rule, so a common prefix with a third of all words spreads; with one open
    letter left it is bounded by the alphabet.
    """
    span = F.explode(F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda k: k >= least)).alias("span")
    start = words.select("word", "n", span).select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit("").alias("path"), F.lit(0).cast("long").alias("g"))
    now, done, turn = _parted(start), None, 0
    while True:
        now = stored(now, f"{folder}/parted-{turn}")
        sizes = now.filter(F.col("span") - F.col("lo") - F.col("hi") >= 2).groupBy("g").agg(F.count("*").alias("size"))
        hot = stored(sizes.filter(F.col("size") > group).select("g"), f"{folder}/hot-{turn}")
        if hot.isEmpty():
            return now if done is None else done.unionByName(now)
        salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
        spread = hot.select("g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large"))
        marked = now.withColumn("salt", salt).join(spread, ["g", "salt"], "left").drop("salt")
        rest = marked.filter("large is null").drop("large")
        done = rest if done is None else done.unionByName(rest)
        now, turn = _parted(marked.filter("large").drop("large")), turn + 1


class Acceptor:
    """The minimal acyclic acceptor of sorted words; a state knows how many words it accepts, so a path numbers its word."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def close(depth: int) -> None:
            """States deeper than ``depth`` are whole: each becomes the known state with the same arcs."""
            while len(path) > depth + 1:
                state = self._state(known, *path.pop())
                path[-1][0][last[len(path) - 1]] = state

        for word in words:
            shared = len(commonprefix((last, word)))
            close(shared)
            path.extend(({}, False) for _ in word[shared:])
            path[-1] = (path[-1][0], True)
            last = word
        close(0)
        self.start = self._state(known, *path[0])

    def _state(self, known: dict[tuple, int], arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in known:
            known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.count.append(final + sum(self.count[t] for t in arcs.values()))
        return known[key]

    def steps(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, next state, number of the first word that goes that way)."""
        at = int(self.final[state])
        for c, t in self.arcs[state].items():
            yield c, t, at
            at += self.count[t]


def composed(left: Acceptor, right: Acceptor, insert: bool) -> Iterator[tuple[int, int]]:
    """Numbers of the pairs that left o edit o right accepts, each once.

    The edit replaces a letter of the left word (then ``left`` is ``right``, and the pair comes in one order), or inserts one
    into it. Before the edit both acceptors read the same letters; after it they must accept the same rest. An insertion into a
    run of its own letter counts at the end of the run.
    """
    rests: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def rest(x: int, y: int) -> list[tuple[int, int]]:
        """Numbers of the words that both states accept."""
        if left is right and x == y:
            return [(k, k) for k in range(left.count[x])]
        if (x, y) not in rests:
            out = [(0, 0)] if left.final[x] and right.final[y] else []
            there = {c: (t, at) for c, t, at in right.steps(y)}
            for c, t, at in left.steps(x):
                if c in there:
                    u, to = there[c]
                    out += [(at + i, to + j) for i, j in rest(t, u)]
            rests[x, y] = out
        return rests[x, y]

    states = [(left.start, right.start, 0, 0)]
    while states:
        x, y, i, j = states.pop()
        here, there = list(left.steps(x)), list(right.steps(y))
        if insert:
            for c, u, to in there:
                same = next(((t, at) for d, t, at in here if d == c), None)
                skip = range(same[1], same[1] + left.count[same[0]]) if same else range(0)
                yield from ((i + p, j + to + q) for p, q in rest(x, u) if p not in skip)
        else:
            for k, (_, t, at) in enumerate(here):
                for _, u, to in here[k + 1 :]:
                    yield from ((i + at + p, j + to + q) for p, q in rest(t, u))
        onward = {c: (u, to) for c, u, to in there}
        states += [(t, onward[c][0], i + at, j + onward[c][1]) for c, t, at in here if c in onward]


def _belongs(a: str, b: str, path: str) -> bool:
    """True if the pair's own way of parting, first halves preferred, is ``path``: so every pair counts in one partition."""
    x, y = 0, min(len(a), len(b))
    m, n = len(a), len(b)
    hi = 0
    for side in path:
        half = (y - x - hi) // 2
        if a[x : x + half] == b[x : x + half]:
            if side == ">":
                return False
            x += half
        else:
            if side == "<" or a[m - hi - half : m - hi] != b[n - hi - half : n - hi]:
                return False
            hi += half
    return True


def near_pairs(words: list[str], span: int, lo: int, hi: int, path: str) -> Iterator[tuple[int, int]]:
    """Places in ``words`` of the pairs of a partition that are one edit apart, the shorter word having ``span`` letters."""
    order = sorted(range(len(words)), key=lambda k: (words[k][:lo], words[k][len(words[k]) - hi :], len(words[k]), words[k]))
    for _, members in groupby(order, key=lambda k: (words[k][:lo], words[k][len(words[k]) - hi :])):
        both = [[], []]
        for k in members:
            both[len(words[k]) - span].append(k)
        if not both[0] or len(both[0]) + len(both[1]) < 2:
            continue
        cores = [[words[k][lo : len(words[k]) - hi] for k in side] for side in both]
        skip = len(commonprefix(cores[0] + cores[1]))  # letters that all share are not walked
        short, long = (Acceptor([c[skip:] for c in side]) if side else None for side in cores)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * span + 2000))
        if len(both[0]) > 1:
            yield from ((both[0][i], both[0][j]) for i, j in composed(short, short, False) if _belongs(words[both[0][i]], words[both[0][j]], path))
        if long:
            yield from ((both[0][i], both[1][j]) for i, j in composed(short, long, True) if _belongs(words[both[0][i]], words[both[1][j]], path))


def neighbours(parts: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): near words of every word that has any, summed up inside each partition."""

    def tally(g: list[tuple], out: dict[str, list]) -> None:
        words, n = [r[0] for r in g], [r[1] for r in g]
        for i, j in near_pairs(words, *g[0][2:6]):
            for a, b in ((i, j), (j, i)):
                own = out.setdefault(words[a], [0, None, 0])
                own[0] += 1
                if own[2] < n[b] or own[2] == n[b] and words[b] < own[1]:
                    own[1:] = words[b], n[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: dict[str, list]) -> pa.RecordBatch:
            columns = [list(out), *([v[k] for v in out.values()] for k in range(3))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n_near", "best", "best_n"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][6], held[0][2:6]) != (row[6], row[2:6]):
                    if len(held) > 1:
                        out: dict[str, list] = {}
                        tally(held, out)
                        if out:
                            yield batch_of(out)
                    held = []
                held.append(row)
        if len(held) > 1:
            out = {}
            tally(held, out)
            yield batch_of(out)

    order = ["g", "span", "lo", "hi", "path"]
    found = parts.select("word", "n", "span", "lo", "hi", "path", "g").repartition(*order).sortWithinPartitions(*order)
    found = found.mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of every row of (word, form): forms followed to the last, the distance doubling in every round."""
    now, turn = stored(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turn += 1
        jumped = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{folder}/roots-{turn}")
        now = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, delete_mod: int | None = DELETE_MOD, group: int = GROUP) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of the texts; parameters as named by the constants above.

    ``form`` is the most frequent near word (ties: the first in code-point order) if it occurs ``ratio`` times as often, else
    null with ``form_n``; ``root`` is the last of the forms. Null and empty texts have no words, repeated rows count as often as
    they occur, only ``doc_id`` and ``text`` are read, an empty table gives no row. Runs of any length are whole words.
    """
    if ratio < 2:
        raise ValueError("forms must occur more often than their words, or following them would not end")
    folder = shared_folder(docs.sparkSession)
    words = stored(vocabulary(occurrences(docs.select("doc_id", "text"), least, delete_mod), least_count), f"{folder}/words")
    near = neighbours(partitions(words, folder, least, group))
    has_form = F.col("best_n") >= F.col("n") * ratio
    known = words.join(near, "word", "left").select(
        "word", "n", F.when(has_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best_n")).alias("form_n")
    )
    known = stored(known, f"{folder}/known")
    last = roots(known.filter("form is not null"), folder)
    return known.join(last, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


#: DuckDB SQL for ``variants`` of ``documents``: words meet by what is left when a code point is deleted.
VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
low AS (SELECT id, translate(run, '{_CAPITALS}', '{_CAPITALS.lower()}') AS run, count(*) AS times FROM runs GROUP BY 1, 2),
marked AS MATERIALIZED (SELECT run, times, {crc32_sql("id || ':' || run")} AS h FROM low),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM marked),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
gaps AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS gap FROM words, unnest(range(1, length(word) + 1)) AS u(k)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.k = b.k AND a.word <> b.word
         UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.gap = w.word
         UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.gap = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
known AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, coalesce(b.n_near, 0) AS n_near,
                 CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk(word, here, depth) AS (SELECT word, word, 0 FROM known UNION ALL SELECT walk.word, known.form, depth + 1 FROM walk JOIN known ON known.word = walk.here WHERE known.form IS NOT NULL),
last AS (SELECT word, arg_max(here, depth) AS root FROM walk GROUP BY word)
SELECT known.word, n, form, root, n_near, form_n FROM known JOIN last ON last.word = known.word
"""
