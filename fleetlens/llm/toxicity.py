"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.labelled import fit_logistic, probability, sample_ids, with_labels

#: Bounds of what is learned: labelled documents per class, and entries of the insult lexicon.
PER_CLASS = 4000
LEXICON = 5000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

# Closed word classes of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your youre yourself he she they him her them people du dich dir dein deine ihr euch sie er tu te toi vous ton ta il elle ils elles usted tú tu vosotros ellos ellas él ella".split())
NEGATIONS = frozenset("not no never isnt arent wasnt dont nobody nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say wrote writes claimed claims called quoted according reported sagte sagt schrieb nannte laut dit disait écrit selon appelé dijo dice escribió según llamó".split())
THREATS = frozenset("kill killed hurt destroy murder beat stab shoot burn die töten umbringen vernichten verletzen tuer détruire frapper mourir matar destruir golpear morir".split())
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n\"“”«»]")
_STOPS = frozenset(".!?;:,\n")
_QUOTES = frozenset('"“”«»')
#: Words that a negation reaches over.
REACH = 3
PATHS = ("insult", "insult at a target", "negated insult", "reported insult", "threat", "negated or reported threat")


@dataclass
class Lexicon:
    """Weights of insult words (``=word``) and stems (``^stem``), learned as log-odds."""

    weights: dict[str, float]

    def weight(self, word: str) -> float:
        best = self.weights.get("=" + word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                best = max(best, self.weights.get("^" + word[:n], 0.0))
        return best


def symbol_of(word: str, lexicon: Lexicon) -> tuple[str, float]:
    """The lexical transducer: a word becomes a class symbol with a weight."""
    weight = lexicon.weight(word)
    if weight > 0:
        return "insult", weight
    for name, group in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
        if word in group:
            return name, 1.0
    return "other", 0.0


def clause_paths(symbols: list[tuple[str, float]], quoted: bool) -> list[tuple[int, float]]:
    """The grammar over one clause: (path, weight) of each insult or threat.

    Three transducers are composed: the negation transducer counts down its reach, the reporting one stays on after a
    reporting verb or inside quotation marks, the target one is on if the clause names somebody. Their joint state when
    an insult or threat is read decides the path.
    """
    target = any(s == "target" for s, _ in symbols)
    negated, reported, out = 0, quoted, []
    for name, weight in symbols:
        if name == "negation":
            negated = REACH + 1
        elif name == "report":
            reported = True
        elif name == "insult":
            out.append((2 if negated else 3 if reported else 1 if target else 0, weight))
        elif name == "threat" and target:
            out.append((5 if negated or reported else 4, weight))
        negated = max(0, negated - 1)
    return out


def features(text: str | None, lexicon: Lexicon, memo: dict[str, tuple[str, float]]) -> list[float]:
    """Per path the log of one plus its clause weights; then number, density and strongest of all matches."""
    sums, clause, quoted, n_words, hits, top = [0.0] * len(PATHS), [], False, 0, 0, 0.0
    clauses = []
    for token in _TOKEN.findall((text or "").lower()):
        if token in _STOPS:
            if clause:
                clauses.append((clause, quoted))
                clause = []
        elif token in _QUOTES:
            quoted = not quoted
        else:
            n_words += 1
            found = memo.get(token)
            if found is None:
                if len(memo) > 200_000:
                    memo.clear()
                found = memo[token] = symbol_of(token, lexicon)
            clause.append(found)
    if clause:
        clauses.append((clause, quoted))
    for symbols, inside in clauses:
        for path, weight in clause_paths(symbols, inside):
            sums[path] += weight
            hits += 1
            top = max(top, weight)
    total = sum(sums)
    return [*map(math.log1p, sums), math.log1p(hits), math.log1p(100 * total / max(n_words, 20)), math.log1p(total), top]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that many more toxic than clean sampled texts hold; equal texts count once."""
    texts = sample.groupBy("text").agg(F.max("_y").alias("y"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))

    def stems_of(n: int) -> Column:
        return F.transform(F.filter("w", lambda x: F.length(x) >= n), lambda x: F.concat(F.lit("^"), F.substring(x, 1, n)))

    stems = map(stems_of, PREFIXES)
    terms = F.array_distinct(F.concat(F.transform("w", lambda x: F.concat(F.lit("="), x)), *stems))
    counts = texts.select("y", words.alias("w")).select("y", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    sizes = texts.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).first()
    n_bad, n_good = max(1, sizes.bad or 0), max(1, sizes.good or 0)
    expected = (F.col("good") + 0.5) * (n_bad / n_good)
    odds = F.log((F.col("bad") + 0.5) / n_bad) - F.log((F.col("good") + 0.5) / n_good)
    strong = counts.filter((F.col("bad") >= max(3, 0.01 * n_bad)) & ((F.col("bad") - expected) / F.sqrt(expected + 1) >= 3.5)).select("term", odds.alias("weight"))
    return Lexicon({r.term: r.weight for r in strong.filter("weight > 1").orderBy(F.desc("weight"), "term").limit(LEXICON).collect()})


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (1 from ``THRESHOLD``), learned from labels where ``learn`` holds.

    The lexicon and the weights of the grammar's paths come from a sample of at most ``per_class`` documents per class;
    every text is then scored whole, also null (as empty) and empty ones. Without any labelled text all scores are 0. Labels of
    null ids or other values than 0 and 1 are not used; new columns replace columns of the same name.
    """
    docs = docs.drop("score", "predicted")
    ids, share = sample_ids(labels, "toxic", learn, per_class)
    lexicon, coef = Lexicon({}), None
    if share:
        sample = with_labels(docs, ids)
        lexicon = learn_lexicon(sample)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for batch in batches:
                rows = [features(t, lexicon, memo) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

        got = sample.select(F.col("_y").alias("y"), "text").mapInArrow(measure, "y int, x array<double>").collect()
        got.sort(key=lambda r: (r.y, r.x))
        y = np.array([r.y for r in got], float)
        if got:
            coef = fit_logistic(np.array([r.x for r in got]), y, np.array([share[int(v)] for v in y]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            rows = [features(t, lexicon, memo) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            p = probability(np.array(rows), coef) if rows and coef is not None else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(score, schema)
