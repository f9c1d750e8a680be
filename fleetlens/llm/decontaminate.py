"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seeds are n-grams of two to this many words.
GRAM = 4
#: A seed is rare if independent words would give it at most so often per document.
RARE = 1e-3
MIN_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Test items are taken in blocks of about so many words; a block's seeds (at most 24 bytes a word and length) go to each task.
BLOCK_WORDS = 1_000_000
_PUNCT = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def item_words(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_PUNCT))]


def word_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit code of every word; words that the benchmark lacks get 0."""
    return np.fromiter((known.get(w, 0) for w in words), np.uint64, len(words))


def all_gram_codes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """The codes of the n-grams of words for n from 1 to ``longest``, each from those before; 0 if a word is one that the benchmark lacks."""
    out, state, known = [], codes, codes != 0
    for n in range(1, longest + 1):
        if n > 1:
            state = (state[:-1] ^ (state[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :]
            known = known[:-1] & known[1:]
        out.append(np.where(known, state | np.uint64(1), np.uint64(0)))
        if len(codes) <= n:
            out += [np.empty(0, np.uint64)] * (longest - n)
            break
    return out


def _code(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word) | 1


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Smith-Waterman score of the best local alignment of two word sequences, row by row."""
    best, row, steps = 0, np.zeros(len(passage) + 1, np.int64), np.arange(len(passage) + 1) * -GAP
    for code in item:
        diag = row[:-1] + np.where(passage == code, MATCH, MISMATCH)
        now = np.concatenate([[0], np.maximum(np.maximum(diag, row[1:] + GAP), 0)])
        row = np.maximum.accumulate(now + steps) - steps  # gaps along the passage
        best = max(best, int(row.max()))
    return best


def rare_grams(logs: np.ndarray, per_doc: float, rare: float, gram: int) -> list[tuple[int, int]]:
    """(place, n) of the seeds of an item from the log shares of its words.

    The shortest n-grams, of two words up to ``gram``, that independent words would give at most ``rare`` times per document;
    one that contains a rare one is left out, as it would find nothing else. An item without any gives its rarest n-grams of
    the greatest length; an item of one word gives that word.
    """
    if len(logs) < 2:
        return [(0, 1)] * len(logs)
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    seeds, covered, expected = [], np.zeros(len(logs), bool), np.empty(0)
    longest = min(gram, len(logs))
    for n in range(2, longest + 1):
        expected = np.exp(sums[n:] - sums[:-n]) * per_doc
        covered = covered[:-1] | covered[1:]
        seeds += [(int(k), n) for k in np.flatnonzero((expected <= rare) & ~covered)]
        covered |= expected <= rare
    return seeds or [(int(k), longest) for k in np.flatnonzero(expected <= expected.min() * (1 + 1e-9))]


@dataclass
class Block:
    """Items of one block: their ids and word codes, the codes of their words, and the sorted seeds of every length."""

    ids: list[int]
    codes: list[np.ndarray]
    known: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    def leaks(self, text: str | None, min_score: float) -> list[tuple[int, float]]:
        """(item_id, score) of the items whose alignment near one of their seeds reaches ``min_score``."""
        codes = word_codes(item_words(text), self.known)
        grams = all_gram_codes(codes, max(self.seeds, default=1))
        near: dict[int, list[int]] = {}
        for n, (seed, owner) in self.seeds.items():
            at = np.flatnonzero(grams[n - 1])
            mine = grams[n - 1][at]
            lo = np.searchsorted(seed, mine)
            hit = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == mine)
            hi = np.searchsorted(seed, mine[hit], "right")
            for p, s, e in zip(at[hit].tolist(), lo[hit].tolist(), hi.tolist()):
                for item in owner[s:e].tolist():
                    near.setdefault(item, []).append(p)
        scores = ((self.ids[item], _score(self.codes[item], codes, places, min_score)) for item, places in near.items())
        return [x for x in scores if x[1] >= min_score]


def _score(item: np.ndarray, codes: np.ndarray, places: list[int], min_score: float = MIN_SCORE) -> float:
    """The best normalised alignment in the windows around the seeds; 0 for windows with too few words of the item.

    An alignment that reaches ``min_score`` loses at most 2 (1 - min_score) points per word of the item, one for each word
    put in, so it lies in a window of that many words and the item's own on both sides of each of its seeds.
    """
    reach, best = len(item) + int(2 * (1 - min_score) * len(item)) + 1, 0
    spans: list[tuple[int, int]] = []
    for p in sorted(places):
        s, e = max(0, p - reach), min(len(codes), p + reach)
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    own, times = np.unique(item, return_counts=True)
    for s, e in spans:
        # a match uses up a word of the window and one of the item: if they share fewer than the score needs, it ends here
        place = np.minimum(np.searchsorted(own, codes[s:e]), len(own) - 1)
        shared = np.bincount(place[own[place] == codes[s:e]], minlength=len(own))
        if np.minimum(shared, times).sum() >= min_score * len(item) - 1e-9:
            best = max(best, align(item, codes[s:e]))
    return best / (MATCH * len(item)) if len(item) else 0.0


def _word_counts(docs: DataFrame, known: dict[str, int]) -> Counter:
    """How often the corpus has each word of a block; "" counts all words, "\\n" the documents. As many rows as the block has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = item_words(t)
                seen.update(w for w in own if w in known)
                seen[""] += len(own)
            seen["\n"] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({r.word: r.n for r in counts.toLocalIterator()})


def blocks(docs: DataFrame, items: DataFrame, gram: int = GRAM, rare: float = RARE, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The test items block by block, each item row whole in one; what an item finds does not depend on its block."""
    held: list[tuple[int, list[str]]] = []

    def block() -> Block:
        known = {w: _code(w) for _, ws in held for w in ws}
        counts = _word_counts(docs, known)
        total = max(1, counts[""])
        share = {w: np.log((counts[w] + 0.5) / total) for w in known}
        codes = [word_codes(ws, known) for _, ws in held]
        found: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(held):
            grams = all_gram_codes(codes[k], gram)
            for at, n in rare_grams(np.array([share[w] for w in ws]), total / max(1, counts["\n"]), rare, gram):
                found.setdefault(n, []).append((int(grams[n - 1][at]), k))
        seeds = {}
        for n, pairs in found.items():
            pairs = sorted(set(pairs))
            seeds[n] = np.array([g for g, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int32)
        return Block([i for i, _ in held], codes, known, seeds)

    size = 0
    for row in items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        ws = item_words(row.text)
        if ws:
            if held and size + len(ws) > block_words:
                yield block()
                held, size = [], 0
            held.append((row.item_id, ws))
            size += len(ws)
    if held:
        yield block()


def contaminated(docs: DataFrame, items: DataFrame, gram: int = GRAM, rare: float = RARE, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score): documents with a passage that aligns with a test item.

    score is the Smith-Waterman score (match 2, mismatch and gap -1) over that of the whole item, 0 to 1; rows reach
    ``min_score``. Candidates share a rare n-gram of words with the item (``rare_grams``): its rarity is the *expected* one,
    by the word counts of the whole corpus, so a leak into many documents stays rare. At a score of 0.6 an item of six words
    or more shares two neighbouring words with the passage whatever the edits, and three under replacements alone.

    The test items are the query set: they meet all documents block by block (``block_words``), each item row whole, so the
    block size changes no row. A document is read once per block for counts and once for seeds; nothing of it is shuffled.
    Nulls and texts without words match nothing, nor do items without an id; a document without an id is reported with a
    null; item rows of one id are items of their own; equal result rows come once; empty tables give no rows; other columns
    are not read.
    """
    schema = "doc_id long, item_id long, score double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(docs, items, gram, rare, block_words):
        out = out.union(docs.mapInArrow(_finder(docs, block, min_score), schema))
    return out.distinct()


def _finder(docs: DataFrame, block: Block, min_score: float) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *leak) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for leak in shared.value.leaks(t, min_score)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "score"])

    return find


def decontaminate(docs: DataFrame, items: DataFrame, gram: int = GRAM, rare: float = RARE, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without those whose text ``contaminated`` finds; all columns as they came, whatever their names.

    Each row is judged by its own text, one without an id too; of rows of one id those that leak go. Nothing is shuffled.
    """
    place = docs.columns.index("text")
    for block in blocks(docs, items, gram, rare, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(t, min_score) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
