"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.labelled import fit_logistic, probability, sample_ids, with_labels

#: Bounds of the sample: labelled documents per class, and blocks of each that train a dictionary.
PER_CLASS = 2000
BLOCKS_PER_DOC = 4
BLOCK = 1024
DICTIONARY = 64 << 10
LEVEL = 1
THRESHOLD = 0.7


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]


class Measure:
    """Compressed sizes of a text's blocks under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def features(self, text: str | None) -> list[float]:
        """The normalised difference of the compressed sizes, over the text and of its worst and best block, and a shortness."""
        parts = blocks(text)
        if not parts:
            return [0.0, 0.0, 0.0, 1.0]
        good, bad = ([len(c.compress(p)) for p in parts] for c in self.pair)
        own = [(b - g) / max(b, g) for g, b in zip(good, bad)]
        long = [d for d, p in zip(own, parts) if len(p) >= BLOCK // 4] or own
        return [(sum(bad) - sum(good)) / max(sum(bad), sum(good)), min(long), max(long), 1 / (1 + sum(map(len, parts)) / 256)]


def train_dictionaries(sample: list[tuple[int, list[bytes]]]) -> tuple[bytes, bytes] | None:
    """Dictionaries of the good and the bad blocks; raw blocks one after another where there are too few to train."""
    out = []
    for y in (1, 0):
        own = sorted({p for label, parts in sample if label == y for p in parts if len(p) >= 16})
        if not own:
            return None
        try:
            out.append(zstandard.train_dictionary(DICTIONARY, own).as_bytes())
        except zstandard.ZstdError:
            out.append(b"".join(own)[-DICTIONARY:])
    return out[0], out[1]


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1, higher is better) and predicted, learned from labels where ``learn`` holds.

    Dictionaries and the calibration (a logistic curve over the size differences) come from at most ``per_class``
    documents of each class; every text is scored whole, null like empty. Without labels of both classes every score is
    the share of good labels (0.5 if there are none). New columns replace columns of the same name.
    """
    docs = docs.drop("score", "predicted")
    ids, share = sample_ids(labels, "quality", learn, per_class)
    dictionaries, coef, base = None, None, 0.5
    if share:
        base = float(1 in share) if len(share) == 1 else 0.5
        sample = with_labels(docs, ids)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = []
                for t in batch.column(1).to_pylist():
                    own = blocks(t)
                    step = max(1, len(own) // BLOCKS_PER_DOC)
                    parts.append(own[::step][:BLOCKS_PER_DOC])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.binary()))], names=["y", "parts"])

        got = sample.select(F.col("_y").alias("y"), "text").mapInArrow(cut, "y int, parts array<binary>").collect()
        dictionaries = train_dictionaries([(r.y, list(map(bytes, r.parts))) for r in got])
    if dictionaries:

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Measure(*dictionaries)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

        got = sorted(sample.select(F.col("_y").alias("y"), "text").mapInArrow(measure, "y int, x array<double>").collect(), key=lambda r: (r.y, r.x))
        y = np.array([r.y for r in got], float)
        coef = fit_logistic(np.array([r.x for r in got]) * 10, y, np.array([share[int(v)] for v in y]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measure(*dictionaries) if dictionaries else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            p = probability(np.array([m.features(t) for t in texts]) * 10, coef) if m and texts else np.full(len(texts), base)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(score, schema)
