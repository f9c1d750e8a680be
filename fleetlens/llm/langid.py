"""Language identification with a byte convolutional network, trained in numpy on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 192
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bounds of the training sample: labelled documents per class, classes, and windows taken from each document.
PER_CLASS = 300
MAX_CLASSES = 500
WINDOWS_PER_DOC = 3


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The bytes of a text in rows of ``window``; the last row is filled with zeros."""
    rows = max(1, -(-len(raw) // window))
    return np.frombuffer(raw.ljust(rows * window, b"\0"), np.uint8).reshape(rows, window)


@dataclass
class ByteNet:
    """Embedding, filters of several widths side by side in one matrix (narrow ones are padded), max pooling, softmax."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _patches(self, x: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        e = self.embed[x]
        return np.concatenate([e[:, k : x.shape[1] - wide + 1 + k] for k in range(wide)], axis=2)

    def scorer(self):
        """Logits of rows of windows. The filters' answer to every pair of bytes is computed once: a convolution of width
        four is then the sum of two table rows, the same values as the matrix product."""
        pairs = np.concatenate([np.repeat(self.embed, 256, 0), np.tile(self.embed, (256, 1))], 1)
        front, back = pairs @ self.filters[: 2 * EMBED], pairs @ self.filters[2 * EMBED :]

        def logits(x: np.ndarray) -> np.ndarray:
            wide = x.astype(np.intp)
            pair = wide[:, :-1] * 256 + wide[:, 1:]
            act = np.take(front, pair[:, :-2], 0)
            act += np.take(back, pair[:, 2:], 0)
            return np.maximum(act.max(axis=1) + self.bias, 0) @ self.out + self.out_bias

        return logits


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy; the order of batches and the start are seeded, so reruns agree."""
    rng, wide, n_f = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide * EMBED, n_f), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    net = ByteNet(
        labels,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.25, (wide * EMBED, n_f)) * mask).astype(np.float32),
        np.zeros(n_f, np.float32),
        rng.normal(0, 0.2, (n_f, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    names = ["embed", "filters", "bias", "out", "out_bias"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xb, n = x[rows], len(rows)
            p = net._patches(xb)
            act = p @ net.filters
            top = act.argmax(axis=1)
            pre = np.take_along_axis(act, top[:, None, :], 1)[:, 0, :] + net.bias
            hid = np.maximum(pre, 0)
            z = hid @ net.out + net.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y[rows]] -= 1
            z /= n
            d_hid = (z @ net.out.T) * (pre > 0)
            seen = np.take_along_axis(p, np.repeat(top[:, :, None], p.shape[2], 2), 1)  # n, filters, patch
            grads = {"out": hid.T @ z, "out_bias": z.sum(0), "bias": d_hid.sum(0), "filters": np.einsum("nf,nfd->df", d_hid, seen) * mask}
            d_patch = d_hid[:, :, None] * net.filters.T[None]
            d_embed = np.zeros_like(net.embed)
            for k in range(wide):
                where = np.take_along_axis(xb, top + k, 1)
                np.add.at(d_embed, where.reshape(-1), d_patch[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
            grads["embed"] = d_embed
            step += 1
            for name in names:
                first[name] = 0.9 * first[name] + 0.1 * grads[name]
                second[name] = 0.999 * second[name] + 0.001 * grads[name] ** 2
                move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - np.float32(rate) * move.astype(np.float32))
    return net


def training_sample(docs: DataFrame, learn: Column, per_class: int = PER_CLASS, max_classes: int = MAX_CLASSES) -> list[tuple[str, bytes]]:
    """At most ``per_class`` texts of each of the ``max_classes`` most frequent lang values, by a hash of their ids.

    The sample is chosen on the distinct (doc_id, lang) alone; only its texts are read. Each gives at most ``WINDOWS_PER_DOC``
    windows, those of one of its rows however often it is repeated.
    """
    spark = docs.sparkSession
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").distinct()
    classes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_classes).select("lang")
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    ids = known.join(F.broadcast(classes), "lang").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_class)
    ids = spark.createDataFrame([(r.doc_id, r.lang) for r in ids.select("doc_id", "lang").toLocalIterator()], "_id long, _lang string")
    raw = F.col("text").cast("binary")
    n = F.octet_length("text")
    spots = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda k: (F.greatest(n - WINDOW, F.lit(0)) * k / (WINDOWS_PER_DOC - 1)).cast("int"))
    parts = docs.filter(learn & F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    parts = parts.select("doc_id", "lang", F.transform(F.array_distinct(spots), lambda at: F.struct(at.alias("at"), F.substring(raw, at + 1, F.lit(WINDOW)).alias("part"))).alias("cuts"))
    parts = parts.groupBy("doc_id", "lang").agg(F.min("cuts").alias("cuts")).select("doc_id", "lang", F.inline("cuts"))
    rows = sorted((r.lang, r.doc_id, r.at, bytes(r.part or b"")) for r in parts.collect())
    return [(r[0], r[3]) for r in rows]


def fit(docs: DataFrame, learn: Column) -> ByteNet | None:
    """A network learned from the rows for which ``learn`` holds; None if none has a label."""
    rows = training_sample(docs, learn)
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    x = np.concatenate([windows_of(r[1])[:1] for r in rows])
    return train(x, np.array([labels.index(r[0]) for r in rows]), labels)


def predict_languages(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1): the mean of the windows' log-probabilities, as a softmax.

    Every window of every text counts. Null texts and texts without a letter, and all texts if there is no network, are
    ``und`` with score 0; an empty table stays empty. The two new columns replace columns of the same name.
    """
    docs = docs.drop("lang_pred", "score")
    model, held = net, 32  # some 20 kB; travels with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = model.scorer() if model else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            said, scores = ["und"] * len(texts), [0.0] * len(texts)
            who = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            sums = np.zeros((len(texts), len(model.labels) if model else 0))
            queue: list[np.ndarray] = []
            owner: list[np.ndarray] = []

            def flush():
                x, o = np.concatenate(queue), np.concatenate(owner)
                for at in range(0, len(x), held):
                    z = logits(x[at : at + held])
                    z = z - z.max(axis=1, keepdims=True)
                    z = np.maximum(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), -6)
                    np.add.at(sums, o[at : at + held], z)
                queue.clear()
                owner.clear()

            waiting = 0
            for k in who:
                w = windows_of(texts[k].encode("utf-8", "surrogatepass"))
                queue.append(w)
                owner.append(np.full(len(w), k))
                waiting += len(w)
                if waiting >= 16 * held:
                    flush()
                    waiting = 0
            if queue:
                flush()
            for k in who:
                n = -(-len(texts[k].encode("utf-8", "surrogatepass")) // WINDOW)
                z = np.exp(sums[k] / n)
                best = int(z.argmax())
                said[k], scores[k] = model.labels[best], float(z[best] / z.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """``predict_languages`` with a network learned from the rows of ``docs`` for which ``learn`` holds."""
    return predict_languages(docs, fit(docs, learn))
