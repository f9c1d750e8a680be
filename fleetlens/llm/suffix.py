"""Exact removal of repeated byte strings with longest-previous-factor arrays over a distributed suffix set.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Whole suffix arrays of a corpus do not fit one machine, so equal suffixes are brought together by *anchors*: the
smallest hash of the ``GRAM``-byte strings of a window. Equal windows have equal anchors at equal places, so windows that
could match always meet in one bucket. Three rounds exchange packed arrays, never a row per byte:

1. every batch of documents sends each distinct (anchor, context) once, with its smallest doc_id. A context is the text
   of the neighbouring windows of one anchor; a bucket answers which contexts an earlier document has as a whole, and
   which anchors stand in several different contexts;
2. only those contexts are sent as text, by the batch with their smallest doc_id. A bucket sorts their suffixes; previous
   and next smaller documents in suffix order, as far as the common prefix stays long enough, are the previous factors;
3. the batches mark the windows answered, and cut the covered bytes.

A context is sent at most once per batch however often it occurs, so copies, and contexts inside of a passage, meet as one
entry per batch. Contexts that straddle the ends of a passage differ in every document although they share its anchor: an
anchor with ``HOT`` contexts or more in a batch is sent as one mark without them, and if there is a mark, or more than
``HOT_ALL`` contexts, all batches send the anchor's windows in round 2 instead of its contexts, each once per batch with its
smallest doc_id, to the bucket of the *window's* hash. So a bucket gets at most ``HOT`` entries of an anchor, and one of a
window, from a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import free, parts_for

LENGTH = 50
GRAM = 28
#: Text bytes of a batch, and the text bytes whose anchors one bucket gets.
BATCH_BYTES = 4 << 20
#: Contexts of one anchor in a batch, and in all, from which on its windows are dealt out one by one.
HOT, HOT_ALL = 8, 4096
_MARK = np.uint64(1 << 48)
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and of its inverse, modulo 2^64."""
    values = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse)]
    return values, powers[0], powers[1]


def contexts(buf: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and text hash of every context of ``buf``.

    ``valid[s]`` says that the window at ``s`` lies in one document. Consecutive windows with one anchor are one context.
    """
    width, out = length - gram + 1, []
    values, powers, inverse = _tables(min(len(buf), _CHUNK + length) + 1)
    low = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(buf) - length + 1), _CHUNK):
        part = buf[at : at + _CHUNK + length - 1]
        ok = valid[at : at + len(part) - length + 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * powers[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        least, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        place = (least & low).astype(np.int64)
        new = ok.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
        stop = ok.copy()
        stop[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        count = last - first + 1
        text = _mix((sums[last + length] - sums[first]) * inverse[first] + count.astype(np.uint64))
        out.append((first + at, count, grams[place[first]], text))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, equal places of its items together."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T if len(raw) else raw.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


class _Batch:
    """The documents of a batch as one buffer, with its contexts and distinct (bucket, anchor, context) entries."""

    def __init__(self, table: pa.Table, n_buckets: int, length: int, gram: int):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        ids = [_LAST if i is None else i for i in table.column("doc_id").to_pylist()]
        # a fixed order, so that every round sees the same buffer however the shuffle delivered the rows
        order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
        self.table, texts = table.take(order), [texts[k] for k in order]
        self.ids = np.array(ids, np.int64)[order]
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        edge = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(edge, np.maximum(self.starts, self.ends - length + 1), 1)
        np.add.at(edge, self.ends, -1)
        self.first, self.count, anchor, text = contexts(self.buf, np.cumsum(edge[:-1]) == 0, length, gram)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")]
        bucket, anchor, text = (anchor % np.uint64(n_buckets)).astype(np.int64), anchor >> np.uint64(16), text >> np.uint64(16)
        order = np.lexsort((self.doc, text, anchor, bucket))
        new = np.ones(len(order), bool)
        for i, x in enumerate((bucket, anchor, text)):
            change = x[order][1:] != x[order][:-1]
            new[1:] = change if i == 0 else new[1:] | change
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.head = order[new]  # of every entry, a context in its smallest document
        self.bucket, self.anchor, self.text = bucket[self.head], anchor[self.head], text[self.head]
        self.n, self.length = n_buckets, length
        self.cuts = np.searchsorted(self.bucket, np.arange(n_buckets + 1))
        # the first entry of a hot anchor is sent as a mark for all of them
        first = np.ones(len(self.head), bool)
        first[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        group = np.cumsum(first) - 1
        hot = np.bincount(group)[group] >= HOT if len(group) else first
        self.sent = np.flatnonzero(first | ~hot)
        self.answered = np.cumsum(first | ~hot) - 1
        self.sent_text = np.where(hot, _MARK, self.text)[self.sent]
        self.sent_cuts = np.searchsorted(self.bucket[self.sent], np.arange(n_buckets + 1))

    def per_bucket(self, values: np.ndarray):
        for b in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield b, values[self.cuts[b] : self.cuts[b + 1]]

    def spread(self, answers: dict[int, bytes], kind) -> np.ndarray:
        """The answers of the buckets, in the order of the entries; zero where there is none."""
        out = np.zeros(len(self.sent), kind)
        for b, data in answers.items():
            out[self.sent_cuts[b] : self.sent_cuts[b + 1]] = _unpack(data, kind)
        return out[self.answered]

    def hot_windows(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash and smallest document of the distinct windows of code 3, dealt to buckets by hash; the buckets' cuts; and
        the place in these, the entry and the bit of every such window."""
        entry = np.flatnonzero(code == 3)
        count = self.count[self.head[entry]]
        bit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(entry, count)
        start, doc = self.first[self.head[entry]] + bit, self.doc[self.head[entry]]
        values, powers, _ = _tables(self.length)
        hashes = np.empty(len(start), np.uint64)
        for at in range(0, len(start), 1 << 15):
            part = self.buf[start[at : at + (1 << 15), None] + np.arange(self.length)]
            hashes[at : at + len(part)] = _mix((values[part] * powers[: self.length]).sum(axis=1, dtype=np.uint64))
        bucket = (hashes % np.uint64(self.n)).astype(np.int64)
        order = np.lexsort((doc, hashes, bucket))
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        head = order[new]
        return hashes[head], doc[head], np.searchsorted(bucket[head], np.arange(self.n + 1)), place, entry, bit


def _answer_contexts(table: pa.Table) -> pa.Table:
    """Per entry: 1 if an earlier document has the whole context; 2 if it is the first of its text and must be compared; 3 if
    its anchor is hot and its windows are compared one by one."""
    parts = list(zip(*(table.column(c).to_pylist() for c in ("batch", "anchors", "texts", "docs"))))
    anchors = [np.cumsum(_unpack(p[1], np.uint64)) for p in parts]
    anchor, text, doc = np.concatenate(anchors), np.concatenate([_unpack(p[2], np.uint64) for p in parts]), np.concatenate([_unpack(p[3], np.int64) for p in parts])
    order = np.lexsort((doc, text, anchor))
    a, t, d = anchor[order], text[order], doc[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_t = new_a | np.concatenate([[True], t[1:] != t[:-1]])
    least = d[new_t][np.cumsum(new_t) - 1]
    group = np.cumsum(new_a) - 1
    different = np.bincount(group, new_t)[group]
    hot = (np.bincount(group, t == _MARK)[group] > 0) | (different > HOT_ALL)
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(hot, 3, np.where(d > least, 1, np.where(different > 1, 2, 0)))
    cut = np.concatenate([[0], np.cumsum([len(x) for x in anchors])])
    b = table.column("bucket")[0].as_py()
    rows = [(p[0], b, _pack(code[s:e])) for p, s, e in zip(parts, cut, cut[1:]) if code[s:e].any()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.binary()))], names=["batch", "bucket", "codes"])


def previous_factors(suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each ``length``-byte suffix has a previous factor as long as itself: the same bytes in a smaller document.

    Suffixes are sorted; a run has common prefixes of full length. Inside a run the smallest document before a place
    (previous smaller value) or after it (next smaller value) in suffix order is the longest previous factor.
    """
    order = np.lexsort((doc, suffix))
    s, d = suffix[order], doc[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    run = np.cumsum(new) - 1
    rank = np.unique(d, return_inverse=True)[1].astype(np.int64)
    span = np.int64(len(d) + 1)
    before = np.minimum.accumulate(rank - run * span) + run * span  # later runs lie lower, so none looks back
    after = np.minimum.accumulate((rank + run * span)[::-1])[::-1] - run * span
    out = np.empty(len(d), bool)
    out[order] = (before < rank) | (after < rank)
    return out


def _answer_texts(table: pa.Table, length: int) -> pa.Table:
    """Per context sent: a bit for every window that an earlier document has; and the same per window of hot anchors."""
    b = table.column("bucket")[0].as_py()
    parts = list(zip(*(table.column(c).to_pylist() for c in ("batch", "lens", "raw", "docs", "windows", "window_docs"))))
    rows = _context_masks([p for p in parts if p[1] is not None], length) + _window_bits([p for p in parts if p[4] is not None])
    rows = [(batch, b, *x) for batch, *x in rows]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["batch", "bucket", "masks", "bits"])


def _window_bits(parts: list[tuple]) -> list[tuple]:
    if not parts:
        return []
    hashes = [_unpack(p[4], np.uint64) for p in parts]
    every, doc = np.concatenate(hashes), np.concatenate([_unpack(p[5], np.int64) for p in parts])
    order = np.lexsort((doc, every))
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    found = np.empty(len(order), np.uint8)
    found[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in hashes])])
    return [(p[0], None, _pack(found[s:e])) for p, s, e in zip(parts, cut, cut[1:])]


def _context_masks(parts: list[tuple], length: int) -> list[tuple]:
    if not parts:
        return []
    lens = [_unpack(p[1], np.uint16).astype(np.int64) for p in parts]
    raw = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(p[2]) for p in parts), np.uint8)
    every, doc = np.concatenate(lens), np.concatenate([_unpack(p[3], np.int64) for p in parts])
    windows = every - length + 1
    owner = np.repeat(np.arange(len(every)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (np.cumsum(every) - every)[owner] + nth
    suffix = np.lib.stride_tricks.sliding_window_view(raw, length)[start]
    found = previous_factors(_suffix_ranks(suffix), doc[owner])
    mask = np.bincount(owner, np.where(found, 2.0**nth, 0.0), len(every)).astype(np.uint64)
    cut = np.concatenate([[0], np.cumsum([len(x) for x in lens])])
    return [(p[0], _pack(mask[s:e]), None) for p, s, e in zip(parts, cut, cut[1:])]


def _suffix_ranks(suffix: np.ndarray) -> np.ndarray:
    """The rank of every row of bytes in their lexicographic order; equal rows share a rank."""
    pad = -suffix.shape[1] % 8
    wide = np.pad(suffix, ((0, 0), (0, pad))) if pad else suffix
    keys = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    new = np.concatenate([[True], np.any(keys[order][1:] != keys[order][:-1], axis=1)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and n_bytes, n_removed, n_spans, kept_sha256 of its UTF-8 bytes.

    Null texts count as empty (and stay null); null ids come after every id; rows of one id do not remove each other.
    Bytes of a character that was cut in part are left out of ``text``, while kept_sha256 is over all bytes kept.
    The new columns replace columns of the same name. Any table size, also none; texts of any length
    (a text longer than ``batch_bytes`` is a batch of its own size).
    """
    if not 1 < gram < length <= gram + 62:
        raise ValueError("the anchor must be shorter than the string, by 62 at most")
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*new)
    (batch,) = free(docs, "_batch")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    n = parts_for(total, batch_bytes)
    kept = docs.schema
    extra = [F.col(f"`{c}`") for c in docs.columns]
    batched = docs.select(*extra, F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.octet_length("text")), F.lit(n)).alias(batch)).repartition(max(n, 1), batch)
    by_batch = batched.groupBy(batch)

    def send_contexts(table: pa.Table) -> pa.Table:
        b, rows = _Batch(table, n, length, gram), []
        own = table.column(batch)[0].as_py()
        anchors, docs_of = b.anchor[b.sent], b.doc[b.head[b.sent]]
        for bucket in np.flatnonzero(np.diff(b.sent_cuts)).tolist():
            cut = slice(b.sent_cuts[bucket], b.sent_cuts[bucket + 1])
            rows.append((own, bucket, _pack(np.diff(anchors[cut], prepend=np.uint64(0))), _pack(b.sent_text[cut]), _pack(docs_of[cut])))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 5, kinds)], names=["batch", "bucket", "anchors", "texts", "docs"])

    codes = by_batch.applyInArrow(send_contexts, "batch long, bucket long, anchors binary, texts binary, docs binary").groupBy("bucket").applyInArrow(_answer_contexts, "batch long, bucket long, codes binary")

    def answers(table: pa.Table, name: str) -> dict[int, bytes]:
        return {b: v for b, v in zip(table.column("bucket").to_pylist(), table.column(name).to_pylist()) if v is not None}

    def send_texts(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows, kinds = [], (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        if table.num_rows and replies.num_rows:
            b = _Batch(table, n, length, gram)
            code = b.spread(answers(replies, "codes"), np.uint8)
            for bucket, c in b.per_bucket(code):
                head = b.head[b.cuts[bucket] : b.cuts[bucket + 1]][c == 2]
                if len(head):
                    lens = b.count[head] + length - 1
                    raw = b"".join(b.buf[s : s + m].tobytes() for s, m in zip(b.first[head].tolist(), lens.tolist()))
                    rows.append((table.column(batch)[0].as_py(), bucket, _pack(lens.astype(np.uint16)), zstandard.ZstdCompressor(level=1).compress(raw), _pack(b.doc[head]), None, None))
            hashes, least, cuts, *_ = b.hot_windows(code)
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[bucket], cuts[bucket + 1])
                rows.append((table.column(batch)[0].as_py(), bucket, None, None, None, _pack(hashes[part]), _pack(least[part])))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 7, kinds)], names=["batch", "bucket", "lens", "raw", "docs", "windows", "window_docs"])

    sent = by_batch.cogroup(codes.groupBy("batch")).applyInArrow(send_texts, "batch long, bucket long, lens binary, raw binary, docs binary, windows binary, window_docs binary")
    masks = sent.groupBy("bucket").applyInArrow(lambda t: _answer_texts(t, length), "batch long, bucket long, masks binary, bits binary")
    replies = codes.unionByName(masks, allowMissingColumns=True)

    def cut(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        b = _Batch(table, n, length, gram)
        table = b.table
        code = b.spread(answers(said, "codes"), np.uint8)
        mask, sent_mask = np.zeros(len(b.head), np.uint64), answers(said, "masks")
        for bucket, c in b.per_bucket(code):
            if bucket in sent_mask:
                mask[b.cuts[bucket] + np.flatnonzero(c == 2)] = _unpack(sent_mask[bucket], np.uint64)
        hashes, least, cuts, place, entry, bit = b.hot_windows(code)
        if len(hashes):
            found = np.zeros(len(hashes), bool)
            for bucket, data in answers(said, "bits").items():
                found[cuts[bucket] : cuts[bucket + 1]] = _unpack(data, np.uint8) > 0
            had = found[place] | (least[place] < b.doc[b.head[entry]])
            np.bitwise_or.at(mask, entry[had], np.uint64(1) << bit[had].astype(np.uint64))
        whole = (code[b.entry] == 1) | (b.doc > b.doc[b.head][b.entry])
        edge = np.zeros(len(b.buf) + 1, np.int32)
        np.add.at(edge, b.first[whole], 1)
        np.add.at(edge, (b.first + b.count - 1 + length)[whole], -1)
        some = np.flatnonzero(~whole & (mask[b.entry] > 0))
        for bit in range(length - gram + 1):
            at = b.first[some[(mask[b.entry[some]] >> np.uint64(bit)) & np.uint64(1) > 0]] + bit
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        texts, sizes, removed, spans, shas = [], [], [], [], []
        for old, s, e in zip(table.column("text").to_pylist(), b.starts.tolist(), b.ends.tolist()):
            g, raw = gone[s:e], b.buf[s:e]
            lost = int(g.sum())
            left = raw[~g].tobytes() if lost else raw.tobytes()
            sizes.append(e - s)
            removed.append(lost)
            spans.append(int(g[:1].sum() + (np.diff(g.view(np.int8)) == 1).sum()) if lost else 0)
            shas.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode("utf-8", "ignore") if lost else old)
        cols = {c: table.column(c) for c in table.column_names if c != batch}
        cols |= {"text": pa.array(texts, pa.string()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table({f.name: cols[f.name].cast(out_schema.field(f.name).type) if f.name in new + ["text"] else cols[f.name] for f in out_schema})

    result = T.StructType([*kept.fields, *(T.StructField(c, T.StringType() if c == "kept_sha256" else T.LongType()) for c in new)])
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(result)
    return by_batch.cogroup(replies.groupBy("batch")).applyInArrow(cut, result)
