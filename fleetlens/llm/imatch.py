"""I-Match fingerprints with randomised lexicon subsets, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE_CLASS, shared_folder, stored

#: Subsets of the lexicon, and terms that a text has in all of them together at most before the next thinner lexicon.
SUBSETS = 48
MOST_TERMS = 48
#: The band: terms of a share of all documents above this are too common (inverse document frequency below -ln).
COMMON_SHARE = 0.02
#: The common terms number at most (distinct terms per document) / COMMON_SHARE; up to this many they are broadcast.
BROADCAST_TERMS = 500_000
#: Rows of one range of the ring of documents.
ROWS_PER_RANGE = 20_000


def terms(text: Column) -> Column:
    """The distinct terms of a text as hashes: lower-cased words (null: none)."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS), lambda w: w != "")
    return F.array_distinct(F.transform(split, lambda w: F.xxhash64(w)))


def level_of(n_terms: Column) -> Column:
    """How often the lexicon is halved so that about 24 to 48 terms of a text stay."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n_terms / MOST_TERMS))).cast("int")


def _in_level(term: Column, level: Column) -> Column:
    return term.bitwiseAND(F.expr("1L") * F.pow(F.lit(2.0), level).cast("long") - 1) == 0


def common_terms(docs: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """(term): the terms of more than ``share`` of all documents, of two at least; counted over all, combined before the shuffle."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") > share * n) & (F.col("n") > 1)).select("term")


def _subset_hashes(kept: Column) -> Column:
    """One hash per lexicon subset, of the text's terms in it in sorted order; 0 if there is none."""
    def one(k: Column) -> Column:
        own = F.filter(kept, lambda t: F.pmod(F.shiftrightunsigned(t, 40), F.lit(SUBSETS)) == k)
        return F.when(F.size(own) == 0, F.lit(0)).otherwise(F.hash(own))

    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)


def fingerprint_arrays(texts: DataFrame, keys: list[str], names: list[str], common: DataFrame) -> DataFrame:
    """``keys`` and for each text column of ``names`` a struct of level, fine and coarse subset hashes.

    The lexicon is thinned by halves until a text has a handful of its terms; two neighbouring thicknesses are kept so that
    texts of somewhat different length can be compared. A text with no term in the band uses its common ones.
    """
    rows = texts
    for name in names:
        rows = rows.withColumn(f"_t_{name}", terms(F.col(name))).withColumn(f"_l_{name}", level_of(F.size(f"_t_{name}")))

    def tagged(k: int, name: str) -> Column:
        kept = F.filter(f"_t_{name}", lambda t: _in_level(t, F.col(f"_l_{name}")))
        return F.transform(kept, lambda t: F.struct(F.lit(k).alias("k"), t.alias("term")))

    def thinner(kept: Column, name: str) -> Column:
        return F.filter(kept, lambda t: _in_level(t, F.col(f"_l_{name}") + 1))

    parts = [tagged(k, name) for k, name in enumerate(names)]
    levels = [f"_l_{name}" for name in names]
    exploded = rows.select(*keys, *levels, F.explode_outer(F.concat(*parts)).alias("x")).select(*keys, *levels, "x.k", "x.term")
    n_common = common.count()
    marked = common.withColumn("_common", F.lit(True))
    exploded = exploded.join(F.broadcast(marked) if n_common <= BROADCAST_TERMS else marked, "term", "left")
    sets = []
    for k in range(len(names)):
        sets += [F.collect_list(F.when((F.col("k") == k) & F.col("_common").isNull(), F.col("term"))).alias(f"_rare{k}"), F.collect_list(F.when(F.col("k") == k, F.col("term"))).alias(f"_all{k}")]
    grouped = exploded.groupBy(*keys, *levels).agg(*sets)
    out = []
    for k, name in enumerate(names):
        kept = F.sort_array(F.when(F.size(f"_rare{k}") > 0, F.col(f"_rare{k}")).otherwise(F.col(f"_all{k}")))
        out.append(F.struct(F.col(f"_l_{name}").alias("level"), _subset_hashes(kept).alias("fine"), _subset_hashes(thinner(kept, name)).alias("coarse")).alias(f"fp_{name}"))
    return grouped.select(*keys, *out)


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets used by either text whose hashes agree, at a thickness both have; 0 if there is none."""
    def share(x: Column, y: Column) -> Column:
        used = F.size(F.filter(F.zip_with(x, y, lambda u, v: (u != 0) | (v != 0)), lambda z: z))
        same = F.size(F.filter(F.zip_with(x, y, lambda u, v: (u == v) & (u != 0)), lambda z: z))
        return F.when(used == 0, F.lit(1.0)).otherwise(same / used)

    return (
        F.when(a["level"] == b["level"], share(a["fine"], b["fine"]))
        .when(a["level"] + 1 == b["level"], share(a["coarse"], b["fine"]))
        .when(a["level"] == b["level"] + 1, share(a["fine"], b["coarse"]))
        .otherwise(F.lit(0.0))
    )


def as_text(fp: Column) -> Column:
    """A fingerprint as a string: its level and hexadecimal subset hashes."""
    numbers = F.transform(F.concat(fp["fine"], fp["coarse"]), lambda h: F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.concat(fp["level"].cast("string"), F.lit(":"), F.array_join(numbers, "."))


def next_rows(rows: DataFrame, folder: str) -> DataFrame:
    """For distinct (h, g) with doc_id: all columns with next_h and next_g, in descending order of doc_id, the last one's next being the first.

    Nulls come last, ties by (h, g). The rows are range-sorted by all three, so many rows of one id or of none are split too;
    only the first row of every range is looked at to join their ends, so no task orders the whole table.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("g")]
    pieces = max(1, rows.count() // ROWS_PER_RANGE)
    ranged = stored(rows.repartitionByRange(pieces, *order).withColumn("_range", F.spark_partition_id()), f"{folder}/ranges")
    inside = Window.partitionBy("_range").orderBy(*order)
    led = ranged.select("*", F.lead(F.struct("h", "g")).over(inside).alias("_next"), F.row_number().over(inside).alias("_n"))
    heads = led.filter("_n = 1").select("_range", F.struct("h", "g").alias("head"))
    ring = Window.orderBy("_range")  # one row per range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_range", F.coalesce(F.lead("head").over(ring), F.first("head").over(whole)).alias("_after"))
    linked = led.join(heads, "_range").withColumn("_next", F.coalesce("_next", "_after"))
    return linked.select(*rows.columns, F.col("_next.h").alias("next_h"), F.col("_next.g").alias("next_g"))


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h, g) of every row: null texts empty, and 128 bits of hash of id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h"), F.xxhash64(F.lit("g"), text, "doc_id").alias("g"))


def _need(text: str) -> Column:
    return F.floor(F.length(text) / 3).cast("int")


def edited_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, g, last, times, doc_id, text, n_chars, edited): the distinct rows of ``docs`` with their edited texts.

    ``asked`` names for each next row (h, g) the row (for_h, for_g) that takes its start. Id and text are combined as one value:
    the rows that give a start and those that take one then read the same shuffle, as no column of either can be pruned.
    """
    keyed = _hashed(docs).groupBy("h", "g").agg(F.first(F.struct("doc_id", "text")).alias("x")).select("h", "g", "x.doc_id", "x.text")
    starts = keyed.join(asked, ["h", "g"]).select(F.col("for_h").alias("h"), F.col("for_g").alias("g"), "last", "times", F.substring("text", F.lit(1), F.col("need")).alias("start"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - _need("text")), F.col("start")).alias("edited")
    return keyed.join(starts, ["h", "g"]).select("h", "g", "last", "times", "doc_id", "text", n.cast("long").alias("n_chars"), edited)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last third replaced by the start of the next document's text (descending doc_id, from the last to
    the first). Null texts are empty; null ids come last; rows of equal id stand in the order of a hash. Equal rows follow
    one another: they are combined before the shuffle and go through as two rows, the last of them, whose next is another
    document, and the others, whose next is an equal row, with their number; they are dealt out again at the end. Rows are
    spread by 128 bits of hash of id and text, so neither copies nor hot sources meet in one task. Only doc_id and text are
    read, so other columns clash with nothing. Empty input: empty result.
    """
    folder = shared_folder(docs.sparkSession)
    # the order needs no texts, so none are shuffled for it
    keys = _hashed(docs).select("h", "g", "doc_id", _need("text").alias("need"))
    keys = keys.groupBy("h", "g").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("need").alias("need"))
    ring = next_rows(stored(keys, f"{folder}/keys"), folder)
    itself = F.struct(F.col("h").alias("next_h"), F.col("g").alias("next_g"), (F.col("rows") - 1).alias("times"), F.lit(False).alias("last"))
    other = F.struct("next_h", "next_g", F.lit(1).cast("long").alias("times"), F.lit(True).alias("last"))
    ring = ring.select("h", "g", "need", F.explode(F.filter(F.array(other, itself), lambda x: x["times"] > 0)).alias("x")).select("h", "g", "need", "x.*")
    ring = stored(ring, f"{folder}/ring")
    asked = ring.select(F.col("next_h").alias("h"), F.col("next_g").alias("g"), F.col("h").alias("for_h"), F.col("g").alias("for_g"), "need", "times", "last")
    back = [F.col("for_h").alias("h"), F.col("for_g").alias("g"), "last"]
    pairs = edited_texts(docs, asked).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["h", "g", "last", "times", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprint_arrays(pairs, keys, ["text", "edited"], stored(common_terms(docs), f"{folder}/common"))
    prints = stored(prints, f"{folder}/prints")
    after = prints.filter("last").select("h", "g", F.col("fp_text").alias("fp_next")).join(asked.drop("need", "times"), ["h", "g"]).select(*back, "fp_next")
    both = prints.join(after, ["h", "g", "last"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / ROWS_PER_RANGE))))
    both = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(ROWS_PER_RANGE), F.col("times") - F.col("_part") * ROWS_PER_RANGE))))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp_text")).alias("fingerprint"), as_text(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"),
    )
