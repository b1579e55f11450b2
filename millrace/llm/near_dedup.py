"""MinHash near-duplicate detection by a signature-coordinate inverted join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, integer_id, matching, table
from .textbytes import alnum, as_bytes, mix64, runs, slices, span_hashes

COORDINATES = 96
THRESHOLD = 0.6
SHINGLE = 3
SEED = 41


def signatures(
    docs: DataFrame,
    coordinates: int = COORDINATES,
    shingle: int = SHINGLE,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, sig)``: for each coordinate the least of a random hash over the text's word shingles.

    Words are runs of letters and digits, lower case. A text of fewer words than ``shingle`` is one shingle; a text
    without words, a null text and a null id have no row.
    """
    rng = np.random.default_rng(seed)
    times = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def sign(batches):
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            raw, at = as_bytes(pc.utf8_lower(pc.fill_null(batch.column(1), "")))
            starts, ends, doc = runs(alnum(raw), at)
            words = span_hashes(raw, starts, ends)
            first = np.searchsorted(doc, np.arange(len(ids)))
            count = np.diff(np.append(first, len(doc)))
            # The shingle that starts at each word; a later word beyond the end of its text adds nothing.
            shingles = words.copy()
            for k in range(1, shingle):
                following = np.zeros_like(words)
                if k < len(words):
                    following[:-k] = np.where(doc[k:] == doc[:-k], words[k:], np.uint64(0))
                shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + following
            place = np.arange(len(doc)) - first[doc]
            whole = (place + shingle <= count[doc]) | (place == 0)
            shingles = mix64(shingles[whole])
            owner = doc[whole]
            have = np.flatnonzero(count)
            if not len(have):
                continue
            edges = np.searchsorted(owner, have)
            sig = np.empty((len(have), coordinates), np.int32)
            for j in range(coordinates):
                least = np.minimum.reduceat((shingles * times[j] + plus[j]) >> np.uint64(32), edges)
                sig[:, j] = least.astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(have) + 1, dtype=np.int32) * coordinates), pa.array(sig.ravel())
            )
            yield pa.record_batch([pa.array(ids[have]), lists], ["doc_id", "sig"])

    narrow = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(sign, "doc_id long, sig array<int>")


def needed(coordinates: int, threshold: float) -> int:
    """The least number of equal coordinates whose share, as a floating number, reaches the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be above 0 and at most 1, not {threshold}")
    return next(m for m in range(coordinates + 1) if m / coordinates >= threshold)


def signature_classes(sigs: DataFrame) -> DataFrame:
    """``(doc_id, key, rep, n, sig)``: each ``(doc_id, sig)`` once, in the class of its signature.

    ``key`` is of the class alone (an id may be in several), ``rep`` its smallest id and ``n`` its number of ids. Only
    the row of ``rep`` carries the signature on.
    """
    whole = Window.partitionBy("sig")
    least = whole.orderBy("doc_id", "key")
    ranked = sigs.withColumn("key", F.monotonically_increasing_id()).select(
        "doc_id",
        "sig",
        F.first("key").over(least).alias("key"),
        F.first("doc_id").over(least).alias("rep"),
        F.row_number().over(least).alias("nth"),
        (~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(least))).alias("new"),
    )
    ranked = ranked.withColumn("n", F.sum(F.col("new").cast("long")).over(whole)).filter("new")
    return cut(ranked.select("doc_id", "key", "rep", "n", F.when(F.col("nth") == 1, F.col("sig")).alias("sig")))


def similar_signatures(sigs: DataFrame, coordinates: int, threshold: float) -> DataFrame:
    """``(doc_a, doc_b, matches)``: the pairs of signatures that agree in at least ``threshold`` of the coordinates.

    Equal signatures are one class: its smallest id stands for it, and each other member is paired with that id alone.
    The other pairs follow from these, but for those of two classes with one smallest id, which only an id with several
    signatures makes: their members are linked through that id. ``near_duplicate_classes`` counts every link.
    """
    ranked = signature_classes(sigs)
    equal = ranked.filter("doc_id <> rep").select(
        F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(coordinates).alias("matches")
    )
    near = similar_classes(ranked.withColumn("key", F.col("rep")), coordinates, threshold)
    return near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "matches").unionByName(equal)


def similar_classes(classes: DataFrame, coordinates: int, threshold: float) -> DataFrame:
    """``(a, b, n_a, n_b, matches)``: the pairs of keys of ``signature_classes`` that agree in ``threshold`` of the coordinates.

    Exact for any input. Each signature is a set of ``coordinates`` items (coordinate, value), so two of them that
    share ``need`` items share one among the first ``coordinates - need + 1`` of each, in any common order of items.
    The order is from rare to frequent: values of one document alone come first and need no posting, so a document is
    posted only under what is left of its prefix, and a value that thousands share is posted by those documents only
    whose every rarer value is used up. Collisions within the prefixes are counted with the last colliding places;
    pairs that could not reach ``need`` even if all that follows agreed are skipped before signatures are compared.
    """
    need = needed(coordinates, threshold)
    prefix = coordinates - need + 1
    reps = classes.filter("sig IS NOT NULL").select(F.col("key").alias("id"), "sig", "n")

    items = reps.select("id", F.posexplode("sig").alias("place", "value")).select(
        "id", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("item")
    )
    shared = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    per_doc = (
        items.join(shared.hint("shuffle_hash"), "item")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items"))
        .withColumn("alone", F.lit(coordinates) - F.size("items"))
        .filter(F.col("alone") < prefix)
    )
    postings = per_doc.select(
        "id", "alone", F.posexplode(F.slice("items", F.lit(1), F.lit(prefix) - F.col("alone"))).alias("nth", "posted")
    ).select("id", F.col("posted.item").alias("item"), (F.col("alone") + F.col("nth")).alias("place"))
    postings = cut(postings)

    a, b = postings.alias("a"), postings.alias("b")
    collisions = (
        a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.id") < F.col("b.id")))
        .groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("a.place").alias("last_a"), F.max("b.place").alias("last_b"))
    )
    hopeful = collisions.filter(F.col("n") + F.lit(coordinates - 1) - F.greatest("last_a", "last_b") >= F.lit(need))
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    agree = F.aggregate(
        F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x
    )
    return (
        hopeful.select("a", "b")
        .join(left, "a")
        .join(right, "b")
        .select("a", "b", "n_a", "n_b", agree.alias("matches"))
        .filter(F.col("matches") >= need)
    )


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    coordinates: int = COORDINATES,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_a, doc_b, matches, similarity)``, ``doc_a < doc_b``: near duplicates of the whole table.

    ``similarity`` is the share of equal MinHash coordinates, an estimate of the Jaccard similarity of the texts' word
    shingles. Defined cases: null ids, null texts and texts without words are in no pair; texts of any length are read
    whole; documents with equal signatures (copies above all) are paired with the smallest id of their class only, from
    which the other pairs follow (see ``similar_signatures``); a share at the threshold is a pair, and a threshold that
    is not above 0 and at most 1 is a ValueError; rows that repeat an id and text count once, and of rows that repeat an
    id with other texts each may make a pair, but never with itself;
    an id that is no integer is a ValueError; an empty table has no pairs; other columns are not read, whatever their
    names.
    """
    sigs = signatures(docs, coordinates, shingle, id_col=id_col, text_col=text_col)
    pairs = similar_signatures(sigs, coordinates, threshold).distinct()
    return pairs.filter("doc_a < doc_b").select(
        "doc_a", "doc_b", "matches", (F.col("matches") / F.lit(float(coordinates))).alias("similarity")
    )


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` for every node but the smallest of each connected component, which is its root.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each round is cut in the shared folder.
    """
    edges = cut(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicate_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    coordinates: int = COORDINATES,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, class_id, links)``: every document, the smallest id it is connected with, and its number of near duplicates.

    ``links`` counts all other documents whose share of equal MinHash coordinates is ``threshold`` or more, copies too,
    without a row for each: those of equal signature, and the members of each class of equal signatures that is similar.
    ``class_id`` is of the connected component of these links.

    Defined cases: a null id has no row and is in no link; a null text and a text without words have no links and their
    own id as class; texts of any length are read whole; rows that repeat an id and a signature count once (equal texts
    have equal ones), and an id with several signatures has a row for each, as they are documents of their own; a share
    at the threshold is a link, and a threshold that is not above 0 and at most 1 is a ValueError; an id that is no
    integer is a ValueError; an empty table has no rows; other columns are not read, whatever their names.
    """
    members = signature_classes(signatures(docs, coordinates, shingle, id_col=id_col, text_col=text_col))
    pairs = cut(similar_classes(members, coordinates, threshold).drop("matches"))
    there = pairs.select(F.col("a").alias("key"), F.col("n_b").alias("far"))
    back = pairs.select(F.col("b").alias("key"), F.col("n_a").alias("far"))
    linked = there.unionByName(back).groupBy("key").agg(F.sum("far").alias("far"))
    groups = components(pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).withColumnRenamed("node", "key")
    classes = members.filter("sig IS NOT NULL").select("key", "rep", "n").join(linked, "key", "left").join(groups, "key", "left")
    classes = classes.select(
        "key", "rep", F.coalesce("root", "key").alias("root"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links")
    )
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = classes.join(least, "root").select("key", "class_id", "links")
    found = members.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "links")
    ids = docs.select(integer_id(docs, id_col).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    single = ids.join(members.select("doc_id"), "doc_id", "left_anti")
    return found.unionByName(single.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` (all columns) without those whose id is in a group of near duplicates and not its smallest.

    Groups are the connected components of ``near_duplicates``, with its defined cases. Rows that repeat an id stay or
    go together; rows in no pair (null ids and texts among them) stay; other columns, whatever their names, are carried
    along. The ids to remove are found without the texts, which stay where they are unless these are too many to be
    broadcast (``common.matching``).
    """
    (gone,) = fresh(docs, "gone")
    groups = components(near_duplicates(docs, id_col=id_col, text_col=text_col, **params))
    groups = groups.select(F.col("node").alias(gone))
    return matching(docs, groups, F.col(id_col) == F.col(gone), groups.count(), anti=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
