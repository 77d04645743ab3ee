"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. Under one order of all shingles, rare
first, two sets that are similar enough share a shingle among the first few of
each; among the first few plus l-1 they share l. Each document chooses l by the
cost it must expect: how often its prefix shingles occur, divided among the
matches that are then required before a pair is verified.

Documents with equal sets form one class, so copies never pair up. Candidate
pairs come from shared prefix shingles in two steps. First each class meets, of
the smallest classes in its shingles' lists, the one it shares most with, which
ties large groups together by linear work. Then lists that still span several
components give all their pairs across components. Every pair must pass a bound
on the symmetric difference by bit sketches and then an exact comparison of the
two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import SKETCH, meet_hubs, pairs_across, sketches_close, spanning_entries
from .components import components
from .storage import stage
from .textnum import LOWER, U, frugal, mix, ngrams, span_hashes, text_slices, words

WORDS, PERCENT = 4, 85
#: Shingle frequencies are counted in so many hashed places, which bounds the table that every task gets.
FREQUENCY_BITS = 18
#: Matches a prefix may require, and what verifying a candidate costs against reading an entry of a list.
MOST_MATCHES, VERIFY_COST = 4, 8.0
SKETCH_WORDS = 16
#: Bits of the filter that keeps documents without candidates out of the verification.
FILTER_BITS = 24


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, sorted within each document, and the place where each document's begin."""
    lower = LOWER[data]
    starts, ends, first = words(lower, off)
    n = np.diff(first)
    h = span_hashes(lower, starts, ends)
    _, grams = ngrams(h, first, k)
    begin = np.concatenate([[0], np.cumsum(np.where(n >= k, n - k + 1, n > 0))])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # a shorter document is one shingle
        g, full = np.empty(begin[-1], U), np.ones(begin[-1], bool)
        full[begin[short]] = False
        g[full] = grams
        for size in range(1, k):
            which = short[n[short] == size]
            whole = np.full(len(which), size, U)
            for j in range(size):
                whole = mix(whole * U(0x9FB21C651E98DF25) + h[first[which] + j])
            g[begin[which]] = whole
    else:
        g = grams
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        g[low:high].sort()
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    return g[new], np.concatenate([[0], np.cumsum(new)])[begin]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))


def _nodes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of each set, which stands for the class of documents that have it."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(g ^ U(0xA0761D6478BD642F)))])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U))


def _profiles(k: int):
    """(id, text) to id, set size, class digest and bit sketch; then, per task, how many sets hold a shingle of each hashed place."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(1 << FREQUENCY_BITS, np.int64), None
        names = ["id", "n_shingles", "node", "sketch", "place", "held"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for row, end, data, off in text_slices(batch.column(1)):
                g, first = shingle_sets(data, off, k)
                total += np.bincount((g >> U(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(total))
                m, n = end - row, np.diff(first)
                doc = np.repeat(np.arange(m), n)
                odd = np.bincount(doc * (64 * SKETCH_WORDS) + (g & U(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=m * 64 * SKETCH_WORDS) & 1
                sketch = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sketch), SKETCH_WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, m), _long(n), _long(_nodes(g, first)), lists, pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)
        full = np.flatnonzero(total)
        for at in range(0, len(full), 1 << 16):
            part = full[at : at + (1 << 16)]
            empty = [pa.nulls(len(part), t) for t in (kind, pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part.astype(np.int32)), pa.array(total[part])], names=names)

    return profile


def frequencies(profiles: DataFrame) -> np.ndarray:
    """How many documents' sets hold a shingle of each hashed place, over all documents; 2**FREQUENCY_BITS counts."""
    table = profiles.where(F.col("place").isNotNull()).groupBy("place").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    out[table.column("place").to_numpy()] = table.column("held").to_numpy()
    return out


def prefixes(g: np.ndarray, first: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles of every document, the document and the rank of each, and the matches each document requires."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    often = table[(g >> U(64 - FREQUENCY_BITS)).astype(np.int64)]
    rare = (often.astype(U) << U(40)) | (g >> U(24))
    order = np.concatenate([low + np.argsort(rare[low:high]) for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]) if len(n) else np.zeros(0, np.int64)
    g, often = g[order], often[order]
    background = table.sum() // max(len(table), 1)
    cost = np.concatenate([[0.0], np.cumsum(np.maximum(often - background, 1).astype(float))])
    least = -(-percent * n // 100)  # matches that any similar set must have
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, MOST_MATCHES + 1):
        reach = cost[first[:-1] + np.minimum(n, n - least + m)] - cost[first[:-1]]
        total = np.where(m <= np.maximum(least, 1), reach * (1 + VERIFY_COST / m), np.inf)
        better = total < best
        best, matches = np.where(better, total, best), np.where(better, m, matches)
    length = np.minimum(n, n - least + matches)
    rank = np.arange(len(g)) - np.repeat(first[:-1], n)
    keep = rank < np.repeat(length, n)
    return g[keep], doc[keep], rank[keep], matches


def _postings(k: int, percent: int, table: object):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, off in text_slices(batch.column(1)):
                g, first = shingle_sets(data, off, k)
                n, node = np.diff(first), _nodes(g, first)
                token, doc, rank, matches = prefixes(g, first, table.value, percent)
                yield pa.RecordBatch.from_arrays(
                    [_long(token), _long(node[doc]), pa.array(n[doc].astype(np.int32)), pa.array(matches[doc].astype(np.int8)), pa.array(rank.astype(np.int32))],
                    names=["token", "node", "size", "matches", "place"],
                )

    return post


def _similar(k: int, percent: int):
    """(a, b, text of a, text of b) to the pairs whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (2, 3):
                sets: list[np.ndarray] = []
                for _, _, data, off in text_slices(batch.column(column)):
                    g, first = shingle_sets(data, off, k)
                    sets += np.split(g, first[1:-1])
                sides.append(sets)
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64) - both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(100 * both >= percent * union))

    return compare


class _Join:
    """State of one join: the classes, their sketches, and how pairs of them are verified."""

    def __init__(self, documents: DataFrame, profiles: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> None:
        self.documents, self.profiles, self.id_col, self.text_col, self.k, self.percent = documents, profiles, id_col, text_col, k, percent
        self.sketches = profiles.where(F.col(id_col).isNotNull()).groupBy("node").agg(F.min(id_col).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches allow the similarity: the symmetric difference d of similar sets has (200-d%) bounds."""
        x = self.sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        y = self.sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        differ: Column = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
        sizes = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        return pairs.join(x, "a").join(y, "b").where(sizes & ((100 + self.percent) * differ <= (100 - self.percent) * (F.col("na") + F.col("nb")))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are similar. A bit filter of bounded size keeps most other documents' texts out of the shuffle."""
        pairs = stage(self.near(pairs))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.sketches.select("node", "rep"), "node")
        bit = F.pmod(F.xxhash64(F.col("rep")), F.lit(1 << FILTER_BITS))
        set_bits = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
        mask = np.zeros(1 << (FILTER_BITS - 6), U)
        mask[set_bits.column("place").to_numpy()] = set_bits.column("bits").to_numpy().view(U)
        sent, k = self.documents.sparkSession.sparkContext.broadcast(mask), self.k

        def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                left = batch.filter(pa.array(((sent.value[at >> 6] >> (at & 63).astype(U)) & U(1)).astype(bool)))
                for row, end, data, off in text_slices(left.column(1)):
                    yield pa.RecordBatch.from_arrays([_long(_nodes(*shingle_sets(data, off, k))), left.column(1).slice(row, end - row)], names=["node", "text"])

        rows = self.documents.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).alias("rep"), F.col(self.text_col).alias("text"))
        texts = rows.select(bit.alias("bit"), "text").mapInArrow(frugal(texts_of), "node bigint, text string")
        one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
        return stage(both.mapInArrow(frugal(_similar(self.k, self.percent)), "a bigint, b bigint").distinct())


def ngram_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are runs without ASCII white space after lower-casing A-Z; a set holds
    the distinct runs of ``k`` words, or of a shorter text its whole sequence.
    Documents link when 100 * intersection >= ``percent`` * union. Null or empty
    texts and texts without words have an empty set and link with nothing. Rows
    that repeat an id are each returned. A null id links nothing and has a null
    component. Other columns are ignored. Sets are compared as 64-bit hashes of
    their shingles.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(id_col, text_col)
    found = stage(rows.mapInArrow(frugal(_profiles(k)), f"id {kind}, n_shingles bigint, node bigint, sketch array<bigint>, place int, held bigint"))
    profiles = found.where(F.col("place").isNull()).select(F.col("id").alias(id_col), "n_shingles", "node", "sketch")
    join = _Join(documents, profiles, id_col, text_col, k, percent)
    table = spark.sparkContext.broadcast(frequencies(found))
    postings = rows.where(F.col(id_col).isNotNull()).mapInArrow(frugal(_postings(k, percent, table)), "token bigint, node bigint, size int, matches tinyint, place int")
    # Staged apart, so that the two shuffles of all postings don't lie on disk at once.
    shared = stage(postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token"))
    met = stage(postings.join(shared, "token"), shared)
    lists = stage(met.distinct(), met)
    links = join.verified(meet_hubs(lists))

    spanning = stage(spanning_entries(lists, components(links)))
    folded = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: F.aggregate(F.slice("sketch", i * (SKETCH_WORDS // SKETCH) + 1, SKETCH_WORDS // SKETCH), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)))
    pairs = pairs_across(spanning.join(join.sketches.select("node", folded.alias("sketch")), "node"), percent, "sketch", sketches_close(percent))
    links = links.union(join.verified(pairs))

    placed = join.sketches.select("node", "rep").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.join(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    own = F.when(F.col("n_shingles") == 0, F.col(id_col)).when(F.col(id_col).isNotNull(), F.col("component_id"))
    return profiles.join(named, "node", "left").select(id_col, "n_shingles", own.alias("component_id"))
