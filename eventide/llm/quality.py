"""Quality rules: counted text defects, and the divergence of a document's distributions from its language's.

Per document two histograms are taken, of character classes and of common words,
and compared with the sums over all documents of the same language by the
Jensen-Shannon distance. Documents below a minimum length are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stage
from .textnum import LEADS, LOWER, NOT_SPACE, U, counts_by, covered, frugal, mix, ngrams, owners, repeated, span_hashes, text_slices, words

# Languages with a reference of their own, and their common words.
LANGUAGES = ("de", "en", "es", "fr")
COMMON_WORDS = (
    "a al and are as at auf be by con das dans de dem den der des die du ein en est et for from has have in is it la las le les los "
    "mit nicht of on or par pas pour que qui se sich sur that the this to un una und une von was with y zu"
).split()
#: Character classes: lower case, upper case, digits, white space, symbols, other ASCII, outside ASCII.
CLASSES = 7
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Documents with fewer words are not judged by divergence; distances beyond these fail.
JUDGED_WORDS, MAX_CHARS, MAX_COMMON = 50, 0.25, 0.30

_CLASS = np.full(256, 5, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[~NOT_SPACE] = 3
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 7
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def _common() -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(COMMON_WORDS).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    h = span_hashes(data, starts, ends)
    order = np.argsort(h)
    return h[order], order


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    known, place = _common()
    starts, ends, first = words(data, off)
    owner = owners(first)
    leads = np.concatenate([[0], np.cumsum(LEADS[data])])
    chars = counts_by(owner, n, (leads[ends] - leads[starts]).astype(float))
    of_byte = np.repeat(np.arange(n), np.diff(off))
    classes = np.bincount(of_byte * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)[:, :CLASSES]

    h = span_hashes(data, starts, ends)
    at, g = ngrams(h, first, 5)
    twice, _ = repeated(mix(g ^ (owner[at].astype(U) * U(0x9E3779B97F4A7C15))))
    repeats = counts_by(owner[covered(len(h), at[twice], 5)], n)

    a, b, lines = words(data, off, _NOT_NEWLINE)
    blank = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    full = blank[b] > blank[a]
    line_owner = owners(lines)[full]
    _, again = repeated(mix(span_hashes(data, a[full], b[full]) ^ (line_owner.astype(U) * U(0x9E3779B97F4A7C15))))
    dup_lines = counts_by(line_owner[again], n)

    low = span_hashes(LOWER[data], starts, ends)
    where = np.minimum(np.searchsorted(known, low), len(known) - 1)
    bins = np.where(known[where] == low, place[where], len(known))
    common = np.bincount(owner * (len(known) + 1) + bins, minlength=n * (len(known) + 1)).reshape(n, -1)
    return [np.diff(first), chars, classes[:, 4], dup_lines, repeats, classes, common]


def measures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, language, the five counts and the two histograms, in one pass over the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, off in text_slices(batch.column(2)):
                out = _measure(data, off)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel(), pa.int64()), x.shape[1]).cast(pa.list_(pa.int64())) for x in out[5:]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, end - row) for c in (0, 1)), *(pa.array(x, pa.int64()) for x in out[:5]), *lists],
                    names=[*batch.schema.names[:2], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, F.col(lang_col).cast("string").alias("__lang"), text_col).mapInArrow(
        frugal(measure), f"`{id_col}` {kind}, __lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars array<bigint>, common array<bigint>"
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms given as arrays of counts; 0 where one is empty."""
    total = [F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b).cast("double") for x in (p, q)]
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(F.transform(p, lambda x: x / total[0]), F.transform(q, lambda x: x / total[1]), lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    sum_of = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.when((total[0] > 0) & (total[1] > 0), F.sqrt(F.greatest(sum_of / 2, F.lit(0.0)))).otherwise(0.0)


def quality(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    judged_words: int = JUDGED_WORDS, max_chars: float = MAX_CHARS, max_common: float = MAX_COMMON,
) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, common_distance, kept.

    A null text is empty: no words, so base_failed. Languages outside LANGUAGES,
    null included, share one reference. Rows that repeat an id are judged each.
    Other columns are ignored. The references are sums over all documents, one row
    for each of at most five languages, which bounds what is broadcast.
    """
    group = F.when(F.col("__lang").isin(*LANGUAGES), F.col("__lang")).otherwise(F.lit("other"))
    found = stage(measures(documents, id_col, text_col, lang_col).withColumn("__lang", group))
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    reference = found.groupBy("__lang").agg(sums("chars", CLASSES).alias("all_chars"), sums("common", len(COMMON_WORDS) + 1).alias("all_common"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = found.join(F.broadcast(reference), "__lang").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        divergence(F.col("chars"), F.col("all_chars")).alias("char_distance"), divergence(F.col("common"), F.col("all_common")).alias("common_distance"),
    )
    far = (F.col("n_words") >= judged_words) & ((F.col("char_distance") > max_chars) | (F.col("common_distance") > max_common))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
