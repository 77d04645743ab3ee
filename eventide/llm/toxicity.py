"""Toxicity by a factorization machine over hashed terms.

A term is a word or the beginning of a longer word, which word forms share,
hashed to one of 2**18 places; a document is the set of its terms. Beside a weight each term has a short factor vector, and the score adds
the inner products of the vectors of all pairs of terms that occur together, so
a pair can mean more than its terms do apart. Which terms enter is decided by how
far their share among labelled documents departs from chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import release, stage
from .textnum import ALNUM, LOWER, owners, span_hashes, text_slices, words

TERM_BITS = 18
#: Lengths in bytes of the word beginnings that are terms of their own.
STEMS = (6, 7)
#: Bound of the labelled sample that the machine is fitted on, in rows.
MOST_ROWS = 20_000
#: Terms that enter, at most; documents that a term must be in; standard deviations from chance.
MOST_TERMS, LEAST_DOCUMENTS, LEAST_Z = 512, 5, 4.0
FACTORS, ROUNDS, RATE, DECAY = 8, 400, 0.05, 1e-5
THRESHOLD = 0.3


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of every word and of the beginnings of longer words."""
    lower = LOWER[data]
    starts, ends, first = words(lower, off, ALNUM)
    owner, at, to = [owners(first)], [starts], [ends]
    for size in STEMS:
        longer = ends - starts > size
        owner.append(owner[0][longer])
        at.append(starts[longer])
        to.append(starts[longer] + size)
    hashes = span_hashes(lower, np.concatenate(at), np.concatenate(to))
    return np.concatenate(owner), (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, distinct terms)."""
    for batch in batches:
        for row, end, data, off in text_slices(batch.column(1)):
            owner, term = _terms(data, off)
            key = np.unique((owner << TERM_BITS) | term)
            cut = np.searchsorted(key >> TERM_BITS, np.arange(end - row + 1))
            low = (key & ((1 << TERM_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(low))], names=["label", "terms"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def strong_terms(seen: np.ndarray, hits: np.ndarray, n: int, positive: float) -> np.ndarray:
    """The places, of how many documents have a term of each place and how many of them are positive, that depart from chance, the farthest first."""
    share = positive / n
    z = (hits - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    rank = np.where(seen >= LEAST_DOCUMENTS, np.abs(z), 0.0)
    terms = np.argsort(-rank, kind="stable")[:MOST_TERMS]
    return terms[rank[terms] >= LEAST_Z]


def _kept_terms(terms: np.ndarray):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x[np.isin(x, terms)] for x in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["label", "terms"])

    return keep


class FactorizationMachine:
    """Logistic second-order factorization machine over term sets, fitted by Adam on whole batches."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors
        self.place = np.full(1 << TERM_BITS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    @classmethod
    def fit(cls, sets: list[np.ndarray], labels: np.ndarray, terms: np.ndarray | None = None, seed: int = 7) -> FactorizationMachine:
        """The machine over ``terms``, or where they are not given over the strong ones of the sets."""
        n, positive = len(sets), float(labels.sum())
        if not n or positive in (0.0, float(n)):  # nothing to tell apart: the share itself
            share = min(max(positive / n if n else 0.0, 1e-6), 1 - 1e-6)
            return cls(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        share = positive / n
        if terms is None:
            terms = strong_terms(np.bincount(flat, minlength=1 << TERM_BITS), np.bincount(flat, weights=np.repeat(labels, sizes), minlength=1 << TERM_BITS), n, positive)
        terms = np.sort(terms)
        machine = cls(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.05, (len(terms), FACTORS)))
        x = np.zeros((n, len(terms)), np.float32)
        at = machine.place[flat]
        x[np.repeat(np.arange(n), sizes)[at >= 0], at[at >= 0]] = 1
        x, inverse = np.unique(x, axis=0, return_inverse=True)  # documents with the same terms count together
        weight = np.bincount(inverse, minlength=len(x)) / n
        target = np.bincount(inverse, weights=labels, minlength=len(x)) / (weight * n)
        values = [np.array([machine.bias]), machine.weights, machine.factors]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, ROUNDS + 1):
            inner = x @ values[2]
            score = values[0] + x @ values[1] + 0.5 * ((inner**2).sum(1) - x @ (values[2] ** 2).sum(1))
            miss = weight * (1 / (1 + np.exp(-score)) - target)
            grads = [np.array([miss.sum()]), x.T @ miss + DECAY * values[1], x.T @ (miss[:, None] * inner) - (x.T @ miss)[:, None] * values[2] + DECAY * values[2]]
            for v, g, a, b in zip(values, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        machine.bias = float(values[0][0])
        return machine

    def scores(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probabilities for n documents from (document, term) pairs, repeats allowed."""
        at = self.place[term]
        key = np.unique(owner[at >= 0] * max(len(self.weights), 1) + at[at >= 0])
        who, at = key // max(len(self.weights), 1), key % max(len(self.weights), 1)
        total = self.bias + np.bincount(who, weights=self.weights[at], minlength=n)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            total = total + 0.5 * (np.bincount(who, weights=v, minlength=n) ** 2 - np.bincount(who, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS
) -> FactorizationMachine:
    """The machine fitted on labelled documents that are not held out: of more than ``most_rows`` those first by hash of their id. Null labels and labels without a document do not count."""
    sample = (
        labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col(id_col).cast("string")), "label")
        .limit(most_rows)
    )
    found = documents.select(F.col(id_col), F.col(text_col)).join(F.broadcast(sample), id_col)  # bounded by most_rows
    sets = stage(found.select("label", text_col).mapInArrow(term_sets, "label int, terms array<int>"))
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("bigint")), F.lit(0)).alias("positive")).first()
    # Counts by place, of which there are at most 2**TERM_BITS whatever the texts.
    counted = sets.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") > 0).cast("bigint")).alias("hits")).toArrow()
    seen, hits = np.zeros((2, 1 << TERM_BITS))
    seen[counted.column("term").to_numpy()], hits[counted.column("term").to_numpy()] = counted.column("n").to_numpy(), counted.column("hits").to_numpy()
    terms = strong_terms(seen, hits, total["n"], total["positive"]) if 0 < total["positive"] < total["n"] else np.zeros(0, np.int64)
    held = sets.mapInArrow(_kept_terms(terms.astype(np.int32)), "label int, terms array<int>").toArrow()  # at most MOST_TERMS terms for each of at most most_rows rows
    release(sets)
    rows = _sets(held.column("terms").combine_chunks()) if held.num_rows else []
    return FactorizationMachine.fit(rows, (held.column("label").to_numpy() > 0).astype(float), terms)


def score_toxicity(documents: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted.

    The whole text is scored; a null or empty text has no terms and gets the score
    of the bias alone. Nothing but the text enters the score. Rows that repeat an
    id are scored each; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for row, end, data, off in text_slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in (0, 1)), pa.array(m.scores(*_terms(data, off), end - row))], names=[*batch.schema.names[:2], "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    scored = documents.select(id_col, held_out(F.col(id_col)).alias("held_out"), text_col).mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
