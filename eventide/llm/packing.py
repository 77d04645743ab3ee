"""Packing along a space-filling curve.

Each document becomes a vector of hashed word signs in a few dimensions, and its
place on the Hilbert curve through that space is the sort key. The rows are
range-sorted by key and every task lays its stretch of the curve end to end into
sequences, so neighbours on the curve share sequences. What is left of a stretch
below a full sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import stage
from .textnum import LOWER, counts_by, frugal, mix, owners, span_hashes, text_slices, words

CAPACITY = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 16
#: Bytes of ids that a stretch of the curve has at most on average, whatever the number of shuffle partitions.
STRETCH = 8 << 20
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by the tokenizer in a file.

    A byte-level BPE vocabulary whose ids follow the order of its merges has the
    same ids by its ranks alone, which is several times faster; the file is
    checked for that, and any other tokenizer, or text with a special token's
    string, goes the plain way.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.ranked, self.marks, largest = self._by_rank(path)
        self.kind = np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)  # only loaded for what needs it

    @staticmethod
    def _by_rank(path: str) -> tuple[object, list[str], int]:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        ordered = model["type"] == "BPE" and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        if not byte_level or file["normalizer"] or not ordered or model.get("dropout") or model.get("ignore_merges"):
            return None, [], 1 << 16
        byte_of = _byte_symbols()
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(special), max(model["vocab"].values(), default=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self.plain(texts)
        out = [b"" if any(m in t for m in self.marks) else np.array(self.ranked.encode_ordinary(t), self.kind).tobytes() for t in texts]
        odd = [i for i, t in enumerate(texts) if any(m in t for m in self.marks)]
        if odd:  # else the tokenizer is not loaded
            for i, ids in zip(odd, self.plain([texts[i] for i in odd]), strict=True):
                out[i] = ids
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of coordinates below 2**bits (Skilling's transposition, over all rows at once)."""
    x = points.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents: the mean of the sign vectors of their words, on a grid."""
    lower = LOWER[data]
    starts, ends, first = words(lower, off)
    n, owner = len(off) - 1, owners(first)
    h = mix(span_hashes(lower, starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    total = np.maximum(np.diff(first), 1)
    grid = [counts_by(owner, n, ((h >> np.uint64(7 * d)) & np.uint64(1)).astype(np.float64)) * ((1 << BITS) - 1) // total for d in range(DIMENSIONS)]
    return hilbert(np.stack(grid, 1), BITS)


def encoded(documents: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """(id, key, ids as little-endian integers) per document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for row, end, data, off in text_slices(texts, SLICE):
                ids = e.encode([t or "" for t in texts.slice(row, end - row).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(curve_keys(data, off)), pa.array(ids, pa.binary()), pa.array(np.full(end - row, e.kind.itemsize, np.int8))], names=[batch.schema.names[0], "key", "ids", "width"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(frugal(encode), f"`{id_col}` {kind}, key bigint, ids binary, width tinyint")


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` the piece's ids too.

    A document is the ids of its whole text and then ``end_id``, so a null or empty
    text has one id. Every id lies in exactly one piece. Sequences have ``capacity``
    ids, or a smaller power of two at the end of a task's stretch. Documents of
    equal key (copies) are sorted by id, then by their ids of tokens, and may be split between tasks; rows that
    repeat an id are packed each. Other columns are ignored; no rows give no rows.
    The result is a staged table; the documents' ids go when it is written.
    """
    path = tokenizer or default_tokenizer()
    kind = documents.schema[id_col].dataType.simpleString()
    table = stage(encoded(documents, id_col, text_col, path))
    size = table.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    n = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // STRETCH))
    curve = table.repartitionByRange(n, "key", id_col).sortWithinPartitions("key", id_col, "ids")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence = filled = 0
        held: list[tuple] = []  # pieces of the sequence that is not full yet
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = [pa.array(columns[0], id_type), *(pa.array(np.array(c, np.int64)) for c in (columns[1], columns[2]))]
            out.append(pa.array(np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in columns[3]], np.int64)))
            out += [pa.array(np.array(c, np.int64)) for c in columns[4:7]]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in columns[3]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, raw, width in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                unit = np.dtype(f"<u{width}")
                ids = np.append(np.frombuffer(raw.as_buffer(), unit), unit.type(end_id))
                at = 0
                while at < len(ids):
                    size = min(capacity - filled, len(ids) - at)
                    held.append((key, at, size, ids[at : at + size], len(ids), base + sequence, filled))
                    at, filled = at + size, filled + size
                    if filled == capacity:
                        done += held
                        held, filled, sequence = [], 0, sequence + 1
                if len(done) >= 1_000:
                    yield batch_of(done)
                    done = []
        left = filled
        room = used = 0
        for key, start, _, ids, total, _, _ in held:  # what is left, cut at the powers of two that add up to it
            at = 0
            while at < len(ids):
                if used == room:
                    sequence, used = sequence + (room > 0), 0
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                size = min(room - used, len(ids) - at)
                done.append((key, start + at, size, ids[at : at + size], total, base + sequence, used))
                at, used = at + size, used + size
        if done:
            yield batch_of(done)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return stage(curve.mapInArrow(frugal(lay), schema), table)  # so that tasks get their rows in batches of moderate size


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves from pieces with ids: sequence_id, ids in order, length."""
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"), F.sum("length").alias("length")
    )
