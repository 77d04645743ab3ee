"""Removal of byte strings that begin in an earlier document, by suffix arrays.

Every stretch of 50 bytes has an anchor, the place of the smallest hash of 16
bytes in it, so equal stretches have equal anchors at equal places. Per anchor
hash, the surroundings that use the anchor (its context) are compared. Contexts
that are equal throughout fall together by hash, and all but those of the
smallest document are removed at once. Where one anchor has different contexts,
they are cut into blocks at the places where their agreement changes; the block
sequences of all such contexts in a partition form one text, its suffix array
(by linear grouping, see suffix_array) puts shared runs side by side, and every
run of at least 50 bytes shared with a smaller document is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage
from .suffix_array import common_prefixes, suffix_array
from .textnum import U, _powers, frugal, mix, text_slices

LENGTH, GRAM = 50, 16
FILTER_BITS = 24
#: Parts per shuffle partition that the anchors are dealt to.
PARTS = 4
#: Contexts that are compared at a time; one anchor's stay together.
BATCH = 4096
#: Bytes that anchors are taken from at a time, and what is seen before and behind such a piece of a longer text.
SLICE, MARGIN = 1 << 18, 256
#: Records that are held before equal ones fall together and the rest is sent.
HELD = 1 << 18
_RECORD = np.dtype([("anchor", "<u8"), ("check", "<u8"), ("start", "<i4"), ("before", "u1"), ("more", "u1")])
#: Bytes that are sent of each number. Anchors are also told apart by their part; those that still fall together are compared byte by byte.
_SENT = {"id": 8, "anchor": 5, "check": 8, "start": 4, "before": 1, "more": 1}


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for every i with a whole window, by windows of doubled width."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of numbers, first bytes first: numbers of like size compress well that way."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(blobs: list[bytes], size: int) -> np.ndarray:
    parts = []
    for blob in blobs:
        wide = np.zeros((len(blob) // size, 8), np.uint8)
        wide[:, :size] = np.frombuffer(blob, np.uint8).reshape(size, -1).T
        parts.append(wide.view("<u8").ravel())
    return np.concatenate(parts)


def _near_ends(off: np.ndarray, length: int, n: int) -> np.ndarray:
    """The places below n from which fewer than ``length`` bytes are left in their document."""
    near = off[1:, None] - np.arange(1, length)
    near = near[near >= off[:-1, None]]
    return near[near < n]


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The document of every anchor, and its record: hash, hash of the context, start of the context, bytes before the anchor, further stretches."""
    none = np.zeros(0, np.int64), np.zeros(0, _RECORD)
    n, width = len(data), length - gram + 1
    if n < length:
        return none
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram]) | U(1)
    h[_near_ends(off, gram, len(h))] = U(0xFFFFFFFFFFFFFFFF)
    least = _sliding(h, width, np.minimum)
    least[_near_ends(off, length, len(least))] = 0  # no whole stretch of a document
    padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    place = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(h)] == h)
    if not len(place):
        return none
    # The stretches that use an anchor lie in one run of equal minima, the last before the anchor with its hash.
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    value = least[first]
    run = np.zeros(len(place), np.int64)
    todo = np.arange(len(place))
    at = np.searchsorted(first, place, "right") - 1
    while len(todo):
        miss = value[at] != h[place[todo]]
        run[todo[~miss]] = at[~miss]
        todo, at = todo[miss], at[miss] - 1
    low = np.maximum(first[run], place - width + 1)
    high = np.minimum(np.append(first[1:], len(least))[run] - 1, place)
    hi, lo = place - low, place - high
    start, stop = low, high + length
    context = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U) * U(0x9E3779B97F4A7C15) + hi.astype(U))
    out = np.zeros(len(place), _RECORD)
    doc = np.searchsorted(off, place, "right") - 1
    out["anchor"], out["check"], out["start"], out["before"], out["more"] = h[place], context, start - off[doc], hi, hi - lo
    return doc, out


def _records(column: pa.Array, length: int, gram: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row and the record of every anchor of a column of texts, a bounded number of bytes at a time whatever a text's length."""
    for row, _, data, off in text_slices(column, piece):
        if len(data) <= 2 * piece:
            doc, found = anchors(data, off, length, gram)
            yield row + doc, found
            continue
        margin = max(MARGIN, 4 * length)  # more than the context of an anchor reaches
        for low in range(0, len(data), piece):
            first, last = max(0, low - margin), min(len(data), low + piece + margin)
            _, found = anchors(data[first:last], np.array([0, last - first]), length, gram)
            place = found["start"] + found["before"] + first
            found = found[(low <= place) & (place < low + piece)]
            found["start"] += first
            yield np.full(len(found), row), found


def _fold(ids: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the records that puts equal contexts side by side, and which of them a smaller id has as well."""
    key = found["anchor"] ^ mix(found["check"])
    order = np.argsort(key, kind="stable")
    anchor, check, who = found["anchor"][order], found["check"][order], ids[order]
    same = _starts(anchor, check)
    return order, who > np.repeat(np.minimum.reduceat(who, same), np.diff(np.append(same, len(who))))


def _emit(parts: int, length: int, gram: int, piece: int, most_held: int):
    """(id, text) to one row per part and piece: part, ids, records; where anchor is null, what is removed already: ids, starts, stops.

    Of equal contexts that come together here only those of the smallest id are
    sent on, so one that very many documents have travels once for each piece.
    """
    names = ["part", "id", *_RECORD.names, "stop"]

    def rows_of(ids: np.ndarray, found: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        order, later = _fold(ids, found)
        gone, rest = order[later], order[~later]
        columns = {n: [] for n in names}
        if len(gone):
            start = found["start"][gone].astype(np.int64)
            stop = start + found["more"][gone] + length
            row = {"part": turn % parts, "id": _planes(ids[gone], 8), "start": _planes(start, 4), "stop": _planes(stop, 4)}
            for n in names:
                columns[n].append(row.get(n))
        part = (found["anchor"][rest] >> U(8)) % U(parts)
        by = np.argsort(part, kind="stable")
        cut, rest = np.searchsorted(part[by], np.arange(parts + 1).astype(U)), rest[by]
        for p in np.flatnonzero(np.diff(cut)).tolist():
            k = rest[cut[p] : cut[p + 1]]
            columns["part"].append(p)
            columns["id"].append(_planes(ids[k], 8))
            columns["stop"].append(None)
            for f in _RECORD.names:
                columns[f].append(_planes(found[f][k] >> U(24) if f == "anchor" else found[f][k], _SENT[f]))
        yield pa.RecordBatch.from_arrays([pa.array(columns["part"], pa.int32()), *(pa.array(columns[n], pa.binary()) for n in names[1:])], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = turn = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for row, found in _records(batch.column(1), length, gram, piece):
                held.append((ids[row], found))
                count += len(found)
                if count >= most_held:
                    yield from rows_of(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), turn)
                    held, count, turn = [], 0, turn + 1
        if count:
            yield from rows_of(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), turn)

    return emit


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _resolve(length: int):
    """All records of some parts to rows (id, start, stop, anchor, before): removed where anchor is null, else a context still to be compared."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for part, ids, *blobs, stop in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if stop is None:
                    held.setdefault(part, []).append([ids, *blobs])
                    continue
                start = blobs[_RECORD.names.index("start")]
                columns = [_from_planes([x], size) for x, size in ((ids, 8), (start, 4), (stop, 4))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].view("<i8")), *(pa.array(x.astype(np.int32)) for x in columns[1:]), pa.nulls(len(columns[0]), pa.int64()), pa.nulls(len(columns[0]), pa.int32())],
                    names=["id", "start", "stop", "anchor", "before"],
                )
        for part in list(held):
            rows = held.pop(part)
            f = {name: _from_planes([r[k] for r in rows], size) for k, (name, size) in enumerate(_SENT.items())}
            del rows
            ids = f.pop("id").view("<i8")
            # The part makes anchors of different parts different in the later grouping, too.
            f["anchor"] = (f["anchor"] << U(20)) | U(part & 0xFFFFF)
            f["start"] = f["start"].astype(np.int64)
            order = np.lexsort((f["start"], ids, f["check"], f["anchor"]))
            ids = ids[order]
            f = {k: v[order] for k, v in f.items()}
            group = _starts(f["anchor"])
            sizes = np.diff(np.append(group, len(ids)))
            shared = np.repeat(np.minimum.reduceat(ids, group) != np.maximum.reduceat(ids, group), sizes)
            same = _starts(f["anchor"], f["check"])
            of_same = np.diff(np.append(same, len(ids)))
            kinds = np.repeat(np.add.reduceat(np.isin(np.arange(len(ids)), same, assume_unique=True).astype(np.int64), group), sizes)
            later = ids > np.repeat(ids[same], of_same)
            start = f["start"]
            stop = start + f["more"].astype(np.int64) + length
            for keep, named in ((shared & later, False), (shared & ~later & (kinds > 1), True)):
                at = np.flatnonzero(keep)
                for low in range(0, len(at), 1 << 16):
                    k = at[low : low + (1 << 16)]
                    anchor = pa.array(np.ascontiguousarray(f["anchor"][k]).view(np.int64)) if named else pa.nulls(len(k), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[k]), pa.array(start[k].astype(np.int32)), pa.array(stop[k].astype(np.int32)), anchor, pa.array(f["before"][k].astype(np.int32))],
                        names=["id", "start", "stop", "anchor", "before"],
                    )

    return resolve


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, as what is made of a row is larger than the row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, wanted contexts) to (anchor, id, start, before, bytes)."""
    for batch in _pieces(batches):
        out: list[tuple] = []
        for key, text, wanted in zip(*(batch.column(i) for i in range(3)), strict=True):
            data = text.as_buffer().to_pybytes()
            out += [(w["anchor"], key.as_py(), w["start"], w["before"], data[w["start"] : w["stop"]]) for w in wanted.as_py()]
        if out:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "id", "start", "before", "bytes"])


def _classes(group: np.ndarray, data: np.ndarray, first: np.ndarray, step: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each row reads the same as some other row of its group, going byte by byte from ``first`` in direction ``step``.

    Returns, by row and distance, the class of rows that have read the same so far
    and the size of that class (0 where a row is alone), and the reach of each row.
    """
    m, width = len(group), int(sizes.max(initial=0))
    label, members, reach = np.zeros((m, width), np.int32), np.zeros((m, width), np.int32), np.zeros(m, np.int64)
    active, now = np.arange(m), group.astype(np.int64)
    for c in range(width):
        active = active[sizes[active] > c]
        _, inverse, count = np.unique(now[active] * 256 + data[first[active] + step * c], return_inverse=True, return_counts=True)
        kept = count[inverse] > 1
        active, inverse = active[kept], inverse[kept]
        if not len(active):
            break
        now[active] = label[active, c] = inverse
        members[active, c] = count[inverse]
        reach[active] = c + 1
    return label, members, reach


def _blocks(side: int, group: np.ndarray, label: np.ndarray, members: np.ndarray, reach: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The blocks of some rows on one side: row, nearest and farthest distance from the anchor, and what names the block's content.

    A row's distances fall into one block as long as no member leaves its class;
    rows of one class have the same blocks so far.
    """
    if not label.shape[1]:
        return [np.zeros(0, np.int64)] * 6
    mine = np.arange(label.shape[1]) < reach[rows][:, None]
    mine[:, 1:] &= members[rows, 1:] != members[rows, :-1]
    r, c = np.nonzero(mine)
    last = np.append(r[1:] != r[:-1], True)
    end = np.where(last, reach[rows][r], np.append(c[1:], 0))
    return [rows[r], c, end, np.full(len(r), side), group[rows][r] * label.shape[1] + c, label[rows[r], c].astype(np.int64)]


def shared_runs(anchor: np.ndarray, ids: np.ndarray, before: np.ndarray, pieces: list[bytes], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(context, first byte, byte after the last) of the runs of a context that some context of the same anchor and a smaller id shares at the same distance from the anchor.

    A shared run of ``length`` bytes reaches over the whole anchor, so only what two
    contexts have in common going outwards from it counts, and a context that is
    alone too early on both sides shares none. What is left is cut into blocks
    where the classes of equal contexts split.
    """
    order = np.lexsort((ids, anchor))
    sizes = np.array([len(p) for p in pieces])[order]
    at = np.concatenate([[0], np.cumsum(np.array([len(p) for p in pieces]))])[:-1][order]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    before_at = before[order]
    heads = _starts(anchor[order])
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    right = _classes(group, data, at + before_at, 1, sizes - before_at)
    left = _classes(group, data, at + before_at - 1, -1, before_at)
    rows = np.flatnonzero((right[2] >= gram) & (left[2] + right[2] >= length))
    if not len(rows):
        return []
    sides = [_blocks(0, group, *left, rows), _blocks(1, group, *right, rows)]
    row, near, far, side, block, label = (np.concatenate(x) for x in zip(*sides, strict=True))
    low = np.where(side == 0, -far, near)
    by = np.lexsort((low, row))
    row, low, weight = row[by], low[by], (far - near)[by]
    new = np.lexsort((label[by], block[by], side[by]))
    symbol = np.zeros(len(by), np.int64)
    symbol[new] = np.cumsum(np.isin(np.arange(len(by)), _starts(side[by][new], block[by][new], label[by][new]))) - 1
    # One text: the blocks of every context from left to right, then a mark of its own.
    marks, total = int(symbol.max()) + 1, np.concatenate([[0], np.cumsum(weight)]).tolist()
    cuts = [*_starts(row).tolist(), len(row)]
    text: list[int] = []
    place: list[int] = []
    named = symbol.tolist()
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        text += named[a:b]
        place += range(a, b)
        text.append(marks + k)
        place.append(-1)
    who = ids[order][row].tolist()
    best = _shared_with_smaller(text, [who[p] if p >= 0 else None for p in place])
    runs, context, start = [], order[row].tolist(), (before_at[row] + low).tolist()
    for i, blocks in enumerate(best):
        if blocks:
            p = place[i]
            size = total[p + blocks] - total[p]
            if size >= length:
                runs.append((context[p], start[p], start[p] + size))
    return runs


def _shared_with_smaller(text: list[int], owner: list[int | None]) -> list[int]:
    """For each place of a text the most symbols from there that also stand at a place of a smaller owner; 0 at marks, which have no owner."""
    sa = suffix_array(text)
    lcp = [*common_prefixes(text, sa), 0]
    best = [0] * len(text)
    for step in (1, -1):  # against the suffixes before it in the order, then against those after
        held: list[tuple[int, int]] = []  # (owner, symbols shared with the entry below), owners ascending
        since = 0  # symbols shared with the last suffix that has an owner
        for k in range(len(sa)) if step == 1 else range(len(sa) - 1, -1, -1):
            i, shared = sa[k], lcp[k] if step == 1 else lcp[k + 1]
            since = min(since, shared)
            mine = owner[i]
            if mine is None:
                continue
            while held and held[-1][0] >= mine:
                since = min(since, held.pop()[1])
            if held and since > best[i]:
                best[i] = since
            held.append((mine, since))
            since = len(text)
    return best


def _compare(length: int, gram: int):
    """All contexts of some anchors to removed (id, start, stop)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by("anchor")
        anchor, ids, start = (table.column(c).to_numpy() for c in ("anchor", "id", "start"))
        before, pieces = table.column("before").to_numpy().astype(np.int64), table.column("bytes")
        del held
        group = np.append(_starts(anchor), len(anchor))
        at = 0
        while at < len(anchor):  # whole groups, about BATCH contexts at a time
            end = int(group[max(np.searchsorted(group, at + BATCH, "right") - 1, np.searchsorted(group, at, "right"))])
            runs = shared_runs(anchor[at:end], ids[at:end], before[at:end], pieces.slice(at, end - at).to_pylist(), length, gram)
            if runs:
                who, low, high = np.array(runs, np.int64).T
                who += at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[who]), pa.array((start[who] + low).astype(np.int32)), pa.array((start[who] + high).astype(np.int32))], names=["id", "start", "stop"]
                )
            at = end

    return compare


def _cut_out(id_name: str, with_kept: bool):
    """(id, text, spans) to id, n_bytes, n_removed, n_spans and the SHA-256, if asked for also the bytes, of what stays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                merged: list[list[int]] = []
                if spans.is_valid and len(spans):
                    pairs = spans.values.flatten()
                    for a, b in sorted(zip(pairs[0].to_pylist(), pairs[1].to_pylist(), strict=True)):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), *[rest] * with_kept))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=[id_name, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(columns)])

    return cut


def _bit_mask(ids: DataFrame) -> tuple[np.ndarray, object]:
    """A bit filter of bounded size over column id, and the expression for a row's bit."""
    bit = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    mask = np.zeros(1 << (FILTER_BITS - 6), U)
    mask[words.column("place").to_numpy()] = words.column("bits").to_numpy().view(U)
    return mask, bit


def _screened(rows: DataFrame, mask: object, bit: object, kind: str, wanted: bool) -> DataFrame:
    """The rows (id, text) whose bit is set, or those whose bit is not."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = ((mask.value[at >> 6] >> (at & 63).astype(U)) & U(1)).astype(bool)
            yield batch.filter(pa.array(found == wanted)).select([1, 2])

    return rows.select(bit.alias("bit"), "id", "text").mapInArrow(screen, f"id {kind}, text string")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = False, piece: int = SLICE, most_held: int = HELD) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_kept`` also the bytes that stay.

    Each byte covered by a string of ``length`` bytes that also starts in a
    document with a smaller id is removed, judged on the input texts. Ids are
    integers; rows that repeat an id do not remove from each other what both have
    at the same place, and each is returned; texts under one id count as that id's.
    Null texts are empty; with a null id nothing is removed. Other columns are
    ignored. Equality of whole contexts of
    one anchor is taken from 64-bit hashes.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    records = named.mapInArrow(frugal(_emit(n * PARTS, length, gram, piece, most_held)), "part int, " + ", ".join(f"{f} binary" for f in [*_SENT, "stop"]))
    found = stage(records.repartition(n, "part").mapInArrow(frugal(_resolve(length)), "id bigint, start int, stop int, anchor bigint, before int"))
    removed = found.where(F.col("anchor").isNull()).select("id", "start", "stop")

    open_ones = found.where(F.col("anchor").isNotNull())
    mask, bit = _bit_mask(open_ones)
    wanted = open_ones.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "stop", "before")).alias("wanted"))
    texts = _screened(named, spark.sparkContext.broadcast(mask), bit, "bigint", True)
    contexts = texts.join(wanted, "id").select("id", "text", "wanted").mapInArrow(frugal(_contexts), "anchor bigint, id bigint, start int, before int, bytes binary")
    compared = contexts.repartition(n, "anchor").mapInArrow(frugal(_compare(length, gram)), "id bigint, start int, stop int")
    spans = stage(removed.union(compared).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))

    mask, bit = _bit_mask(spans)
    shared = spark.sparkContext.broadcast(mask)
    touched = _screened(rows.where(F.col("id").isNotNull()), shared, bit, "bigint", True).join(spans, "id", "left").select("id", "text", "spans")
    empty = F.lit(None).cast("array<struct<start:int,stop:int>>")
    clear = _screened(rows.where(F.col("id").isNotNull()), shared, bit, "bigint", False).union(rows.where(F.col("id").isNull())).select("id", "text", empty.alias("spans"))
    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return touched.union(clear).mapInArrow(frugal(_cut_out(id_col, with_kept)), schema)
