"""Sums over the pairs of a query's recent nodes and its candidates, as of its time.

Rows of a key go through one task in the order of time and are dealt with one by
one, so no query is joined with what lies before it. First the log is walked by
source, which gives every query its nodes and every event the pairs it makes;
then both are dealt out by the pairs' second node, and a sum per pair is kept up
to date while queries read it. A query travels once for each part its candidates
fall into, not once for each pair.
"""

from __future__ import annotations

from array import array
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Nodes of a query: so many different destinations, or destinations of so many events.
RECENT = 64
#: Rows given back to Spark at a time.
_BATCH = 4000
_PROBE, _EVENT, _STEP = 0, 1, 2
#: Lists go packed, as bytes of their numbers: Spark only passes them on, and copies them as a whole.
_DEALT = "part bigint, kind int, t bigint, far double, qid bigint, a binary, w binary, pos binary, b binary"
_SUMS = "qid bigint, pos bigint, n bigint, v double"

Rows = Iterator[tuple]


def _packed(numbers: list, code: str = "q") -> bytes:
    return array(code, numbers).tobytes()


def _part(node: int, parts: int) -> int:
    return node % 2147483647 * 48271 % 2147483647 % parts


def _in_order(rows: DataFrame, key: str, new: Callable[[], Callable[[tuple], Iterable[tuple]]], schema: str, parts: int | None = None) -> DataFrame:
    """What ``new()`` makes for every key returns for its rows, in the order of t; at equal times probes come first, then events by seq."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = rows.columns
    at, kind = names.index(key), to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
        last, step, out = (), None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[at],) != last:
                    last, step = (row[at],), new()
                out.extend(step(row))
                if len(out) >= _BATCH:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    dealt = rows.repartitionById(parts, F.col(key).cast("int")) if parts else rows.repartition(key)
    return dealt.sortWithinPartitions(key, "t", "kind", *["seq"] * ("seq" in names)).mapInArrow(walk, schema)


def _dealt_event(t: int, far: float, a: list[int], b: list[int], parts: int) -> Rows:
    """The pairs of all a and all b, for each part that b fall into."""
    of = defaultdict(list)
    for x in b:
        of[_part(x, parts)].append(x)
    packed = _packed(a)
    for part, x in of.items():
        yield part, _EVENT, t, far, None, packed, None, None, _packed(x)


def _dealt_probe(row: tuple, a: list[int], w: list[float] | None, parts: int) -> Rows:
    """The probe for each part that its candidates fall into; null ones go without a number."""
    _, t, kind, _, far, _, qid, places, candidates = row
    of = defaultdict(lambda: ([], []))
    for p, c in zip(places, candidates, strict=True):
        pos, b = of[None if c is None else _part(c, parts)]
        pos.append(p)
        b.append(c)
    a, w = _packed(a), None if w is None else _packed(w, "d")
    for part, (pos, b) in of.items():
        yield part or 0, kind, t, far, qid, a, w, _packed(pos), None if part is None else _packed(b)


def _sums(dealt: DataFrame, parts: int) -> DataFrame:
    """(qid, pos, n, v): over the pairs (a, c) with the candidate c before the probe, how many and the sum of the weights w of a times exp((t - time of the probe) / width), where far is (t - some time) / width."""
    from math import exp

    def new() -> Callable[[tuple], Iterable[tuple]]:
        held: dict[int, dict[int, complex]] = {}

        def step(row: tuple) -> Iterable[tuple]:
            _, kind, _, far, qid, a, w, pos, b = row
            a = array("q", a)
            if kind:
                one = complex(1, exp(far))
                for y in array("q", b):
                    of = held.setdefault(y, {})
                    for x in a:
                        of[x] = of.get(x, 0j) + one
                return ()
            if b is None:
                return [(qid, p, 0, 0.0) for p in array("q", pos)]
            scale, out = exp(-far), []
            w = None if w is None else array("d", w)
            for p, c in zip(array("q", pos), array("q", b), strict=True):
                of = held.get(c) if a else None
                if not of:
                    out.append((qid, p, 0, 0.0))
                    continue
                if w is None:
                    s = sum([of[x] for x in a if x in of])
                else:
                    s = sum([of[x].imag * k for x, k in zip(a, w, strict=True) if x in of]) * 1j
                out.append((qid, p, int(s.real), s.imag * scale))
            return out

        return step

    return _in_order(dealt, "part", new, _SUMS, parts)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _probes(q: DataFrame) -> DataFrame:
    lists = q.groupBy("qid", "src", "t").agg(F.collect_list(F.struct("pos", "c")).alias("x"))
    return lists.select(F.col("src").alias("key"), "t", F.lit(_PROBE).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("dst"), "qid", F.col("x.pos").alias("pos"), F.col("x.c").alias("c"))


def _with_far(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """Rows (key, t, kind, seq, far, dst, qid, pos, c); clock has one row of max_t and width."""
    far = ((F.col("t") - F.col("max_t")).cast("double") / F.col("width")).alias("far")
    return rows.crossJoin(F.broadcast(clock)).select("key", "t", "kind", "seq", far, "dst", "qid", "pos", "c")


def _marked(events: DataFrame, key: str, kind: int) -> DataFrame:
    none = F.lit(None)
    return events.select(F.col(key).alias("key"), "t", F.lit(kind).alias("kind"), "seq", "dst", none.cast("bigint").alias("qid"), none.cast("array<bigint>").alias("pos"), none.cast("array<bigint>").alias("c"))


def cooccurrence_of_recent(ix: DataFrame, q: DataFrame, clock: DataFrame, limit: int) -> DataFrame:
    """(qid, pos, n, v): co-occurrences before a query of its source's last ``RECENT`` destinations with a candidate, counted and decayed.

    A destination that enters the bounded history of its source (``limit``, first
    in, first out) co-occurs with those in it, both ways.
    """
    parts = _parts(ix)

    def new() -> Callable[[tuple], Iterable[tuple]]:
        recent: dict[int | None, None] = {}
        held: dict[int | None, None] = {}

        def step(row: tuple) -> Iterable[tuple]:
            _, t, kind, _, far, d, *_ = row
            if kind == _PROBE:
                return _dealt_probe(row, [x for x in recent if x is not None], None, parts)
            recent.pop(d, None)
            recent[d] = None
            if len(recent) > RECENT:
                del recent[next(iter(recent))]
            if d in held:
                return ()
            known = [x for x in held if x is not None]  # d is not among them
            held[d] = None
            if len(held) > limit:
                del held[next(iter(held))]
            if d is None or not known:
                return ()
            return [*_dealt_event(t, far, known, [d], parts), *_dealt_event(t, far, [d], known, parts)]

        return step

    rows = _with_far(_probes(q).unionByName(_marked(ix, "src", _EVENT)), clock)
    return _sums(_in_order(rows, "key", new, _DEALT), parts)


def two_steps(ix: DataFrame, steps: DataFrame, q: DataFrame, clock: DataFrame) -> DataFrame:
    """(qid, pos, n, v): the decayed weight of steps before a query from its source's last destination z to a candidate, and over each node that z, as a source, met in its last ``RECENT`` events.

    Steps are rows (prev, dst, t); the weight of a path is the product of its steps'.
    """
    from math import exp

    parts = _parts(ix)

    def newest() -> Callable[[tuple], Iterable[tuple]]:
        seen: list[int | None] = [None]

        def step(row: tuple) -> Iterable[tuple]:
            if row[2] != _PROBE:
                seen[0] = row[5]
                return ()
            return ((seen[0], *row[1:]),)

        return step

    def nodes() -> Callable[[tuple], Iterable[tuple]]:
        last: deque = deque(maxlen=RECENT)
        weight: dict[int, float] = {}

        def step(row: tuple) -> Iterable[tuple]:
            z, t, kind, _, far, d, *_ = row
            if kind == _EVENT:
                last.append(d)
            elif kind == _STEP and d is not None:
                weight[d] = weight.get(d, 0.0) + exp(far)
                return _dealt_event(t, far, [z], [d], parts)
            elif kind == _PROBE:
                met = [] if z is None else [x for x in dict.fromkeys(last) if x is not None and x in weight]
                return _dealt_probe(row, met + [z] * (z is not None), [weight[x] * exp(-far) for x in met] + [1.0] * (z is not None), parts)
            return ()

        return step

    rows = _with_far(_probes(q).unionByName(_marked(ix, "src", _EVENT)), clock)
    at_z = _in_order(rows, "key", newest, "key bigint, t bigint, kind int, seq bigint, far double, dst bigint, qid bigint, pos array<bigint>, c array<bigint>")
    moved = _marked(steps.withColumn("seq", F.lit(None).cast("bigint")), "prev", _STEP)
    by_node = at_z.unionByName(_with_far(_marked(ix, "src", _EVENT).unionByName(moved), clock))
    return _sums(_in_order(by_node, "key", nodes, _DEALT), parts)
