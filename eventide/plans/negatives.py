"""Mixed negatives of each true pair (survey rows M1, M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import Statement as S
from .dialect import frame

#: Negatives per true pair, and how many of them come from other queries' candidates, are hard, or popular.
TOTAL, FROM_TESTS, HARD, POPULAR = 10, 2, 4, 2

_HEAD = """WITH u AS (SELECT qid, src, c AS positive FROM {q} WHERE pos = 0), g AS (SELECT min(qid) AS lo, max(qid) AS hi, (SELECT max(t) FROM {train}) AS end_t FROM {q}), pool AS (SELECT dst, count(*) AS n FROM {train} GROUP BY dst), ids AS (SELECT min(dst) AS lo, max(dst) AS hi FROM pool),
        known AS (SELECT DISTINCT src, dst FROM {train}), pop AS (SELECT dst, row_number() OVER (ORDER BY n DESC, dst) AS k FROM (SELECT dst, n FROM pool ORDER BY n DESC, dst LIMIT 2048) x), np AS (SELECT count(*) AS n FROM pop), last AS (SELECT src, max_by(dst, k) AS dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY t, seq) AS k FROM {train}) x GROUP BY src)"""


def _draw(salt: int) -> str:
    """A number from a query and the number of a draw, the same wherever it is worked out."""
    return f"((u.qid * 7919 + j.j * 104729 + {salt}) * 48271 % 2147483647)"


def _places(n: int) -> str:
    return f"(SELECT EACH(CAST(0 AS BIGINT), CAST({n - 1} AS BIGINT))) AS j)"


#: Stages: candidates (qid, dst, place), whether those the source has met are left out. Draws go to places in numbered lists or id ranges, so no query meets a whole list.
_STAGES = (
    (f"SELECT u.qid, o.c AS dst, j.j AS place FROM u CROSS JOIN {_places(8)} j CROSS JOIN g JOIN {{q}} o ON o.qid = g.lo + {_draw(1)} % (g.hi - g.lo + 1) AND o.pos = {_draw(2)} % 20", True),
    ("SELECT u.qid, h.dst, h.k AS place FROM u JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY max(t) DESC, max(seq) DESC) AS k FROM {train} GROUP BY src, dst) h ON h.src = u.src WHERE h.k <= 32", False),
    ("SELECT u.qid, s.dst, s.k AS place FROM u JOIN last ON last.src = u.src JOIN (SELECT prev, dst, row_number() OVER (PARTITION BY prev ORDER BY n DESC, dst) AS k FROM (SELECT s.prev, s.dst, count(*) AS n FROM {steps} s CROSS JOIN g WHERE s.t < g.end_t GROUP BY s.prev, s.dst) x) s ON s.prev = last.dst WHERE s.k <= 512", True),
    (f"SELECT u.qid, p.dst, j.j AS place FROM u CROSS JOIN {_places(12)} j CROSS JOIN np JOIN pop p ON p.k = {_draw(3)} % np.n + 1", True),
    (f"SELECT u.qid, d.dst, j.j AS place FROM u CROSS JOIN {_places(24)} j CROSS JOIN ids JOIN pool d ON d.dst = ids.lo + {_draw(4)} % (ids.hi - ids.lo + 1)", True),
    (f"SELECT u.qid, d.dst, j.j AS place FROM u CROSS JOIN {_places(2 * TOTAL)} j CROSS JOIN ids JOIN pool d ON d.dst = ids.lo + (u.positive - ids.lo + 1 + j.j) % (ids.hi - ids.lo + 1)", False),
)


#: The first stage with its draws worked out before they meet candidates: as one list of joins it is put in an order where each draw meets all candidates of its place.
_DRAWN = f"""SELECT d.qid, o.c AS dst, d.j AS place FROM (SELECT u.qid, j.j, g.lo + {_draw(1)} % (g.hi - g.lo + 1) AS other, {_draw(2)} % 20 AS pos FROM u CROSS JOIN {_places(8)} j CROSS JOIN g) d
        JOIN {{q}} o ON o.qid = d.other AND o.pos = d.pos"""


def _candidates(stage: int, drawn: bool = False) -> str:
    rows, unmet = _STAGES[stage]
    rows = _DRAWN if drawn and stage == 0 else rows
    return f"SELECT x.qid, x.dst, min(x.place) AS place FROM ({rows}) x JOIN u ON u.qid = x.qid AND u.positive <> x.dst {'LEFT JOIN known ON known.src = u.src AND known.dst = x.dst WHERE known.src IS NULL' if unmet else ''} GROUP BY x.qid, x.dst"


def mixed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, dst, stage, k): other queries' candidates, recent history, successors of the last destination, popular ones, any, the next ids; at last the positive again.

    What a stage lacks is made up by the later ones. A query has one bounded list of
    candidates per stage, and takes from list to list what is not taken yet.
    """
    held: dict[str, DataFrame] = {}
    rows = frame(spark, sf_dir, "SELECT qid, c AS positive FROM {q} WHERE pos = 0", held)
    for i in range(len(_STAGES)):
        found = frame(spark, sf_dir, f"{_HEAD} {_candidates(i, drawn=True)}", held)
        lists = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dst"))), lambda x: x["dst"]).alias(f"c{i}"))
        rows = rows.join(lists, "qid", "left")
    none = F.array().cast("array<bigint>")
    quotas = (
        lambda n: F.lit(FROM_TESTS), lambda n: F.lit((HARD + 1) // 2), lambda n: HARD - n[1], lambda n: F.lit(POPULAR), lambda n: TOTAL - sum(n), lambda n: TOTAL - sum(n),
    )
    sizes: list = []
    for i, quota in enumerate(quotas):
        taken = F.concat(none, *[F.col(f"t{k}") for k in range(i)])
        rows = rows.withColumn(f"t{i}", F.slice(F.array_except(F.coalesce(F.col(f"c{i}"), none), taken), F.lit(1), quota(sizes).cast("int")))
        sizes.append(F.size(f"t{i}"))
    rows = rows.withColumn("t6", F.when(sum(sizes) < TOTAL, F.array_repeat("positive", (TOTAL - sum(sizes)).cast("int"))).otherwise(none))
    marked = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("stage"), F.col(f"t{i}").alias("dsts")) for i in range(len(_STAGES) + 1)])
    each = rows.select("qid", F.explode(marked).alias("s")).select("qid", "s.stage", F.posexplode("s.dsts").alias("k", "dst"))
    return each.select("qid", "dst", "stage", (F.col("k") + 1).cast("bigint").alias("k"))


def _oracle() -> str:
    """The same, stage by stage with anti-joins."""
    quotas = (str(FROM_TESTS), str((HARD + 1) // 2), f"{HARD} - n2", str(POPULAR), f"{TOTAL} - n1 - n2 - n3 - n4", f"{TOTAL} - n1 - n2 - n3 - n4 - n5")
    taken = ", ".join(f"count(CASE WHEN stage = {k} THEN 1 END) AS n{k}" for k in range(1, 6))
    sql = _HEAD + ", t0 AS (SELECT CAST(NULL AS BIGINT) AS qid, CAST(NULL AS BIGINT) AS dst, 0 AS stage, CAST(0 AS BIGINT) AS k WHERE 1 = 0)"
    for i, quota in enumerate(quotas, 1):
        sql += f""",
        c{i} AS (SELECT x.* FROM ({_candidates(i - 1)}) x LEFT JOIN t{i - 1} t ON t.qid = x.qid AND t.dst = x.dst WHERE t.qid IS NULL),
        s{i} AS (SELECT u.qid, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(n4, 0) AS n4, coalesce(n5, 0) AS n5 FROM u LEFT JOIN (SELECT qid, {taken} FROM t{i - 1} GROUP BY qid) n ON n.qid = u.qid),
        t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT c.qid, c.dst, {i}, c.k FROM (SELECT qid, dst, row_number() OVER (PARTITION BY qid ORDER BY place, dst) AS k FROM c{i}) c JOIN s{i} s ON s.qid = c.qid WHERE c.k <= {quota})"""
    return sql + f"""
        SELECT qid, dst, CAST(stage AS BIGINT) AS stage, CAST(k AS BIGINT) AS k FROM t6 UNION ALL SELECT u.qid, u.positive, 7, j.j + 1 FROM u LEFT JOIN (SELECT qid, count(*) AS n FROM t6 GROUP BY qid) n ON n.qid = u.qid CROSS JOIN {_places(TOTAL)} j WHERE j.j < {TOTAL} - coalesce(n.n, 0)"""


QUERIES = {"m1_m2_mixed_negatives": S("M1 M2", "", _oracle(), mixed_negatives)}
