"""The canonical inputs of the registered queries."""

from eventide.operators import asof, graph, hops

from .dialect import define

#: The primary interaction log; seq is the file order.
define(
    "ix",
    """SELECT user_id AS src, CAST(get_json_object(props, '$.k') AS BIGINT) AS dst,
       CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS t, event_id AS seq FROM {events}""",
    """SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst,
       CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq FROM {events}""",
)
#: Customers and suppliers; ties in time have no order here.
define(
    "ox",
    "SELECT o.o_custkey AS src, l.l_suppkey AS dst, unix_seconds(CAST(l.l_shipdate AS TIMESTAMP)) AS t FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey",
    "SELECT o.o_custkey AS src, l.l_suppkey AS dst, CAST(floor(epoch(l.l_shipdate)) AS BIGINT) AS t FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey",
)
#: Bounds of the log in one row.
define("span", "SELECT min(t) AS min_t, max(t) AS max_t, greatest(max(t) - min(t), 1) AS span, count(*) AS n, max(seq) AS max_seq FROM {ix}")
#: Events before the last 15 %, and those after as queries of 20 candidates; candidate 0 is the true one.
define("train", "SELECT ix.* FROM {ix} ix WHERE seq < (SELECT CAST(floor(max_seq * 0.85) AS BIGINT) FROM {span})")
define(
    "q",
    """SELECT qid, pos, src, t, CASE WHEN pos = 0 THEN dst ELSE (pos * 37 + qid * 17) % 100 END AS c
       FROM (SELECT seq AS qid, src, dst, t, EACH(CAST(0 AS BIGINT), CAST(19 AS BIGINT))) AS pos FROM {ix}
             WHERE seq >= (SELECT CAST(floor(max_seq * 0.85) AS BIGINT) FROM {span})) x""",
)
#: Three deterministic scores per candidate: almost free of ties, many ties, and by candidate.
define(
    "sc",
    """SELECT qid, pos, src, t, c, CAST((pos * 7919 + qid * 10729) % 1000 AS DOUBLE) / 1000 AS s,
       CAST((pos * 6151 + qid * 15485) % 20 AS DOUBLE) / 20 AS r, CAST((c * 31 + qid) % 50 AS DOUBLE) / 50 AS u FROM {q}""",
)
#: The same scores as three experts, one row for each.
define("ex", "SELECT 1 AS expert, qid, pos, c, s FROM {sc} UNION ALL SELECT 2, qid, pos, c, r FROM {sc} UNION ALL SELECT 3, qid, pos, c, u FROM {sc}")
#: First event of every pair, adjacent events of a source, and events numbered per source.
define("firsts", "SELECT src, dst, min(t) AS t, min(seq) AS seq, count(*) AS n, max(t) AS last_t FROM {ix} GROUP BY src, dst")
define("num", "SELECT src, dst, t, seq, CAST(row_number() OVER (PARTITION BY src ORDER BY t, seq) AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY src) AS BIGINT) AS n FROM {ix}")
define("steps", "SELECT src, prev, dst, t FROM (SELECT src, lag(dst) OVER (PARTITION BY src ORDER BY t, seq) AS prev, dst, t FROM {ix}) x WHERE prev IS NOT NULL")
#: Destinations as they enter the bounded history of their source (first in, first out), numbered per source. No source of the driver's log meets more than the limit, so that the oracle has first events only.
LIMIT = 128
define("put", lambda ix: graph.insertions(ix, LIMIT), "SELECT src, dst, t, CAST(row_number() OVER (PARTITION BY src ORDER BY t, seq) - 1 AS BIGINT) AS k FROM {firsts}")
#: Co-occurrence: each destination that enters a history with those in it, both ways.
define("co", lambda put: graph.paired(put, LIMIT), "SELECT a.dst AS a, b.dst AS b, greatest(a.t, b.t) AS t FROM {firsts} a JOIN {firsts} b ON a.src = b.src AND a.dst <> b.dst")
#: Co-occurrences of a query's recent destinations with its candidates before its time; paths of two steps likewise. The clocks have the width of the decay in one row. No oracle reads these.
define("near_clock", "SELECT max_t, CAST(greatest(span * 0.05, 1) AS DOUBLE) AS width FROM {span}")
define("co_recent", lambda ix, q, near_clock: hops.cooccurrence_of_recent(ix, q, near_clock, LIMIT))
define("wide_clock", "SELECT max_t, CAST(greatest(ceil(span * 0.2), 1) AS DOUBLE) AS width FROM {span}")
define("step_paths", lambda ix, steps, q, wide_clock: hops.two_steps(ix, steps, q, wide_clock))
#: Earlier events of the destination of a query's candidate 0. No oracle reads them.
define("dst_views", lambda ix, q: asof.destination_views(ix, q))
define("con", "SELECT a, b, count(*) AS n FROM {co} GROUP BY a, b")
define("deg", "SELECT node, CAST(sum(n) AS BIGINT) AS deg FROM (SELECT src AS node, count(*) AS n FROM {ix} GROUP BY src UNION ALL SELECT dst, count(*) FROM {ix} GROUP BY dst) x GROUP BY node")
#: Counts of different destinations at most 16 events of a source apart, both ways. Events meet by the stretch of 16 they or their successors lie in.
define(
    "item_pairs",
    """SELECT a, b, sum(n) AS n FROM (SELECT a, b, count(*) AS n FROM {near} GROUP BY a, b UNION ALL SELECT b, a, count(*) FROM {near} GROUP BY b, a) x GROUP BY a, b""",
    "SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM {num} a JOIN {num} b ON a.src = b.src AND b.k - a.k BETWEEN -16 AND 16 AND b.k <> a.k AND a.dst <> b.dst GROUP BY a.dst, b.dst",
)
define(
    "near",
    """SELECT a.dst AS a, b.dst AS b FROM (SELECT src, dst, k, EACH(CAST(floor(k / 16) AS BIGINT), CAST(floor(k / 16) AS BIGINT) + 1)) AS h FROM {num}) a
       JOIN (SELECT src, dst, k, CAST(floor(k / 16) AS BIGINT) AS h FROM {num}) b ON a.src = b.src AND a.h = b.h AND b.k - a.k BETWEEN 1 AND 16 AND a.dst <> b.dst""",
)
#: Whether the log's ids may bridge from a destination to a source.
define(
    "bridge",
    """WITH a AS (SELECT DISTINCT src AS v FROM {ix}), b AS (SELECT DISTINCT dst AS v FROM {ix}),
       r AS (SELECT CAST(count(*) AS DOUBLE) / greatest(least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 1) AS ratio FROM a JOIN b ON a.v = b.v)
       SELECT ratio, CASE WHEN ratio >= 0.5 THEN 'global' WHEN ratio > 0 THEN 'both_roles' ELSE 'degree' END AS policy, CASE WHEN ratio >= 0.5 THEN 0 ELSE 2 END AS min_degree FROM r""",
)
