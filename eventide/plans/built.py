"""Queries whose plan is built by operators instead of one statement; those SQL can express have an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import asof, graph, learned
from eventide.sources import files

from .dialect import Statement as S
from .dialect import frame

FEATURES = ("s", "r", "u")


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"SELECT * FROM {{{name}}}")


def stats_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.stats_features(_frame(spark, sf_dir, "ix"))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.node_ids(_frame(spark, sf_dir, "ix"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_frame(spark, sf_dir, "ix"))


def fifo_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fifo_cooccurrence(_frame(spark, sf_dir, "ix"), 16).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def fifo_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fifo_cooccurrence(_frame(spark, sf_dir, "ix"), 128).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def spread_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = frame(spark, sf_dir, "SELECT qid, r AS s, CAST(row_number() OVER (PARTITION BY qid ORDER BY r DESC, u DESC, c, pos) AS BIGINT) AS place FROM {sc}")
    return graph.spread_ties(placed)


def interest_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("src"), F.col("vec_id").alias("t"), "embedding")
    return graph.interest_centres(history)


def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the mean vector of each label: the largest, the second, and how many reach half of the largest."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = vectors.groupBy("label", "i").agg(F.avg("x").alias("c"))
    norms = centre.groupBy("label").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("nc"))
    own = vectors.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    dots = vectors.select("vec_id", "i", "x").join(centre, "i").groupBy("vec_id", "label").agg(F.sum(F.col("x") * F.col("c")).alias("dot"))
    cosine = dots.join(norms, "label").join(own, "vec_id").select("vec_id", (F.col("dot") / F.greatest(F.col("nc") * F.col("nx"), F.lit(1e-12))).alias("cos"))
    top = F.sort_array(F.collect_list("cos"), asc=False)
    lists = cosine.groupBy("vec_id").agg(top.alias("t"))
    return lists.select("vec_id", F.round(F.col("t")[0], 6).alias("best"), F.round(F.get("t", F.lit(1)), 6).alias("second"), F.size(F.filter("t", lambda x: x >= 0.5 * F.col("t")[0])).cast("bigint").alias("coverage"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chronological sample without replacement: the operator's limit is its feature."""
    return _frame(spark, sf_dir, "ix").orderBy(F.xxhash64(F.lit(7), "seq")).limit(1000).orderBy("t", "seq")


def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight events of each source, drawn by hash."""
    return frame(spark, sf_dir, "SELECT src, dst, t, seq FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY xxhash64(7, seq)) AS k FROM {ix}) x WHERE k <= 8")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "SELECT qid, pos, s, r, u, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS label FROM {sc}")


def _ranker(kind: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _labelled(spark, sf_dir)
        return learned.score(learned.fit_ranker(rows, FEATURES, kind), rows)

    return build


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return learned.permutation_importance(learned.fit_ranker(rows, FEATURES), rows, FEATURES)


def factor_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.factor_dots(_frame(spark, sf_dir, "train"), _frame(spark, sf_dir, "q"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.item_vectors(_frame(spark, sf_dir, "train"))


_STATS = """WITH x AS (
  SELECT e.seq, e.src, e.dst, e.t,
    (SELECT count(*) FROM {ix} p WHERE p.src = e.src AND p.t < e.t) AS n_src, (SELECT max(t) FROM {ix} p WHERE p.src = e.src AND p.t < e.t) AS last_src,
    (SELECT count(*) FROM {ix} p WHERE p.dst = e.dst AND p.t < e.t) AS n_dst, (SELECT max(t) FROM {ix} p WHERE p.dst = e.dst AND p.t < e.t) AS last_dst,
    (SELECT count(*) FROM {ix} p WHERE p.src = e.src AND p.dst = e.dst AND p.t < e.t) AS n_pair, (SELECT max(t) FROM {ix} p WHERE p.src = e.src AND p.dst = e.dst AND p.t < e.t) AS last_pair,
    (SELECT max(k) FROM {num} p WHERE p.src = e.src AND p.dst = e.dst AND p.t < e.t) AS k_pair,
    (SELECT count(*) FROM {ix} p WHERE p.t < e.t) AS n_all, greatest(coalesce((SELECT max(t) FROM {ix} p WHERE p.t < e.t), sp.min_t) - sp.min_t, 1) AS span
  FROM {ix} e CROSS JOIN {span} sp)
SELECT seq, src, dst, t, round(ln(1 + n_pair), 6) AS pair_strength, round(n_pair / greatest(n_src, 1)::DOUBLE, 6) AS repeat_rate,
  round(CASE WHEN last_pair IS NULL THEN 0 ELSE exp(-(t - last_pair)::DOUBLE / span) END, 6) AS pair_recency, round(ln(1 + n_dst) / ln(1 + greatest(n_all, 1)), 6) AS dst_popularity,
  round(CASE WHEN last_dst IS NULL THEN 0 ELSE exp(-(t - last_dst)::DOUBLE / span) END, 6) AS dst_recency, round(CASE WHEN n_src - k_pair + 1 <= 32 THEN 1.0::DOUBLE / (n_src - k_pair + 1) ELSE 0 END, 6) AS recent_hit,
  round(ln(1 + n_src) / ln(1 + greatest(n_all, 1)), 6) AS src_activity, round(CASE WHEN last_src IS NULL THEN 0 ELSE exp(-(t - last_src)::DOUBLE / span) END, 6) AS src_recency
FROM x"""

_COMPONENTS = """WITH RECURSIVE p AS (SELECT DISTINCT src, dst FROM {ix}), reach(s, c) AS (
  SELECT src, src FROM p UNION SELECT b.src, reach.c FROM reach JOIN p a ON a.src = reach.s JOIN p b ON b.dst = a.dst),
label AS (SELECT s, min(c) AS c FROM reach GROUP BY s)
SELECT 'src' AS role, s AS node, c AS component FROM label UNION ALL SELECT 'dst', p.dst, min(label.c) FROM p JOIN label ON label.s = p.src GROUP BY p.dst"""

_AFFINITY = """WITH v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM {embeddings}),
c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY ALL), nc AS (SELECT label, sqrt(sum(c * c)) AS nc FROM c GROUP BY label), nx AS (SELECT vec_id, sqrt(sum(x * x)) AS nx FROM v GROUP BY vec_id),
d AS (SELECT v.vec_id, c.label, sum(v.x * c.c) AS dot FROM v JOIN c USING (i) GROUP BY ALL), s AS (SELECT vec_id, dot / greatest(nc * nx, 1e-12) AS cos FROM d JOIN nc USING (label) JOIN nx USING (vec_id)),
k AS (SELECT vec_id, cos, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC) AS k, max(cos) OVER (PARTITION BY vec_id) AS best FROM s)
SELECT vec_id, round(max(best), 6) AS best, round(max(CASE WHEN k = 2 THEN cos END), 6) AS second, count(CASE WHEN cos >= 0.5 * best THEN 1 END) AS coverage FROM k GROUP BY vec_id"""

_FIFO = """WITH RECURSIVE w AS (SELECT src, k, dst, TRUE AS put, [dst] AS held FROM {num} WHERE k = 1
  UNION ALL SELECT n.src, n.k, n.dst, NOT list_contains(w.held, n.dst), CASE WHEN list_contains(w.held, n.dst) THEN w.held ELSE list_append(w.held, n.dst)[-16:] END FROM w JOIN {num} n ON n.src = w.src AND n.k = w.k + 1),
p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k) AS i FROM w WHERE put), one AS (SELECT x.dst AS a, y.dst AS b FROM p x JOIN p y ON x.src = y.src AND y.i - x.i BETWEEN 1 AND 16 AND x.dst <> y.dst)
SELECT a, b, count(*) AS n FROM (SELECT a, b FROM one UNION ALL SELECT b, a FROM one) x GROUP BY a, b"""

_SPREAD = """WITH RECURSIVE p AS (SELECT qid, r AS s, row_number() OVER (PARTITION BY qid ORDER BY r DESC, u DESC, c, pos) AS place FROM {sc}),
w AS (SELECT qid, place, s FROM p WHERE place = 1 UNION ALL SELECT p.qid, p.place, least(p.s, nextafter(w.s, '-infinity'::DOUBLE)) FROM w JOIN p ON p.qid = w.qid AND p.place = w.place + 1) SELECT qid, place, s FROM w"""

QUERIES = {
    "stats_features": S("C1 C2 C3 C4 C5 C6 C7 C8", "", _STATS, stats_features),
    "node_ids": S("A11 B11", "", "SELECT 'src' AS role, src AS raw, dense_rank() OVER (ORDER BY src) - 1 AS id FROM (SELECT DISTINCT src FROM {ix}) UNION ALL SELECT 'dst', dst, dense_rank() OVER (ORDER BY dst) - 1 FROM (SELECT DISTINCT dst FROM {ix})", node_ids),
    "n7_components": S("N7", "", _COMPONENTS, components),
    "f5_fifo_cooccurrence": S("F5", "", _FIFO, fifo_cooccurrence),
    "f5_fifo_unexpired": S("F5", "", "SELECT a, b, n FROM {con}", fifo_unexpired),
    "h18_spread_ties": S("A5 H18", "", _SPREAD, spread_ties),
    "g16_interest_centres": S("G16", "", None, interest_centres),
    "g17_affinity": S("G17", "", _AFFINITY, affinity),
    "b4_chronological_sample": S("B4", "", None, sample),
    "b5_reservoir": S("B5", "", None, reservoir),
    "o1_logistic_ranker": S("O1 O3", "", None, _ranker("logistic")),
    "o2_boosted_ranker": S("O2", "", None, _ranker("boosted")),
    "o4_policy_tree": S("O4", "", None, _ranker("tree")),
    "n18_importance": S("N18", "", None, importance),
    "g18_factor_dots": S("G18", "", None, factor_dots),
    "g7_item_vectors": S("G7", "", None, item_vectors),
}
