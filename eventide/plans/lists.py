"""List, blend, routing, metric, split, sampling and report queries (survey sections H to N)."""

from .dialect import Statement as S
from .temporal import QUERIES as TEMPORAL

_RANK = "rank() OVER (PARTITION BY qid ORDER BY {0} DESC) + CAST(count(*) OVER (PARTITION BY qid, {0}) - 1 AS DOUBLE) / 2"


def _avg_rank(x: str) -> str:
    return _RANK.replace("{0}", x)


def _percentile(x: str, part: str = "qid") -> str:
    """Ascending mid-rank percentile; a query's only candidate has 0."""
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) - 1 + CAST(count(*) OVER (PARTITION BY {part}, {x}) - 1 AS DOUBLE) / 2) / greatest(count(*) OVER (PARTITION BY {part}) - 1, 1)"


def _reciprocal(scores: str, x: str = "s", key: str = "qid") -> str:
    """Tie-neutral reciprocal rank of candidate 0 per query, from rows with pos and a score."""
    return f"""SELECT {key}, CAST(1 AS DOUBLE) / (1 + count(CASE WHEN x > p THEN 1 END) + CAST(count(CASE WHEN x = p AND pos > 0 THEN 1 END) AS DOUBLE) / 2) AS rr,
        1 + count(CASE WHEN x > p THEN 1 END) AS low, 1 + count(CASE WHEN x > p THEN 1 END) + CAST(count(CASE WHEN x = p AND pos > 0 THEN 1 END) AS DOUBLE) / 2 AS mid
        FROM (SELECT {key}, pos, {x} AS x, max(CASE WHEN pos = 0 THEN {x} END) OVER (PARTITION BY {key}) AS p FROM {scores}) rr_in GROUP BY {key}"""


_AUC = """SELECT {key}(sum(CASE WHEN pos = 0 THEN r END) - CAST(count(CASE WHEN pos = 0 THEN 1 END) AS DOUBLE) * (count(CASE WHEN pos = 0 THEN 1 END) + 1) / 2) / (CAST(count(CASE WHEN pos = 0 THEN 1 END) AS DOUBLE) * count(CASE WHEN pos > 0 THEN 1 END)) AS auc"""

_SEGMENT_INPUTS = ("c1_c8_candidate_stats", "d1_d5_candidate_prior", "e1_pair_decay")
_SEGMENTS = """SELECT c.qid, round(avg(CASE WHEN pair_strength > 0 THEN 1e0 ELSE 0e0 END), 6) AS repeat_candidate_fraction, round(max(pair_strength), 6) AS repeat_strength_max, round(max(repeat_rate), 6) AS repeat_rate_max,
          max(src_activity) AS source_activity, max(src_recency) AS source_recency, round(avg(CASE WHEN train_seen <= 0 THEN 1e0 ELSE 0e0 END), 6) AS target_unseen_fraction, round(avg(dst_popularity), 9) AS target_popularity_mean, round(max(dst_popularity), 6) AS target_popularity_max,
          round(avg(test_freq), 12) AS prior_strength_mean, round(max(test_freq), 6) AS prior_strength_max, round(max(test_freq) - max(CASE WHEN k = 2 THEN test_freq END), 6) AS prior_strength_top_gap,
          round(avg(CASE WHEN recent_hit > 0 THEN 1e0 ELSE 0e0 END), 6) AS memory_recent_hit_fraction, round(max(recent_hit), 6) AS memory_recent_hit_max, round(max(decay_short), 6) AS memory_short_max, round(max(decay_long), 6) AS memory_long_max, round(max(decay_short) - max(decay_long), 6) AS memory_short_minus_long
        FROM ({}) c JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY test_freq DESC, pos) AS k FROM ({}) x) d ON d.qid = c.qid AND d.pos = c.pos JOIN ({}) e ON e.qid = c.qid AND e.pos = c.pos GROUP BY c.qid"""


QUERIES = {
    "h1_average_rank": S("H1", f"SELECT qid, pos, {_avg_rank('r')} AS avg_rank FROM {{sc}}",
        "SELECT a.qid, a.pos, count(*) FILTER (b.r > a.r) + (count(*) FILTER (b.r = a.r) + 1) / 2 AS avg_rank FROM {sc} a JOIN {sc} b ON b.qid = a.qid GROUP BY a.qid, a.pos"),
    "h2_percentile": S("H2", f"SELECT qid, pos, round({_percentile('r')}, 9) AS percentile FROM {{sc}}",
        "SELECT a.qid, a.pos, round((count(*) FILTER (b.r < a.r) + (count(*) FILTER (b.r = a.r) - 1) / 2) / 19, 9) AS percentile FROM {sc} a JOIN {sc} b ON b.qid = a.qid GROUP BY a.qid, a.pos"),
    "h3_tolerant_percentile": S("H3", """WITH a AS (SELECT qid, pos, s, CASE WHEN s - lag(s) OVER (PARTITION BY qid ORDER BY s, pos) <= 0.0015 THEN 0 ELSE 1 END AS step FROM {sc}),
        b AS (SELECT qid, pos, s, sum(step) OVER (PARTITION BY qid ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM a)
        SELECT qid, pos, round((rank() OVER (PARTITION BY qid ORDER BY g) - 1 + CAST(count(*) OVER (PARTITION BY qid, g) - 1 AS DOUBLE) / 2) / greatest(count(*) OVER (PARTITION BY qid) - 1, 1), 9) AS percentile FROM b"""),
    "h4_setwise_context": S("H4", f"""WITH m AS (SELECT qid, PCTL(s, 0.5) AS med FROM {{sc}} GROUP BY qid), d AS (SELECT sc.qid, max(m.med) AS med, PCTL(abs(sc.s - m.med), 0.5) AS mad FROM {{sc}} sc JOIN m ON m.qid = sc.qid GROUP BY sc.qid)
        SELECT sc.qid, sc.pos, sc.s, round(s - avg(s) OVER (PARTITION BY sc.qid), 9) AS off_mean, round(s - max(s) OVER (PARTITION BY sc.qid), 9) AS off_max, round({_percentile('s', 'sc.qid')}, 9) AS percentile, round(CASE WHEN d.mad * 1.4826 <= 1e-6 THEN 0.0 ELSE (s - d.med) / (d.mad * 1.4826) END, 6) AS z FROM {{sc}} sc JOIN d ON d.qid = sc.qid""",
        """WITH d AS (SELECT qid, median(s) AS med, mad(s) AS mad, avg(s) AS mean, max(s) AS best, list(s) AS l FROM {sc} GROUP BY qid)
        SELECT sc.qid, sc.pos, sc.s, round(s - mean, 9) AS off_mean, round(s - best, 9) AS off_max, round((len(list_filter(l, lambda x: x < s)) + (len(list_filter(l, lambda x: x = s)) - 1) / 2) / 19, 9) AS percentile, round(CASE WHEN d.mad * 1.4826 <= 1e-6 THEN 0 ELSE (s - med) / (d.mad * 1.4826) END, 6) AS z FROM {sc} sc JOIN d USING (qid)"""),
    "h5_robust_z": S("H5", """WITH m AS (SELECT qid, PCTL(s, 0.5) AS med FROM {sc} GROUP BY qid), d AS (SELECT sc.qid, PCTL(abs(sc.s - m.med), 0.5) AS mad FROM {sc} sc JOIN m ON m.qid = sc.qid GROUP BY sc.qid)
        SELECT sc.qid, sc.pos, round(CASE WHEN d.mad * 1.4826 <= 1e-6 THEN 0.0 ELSE (sc.s - m.med) / (d.mad * 1.4826) END, 6) AS z FROM {sc} sc JOIN m ON m.qid = sc.qid JOIN d ON d.qid = sc.qid""",
        "SELECT sc.qid, pos, round(CASE WHEN m * 1.4826 <= 1e-6 THEN 0 ELSE (s - med) / (m * 1.4826) END, 6) AS z FROM {sc} sc JOIN (SELECT qid, median(s) AS med, mad(s) AS m FROM {sc} GROUP BY qid) x USING (qid)"),
    "h6_min_max": S("H6", "SELECT qid, pos, round(CASE WHEN max(r) OVER w > min(r) OVER w THEN (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) ELSE 0.0 END, 9) AS x FROM {sc} WINDOW w AS (PARTITION BY qid)"),
    "h7_softmax": S("H7", """SELECT qid, pos, round(e1 / sum(e1) OVER (PARTITION BY qid), 9) AS softmax, round(e2 / sum(e2) OVER (PARTITION BY qid), 9) AS tempered
        FROM (SELECT qid, pos, exp(s - m) AS e1, exp((s - m) / 0.5) AS e2 FROM (SELECT qid, pos, s, max(s) OVER (PARTITION BY qid) AS m FROM {sc}) x) y""",
        "SELECT qid, pos, round(exp(s) / sum(exp(s)) OVER (PARTITION BY qid), 9) AS softmax, round(exp(2 * s) / sum(exp(2 * s)) OVER (PARTITION BY qid), 9) AS tempered FROM {sc}"),
    "h8_rank_probabilities": S("H8", f"SELECT qid, pos, round(p / sum(p) OVER (PARTITION BY qid), 9) AS p FROM (SELECT qid, pos, {_percentile('r')} AS p FROM {{sc}}) x"),
    "h9_uniform_rank_average": S("H9", """SELECT qid, pos, round(CAST(a + b + c AS DOUBLE) / 3 / greatest(k - 1, 1), 9) AS x FROM (SELECT qid, pos, count(*) OVER (PARTITION BY qid) AS k, row_number() OVER (PARTITION BY qid ORDER BY s, pos) - 1 AS a, row_number() OVER (PARTITION BY qid ORDER BY r, pos) - 1 AS b, row_number() OVER (PARTITION BY qid ORDER BY u, pos) - 1 AS c FROM {sc}) y"""),
    "h10_expert_features": S("H10", f"""WITH f AS (SELECT expert, qid, pos, {_percentile('s', 'expert, qid')} AS pct, s - max(s) OVER (PARTITION BY expert, qid) AS margin, CASE WHEN s = max(s) OVER (PARTITION BY expert, qid) THEN 1 ELSE 0 END AS top FROM {{ex}})
        SELECT qid, pos, round(avg(pct), 6) AS pct_mean, round(stddev_pop(pct), 6) AS pct_std, round(min(margin), 6) AS margin_min, count(CASE WHEN top = 1 THEN 1 END) AS top_votes, round(max(pct) - min(pct), 6) AS pct_gap FROM f GROUP BY qid, pos"""),
    "h11_segments": S("H11", _SEGMENTS.format(*(TEMPORAL[n].sql for n in _SEGMENT_INPUTS)), _SEGMENTS.format(*(TEMPORAL[n].oracle for n in _SEGMENT_INPUTS))),
    "h12_score_descriptors": S("H12", """WITH p AS (SELECT qid, pos, s / sum(s) OVER (PARTITION BY qid) AS p, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS k FROM {sc})
        SELECT qid, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END) / ln(greatest(CAST(count(*) AS DOUBLE), 2)), 6) AS entropy, round(sum(CASE WHEN k <= 3 THEN p ELSE 0.0 END), 6) AS top3, round(sum(CASE WHEN k <= 5 THEN p ELSE 0.0 END), 6) AS top5, round(max(CASE WHEN k = 1 THEN p END) - max(CASE WHEN k = 2 THEN p END), 6) AS margin FROM p GROUP BY qid"""),
    "h13_top_overlap": S("H13", """WITH m AS (SELECT qid, pos, s >= max(CASE WHEN ks = 5 THEN s END) OVER (PARTITION BY qid) AS a, r >= max(CASE WHEN kr = 5 THEN r END) OVER (PARTITION BY qid) AS b
          FROM (SELECT qid, pos, s, r, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS kr FROM {sc}) x)
        SELECT qid, count(CASE WHEN a AND b THEN 1 END) AS both_top, round(CAST(count(CASE WHEN a AND b THEN 1 END) AS DOUBLE) / greatest(count(CASE WHEN a OR b THEN 1 END), 1), 6) AS jaccard FROM m GROUP BY qid"""),
    "h14_disagreement": S("H14", """WITH k AS (SELECT qid, pos, s, r, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS kr FROM {sc})
        SELECT qid, round(avg(CASE WHEN kr <= 5 THEN CAST(ks AS DOUBLE) END), 6) AS rank_of_others_top, round(max(CASE WHEN ks = 1 THEN s - r END), 6) AS own_preference, round(avg(abs(s - r)), 6) AS mean_diff, round(max(abs(s - r)), 6) AS max_diff FROM k GROUP BY qid"""),
    "h15_top_deltas": S("H15", """WITH k AS (SELECT qid, pos, u, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS kr FROM {sc})
        SELECT qid, round(max(CASE WHEN ks = 1 THEN u END) - max(CASE WHEN kr = 1 THEN u END), 6) AS u_delta FROM k GROUP BY qid"""),
    "h16_row_norms": S("H16", "SELECT qid, round(sum(s * r) / greatest(sqrt(sum(s * s)) * sqrt(sum(r * r)), 1e-12), 6) AS cosine, round(sqrt(sum((s - r) * (s - r))), 6) AS l2, round(sqrt(avg((s - r) * (s - r))), 6) AS rms FROM {sc} GROUP BY qid"),
    "h17_top_mask": S("H17", "SELECT qid, pos, k = 1 AS is_top, k <= 5 AS in_top5 FROM (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS k FROM {sc}) x"),
    "h18_tie_break": S("H18", "SELECT qid, pos, CAST(row_number() OVER (PARTITION BY qid ORDER BY r DESC, u DESC, c, pos) AS BIGINT) AS place FROM {sc}"),
    "h19_clip": S("H19", "SELECT qid, pos, greatest(least(s * 2 - 0.5, 1e0), 0e0) AS p FROM {sc}"),
    "h20_neutralise": S("H20", "SELECT qid, pos, 0e0 AS neutral, round(avg(s) OVER (PARTITION BY qid), 9) AS replaced FROM {sc}"),
    # I: blends
    "i1_blend": S("I1", f"""WITH b AS (SELECT qid, pos, 0.6 * s + 0.4 * r AS prob, 0.6 / (60 + {_avg_rank('s')}) + 0.4 / (60 + {_avg_rank('r')}) AS rrf FROM {{sc}})
        SELECT qid, pos, round(prob / sum(prob) OVER (PARTITION BY qid), 9) AS probability, round(rrf / sum(rrf) OVER (PARTITION BY qid), 9) AS rrf FROM b"""),
    # Queries whose lists of differences to their best score are equal count as one, with their number; temperatures meet lists, not rows.
    "i2_temperature": S("I2", """WITH m AS (SELECT qid, max(s) AS m, max(CASE WHEN pos = 0 THEN s END) AS s0, sort_array(collect_list(s)) AS l FROM {sc} GROUP BY qid),
        c AS (SELECT d0, d, count(*) AS n FROM (SELECT s0 - m AS d0, transform(l, x -> x - m) AS d FROM m) x GROUP BY d0, d),
        e AS (SELECT k, tau, n, d0 / tau - ln(aggregate(d, 0e0, (a, x) -> a + exp(x / tau))) AS ll FROM (SELECT d0, d, n, k, 0.05e0 * power(400e0, CAST(k AS DOUBLE) / 160) AS tau FROM (SELECT d0, d, n, explode(sequence(0, 160)) AS k FROM c) x) y),
        n AS (SELECT k, max(tau) AS tau, round(-sum(n * ll) / sum(CASE WHEN ll IS NOT NULL THEN n END), 6) AS nll FROM e GROUP BY k) SELECT CAST(k AS BIGINT) AS k, round(tau, 6) AS tau, nll, k = (SELECT min(k) FROM n WHERE nll = (SELECT min(nll) FROM n)) AS chosen FROM n""",
        """WITH e AS (SELECT k, qid, max(tau) AS tau, (max(CASE WHEN pos = 0 THEN s END) - max(s)) / max(tau) - ln(sum(exp((s - m) / tau))) AS ll FROM (SELECT qid, pos, s, m, k, 0.05e0 * power(400e0, CAST(k AS DOUBLE) / 160) AS tau FROM (SELECT qid, pos, s, max(s) OVER (PARTITION BY qid) AS m, EACH(0, 160)) AS k FROM {sc}) x) y GROUP BY k, qid),
        n AS (SELECT k, max(tau) AS tau, round(-avg(ll), 6) AS nll FROM e GROUP BY k) SELECT CAST(k AS BIGINT) AS k, round(tau, 6) AS tau, nll, k = (SELECT min(k) FROM n WHERE nll = (SELECT min(nll) FROM n)) AS chosen FROM n"""),
    "i3_weight_scan": S("I3 I8", f"""WITH g AS (SELECT w, qid, pos, round(w * 0.1 * s + (1 - w * 0.1) * r, 9) AS x FROM (SELECT qid, pos, s, r, EACH(0, 10)) AS w FROM {{sc}}) y)
        SELECT CAST(w AS BIGINT) AS w, round(avg(rr), 6) AS mrr FROM ({_reciprocal('g', 'x', 'w, qid')}) z GROUP BY w"""),
    "i4_prefix_selection": S("I4", f"""WITH g AS (SELECT w, qid, pos, round(w * 0.1 * s + (1 - w * 0.1) * r, 9) AS x FROM (SELECT qid, pos, s, r, EACH(0, 10)) AS w FROM {{sc}}) y),
        rr AS (SELECT w, qid, rr FROM ({_reciprocal('g', 'x', 'w, qid')}) z), cut AS (SELECT CAST(floor((min(qid) + max(qid)) / 2) AS BIGINT) AS c FROM rr),
        m AS (SELECT w, round(avg(CASE WHEN qid < c THEN rr END), 6) AS early, round(avg(CASE WHEN qid >= c THEN rr END), 6) AS late FROM rr CROSS JOIN cut GROUP BY w)
        SELECT CAST(w AS BIGINT) AS w, early, late FROM (SELECT w, early, late, row_number() OVER (ORDER BY early DESC, w DESC) AS k FROM m) y WHERE k = 1"""),
    "i5_subset_ensembles": S("I5 I11", f"""WITH m AS (SELECT mask, qid, pos, round(avg(s), 9) AS x FROM (SELECT mask, qid, pos, s, expert FROM (SELECT expert, qid, pos, s, EACH(1, 7)) AS mask FROM {{ex}}) y WHERE CAST(floor(mask / power(2, expert - 1)) AS BIGINT) % 2 = 1) z GROUP BY mask, qid, pos)
        SELECT CAST(mask AS BIGINT) AS mask, round(avg(rr), 6) AS mrr FROM ({_reciprocal('m', 'x', 'mask, qid')}) y GROUP BY mask"""),
    "i6_i7_time_weights": S("I6 I7", """SELECT qid, round(power(greatest(least(CAST(t - lo AS DOUBLE) / greatest(hi - lo, 1), 1e0), 0e0), 2), 6) AS ramp, round(power(2e0, -CAST(hi - t AS DOUBLE) / 86400) / avg(power(2e0, -CAST(hi - t AS DOUBLE) / 86400)) OVER (PARTITION BY one), 6) AS recency
        FROM (SELECT q.qid, q.t, x.lo, x.hi, 1 AS one FROM {q} q CROSS JOIN (SELECT min(t) AS lo, max(t) AS hi FROM {q}) x WHERE q.pos = 0) y"""),
    "i9_oracle_weight": S("I9", f"""WITH g AS (SELECT w, qid, pos, round(w * 0.1 * s + (1 - w * 0.1) * r, 9) AS x FROM (SELECT qid, pos, s, r, EACH(0, 10)) AS w FROM {{sc}}) y),
        rr AS (SELECT w, qid, round(rr, 9) AS rr FROM ({_reciprocal('g', 'x', 'w, qid')}) z)
        SELECT qid, CAST(w AS BIGINT) AS w, rr FROM (SELECT qid, w, rr, row_number() OVER (PARTITION BY qid ORDER BY rr DESC, abs(w - 5), w) AS k FROM rr) x WHERE k = 1"""),
    "i10_i12_aux_blend": S("I10 I12", f"SELECT qid, pos, round(0.85 * s + 0.15 * u, 9) AS lift_blend, round(0.7 * p + 0.3 * {_percentile('r')}, 9) AS listwise FROM (SELECT qid, pos, s, r, u, s / sum(s) OVER (PARTITION BY qid) AS p FROM {{sc}}) x"),
    "i13_dual_horizon": S("I13", f"""WITH rr AS (SELECT qid, rr FROM ({_reciprocal('{sc}', 's')}) a), br AS (SELECT qid, rr FROM ({_reciprocal('{sc}', 'r')}) a), h AS (SELECT rr.qid, rr.rr - br.rr AS d, ntile(2) OVER (ORDER BY rr.qid) AS half FROM rr JOIN br ON br.qid = rr.qid)
        SELECT CAST(half AS BIGINT) AS half, round(avg(d), 6) AS gain, avg(d) >= 0 AS passes FROM h GROUP BY half"""),
    # J: routing
    "j1_disagreement_signal": S("J1", f"""WITH p AS (SELECT expert, qid, pos, {_percentile('s', 'expert, qid')} AS pct, row_number() OVER (PARTITION BY expert, qid ORDER BY s DESC, pos) AS k FROM {{ex}})
        SELECT qid, pos, round(avg(pct) - 0.15 * stddev_pop(pct), 6) AS signal, round(CAST(count(CASE WHEN k = 1 THEN 1 END) AS DOUBLE) / 3, 6) AS votes FROM p GROUP BY qid, pos"""),
    "j2_consensus": S("J2", f"SELECT qid, pos, round((a + b) / 2, 6) AS consensus, round(a - b, 6) AS gap FROM (SELECT qid, pos, {_percentile('s')} AS a, {_percentile('r')} AS b FROM {{sc}}) x"),
    "j3_proposal": S("J3 J5", """WITH k AS (SELECT qid, pos, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, u FROM {sc}), i AS (SELECT qid, pos, s, ks, row_number() OVER (PARTITION BY qid ORDER BY u DESC, pos) AS ku FROM k WHERE ks <= 5)
        SELECT k.qid, k.pos, coalesce(v.s, k.s) AS s FROM k LEFT JOIN i ON i.qid = k.qid AND i.pos = k.pos LEFT JOIN i v ON v.qid = i.qid AND v.ks = i.ku"""),
    "j4_j9_router_features": S("J4 J9", """WITH p AS (SELECT qid, pos, s, r, u, s / sum(s) OVER (PARTITION BY qid) AS ps, r / sum(r) OVER (PARTITION BY qid) AS pr, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS kr FROM {sc})
        SELECT qid, round(max(CASE WHEN ks = 1 THEN s END) - max(CASE WHEN ks = 2 THEN s END), 6) AS margin_s, round(max(CASE WHEN kr = 1 THEN r END) - max(CASE WHEN kr = 2 THEN r END), 6) AS margin_r, round(sum(abs(s - r)), 6) AS l1, count(CASE WHEN ks <= 5 AND kr <= 5 THEN 1 END) AS shared_top, bool_or(ks = 1 AND kr = 1) AS same_top,
          round(-sum(CASE WHEN ps > 0 THEN ps * ln(ps) ELSE 0e0 END), 6) AS entropy_s, round(-sum(CASE WHEN pr > 0 THEN pr * ln(pr) ELSE 0e0 END), 6) AS entropy_r, max(CASE WHEN ks = 1 THEN kr END) AS rank_of_top_s, max(CASE WHEN kr = 1 THEN ks END) AS rank_of_top_r,
          round(max(CASE WHEN ks = 1 THEN u END) - max(CASE WHEN kr = 1 THEN u END), 6) AS prior_delta, round(max(abs(s - r)), 6) AS most_apart, round(avg(CASE WHEN ks <= 5 THEN abs(ks - kr) * 1e0 END), 6) AS moved_top FROM p GROUP BY qid"""),
    "j6_pair_weights": S("J6", """WITH k AS (SELECT qid, pos, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS k FROM {sc})
        SELECT n.qid, n.pos, round(abs(CAST(1 AS DOUBLE) / p.k - CAST(1 AS DOUBLE) / n.k), 6) AS weight, round(ln(1 + exp(n.s - p.s)), 6) AS loss FROM k n JOIN k p ON p.qid = n.qid AND p.pos = 0 WHERE n.pos > 0"""),
    "j7_quota_route": S("J7", """WITH c AS (SELECT qid, round(max(s) - avg(s), 9) AS conf FROM {sc} GROUP BY qid), n AS (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) AS quota FROM c),
        b AS (SELECT conf, count(*) AS m FROM c GROUP BY conf), cum AS (SELECT conf, sum(m) OVER (ORDER BY conf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b)
        SELECT c.qid, c.conf, coalesce(cum.above, 0) + row_number() OVER (PARTITION BY c.conf ORDER BY c.qid) <= n.quota AND c.conf >= 0.1 AS routed FROM c JOIN cum ON cum.conf = c.conf CROSS JOIN n"""),
    "j8_bounded_residual": S("J8", "SELECT qid, pos, round(s + CASE WHEN k <= 5 THEN 0.1 * tanh(u - avg(CASE WHEN k <= 5 THEN u END) OVER (PARTITION BY qid)) ELSE 0.0 END, 6) AS x FROM (SELECT qid, pos, s, u, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS k FROM {sc}) y"),
    "j10_j11_utility_route": S("J10 J11", f"""WITH a AS (SELECT qid, rr FROM ({_reciprocal('{sc}', 's')}) x), b AS (SELECT qid, rr FROM ({_reciprocal('{sc}', 'r')}) x), c AS (SELECT qid, rr FROM ({_reciprocal('{sc}', 'u')}) x)
        SELECT a.qid, round(b.rr - a.rr, 6) AS lift_b, round(c.rr - a.rr, 6) AS lift_c, CASE WHEN greatest(b.rr, c.rr) - a.rr < 0.05 THEN 'default' WHEN b.rr >= c.rr THEN 'b' ELSE 'c' END AS route FROM a JOIN b ON b.qid = a.qid JOIN c ON c.qid = a.qid"""),
    "j12_audit": S("J12", "SELECT bool_and(abs(x - s) <= 0.1) AS within_cap, bool_and(k <= 5 OR x = s) AS exact_outside, count(*) AS n FROM (SELECT s, k, CASE WHEN k <= 5 THEN s + 0.1 * (u - 0.5) ELSE s END AS x FROM (SELECT s, u, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS k FROM {sc}) y) z"),
    "j13_bounded_alternative": S("J13", """WITH k AS (SELECT qid, pos, s, r, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS k FROM {sc}), d AS (SELECT qid, pos, s, k, (r - s) - avg(CASE WHEN k <= 5 THEN r - s END) OVER (PARTITION BY qid) AS d FROM k),
        c AS (SELECT qid, pos, s, k, d, max(CASE WHEN k <= 5 THEN abs(d) END) OVER (PARTITION BY qid) AS most FROM d)
        SELECT qid, pos, round(s + CASE WHEN k <= 5 THEN d * least(1e0, 0.05 / greatest(most, 1e-12)) ELSE 0.0 END, 6) AS x FROM c"""),
    "j14_two_way_route": S("J14", """WITH a AS (SELECT qid, round(avg(r) - avg(s), 9) AS a, round(avg(u) - avg(s), 9) AS b FROM {sc} GROUP BY qid) SELECT qid, greatest(a, b) AS best, round(greatest(a, b) - greatest(least(a, b), 0), 9) AS confidence, greatest(a, b) > 0 AND greatest(a, b) - greatest(least(a, b), 0) >= 0.02 AS eligible FROM a"""),
    "j15_route_rewards": S("J15", f"SELECT a.qid, round(b.rr - a.rr, 6) AS reward FROM ({_reciprocal('{sc}', 's')}) a JOIN ({_reciprocal('{sc}', 'r')}) b ON b.qid = a.qid"),
    # K: metrics
    "k1_k2_mrr": S("K1 K2", f"SELECT round(avg(CAST(1 AS DOUBLE) / low), 6) AS optimistic, round(avg(rr), 6) AS tie_neutral FROM ({_reciprocal('{sc}', 'r')}) x",
        "SELECT round(avg(1 / low), 6) AS optimistic, round(avg(1 / (low + tied / 2)), 6) AS tie_neutral FROM (SELECT p.qid, (SELECT count(*) FROM {sc} o WHERE o.qid = p.qid AND o.r > p.r) + 1 AS low, (SELECT count(*) FROM {sc} o WHERE o.qid = p.qid AND o.r = p.r AND o.pos > 0) AS tied FROM {sc} p WHERE p.pos = 0) x"),
    "k3_hits": S("K3", f"""SELECT round(avg(CASE WHEN mid <= 1 THEN 1e0 ELSE 0e0 END), 6) AS hit1, round(avg(CASE WHEN mid <= 3 THEN 1e0 ELSE 0e0 END), 6) AS hit3, round(avg(CASE WHEN mid <= 10 THEN 1e0 ELSE 0e0 END), 6) AS hit10,
        round(avg(CASE WHEN mid <= 10 THEN ln(2e0) / ln(mid + 1) ELSE 0.0 END), 6) AS ndcg10, round(avg(mid), 6) AS mean_rank FROM ({_reciprocal('{sc}', 'r')}) x""",
        "SELECT round(avg((low + tied / 2 <= 1)::INT), 6) AS hit1, round(avg((low + tied / 2 <= 3)::INT), 6) AS hit3, round(avg((low + tied / 2 <= 10)::INT), 6) AS hit10, round(avg(CASE WHEN low + tied / 2 <= 10 THEN 1 / log2(low + tied / 2 + 1) ELSE 0 END), 6) AS ndcg10, round(avg(low + tied / 2), 6) AS mean_rank FROM (SELECT p.qid, (SELECT count(*) FROM {sc} o WHERE o.qid = p.qid AND o.r > p.r) + 1 AS low, (SELECT count(*) FROM {sc} o WHERE o.qid = p.qid AND o.r = p.r AND o.pos > 0) AS tied FROM {sc} p WHERE p.pos = 0) x"),
    "k4_movements": S("K4", f"SELECT count(CASE WHEN b.rr > a.rr THEN 1 END) AS improved, count(CASE WHEN b.rr = a.rr THEN 1 END) AS unchanged, count(CASE WHEN b.rr < a.rr THEN 1 END) AS worsened FROM ({_reciprocal('{sc}', 's')}) a JOIN ({_reciprocal('{sc}', 'r')}) b ON b.qid = a.qid",
        """WITH x AS (SELECT p.qid, (SELECT sum((o.s > p.s)::INT + (o.s = p.s)::INT / 2) FROM {sc} o WHERE o.qid = p.qid) AS a, (SELECT sum((o.r > p.r)::INT + (o.r = p.r)::INT / 2) FROM {sc} o WHERE o.qid = p.qid) AS b FROM {sc} p WHERE p.pos = 0)
        SELECT count(*) FILTER (b < a) AS improved, count(*) FILTER (b = a) AS unchanged, count(*) FILTER (b > a) AS worsened FROM x"""),
    "k5_slices": S("K5", f"SELECT CAST(third AS BIGINT) AS third, count(*) AS n, round(avg(rr), 6) AS mrr FROM (SELECT rr, ntile(3) OVER (ORDER BY qid) AS third FROM ({_reciprocal('{sc}', 's')}) x) y GROUP BY third"),
    "k6_auc_ap": S("K6", """WITH v AS (SELECT r AS x, count(*) AS n, count(CASE WHEN pos = 0 THEN 1 END) AS p FROM {sc} GROUP BY r),
        c AS (SELECT x, n, p, sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below, sum(n) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken, sum(p) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hit FROM v), t AS (SELECT sum(n) AS n, sum(p) AS p FROM v)
        SELECT round((sum(c.p * (below + (c.n + 1) / 2e0)) - max(t.p) * (max(t.p) + 1) / 2e0) / (CAST(max(t.p) AS DOUBLE) * (max(t.n) - max(t.p))), 6) AS auc, round(sum(CAST(c.p AS DOUBLE) / t.p * (CAST(hit AS DOUBLE) / taken)), 6) AS average_precision FROM c CROSS JOIN t""",
        """WITH v AS (SELECT r AS x, count(*) AS n, count(*) FILTER (pos = 0) AS p FROM {sc} GROUP BY r), pairs AS (SELECT sum(a.p * (b.n - b.p) * CASE WHEN a.x > b.x THEN 1 WHEN a.x = b.x THEN 0.5e0 ELSE 0 END) / (sum(a.p) * sum(b.n - b.p) / count(DISTINCT a.x) / count(DISTINCT b.x)) AS auc FROM v a, v b)
        SELECT round((SELECT auc FROM pairs), 6) AS auc, round(sum(a.p * (SELECT sum(b.p) / sum(b.n) FROM v b WHERE b.x >= a.x)) / sum(a.p), 6) AS average_precision FROM v a"""),
    "k7_strict": S("K7", f"SELECT round(avg(CASE WHEN mid = 1 THEN 1e0 ELSE 0e0 END), 6) AS strict_hit1, PCTL(mid, 0.5) AS median_rank FROM ({_reciprocal('{sc}', 'r')}) x",
        "SELECT round(avg((low = 1 AND tied = 0)::INT), 6) AS strict_hit1, median(low + tied / 2) AS median_rank FROM (SELECT p.qid, (SELECT count(*) FROM {sc} o WHERE o.qid = p.qid AND o.r > p.r) + 1 AS low, (SELECT count(*) FROM {sc} o WHERE o.qid = p.qid AND o.r = p.r AND o.pos > 0) AS tied FROM {sc} p WHERE p.pos = 0) x"),
    "k8_new_links": S("K8", f"""WITH x AS (SELECT a.rr, e.src IS NOT NULL AS seen, q.qid, s.gap FROM ({_reciprocal('{sc}', 's')}) a JOIN {{q}} q ON q.qid = a.qid AND q.pos = 0 LEFT JOIN (SELECT DISTINCT src, dst FROM {{train}}) e ON e.src = q.src AND e.dst = q.c
          JOIN (SELECT qid, max(s) - max(CASE WHEN pos = 0 THEN s END) AS gap FROM {{sc}} GROUP BY qid) s ON s.qid = a.qid), t AS (SELECT sum(1 - rr) AS regret, avg(rr) AS mrr FROM x)
        SELECT seen, count(*) AS n, round(avg(rr), 6) AS mrr, round(sum(1 - rr), 6) AS regret, round(sum(1 - rr) / max(t.regret), 6) AS regret_share, round(avg(gap), 6) AS score_gap, round(avg(rr) - max(t.mrr), 6) AS mrr_gap FROM x CROSS JOIN t GROUP BY seen"""),
    "k9_rank_quantiles": S("K9", f"""WITH r AS (SELECT mid, row_number() OVER (ORDER BY mid, qid) AS k, count(*) OVER (PARTITION BY one) AS n FROM (SELECT qid, mid, 1 AS one FROM ({_reciprocal('{sc}', 'r')}) x) y)
        SELECT max(CASE WHEN k = ceil(0.5 * (n - 1)) + 1 THEN mid END) AS p50, max(CASE WHEN k = ceil(0.9 * (n - 1)) + 1 THEN mid END) AS p90, max(CASE WHEN k = ceil(0.99 * (n - 1)) + 1 THEN mid END) AS p99 FROM r"""),
    # Quartiles of queries by the activity of their source go by how many sources' counts lie below.
    "k10_spearman": S("K10", f"""WITH x AS (SELECT qid, pos, {_avg_rank('s')} AS a, {_avg_rank('u')} AS b, {_percentile('s')} AS p FROM {{sc}}), n AS (SELECT q.qid, count(e.src) AS n FROM {{q}} q LEFT JOIN {{train}} e ON e.src = q.src WHERE q.pos = 0 GROUP BY q.qid),
        c AS (SELECT n, count(*) AS m FROM n GROUP BY n), t AS (SELECT n, sum(m) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS below FROM c), g AS (SELECT n.qid, least(CAST(floor(t.below * 4e0 / (SELECT count(*) FROM n)) AS BIGINT), 3) AS quartile FROM n JOIN t ON t.n = n.n)
        SELECT g.quartile, count(DISTINCT x.qid) AS n_queries, round(corr(a, b), 6) AS spearman, round(avg(CASE WHEN pos = 0 THEN p END), 6) AS positive_percentile, round(count(DISTINCT x.qid) * (1 - avg(CASE WHEN pos = 0 THEN p END)), 6) AS priority FROM x JOIN g ON g.qid = x.qid GROUP BY g.quartile""",
        """WITH x AS (SELECT a.qid, a.pos, count(*) FILTER (b.s > a.s) + count(*) FILTER (b.s = a.s) / 2 AS x, count(*) FILTER (b.u > a.u) + count(*) FILTER (b.u = a.u) / 2 AS y, (count(*) FILTER (b.s < a.s) + (count(*) FILTER (b.s = a.s) - 1) / 2) / 19 AS p FROM {sc} a JOIN {sc} b ON b.qid = a.qid GROUP BY a.qid, a.pos),
        n AS (SELECT qid, (SELECT count(*) FROM {train} e WHERE e.src = q.src) AS n FROM {q} q WHERE pos = 0), g AS (SELECT qid, least((SELECT count(*) FROM n o WHERE o.n < n.n) * 4 // (SELECT count(*) FROM n), 3) AS quartile FROM n)
        SELECT quartile, count(DISTINCT qid) AS n_queries, round(corr(x, y), 6) AS spearman, round(avg(p) FILTER (pos = 0), 6) AS positive_percentile, round(count(DISTINCT qid) * (1 - avg(p) FILTER (pos = 0)), 6) AS priority FROM x JOIN g USING (qid) GROUP BY quartile"""),
    "k11_k12_gates": S("K11 K12", f"""WITH m AS (SELECT 's' AS model, avg(rr) AS mrr, min(rr) AS worst FROM ({_reciprocal('{sc}', 's')}) x UNION ALL SELECT 'r', avg(rr), min(rr) FROM ({_reciprocal('{sc}', 'r')}) x UNION ALL SELECT 'u', avg(rr), min(rr) FROM ({_reciprocal('{sc}', 'u')}) x)
        SELECT model, round(mrr, 6) AS mrr, mrr + 1e-15 >= (SELECT avg(mrr) FROM m) AS passes, CAST(row_number() OVER (ORDER BY worst DESC, mrr DESC, model) AS BIGINT) AS place FROM m"""),
    "k13_comparison": S("K13", f"""WITH a AS (SELECT qid, rr, ntile(3) OVER (ORDER BY qid) AS third FROM ({_reciprocal('{sc}', 's')}) x) SELECT CAST(third AS BIGINT) AS third, round(avg(a.rr), 6) AS baseline, round(avg(b.rr), 6) AS candidate, round(avg(b.rr - a.rr), 6) AS delta FROM a JOIN ({_reciprocal('{sc}', 'u')}) b ON b.qid = a.qid GROUP BY third"""),
    # L: splits
    "l1_l2_split": S("L1 L2", """WITH b AS (SELECT n, greatest(2, n - greatest(1, CAST(floor(n * 0.15) AS BIGINT))) AS train_end FROM {span}), c AS (SELECT n, train_end, CAST(floor(train_end * 0.75) AS BIGINT) AS context_end FROM b)
        SELECT ix.seq, CASE WHEN seq < context_end THEN 'context' WHEN seq < train_end THEN 'train' ELSE 'val' END AS part FROM {ix} ix CROSS JOIN c"""),
    "l3_l8_folds": S("L3 L4 L8", """WITH f AS (SELECT ix.t, ix.seq, CAST(floor(n * 0.4) AS BIGINT) AS b1, CAST(floor(n * 0.6) AS BIGINT) AS b2, CAST(floor(n * 0.8) AS BIGINT) AS b3 FROM {ix} ix CROSS JOIN {span} sp),
        snap AS (SELECT min(CASE WHEN g.seq = f.b1 THEN f.first_seq END) AS s1, min(CASE WHEN g.seq = f.b2 THEN f.first_seq END) AS s2, min(CASE WHEN g.seq = f.b3 THEN f.first_seq END) AS s3
                 FROM (SELECT t, min(seq) AS first_seq, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3 FROM f GROUP BY t) f JOIN {ix} g ON g.t = f.t)
        SELECT ix.seq, CASE WHEN seq < s1 THEN 0 WHEN seq < s2 THEN 1 WHEN seq < s3 THEN 2 ELSE 3 END AS fold FROM {ix} ix CROSS JOIN snap"""),
    "l5_rolling_origin": S("L5", """SELECT CAST(k AS BIGINT) AS fold, CASE WHEN k < 4 THEN 'selection' ELSE 'gate' END AS role, count(CASE WHEN seq < lo THEN 1 END) AS n_train, count(CASE WHEN seq >= lo THEN 1 END) AS n_score
        FROM (SELECT ix.seq, g.k, CAST(floor(n * (0.4 + 0.1 * g.k)) AS BIGINT) AS lo, CAST(floor(n * (0.5 + 0.1 * g.k)) AS BIGINT) AS hi, CAST(floor(n * 0.1 * g.k) AS BIGINT) AS start FROM {ix} ix CROSS JOIN (SELECT n, EACH(1, 5)) AS k FROM {span}) g) x WHERE seq >= start AND seq < hi GROUP BY k"""),
    "l6_contiguous_folds": S("L6", "SELECT qid, CAST(ntile(5) OVER (ORDER BY qid) AS BIGINT) AS fold FROM (SELECT DISTINCT qid FROM {q}) x"),
    "l7_multi_horizon": S("L7", """WITH f AS (SELECT qid, CAST(ntile(4) OVER (ORDER BY qid) AS BIGINT) AS fold FROM (SELECT DISTINCT qid FROM {q}) x), s AS (SELECT fold, count(*) AS n FROM f GROUP BY fold)
        SELECT o.fold AS origin, t.fold AS target, CASE t.fold - o.fold WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS horizon, t.n FROM s o JOIN s t ON t.fold - o.fold BETWEEN 0 AND 2"""),
    # M: sampling
    "m3_pool_membership": S("M3", "SELECT q.qid, q.pos, p.dst IS NOT NULL AS in_pool FROM {q} q LEFT JOIN (SELECT dst FROM {train} GROUP BY dst HAVING count(*) >= 80) p ON p.dst = q.c"),
    "m4_candidate_weights": S("M4", "SELECT c, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY one), 9) AS w FROM (SELECT c, count(*) AS n, 1 AS one FROM {q} GROUP BY c) x"),
    "m5_test_like_rows": S("M5", "SELECT a.qid, b.qid AS donor FROM (SELECT qid, src, row_number() OVER (PARTITION BY src ORDER BY qid) AS k, count(*) OVER (PARTITION BY src) AS n FROM {q} WHERE pos = 0) a JOIN (SELECT qid, src, row_number() OVER (PARTITION BY src ORDER BY qid) AS k FROM {q} WHERE pos = 0) b ON b.src = a.src AND b.k = a.k % a.n + 1"),
    "m6_in_batch_mask": S("M6", "SELECT a.qid AS qid, b.qid AS other, a.c <> b.c AS usable FROM (SELECT qid, c, CAST(floor(qid / 64) AS BIGINT) AS batch FROM {q} WHERE pos = 0) a JOIN (SELECT qid, c, CAST(floor(qid / 64) AS BIGINT) AS batch FROM {q} WHERE pos = 0) b ON b.batch = a.batch AND b.qid <> a.qid"),
    "m7_supervised_rows": S("M7", "SELECT qid, pos, c, pos = 0 AS positive FROM {sc}"),
    # N: reports
    # The share of the most popular hundredth goes by how many destinations have each count, so no window runs over all destinations.
    "n1_n2_profile": S("N1 N2", """WITH p AS (SELECT DISTINCT src, dst FROM {train}), i AS (SELECT dst, count(*) AS n FROM {train} GROUP BY dst), e AS (SELECT CAST(ceil(count(*) * 0.01) AS BIGINT) AS most, sum(n) AS total FROM i),
        c AS (SELECT n, count(*) AS m FROM i GROUP BY n), r AS (SELECT n, m, coalesce(sum(m) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c),
        top AS (SELECT CAST(sum(r.n * greatest(least(r.m, e.most - r.above), 0)) AS DOUBLE) / max(e.total) AS share FROM r CROSS JOIN e),
        h AS (SELECT avg(CASE WHEN p.src IS NULL THEN 0e0 ELSE 1e0 END) AS pair_hit FROM {q} q LEFT JOIN p ON p.src = q.src AND p.dst = q.c WHERE q.pos = 0), un AS (SELECT avg(CASE WHEN i.dst IS NULL THEN 1e0 ELSE 0e0 END) AS unseen FROM {q} q LEFT JOIN i ON i.dst = q.c), hist AS (SELECT PCTL(n, 0.9) AS p90 FROM (SELECT src, count(*) AS n FROM {train} GROUP BY src) x)
        SELECT round(pair_hit, 6) AS pair_hit, round(1 - pair_hit, 6) AS new_pair, round(unseen, 6) AS unseen, p90, round(share, 6) AS top_share, CASE WHEN pair_hit >= 0.25 AND unseen <= 0.2 THEN 'repeat_memory' WHEN pair_hit < 0.1 AND unseen >= 0.3 THEN 'new_link_cold' ELSE 'balanced' END AS strategy FROM h CROSS JOIN un CROSS JOIN hist CROSS JOIN top""",
        """WITH i AS (SELECT dst, count(*) AS n FROM {train} GROUP BY dst), v AS (SELECT * FROM {q})
        SELECT round(hit, 6) AS pair_hit, round(1 - hit, 6) AS new_pair, round(un, 6) AS unseen, p90, round(share, 6) AS top_share, CASE WHEN hit >= 0.25 AND un <= 0.2 THEN 'repeat_memory' WHEN hit < 0.1 AND un >= 0.3 THEN 'new_link_cold' ELSE 'balanced' END AS strategy FROM
          (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM {train} e WHERE e.src = v.src AND e.dst = v.c) THEN 1e0 ELSE 0e0 END) AS hit FROM v WHERE pos = 0) a, (SELECT avg(CASE WHEN c IN (SELECT dst FROM i) THEN 0e0 ELSE 1e0 END) AS un FROM v) b,
          (SELECT quantile_cont(n, 0.9) AS p90 FROM (SELECT count(*) AS n FROM {train} GROUP BY src) x) c, (SELECT sum(n) / (SELECT sum(n) FROM i) AS share FROM (SELECT n FROM i ORDER BY n DESC LIMIT (SELECT CAST(ceil(count(*) * 0.01) AS BIGINT) FROM i)) y) d"""),
    "n3_basic_stats": S("N3", """WITH d AS (SELECT dst, count(*) AS n FROM {ix} GROUP BY dst), c AS (SELECT n, count(*) AS m FROM d GROUP BY n),
        g AS (SELECT n, m, coalesce(sum(m) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), b AS (SELECT count(*) AS n_both FROM (SELECT DISTINCT src AS v FROM {ix}) s JOIN d ON d.dst = s.v)
        SELECT (SELECT count(*) FROM {ix}) AS edges, (SELECT count(DISTINCT src) FROM {ix}) AS n_src, (SELECT count(*) FROM d) AS n_dst, (SELECT n_both FROM b) AS n_both, round(1 - (SELECT CAST(count(*) AS DOUBLE) FROM {firsts}) / (SELECT count(*) FROM {ix}), 6) AS duplicate_rate,
          (SELECT round(2 * sum(CAST(n AS DOUBLE) * (m * below + m * (m + 1) / 2e0)) / (sum(m) * CAST(sum(n * m) AS DOUBLE)) - CAST(sum(m) + 1 AS DOUBLE) / sum(m), 6) FROM g) AS gini, (SELECT PCTL(n, 0.5) FROM d) AS median_degree, (SELECT PCTL(n, 0.9) FROM d) AS p90_degree, (SELECT PCTL(n, 0.99) FROM d) AS p99_degree""",
        """WITH d AS (SELECT dst, count(*) AS n, row_number() OVER (ORDER BY count(*), dst) AS k FROM {ix} GROUP BY dst)
        SELECT (SELECT count(*) FROM {ix}) AS edges, (SELECT count(DISTINCT src) FROM {ix}) AS n_src, count(*) AS n_dst, (SELECT count(DISTINCT src) FROM {ix} WHERE src IN (SELECT dst FROM {ix})) AS n_both, (SELECT round(1 - count(DISTINCT (src, dst)) / count(*), 6) FROM {ix}) AS duplicate_rate,
          round(2 * sum(k * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, quantile_cont(n, 0.5) AS median_degree, quantile_cont(n, 0.9) AS p90_degree, quantile_cont(n, 0.99) AS p99_degree FROM d"""),
    # Buckets are tenths of the file order. A pair is recent if at most so many events of its source lie since.
    "n4_drift": S("N4", """WITH b AS (SELECT ix.src, ix.dst, ix.seq, CAST(floor(CAST(ix.seq AS DOUBLE) * 10 / sp.n) AS BIGINT) AS bucket FROM {ix} ix CROSS JOIN {span} sp),
        k AS (SELECT bucket, src, dst, seq, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS kp, row_number() OVER (PARTITION BY src ORDER BY seq) AS ks, row_number() OVER (PARTITION BY dst ORDER BY seq) AS kd FROM b),
        f AS (SELECT bucket, dst, kp, ks, kd, ks - lag(ks) OVER (PARTITION BY src, dst ORDER BY seq) AS back FROM k),
        r AS (SELECT bucket, count(*) AS n, avg(CASE WHEN kp > 1 THEN 1e0 ELSE 0e0 END) AS pair_seen, avg(CASE WHEN ks > 1 THEN 1e0 ELSE 0e0 END) AS src_seen, avg(CASE WHEN kd > 1 THEN 1e0 ELSE 0e0 END) AS dst_seen, avg(CASE WHEN back <= 1 THEN 1e0 ELSE 0e0 END) AS recent1,
          avg(CASE WHEN back <= 5 THEN 1e0 ELSE 0e0 END) AS recent5, avg(CASE WHEN back <= 10 THEN 1e0 ELSE 0e0 END) AS recent10, avg(CASE WHEN back <= 32 THEN 1e0 ELSE 0e0 END) AS recent32 FROM f GROUP BY bucket),
        p AS (SELECT bucket, dst, count(*) AS n FROM b GROUP BY bucket, dst), t AS (SELECT bucket, dst, n, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, dst) AS k FROM p),
        top AS (SELECT bucket, count(*) AS n_dst, sum(CASE WHEN k <= 10 THEN n ELSE 0 END) AS n10, count(CASE WHEN k <= 50 THEN 1 END) AS m FROM t GROUP BY bucket),
        same AS (SELECT x.bucket, count(*) AS both_top FROM t x JOIN t y ON y.bucket = x.bucket - 1 AND y.dst = x.dst WHERE x.k <= 50 AND y.k <= 50 GROUP BY x.bucket)
        SELECT r.bucket, r.n, round(pair_seen, 6) AS pair_seen, round(src_seen, 6) AS src_seen, round(dst_seen, 6) AS dst_seen, round(recent1, 6) AS recent1, round(recent5, 6) AS recent5, round(recent10, 6) AS recent10, round(recent32, 6) AS recent32, top.n_dst,
          round(CAST(top.n10 AS DOUBLE) / r.n, 6) AS top10_share, round(CAST(coalesce(same.both_top, 0) AS DOUBLE) / greatest(top.m + coalesce(before.m, 0) - coalesce(same.both_top, 0), 1), 6) AS top_jaccard
        FROM r JOIN top ON top.bucket = r.bucket LEFT JOIN top before ON before.bucket = r.bucket - 1 LEFT JOIN same ON same.bucket = r.bucket""",
        """WITH b AS (SELECT ix.*, ix.seq * 10 // sp.n AS bucket FROM {ix} ix, {span} sp), o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq) AS ks FROM b),
        f AS (SELECT o.bucket, o.seq, max(p.ks) AS last, any_value(o.ks) AS ks, count(p.seq) AS earlier FROM o LEFT JOIN o p ON p.src = o.src AND p.dst = o.dst AND p.seq < o.seq GROUP BY o.bucket, o.seq),
        d AS (SELECT b.bucket, avg(CASE WHEN first.s < b.seq THEN 1e0 ELSE 0e0 END) AS dst_seen, count(DISTINCT b.dst) AS n_dst FROM b JOIN (SELECT dst, min(seq) AS s FROM b GROUP BY dst) first USING (dst) GROUP BY b.bucket),
        s AS (SELECT bucket, list(dst ORDER BY n DESC, dst)[:50] AS top, list_sum(list(n ORDER BY n DESC, dst)[:10]) AS n10, sum(n) AS n FROM (SELECT bucket, dst, count(*) AS n FROM b GROUP BY bucket, dst) x GROUP BY bucket)
        SELECT f.bucket, count(*) AS n, round(avg(CASE WHEN earlier > 0 THEN 1e0 ELSE 0e0 END), 6) AS pair_seen, round(avg(CASE WHEN ks > 1 THEN 1e0 ELSE 0e0 END), 6) AS src_seen, round(any_value(d.dst_seen), 6) AS dst_seen,
          round(avg(CASE WHEN ks - last <= 1 THEN 1e0 ELSE 0e0 END), 6) AS recent1, round(avg(CASE WHEN ks - last <= 5 THEN 1e0 ELSE 0e0 END), 6) AS recent5, round(avg(CASE WHEN ks - last <= 10 THEN 1e0 ELSE 0e0 END), 6) AS recent10, round(avg(CASE WHEN ks - last <= 32 THEN 1e0 ELSE 0e0 END), 6) AS recent32,
          any_value(d.n_dst) AS n_dst, round(any_value(s.n10 / s.n), 6) AS top10_share, round(any_value(coalesce(len(list_intersect(s.top, y.top)), 0) / greatest(len(s.top) + coalesce(len(y.top), 0) - coalesce(len(list_intersect(s.top, y.top)), 0), 1)), 6) AS top_jaccard
        FROM f JOIN d ON d.bucket = f.bucket JOIN s ON s.bucket = f.bucket LEFT JOIN s y ON y.bucket = f.bucket - 1 GROUP BY f.bucket"""),
    "n5_candidates": S("N5", """WITH i AS (SELECT dst, count(*) AS n FROM {train} GROUP BY dst), c AS (SELECT n, count(*) AS m FROM i GROUP BY n), above AS (SELECT n, coalesce(sum(m) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c),
        pop AS (SELECT i.dst, a.above + row_number() OVER (PARTITION BY i.n ORDER BY i.dst) AS k FROM i JOIN above a ON a.n = i.n), p AS (SELECT DISTINCT src, dst FROM {train}),
        late AS (SELECT DISTINCT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY t DESC, seq DESC) AS k FROM {train}) x WHERE k <= 32),
        r AS (SELECT q.qid, avg(CASE WHEN pop.dst IS NULL THEN 0e0 ELSE 1e0 END) AS known, avg(CASE WHEN pop.k <= 10 THEN 1e0 ELSE 0e0 END) AS top10, avg(CASE WHEN pop.k <= 100 THEN 1e0 ELSE 0e0 END) AS top100, avg(CASE WHEN pop.k <= 1000 THEN 1e0 ELSE 0e0 END) AS top1000,
            avg(CASE WHEN p.src IS NULL THEN 0e0 ELSE 1e0 END) AS pair_hit, avg(CASE WHEN late.src IS NULL THEN 0e0 ELSE 1e0 END) AS recent32
          FROM {q} q LEFT JOIN pop ON pop.dst = q.c LEFT JOIN p ON p.src = q.src AND p.dst = q.c LEFT JOIN late ON late.src = q.src AND late.dst = q.c GROUP BY q.qid)
        SELECT round(avg(known), 6) AS known, round(1 - avg(known), 6) AS unseen, round(avg(top10), 6) AS top10, round(avg(top100), 6) AS top100, round(avg(top1000), 6) AS top1000, round(avg(pair_hit), 6) AS pair_hit, round(avg(recent32), 6) AS recent32,
          round(PCTL(pair_hit, 0.1), 6) AS p10_hit, round(PCTL(pair_hit, 0.5), 6) AS p50_hit, round(PCTL(pair_hit, 0.9), 6) AS p90_hit, round(PCTL(recent32, 0.5), 6) AS p50_recent, round(PCTL(top10, 0.9), 6) AS p90_top10 FROM r""",
        """WITH pop AS (SELECT dst, row_number() OVER (ORDER BY count(*) DESC, dst) AS k FROM {train} GROUP BY dst), late AS (SELECT src, list(dst ORDER BY t DESC, seq DESC)[:32] AS l, list(dst) AS a FROM {train} GROUP BY src),
        r AS (SELECT q.qid, avg((pop.dst IS NOT NULL)::INT) AS known, avg((coalesce(pop.k, 1000000) <= 10)::INT) AS top10, avg((coalesce(pop.k, 1000000) <= 100)::INT) AS top100, avg((coalesce(pop.k, 1000000) <= 1000)::INT) AS top1000,
          avg(coalesce(list_contains(late.a, q.c), FALSE)::INT) AS pair_hit, avg(coalesce(list_contains(late.l, q.c), FALSE)::INT) AS recent32 FROM {q} q LEFT JOIN pop ON pop.dst = q.c LEFT JOIN late ON late.src = q.src GROUP BY q.qid)
        SELECT round(avg(known), 6) AS known, round(1 - avg(known), 6) AS unseen, round(avg(top10), 6) AS top10, round(avg(top100), 6) AS top100, round(avg(top1000), 6) AS top1000, round(avg(pair_hit), 6) AS pair_hit, round(avg(recent32), 6) AS recent32,
          round(quantile_cont(pair_hit, 0.1), 6) AS p10_hit, round(quantile_cont(pair_hit, 0.5), 6) AS p50_hit, round(quantile_cont(pair_hit, 0.9), 6) AS p90_hit, round(quantile_cont(recent32, 0.5), 6) AS p50_recent, round(quantile_cont(top10, 0.9), 6) AS p90_top10 FROM r"""),
    "n6_unseen": S("N6", "SELECT count(*) AS n, count(DISTINCT q.c) AS n_ids, min(q.c) AS lo, max(q.c) AS hi FROM {q} q LEFT JOIN (SELECT DISTINCT dst FROM {train}) i ON i.dst = q.c WHERE i.dst IS NULL"),
    # Quantiles of whole seconds go by how often each gap occurs.
    "n8_sequences": S("N8", """WITH g AS (SELECT t - lag(t) OVER (PARTITION BY src ORDER BY t, seq) AS gap, t - lag(t) OVER (PARTITION BY src, dst ORDER BY t, seq) AS repeat_gap FROM {ix}), a AS (SELECT gap, count(*) AS n FROM g GROUP BY gap), b AS (SELECT repeat_gap, count(*) AS n FROM g GROUP BY repeat_gap), h AS (SELECT count(*) AS n FROM {ix} GROUP BY src)
        SELECT (SELECT percentile(gap, 0.5, n) FROM a) AS median_gap, (SELECT percentile(gap, 0.9, n) FROM a) AS p90_gap, (SELECT percentile(repeat_gap, 0.5, n) FROM b) AS median_repeat_gap, (SELECT sum(n) FROM b WHERE repeat_gap IS NOT NULL) AS n_repeats, (SELECT PCTL(n, 0.5) FROM h) AS median_history, (SELECT PCTL(n, 0.9) FROM h) AS p90_history, (SELECT max(n) FROM h) AS longest_history""",
        """WITH g AS (SELECT b.t - a.t AS gap FROM {num} a JOIN {num} b ON b.src = a.src AND b.k = a.k + 1), r AS (SELECT b.t - max_by(a.t, a.k) AS gap FROM {num} b JOIN {num} a ON a.src = b.src AND a.dst = b.dst AND a.k < b.k GROUP BY b.src, b.k, b.t), h AS (SELECT count(*) AS n FROM {ix} GROUP BY src)
        SELECT (SELECT quantile_cont(gap, 0.5) FROM g) AS median_gap, (SELECT quantile_cont(gap, 0.9) FROM g) AS p90_gap, (SELECT quantile_cont(gap, 0.5) FROM r) AS median_repeat_gap, (SELECT count(*) FROM r) AS n_repeats, (SELECT quantile_cont(n, 0.5) FROM h) AS median_history, (SELECT quantile_cont(n, 0.9) FROM h) AS p90_history, (SELECT max(n) FROM h) AS longest_history"""),
    # Eight segments: by the popularity of the true destination, the activity of the source, whether the pair is known, and the hour.
    "n9_segments": S("N9", f"""WITH f AS (SELECT q.qid, q.t, coalesce(d.n, 0) AS nd, coalesce(s.n, 0) AS ns, p.src IS NOT NULL AS known FROM {{q}} q LEFT JOIN (SELECT dst, count(*) AS n FROM {{train}} GROUP BY dst) d ON d.dst = q.c LEFT JOIN (SELECT src, count(*) AS n FROM {{train}} GROUP BY src) s ON s.src = q.src LEFT JOIN (SELECT DISTINCT src, dst FROM {{train}}) p ON p.src = q.src AND p.dst = q.c WHERE q.pos = 0),
        m AS (SELECT avg(nd) AS d, avg(ns) AS s FROM f), g AS (SELECT qid, 'popular' AS segment FROM f CROSS JOIN m WHERE nd >= m.d UNION ALL SELECT qid, 'rare' FROM f CROSS JOIN m WHERE nd < m.d UNION ALL SELECT qid, 'active' FROM f CROSS JOIN m WHERE ns >= m.s UNION ALL SELECT qid, 'quiet' FROM f CROSS JOIN m WHERE ns < m.s
          UNION ALL SELECT qid, 'repeat' FROM f WHERE known UNION ALL SELECT qid, 'new' FROM f WHERE NOT known UNION ALL SELECT qid, 'first_half_of_day' FROM f WHERE t % 86400 < 43200 UNION ALL SELECT qid, 'second_half_of_day' FROM f WHERE t % 86400 >= 43200),
        rr AS (SELECT g.segment, count(*) AS n, avg(x.rr) AS mrr FROM ({_reciprocal('{sc}', 's')}) x JOIN g ON g.qid = x.qid GROUP BY g.segment),
        v AS (SELECT g.segment, sc.s AS x, count(*) AS n, count(CASE WHEN pos = 0 THEN 1 END) AS p FROM {{sc}} sc JOIN g ON g.qid = sc.qid GROUP BY g.segment, sc.s),
        c AS (SELECT segment, x, n, p, sum(n) OVER (PARTITION BY segment ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below, sum(n) OVER (PARTITION BY segment ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken, sum(p) OVER (PARTITION BY segment ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hit FROM v)
        SELECT c.segment, max(rr.n) AS n, round(max(rr.mrr), 6) AS mrr, round((sum(c.p * (below + (c.n + 1) / 2e0)) - sum(c.p) * (sum(c.p) + 1) / 2e0) / (CAST(sum(c.p) AS DOUBLE) * (sum(c.n) - sum(c.p))), 6) AS auc, round(sum(c.p * (CAST(hit AS DOUBLE) / taken)) / sum(c.p), 6) AS average_precision FROM c JOIN rr ON rr.segment = c.segment GROUP BY c.segment"""),
    "n10_recent_proxy": S("N10", """WITH h AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY last_t DESC, dst) AS k FROM (SELECT src, dst, max(t) AS last_t FROM {train} GROUP BY src, dst) x)
        SELECT q.qid, q.pos, round(ln(1 + coalesce(sum(CAST(con.n AS DOUBLE) / h.k), 0)) / ln(1 + CAST(max(sp.n) AS DOUBLE)), 6) AS proxy FROM {q} q CROSS JOIN {span} sp LEFT JOIN h ON h.src = q.src AND h.k <= 16 LEFT JOIN {con} con ON con.a = h.dst AND con.b = q.c GROUP BY q.qid, q.pos"""),
    "n11_collapse": S("N11", "SELECT count(CASE WHEN s = 0 THEN 1 END) AS zero_cells, count(*) AS cells, (SELECT count(*) FROM (SELECT qid FROM {sc} GROUP BY qid HAVING min(r) = max(r)) x) AS constant_rows FROM {sc}"),
    "n12_distribution": S("N12", """WITH b AS (SELECT CAST(floor(s * 10) AS BIGINT) AS bin, count(*) AS n, avg(s) AS mean_s FROM {sc} GROUP BY CAST(floor(s * 10) AS BIGINT)), e AS (SELECT qid, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0e0 END) AS h FROM (SELECT qid, s / sum(s) OVER (PARTITION BY qid) AS p FROM {sc}) x GROUP BY qid)
        SELECT bin, n, round(mean_s, 6) AS mean_s, round((SELECT avg(h) FROM e), 6) AS mean_entropy FROM b""",
        """SELECT CAST(floor(s * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(s), 6) AS mean_s, (SELECT round(avg(h), 6) FROM (SELECT ln(sum(s)) - sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) / sum(s) AS h FROM {sc} GROUP BY qid) e) AS mean_entropy FROM {sc} GROUP BY 1"""),
    "n13_shift": S("N13", """WITH v AS (SELECT CAST(floor(x * 20) AS BIGINT) AS b, count(CASE WHEN k = 0 THEN 1 END) AS p, count(CASE WHEN k = 1 THEN 1 END) AS q FROM (SELECT s AS x, 0 AS k FROM {sc} UNION ALL SELECT u, 1 FROM {sc}) a GROUP BY CAST(floor(x * 20) AS BIGINT)),
        t AS (SELECT CAST(sum(p) AS DOUBLE) AS p, CAST(sum(q) AS DOUBLE) AS q FROM v), d AS (SELECT b, v.p / t.p AS p, v.q / t.q AS q FROM v CROSS JOIN t), c AS (SELECT p, q, abs(sum(p - q) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS gap FROM d),
        m AS (SELECT (avg(u) - avg(s)) / greatest(stddev_pop(s), 1e-12) AS shift FROM {sc}), n AS (SELECT avg(CASE WHEN i.dst IS NULL THEN 1e0 ELSE 0e0 END) AS unseen, avg(CASE WHEN q.pos = 0 THEN CASE WHEN i.dst IS NULL THEN 1e0 ELSE 0e0 END END) AS unseen_positive FROM {q} q LEFT JOIN (SELECT DISTINCT dst FROM {train}) i ON i.dst = q.c)
        SELECT round(max(gap), 6) AS ks, round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0.0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0.0 END) / 2, 6) AS js, round(max(m.shift), 6) AS standardised_mean, round(max(n.unseen - n.unseen_positive), 6) AS unseen_delta FROM c CROSS JOIN m CROSS JOIN n"""),
    "n14_time_support": S("N14", "SELECT count(DISTINCT t) AS n_times, min(t) AS lo, max(t) AS hi, round(CAST(count(*) AS DOUBLE) / count(DISTINCT t), 6) AS per_time FROM {ix}"),
    "n15_top_change": S("N15", "SELECT round(avg(CASE WHEN a <> b THEN 1e0 ELSE 0e0 END), 6) AS changed FROM (SELECT qid, max(CASE WHEN ks = 1 THEN pos END) AS a, max(CASE WHEN kr = 1 THEN pos END) AS b FROM (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS kr FROM {sc}) x GROUP BY qid) y"),
    "n16_behaviour": S("N16", f"""WITH a AS (SELECT src, count(*) AS n FROM {{train}} GROUP BY src) SELECT CASE WHEN a.n IS NULL THEN 'cold' WHEN a.n < 50 THEN 'light' ELSE 'heavy' END AS kind, count(*) AS n, round(avg(x.rr), 6) AS mrr, round(avg(CASE WHEN x.mid > 10 THEN 1e0 ELSE 0e0 END), 6) AS far_share FROM ({_reciprocal('{sc}', 's')}) x JOIN {{q}} q ON q.qid = x.qid AND q.pos = 0 LEFT JOIN a ON a.src = q.src GROUP BY CASE WHEN a.n IS NULL THEN 'cold' WHEN a.n < 50 THEN 'light' ELSE 'heavy' END"""),
    "n17_normaliser": S("N17", "SELECT round(avg(s), 6) AS mean_s, round(CASE WHEN stddev_pop(s) < 1e-6 THEN 1.0 ELSE stddev_pop(s) END, 6) AS std_s, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r FROM {sc}"),
    "n19_compare_outputs": S("N19", """WITH k AS (SELECT qid, pos, s, r, count(*) OVER (PARTITION BY qid) AS count_k, r / sum(r) OVER (PARTITION BY qid) AS p, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS ks, row_number() OVER (PARTITION BY qid ORDER BY r DESC, pos) AS kr FROM {sc}),
        g AS (SELECT qid, corr(s, r) AS corr_sr, avg(abs(ks - kr)) AS moved, count(CASE WHEN ks <= 5 AND kr <= 5 THEN 1 END) AS top5, max(CASE WHEN ks = 1 AND kr = 1 THEN 1 ELSE 0 END) AS top1, abs(sum(s) - sum(r)) AS sum_delta, abs(max(s) - max(r)) AS max_delta, sum(CASE WHEN p > 0 THEN ln(count_k * p) * p ELSE 0e0 END) / max(count_k) AS kl FROM k GROUP BY qid)
        SELECT round(avg(corr_sr), 6) AS corr_sr, round(avg(moved), 6) AS moved, round(avg(top5) / 5, 6) AS top5, round(avg(top1), 6) AS top1, round(avg(sum_delta), 6) AS sum_delta, round(avg(max_delta), 6) AS max_delta, round(avg(kl), 6) AS kl_cells FROM g"""),
    "n20_ties": S("N20", "SELECT count(CASE WHEN ties > 0 THEN 1 END) AS rows_with_ties, CAST(sum(ties) AS BIGINT) AS ties, max(ties) AS most FROM (SELECT qid, count(*) - count(DISTINCT r) AS ties FROM {sc} GROUP BY qid) x"),
    "n21_signatures": S("N21", """WITH g AS (SELECT d, CAST(floor(s * power(10, d) + 1e-6) AS BIGINT) AS a, CAST(floor(u * power(10, d) + 1e-6) AS BIGINT) AS b, CAST(floor(r * power(10, d) + 1e-6) AS BIGINT) AS c FROM (SELECT s, u, r, EACH(CAST(2 AS BIGINT), CAST(6 AS BIGINT))) AS d FROM {sc}) x),
        n AS (SELECT d, a, b, c, count(*) AS n FROM g GROUP BY d, a, b, c) SELECT d, count(*) AS n_groups, count(CASE WHEN n = 1 THEN 1 END) AS alone, max(n) AS largest, round(avg(n), 6) AS mean_n FROM n GROUP BY d"""),
}
