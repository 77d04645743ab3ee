"""The engine's operators against hand-computed values, loops and DuckDB."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from eventide.operators import asof, graph
from eventide.plans import registry
from eventide.plans.dialect import duck, frame
from eventide.sources import files

DATA = "/root/testdata/sf0.001"
TINY = [(1, 10, 5), (1, 20, 9), (2, 10, 9), (1, 10, 14), (3, 20, 14), (2, 30, 20), (1, 30, 26)]


def _log(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src bigint, dst bigint, t bigint, seq bigint")


def test_stats_features_by_hand(spark):
    got = {r.seq: r for r in asof.stats_features(_log(spark, TINY)).collect()}
    # The event (1, 10, 14): one earlier event with 10 of two; span 9 - 5, three events before.
    r = got[3]
    assert (r.pair_strength, r.repeat_rate, r.recent_hit) == (0.693147, 0.5, 0.5)
    assert r.pair_recency == round(math.exp(-9 / 4), 6) and r.dst_popularity == round(math.log(3) / math.log(4), 6)
    # An event at the same time is not seen.
    assert got[2].pair_strength == 0 and got[2].src_activity == 0 and got[2].dst_popularity == 1.0


def test_no_leakage(spark):
    early = {r.seq: r for r in asof.stats_features(_log(spark, TINY[:5])).collect()}
    late = {r.seq: r for r in asof.stats_features(_log(spark, TINY)).collect()}
    assert all(early[k] == late[k] for k in early)


def test_fifo_history(spark):
    def loop(rows, limit):
        out, held = [], {}
        for s, d, t in rows:
            h = held.setdefault(s, [])
            if d in h:
                continue
            out += [x for o in h for x in ((o, d, t), (d, o, t))]
            h.append(d)
            del h[:-limit]
        return sorted(out)

    rows = [(1, d, i) for i, d in enumerate([1, 2, 3, 4, 1, 5, 2, 2, 6, 1])] + [(2, d, i) for i, d in enumerate([3, 1, 3, 2])]
    for limit in (2, 3, 8):
        got = sorted(map(tuple, graph.fifo_cooccurrence(_log(spark, rows), limit).collect()))
        # The self-join on insertion numbers also holds pairs whose second insertion follows an expiry.
        assert got == loop(rows, limit), limit


def test_components(spark):
    got = {(r.role, r.node): r.component for r in graph.connected_components(_log(spark, [(5, 1, 0), (4, 1, 0), (4, 2, 0), (7, 3, 0)])).collect()}
    assert got == {("src", 4): 4, ("src", 5): 4, ("src", 7): 7, ("dst", 1): 4, ("dst", 2): 4, ("dst", 3): 7}


def test_spread_ties(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.2), (1, 4, 0.2)], "qid bigint, place bigint, s double")
    got = [r.s for r in graph.spread_ties(rows).orderBy("place").collect()]
    assert got[0] == 0.5 and got[2] == 0.2 and all(a > b for a, b in zip(got, got[1:], strict=False))


def test_files(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1/train.csv").write_text("extra,src,dst,time\n9,1,2,3\n9,4,5,6\n")
    names = ",".join(f"c{i}" for i in range(1, 101))
    (tmp_path / "d1/test.csv").write_text(f"src,time,{names}\n1,2,{','.join(map(str, range(100)))}\n")
    assert [p.rpartition("/")[2] for p in files.discover_datasets(spark, str(tmp_path))] == ["d1"]
    assert len(files.chosen(spark, str(tmp_path), ["d1"])) == 1 and files.chosen(spark, str(tmp_path), most=0) == []
    (tmp_path / "done/d1").mkdir(parents=True)
    (tmp_path / "done/d1/_SUCCESS").touch()
    assert files.chosen(spark, str(tmp_path), done=f"{tmp_path}/done") == []
    with pytest.raises(ValueError):
        files.chosen(spark, str(tmp_path), ["d9"])
    assert sorted(map(tuple, files.read_interactions(spark, f"{tmp_path}/d1/train.csv").collect())) == [(1, 2, 3), (4, 5, 6)]
    assert files.read_test_queries(spark, f"{tmp_path}/d1/test.csv").first().candidates == list(range(100))
    with pytest.raises(ValueError):
        files.read_test_queries(spark, f"{tmp_path}/d1/train.csv")
    scores = spark.createDataFrame([(q, p, 1 / (q + p + 1)) for q in range(3) for p in range(4)], "qid bigint, pos bigint, s double")
    files.write_probabilities(scores, f"{tmp_path}/out")
    lines = spark.read.text(f"{tmp_path}/out")
    assert sorted(float(x) for r in lines.collect() for x in r.value.split(",")) == sorted(1 / (q + p + 1) for q in range(3) for p in range(4))
    assert tuple(files.validate_probabilities(lines, 3, 4).first()) == (3, True, True, True)
    files.package({"a.csv": b"1"}, f"{tmp_path}/x.zip")
    assert files.verify_package(f"{tmp_path}/x.zip")
    with pytest.raises(FileExistsError):
        files.package({}, f"{tmp_path}/x.zip")


def test_statements_are_named_and_distinct():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert duck("SELECT * FROM {ix}").startswith("WITH ix AS (")


@pytest.mark.parametrize("name", ["b12_asof_join", "c1_c8_candidate_stats", "e2_e3_dst_unique_src", "h2_percentile", "k6_auc_ap", "n3_basic_stats"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    order = sorted(want.columns)
    same = lambda df: sorted(tuple(round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in row) for row in df[order].itertuples(index=False))
    assert same(got) == same(want)


def test_plan_shapes(spark, capsys):
    """Statistics share exchanges, and the top of a group is limited before the shuffle."""
    frame(spark, DATA, registry.STATEMENTS["b16_top_k"].sql).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_rankers(spark, tmp_path):
    from eventide.operators import learned

    rows = spark.createDataFrame([(q, p, float(p == 0) + (q * 7 + p * 3) % 5 / 10, (q + p) % 3 / 3.0, int(p == 0)) for q in range(40) for p in range(4)], "qid bigint, pos bigint, a double, b double, label int")
    best = learned.tune(rows, ["a", "b"])
    learned.save_model(best, f"{tmp_path}/m")
    got = {(r.qid, r.pos): r.s for r in learned.score(learned.load_model(f"{tmp_path}/m"), rows).collect()}
    assert all(got[q, 0] > got[q, p] for q in range(40) for p in (1, 2, 3))
    drop = {r.feature: r.gap for r in learned.permutation_importance(best, rows, ["a", "b"]).collect()}
    assert drop["none"] >= drop["a"] - 1e-9
    assert learned.leave_one_out(rows, ["a", "b"]) == [("a", "b"), ("b",), ("a",)]


def test_statements_on_own_frames(spark):
    """Queries of three and of one candidate, with other names for nothing: the statements take any frames of the right columns."""
    ix = _log(spark, TINY)
    q = spark.createDataFrame([(7, 0, 1, 30, 10), (7, 1, 1, 30, 20), (7, 2, 1, 30, 99), (8, 0, 4, 30, 30)], "qid bigint, pos bigint, src bigint, t bigint, c bigint")
    span = frame(spark, "", "SELECT min(t) AS min_t, max(t) AS max_t, greatest(max(t) - min(t), 1) AS span, count(*) AS n, max(seq) AS max_seq FROM {ix}", {"ix": ix})
    got = {(r.qid, r.pos): r for r in registry.STATEMENTS["f3_pair_times"].on(spark, ix=ix, q=q).collect()}
    assert [got[7, p].n for p in range(3)] == [2, 1, 0] and got[8, 0].n == 0
    got = {(r.qid, r.pos): r for r in registry.STATEMENTS["c1_c8_candidate_stats"].on(spark, ix=ix, q=q, span=span).collect()}
    assert (got[7, 0].pair_strength, got[7, 0].repeat_rate, got[7, 0].dst_popularity, got[7, 0].recent_hit) == (1.098612, 0.5, 0.666667, 0.5)
    scores = q.selectExpr("*", "double(pos) AS s", "double(-pos) AS r", "0D AS u")
    got = {(r.qid, r.pos): r.percentile for r in registry.STATEMENTS["h2_percentile"].on(spark, sc=scores).collect()}
    assert got == {(7, 0): 1.0, (7, 1): 0.5, (7, 2): 0.0, (8, 0): 0.0}


def test_reverse_pairs_do_not_multiply(spark):
    ix = _log(spark, [(1, 2, 1), (1, 2, 2), (1, 2, 3), (2, 1, 4)])
    q = spark.createDataFrame([(1, 0, 1, 9, 2)], "qid bigint, pos bigint, src bigint, t bigint, c bigint")
    (row,) = registry.STATEMENTS["f3_pair_times"].on(spark, ix=ix, q=q).collect()
    assert (row.n, row.n_reverse) == (3, 1)


def test_windows_reach_back_over_any_span(spark):
    """Events far apart: the widths follow the log's span."""
    ix = _log(spark, [(1, 5, 0), (2, 5, 40_000_000), (3, 6, 50_000_000), (1, 6, 99_000_000), (1, 5, 100_000_000)])
    q = spark.createDataFrame([(4, 0, 1, 100_000_000, 5), (4, 1, 1, 100_000_000, 6)], "qid bigint, pos bigint, src bigint, t bigint, c bigint")
    got = {r.pos: r for r in registry.STATEMENTS["d6_d8_target_windows"].on(spark, ix=ix, q=q).collect()}
    assert (got[0].share_w001, got[1].share_w001, got[0].share_w100, got[1].share_w100) == (0.0, 1.0, 0.5, 0.5)


def test_bounded_cooccurrence_of_a_wide_source(spark):
    """A source beyond the limit is walked through; pairs lie at most the limit apart."""
    put = graph.insertions(_log(spark, [(1, d, d) for d in range(20)] + [(2, 3, 1), (2, 4, 2)]), 5)
    assert sorted((r.src, r.dst, r.k) for r in put.collect()) == [(1, d, d) for d in range(20)] + [(2, 3, 0), (2, 4, 1)]
    assert graph.paired(put, 5).count() == 2 * (5 * 15 + 10 + 1)


def test_temperatures_meet_lists(spark):
    """Every temperature takes the queries' score lists, equal ones once, not every candidate's row."""
    scores = [[0.1, 0.9, 0.4], [0.9, 0.1, 0.4], [0.6, 0.6], [0.3]]
    rows = [(q, p, s) for q, x in enumerate(scores * 3) for p, s in enumerate(x)]
    got = registry.STATEMENTS["i2_temperature"].on(spark, sc=spark.createDataFrame(rows, "qid bigint, pos bigint, s double"))
    for r in got.collect():
        tau = 0.05 * 400 ** (r.k / 160)
        loss = [math.log(sum(math.exp((s - x[0]) / tau) for s in x)) for x in scores]
        assert abs(r.nll - sum(loss) / len(loss)) < 2e-6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [d0" in plan[plan.index("Generate") :]


def test_lift_counts_without_meeting_events(spark):
    """The last day is counted at bounds; no query row is joined with the events behind its bound."""
    rows = [(i % 3, i % 4, 1000 * i) for i in range(60)]
    got = registry.STATEMENTS["d9_d10_cooccur_lift"].on(spark, ix=_log(spark, rows))
    assert not re.search(r"\bt#\d+L > \(t#\d+L - 86400\)", got._jdf.queryExecution().optimizedPlan().toString())
    last = {(r.qid, r.pos): r for r in got.where("short_window_support = 1").collect()}
    end = rows[49][2]  # seq below floor(59 * 0.85) = 50
    for q in (51, 55):
        low, c = max(rows[q][2], end) - 86400, rows[q][1]
        n = sum(d == c and low < t < end for _, d, t in rows[:50])
        h = {d for s, d, t in rows[:50] if s == rows[q][0] and t < end}
        first = {}
        for s, d, t in rows:
            first.setdefault((s, d), t)
        m = sum(low < max(first[s, a], first[s, c]) < end for s in range(3) for a in h if a != c)
        assert abs(last[q, 0].lift_short - (math.log(1 + m) - math.log(1 + n))) < 2e-6


def test_draws_meet_candidates_by_query_and_place(spark):
    """A draw is worked out before the join; no draw meets all candidates of its place."""
    plan = entry.queries()["m1_m2_mixed_negatives"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "48271" in plan and not re.search(r"Join \w+, \(pos#\d+L = .*% 20\)\)", plan)


def test_two_hop_counts_without_meeting_pairs(spark):
    """The log is walked in order; no query is joined with the co-occurrences of its destinations, and ties in time, nulls and returning destinations count as by plain loops."""
    rows = [(i * 7 % 3, (i * i + i // 4) % 5, 100 * (i // 2)) for i in range(60)]
    q = [(k, p, s, t, c) for k, (s, t) in enumerate([(0, 900), (1, 3000), (2, 2900), (9, 3000), (0, 0)]) for p, c in enumerate([0, 1, 4, 77, None])]
    frames = dict(ix=_log(spark, rows), q=spark.createDataFrame(q, "qid bigint, pos bigint, src bigint, t bigint, c bigint"))
    got = registry.STATEMENTS["e16_two_hop_proxy"].on(spark, **frames)
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    first = {}
    for s, d, t in rows:
        first.setdefault((s, d), t)
    co = [(a, b, max(t, u)) for (s, a), t in first.items() for (r, b), u in first.items() if s == r and a != b]
    tau = rows[-1][2] * 0.05
    got = {(r.qid, r.pos): (r.raw, r.decayed) for r in got.collect()}
    assert len(got) == len(q)
    for k, p, s, t, c in q:
        met = [u for a, b, u in co if b == c and u < t and any(r == s and d == a and e < t for r, d, e in rows)]
        assert got[k, p][0] == len(met) and abs(got[k, p][1] - sum(math.exp((u - t) / tau) for u in met)) < 2e-5


def test_two_steps_are_walked(spark):
    """Paths of two steps by plain loops; no query is joined with the nodes in between."""
    rows = [(i * 7 % 3, (i * i + i // 4) % 5, 100 * (i // 2)) for i in range(60)]
    q = [(k, p, s, t, c) for k, (s, t) in enumerate([(0, 900), (1, 3000), (2, 2900), (9, 3000), (0, 0)]) for p, c in enumerate([0, 1, 4, 77, None])]
    got = registry.STATEMENTS["g13_hop2"].on(spark, ix=_log(spark, rows), q=spark.createDataFrame(q, "qid bigint, pos bigint, src bigint, t bigint, c bigint"))
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = lambda s, t: [d for r, d, u in rows if r == s and u < t]
    steps = [(a[1], b[1], b[2]) for s in range(3) for of in [[r for r in rows if r[0] == s]] for a, b in zip(of, of[1:], strict=False)]
    width = math.ceil(rows[-1][2] * 0.2)
    w = lambda a, b, t: sum(math.exp((u - t) / width) for x, y, u in steps if (x, y) == (a, b) and u < t)
    got = {(r.qid, r.pos): r.hop2 for r in got.collect()}
    assert len(got) == len(q)
    for k, p, s, t, c in q:
        z = own(s, t)[-1:]
        v = sum(w(a, c, t) + sum(w(a, m, t) * w(m, c, t) for m in set(own(a, t)[-64:])) for a in z)
        assert abs(got[k, p] - math.log(1 + v)) < 2e-5


def test_destination_views_meet_lists(spark):
    """Every earlier event of a query's destination by plain loops; queries meet lists of events, not events."""
    rows = [(i * 7 % 5, (i * i + i // 4) % 3, 100 * (i // 3)) for i in range(60)] + [(1, None, 5), (2, 0, None)]
    q = [(k, p, 0, t, c) for k, (t, c) in enumerate([(700, 0), (700, 0), (5000, 1), (0, 2), (100, 2), (900, 9), (900, None), (None, 1)]) for p in (0, 1)]
    frames = dict(ix=_log(spark, rows), q=spark.createDataFrame([*q, q[0]], "qid bigint, pos bigint, src bigint, t bigint, c bigint"))
    want = sorted((k, s, t, i) for k, p, _, at, c in [*q, q[0]] for i, (s, d, t) in enumerate(rows) if p == 0 and None not in (c, at, t) and d == c and t < at)
    for stretch in (1, 4, 4096):
        assert sorted(map(tuple, asof.destination_views(stretch=stretch, **frames).collect())) == want, stretch
    got = registry.STATEMENTS["f2_destination_view"].on(spark, **frames)
    assert sorted(map(tuple, got.collect())) == want
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()
