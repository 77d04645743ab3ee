"""List functions on one query with ties, against values worked out by hand."""

import pytest

from eventide.functions import lists

SCORES = [0.5, 0.2, 0.5, 0.9, 0.2]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: lists.average_rank("s", "qid"), [2.5, 4.5, 2.5, 1, 4.5]),
        (lambda: lists.percentile("s", "qid"), [0.625, 0.125, 0.625, 1, 0.125]),
        (lambda: lists.softmax("s", "qid"), [0.201067, 0.148954, 0.201067, 0.299957, 0.148954]),
        (lambda: lists.robust_z("s", "qid"), [0, -0.674491, 0, 0.899321, -0.674491]),
        (lambda: lists.min_max("s", "qid"), [0.428571, 0, 0.428571, 1, 0]),
    ],
)
def test_values(spark, column, want):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(SCORES)], "qid bigint, pos bigint, s double")
    got = [r.x for r in rows.select("pos", column().alias("x")).orderBy("pos").collect()]
    assert got == pytest.approx(want, abs=2e-6)


def test_reciprocal_ranks_and_place(spark):
    rows = spark.createDataFrame([(1, i, s, 0.1 * i, 9 - i) for i, s in enumerate(SCORES)], "qid bigint, pos bigint, s double, prior double, c bigint")
    r = lists.reciprocal_ranks(rows).first()
    assert (r.optimistic, round(r.tie_neutral, 6)) == (0.5, 0.4)
    got = [x.pos for x in rows.select("pos", lists.place("s", "prior", "c", "pos", "qid").alias("k")).orderBy("k").collect()]
    assert got == [3, 2, 0, 4, 1]
