"""Studies of thresholds: what sums and counts must give in any order."""

import random

from storepulse.operators import studies


def test_a_mean_that_is_the_threshold_is_not_over_it(spark):
    """Eight margins with the mean 0.45, whose sum as doubles is over 3.6 in this order, and not in others."""
    margins = [0.02, 0.53, 0.71, 0.82, 0.12, 0.23, 0.8, 0.37]
    for turn in range(4):
        rows = spark.createDataFrame([(1, "F", m) for m in margins], "person_id int, truth string, margin double").coalesce(1)
        got = {(r.how, r.delta): r.errors for r in studies.margin_sweep(rows, [0.45, 0.44]).collect()}
        assert got["mean", 0.45] == 0 and got["mean", 0.44] == 1
        random.Random(turn).shuffle(margins)
