"""Spans that can't meet the other side are left out before they are dealt over buckets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators.relational import overlap_join


@pytest.mark.parametrize("wide", [1, 40])
def test_only_spans_near_the_other_side_are_dealt(spark, wide):
    rng = random.Random(wide)
    a = [(i, x := rng.uniform(0, 100_000), x + rng.choice([0.2, 3, 60])) for i in range(3000)] + [(3000, 500.0, 500.0 + wide), (3001, 499.0, 500.0), (3002, -1.0, 1e6)]
    b = [(i, x := rng.uniform(500, 500 + wide), x + rng.choice([0.1, 1, 7])) for i in range(100)] + [(100, 500.0, 500.0 + wide)]
    left, right = spark.createDataFrame(a, "i int, al double, ah double"), spark.createDataFrame(b, "j int, bl double, bh double")
    found = overlap_join(left, right, ("al", "ah"), ("bl", "bh"), 1.0)
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, al, ah in a for j, bl, bh in b if al < bh and bl < ah)
    low, high = min(r[1] for r in b), max(r[2] for r in b)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"al#\d+ < {high}", plan) and re.search(rf"ah#\d+ > {low}", plan)  # below the buckets
    near = left.where((F.col("al") < high) & (F.col("ah") > low)).count()
    assert near < 200  # of 3003
