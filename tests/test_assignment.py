"""Shard assignment against a writer that takes one row at a time."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shardloom.operators.assignment import (
    LONG_AGO,
    Rollover,
    bucket_steps,
    check_limits,
    compose,
    number_rows,
    roll_shards,
    walk,
)
from shardloom.operators.attach import by_boundaries, by_sample_id
from shardloom.operators.ordering import bucket_digits, with_order
from shardloom.plans.prepare import assign_writers
from shardloom.session import stage


def one_by_one(sizes, rule):
    rows, shard, slot, held = [], -1, 0, 0
    for size in sizes:
        full = held >= rule.limit if rule.policy == "overshoot" else held + size > rule.limit
        if shard < 0 or full or (rule.max_rows is not None and slot >= rule.max_rows):
            shard, slot, held = shard + 1, 0, 0
        rows.append((shard, slot))
        slot, held = slot + 1, held + size
    return rows


rules = st.builds(Rollover, st.integers(1, 40), st.sampled_from(["overshoot", "fit"]),
                  st.one_of(st.none(), st.integers(1, 7)))


@settings(max_examples=400, deadline=None)
@given(sizes=st.lists(st.sampled_from([0, 1, 5, 5, 7, 30]), min_size=1, max_size=60), rule=rules,
       cuts=st.lists(st.integers(1, 59), max_size=8, unique=True), fan_in=st.integers(1, 4))
def test_buckets_chain_exactly(sizes, rule, cuts, fan_in):
    sizes = np.array(sizes)
    cum, pos = np.cumsum(sizes) - sizes, np.arange(len(sizes))
    edges = [0, *sorted(c for c in cuts if c < len(sizes)), len(sizes)]
    spans = [slice(a, b) for a, b in zip(edges, edges[1:])]
    steps = pd.DataFrame([{**bucket_steps(rule, cum[s], pos[s], sizes[s]), "part": n} for n, s in enumerate(spans)])
    ranges = pd.DataFrame([{**compose(rule, group), "part": n} for n, group in steps.groupby(steps.part // fan_in)])
    rows = []
    for outer in walk(rule, ranges, LONG_AGO, LONG_AGO, -1).itertuples():
        inner = steps[steps.part // fan_in == outer.part]
        for state in walk(rule, inner, outer.open_cum, outer.open_pos, outer.open_shard).itertuples():
            s = spans[state.part]
            shard, slot = number_rows(rule, cum[s], pos[s], sizes[s], state.open_cum, state.open_pos, state.open_shard)
            rows += list(zip(shard.tolist(), slot.tolist()))
    assert rows == one_by_one(sizes.tolist(), rule)


def test_equal_sizes_never_merge_chains():
    """The worst case for step functions: chains from different entries run in parallel for ever."""
    rule, sizes = Rollover(1000, "fit"), np.full(5000, 7)
    cum, pos = np.cumsum(sizes) - sizes, np.arange(5000)
    steps = bucket_steps(rule, cum, pos, sizes)
    assert len(steps["opened"]) <= 1000 // 7 + 1


@pytest.mark.parametrize("partitions", [1, 7, 64])
@pytest.mark.parametrize("digits, known", [(1, 400), (1, None), (2, None)])
def test_same_shards_for_any_partitioning(spark, partitions, digits, known):
    rule = Rollover(300, "overshoot", 9)
    table = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") * 37 % 101).alias("size"))
    rows = stage(with_order(table.repartition(partitions), digits=digits))
    rolled = roll_shards(rows, rule, ["order_key", "sample_id"], n_rows=known).orderBy("pos").collect()
    assert [r.pos for r in rolled] == list(range(400))
    assert [r.order_key for r in rolled] == sorted(r.order_key for r in rolled)
    assert [(r.shard, r.slot) for r in rolled] == one_by_one([r["size"] for r in rolled], rule)


@pytest.mark.parametrize("writers", [0, 3])
@pytest.mark.parametrize("rule", [Rollover(2000, "fit"), Rollover(900, "overshoot", 31)])
def test_composition_in_rounds(spark, writers, rule):
    """Small rows, so that steps are many: several rounds, and no group above its bound."""
    from shardloom.operators import assignment

    most, seen = 150, []
    table = spark.range(6000).select(F.col("id").alias("sample_id"), (F.col("id") * 37 % 5 + 38).alias("size"),
                                     (F.col("id") % max(writers, 1)).alias("writer"))
    group = ("writer",) if writers else ()

    def recording(steps, keys, max_steps, *rest):
        rounds, top = original(steps, keys, max_steps, *rest)
        for part in rounds:
            sums = part.groupBy(*keys, "group_no").agg(F.sum("n_steps").alias("n"), F.count(F.lit(1)).alias("parts"), F.max("n_steps").alias("m"))
            seen.append([(r.n, r.parts, r.m) for r in sums.collect()])
        return rounds, top

    original, assignment.compose_rounds = assignment.compose_rounds, recording
    try:
        rolled = roll_shards(stage(with_order(table, digits=2)), rule, ["order_key", "sample_id"], group=group,
                             max_steps=most).orderBy("writer", "pos").collect()
    finally:
        assignment.compose_rounds = original
    assert len(seen) >= 2
    assert all(n <= max(1.5 * most, 3 * m) for groups in seen for n, parts, m in groups)
    for w in range(max(writers, 1)):
        mine = [r for r in rolled if r.writer == w]
        assert [(r.shard, r.slot) for r in mine] == one_by_one([r["size"] for r in mine], rule)
    assert len(rolled) == 6000


def test_empty_and_single_row(spark):
    rule = Rollover(100, "fit")
    for n in (0, 1):
        table = spark.range(n).select(F.col("id").alias("sample_id"), F.lit(5000).cast("long").alias("size"))
        rolled = roll_shards(with_order(table), rule, ["order_key", "sample_id"]).collect()
        assert [(r.shard, r.slot) for r in rolled] == [(0, 0)] * n


def test_a_writer_with_most_rows_is_many_buckets(spark):
    table = spark.range(900).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") < 700, "a").otherwise("b").alias("file"),
        (F.col("id") % 23).alias("size"))
    rule = Rollover(60, "fit")
    assigned = assign_writers(table, F.when(F.col("file") == "a", 0).otherwise(1), F.col("file"), F.col("sample_id"),
                              F.col("size"), rule, buckets=20).orderBy("writer", "pos").collect()
    for writer, ids in ((0, range(700)), (1, range(700, 900))):
        mine = [r for r in assigned if r.writer == writer]
        assert [r.sample_id for r in mine] == list(ids)
        assert [(r.shard, r.slot) for r in mine] == one_by_one([r["size"] for r in mine], rule)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_payload_finds_its_shard_without_a_join_on_ids(spark, limit):
    table = spark.range(500).select(F.col("id").alias("sample_id"), (F.col("id") % 50 + 1).alias("size"))
    assigned = stage(roll_shards(stage(with_order(table, digits=2)), Rollover(40, "fit"), ["order_key", "sample_id"]))
    expected = {r.sample_id: r.shard for r in by_sample_id(table, assigned).collect()}
    found = by_boundaries(table, assigned, broadcast_limit=limit)
    assert {r.sample_id: r.shard for r in found.collect()} == expected and len(expected) == 500


def test_limits():
    with pytest.raises(ValueError):
        check_limits(10_000_000, 10_000)
    with pytest.raises(ValueError):
        check_limits(1 << 27, 1_000_000)
    check_limits(1 << 27, 10_000)
    with pytest.raises(ValueError):
        Rollover(0)
    with pytest.raises(ValueError):
        Rollover(1, "sideways")


def test_bucket_digits_follow_the_rows():
    assert [bucket_digits(n) for n in (0, 1_000_000, 20_000_000, 1_000_000_000, 10**13)] == [1, 1, 2, 3, 6]
