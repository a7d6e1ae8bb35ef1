"""Shard assignment.

A size-bounded writer opens a new shard when the open one is full, so where a shard starts depends on where
the one before it started. That chain is resolved exactly, and in parallel, over buckets of the global order:

1. each bucket reduces to a step function: "if the shard open on entry started at byte b, row p, then the
   shard open on exit started at (b', p') and k shards were opened in between". Chains from different entries
   soon meet, so a bucket of a million rows is a handful of steps.
2. a short walk over the step functions gives every bucket the shard that is open when it begins. A walk takes
   at most ``MAX_STEPS`` steps: beyond that, groups of consecutive buckets, cut by their number of steps, compose
   into one step function each, and these in turn, round by round, until one walk is short enough. The states it
   gives are handed down the same rounds.
3. each bucket numbers its own rows.

No task sees more than one bucket of narrow rows, or the steps of one group: at most one and a half times
``MAX_STEPS``, unless three step functions alone have more, and one has no more steps than a shard holds rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shardloom.operators.ordering import with_positions
from shardloom.session import stage

MAX_STEPS = 4_000_000  # steps of 40 bytes
# Entry state of the first bucket: a shard that started infinitely long ago, so row 0 always opens one.
LONG_AGO = -(1 << 61)


@dataclass(frozen=True)
class Rollover:
    """When a writer closes the open shard.

    ``overshoot``: before a write, if the shard already holds ``limit`` bytes or more.
    ``fit``: before a write that would take it over ``limit``; an oversized row is alone in its shard.
    ``max_rows`` closes it by row count as well.
    """

    limit: int
    policy: str = "overshoot"
    max_rows: int | None = None

    def __post_init__(self):
        if self.limit <= 0 or (self.max_rows is not None and self.max_rows <= 0):
            raise ValueError("shard limits must be positive")
        if self.policy not in ("overshoot", "fit"):
            raise ValueError(f"unknown rollover policy {self.policy!r}")

    def mark(self, cum, size):
        """Per-row value that reaches ``start + reach`` on the first row outside a shard."""
        return cum if self.policy == "overshoot" else cum + size

    @property
    def reach(self) -> int:
        return self.limit if self.policy == "overshoot" else self.limit + 1

    def first_outside(self, marks, positions, start_cum, start_pos):
        """Index of the first row outside the shard(s) that start at the given byte and row."""
        found = np.searchsorted(marks, start_cum + self.reach, side="left")
        if self.max_rows is not None:
            found = np.minimum(found, np.searchsorted(positions, start_pos + self.max_rows, side="left"))
        return found


STEPS = T.StructType([
    T.StructField("part", T.LongType()),
    # State of the bucket as a whole: its first row, and its last mark and position.
    T.StructField("head_cum", T.LongType()),
    T.StructField("head_pos", T.LongType()),
    T.StructField("tail_mark", T.LongType()),
    T.StructField("tail_pos", T.LongType()),
    # The steps: entries up to (mark, pos) leave with the shard that started at (cum, pos) after `opened` more.
    T.StructField("upto_mark", T.ArrayType(T.LongType())),
    T.StructField("upto_pos", T.ArrayType(T.LongType())),
    T.StructField("exit_cum", T.ArrayType(T.LongType())),
    T.StructField("exit_pos", T.ArrayType(T.LongType())),
    T.StructField("opened", T.ArrayType(T.LongType())),
])
STATE = T.StructType([
    T.StructField("part", T.LongType()),
    T.StructField("open_cum", T.LongType()),
    T.StructField("open_pos", T.LongType()),
    T.StructField("open_shard", T.LongType()),
])
STEP_ARRAYS = ["upto_mark", "upto_pos", "exit_cum", "exit_pos", "opened"]


def bucket_steps(rule: Rollover, cum, pos, size) -> dict:
    """Step function of one bucket, rows in order."""
    marks, n = rule.mark(cum, size), len(pos)
    # A shard that opened earlier ends no later than one opened by the bucket's first row would.
    furthest = max(int(rule.first_outside(marks, pos, cum[0], pos[0])), 1)
    entry = np.arange(min(furthest, n - 1) + 1)
    at, opened = entry.copy(), np.ones(len(entry), dtype=np.int64)
    while True:
        following = np.maximum(rule.first_outside(marks, pos, cum[at], pos[at]), at + 1)
        inside = following < n
        if not inside.any():
            break
        at = np.where(inside, following, at)
        opened += inside
    last_of_run = np.append((np.diff(at) != 0) | (np.diff(opened) != 0), True)
    entry, at, opened = entry[last_of_run], at[last_of_run], opened[last_of_run]
    return {"head_cum": cum[0], "head_pos": pos[0], "tail_mark": marks[-1], "tail_pos": pos[-1],
            "upto_mark": marks[entry], "upto_pos": pos[entry], "exit_cum": cum[at], "exit_pos": pos[at],
            "opened": opened}


def pass_through(rule: Rollover, steps, open_cum, open_pos, shard):
    """States after a bucket, given the states before it."""
    i = np.searchsorted(steps.upto_mark, open_cum + rule.reach, side="left")
    if rule.max_rows is not None:
        i = np.minimum(i, np.searchsorted(steps.upto_pos, open_pos + rule.max_rows, side="left"))
    ends = i < len(steps.upto_mark)
    i = np.minimum(i, len(steps.upto_mark) - 1)
    return (np.where(ends, np.asarray(steps.exit_cum)[i], open_cum),
            np.where(ends, np.asarray(steps.exit_pos)[i], open_pos),
            shard + np.where(ends, np.asarray(steps.opened)[i], 0))


def compose(rule: Rollover, parts: pd.DataFrame) -> dict:
    """Step function of consecutive buckets."""
    parts = parts.sort_values("part")
    first, last = parts.iloc[0], parts.iloc[-1]
    upto_mark = upto_pos = exit_cum = exit_pos = opened = np.empty(0, dtype=np.int64)
    covered = False
    for steps in parts.itertuples():
        if len(opened):
            exit_cum, exit_pos, opened = pass_through(rule, steps, exit_cum, exit_pos, opened)
        if not covered:
            # Shards open before the first bucket may still end in this one.
            upto_mark, upto_pos = np.append(upto_mark, steps.upto_mark), np.append(upto_pos, steps.upto_pos)
            exit_cum, exit_pos = np.append(exit_cum, steps.exit_cum), np.append(exit_pos, steps.exit_pos)
            opened = np.append(opened, steps.opened)
        covered = covered or steps.tail_mark >= first.head_cum + rule.reach or (
            rule.max_rows is not None and steps.tail_pos >= first.head_pos + rule.max_rows)
    last_of_run = np.append((np.diff(exit_pos) != 0) | (np.diff(opened) != 0), True)
    return {"head_cum": first.head_cum, "head_pos": first.head_pos,
            "tail_mark": last.tail_mark, "tail_pos": last.tail_pos,
            "upto_mark": upto_mark[last_of_run], "upto_pos": upto_pos[last_of_run],
            "exit_cum": exit_cum[last_of_run], "exit_pos": exit_pos[last_of_run], "opened": opened[last_of_run]}


def walk(rule: Rollover, parts: pd.DataFrame, open_cum: int, open_pos: int, open_shard: int) -> pd.DataFrame:
    """State before each of the parts, in order."""
    states, state = [], (open_cum, open_pos, open_shard)
    for steps in parts.sort_values("part").itertuples():
        states.append((steps.part, *map(int, state)))
        state = pass_through(rule, steps, *state)
    return pd.DataFrame(states, columns=STATE.names)


def number_rows(rule: Rollover, cum, pos, size, open_cum: int, open_pos: int, open_shard: int):
    """Shard and slot of every row of a bucket, given the shard open when it begins."""
    marks, n, starts = rule.mark(cum, size), len(pos), []
    at = int(rule.first_outside(marks, pos, open_cum, open_pos))
    while at < n:
        starts.append(at)
        at = max(int(rule.first_outside(marks, pos, cum[at], pos[at])), at + 1)
    nth = np.searchsorted(np.asarray(starts, dtype=np.int64), np.arange(n), side="right")
    start_pos = np.append(open_pos, pos[np.asarray(starts, dtype=np.int64)])
    return open_shard + nth, pos - start_pos[nth]


def step_groups(steps: DataFrame, keys: list[str], max_steps: int) -> DataFrame:
    """(keys, part, group_no): consecutive parts of at most one and a half times ``max_steps``, two at least.

    Only the numbers of steps are ordered here, one row per part.
    """
    counts = steps.select(*keys, "part", F.size("opened").cast("long").alias("n_steps"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A part weighs half a group at most, so that groups of two are made whatever its steps.
    begin = F.coalesce(F.sum(F.least("n_steps", F.lit(max(max_steps // 2, 1)))).over(before), F.lit(0))
    number = F.call_function("div", begin.cast("long"), F.lit(max(max_steps, 2)).cast("long"))
    return counts.select(*keys, "part", "n_steps", number.alias("group_no"))


def compose_rounds(steps: DataFrame, keys: list[str], max_steps: int, reduce_group, schema) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of composition, each the staged step functions with their groups; and what is left, one group a key."""
    rounds = []
    while True:
        steps = stage(steps)
        groups = stage(step_groups(steps, keys, max_steps))
        if not groups.agg(F.max("group_no")).first()[0]:
            return rounds, steps
        grouped = stage(steps.join(groups, [*keys, "part"]))
        rounds.append(grouped)
        steps = grouped.groupBy(*keys, "group_no").applyInPandas(reduce_group, schema)


def roll_shards(rows: DataFrame, rule: Rollover, order_by: list[str], bucket: str = "bucket",
                group: tuple[str, ...] = (), size: str = "size", n_rows: int | None = None,
                keep: list[str] | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """Add ``pos``, ``shard`` and ``slot`` (row within shard), numbered from 0 in each group.

    ``rows`` is narrow (ids, order, size) and staged; ``bucket`` is an ordered cut of the group's order.
    ``n_rows`` is how many there are, where the caller knows: no step function has more steps than rows, so a table of
    at most ``max_steps`` rows is walked without counting its steps. ``keep`` names the columns wanted back, all by default;
    others, such as a sort key that can be computed again, need not pass through the kernels.
    """
    keys = list(group)
    placed = with_positions(rows, order_by, bucket, group, size)
    ranked = ["bucket_no", "cum", "pos", size]
    if keep is not None:
        placed = placed.select(*dict.fromkeys([*keys, bucket, *keep, *ranked]))
    # Kernels group by the columns the positions were ranked by, so rows stay where that exchange put them.
    at = [*keys, bucket]
    fields = {name: placed.schema[name] for name in at}

    def schema_of(names: list[str], of: T.StructType) -> T.StructType:
        return T.StructType([fields[n] for n in names] + of.fields)

    def keyed(names, values, out: pd.DataFrame) -> pd.DataFrame:
        for i, (name, value) in enumerate(zip(names, values)):
            out.insert(i, name, value)
        return out

    def arrays(pdf):
        ordered = pdf.sort_values("pos", kind="stable")
        return (ordered, *(ordered[c].to_numpy(dtype=np.int64) for c in ("cum", "pos", size)))

    def reduce_bucket(key, pdf):
        ordered, cum, pos, sizes = arrays(pdf)
        steps = {**bucket_steps(rule, cum, pos, sizes), "part": ordered["bucket_no"].iloc[0]}
        return keyed(at, key, pd.DataFrame([steps], columns=STEPS.names))

    def reduce_group(key, pdf):
        steps = {**compose(rule, pdf), "part": key[-1]}
        return keyed(keys, key, pd.DataFrame([steps], columns=STEPS.names))

    def enter(names):
        """States before each part of a group, given the state before the group; ``names`` is what says which part."""
        def states_of(key, steps, state=None):
            begin = (LONG_AGO, LONG_AGO, -1) if state is None else state[STATE.names[1:]].iloc[0]
            steps = steps.sort_values("part")
            return keyed([*keys, *names], [*key[:len(keys)], *(steps[n].to_numpy() for n in names)], walk(rule, steps, *begin))
        return states_of

    def entered(steps):
        if n_rows is not None and n_rows <= max_steps:
            return steps.groupBy(*keys).applyInPandas(lambda key, pdf: enter([bucket])(key, pdf), schema_of(at, STATE))
        # Only the first round's parts are buckets; it keeps their names.
        rounds, top = compose_rounds(steps, keys, max_steps, reduce_group, schema_of(keys, STEPS))
        last = [bucket] if not rounds else []
        states = top.groupBy(*keys).applyInPandas(lambda key, pdf: enter(last)(key, pdf), schema_of([*keys, *last], STATE))
        for depth, grouped in reversed(list(enumerate(rounds))):
            names = [] if depth else [bucket]
            states = (grouped.groupBy(*keys, "group_no")
                      .cogroup(states.withColumnRenamed("part", "group_no").groupBy(*keys, "group_no"))
                      .applyInPandas(enter(names), schema_of([*keys, *names], STATE)))
        return states

    out_schema = T.StructType(placed.schema.fields + [T.StructField("shard", T.LongType()),
                                                      T.StructField("slot", T.LongType())])

    def fill_bucket(key, pdf, state):
        ordered, cum, pos, sizes = arrays(pdf)
        shard, slot = number_rows(rule, cum, pos, sizes, *state[STATE.names[1:]].iloc[0])
        return ordered.assign(shard=shard, slot=slot)[out_schema.names]

    steps = placed.select(*at, *ranked).groupBy(*at).applyInPandas(reduce_bucket, schema_of(at, STEPS))
    filled = placed.groupBy(*at).cogroup(entered(steps).groupBy(*at)).applyInPandas(fill_bucket, out_schema)
    return filled.drop("bucket_no")


def by_count(pos: Column, rows_per_shard: int) -> Column:
    """Shard of a global position under a row limit alone."""
    return F.call_function("div", pos, F.lit(rows_per_shard).cast("long"))


def by_bytes(cum: Column, limit: int) -> Column:
    """Shard of a byte prefix: no chain to resolve, shards average ``limit`` bytes but may pass it by a row."""
    return F.call_function("div", cum, F.lit(limit).cast("long"))


def check_limits(max_bytes: float, max_rows: float, least_bytes: int = 10_000_000, most_rows: int = 1_000_000):
    """The production bounds of the tar writer; pass smaller ones for fixtures."""
    if max_bytes <= least_bytes:
        raise ValueError(f"max_bytes must be more than {least_bytes}")
    if max_rows >= most_rows:
        raise ValueError(f"max_rows must be less than {most_rows}")


def shard_manifest(assigned: DataFrame, group: tuple[str, ...] = (), size: str = "size") -> DataFrame:
    """One row per shard: rows, bytes and the range of positions."""
    return assigned.groupBy(*group, "shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
