"""Finite automata over ordered rows, by composing transition maps.

What a stretch of rows does to a state is a map from states to states, an array with a place for each state; maps compose,
and composing is associative. So a long sequence is cut into stretches whose maps are made side by side, and only maps meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Maps that are composed in one row; more are composed to one map for each such part first.
PART = 1024


def composed(maps: Column, states: int) -> Column:
    """The map of maps (array of arrays) that are taken one after another."""
    return F.aggregate(maps, F.array(*map(F.lit, range(states))), lambda acc, m: F.transform(acc, lambda s: m[s]))


def visited(maps: Column, start: Column) -> Column:
    """The state before each map, and that behind the last one."""
    return F.aggregate(maps, F.array(start), lambda acc, m: F.concat(acc, F.array(m[F.element_at(acc, -1)])))


def states_before(rows: DataFrame, key: list[str], place: str, step: str, states: int, start: str) -> DataFrame:
    """(key, place, state): the state before each row.

    ``place`` counts a key's rows from 0 without gaps, ``step`` is a row's map, ``start`` the key's first state (equal in all its
    rows). A part's rows are one row's arrays, and so are a key's parts: ``PART`` and a ``PART``-th of its rows.
    """
    part = F.floor(F.col(place) / PART)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(place, c))), lambda x: x[c])
    parts = rows.groupBy(*key, part.alias("__part")).agg(ordered(step).alias("__maps"), F.any_value(start).alias("__start"))
    whole = parts.withColumn("__map", composed(F.col("__maps"), states))
    of_key = F.transform(F.array_sort(F.collect_list(F.struct("__part", "__map"))), lambda x: x["__map"])
    first = whole.groupBy(*key).agg(of_key.alias("__maps"), F.any_value("__start").alias("__start"))
    first = first.select(*key, F.posexplode(visited(F.col("__maps"), F.col("__start"))).alias("__part", "__state"))
    inside = parts.join(first, [*key, "__part"]).withColumn("__states", visited(F.col("__maps"), F.col("__state")))
    inside = inside.withColumn("__states", F.slice("__states", F.lit(1), F.size("__maps")))
    return inside.select(*key, F.posexplode("__states").alias("__at", "state"), (F.col("__part") * PART).alias("__from")).select(
        *key, (F.col("__from") + F.col("__at")).cast("long").alias(place), "state"
    )
