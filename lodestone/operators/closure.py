"""Transitive closure of a relation: all of it by doubling, or what is reached from one end."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, o) with a: s -> m and b: m -> o."""
    return a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o")


def closure(pairs: DataFrame, scratch: Scratch, max_iterations: int = 1000) -> DataFrame:
    """All (s, o) joined by one or more steps: each round joins what is new with all so far on either side, so path
    lengths double and a chain of n needs about log2(n) rounds. Only new pairs are written; what is known is the
    union of the rounds' tables."""
    delta = scratch.keep(pairs.select("s", "o").distinct())
    rounds = [delta]
    for _ in range(max_iterations):
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        new = compose(delta, known).unionByName(compose(known, delta)) if len(rounds) > 1 else compose(delta, known)
        delta = scratch.keep(new.distinct().join(known, ["s", "o"], "left_anti"))
        if delta.isEmpty():
            return known
        rounds.append(delta)
        if len(rounds) > 8:  # few, larger tables
            whole = rounds[0]
            for r in rounds[1:-1]:
                whole = whole.unionByName(r)
            rounds = [scratch.keep(whole), delta]
    warnings.warn(f"closure stopped after {max_iterations} rounds", RuntimeWarning, stacklevel=2)
    known = rounds[0]
    for r in rounds[1:]:
        known = known.unionByName(r)
    return known


def reach(first: DataFrame, pairs: DataFrame, scratch: Scratch, max_iterations: int = 1000) -> DataFrame:
    """All (s, o) that continue ``first`` by any number of steps of ``pairs``: a frontier search that never looks at what
    isn't reached."""
    delta = scratch.keep(first.select("s", "o").distinct())
    rounds = [delta]
    for _ in range(max_iterations):
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        delta = scratch.keep(compose(delta, pairs).distinct().join(known, ["s", "o"], "left_anti"))
        if delta.isEmpty():
            return known
        rounds.append(delta)
        if len(rounds) > 8:
            whole = rounds[0]
            for r in rounds[1:-1]:
                whole = whole.unionByName(r)
            rounds = [scratch.keep(whole), delta]
    warnings.warn(f"path stopped after {max_iterations} rounds", RuntimeWarning, stacklevel=2)
    return known.unionByName(delta)
