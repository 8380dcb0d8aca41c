"""Joining a table of any size to a dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.sources.staging import stage

#: A key with more than one such share of all rows is dealt over parts of about that size: so many keys are hot at most.
SHARES = 1_000

#: A join's pairs are dealt over tasks of at least so many each and over so many tasks at most. A first task runs long before the
#: compiler of the executor has done its loop, so the next ones, which start in compiled code, should come soon.
PAIRS, TASKS = 1 << 22, 4_000

# A table of configured values is sent to every executor up to this size.
MAX_BROADCAST_ROWS = 200_000


def join_dimension(
    big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", configured_rows: int | None = None,
) -> DataFrame:
    """Equi-join with a dimension.

    `configured_rows` is the dimension's size where configuration fixes it; a small one is broadcast. Without it
    Spark chooses by the sizes that it knows or meets at run time, and adaptive execution splits hot keys.
    """
    if configured_rows is not None and configured_rows <= MAX_BROADCAST_ROWS:
        dim = F.broadcast(dim)
    return big.join(dim, list(on), how)


def salted_sides(
    probes: DataFrame, rows: DataFrame, place: Sequence[str], held: Column | None = None,
) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Both sides of an equi-join on `place`, the columns to join them on and a number of tasks; hot keys are known beforehand.

    Rows of `probes` with a hot key are dealt over parts, and the key's few `rows` are copied to each. Keys are counted
    first, with partial counts before the shuffle, so `probes` is read twice: pass something cheap to make again.
    `held` is what a row of `rows` holds if each of these makes a pair with a probe: then keys with many pairs are hot as well, and
    the number of tasks follows from the pairs. It is 0, as Spark likes, without `held` or with pairs for a few tasks only.
    """
    counts, pairs = probes.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")), F.lit(0.0)
    number = F.monotonically_increasing_id()
    if held is not None:
        # Probes of one level may come at every so many rows, which would leave parts empty.
        number = F.xxhash64(number)
        counts = counts.join(rows.groupBy(*place).agg(F.sum(held.cast("double")).alias("__held")), list(place), "left")
        pairs = F.coalesce(F.col("__n") * F.col("__held"), pairs)
    counts = stage(counts, "key-counts")
    total, work = counts.agg(F.sum("__n"), F.sum(pairs)).first()
    total, work = total or 0, work or 0.0
    share = max(work / TASKS, PAIRS)
    salts = stage(counts.where((F.col("__n") * SHARES > F.lit(total)) | (pairs > share)).select(
        *place, F.greatest(F.ceil(F.col("__n") * SHARES / F.lit(max(total, 1))), F.ceil(pairs / share)).cast("int").alias("__salts")),
        "hot-keys")
    parts = F.coalesce("__salts", F.lit(1))
    # At most SHARES and TASKS rows, so the table is small whatever the probes.
    dealt = probes.join(F.broadcast(salts), list(place), "left").withColumn(
        "__salt", F.pmod(number, parts).cast("int")).drop("__salts")
    copies = rows.join(salts, list(place), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__salts")
    return dealt, copies, [*place, "__salt"], math.ceil(work / share) if work > 8 * PAIRS else 0


def salted_join(probes: DataFrame, rows: DataFrame, place: Sequence[str]) -> DataFrame:
    """Inner equi-join on `place` over salted_sides."""
    dealt, copies, on, _ = salted_sides(probes, rows, place)
    return dealt.join(copies, on).drop("__salt")
