"""Admission to a bounded pool, and what leaves it.

Every ranking ends in a unique key, so results don't depend on partitioning.
Blocks are windows' partitions; a cap or quota is a filter on a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATA = 64


def admit_take(live: Column, queued: Column, cap: int, steal_percent: int = 25, steal: bool = True) -> Column:
    """How many of ``queued`` a pool of ``cap`` with ``live`` voices takes: all
    if they fit, else what is free and what may be stolen."""
    want = F.least(queued, F.lit(cap))
    most = max(cap * steal_percent // 100, 1)
    need = F.least(live + want - cap, live, F.lit(most)) if steal else F.lit(0)
    return F.when(live + want <= cap, want).otherwise(F.least(want, F.lit(cap) - (live - need)))


def admit_loudest(cand: DataFrame, cap: int) -> DataFrame:
    """The candidates (block, idx, want, gain) to admit: each block is cut into
    up to STRATA even strata in order, and each keeps its loudest up to a
    proportional quota; of equal gains the later goes first."""
    take, strata = F.least(F.col("want"), F.lit(cap)), F.least(F.col("want"), F.lit(cap), F.lit(STRATA))
    cut = cand.withColumns({"take": take, "_st": strata}).withColumn("stratum", F.expr("((idx + 1) * _st - 1) div want"))
    quota = F.expr("((stratum + 1) * take) div _st - (stratum * take) div _st")
    order = Window.partitionBy("block", "stratum").orderBy(F.desc("gain"), F.desc("idx"))
    return cut.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= quota).drop("_n", "_st")


def admit_even(cand: DataFrame, cap: int) -> DataFrame:
    """The candidates floor(i * want / take) of each block, for i below take;
    no window is needed to tell."""
    take = cand.withColumn("take", F.least(F.col("want"), F.lit(cap)))
    return take.filter(F.expr("((idx * take + want - 1) div want) * want < (idx + 1) * take"))


def steal_key(level: Column, note_id: Column, rule: str = "quietest") -> list[Column]:
    """The order in which voices are stolen."""
    quietness = F.floor(F.greatest(F.least(level, F.lit(1.0)), F.lit(0.0)) * 65535)
    return [quietness, note_id] if rule == "quietest" else [note_id]


def steal(voices: DataFrame, k: int, rule: str = "quietest", by: str | None = None) -> DataFrame:
    """The k voices (level, id) to steal, of each group if ``by`` names one;
    without groups the plan is a top-k, not a sort."""
    key = steal_key(F.col("level"), F.col("id"), rule)
    if by is None:
        return voices.orderBy(*key).limit(k)
    return voices.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*key))).filter(F.col("_n") <= k).drop("_n")


#: States that a cache of controller variants may hold.
MOST_STATES = 1024


def nearest_state(wanted: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Each wanted state's nearest known one by the sum of absolute differences,
    the first of equals; null if none is known. The known states are those of a
    cache, of at most MOST_STATES, and become an array that each row looks
    through; more raise an error."""
    held = known.select("state", *columns).orderBy("state").limit(MOST_STATES + 1).collect()
    if len(held) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} known states")
    far = lambda k: sum((F.abs(F.col(c) - F.lit(k[c])) for c in columns), F.lit(0))
    each = F.array(*[F.struct(far(k).alias("distance"), F.lit(k["state"]).alias("state")) for k in held]) if held else F.lit(None)
    best = F.array_min(each) if held else F.lit(None).cast("struct<distance: bigint, state: bigint>")
    return wanted.select("seq", best.alias("m")).select("seq", "m.distance", "m.state")
