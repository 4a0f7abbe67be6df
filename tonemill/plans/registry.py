"""Collects queries (spark, sf_dir) -> DataFrame and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The event view of the table events, in DuckDB's SQL.
EV = """ev as (select event_id as seq, epoch_us(ts) as micros, epoch_us(ts) // 1000000 as sec, user_id as slot, user_id % 16 as ch, user_id % 128 as note,
 cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, 1 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 127 as vel, event_type,
 case when event_type in ('click', 'view') then 'note_on' when event_type in ('signup', 'purchase') then 'note_off' else 'controller' end as kind,
 value, epoch_us(ts) // 1000000 // 21600 as block, epoch_us(ts) // 1000000 // 675 as tile from events)"""
#: Note-ons as admission candidates.
CAND = f"""{EV}, cand as (select seq, block, value as gain, row_number() over (partition by block order by seq) - 1 as idx, count(*) over (partition by block) as want from ev where kind = 'note_on')"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
