"""Joining what was aggregated per key back to the rows, whatever the size of a key's group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows goes by broadcast: there are fewer than 1 / HOT_SHARE such keys, however much data there is.
HOT_SHARE = 1 / 2000


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """`rows` inner joined with `groups`, one row per key with the number of its rows in `size`.

    The shuffle join never sees a hot key: the rows of keys above HOT_SHARE of all rows meet their group
    through a broadcast of fewer than 1 / HOT_SHARE lines, the others through a shuffle. `groups` should be
    cheap to read twice (persisted or a checkpoint). Keys must not be null.
    """
    keys = list(keys)
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = groups.filter(F.col(size) <= least)
    by_broadcast = rows.join(hot, keys)
    by_shuffle = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return by_broadcast.unionByName(by_shuffle)
