"""Joins of a side whose keys may repeat without bound with one whose keys do not.

The plan is the same at any size and building it starts no job. At run time
Spark splits a partition that is too large on either side of an inner join and
on the side whose rows an outer or anti join keeps
(``spark.sql.adaptive.skewJoin``); it cannot split the other side of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def skew_join(big: DataFrame, small: DataFrame, key: str, keep: str = "neither") -> DataFrame:
    """Equi-join on ``key``; ``keep`` names the side whose rows all remain.

    ``big`` is the side on which a key may repeat. To keep ``small``, the pairs
    come from an inner join and the rows of ``small`` without a partner from an
    anti join against the distinct keys of ``big``, which are found on the map
    side: a hot key of ``big`` can be split in the one and is a single row in
    the other. The rows of the anti join, few as a rule, are dealt by ``key`` once more:
    that makes it a stage of its own. In one stage with the inner join it would get
    as few tasks as its share of the bytes, though its keys are many.
    """
    if keep != "small":
        return big.join(small, key, {"big": "left", "neither": "inner"}[keep])
    alone = small.join(big.select(key).distinct(), key, "left_anti").hint("rebalance", key)
    return big.join(small, key).unionByName(alone, allowMissingColumns=True)
