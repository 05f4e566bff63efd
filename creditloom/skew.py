"""Ranking and joining that stay spread out when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LARGE = 1 << 20  # rows of a key that one task ranks at most


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: dict[str, Column], name: str, large: int = LARGE) -> DataFrame:
    """Exact ``row_number`` per key, ranked block by block where a key has more than ``large`` rows.

    ``block`` holds columns that never decrease along ``order``. Rows of other keys are ranked by one shuffle. Rows of large keys are ranked
    inside (key, block) and shifted by the sizes of the key's earlier blocks, so no task sorts all the rows of one key. Large keys are
    found by a pre-aggregated count; there is at most one for every ``large`` rows, so they are broadcast. Rows with a null key or block are
    left out, after they have been counted.
    """
    blocks = list(block)
    group = [*keys, *blocks]
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    df = df.withColumns(block)
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > large).select(*keys, F.lit(True).alias("_large"))
    df = df.join(F.broadcast(heavy), list(keys), "left").withColumn("_whole", F.coalesce(*[F.when(F.col(b).isNull(), F.lit(False)) for b in blocks], F.lit(True)))
    df = df.withColumns({b: F.when(F.col("_large"), F.col(b)) for b in blocks})
    sizes = df.where("_large").groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        df.withColumn("_rank", inner)
        .join(offsets, group, "left")
        .where("_whole")
        .withColumn(name, (F.col("_rank") + F.coalesce("_offset", F.lit(0))).cast("int"))
        .drop("_rank", "_offset", "_large", "_whole", *blocks)
    )


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salt: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Inner or left join whose left side may be dominated by one key.

    Left rows are spread over ``salts`` slices by ``salt`` (an integer column); the right side, which must
    be small per key, is repeated once per slice.
    """
    spread = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
