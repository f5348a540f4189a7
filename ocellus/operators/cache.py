"""An incremental store of computed rows: what can be reused, what is left to do, and the latest record of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.operators.manifest import first_of


def cache_key(path: Column, modified: Column, signature: Column) -> Column:
    return F.concat_ws("|", path, F.unix_timestamp(modified).cast("string"), signature)


def latest(cache: DataFrame, key: str = "key", at: str = "at") -> DataFrame:
    """The last record of each key."""
    return first_of(cache, key, -F.col(at))


def reusable(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return work.join(cache.select(key), key, "left_semi")


def left_to_do(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return work.join(cache.select(key), key, "left_anti")


def combined(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old and new rows; columns that one side lacks are null."""
    return cached.unionByName(fresh, allowMissingColumns=True)
