"""Layered configuration with the origin of every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(values: DataFrame, application: str, configuration_set: str, profile: str = "", module: str = "") -> DataFrame:
    """key_path, value_json, layer, profile, source_id, path that hold for an application.

    Layers from weak to strong: central base, module base, central profile, module profile. Central values
    belong to the configuration set, module values to the application and, if given, the module. Within a
    layer the last by path, source and document wins. Without a profile the base layers are taken twice.
    """
    central = (F.col("layer") == "central") & (F.col("configuration_set") == configuration_set)
    own = (F.col("layer") == "module") & (F.col("repository") == application) & (F.col("configuration_set") == "")
    if module:
        own = own & (F.col("module") == module)
    base = F.col("profile") == ""
    special = F.col("profile") == profile
    rank = F.when(central & special, 2).when(own & special, 3).when(central & base, 0).when(own & base, 1)
    return strongest(values.withColumn("_rank", rank).where("_rank is not null"), ["key_path"], F.col("_rank"))


def strongest(values: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of the highest rank for each key, ties to the last path, source and document."""
    order = [c for c in ("path", "source_id", "document") if c in values.columns]
    found = values.groupBy(*keys).agg(F.max_by(F.struct("value_json", "layer", "profile", "source_id", "path"), F.struct(rank, *order)).alias("r"))
    return found.select(*keys, "r.*")
