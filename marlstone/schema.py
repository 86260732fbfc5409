"""Schemas of the stored relations, and their strict check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERSION = 2


def _schema(text: str, integers: str = "") -> T.StructType:
    whole = set(integers.split())
    return T.StructType([T.StructField(n, T.IntegerType() if n in whole else T.StringType(), False) for n in text.split()])


CHUNKS = _schema("source_id pack_id repository module path kind language configuration_set commit_sha line_start line_end title content content_hash", "line_start line_end")
CONFIGURATION = _schema("source_id pack_id repository module path document configuration_set profile layer key_path value_json", "document")
ALIASES = _schema("pack_id catalog_repository catalog_path catalog_commit_sha alias accessor group_id artifact_id version_ref version_value owner_repository owner_module")
USAGES = _schema("pack_id catalog_repository catalog_path alias accessor consumer_repository consumer_module path configuration commit_sha line", "line")
METADATA = _schema("key value")

RELATIONS = {"chunks": CHUNKS, "configuration_values": CONFIGURATION, "dependency_aliases": ALIASES, "dependency_usages": USAGES, "knowledge_metadata": METADATA}


def problems(name: str, df: DataFrame) -> list[str]:
    """How a relation's columns differ from the stored schema: names, order and types must be equal."""
    want = [(f.name, f.dataType.simpleString()) for f in RELATIONS[name].fields]
    return [] if df.dtypes == want else [f"{name}: columns are {df.dtypes}, not {want}"]
