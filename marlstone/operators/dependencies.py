"""The dependency usage graph: aliases, owners, consumers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import ascii_only, letters_only
from marlstone.session import spread

ALIAS = ["catalog_repository", "catalog_path", "alias"]
PLACE = "consumer_repository consumer_module path configuration line".split()
SUFFIX = r"\.(get|orNull|getOrNull)$"


def distinct_aliases(aliases: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each alias of a catalog, by a deterministic order."""
    first = Window.partitionBy(*ALIAS).orderBy(*order)
    return aliases.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def resolve_owners(aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """owner_repository and owner_module of every alias: of the candidates (repository, module, names,
    priority) that have the artifact among their names, the best by priority, repository, module; else ''."""
    terms = candidates.select("repository", "module", "priority", F.explode(F.array_distinct(F.transform("names", ascii_only))).alias("_term")).where("_term <> ''")
    best = terms.groupBy("_term").agg(F.min_by(F.struct("repository", "module"), F.struct((-F.col("priority")).alias("p"), "repository", "module")).alias("_o"))
    joined = aliases.withColumn("_term", ascii_only("artifact_id")).join(best, "_term", "left")
    return joined.withColumn("owner_repository", F.coalesce("_o.repository", F.lit(""))).withColumn("owner_module", F.coalesce("_o.module", F.lit(""))).drop("_term", "_o")


def link_usages(usages: DataFrame, aliases: DataFrame, n_usages: int | None = None) -> DataFrame:
    """Usages with every alias of their accessor; without one, of the accessor less a provider call. Usages
    that match no alias are left out, repeated edges are one. ``n_usages`` is the number of usages, if it is known."""
    n_usages = usages.count() if n_usages is None else n_usages
    usages = spread(usages, "accessor", rows=n_usages)
    keys = aliases.select(*ALIAS, "accessor")
    exact = usages.join(keys, "accessor")
    rest = usages.join(keys.select("accessor").distinct(), "accessor", "left_anti").where(F.col("accessor").rlike(SUFFIX))
    late = rest.withColumn("accessor", F.regexp_replace("accessor", SUFFIX, "")).join(keys, "accessor")
    edge = [*ALIAS, *PLACE]
    return spread(exact.unionByName(late), *edge, rows=n_usages).dropDuplicates(edge)


def unresolved(usages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Usages that match no alias, even without a provider call."""
    known = aliases.select("accessor").distinct()
    left = usages.join(known, "accessor", "left_anti")
    short = known.withColumnRenamed("accessor", "_short")
    return left.join(short, F.regexp_replace("accessor", SUFFIX, "") == F.col("_short"), "left_anti")


def orphans(usages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Usages whose alias is in no catalog."""
    return usages.join(aliases, ALIAS, "left_anti")


def matching(aliases: DataFrame, requested: str) -> DataFrame:
    """Aliases whose names hold all requested terms; a request without terms matches none."""
    terms = [re.sub(r"[\W_]+", "", t) for t in re.findall(r"[-\w]+", requested.lower()) if t not in ("dependency", "library", "libs")]
    if not terms:
        return aliases.limit(0)
    text = letters_only(F.concat_ws(" ", *"alias accessor group_id artifact_id owner_repository owner_module".split()))
    return aliases.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def consumers(aliases: DataFrame, usages: DataFrame, most: int, repository: str = "") -> DataFrame:
    """The first ``most`` usages of each alias, by consumer, path and line."""
    rows = usages.where(F.col("consumer_repository") == repository) if repository else usages
    order = Window.partitionBy(*ALIAS).orderBy("consumer_repository", "consumer_module", "path", "line")
    return aliases.select(*ALIAS).join(rows, ALIAS).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def usage_budget(aliases: DataFrame, usages: DataFrame, budget: int = 20, repository: str = "") -> DataFrame:
    """Usages of the aliases in order until the shared budget (1 to 50) is spent."""
    budget = min(max(budget, 1), 50)
    rows = usages.where(F.col("consumer_repository") == repository) if repository else usages
    return aliases.select(*ALIAS).join(rows, ALIAS).orderBy("alias", "catalog_path", "catalog_repository", "consumer_repository", "consumer_module", "path", "line").limit(budget)


def suggestion(aliases: DataFrame, usages: DataFrame, requested: str, scope: str = "implementation") -> DataFrame:
    """Ten matching aliases with their declaration and up to three consumers each."""
    if not re.fullmatch(r"[A-Za-z]\w*", scope, re.A):
        raise ValueError(f"{scope!r} is no dependency scope")
    top = matching(aliases, requested).orderBy("alias", "catalog_path").limit(10)
    shown = consumers(top, usages, 3).groupBy(*ALIAS).agg(F.array_sort(F.collect_list(F.struct("n", "consumer_repository", "consumer_module", "path", "line", "configuration", "commit_sha"))).alias("consumers"))
    version = F.when(F.col("version_ref") != "", F.col("version_ref")).otherwise(F.col("version_value"))
    return top.join(shown, ALIAS, "left").withColumn("declaration", F.format_string("%s(libs.%s)", F.lit(scope), "accessor")).withColumn("coordinates", F.concat_ws(":", "group_id", "artifact_id")).withColumn("version", version)


def draft_cases(aliases: DataFrame, usages: DataFrame, most: int = 20) -> DataFrame:
    """position, case_id, query, alias, usages, consumer of the most used aliases with an owner, as cases to review.

    Only usages with a known configuration count. The case_id is the alias as a slug; further ones of the
    same slug get a number.
    """
    known = usages.where("configuration <> 'unknown'").select(*ALIAS, *PLACE)
    joined = aliases.where("owner_repository <> ''").select(*ALIAS, "artifact_id").join(known, ALIAS)
    consumer = F.struct("consumer_repository", "consumer_module", "path", "line", "configuration")
    grouped = joined.groupBy(*ALIAS).agg(F.count("*").alias("usages"), F.min(consumer).alias("consumer"), F.min("artifact_id").alias("query"))
    top = grouped.orderBy(F.desc("usages"), "alias", "catalog_path", "catalog_repository").limit(most)
    order = Window.orderBy(F.desc("usages"), "alias", "catalog_path", "catalog_repository")  # over ``most`` rows
    slug = F.regexp_replace(F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", "-"), "^-|-$", "")
    placed = top.withColumn("position", F.row_number().over(order)).withColumn("_slug", F.when(slug == "", "case").otherwise(slug))
    again = F.row_number().over(Window.partitionBy("_slug").orderBy("position"))
    return placed.withColumn("_n", again).select("position", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("_n").cast("string"))).alias("case_id"), "query", "alias", "usages", "consumer")
