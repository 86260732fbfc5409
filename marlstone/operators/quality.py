"""Data-quality gates, retrieval metrics, inventories and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import KIND_ORDER, TAG, secret_lines
from marlstone.sources.files import valid_revision

KINDS = (*KIND_ORDER, "configuration")


def inventory(chunks: DataFrame) -> DataFrame:
    """Per repository: chunks, chunks of each kind, modules, the greatest commit."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_chunks") for k in KINDS]
    return chunks.groupBy("repository").agg(F.count("*").alias("chunks"), *kinds, F.countDistinct("module").alias("modules"), F.max("commit_sha").alias("commit_sha"))


def duplicates(chunks: DataFrame) -> DataFrame:
    """One row: groups of equal content, and the rows beyond the first of each."""
    groups = chunks.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def generated(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.contains("/generated/") | path.contains("/__generated/")


def raw_html(content: Column | str) -> Column:
    return F.col(content).rlike(TAG) if isinstance(content, str) else content.rlike(TAG)


def chunk_gate(chunks: DataFrame) -> DataFrame:
    """One row of counters over all chunks, in one pass."""
    leaks = (F.col("kind") == "configuration") & (F.size(secret_lines("content")) > 0)
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(generated("path")).alias("generated_paths"),
        F.count_if((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start"))).alias("invalid_line_ranges"),
        F.count_if(F.col("kind").isin("docs", "usage") & raw_html("content")).alias("raw_html_in_docs"),
        F.count_if(leaks).alias("secret_leaks"),
    )


def usage_gate(usages: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: orphan usages, usages without full provenance, usages in generated paths."""
    marks = aliases.select("catalog_repository", "catalog_path", "alias", F.lit(True).alias("_known")).distinct()
    joined = usages.join(marks, ["catalog_repository", "catalog_path", "alias"], "left")
    empty = F.exists(F.array("consumer_repository", "consumer_module", "path", "commit_sha"), lambda v: v == "")
    return joined.agg(F.count_if(F.col("_known").isNull()).alias("orphan_usages"), F.count_if(empty | (F.col("line") < 1)).alias("invalid_provenance"), F.count_if(generated("path")).alias("generated_usage_paths"))


def gate(chunk_row: DataFrame, usage_row: DataFrame) -> DataFrame:
    """Both rows and whether all is well: there are chunks, and no counter of defects is above 0."""
    joined = chunk_row.crossJoin(usage_row)
    clean = F.forall(F.array(*(F.col(c).cast("long") for c in joined.columns if c != "chunks")), lambda n: n == 0)
    return joined.withColumn("passed", (F.col("chunks") > 0) & clean)


def retrieval_metrics(results: DataFrame, expected: DataFrame, cases: DataFrame, min_recall: float = 1.0, min_mrr: float = 0.8, min_negative: float = 1.0) -> DataFrame:
    """One row: recall, MRR and negative pass rate over cases, and whether they reach the thresholds.

    results: query_id, position, path; expected: query_id, path; cases: query_id, expect_no_results. A case
    counts by its best expected result. Where there are no cases of a sort its rate is 1.
    """
    hits = results.join(expected, ["query_id", "path"]).groupBy("query_id").agg(F.min("position").alias("rank"))
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = cases.join(hits, "query_id", "left").join(n, "query_id", "left")
    positive = ~F.col("expect_no_results")

    def rate(value: Column, of: Column) -> Column:
        return F.round(F.coalesce(F.avg(F.when(of, value)), F.lit(1.0)), 6)

    out = rows.agg(
        F.count_if(positive).alias("positive_cases"),
        rate(F.col("rank").isNotNull().cast("double"), positive).alias("recall"),
        rate(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), positive).alias("mrr"),
        rate(F.col("n").isNull().cast("double"), ~positive).alias("negative_pass_rate"),
    )
    return out.withColumn("passed", (F.col("recall") >= min_recall) & (F.col("mrr") >= min_mrr) & (F.col("negative_pass_rate") >= min_negative))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two snapshots (path, fingerprint)."""
    b, a = before.toDF("path", "_b"), after.toDF("path", "_a")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return b.join(a, "path", "full_outer").where(~F.col("_b").eqNullSafe(F.col("_a"))).select("path", change.alias("change"))


def status_summary(records: DataFrame, attempts: int = 2) -> DataFrame:
    """One row of counts: total, each status, failed records that may be tried again and those that may not."""
    failed = F.col("status") == "failed"
    each = [F.count_if(F.col("status") == s).alias(s) for s in "failed successful running pending".split()]
    return records.agg(F.count("*").alias("total"), *each, F.count_if(failed & (F.col("attempts") < attempts)).alias("retryable"), F.count_if(failed & (F.col("attempts") >= attempts)).alias("terminal"))


def audit_failures(audit: DataFrame, revisions: DataFrame, schema_version: int, fingerprint: str) -> DataFrame:
    """One row, failures: what in a one-row audit contradicts the index or tells of lost input.

    revisions has a row for each source with its commit; counters that the audit lacks count as 0.
    """
    have = set(audit.columns)

    def n(name: str) -> Column:
        return F.coalesce(F.col(name).cast("long"), F.lit(0)) if name in have else F.lit(0)

    sources = revisions.agg(F.count("*").alias("_revisions"), F.count_if(~valid_revision("commit")).alias("_bad"))
    rules = (
        (n("schema_version") != schema_version, "another schema version"),
        (F.coalesce(F.col("fingerprint") if "fingerprint" in have else F.lit(""), F.lit("")) != fingerprint, "another index"),
        (n("sources") == 0, "no sources"),
        (F.col("_revisions") != n("sources"), "revisions do not cover the sources"),
        (F.col("_bad") > 0, "a source without a commit"),
        (n("files_unreadable") > 0, "unreadable files"),
        (n("chunks_with_raw_html") > 0, "raw HTML in chunks"),
        (n("configuration_skipped") > 0, "configuration was skipped"),
        (n("contexts_invalid") > 0, "invalid context cards"),
        ((n("catalogs_seen") > 0) & (n("aliases") == 0), "a catalog gave no aliases"),
    )
    found = F.array_compact(F.array(*(F.when(test, F.lit(text)) for test, text in rules)))
    return audit.crossJoin(sources).select(found.alias("failures"))


def first_offenders(rows: DataFrame, condition: Column, key: str, most: int = 20) -> DataFrame:
    """The first keys of the rows that a gate objects to."""
    return rows.where(condition).select(key).distinct().orderBy(key).limit(most)
