"""Evaluation of an index by a JSON definition of retrieval and dependency cases, each sort of cases in one job."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import letters_only
from marlstone.operators import dependencies, search
from marlstone.session import spread

FILTERS = frozenset("repository module kind language path".split())
CONSUMER = {"alias": "alias", "accessor": "accessor", "repository": "consumer_repository", "module": "consumer_module", "path": "path", "configuration": "configuration", "commit": "commit_sha", "line": "line"}
COMMIT = "^[0-9a-f]{40,64}$"


def load_definition(spark: SparkSession, path: str) -> dict:
    """A definition from a JSON file on any file system that Spark reads; ValueError if it is no JSON object."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not an object")
    return found


def _named(cases: list[dict], sort: str) -> list[dict]:
    names = [c.get("id") for c in cases]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError(f"{sort}: ids are missing or repeated")
    if lacking := [c["id"] for c in cases if not c.get("query")]:
        raise ValueError(f"{sort}: no query in {', '.join(lacking)}")
    return cases


def _top_k(value) -> int:
    return min(max(int(value), 1), 20)


def retrieval_cases(definition: dict) -> list[dict]:
    """The checked retrieval cases, each with its top_k."""
    cases = _named(definition.get("cases", []), "cases")
    if not cases:
        raise ValueError("cases: there are none")
    for c in cases:
        if not c.get("expect_no_results") and not c.get("expected_sources") and not c.get("expected_paths"):
            raise ValueError(f"cases: {c['id']} expects nothing")
    return [c | {"top_k": _top_k(c.get("top_k", definition.get("top_k", 5)))} for c in cases]


def _rate(value: Column, of: Column) -> Column:
    return F.coalesce(F.avg(F.when(of, value.cast("double"))), F.lit(1.0))


def retrieval(index: search.Index, definition: dict) -> tuple[DataFrame, DataFrame]:
    """(one row of metrics, a row for each case) of a definition's retrieval cases.

    A case is found by its best result among expected sources (repository:path) or paths, within its own
    filters and top_k; one that expects no result passes without any. A rate without cases is 1.
    """
    spark = index.rows.sparkSession
    cases = retrieval_cases(definition)
    schema = "query_id long, id string, query string, top_k int, expect_no_results boolean, expected_sources array<string>, expected_paths array<string>"
    table = spark.createDataFrame([(k, c["id"], c["query"], c["top_k"], bool(c.get("expect_no_results")), c.get("expected_sources") or [], c.get("expected_paths") or []) for k, c in enumerate(cases)], schema)
    asked = [(k, f, str(v)) for k, c in enumerate(cases) for f, v in (c.get("filters") or {}).items() if f in FILTERS and v]
    filters = spark.createDataFrame(asked, "query_id long, field string, value string")
    terms = search.query_terms(spark, {k: c["query"] for k, c in enumerate(cases)})
    scores = search.narrowed(index, search.bm25(index, terms), filters)
    best = search.ranked(index, scores, table.select("query_id", "top_k"))
    found = best.select("query_id", "position", "path", F.concat_ws(":", "repository", "path").alias("source")).join(table, "query_id")
    hit = F.array_contains("expected_sources", F.col("source")) | F.array_contains("expected_paths", F.col("path"))
    each = found.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "source"))), lambda x: x["source"]).alias("retrieved_sources"),
        F.min(F.when(hit, F.col("position"))).alias("rank"), F.min_by("source", F.when(hit, F.col("position"))).alias("matched_source"),
    )
    rows = table.join(each, "query_id", "left").withColumn("retrieved_sources", F.coalesce("retrieved_sources", F.array().cast("array<string>")))
    no = F.col("expect_no_results")
    results = rows.select(
        "id", "query", "top_k", "expected_sources", "expected_paths", "expect_no_results", "retrieved_sources",
        F.when(~no & F.col("rank").isNotNull(), F.col("matched_source")).alias("matched_source"), F.when(~no, F.col("rank").isNotNull().cast("double")).alias("recall"),
        F.when(~no, F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("reciprocal_rank"), F.when(no, F.size("retrieved_sources") == 0).otherwise(F.col("rank").isNotNull()).alias("passed"),
    )
    least = definition.get("thresholds", {})
    metrics = results.agg(F.count("*").alias("cases"), F.count_if(~no).alias("positive_cases"), F.count_if(no).alias("negative_cases"), _rate(F.col("recall"), ~no).alias("recall_at_k"), _rate(F.col("reciprocal_rank"), ~no).alias("mrr"), _rate(F.col("passed"), no).alias("negative_pass_rate"))
    passed = (F.col("recall_at_k") >= float(least.get("min_recall_at_k", 1.0))) & (F.col("mrr") >= float(least.get("min_mrr", 0.8))) & (F.col("negative_pass_rate") >= float(least.get("min_negative_pass_rate", 1.0)))
    metrics = metrics.withColumn("passed", passed).withColumns({c: F.round(c, 6) for c in ("recall_at_k", "mrr", "negative_pass_rate")})
    return metrics, results


def matched_aliases(aliases: DataFrame, cases: DataFrame) -> DataFrame:
    """The columns of ``cases`` (with query) and of the aliases that hold all terms of a case's query."""
    words = F.filter(F.regexp_extract_all(F.lower("query"), F.lit(r"(?U)[\w-]+"), F.lit(0)), lambda w: ~w.isin("libs", "library", "dependency"))
    terms = cases.withColumn("_terms", F.transform(words, letters_only)).where(F.size("_terms") > 0)
    text = letters_only(F.concat_ws(" ", *"alias accessor group_id artifact_id owner_repository owner_module".split()))
    named = aliases.withColumn("_text", text)
    return named.join(terms, F.forall("_terms", lambda t: F.contains(F.col("_text"), t))).drop("_terms", "_text")  # nested loop: substrings have no key


def dependency(aliases: DataFrame, usages: DataFrame, definition: dict) -> tuple[DataFrame, DataFrame]:
    """(one row of metrics, a row for each case) of a definition's dependency cases.

    A positive case passes if any expected alias is among the found ones, any expected consumer (null fields match
    all) among their usages, and all these usages have their full provenance; a negative one if no alias is found.
    A draft that still asks for review fails.
    """
    spark = aliases.sparkSession
    cases = _named(definition.get("dependency_cases", []), "dependency_cases")
    for c in cases:
        if not c.get("expect_no_results") and not c.get("expected_aliases") and not c.get("expected_consumers"):
            raise ValueError(f"dependency_cases: {c['id']} expects nothing")
        for want in c.get("expected_consumers") or []:
            if not want or set(want) - set(CONSUMER):
                raise ValueError(f"dependency_cases: {c['id']} has a consumer without fields or with unknown ones")
    fields = ", ".join(f"{f}: {'int' if f == 'line' else 'string'}" for f in CONSUMER)
    schema = f"id string, query string, repository string, expect_no_results boolean, expected_aliases array<string>, expected_consumers array<struct<{fields}>>"
    rows = [(c["id"], c["query"], c.get("repository") or "", bool(c.get("expect_no_results")), c.get("expected_aliases") or [], [tuple(w.get(f) for f in CONSUMER) for w in c.get("expected_consumers") or []]) for c in cases]
    table = spark.createDataFrame(rows, schema)
    found = matched_aliases(aliases, F.broadcast(table.select("id", "query", F.col("repository").alias("_asked"))))  # the definition's size
    names = found.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("retrieved_aliases"))
    used = found.select("id", "_asked", *dependencies.ALIAS).join(spread(usages, *dependencies.ALIAS), dependencies.ALIAS).where((F.col("_asked") == "") | (F.col("_asked") == F.col("consumer_repository")))
    used = used.select("id", *(F.col(c).alias(f) for f, c in CONSUMER.items())).join(F.broadcast(table.select("id", "expected_consumers")), "id")  # a shuffle would gather a case in one task
    sure = F.forall(F.array("repository", "module", "path", "configuration"), lambda v: F.length(v) > 0) & F.col("commit").rlike(COMMIT) & (F.col("line") >= 1)
    meets = F.exists("expected_consumers", lambda w: _all(w[f].isNull() | (w[f] == F.col(f)) for f in CONSUMER))
    consumers = used.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(*CONSUMER))).alias("retrieved_consumers"), F.bool_and(sure).alias("_sure"), F.bool_or(meets).alias("_met"))
    every = table.join(names, "id", "left").join(consumers, "id", "left")
    have = F.coalesce("retrieved_aliases", F.array().cast("array<string>"))
    alias_match = (F.size("expected_aliases") == 0) | F.arrays_overlap("expected_aliases", have)
    consumer_match = (F.size("expected_consumers") == 0) | F.coalesce("_met", F.lit(False))
    provenance = F.coalesce("_sure", F.lit(True))
    no = F.col("expect_no_results")
    results = every.select(
        "id", "query", "repository", "expected_aliases", "expected_consumers", "expect_no_results", have.alias("retrieved_aliases"), "retrieved_consumers",
        F.when(~no, alias_match).alias("alias_match"), F.when(~no, consumer_match).alias("consumer_match"), provenance.alias("provenance_valid"),
        F.when(no, F.size(have) == 0).otherwise(alias_match & consumer_match & provenance).alias("passed"),
    )
    least = definition.get("thresholds", {})
    reviewed = not (definition.get("dependency_case_draft") or {}).get("review_required")
    metrics = results.agg(F.count("*").alias("cases"), F.count_if(~no).alias("positive_cases"), F.count_if(no).alias("negative_cases"), _rate(F.col("passed"), F.lit(True)).alias("pass_rate"))
    passed = F.lit(reviewed) & (F.col("positive_cases") >= max(int(least.get("min_dependency_cases", 0)), 0)) & (F.col("pass_rate") >= float(least.get("min_dependency_pass_rate", 1.0)))
    return metrics.withColumn("review_acknowledged", F.lit(reviewed)).withColumn("passed", passed).withColumn("pass_rate", F.round("pass_rate", 6)), results


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def probe(index: search.Index, expressions: list[str]) -> DataFrame:
    """query, n: how many rows each fixed search finds; 0 where it has no term."""
    spark = index.rows.sparkSession
    queries = spark.createDataFrame(list(enumerate(expressions)), "query_id long, query string")
    found = search.matches(index, search.query_terms(spark, dict(enumerate(expressions)))).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(found, "query_id", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))


def fingerprint(relations: dict[str, DataFrame]) -> str:
    """A digest of the rows of all relations, whatever their order and files."""
    parts = []
    for name, df in sorted(relations.items()):
        h = F.xxhash64(*sorted(df.columns))
        row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)")).alias("b")).first()
        parts.append(f"{name}:{row.n}:{row.a}:{row.b}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()

