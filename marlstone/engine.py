"""The query interface over a set of stored relations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schema
from marlstone.functions.text import secret_lines, short_commit
from marlstone.operators import cards, configuration, dependencies, evaluation, quality, search
from marlstone.session import scratch
from marlstone.sources import sinks

SEARCH_FILTERS = frozenset("configuration_set kind language module pack_id path repository".split())


class Engine:
    """Searches and lookups; every method returns a DataFrame."""

    def __init__(self, relations: dict[str, DataFrame], audit: DataFrame | None = None, catalog: DataFrame | None = None, index: search.Index | None = None):
        self.relations = relations
        self.chunks, self.values = relations["chunks"], relations["configuration_values"]
        self.aliases, self.usages = relations["dependency_aliases"], relations["dependency_usages"]
        self._audit, self._catalog, self._index = audit, catalog, index

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        """The engine over a published folder, searching its stored index."""
        extra = [sinks.load_extra(spark, folder, n) for n in ("audit", "catalog")]
        return cls(sinks.load(spark, folder), *extra, search.read_index(spark, f"{folder}/index"))

    @property
    def index(self) -> search.Index:
        """The stored index; of relations that were not published it is written once."""
        if self._index is None:
            spark = self.chunks.sparkSession
            folder = scratch(spark, "index")
            search.write_index(self.chunks, folder)
            self._index = search.read_index(spark, folder)
        return self._index

    def search(self, query: str, limit: int = 5, **filters: str) -> DataFrame:
        """Best chunks with a highlighted snippet; limits are 1 to 10, filters equalities."""
        if strange := set(filters) - SEARCH_FILTERS:
            raise ValueError(f"no such filter: {', '.join(sorted(strange))}")
        best = search.search(self.index, {0: query}, min(max(limit, 1), 10), filters).drop("query_id")
        text = best.join(self.chunks.select("source_id", "content"), "source_id").withColumn("snippet", search.snippet("content", search.phrases(query)))
        return text.drop("content").withColumn("commit_sha", short_commit("commit_sha")).orderBy("position")

    def search_config(self, query: str, limit: int = 5, **filters: str) -> DataFrame:
        return self.search(query, limit, **(filters | {"kind": "configuration"}))

    def suggest_dependency(self, query: str, scope: str = "implementation") -> DataFrame:
        return dependencies.suggestion(self.aliases, self.usages, query, scope)

    def find_usages(self, query: str, repository: str = "", limit: int = 20) -> DataFrame:
        return dependencies.usage_budget(dependencies.matching(self.aliases, query), self.usages, limit, repository)

    def resolve_config(self, application: str, configuration_set: str, profile: str = "", module: str = "") -> DataFrame:
        if not application or not configuration_set:
            raise ValueError("application and configuration_set are needed")
        return configuration.resolve(self.values, application, configuration_set, profile, module)

    def get_source(self, source_id: str) -> DataFrame:
        """One chunk, or all chunks of a file in string order of their ids."""
        wanted = F.col("source_id") == source_id if "#" in source_id else F.col("source_id").startswith(source_id + "#")
        return self.chunks.where(wanted).withColumn("commit_sha", short_commit("commit_sha")).orderBy("source_id")

    def repositories(self) -> DataFrame:
        return quality.inventory(self.chunks).withColumn("commit_sha", short_commit("commit_sha")).orderBy("repository")

    def catalog(self) -> DataFrame | None:
        return None if self._catalog is None else sinks.catalog_markdown(self._catalog)

    def audit(self) -> DataFrame | None:
        return self._audit

    def gate(self) -> DataFrame:
        """Counters of defects over chunks and usages, and whether all are 0."""
        return quality.gate(quality.chunk_gate(self.chunks), quality.usage_gate(self.usages, self.aliases))

    def evaluate(self, definition: dict) -> tuple[DataFrame, DataFrame]:
        """Metrics and cases of a definition's retrieval cases, all in one job."""
        return evaluation.retrieval(self.index, definition)

    def evaluate_dependencies(self, definition: dict) -> tuple[DataFrame, DataFrame]:
        """Metrics and cases of a definition's dependency cases."""
        return evaluation.dependency(self.aliases, self.usages, definition)

    def verify(self, definition: str | None = None, expect: list[str] | None = None) -> dict:
        """The whole gate as a report: schemas, counters of defects, fixed searches, audit, evaluation, and passed.

        ``definition`` is the JSON text of the evaluation cases; ``expect`` are searches that must find something.
        """
        errors = [e for n, df in self.relations.items() for e in schema.problems(n, df)]
        report = {"schema_version": schema.VERSION, "fingerprint": evaluation.fingerprint(self.relations)} | self.gate().first().asDict()
        clean = report.pop("passed")
        report["raw_html_sources"] = [r[0] for r in quality.first_offenders(self.chunks, F.col("kind").isin("docs", "usage") & quality.raw_html("content"), "source_id").collect()]
        leaks = (F.col("kind") == "configuration") & (F.size(secret_lines("content")) > 0)
        report["secret_sources"] = [r[0] for r in quality.first_offenders(self.chunks, leaks, "source_id").collect()]
        report["expected"] = {r["query"]: r["n"] for r in evaluation.probe(self.index, list(expect or [])).collect()} if expect else {}
        audit = self._audit.first().asDict(recursive=True) if self._audit is not None else None
        failures = ["there is no audit"]
        if audit is not None:
            report["audit_sha256"] = sinks.text_digest(json.dumps(audit, sort_keys=True, default=str))
            revisions = self._audit.select(F.explode("source_revisions").alias("r")).select(F.col("r.repository").alias("source"), F.col("r.commit").alias("commit"))
            failures = list(quality.audit_failures(self._audit, revisions, schema.VERSION, report["fingerprint"]).first()[0])
        report["audit_failures"] = failures
        evaluated = True
        if definition is not None:
            report["definition_sha256"] = sinks.text_digest(definition)
            try:
                cases = json.loads(definition)
                for name, (metrics, results) in (("retrieval", self.evaluate(cases)), ("dependencies", self.evaluate_dependencies(cases))):
                    report[name] = metrics.first().asDict() | {"results": [r.asDict(recursive=True) for r in results.orderBy("id").collect()]}
                    evaluated = evaluated and report[name]["passed"]
            except ValueError as e:
                errors.append(str(e))
        report["errors"] = errors
        report["passed"] = bool(clean and not errors and not failures and evaluated and all(report["expected"].values()))
        return report

    @staticmethod
    def validate_cards(files: DataFrame) -> DataFrame:
        """source, errors of the context cards among files (repository, path, module, kind, text) that have any."""
        found = cards.validated(files)
        return found.where("item is null").select(F.concat_ws(":", "repository", "path").alias("source"), "errors")
