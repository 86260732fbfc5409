"""Index build: source files to the stored relations, with an audit row."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schema
from marlstone.functions import text as X
from marlstone.functions.lexer import chunks_of, configuration_of, libraries_of, redacted, usages_of
from marlstone.operators import cards, dependencies, evaluation, quality
from marlstone.session import materialise
from marlstone.sources import files as S


@dataclass
class Options:
    """Names that a build depends on: the pack, the repository and file of version catalogs, central configuration."""

    pack: str = "pack"
    catalog_repositories: tuple[str, ...] = ()
    catalog_file: str = "libs.versions.toml"
    central: list[str] = field(default_factory=list)
    chunk_chars: int = 7000
    short_chunk: int = 40
    priorities: tuple[int, int, int] = (2, 3, 10)  # of an owner: repository, module, curated card
    strict: bool = False  # whether invalid cards and catalogs, all of them named, end the build


def prepared(files: DataFrame, modules: DataFrame, options: Options) -> DataFrame:
    """Files cleaned, redacted, with module, kind, title and source id."""
    files = S.with_module(files, modules)
    clean = F.when(F.col("language") == "markdown", X.clean_markdown("text")).when(F.col("language") == "html", X.clean_html("text")).otherwise(F.col("text"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = files.withColumn("raw", F.col("text")).withColumn("text", clean)
    config = F.col("language").isin("yaml", "toml", "properties")
    safe = named.where(~config).unionByName(named.where(config).withColumn("text", redacted("text", "language")))
    return safe.withColumns({"kind": X.content_kind(F.col("path"), F.col("language")), "title": X.title("text", stem), "configuration_set": S.configuration_set(F.col("repository"), F.col("path"), options.central), "source_base": X.source_name("repository", "path")})


def chunk_rows(ready: DataFrame, options: Options) -> DataFrame:
    """The chunks relation; short chunks go after numbering, so that numbers keep their gaps."""
    cut = ready.select("*", F.posexplode(chunks_of("text", "language", F.lit(options.chunk_chars))).alias("n", "c"))
    rows = cut.select(
        F.concat("source_base", F.lit("#"), (F.col("n") + 1).cast("string")).alias("source_id"), F.lit(options.pack).alias("pack_id"), *"repository module path kind language".split(),
        "configuration_set", "commit_sha", "c.line_start", "c.line_end", "title", "c.content", F.sha2("c.content", 256).alias("content_hash"),
    )
    return rows.where(F.length("content") >= options.short_chunk)


def carded(spark: SparkSession, ready: DataFrame, every: DataFrame) -> DataFrame:
    """The context cards among the files with their errors and items; ``every`` lists all files, also unread ones."""
    texts = ready.select("repository", "path", "module", "kind", F.when(F.col("kind") == "context", F.col("text")).otherwise(F.col("raw")).alias("text"))
    return materialise(spark, cards.validated(every.select("repository", "path").join(texts, ["repository", "path"], "left")), "cards")


def configuration_rows(ready: DataFrame, options: Options) -> DataFrame:
    """The configuration_values relation; a text that is no YAML gives none."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = ready.where("language = 'yaml' AND kind = 'configuration'").select("*", F.explode(configuration_of("text", name)).alias("v"))
    layer = F.when(F.col("configuration_set") == "", "module").otherwise("central")
    return rows.select(F.col("source_base").alias("source_id"), F.lit(options.pack).alias("pack_id"), *"repository module path v.document configuration_set v.profile".split(), layer.alias("layer"), "v.key_path", "v.value_json")


def catalog_files(ready: DataFrame, options: Options) -> DataFrame:
    """The version catalogs, with their libraries; null for a text that is no catalog."""
    file = F.element_at(F.split("path", "/"), -1)
    return ready.where(F.col("repository").isin(*options.catalog_repositories) & (file == options.catalog_file)).withColumn("libraries", libraries_of("raw"))


def alias_rows(ready: DataFrame, catalogs: DataFrame, options: Options, curated: DataFrame | None = None) -> DataFrame:
    """The dependency_aliases relation with owners among repositories, modules and curated cards (repository, module, names)."""
    rows = catalogs.select(F.col("repository").alias("catalog_repository"), F.col("path").alias("catalog_path"), F.col("commit_sha").alias("catalog_commit_sha"), F.explode("libraries").alias("l"))
    rows = dependencies.distinct_aliases(rows.select("catalog_repository", "catalog_path", "catalog_commit_sha", "l.*"), ["accessor", "group_id", "artifact_id"])
    first, second, _ = options.priorities
    places = ready.select("repository", "module", "module_folder").distinct()
    owners = places.select("repository", F.lit(":").alias("module"), F.array("repository").alias("names"), F.lit(first).alias("priority")).distinct()
    owners = owners.unionByName(places.where("module <> ':'").select("repository", "module", F.array(F.element_at(F.split("module_folder", "/"), -1), F.regexp_replace("module", "^:", "")).alias("names"), F.lit(second).alias("priority")))
    if curated is not None:
        owners = owners.unionByName(curated.select("repository", "module", "names", F.lit(options.priorities[2]).alias("priority")))
    return dependencies.resolve_owners(rows, owners).withColumn("pack_id", F.lit(options.pack)).select(*schema.ALIASES.names)


def usage_rows(ready: DataFrame, aliases: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """The dependency_usages relation, and the usages that match no alias."""
    scripts = ready.where(F.col("path").rlike(r"(^|/)build\.gradle(\.kts)?$"))
    rows = scripts.select(F.col("repository").alias("consumer_repository"), F.col("module").alias("consumer_module"), "path", "commit_sha", F.explode(usages_of("raw")).alias("u")).select("*", "u.accessor", "u.configuration", "u.line").drop("u")
    linked = dependencies.link_usages(rows, aliases).withColumn("pack_id", F.lit(options.pack)).select(*schema.USAGES.names)
    return linked, dependencies.unresolved(rows, aliases)


class Built(NamedTuple):
    """What a build gives: the stored relations, a one-row audit, and the catalog's items."""

    relations: dict[str, DataFrame]
    audit: DataFrame
    catalog: DataFrame


def build(spark: SparkSession, roots: dict[str, str], options: Options | None = None, commits: dict[str, str] | None = None) -> Built:
    """Index repositories (name to folder).

    Context cards that are valid give catalog items, owners and titles; those with errors are not indexed
    and are listed in the audit, as are version catalogs that cannot be read.
    """
    options = options or Options()
    listed = materialise(spark, S.paths(spark, roots), "paths")
    files = materialise(spark, S.scan(spark, roots, commits), "scan")
    modules = materialise(spark, S.modules(files), "modules")
    ready = materialise(spark, prepared(files, modules, options), "files")
    found = carded(spark, ready, listed)
    names = found.where("item is not null").select("repository", "path", F.col("item.id").alias("_name"))
    bad = found.where("item is null").select("repository", "path")
    indexed = ready.join(bad, ["repository", "path"], "left_anti").join(names, ["repository", "path"], "left").withColumn("title", F.coalesce("_name", "title")).drop("_name")
    indexed = materialise(spark, indexed, "indexed")
    catalogs = materialise(spark, catalog_files(indexed, options), "catalogs")
    curated = found.where("item is not null").select("repository", "module", F.concat(F.array("item.id"), "item.aliases").alias("names"))
    aliases = materialise(spark, alias_rows(indexed, catalogs, options, curated), "aliases")
    usages, lost = usage_rows(indexed, aliases, options)
    meta = spark.createDataFrame([("schema_version", str(schema.VERSION)), ("pack_id", options.pack), *(("source", r) for r in sorted(roots))], "key string, value string")
    relations = {"chunks": chunk_rows(indexed, options), "configuration_values": configuration_rows(indexed, options), "dependency_aliases": aliases, "dependency_usages": usages, "knowledge_metadata": meta}
    relations = {n: materialise(spark, df.select(*schema.RELATIONS[n].names), n) for n, df in relations.items()}
    items = cards.merge_catalog(found.where("item is not null").select("item.*").unionByName(cards.guessed_items(modules)))
    if options.strict and (wrong := [*found.where("item is null").select(X.source_name("repository", "path")).toLocalIterator(), *catalogs.where("libraries is null").select(X.source_name("repository", "path")).toLocalIterator()]):
        raise ValueError("invalid context cards or version catalogs: " + ", ".join(sorted(r[0] for r in wrong)))
    audit = materialise(spark, audit_of(spark, options, listed, indexed, found, catalogs, relations, lost), "audit")
    return Built(relations, audit, materialise(spark, items, "catalog"))


def audit_of(spark: SparkSession, options: Options, listed: DataFrame, ready: DataFrame, found: DataFrame, catalogs: DataFrame, relations: dict[str, DataFrame], lost: DataFrame) -> DataFrame:
    """One row: the counters of a build, its fingerprint, the revision of each source, and what could not be used."""
    chunks, values = relations["chunks"], relations["configuration_values"]
    aliases, usages = relations["dependency_aliases"], relations["dependency_usages"]
    docs = F.col("language").isin("markdown", "html")
    per = ready.groupBy("repository").agg(F.max("commit_sha").alias("commit"), F.count("*").alias("files"))
    for df, n in ((chunks, "chunks"), (values, "configuration_values")):
        per = per.join(df.groupBy("repository").agg(F.count("*").alias(n)), "repository", "left")
    revision = F.struct("repository", "commit", "files", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "configuration_values")))
    parts = [
        listed.agg(F.count_if("wanted").alias("files_seen"), F.countDistinct("repository").alias("sources")),
        ready.agg(F.count("*").alias("files"), F.count_if(docs & F.col("text").rlike(X.TAG)).alias("chunks_with_raw_html"), F.count_if(F.col("kind") == "usage").alias("usage_documents")),
        found.agg(F.count_if(F.col("item").isNotNull()).alias("contexts_indexed"), F.count_if(F.col("item").isNull()).alias("contexts_invalid"), F.array_sort(F.collect_list(F.when(F.col("item").isNull(), F.struct(X.source_name("repository", "path").alias("source"), "errors")))).alias("context_errors")),
        catalogs.agg(F.count("*").alias("catalogs_seen"), F.coalesce(F.sum(F.size(F.coalesce("libraries", F.array()))), F.lit(0)).alias("catalog_entries_seen"), F.array_sort(F.collect_list(F.when(F.col("libraries").isNull(), X.source_name("repository", "path")))).alias("catalog_errors")),
        chunks.agg(F.count("*").alias("chunks"), F.countDistinct("content_hash").alias("distinct_chunks")),
        quality.duplicates(chunks).withColumnRenamed("excess", "duplicate_excess"),
        values.agg(F.count("*").alias("configuration_values")),
        aliases.agg(F.count("*").alias("aliases"), F.count_if(F.col("owner_repository") != "").alias("aliases_with_owner")),
        usages.agg(F.count("*").alias("usages")),
        lost.agg(F.count("*").alias("unresolved_usages")),
        per.agg(F.array_sort(F.collect_list(revision)).alias("source_revisions")),
    ]
    row = reduce(DataFrame.crossJoin, parts)  # of one row each
    unread = F.greatest(F.col("files_seen") - F.col("files") - F.col("contexts_invalid"), F.lit(0))
    return row.withColumns({"files_unreadable": unread, "configuration_skipped": F.lit(0), "schema_version": F.lit(schema.VERSION), "fingerprint": F.lit(evaluation.fingerprint(relations)), "pack": F.lit(options.pack)})
