"""The engine's operators as queries over the bundled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.engine import Engine
from marlstone.functions import text as X
from marlstone.functions.lexer import chunks_of, configuration_of, libraries_of, usages_of
from marlstone.operators import cards, configuration, dependencies, evaluation, quality, search
from marlstone.plans import build
from marlstone.session import scratch, spread, table
from marlstone.sources import sinks

KINDS = "context usage docs example source configuration".split()
QUERY = "Licensed under-the Apache"
LIMIT = 5


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as indexed chunks: source is the repository, the kind follows doc_id."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("repository"), F.concat(F.lit(":"), F.col("lang")).alias("module"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("kind"), F.col("lang").alias("language"),
        F.substring(F.sha2(F.concat("source", "lang"), 256), 1, 40).alias("commit_sha"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"),
        F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as catalog aliases."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-"), F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_brand").alias("catalog_repository"), F.col("p_type").alias("catalog_path"), name.alias("alias"), X.accessor(name).alias("accessor"),
        F.col("p_brand").alias("group_id"), F.lower("p_name").alias("artifact_id"), F.col("p_partkey").alias("key"),
    )


def repo_inventory(spark, sf_dir):
    return quality.inventory(chunks(spark, sf_dir))


def chunk_kind_counts(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("kind", X.kind_priority("kind").alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("repository").alias("repositories"))


def dup_groups(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("source_id").alias("first_id")).where("n > 1")


def dup_excess(spark, sf_dir):
    return quality.duplicates(chunks(spark, sf_dir))


def token_stats(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("dl", F.size(X.tokens("content")))
    return c.groupBy("language").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("tokens"), F.max("dl").alias("longest"), F.round(F.avg("dl"), 6).alias("avgdl"))


def doc_freq(spark, sf_dir):
    t = chunks(spark, sf_dir).select(F.explode(F.array_distinct(X.tokens("content"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")


def index_of(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored index of the documents of a folder, written by the session's first search of it."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _INDEXES:
        folder = scratch(spark, "index")
        search.write_index(chunks(spark, sf_dir), folder, fields=("content",))
        _INDEXES[at] = folder
    return search.read_index(spark, _INDEXES[at])


_INDEXES: dict[tuple[str, str], str] = {}


def bm25_top(spark, sf_dir):
    best = search.search(index_of(spark, sf_dir), {0: QUERY}, LIMIT)
    return best.select("position", "source_id", "repository", "kind", F.round("rank", 6).alias("score"))


def bm25_scores(spark, sf_dir):
    scores = search.bm25(index_of(spark, sf_dir), search.query_terms(spark, {0: QUERY}))
    return scores.select("source_id", F.round("rank", 6).alias("score"))


def phrase_match(spark, sf_dir):
    terms = search.query_terms(spark, {0: "general-public-license", 1: "version-2", 2: "on-the on"})
    return search.matches(index_of(spark, sf_dir), terms).select("query_id", "source_id")


def _cases(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 4), " ").alias("query"))


def _batch(spark, sf_dir) -> DataFrame:
    index = index_of(spark, sf_dir)
    return search.ranked(index, search.bm25(index, search.term_columns(_cases(spark, sf_dir))), LIMIT)


def bm25_batch(spark, sf_dir):
    """Top results of every benchmark item's first words, all items in one job."""
    return _batch(spark, sf_dir).select("query_id", "position", "source_id", F.round("rank", 6).alias("score"))


def recall_mrr(spark, sf_dir):
    """Metrics of the same searches, a passage's documents being those that hold it."""
    index = index_of(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    close = search.holding(index, items).join(items, "query_id").withColumnRenamed("query", "passage")
    texts = chunks(spark, sf_dir).select("source_id", "path", "content")
    expected = close.join(texts, "source_id").where(F.contains("content", "passage")).select("query_id", "path")
    cases = expected.select("query_id").distinct().withColumn("expect_no_results", F.lit(False))
    return quality.retrieval_metrics(_batch(spark, sf_dir).select("query_id", "position", "path"), expected, cases)


def greedy_dedup_top(spark, sf_dir):
    """Greedy de-duplication by content or (repository, language) over the longest documents."""
    d = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(LIMIT * search.OVERFETCH)
    row = F.struct((-F.col("n_chars")).alias("k"), "doc_id", F.sha2("text", 256).alias("h"), F.concat_ws("|", "source", "lang").alias("s"))
    rows = d.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kept = rows.select(F.posexplode(search.greedy(F.col("rows"), "h", "s", 10)).alias("position", "r"))
    return kept.select((F.col("position") + 1).alias("position"), "r.doc_id", F.col("r.s").alias("source_key"))


def html_clean(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("clean", F.trim(F.regexp_replace(X.clean_html("html"), r"\s+", " ")))
    return p.select("page_id", F.sha2("clean", 256).alias("text_hash"), F.length("clean").alias("n_chars"))


def html_gate(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.agg(F.count("*").alias("pages"), F.count_if(quality.raw_html("html")).alias("raw"), F.count_if(quality.raw_html(X.clean_html("html"))).alias("raw_after_cleaning"))


def redact_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    red = X.redact_lines(F.regexp_replace("text", r"[.,]? ([A-Za-z_]+ = )", "\n$1"))
    return d.select("doc_id", F.sha2(red, 256).alias("text_hash"), F.size(F.filter(F.split(red, "\n"), lambda s: F.contains(s, F.lit("<redacted>")))).alias("redacted")).where("redacted > 0")


def secret_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("lines", F.regexp_replace("text", r"[.,]? ([A-Za-z_]+ = )", "\n$1"))
    return d.agg(F.count_if(F.size(X.secret_lines("lines")) > 0).alias("leaks"), F.count_if(F.size(X.secret_lines(X.redact_lines("lines"))) > 0).alias("leaks_after_redaction"))


def title_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace("text", r"^", "# ")
    return d.select("doc_id", X.title(F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("text")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


def kind_case(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^[a-z]+://[^/]+/|[?#].*$", "").alias("path"), F.col("page_id"))
    language = F.when(F.col("page_id") % 3 == 0, "yaml").when(F.col("page_id") % 3 == 1, "html").otherwise("kotlin")
    path = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("latest/"), F.col("path"))).otherwise(F.col("path"))
    return p.select(X.content_kind(path, language).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def _conversations(spark, sf_dir, line: Column) -> DataFrame:
    """Conversations as texts of one line for each turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))


def _flat(text: str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def heading_split(spark, sf_dir):
    """Conversations as Markdown with a heading at each user turn, cut at the headings."""
    t = _conversations(spark, sf_dir, F.concat(F.when(F.col("role") == "user", F.lit("# ")).otherwise(""), _flat("text")))
    cut = t.select("conv_id", F.posexplode(chunks_of("text", F.lit("markdown"), F.lit(100_000))).alias("position", "c"))
    return cut.select("conv_id", "position", "c.line_start", "c.line_end", F.length("c.content").alias("n_chars"), F.sha2("c.content", 256).alias("content_hash"))


def short_chunk_filter(spark, sf_dir):
    """Chunks are numbered before the short ones go, so numbers keep their gaps."""
    t = _conversations(spark, sf_dir, _flat("text"))
    empty = [F.lit("").alias(n) for n in "repository module path kind configuration_set commit_sha title".split()]
    ready = t.select(F.col("conv_id").cast("string").alias("source_base"), "text", F.lit("text").alias("language"), *empty)
    return build.chunk_rows(ready, build.Options(chunk_chars=1)).select(F.col("source_id").alias("chunk_id"), "content_hash")


def turn_ranges(spark, sf_dir):
    """Line ranges of chunks of at most 120 characters or one line, less blank lines at their ends."""
    t = _conversations(spark, sf_dir, F.concat(F.lit("\n"), F.rpad(F.substring(_flat("text"), 1, 99), 99, "x"), F.lit("\n")))
    cut = t.select("conv_id", F.posexplode(chunks_of("text", F.lit("text"), F.lit(120))).alias("turn", "c"))
    return cut.select("conv_id", "turn", "c.line_start", "c.line_end", F.length("c.content").alias("n_chars"))


def json_leaves(spark, sf_dir):
    """The leaves of events' properties, read as configuration documents."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(configuration_of("props", F.lit("application.yml"))).alias("v"))
    value = F.col("v.value_json").cast("long")
    return e.groupBy("event_type", F.col("v.key_path").alias("key_path")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def layered_resolve(spark, sf_dir):
    """The strongest layer's latest value of each user's key; event types are the layers."""
    e = table(spark, sf_dir, "events")
    rank = F.expr("CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END")
    rows = e.select(F.col("user_id"), F.explode(F.from_json("props", "map<string,string>")).alias("key_path", "value_json"), F.col("event_type").alias("layer"), F.lit("").alias("profile"), F.col("event_id").alias("source_id"), F.date_format("ts", "yyyyMMddHHmmss").alias("path"))
    return configuration.strongest(rows, ["user_id", "key_path"], F.expr("CASE layer WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END")).select("user_id", "key_path", "value_json", "layer", "source_id")


def config_four_layers(spark, sf_dir):
    """resolve() with a profile over events as configuration values."""
    e = table(spark, sf_dir, "events")
    v = e.select(
        F.when(F.col("event_type").isin("view", "click"), "central").otherwise("module").alias("layer"),
        F.when(F.col("event_type").isin("click", "purchase", "error"), "prod").otherwise("").alias("profile"),
        F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string")).alias("repository"), F.lit(":").alias("module"),
        F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("set"), (F.col("user_id") % 2).cast("string"))).otherwise("").alias("configuration_set"),
        F.concat(F.lit("key."), (F.col("user_id") % 97).cast("string")).alias("key_path"), F.col("event_id").cast("string").alias("value_json"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.col("event_id").cast("string").alias("source_id"),
    )
    return configuration.resolve(v, "app1", "set0", "prod").select("key_path", "value_json", "layer", "profile")


def _usages(spark, sf_dir) -> DataFrame:
    """lineitem as usages of part: the supplier is the consumer."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("key"), F.format_string("Supplier#%05d", "l_suppkey").alias("consumer_repository"), F.lit(":").alias("consumer_module"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("path"), F.lit("api").alias("configuration"), F.col("l_linenumber").alias("line"),
    )


def _linked(spark, sf_dir) -> DataFrame:
    u = spread(_usages(spark, sf_dir), "key", rows=table(spark, sf_dir, "lineitem").count())
    return u.join(aliases(spark, sf_dir).select("key", *dependencies.ALIAS), "key")


def alias_usage_join(spark, sf_dir):
    """Usages linked with the aliases of their accessor."""
    a = aliases(spark, sf_dir)
    n = table(spark, sf_dir, "lineitem").count()
    u = spread(_usages(spark, sf_dir), "key", rows=n).join(a.select("key", "accessor"), "key").drop("key")
    j = dependencies.link_usages(u, a, n)
    return j.groupBy("catalog_repository").agg(F.count("*").alias("usages"), F.countDistinct(*dependencies.ALIAS).alias("aliases"), F.countDistinct("consumer_repository").alias("consumers"))


def usage_budget(spark, sf_dir):
    """The first 20 usages, shared in order by the aliases that match a request."""
    a = dependencies.matching(aliases(spark, sf_dir).withColumns({"owner_repository": F.lit(""), "owner_module": F.lit("")}), "Brand#1 library")
    return dependencies.usage_budget(a, _linked(spark, sf_dir), 20).select("alias", "catalog_path", "consumer_repository", "path", "line")


def orphan_usages(spark, sf_dir):
    """Usages of aliases that are in no catalog."""
    known = aliases(spark, sf_dir).join(table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("key")), "key", "left_semi")
    return dependencies.orphans(_linked(spark, sf_dir), known).groupBy(F.col("key").alias("l_partkey")).agg(F.count("*").alias("orphans"))


def owner_resolve(spark, sf_dir):
    """Owners of nations among suppliers and customers: suppliers have the higher priority."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("repository"), F.lit("supplier").alias("module"), F.lit(3).alias("priority"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("repository"), F.lit("customer").alias("module"), F.lit(2).alias("priority"))
    both = s.where("k % 2 = 0").unionByName(c).join(F.broadcast(n), F.col("k") == F.col("n_nationkey"))  # 25 nations
    candidates = both.select("repository", "module", "priority", F.array("n_name", F.concat("n_name", F.lit("-lib"))).alias("names"))
    owned = dependencies.resolve_owners(n.select("n_nationkey", F.lower("n_name").alias("artifact_id")), candidates)
    return owned.select("n_nationkey", "owner_repository", "owner_module")


def topk_consumers(spark, sf_dir):
    """The first three usages of each alias."""
    best = dependencies.consumers(aliases(spark, sf_dir), _linked(spark, sf_dir), 3)
    return best.select("alias", F.col("n").alias("position"), "consumer_repository", "path", "line")


def alias_terms_match(spark, sf_dir):
    a = aliases(spark, sf_dir).withColumns({"owner_repository": F.lit(""), "owner_module": F.lit("")})
    return dependencies.matching(a, "libs brand-1 7").select("alias", "accessor")


def accessor_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.accessor(F.concat_ws("__", "p_type", "p_brand", "p_name")).alias("accessor"), X.letters_only("p_brand").alias("letters"), X.ascii_only("p_name").alias("ascii"))


def fallback_join(spark, sf_dir):
    """Usages whose accessor matches after a provider call is taken off."""
    a = aliases(spark, sf_dir).where("key % 3 <> 0")
    tail = F.element_at(F.array(F.lit(""), F.lit(".get"), F.lit(".orNull"), F.lit(".getOrNull"), F.lit(".map")), (F.col("l_orderkey") % 5 + 1).cast("int"))
    names = aliases(spark, sf_dir).select(F.col("key").alias("l_partkey"), F.col("accessor").alias("_a"))
    li = table(spark, sf_dir, "lineitem").join(names, "l_partkey")
    u = li.select(F.concat("_a", tail).alias("accessor"), F.lit("c").alias("consumer_repository"), F.lit(":").alias("consumer_module"), F.col("l_orderkey").alias("path"), F.lit("api").alias("configuration"), F.col("l_linenumber").alias("line"))
    linked = dependencies.link_usages(u, a).agg(F.count("*").alias("linked"), F.countDistinct("alias").alias("aliases"))
    return linked.crossJoin(dependencies.unresolved(u, a).agg(F.count("*").alias("unresolved")))


def gate_summary(spark, sf_dir):
    c = chunks(spark, sf_dir)
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), "quality")
    orphan = marks.join(c.select("source_id"), "source_id", "left_anti").agg(F.count("*").alias("orphan_labels"))
    return quality.gate(quality.chunk_gate(c), orphan)


def catalog_lines(spark, sf_dir):
    """Regions as catalog items, their nations as sources."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    items = j.groupBy(F.col("r_name").alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("sources"), F.array_sort(F.collect_set(F.lower(F.substring("n_name", 1, 3)))).alias("aliases"))
    items = items.withColumns({"type": F.lit("region"), "status": F.lit(None).cast("string"), "capabilities": F.array(F.lit("docs"), F.lit("api"))})
    return sinks.catalog_markdown(items)


def catalog_merge(spark, sf_dir):
    """Suppliers as curated items of their nation, nations as guessed ones: a guessed item of a covered source goes."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_name").alias("id"), F.lit("curated").alias("status"), F.array("s_nationkey").alias("sources"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("discovered").alias("status"), F.array("n_nationkey").alias("sources"))
    return cards.merge_catalog(s.unionByName(n)).select("id", "status", F.col("sources")[0].alias("source"))


def manifest_check(spark, sf_dir):
    """Errors of parts as catalog entries: types and sources that are unknown, capabilities that are missing."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("library", "guide", "gadget", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    entries = p.select(F.col("p_partkey").alias("id"), kind.alias("type"), F.array(F.col("p_partkey") % 150).alias("source_modules"), F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("api"))).alias("capabilities"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return cards.manifest_errors(entries, known).select("id", F.regexp_replace("error", r" \d+$", "").alias("error"))


def probe_terms(spark, sf_dir):
    """How many rows fixed searches find."""
    return evaluation.probe(index_of(spark, sf_dir), ["general public license", "version-2", "the", "Übermut", "nosuchword", "___"])


def filtered_search(spark, sf_dir):
    """The metrics of retrieval cases with filters and limits of their own."""
    cases = [{"id": f"{k}{lang}", "query": "licensed under the", "filters": {"kind": k, "language": lang}, "top_k": 3, "expected_paths": ["docs/2.md", "docs/20.md"]} for k in ("docs", "source") for lang in ("en", "fr")]
    cases.append({"id": "none", "query": "nosuchword", "expect_no_results": True})
    _, results = evaluation.retrieval(index_of(spark, sf_dir), {"cases": cases})
    return results.select("id", F.array_join("retrieved_sources", " ").alias("retrieved"), "passed")


def dependency_rate(spark, sf_dir):
    """A dependency case for each brand: the first usage of one of its aliases is expected, of every fifth a wrong one."""
    a = aliases(spark, sf_dir).withColumns({"owner_repository": F.lit(""), "owner_module": F.lit("")})
    u = _linked(spark, sf_dir).withColumns({"accessor": F.lit("a"), "commit_sha": F.lit("0" * 40)})
    brands = [f"Brand#{k}" for k in range(1, 6)]
    first = {r[0]: r for r in u.where(F.col("catalog_repository").isin(brands)).groupBy("catalog_repository").agg(F.min_by(F.struct("alias", "consumer_repository", "line"), F.struct("alias", "consumer_repository", "path", "line")).alias("u")).collect()}
    cases = [{"id": b, "query": b.replace("#", ""), "expected_consumers": [{"alias": r.u.alias, "repository": r.u.consumer_repository, "line": r.u.line if k % 5 else 99}]} for k, (b, r) in enumerate(sorted(first.items()))]
    metrics, _ = evaluation.dependency(a, u, {"dependency_cases": [*cases, {"id": "none", "query": "nosuchalias", "expect_no_results": True}]})
    return metrics


def script_usages(spark, sf_dir):
    """Usages found in build scripts made of parts: calls, wrapped calls, statements, added ones, comments and strings."""
    a = aliases(spark, sf_dir)
    shapes = ["implementation(libs.%s)", "api(platform(libs.%s))", "runtimeOnly libs.%s", "add(\"ksp\", libs.%s)", "// api(libs.%s)", "val s = \"libs.%s\""]
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.col("key") % 6 + 1).cast("int"))
    scripts = a.select("key", F.concat(F.lit("dependencies {\n  "), F.replace(shape, F.lit("%s"), F.col("accessor")), F.lit("\n}\n")).alias("text"))
    return scripts.select("key", F.explode(usages_of("text")).alias("u")).select("key", "u.accessor", "u.configuration", "u.line")


def catalog_entries(spark, sf_dir):
    """Libraries of version catalogs made of parts: strings, modules with references, groups with rich versions, and no TOML."""
    a = aliases(spark, sf_dir)
    g, n = F.lower(F.regexp_replace("group_id", "[^A-Za-z0-9]", "")), F.replace("artifact_id", F.lit(" "), F.lit("-"))
    lines = [F.concat(F.lit(" = \""), g, F.lit(":"), n, F.lit(":1."), "key", F.lit("\"")), F.concat(F.lit(" = { module = \""), g, F.lit(":"), n, F.lit("\", version.ref = \"v\" }")), F.concat(F.lit(" = { group = \""), g, F.lit("\", name = \""), n, F.lit("\", version = { strictly = \"3\" } }")), F.lit(" = {")]
    shape = F.col("key") % 4
    body = F.when(shape == 0, lines[0]).when(shape == 1, lines[1]).when(shape == 2, lines[2]).otherwise(lines[3])
    text = F.concat(F.lit("[versions]\nv = \"2\"\n[libraries]\n"), "alias", body, F.lit("\n"))
    rows = a.select("key", libraries_of(text).alias("l"))
    return rows.select("key", F.col("l").isNull().alias("malformed"), F.explode_outer("l").alias("x")).select("key", "malformed", "x.alias", "x.accessor", "x.group_id", "x.artifact_id", "x.version_ref", "x.version_value")


def snapshot_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    before = d.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256))
    after = d.where("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return quality.snapshot_diff(before, after).select(F.col("path").alias("doc_id"), "change")


def status_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'successful' END")
    return quality.status_summary(o.select(status.alias("status"), (F.col("o_orderkey") % 4).alias("attempts")))


def source_lookup(spark, sf_dir):
    """Chunks of sources by id prefix, in string order."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("#", F.concat(F.lit("conv"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("source_id"), "role", F.length("text").alias("n_chars"), F.lit("").alias("commit_sha"))
    engine = Engine({"chunks": c, "configuration_values": c, "dependency_aliases": c, "dependency_usages": c})
    return engine.get_source("conv1").unionByName(engine.get_source("conv12")).unionByName(engine.get_source("conv3#1")).drop("commit_sha")


def snippets(spark, sf_dir):
    m = search.matches(index_of(spark, sf_dir), search.query_terms(spark, {0: "license"})).select("source_id")
    return chunks(spark, sf_dir).join(m, "source_id").select("source_id", search.snippet("content", [["license"]], 12).alias("snippet"))


QUERIES = {
    f.__name__: f
    for f in (
        repo_inventory, chunk_kind_counts, dup_groups, dup_excess, token_stats, doc_freq, bm25_top, bm25_scores, phrase_match, bm25_batch, recall_mrr,
        greedy_dedup_top, html_clean, html_gate, redact_lines, secret_gate, title_extract, kind_case, heading_split, short_chunk_filter, turn_ranges,
        json_leaves, layered_resolve, config_four_layers, alias_usage_join, usage_budget, orphan_usages, owner_resolve, topk_consumers, alias_terms_match,
        accessor_normalize, fallback_join, gate_summary, catalog_lines, catalog_merge, manifest_check, probe_terms, filtered_search, dependency_rate,
        script_usages, catalog_entries, snapshot_diff, status_counts, source_lookup, snippets,
    )
}
