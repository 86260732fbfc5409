"""End to end: source trees to relations, gates, searches and packs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone import schema
from marlstone.engine import Engine
from marlstone.functions.text import sync_progress
from marlstone.operators import cards, evaluation, quality
from marlstone.plans.build import Options, build
from marlstone.sources import files as S
from marlstone.sources import sinks

PAD = "This sentence makes the section long enough to be kept as a chunk of its own. " * 2


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("work")
    tree = {
        "platform/gradle/libs.versions.toml": '[versions]\nv = "1.0"\n[libraries]\nfixture-lib = { module = "g:fixture", version.ref = "v" }\nother = "g:absent:2"\n',
        "app/settings.gradle.kts": 'include(":core")\n',
        "app/build.gradle.kts": "dependencies {\n  implementation(libs.fixture.lib)\n  api(libs.other.get())\n  api(libs.nothing)\n}\n",
        "app/core/build.gradle.kts": "dependencies { }\n",
        "app/core/src/Main.kt": "package a\n\nclass SearchableThing {\n  fun run() = 1\n}\n" + "// filler\n" * 5,
        "app/docs/guide.md": f"# Guide\n{PAD}\n## Searchable part\n{PAD} searchable thing\n",
        "app/docs/copy.md": f"# Guide\n{PAD}\n## Searchable part\n{PAD} searchable thing\n",
        "app/docs/usage/use.md": f"# Use\n{PAD} searchable thing in usage\n",
        "app/application.yml": "server:\n  port: 1\n  password: hunter2\nonly: module\n# a comment that makes this long enough\n",
        "app/application-prod.yml": "server:\n  port: 3\n# a comment that makes this file long enough\n",
        "app/project-context.yaml": "schema_version: 1\nkind: application\nname: Приложение\naliases: [searcher]\npurpose: Поиск вещей\nuse_when: [Когда нужно искать]\nevidence:\n  - {path: core/src/Main.kt, proves: Класс поиска}\n  - {path: schema.sql, proves: Таблицы}\n",
        "app/schema.sql": "create table t (a int)\n",
        "app/things-lib/core-adapter/build.gradle": "dependencies { }\n",
        "fixture/project-context.yaml": "schema_version: 2\nkind: library\n",
        "fixture/gradle/libs.versions.toml": "[libraries]\nbroken = {",
        "app/build/generated/Skip.kt": "class Skip\n",
        "fixture/build.gradle": "dependencies { }\n",
        "config/app/application.yml": "server:\n  port: 2\n  host: central\n# a comment that makes this long enough\n",
    }
    for path, text in tree.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    for name in ("platform", "app", "fixture", "config"):
        (base / name / ".git").mkdir()
    return {os.path.basename(r): r for r in S.discover(str(base))}


@pytest.fixture(scope="module")
def built(spark, roots):
    return build(spark, roots, Options(pack="p", catalog_repositories=("platform", "fixture"), central=["config"]), dict.fromkeys(roots, "a" * 40))


def test_strict_build_names_what_is_wrong(spark, roots):
    with pytest.raises(ValueError, match="fixture:gradle/libs.versions.toml, fixture:project-context.yaml"):
        build(spark, roots, Options(catalog_repositories=("platform", "fixture"), strict=True))


def test_discovery(roots, tmp_path):
    assert sorted(roots) == ["app", "config", "fixture", "platform"]
    assert S.excluded_names("a # x\n\n#b\n c \n") == {"a", "c"}


def test_relations(spark, built, tmp_path):
    relations, audit, catalog = built
    row = audit.first()
    assert (row.files_seen, row.files_unreadable, row.contexts_indexed, row.contexts_invalid, row.usage_documents) == (16, 0, 1, 1, 1)
    assert [e.source for e in row.context_errors] == ["fixture:project-context.yaml"] and "schema_version is not 1" in row.context_errors[0].errors
    assert row.catalog_errors == ["fixture:gradle/libs.versions.toml"] and (row.catalogs_seen, row.catalog_entries_seen) == (2, 2)
    assert row.duplicate_groups == 2 and [(r.repository, r.commit) for r in row.source_revisions] == [(r, "a" * 40) for r in ("app", "config", "fixture", "platform")]
    items = {r.id: r.status for r in catalog.collect()}
    assert items == {"Приложение": "curated", "app-things-lib-core-adapter": "discovered"}
    assert relations["chunks"].where("kind = 'context'").first().title == "Приложение"
    assert (row.sources, row.aliases, row.aliases_with_owner, row.usages, row.unresolved_usages) == (4, 2, 1, 2, 1)
    rows = [(r.accessor, r.configuration, r.consumer_module, r.line) for r in relations["dependency_usages"].orderBy("line").collect()]
    assert rows == [("fixture.lib", "implementation", ":", 2), ("other", "api", ":", 3)]
    paths = {r.path for r in relations["chunks"].collect()}
    assert "core/src/Main.kt" in paths and not any("generated" in p for p in paths)
    assert relations["chunks"].where("path = 'core/src/Main.kt'").first().module == ":core"
    sinks.publish(spark, relations, str(tmp_path / "pack"))
    assert sinks.load(spark, str(tmp_path / "pack"))["chunks"].count() == relations["chunks"].count()
    with pytest.raises(ValueError):
        sinks.publish(spark, relations | {"chunks": relations["chunks"].drop("title")}, str(tmp_path / "pack"))
    assert schema.problems("chunks", relations["chunks"]) == []


def test_gate_and_packs(spark, built, tmp_path):
    relations, audit, catalog = built
    folder = str(tmp_path / "pack")
    sinks.publish(spark, relations, folder, audit, catalog)
    e = Engine.load(spark, folder)
    assert e.audit().count() == 1 and "## Приложение [application, curated]" in {r.block.split("\n")[0] for r in e.catalog().collect()}
    cases = {
        "cases": [{"id": "a", "query": "searchable usage", "expected_sources": ["app:docs/usage/use.md"]}, {"id": "b", "query": "nosuchword", "expect_no_results": True}, {"id": "c", "query": "searchable", "top_k": 1, "filters": {"kind": "source"}, "expected_paths": ["core/src/Main.kt"]}],
        "dependency_cases": [{"id": "d", "query": "fixture", "expected_aliases": ["fixture-lib", "never"], "expected_consumers": [{"repository": "app", "line": 2}]}, {"id": "e", "query": "nothing", "expect_no_results": True}],
    }
    text = json.dumps(cases)
    report = e.verify(text, ["searchable", "thing"])
    assert report["audit_failures"] == ["invalid context cards"] and not report["passed"] and not report["retrieval"]["passed"] and report["dependencies"]["passed"]
    assert [r["retrieved_sources"] for r in report["retrieval"]["results"]][1:] == [[], []] and report["retrieval"]["recall_at_k"] == 0.5
    with pytest.raises(ValueError, match="not passed"):
        sinks.pack(folder, str(tmp_path / "p.zip"), report, {}, text, report["fingerprint"])


def test_pack_of_a_passed_report(spark, built, tmp_path):
    relations, audit, catalog = built
    folder = str(tmp_path / "pack")
    clean = audit.withColumn("contexts_invalid", F.lit(0))
    sinks.publish(spark, relations, folder, clean, catalog)
    e = Engine.load(spark, folder)
    text = json.dumps({"cases": [{"id": "a", "query": "searchable usage", "filters": {"repository": "app"}, "expected_paths": ["docs/usage/use.md"]}, {"id": "b", "query": "nosuchword", "expect_no_results": True}]})
    report = e.verify(text, ["searchable thing"])
    assert report["passed"] and report["expected"] == {"searchable thing": 3} and report["audit_failures"] == []
    row = clean.first().asDict(recursive=True)
    args = (report, row, text, report["fingerprint"])
    sinks.pack(folder, str(tmp_path / "p.zip"), *args)
    for k, wrong in enumerate((report | {"fingerprint": "x"}, report | {"retrieval": {}}, report | {"dependencies": None}, report | {"schema_version": 0}, report | {"audit_sha256": ""})):
        assert len(sinks.stale(wrong, *args[1:])) == 1, k
    assert len(sinks.stale(report, row, "{}", args[3])) == 1 and len(sinks.stale(report, row | {"fingerprint": ""}, text, args[3])) == 2
    assert not e.verify(text, ["searchable", "nosuchword"])["passed"] and not e.verify("{}")["passed"] and not e.verify("no json")["passed"]
    sinks.install(str(tmp_path / "p.zip"), str(tmp_path / "installed"))
    assert Engine.load(spark, str(tmp_path / "installed")).search("searchable thing").first().kind == "usage"
    data = bytearray((tmp_path / "p.zip").read_bytes())
    data[len(data) // 2] ^= 1
    (tmp_path / "bad.zip").write_bytes(data)
    with pytest.raises(Exception):
        sinks.install(str(tmp_path / "bad.zip"), str(tmp_path / "installed"))
    assert os.path.isdir(tmp_path / "installed" / "chunks")


def test_definitions(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"cases": []}')
    assert evaluation.load_definition(spark, str(tmp_path / "d.json")) == {"cases": []}
    (tmp_path / "bad.json").write_text("[1")
    with pytest.raises(ValueError):
        evaluation.load_definition(spark, str(tmp_path / "bad.json"))
    for cases in ([], [{"id": "", "query": "x", "expect_no_results": True}], [{"id": "a", "query": "x", "expected_paths": ["p"]}] * 2, [{"id": "a", "expected_paths": ["p"]}], [{"id": "a", "query": "x"}]):
        with pytest.raises(ValueError):
            evaluation.retrieval_cases({"cases": cases})
    assert evaluation.retrieval_cases({"top_k": 50, "cases": [{"id": "a", "query": "x", "expected_paths": ["p"]}]})[0]["top_k"] == 20


def test_columns_of_sources(spark):
    df = spark.createDataFrame([("r", ":a:b-adapter", "a/b-adapter", "sync_skipped_dirty", "a" * 40), ("r", ":", "", "ok", "abc"), ("r", ":x", "core-lib/x", "ok", None)], "repository string, module string, folder string, status string, sha string")
    rows = df.select(S.is_library(F.col("module"), F.col("folder")), sync_progress("status"), S.valid_revision("sha")).collect()
    assert [tuple(r) for r in rows] == [(True, "sync_skipped_dirty (sync skipped; the dirty working tree is indexed)", True), (False, "ok", False), (True, "ok", False)]


def test_manifest(spark):
    manifest = {"sources": [{"id": "r", "modules": [{"id": ":m"}]}], "catalog": [{"id": "x", "type": "library", "source_modules": ["r::m"], "capabilities": ["api"]}]}
    assert sinks.catalog_markdown(cards.manifest_catalog(spark, manifest)).first().block == "## x [library, ready]\n- sources: r::m\n- capabilities: api\n"
    manifest["catalog"][0]["source_modules"] = ["r::n"]
    with pytest.raises(ValueError, match="unknown source r::n"):
        cards.manifest_catalog(spark, manifest)


def test_head_commit(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert S.head_commit(str(tmp_path)) == ""
    (git / "packed-refs").write_text("# pack\n" + "b" * 40 + " refs/heads/main\n")
    assert S.head_commit(str(tmp_path)) == "b" * 40
    (git / "refs/heads/main").write_text("c" * 40 + "\n")
    assert S.head_commit(str(tmp_path)) == "c" * 40
    (git / "HEAD").write_text("d" * 40 + "\n")
    assert S.head_commit(str(tmp_path)) == "d" * 40


def test_engine(spark, built):
    relations, audit, _ = built
    e = Engine(relations, audit)
    found = e.search("searchable thing").collect()
    assert found[0].kind == "usage" and "**searchable**" in found[0].snippet
    assert len({r.content_hash for r in found}) == len(found) and len({(r.repository, r.path) for r in found}) == len(found)
    assert e.search("SearchableThing", kind="source").first().path == "core/src/Main.kt"
    assert e.search("___").count() == 0
    values = {r.key_path: (r.value_json, r.layer) for r in e.resolve_config("app", "app", "prod").collect()}
    assert values["server.port"] == ("3", "module") and values["server.host"] == ('"central"', "central") and values["only"][0] == '"module"'
    assert values["server.password"][0] == '"<redacted>"'
    assert {r.key_path: r.value_json for r in e.resolve_config("app", "app").collect()}["server.port"] == "1"
    s = e.suggest_dependency("fixture").first()
    assert s.declaration == "implementation(libs.fixture.lib)" and s.owner_repository == "fixture" and len(s.consumers) == 1
    assert e.find_usages("libs g").count() == 2 and e.find_usages("library").count() == 0
    assert e.get_source("app:docs/guide.md").count() == 2 and e.get_source("app:docs/guide.md#1").count() == 1
    assert e.repositories().where("repository = 'app'").first().modules == 2
    assert e.gate().first().passed
    metrics, results = e.evaluate({"cases": [{"id": "1", "query": "searchable usage", "expected_paths": ["docs/usage/use.md"]}, {"id": "2", "query": "nosuchword", "expect_no_results": True}]})
    m = metrics.first()
    assert m.passed and m.mrr == 1.0 and m.negative_pass_rate == 1.0 and results.where("passed").count() == 2


def test_dependency_cases(spark):
    a = spark.createDataFrame([("c", "p", "a-one", "a.one", "g", "one", "", ""), ("c", "p", "b", "b", "g", "two", "", "")], "catalog_repository string, catalog_path string, alias string, accessor string, group_id string, artifact_id string, owner_repository string, owner_module string")
    used = [("c", "p", "a-one", "a.one", "r", ":", "b", "api", "a" * 40, 3), ("c", "p", "b", "b", "r", ":", "b", "api", "no commit", 4)]
    u = spark.createDataFrame(used, "catalog_repository string, catalog_path string, alias string, accessor string, consumer_repository string, consumer_module string, path string, configuration string, commit_sha string, line int")
    cases = [
        {"id": "any", "query": "one", "expected_aliases": ["x", "a-one"], "expected_consumers": [{"line": 9}, {"line": 3, "repository": "r"}]},
        {"id": "line", "query": "one", "expected_consumers": [{"line": 9}]},
        {"id": "provenance", "query": "two", "expected_aliases": ["b"]},
        {"id": "elsewhere", "query": "two", "repository": "other", "expected_aliases": ["b"]},
        {"id": "none", "query": "three", "expect_no_results": True},
        {"id": "words", "query": "library libs", "expect_no_results": True},
    ]
    metrics, results = evaluation.dependency(a, u, {"dependency_cases": cases, "thresholds": {"min_dependency_pass_rate": 0.6}})
    assert {r.id: r.passed for r in results.collect()} == {"any": True, "line": False, "provenance": False, "elsewhere": True, "none": True, "words": True}
    row = metrics.first()
    assert (row.cases, row.positive_cases, row.pass_rate, row.passed) == (6, 4, 0.666667, True)
    assert not evaluation.dependency(a, u, {"dependency_cases": cases, "dependency_case_draft": {"review_required": True}})[0].first().passed
    with pytest.raises(ValueError):
        evaluation.dependency(a, u, {"dependency_cases": [{"id": "x", "query": "q", "expected_consumers": [{"unknown": 1}]}]})


def test_cards():
    good = dict(name="x", kind="library", purpose="Цель", schema_version=1, use_when=["Когда"], evidence=[{"path": "src/A.kt", "proves": "Код"}])
    files = {"src/A.kt": ""}
    assert cards.card_errors(good, files) == []
    bad = good | {"evidence": [{"path": "/abs", "proves": "Код"}, {"path": "../up", "proves": "Код"}, {"path": "no", "proves": "Код"}], "extra": 1}
    assert len(cards.card_errors(bad, files)) == 4
    assert cards.catalog_item(good | {"examples": [], "entrypoints": ["e"]}, "r", ":m")["capabilities"] == ["context", "api"]
    assert cards.dependency_errors({"ecosystem": "gradle", "alias": "libs.x", "declaration": "api(libs.x)"}) == []
    assert cards.dependency_errors({"ecosystem": "npm", "declaration": "x"}) == ["dependency.package: empty"]


def test_catalog_merge(spark):
    rows = [("a", "library", "curated", [], ["r:m"], ["context"]), ("b", "library", "guessed", [], ["r:m"], []), ("c", "library", "guessed", ["x"], ["r:n"], ["api"])]
    items = spark.createDataFrame(rows, "id string, type string, status string, aliases array<string>, sources array<string>, capabilities array<string>")
    merged = cards.merge_catalog(items)
    assert sorted(r.id for r in merged.collect()) == ["a", "c"]
    assert "- aliases: x" in sinks.catalog_markdown(merged).where("id = 'c'").first().block


def test_streaming(spark, sf, tmp_path):
    from marlstone.streaming.incremental import index_stream

    src = tmp_path / "in"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(src))
    for _ in range(2):
        index_stream(spark, str(src), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    from marlstone.operators.search import postings

    assert spark.read.parquet(str(tmp_path / "out")).count() == postings(docs, "doc_id", ("text",)).count()


def test_draft_cases_and_audit(spark, built):
    from marlstone.operators import dependencies

    relations, audit, _ = built
    cases = dependencies.draft_cases(relations["dependency_aliases"], relations["dependency_usages"]).collect()
    assert [(c.case_id, c.usages, c.consumer.line) for c in cases] == [("fixture-lib", 1, 2)]
    twice = relations["dependency_aliases"].withColumn("alias", F.lit("A-b")).unionByName(relations["dependency_aliases"].withColumn("alias", F.lit("a_b"))).withColumn("owner_repository", F.lit("o"))
    used = relations["dependency_usages"].withColumn("alias", F.lit("A-b")).unionByName(relations["dependency_usages"].withColumn("alias", F.lit("a_b")))
    assert [c.case_id for c in dependencies.draft_cases(twice, used).collect()] == ["a-b", "a-b-2"]
    revisions = spark.createDataFrame([(r, "a" * 40) for r in "abcd"], "source string, commit string")
    good = audit.withColumns({"schema_version": F.lit(1), "fingerprint": F.lit("f"), "contexts_invalid": F.lit(0)})
    assert quality.audit_failures(good, revisions, 1, "f").first()[0] == []
    bad = good.withColumns({"schema_version": F.lit(2), "files_unreadable": F.lit(3)})
    assert quality.audit_failures(bad, revisions.limit(3), 1, "f").first()[0] == ["another schema version", "revisions do not cover the sources", "unreadable files"]
    assert [r[0] for r in quality.first_offenders(relations["chunks"], F.col("kind") == "usage", "path").collect()] == ["docs/usage/use.md"]


def test_links_are_spread_by_the_number_of_usages(spark, monkeypatch):
    """Tasks follow the usages' number, and what is linked stays the same."""
    from marlstone import session
    from marlstone.operators import dependencies

    aliases = spark.createDataFrame([("c", "p", f"a{i}", f"a{i}") for i in range(20)], "catalog_repository string, catalog_path string, alias string, accessor string")
    usages = spark.createDataFrame([(f"a{i % 25}" + (".get" if i % 2 else ""), f"r{i % 3}", ":", f"p{i % 60}", "api", i % 60) for i in range(120)], "accessor string, consumer_repository string, consumer_module string, path string, configuration string, line int")
    whole = sorted(map(tuple, dependencies.link_usages(usages, aliases).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.spread(usages, "accessor").rdd.getNumPartitions() == 12
    assert sorted(map(tuple, dependencies.link_usages(usages, aliases).collect())) == whole and len(whole) == len(set(whole)) > 40
