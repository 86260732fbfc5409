"""Golden values of the text functions and lexers."""

import random
import re
import sqlite3

from pyspark.sql import functions as F

from marlstone.functions import lexer as L
from marlstone.functions import text as X
from marlstone.operators import search


def test_line_ranges():
    text = "\n\npackage a\n\nclass B {\n  val c = 1\n}\n"
    assert [(a, b) for _, a, b in L.chunk_text(text, "kotlin")] == [(3, 7)]


def test_large_code_is_cut_at_a_symbol():
    text = "class First {\n" + "  val a = 1\n" * 10 + "}\n\nclass Second {\n" + "  val b = 2\n" * 10 + "}\n"
    assert any(c.startswith("class Second") for c, _, _ in L.chunk_text(text, "kotlin", 180))


def test_markdown_drops_short_sections():
    text = "# A\n" + "word " * 30 + "\n## B\nshort\n### C\n" + "more " * 30
    assert [c.split("\n")[0] for c, _, _ in L.chunk_text(text, "markdown")] == ["# A", "### C"]


def test_redaction():
    assert L.redact("spring.datasource.password=real-secret\nname=x", "properties") == "spring.datasource.password= <redacted>\nname=x"
    assert L.redact("a:\n  secret: |\n    one\n    two\n  b: 1\n", "yaml") == "a:\n  secret: <redacted>\n\n\n  b: 1\n"
    assert L.redact("password=x", "kotlin") == "password=x"


def test_query_phrases():
    assert X.match_expression("harbour-adapter SaveMode.INSERT") == '"harbour-adapter" "SaveMode" "INSERT"'
    assert X.phrases("a-b w1 - ___ É") == [["a", "b"], ["w1"], ["e"]]


def test_usages_ignore_comments_and_strings():
    script = 'dependencies {\n  implementation(libs.a.b)\n  // api(libs.c)\n  /* /* libs.d */ libs.e */\n  api(platform(libs.f))\n  val s = "libs.g"\n  runtimeOnly libs.h\n  add("ksp2", libs.i)\n  testImplementation(\n    libs.j.get()\n  )\n  implementation(libs.bundles.k)\n}\n'
    assert L.alias_usages(script) == [("a.b", "implementation", 2), ("f", "api", 5), ("h", "runtimeOnly", 7), ("i", "ksp2", 8), ("j.get", "testImplementation", 10)]


def test_usages_in_odd_scripts():
    found = lambda s: L.alias_usages(s)
    assert found("api(libs.a libs.b(libs.c))") == [("a", "api", 1), ("b", "api", 1), ("c", "api", 1)]
    assert found("x { runtimeOnly libs.a }; foo(bar(libs.b))") == [("a", "runtimeOnly", 1), ("b", "bar", 1)]
    assert found("add('ksp', libs.a)\n)libs.versions.x libs.bundles (libs.c") == [("a", "ksp", 1), ("bundles", "unknown", 2), ("c", "unknown", 2)]


def test_html_character_references(spark):
    df = spark.createDataFrame([("<p>&#8212;&eacute;&#x41; &amp;lt; &amp",), (None,)], "h string")
    assert [r[0] for r in df.select(X.clean_html("h")).collect()] == [" —éA &lt; &", None]


def test_html_references_without_semicolon(spark):
    """Only ``&amp`` is one without its semicolon, as in the query's SQL."""
    texts = ["token = &quot", "a&copy b&#39 c&notit; d&amp e&ampere &amp;quot; &quot;&#39;", "?x=1&lt=2&unknown;"]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    assert [r[0] for r in df.select(X.clean_html("h")).collect()] == ["token = &quot", "a&copy b&#39 c&notit; d& e&ere &quot; \"'", "?x=1&lt=2&unknown;"]


def test_version_catalog():
    toml = '[versions]\none = "1"\ntwo = { strictly = "2" }\n[libraries]\na-b = { module = "g:a", version.ref = "one" }\nc = { group = "g", name = "c", version = { ref = "two" } }\nd = "g:d:3"\ne.f = { module = "g:f", version = "4" }\n'
    assert [(r["alias"], r["accessor"], r["artifact_id"], r["version_ref"], r["version_value"]) for r in L.version_catalog(toml)] == [("a-b", "a.b", "a", "one", "1"), ("c", "c", "c", "two", "2"), ("d", "d", "d", "", "3"), ("e.f", "e.f", "f", "", "4")]


def test_yaml_leaves():
    text = "a: {b: 1, c: [x, y], d: {}, e: null}\n---\nspring: {config: {activate: {on-profile: 'p, q'}}}\nk: 2020-01-02\n"
    rows = L.yaml_leaves(text, "application-dev.yml")
    assert [(d, p, k) for d, p, k, _ in rows[:3]] == [(0, "dev", "a.b"), (0, "dev", "a.c"), (0, "dev", "a.e")]
    assert {p for d, p, _, _ in rows if d} == {"p", "q"} and rows[1][3] == '["x", "y"]' and rows[2][3] == "null" and rows[-1][3] == '"2020-01-02"'
    assert L.yaml_leaves("a: [", "x.yml") == []


def test_html_and_markdown(spark):
    df = spark.createDataFrame([("a<nav>x\ny</nav><p>b &amp; c</p><b>d</b>", "---\nt: 1\n---\n# H\nimport x\n<div>q</div>")], "h string, m string")
    h, m = df.select(X.clean_html("h"), X.clean_markdown("m")).first()
    assert h == "a\n b & c <b>d</b>" and m == "\n\n\n# H\n\nq"


def test_bm25_equals_fts5(spark, tmp_path):
    words = "alpha beta gamma delta café naïve x-ray kebab case thing".split()
    docs = [(i, " ".join(words[(i * k + k) % len(words)] for k in range(1, 3 + i % 9))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content, tokenize='unicode61')")
    con.executemany("insert into t(rowid, content) values (?, ?)", [(i + 1, c) for i, c in docs])
    search.write_index(spark.createDataFrame(docs, "source_id long, content string"), str(tmp_path / "index"), fields=("content",))
    index = search.read_index(spark, str(tmp_path / "index"))
    for query in ("alpha", "cafe beta", "x-ray", "alpha - gamma", "alpha alpha"):
        want = {r[0] - 1: r[1] for r in con.execute("select rowid, bm25(t) from t where t match ?", (X.match_expression(query),))}
        got = {r[0]: r[1] for r in search.bm25(index, search.query_terms(spark, {0: query})).select("source_id", "rank").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), query


def test_greedy_keeps_what_windows_would_lose(spark):
    df = spark.createDataFrame([([("h1", "s1"), ("h1", "s2"), ("h2", "s2")],)], "r array<struct<h:string,s:string>>")
    kept = df.select(search.greedy(F.col("r"), "h", "s", 5)).first()[0]
    assert [tuple(k) for k in kept] == [("h1", "s1"), ("h2", "s2")]


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    """A batch with more terms than are given to the scan as values finds the same."""
    docs = [(i, f"common word{i % 7} other{i}", "t é") for i in range(50)]
    search.write_index(spark.createDataFrame(docs, "source_id long, content string, title string"), str(tmp_path / "index"))
    index = search.read_index(spark, str(tmp_path / "index"))
    queries = {k: f"common word{k}" for k in range(7)} | {7: "other3-t", 8: "t", 9: "t-e word1", 10: "..."}
    found = [sorted(map(tuple, search.matches(index, search.query_terms(spark, queries)).collect()))]
    monkeypatch.setattr(search, "LITERALS", 3)
    found.append(sorted(map(tuple, search.matches(index, search.query_terms(spark, queries)).collect())))
    want = [(k, i) for i in range(50) for k in range(7) if i % 7 == k] + [(8, i) for i in range(50)] + [(9, i) for i in range(50) if i % 7 == 1]
    assert found == [sorted(want)] * 2
    held = search.holding(index, spark.createDataFrame([(0, "word2 other9"), (1, "!"), (2, "nowhere")], "query_id long, query string"))
    assert sorted(map(tuple, held.collect())) == [(0, 9), *((1, i) for i in range(50))]
    empty = search.matches(index, search.query_terms(spark, {}))
    assert empty.count() == 0


def test_index_tasks_follow_the_texts(spark, tmp_path, monkeypatch):
    """Longer texts make more slices of a bucket, not larger ones, and the same results."""
    docs = [(i, f"on the on the way {i % 5} the on" + " on" * (i % 3)) for i in range(200)]
    queries = {0: "on-the-on", 1: "the-the", 2: "on-on the", 3: "way-3"}
    found, files = [], []
    for name in ("whole", "cut"):
        if name == "cut":
            monkeypatch.setattr(search, "SLICE_CHARS", 40)
            monkeypatch.setattr(search, "TASK_CHARS", 500)
        folder = tmp_path / name
        search.write_index(spark.createDataFrame(docs, "source_id long, content string"), str(folder), fields=("content",))
        files.append(len(list(folder.glob("postings/*/*.parquet"))))
        index = search.read_index(spark, str(folder))
        rows = search.conjunctions(index, search.query_terms(spark, queries)).select("query_id", "source_id", "tf", "df")
        found.append(sorted(map(tuple, rows.collect())))
    words = {i: t.split() for i, t in docs}
    runs = lambda i, p: sum(words[i][k : k + len(p)] == p for k in range(len(words[i])))
    want = {(0, i, runs(i, ["on", "the", "on"])) for i in words} | {(2, i, runs(i, ["on", "on"])) for i in words if i % 3} | {(2, i, 3) for i in words if i % 3} | {(3, i, 1) for i in words if i % 5 == 3}
    assert found[0] == found[1] and {r[:3] for r in found[0]} == want and files[1] > files[0]


def test_small_terms_are_broadcast(spark, tmp_path):
    """No shuffle brings the postings of a term together."""
    search.write_index(spark.createDataFrame([(i, "common word") for i in range(50)], "source_id long, content string"), str(tmp_path / "index"), fields=("content",))
    plan = search.lookup(search.read_index(spark, str(tmp_path / "index")), search.query_terms(spark, {0: "common"}))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_snippets_equal_fts5():
    rng = random.Random(3)
    words = "alpha beta gamma delta café x-ray thing. other: end".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content, tokenize='unicode61')")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice(["", ".", "\n"]) for _ in range(300)]
    con.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts)))
    for query in ("alpha", "alpha beta", "x-ray alpha", "gamma alpha gamma", "thing-other"):
        for row, want in con.execute("select rowid, snippet(t, 0, '**', '**', '…', 8) from t where t match ?", (X.match_expression(query),)):
            assert search.best_window(texts[row], X.phrases(query), 8) == want, (query, texts[row])


def test_snippet(spark):
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(50)),), ("",)], "t string")
    a, b = [r[0] for r in df.select(search.snippet("t", [["w30"]], 10)).collect()]
    assert "**w30**" in a and a.startswith("…") and a.endswith("…") and len(re.findall(r"w\d+", a)) == 10 and b == ""
