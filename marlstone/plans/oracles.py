"""DuckDB SQL for the results of ``queries``, written independently of the Spark plans and sharing nothing with them."""

from __future__ import annotations

ACCENTS, PLAIN = "éèêëáàâäãåíìîïóòôöõúùûüñçýÿ", "eeeeaaaaaaiiiiooooouuuuncyy"
TAGS = "a|article|aside|br|code|details|div|em|footer|h1|h2|h3|h4|h5|h6|header|img|li|main|nav|ol|p|pre|script|section|span|strong|style|table|tbody|td|th|thead|tr|ul"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&middot;": "·", "&eacute;": "é"}
_TOK = f"regexp_extract_all(translate(lower({{}}), '{ACCENTS}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
_SECRET = r"(?:[\w.-]+[._-])?(?:api[-_]?key|credential|password|private[-_]?key|secret|token)"


def tok(column: str) -> str:
    return _TOK.format(column).replace("{{", "{").replace("}}", "}")


CHUNKS = """chunks AS (
  SELECT doc_id AS source_id, source AS repository, ':' || lang AS module, 'docs/' || doc_id || '.md' AS path,
    ['context', 'usage', 'docs', 'example', 'source', 'configuration'][doc_id % 6 + 1] AS kind, lang AS language,
    substr(sha256(source || lang), 1, 40) AS commit_sha, 1 AS line_start, len(string_split(text, chr(10))) AS line_end,
    text AS content, sha256(text) AS content_hash
  FROM documents)"""
PRIORITY = "CASE kind WHEN 'context' THEN 0 WHEN 'usage' THEN 1 WHEN 'docs' THEN 2 WHEN 'example' THEN 3 WHEN 'source' THEN 4 ELSE 5 END"
ALIASES = """aliases AS (
  SELECT p_partkey AS key, p_brand AS catalog_repository, p_type AS catalog_path, p_brand AS group_id, lower(p_name) AS artifact_id,
    regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || p_partkey AS alias,
    array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || p_partkey, '[-_.]+'), lambda x: x <> ''), '.') AS accessor
  FROM part)"""


def searched(terms: str) -> str:
    """CTEs from terms(query_id, phrase, size, off, term) to scores(query_id, source_id, rank)."""
    return f"""{CHUNKS},
  arr AS (SELECT source_id, {tok('content')} AS t FROM chunks),
  stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM arr),
  {terms},
  tokens AS (SELECT source_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM arr),
  starts AS (SELECT query_id, phrase, source_id, dl, pos - off AS s FROM tokens JOIN terms USING (term)
    GROUP BY query_id, phrase, size, source_id, dl, pos - off HAVING count(*) = size),
  tf AS (SELECT query_id, phrase, source_id, dl, count(*) AS tf FROM starts GROUP BY ALL),
  df AS (SELECT query_id, phrase, count(*) AS df FROM tf GROUP BY ALL),
  wanted AS (SELECT query_id, count(DISTINCT phrase) AS w FROM terms GROUP BY ALL),
  scores AS (SELECT query_id, source_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
    FROM tf JOIN df USING (query_id, phrase) JOIN wanted USING (query_id), stats GROUP BY query_id, source_id, w HAVING count(*) = w)"""


QUERY_TERMS = "terms(query_id, phrase, size, off, term) AS (VALUES (0, 0, 1, 0, 'licensed'), (0, 1, 2, 0, 'under'), (0, 1, 2, 1, 'the'), (0, 2, 1, 0, 'apache'))"
BATCH_TERMS = f"""firsts AS (SELECT item_id, array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:4], ' ') AS q FROM benchmark),
  parts AS (SELECT item_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT item_id, list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_-]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS p FROM firsts)),
  listed AS (SELECT item_id, k, {tok('part')} AS t FROM parts),
  terms AS (SELECT item_id AS query_id, k AS phrase, len(t) AS size, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS off FROM listed)"""
RANKED = f"""joined AS (SELECT s.query_id, s.rank, {PRIORITY} AS kp, c.* FROM scores s JOIN chunks c USING (source_id)),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kp, round(rank, 9), source_id) AS n FROM joined QUALIFY n <= 100),
  once AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY n) AS h FROM top QUALIFY h = 1),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS position FROM once QUALIFY position <= 5)"""

_clean = "html"
for _b in ("script", "style", "nav", "header", "footer"):
    _clean = f"regexp_replace({_clean}, '<{_b}.*?</{_b}>', '', 'gis')"
_clean = f"regexp_replace({_clean}, '</?(?:{TAGS})\\b[^>]*>', ' ', 'gi')"
for _e, _c in ENTITIES.items():
    _clean = f"replace({_clean}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_clean = f"regexp_replace({_clean}, '&amp;?', '&', 'g')"
CLEAN = f"trim(regexp_replace({_clean}, '\\s+', ' ', 'g'))"
RAW = f"regexp_matches({{}}, '</?(?:{TAGS})\\b[^>]*>', 'i')"
LINES = r"regexp_replace(text, '[.,]? ([A-Za-z_]+ = )', chr(10) || '\1', 'g')"
REDACTED = rf"regexp_replace({LINES}, '(?im)^(\s*{_SECRET}\s*[:=]).*$', '\1 <redacted>', 'g')"
LEAKS = rf"len(list_filter(regexp_extract_all({{}}, '(?im)^(\s*{_SECRET}\s*[:=].*)$', 1), lambda m: NOT contains(m, '<redacted>')))"
LINKED = f"""{ALIASES}, linked AS (SELECT a.*, printf('Supplier#%05d', l_suppkey) AS consumer_repository, lpad(l_orderkey::VARCHAR, 10, '0') AS path, l_linenumber AS line FROM lineitem JOIN aliases a ON key = l_partkey)"""
TURNS = "t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)"
LEAF = "(SELECT *, unnest(json_keys(props)) AS key_path FROM events)"

ORACLES = {
    "repo_inventory": f"WITH {CHUNKS} SELECT repository, count(*) AS chunks, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_chunks" for k in "configuration source example docs usage context".split()) + ", count(DISTINCT module) AS modules, max(commit_sha) AS commit_sha FROM chunks GROUP BY repository",
    "chunk_kind_counts": f"WITH {CHUNKS} SELECT kind, {PRIORITY}::INTEGER AS priority, count(*) AS n, count(DISTINCT repository) AS repositories FROM chunks GROUP BY kind",
    "dup_groups": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "dup_excess": "SELECT count(*) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS excess FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)",
    "token_stats": f"SELECT lang AS language, count(*) AS n_docs, sum(dl)::BIGINT AS tokens, max(dl)::INTEGER AS longest, round(avg(dl), 6) AS avgdl FROM (SELECT lang, len({tok('text')}) AS dl FROM documents) GROUP BY lang",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tok('text')})) AS term FROM documents) GROUP BY term HAVING count(*) >= 20",
    "bm25_top": f"WITH {searched(QUERY_TERMS)}, {RANKED} SELECT position::INTEGER AS position, source_id, repository, kind, round(rank, 6) AS score FROM best",
    "bm25_scores": f"WITH {searched(QUERY_TERMS)} SELECT source_id, round(rank, 6) AS score FROM scores",
    "phrase_match": rf"""WITH d AS (SELECT doc_id, ' ' || array_to_string({tok('text')}, ' ') || ' ' AS t FROM documents)
        SELECT 0::BIGINT AS query_id, doc_id AS source_id FROM d WHERE contains(t, ' general public license ')
        UNION ALL SELECT 1::BIGINT, doc_id FROM d WHERE contains(t, ' version 2 ')
        UNION ALL SELECT 2::BIGINT, doc_id FROM d WHERE contains(t, ' on the ') AND contains(t, ' on ')""",
    "bm25_batch": f"WITH {searched(BATCH_TERMS)}, {RANKED} SELECT query_id, position::INTEGER AS position, source_id, round(rank, 6) AS score FROM best",
    "recall_mrr": f"""WITH {searched(BATCH_TERMS)}, {RANKED},
        expected AS (SELECT item_id AS query_id, doc_id AS source_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        cases AS (SELECT e.query_id, min(b.position) AS r FROM expected e LEFT JOIN best b USING (query_id, source_id) GROUP BY 1),
        rates AS (SELECT count(*) AS positive_cases, round(coalesce(avg((r IS NOT NULL)::INT), 1.0), 6) AS recall, round(coalesce(avg(coalesce(1.0 / r, 0.0)), 1.0), 6) AS mrr FROM cases)
        SELECT positive_cases, recall, mrr, 1.0::DOUBLE AS negative_pass_rate, recall >= 1.0 AND mrr >= 0.8 AS passed FROM rates""",
    "greedy_dedup_top": """WITH RECURSIVE top AS (SELECT doc_id, sha256(text) AS h, source || '|' || lang AS s, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents ORDER BY n LIMIT 100),
        fold(n, hs, ss, ids) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
          UNION ALL SELECT t.n, CASE WHEN ok THEN list_append(hs, h) ELSE hs END, CASE WHEN ok THEN list_append(ss, s) ELSE ss END, CASE WHEN ok THEN list_append(ids, doc_id) ELSE ids END
          FROM (SELECT f.*, t.n AS tn, t.h, t.s, t.doc_id, len(f.ids) < 10 AND NOT list_contains(f.hs, t.h) AND NOT list_contains(f.ss, t.s) AS ok FROM fold f JOIN top t ON t.n = f.n + 1) x JOIN top t ON t.n = x.tn),
        last AS (SELECT * FROM fold ORDER BY n DESC LIMIT 1)
        SELECT generate_subscripts(ids, 1)::INTEGER AS position, unnest(ids) AS doc_id, unnest(ss) AS source_key FROM last""".replace("THEN list_append(hs, h)", "THEN list_append(hs, x.h)").replace("THEN list_append(ss, s)", "THEN list_append(ss, x.s)").replace("THEN list_append(ids, doc_id)", "THEN list_append(ids, x.doc_id)"),
    "html_clean": f"SELECT page_id, sha256({CLEAN}) AS text_hash, length({CLEAN})::INTEGER AS n_chars FROM pages",
    "html_gate": f"SELECT count(*) AS pages, count(*) FILTER ({RAW.format('html')}) AS raw, count(*) FILTER ({RAW.format(_clean)}) AS raw_after_cleaning FROM pages",
    "redact_lines": f"SELECT doc_id, sha256(r) AS text_hash, len(list_filter(string_split(r, chr(10)), lambda s: contains(s, '<redacted>')))::INTEGER AS redacted FROM (SELECT doc_id, {REDACTED} AS r FROM documents) WHERE contains(r, '<redacted>')",
    "secret_gate": f"SELECT count(*) FILTER ({LEAKS.format(LINES)} > 0) AS leaks, count(*) FILTER ({LEAKS.format(REDACTED)} > 0) AS leaks_after_redaction FROM documents",
    "title_extract": r"""SELECT doc_id, trim(CASE WHEN doc_id % 2 = 0 AND trim(string_split(text, chr(10))[1]) <> '' THEN string_split(text, chr(10))[1]
        WHEN regexp_extract(text, '(?m)^#\s+(.+)$', 1) <> '' THEN regexp_extract(text, '(?m)^#\s+(.+)$', 1)
        WHEN regexp_extract(text, '(?m)^\s*(?:(?:abstract|data|final|open|private|protected|public|sealed)\s+)*(?:enum|class|record|object|interface)\s+([_a-zA-Z]\w*)', 1) <> ''
        THEN regexp_extract(text, '(?m)^\s*(?:(?:abstract|data|final|open|private|protected|public|sealed)\s+)*(?:enum|class|record|object|interface)\s+([_a-zA-Z]\w*)', 1)
        ELSE 'doc-' || doc_id END) AS title FROM documents""",
    "kind_case": r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p, '(^|/)project-context\.yaml$') THEN 'context' WHEN l = 'markdown' AND regexp_matches(p, '(^|/)docs/usage/[^/]+$') THEN 'usage'
        WHEN contains(lower(p), 'example') OR contains(lower(p), 'test') THEN 'example' WHEN l = 'yaml' THEN 'configuration' WHEN l = 'html' THEN 'docs' ELSE 'source' END AS kind
        FROM (SELECT CASE WHEN page_id % 7 = 0 THEN 'latest/' ELSE '' END || regexp_replace(url, '^[a-z]+://[^/]+/|[?#].*$', '', 'g') AS p, ['yaml', 'html', 'kotlin'][page_id % 3 + 1] AS l FROM pages)) GROUP BY kind""",
    "heading_split": f"""WITH {TURNS}, s AS (SELECT conv_id, i, CASE WHEN role = 'user' THEN '# ' ELSE '' END || line AS line, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM t),
        c AS (SELECT conv_id, section, min(i) AS a, max(i) AS b, trim(string_agg(line, chr(10) ORDER BY i)) AS content FROM s GROUP BY ALL)
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY section) - 1)::INTEGER AS position, a::INTEGER AS line_start, b::INTEGER AS line_end, length(content)::INTEGER AS n_chars, sha256(content) AS content_hash FROM c WHERE length(content) >= 80""",
    "short_chunk_filter": f"WITH {TURNS} SELECT conv_id || '#' || i AS chunk_id, sha256(line) AS content_hash FROM t WHERE length(line) >= 40",
    "turn_ranges": f"WITH {TURNS} SELECT conv_id, (i - 1)::INTEGER AS turn, (3 * i - 1)::INTEGER AS line_start, (3 * i - 1)::INTEGER AS line_end, length(rtrim(rpad(substr(line, 1, 99), 99, 'x')))::INTEGER AS n_chars FROM t",
    "json_leaves": f"SELECT event_type, key_path, count(*) AS n, min(json_extract_string(props, '$.' || key_path)::BIGINT) AS least, max(json_extract_string(props, '$.' || key_path)::BIGINT) AS greatest FROM {LEAF} GROUP BY 1, 2",
    "layered_resolve": f"""SELECT user_id, key_path, json_extract_string(props, '$.' || key_path) AS value_json, event_type AS layer, event_id AS source_id FROM {LEAF}
        QUALIFY row_number() OVER (PARTITION BY user_id, key_path ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END DESC, date_trunc('second', ts) DESC, event_id DESC) = 1""",
    "config_four_layers": """WITH v AS (SELECT 'key.' || user_id % 97 AS key_path, event_id::VARCHAR AS value_json, event_id,
          CASE WHEN event_type IN ('view', 'click') THEN 'central' ELSE 'module' END AS layer, CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'prod' ELSE '' END AS profile,
          CASE WHEN event_type IN ('view', 'click') THEN user_id % 2 = 0 ELSE user_id % 3 = 1 END AS mine FROM events)
        SELECT key_path, value_json, layer, profile FROM v WHERE mine
        QUALIFY row_number() OVER (PARTITION BY key_path ORDER BY CASE WHEN profile = 'prod' THEN 2 ELSE 0 END + CASE layer WHEN 'module' THEN 1 ELSE 0 END DESC, event_id DESC) = 1""",
    "alias_usage_join": "SELECT p_brand AS catalog_repository, count(DISTINCT (p_partkey, l_suppkey, l_orderkey, l_linenumber)) AS usages, count(DISTINCT p_partkey) AS aliases, count(DISTINCT l_suppkey) AS consumers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "usage_budget": f"WITH {LINKED} SELECT alias, catalog_path, consumer_repository, path, line FROM linked WHERE contains(regexp_replace(lower(concat_ws(' ', alias, accessor, group_id, artifact_id)), '[^a-z0-9]+', '', 'g'), 'brand') AND contains(regexp_replace(lower(concat_ws(' ', alias, accessor, group_id, artifact_id)), '[^a-z0-9]+', '', 'g'), '1') ORDER BY alias, catalog_path, catalog_repository, consumer_repository, path, line LIMIT 20",
    "orphan_usages": "SELECT l_partkey, count(*) AS orphans FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 5 GROUP BY 1",
    "owner_resolve": """WITH c AS (SELECT s_nationkey AS k, s_name AS r, 'supplier' AS m, 3 AS p FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT c_nationkey, c_name, 'customer', 2 FROM customer),
        b AS (SELECT n_name AS own, r, m, p FROM c JOIN nation ON k = n_nationkey), w AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(own), '[^a-z0-9]+', '', 'g') ORDER BY p DESC, r, m) AS n FROM b)
        SELECT n_nationkey, coalesce(r, '') AS owner_repository, coalesce(m, '') AS owner_module FROM nation LEFT JOIN w ON w.n = 1 AND regexp_replace(lower(own), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g')""",
    "topk_consumers": f"WITH {LINKED} SELECT alias, position::INTEGER AS position, consumer_repository, path, line FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY consumer_repository, path, line) AS position FROM linked) WHERE position <= 3",
    "alias_terms_match": f"WITH {ALIASES}, n AS (SELECT alias, accessor, regexp_replace(lower(concat_ws(' ', alias, accessor, group_id, artifact_id)), '[^a-z0-9]+', '', 'g') AS t FROM aliases) SELECT alias, accessor FROM n WHERE contains(t, 'brand1') AND contains(t, '7')",
    "accessor_normalize": "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(concat_ws('__', p_type, p_brand, p_name), '[-_.]+'), lambda x: x <> ''), '.') AS accessor, regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]+', '', 'g') AS letters, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS ascii FROM part",
    "fallback_join": f"""WITH {ALIASES}, u AS (SELECT accessor || ['', '.get', '.orNull', '.getOrNull', '.map'][l_orderkey % 5 + 1] AS used, l_orderkey % 5 = 4 AS other, key, l_orderkey, l_linenumber FROM lineitem JOIN aliases ON l_partkey = key),
        l AS (SELECT DISTINCT key, l_orderkey, l_linenumber FROM u WHERE NOT other AND key % 3 <> 0)
        SELECT (SELECT count(*) FROM l) AS linked, (SELECT count(DISTINCT key) FROM l) AS aliases, (SELECT count(*) FROM u WHERE other OR key % 3 = 0) AS unresolved""",
    "gate_summary": f"""WITH {CHUNKS}, c AS (SELECT count(*) AS chunks, count(*) FILTER (contains(path, '/generated/') OR contains(path, '/__generated/')) AS generated_paths, count(*) FILTER (line_start < 1 OR line_end < line_start) AS invalid_line_ranges,
          count(*) FILTER (kind IN ('docs', 'usage') AND {RAW.format('content')}) AS raw_html_in_docs, count(*) FILTER (kind = 'configuration' AND {LEAKS.format('content')} > 0) AS secret_leaks FROM chunks),
        o AS (SELECT count(*) AS orphan_labels FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
        SELECT *, chunks > 0 AND generated_paths + invalid_line_ranges + raw_html_in_docs + secret_leaks + orphan_labels = 0 AS passed FROM c, o""",
    "catalog_lines": """SELECT r_name AS id, '## ' || r_name || ' [region, ready]' || chr(10) || '- aliases: ' || string_agg(DISTINCT lower(n_name[1:3]), ', ' ORDER BY lower(n_name[1:3])) || chr(10)
        || '- sources: ' || string_agg(n_name, ', ' ORDER BY n_name) || chr(10) || '- capabilities: docs, api' || chr(10) AS block FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "snapshot_diff": "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)",
    "status_counts": """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'successful' END AS s, o_orderkey % 4 AS a FROM orders)
        SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'successful') AS successful, count(*) FILTER (s = 'failed') AS failed,
        count(*) FILTER (s = 'failed' AND a < 2) AS retryable, count(*) FILTER (s = 'failed' AND a >= 2) AS terminal FROM r""",
    "source_lookup": "SELECT 'conv' || conv_id || '#' || turn AS source_id, role, length(text)::INTEGER AS n_chars FROM conversations WHERE conv_id IN (1, 12) OR conv_id = 3 AND turn = 1",
    "catalog_merge": """WITH c AS (SELECT s_name AS id, 'curated' AS status, s_nationkey AS source FROM supplier WHERE s_suppkey % 7 = 0)
        SELECT * FROM c UNION ALL SELECT n_name, 'discovered', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT source FROM c)""",
    "manifest_check": """SELECT p_partkey AS id, 'type is missing' AS error FROM part WHERE p_size % 4 = 3 UNION ALL SELECT p_partkey, 'unknown type gadget' FROM part WHERE p_size % 4 = 2
        UNION ALL SELECT p_partkey, 'capabilities is missing' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'unknown source' FROM part WHERE p_partkey % 150 NOT IN (SELECT s_suppkey FROM supplier)""",
    "probe_terms": rf"""WITH d AS (SELECT ' ' || array_to_string({tok('text')}, ' ') || ' ' AS t FROM documents)
        SELECT 'general public license' AS query, count(*) AS n FROM d WHERE contains(t, ' general ') AND contains(t, ' public ') AND contains(t, ' license ')
        UNION ALL SELECT 'version-2', count(*) FROM d WHERE contains(t, ' version 2 ') UNION ALL SELECT 'the', count(*) FROM d WHERE contains(t, ' the ')
        UNION ALL SELECT 'Übermut', count(*) FROM d WHERE contains(t, ' ubermut ') UNION ALL SELECT 'nosuchword', 0 UNION ALL SELECT '___', 0""",
    "filtered_search": f"""WITH {searched("terms(query_id, phrase, size, off, term) AS (VALUES (0, 0, 1, 0, 'licensed'), (0, 1, 1, 0, 'under'), (0, 2, 1, 0, 'the'))")},
        cases AS (SELECT k || l AS id, k, l FROM (VALUES ('docs'), ('source')) a(k), (VALUES ('en'), ('fr')) b(l)),
        joined AS (SELECT id, s.rank, {PRIORITY} AS kp, c.* FROM scores s JOIN chunks c USING (source_id) JOIN cases ON kind = k AND language = l),
        top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kp, round(rank, 9), source_id) AS n FROM joined QUALIFY n <= 60),
        once AS (SELECT *, row_number() OVER (PARTITION BY id, content_hash ORDER BY n) AS h FROM top QUALIFY h = 1),
        best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS position FROM once QUALIFY position <= 3)
        SELECT cases.id, coalesce(string_agg(repository || ':' || path, ' ' ORDER BY position), '') AS retrieved, coalesce(bool_or(path IN ('docs/2.md', 'docs/20.md')), false) AS passed FROM cases LEFT JOIN best ON best.id = cases.id GROUP BY cases.id
        UNION ALL SELECT 'none', '', true""",
    "dependency_rate": """WITH b AS (SELECT count(DISTINCT p_brand) AS b FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5'))
        SELECT b + 1 AS cases, b AS positive_cases, 1::BIGINT AS negative_cases, round(b::DOUBLE / (b + 1), 6) AS pass_rate, true AS review_acknowledged, false AS passed FROM b""",
    "script_usages": f"WITH {ALIASES} SELECT key, accessor, ['implementation', 'api', 'runtimeOnly', 'ksp'][key % 6 + 1] AS configuration, 2 AS line FROM aliases WHERE key % 6 < 4",
    "catalog_entries": f"""WITH {ALIASES} SELECT key, key % 4 = 3 AS malformed, CASE WHEN key % 4 < 3 THEN alias END AS alias, CASE WHEN key % 4 < 3 THEN accessor END AS accessor,
        CASE WHEN key % 4 < 3 THEN lower(replace(group_id, '#', '')) END AS group_id, CASE WHEN key % 4 < 3 THEN replace(artifact_id, ' ', '-') END AS artifact_id,
        ['', 'v', '', NULL][key % 4 + 1] AS version_ref, ['1.' || key, '2', '3', NULL][key % 4 + 1] AS version_value FROM aliases""",
}
