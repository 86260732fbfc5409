"""The operators against brute force, round trips, held-out labels, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone import session
from marlstone.llm import decontaminate, licenses, linededup, neardup, pieces, quality, rules, tokencounts, urltemplates, wrappers
from marlstone.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs_of(spark, texts):
    """Rows with doc_id from 0; a pair gives the doc_id itself."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def plain_words(text):
    """Words by another library's classes of characters."""
    return [w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}_]+", text or "")]


ODD = [None, "", "   ", "one", (None, "null id text " * 30), "x " * 60_000, "é日本 İSTANBUL KK \x00 tab\t", (7, "same row"), (7, "same row"), (7, "same id, other text")]


def odd(spark):
    """Nulls in all columns, empty, very long and repeated rows, and columns that clash with working names."""
    base = docs_of(spark, ODD).unionByName(spark.createDataFrame([(None, None, None, None, None)], DOCS))
    for name in ("score", "keep", "rep", "n", "good", "start", "end", "text_hash", "_spans", "_id", "fp", "html", "host"):
        base = base.withColumn(name, F.lit("clash"))
    return base


# words


def test_words_agree_with_the_expression():
    texts = ["Héllo, wörld_1!  a-b\n\nx", None, "", "İSTANBUL KK", "z" * 3_000_000 + " end"]
    seen = []
    for lo, hi, buf, off in W.blocks(pa.array(texts), True):
        s, e = W.split(buf)
        cut = W.rows_of(off, s)
        seen += [[buf[a:b].tobytes().decode() for a, b in zip(s[cut[r] : cut[r + 1]], e[cut[r] : cut[r + 1]])] for r in range(hi - lo)]
    assert [len(x) for x in seen] == [len(plain_words(t)) for t in texts]
    assert seen[0] == plain_words(texts[0])


def test_a_task_holds_a_few_mb_of_texts(spark, monkeypatch):
    """Workers get batches of bounded bytes while a table is written, and lower-case one block at a time."""
    rows = spark.range(120).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Some Words "), 20_000).alias("text")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    key, before = session._ARROW, spark.conf.get(session._ARROW, None)
    most = session.materialise(spark, rows.mapInArrow(W.lean(sizes), "n long"), "sizes").agg(F.max("n"), F.sum("n")).first()
    assert most[0] <= 2 * session.ARROW_BYTES and most[1] >= 120 * 220_000 and spark.conf.get(key, None) == before
    seen, whole = [], W.as_strings
    monkeypatch.setattr(W, "as_strings", lambda c, lower: (seen.append(c.nbytes), whole(c, lower))[1])
    column = pa.array(["A b " * 50_000, None, "", "Ünï c " * 10] * 12)
    got = [(lo + r, bytes(buf[off[r] : off[r + 1]])) for lo, hi, buf, off in W.blocks(column.slice(1), lower=True) for r in range(hi - lo)]
    assert got == [(i, ((t or "").lower() + "\n").encode()) for i, t in enumerate(column.to_pylist()[1:])]
    assert max(seen) <= 2 * W.BLOCK_BYTES


def test_span_hash_depends_on_bytes_only():
    buf = np.frombuffer(b"abc xabc abcd cba abc", np.uint8)
    s, e = W.split(buf)
    h = W.span_hash(buf, s, e)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


# 1 token counts


def test_counts_equal_the_library(texts):
    c = tokencounts.Counter(tokencounts.vocabularies())
    odd_texts = ["", None, "  ", "a  b", "\n x", "a\n\n b \n", "don't x", "日本 語", "x" * 500, "\t y", "　 b"]
    some = [*list(texts.values())[:60], *odd_texts]
    for _ in range(2):
        assert [tuple(r) for r in c.count(some)] == [c.whole(t) if t else (0, 0) for t in some]


@pytest.mark.parametrize("compact", [16, 1, 2])
def test_rollup_is_signed_and_idempotent(spark, tmp_path, compact):
    store = tokencounts.Rollup(spark, str(tmp_path / "store"), ("byte_bpe_50k",), compact=compact)
    first = docs_of(spark, ["one two", "three four five", None, (None, "six")]).withColumn("n_tokens", F.lit("clash"))
    totals = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    count = lambda *t: sum(tokencounts.Counter(tokencounts.vocabularies(("byte_bpe_50k",))).count(list(t))[:, 0])
    assert totals() == {}
    assert store.commit("a", first) and not store.commit("a", first)
    assert totals() == {("s", "en"): (4, count("one two", "three four five", "six"))}
    revised = docs_of(spark, [(0, "one two three seven")]).withColumn("source", F.lit("t"))
    assert store.commit("b", revised, spark.createDataFrame([(1,), (99,), (None,)], "doc_id long"))
    want = {("s", "en"): (2, count("six")), ("t", "en"): (1, count("one two three seven"))}
    assert totals() == want
    assert not store.commit("b", revised) and totals() == want
    assert store.commit("c", docs_of(spark, []), None) and totals() == want
    assert store.commit("d", None, spark.createDataFrame([(0,), (2,)], "doc_id long")) and totals() == {("s", "en"): (1, count("six"))}
    with pytest.raises(ValueError):
        store.commit("../x", first)


def test_a_writer_that_comes_second_starts_again(spark, tmp_path):
    """The entry that another writer adds in between is seen, so the old counts are taken back once."""
    store, other = (tokencounts.Rollup(spark, str(tmp_path / "store"), ("byte_bpe_50k",)) for _ in range(2))
    store.commit("a", docs_of(spark, ["one two three"]))
    read, seen = store.log, []

    def log():
        found = read()
        if len(seen) == 1:  # the commit has looked for its name, and now reads the state
            seen.append(2)
            assert other.commit("b", docs_of(spark, ["one"]))
        else:
            seen.append(1)
        return found

    store.log = log
    assert store.commit("c", docs_of(spark, ["one two"]))
    assert [(r.n_docs, r.n_tokens) for r in other.totals().collect()] == [(1, 2)] and len(other.log()[1]) == 3


def test_token_totals_are_those_of_the_table(spark, sf, docs):
    want = tokencounts.count_tokens(docs).groupBy("source", "lang", "version").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    got = tokencounts.op1_token_counts(spark, sf)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_rollup_of_odd_rows(spark, tmp_path):
    store = tokencounts.Rollup(spark, str(tmp_path / "store"), ("byte_bpe_50k",))
    assert store.commit("a", odd(spark))
    assert sum(r.n_docs for r in store.totals().collect()) == len(ODD) + 1


# 2 licence scans


def brute_licences(text):
    """Every template at every word: its phrases, each at most 12 words from where it belongs."""
    words, spans = plain_words(text), [m.span() for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+", text or "")]
    found = set()
    stands = lambda p, s: s >= 0 and words[s : s + len(p)] == p
    for name, notice, phrases in licenses.TEMPLATES:
        body = plain_words(notice)
        parts = sorted((next(k for k in range(len(body)) if body[k : k + len(p)] == p), p) for p in map(plain_words, phrases))
        for first in range(len(words)):
            if stands(parts[0][1], first):
                ends = [first + len(parts[0][1])]
                for at, p in parts[1:]:
                    want = first + at - parts[0][0]
                    near = sorted((abs(s - want), s) for s in range(want - 12, want + 13) if stands(p, s))
                    ends.append(near[0][1] + len(p) if near else None)
                if None not in ends:
                    found.add((name, first, max(ends)))
    outer = [f for f in found if not any(g[1] <= f[1] and f[2] <= g[2] and g[2] - g[1] > f[2] - f[1] for g in found)]
    return [(n, spans[s][0], spans[e - 1][1]) for n, s, e in outer]


def test_licences_equal_brute_force(spark, texts):
    notices = [t[1] for t in licenses.TEMPLATES]
    made = [f"Some words. {n} and more; {n.upper()}." for n in notices] + ["licensed under the apache license but no version", "under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy only"]
    made += [notices[2].replace("the", "the “new”\u00a0—"), *(n.replace(". ", ". Copyright 2020 by some of us. ").replace(" of ", " “of” ") for n in notices)]
    every = made + list(texts.values())
    got = defaultdict(list)
    for r in licenses.scan(docs_of(spark, every)).collect():
        got[r.doc_id].append((r.license, r.start, r.end))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(w) for i, t in enumerate(every) if (w := brute_licences(t))}
    assert all(got[i] for i in range(len(notices)))


def test_licences_of_odd_rows(spark):
    df = odd(spark)
    assert licenses.scan(df).count() == 0 and licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, ()).count() == 0
    assert [r.doc_id for r in licenses.scan(docs_of(spark, [(None, "Released under the MIT License.")] * 2)).collect()] == [None, None]


# 3 quality classifier


def labelled_docs(spark, n=240):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        kind = i % 4
        body = rng.choices(words, k=rng.randint(30, 200))
        if kind == 0:
            body = [w.upper() + "!!" for w in body]
        if kind == 1:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["vile", "nasty", "awful"]))
        rows.append((i, " ".join(body)))
        marks.append((i, int(kind != 0), int(kind == 1)))
    return docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled_docs(spark)
    known = labels.where("doc_id < 160")
    kept = {r.doc_id for r in quality.scored_kept(docs, known).collect()}
    held = range(160, 240)
    right = sum((i in kept) == (i % 4 > 1) for i in held)
    assert right >= 0.95 * len(held)
    assert {r.doc_id for r in quality.keep_good(docs.withColumn("score", F.lit("x")), known).collect()} == kept


def test_pair_loss_orders_scores():
    x = np.random.default_rng(0).normal(size=(200, 3)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    s = x @ quality.fit_pairs(x, y, 5000)
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.97


def test_fitted_loss_equals_a_slow_optimiser():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    y = (x @ [1, -1, 0.5, 0, 0, 0.2] + rng.normal(size=300) > 0).astype(int)
    i, j = quality.drawn_pairs(y, 4000)
    w = np.zeros(6)
    for _ in range(20_000):  # plain gradient descent on the convex loss
        s = x @ w
        g = -1 / (1 + np.exp(s[i] - s[j])) / len(i)
        w -= 0.5 * (x.T @ (np.bincount(i, g, len(y)) - np.bincount(j, g, len(y))) + quality.L2 * w)
    fitted = quality.fit_pairs(x, y, 4000).astype(float)
    assert quality.pair_loss(fitted, x, i, j) <= quality.pair_loss(w, x, i, j) * 1.005


def test_chosen_words_equal_brute_force(spark):
    docs, labels = labelled_docs(spark)
    sample = quality.draw(quality.labelled(labels), docs, 70)
    rows = sample.collect()
    assert Counter(r.good for r in rows) == {0: 70, 1: 70} and sorted(r.place for r in rows) == sorted([*range(1, 71)] * 2)
    want = []
    for word in {w for r in rows for w in quality.words_and_stats(r.text)[0]}:
        n = Counter(r.good for r in rows if word in quality.words_and_stats(r.text)[0])
        p, q, m = n[0] / 70, n[1] / 70, (n[0] + n[1]) / 140
        z = (p - q) / (max(m * (1 - m), 1e-9) * (2 / 70)) ** 0.5
        if n[0] + n[1] >= 5 and z >= 4 and p >= 0.8 * (p + q):
            want.append(word)
    assert quality.bad_words(sample) == sorted(want) and {"awful", "vile", "nasty"} <= set(want)


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(odd(spark), none)
    assert kept.columns == COLUMNS and kept.count() == sum(bool((t[1] if isinstance(t, tuple) else t or "").strip()) for t in ODD)
    nulls = spark.createDataFrame([(0, None, None), (None, 1, 0), (1, 1, None), (1, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.good for r in quality.labelled(nulls).collect()} == {1: 0, 2: 1}
    docs, labels = labelled_docs(spark, 80)
    assert quality.scored_kept(docs.limit(0), labels).count() == 0
    assert quality.keep_good(odd(spark).unionByName(docs, allowMissingColumns=True), labels).columns == COLUMNS


# 4 decontamination


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for sigma in (1, 2, 5):
        text = rng.integers(0, sigma + 1, 300)
        index = decontaminate.FMIndex(text, sigma)
        for n in (1, 2, 4):
            p = rng.integers(1, sigma + 1, (20, n))
            lo, hi = index.search(p, np.full(20, n))
            for row, a, b in zip(p, lo, hi):
                want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == row).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_spans(text, items, window):
    seq, marks = plain_words(text), set()
    for item in items:
        w = plain_words(item)
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(seq) - n + 1 if n else 0):
            if tuple(seq[k : k + n]) in grams:
                marks.add((k, k + n))
    out = []
    for s, e in sorted(marks):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    chars = W.word_spans(text)
    return [(chars[s][0], chars[e - 1][1]) for s, e in out]


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_spans_equal_brute_force(spark, texts, sf, shard):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r.text for r in bench.collect()] + ["tiny phrase here"]
    made = list(texts.values()) + [f"Before. {items[0].upper()} then, TINY   phrase\nhere! {items[1]} {items[1]}", " ".join(items[0].split()[:12]), " ".join(items[0].split()[2:17])]
    more = bench.unionByName(spark.createDataFrame([(999, "tiny phrase here"), (None, None), (None, "..."), (1000, "tiny phrase here")], "item_id long, text string"))
    got = defaultdict(list)
    for r in decontaminate.find_spans(docs_of(spark, made), more, shard_symbols=shard).collect():
        got[r.doc_id].append((r.start, r.end))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, t in enumerate(made) if (w := brute_spans(t, items, decontaminate.WINDOW))}


def test_removal(spark):
    bench = spark.createDataFrame([(1, "İx secret answer phrase")], "item_id long, text string")
    df = docs_of(spark, ["keep é this İx secret answer phrase, and that", None, "", (None, "a İx Secret answer phrase b"), (5, "clean"), (5, "İx secret answer phrase")]).withColumn("start", F.lit(1))
    rows = [(r.doc_id, r.text, r.n_chars) for r in decontaminate.remove_phrases(df, bench).collect()]
    assert sorted(rows, key=repr) == sorted([(0, "keep é this , and that", 22), (1, None, None), (2, "", 0), (None, "a  b", 4), (5, "clean", 5), (5, "", 0)], key=repr)
    assert decontaminate.remove_phrases(odd(spark), bench).columns == COLUMNS
    assert decontaminate.remove_phrases(odd(spark), bench).count() == len(ODD) + 1
    assert decontaminate.find_spans(df, bench.limit(0)).count() == 0 and decontaminate.find_spans(df.limit(0), bench).count() == 0


# 5 SentencePiece


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(9)
    vocabulary = [sp.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    made = ["".join(rng.choices(vocabulary, k=rng.randint(1, 5))) for _ in range(1500)]
    some = [*list(texts.values())[:80], *made, "", " ", "  a  b ", "\n\n x\n", "日本語 😀 \x00\ttab", "x" * 700, None]
    rows = {r.doc_id: r for r in pieces.encode_documents(docs_of(spark, some)).collect()}
    for i, t in enumerate(some):
        assert rows[i].ids == (None if t is None else sp.encode(t)) and rows[i].round_trip == (None if t is None else True), t
    again = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode_documents(docs_of(spark, some))).collect()}
    assert [again[i] for i in range(len(some))] == some


def test_long_words(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(2)
    made = ["x" * 1_000_000, "".join(rng.choices("abcdefghij", k=300_000)), "é" * 5000 + "日" * 700]
    rows = {r.doc_id: r for r in pieces.encode_documents(docs_of(spark, made)).collect()}
    assert all(rows[i].round_trip for i in range(3)) and all(rows[i].ids == sp.encode(made[i]) for i in (1, 2))


def test_pieces_of_odd_rows(spark):
    rows = pieces.encode_documents(odd(spark)).collect()
    assert len(rows) == len(ODD) + 1 and all(r.round_trip for r in rows if r.ids is not None)
    assert pieces.encode_documents(odd(spark).limit(0)).count() == 0


# 6 quality rules


def test_rules_on_held_out_rows(spark):
    docs, labels = labelled_docs(spark)
    kept = {r.doc_id for r in rules.kept(docs, labels.where("doc_id < 160")).collect()}
    assert sum((i in kept) == (i % 4 > 1) for i in range(160, 240)) >= 0.95 * 80


def test_expression_equals_the_rules(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (80, len(rules.STATS))).astype(float)
    found = [[("marks", ">=", 3.5), ("upper", "<=", 2.0)], [("n_words", "<=", 1.0)]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(rules.STATS))
    got = [r[0] for r in df.select(rules.expression(found)).collect()]
    want = np.where(rules.covered(x, found[0]), 1, np.where(rules.covered(x, found[1]), 2, 0))
    assert got == want.tolist()


def brute_learn(x, bad):
    """Covering with every rule grown by trying every cut of every statistic."""
    order = np.random.default_rng(5).permutation(len(x))
    rows = [(dict(zip(rules.STATS, x[i])), bool(bad[i]), k % 3 == 0) for k, i in enumerate(order)]
    meets = lambda r, rule: all(r[n] >= t if op == ">=" else r[n] <= t for n, op, t in rule)
    found = []
    while any(b for _, b, held in rows if not held):
        rule = []
        while True:
            inside = [(r, b) for r, b, held in rows if not held and meets(r, rule)]
            p0 = sum(b for _, b in inside)
            if p0 in (0, len(inside)):
                break
            best = (1e-9, None)
            for name in rules.STATS:
                v = sorted({r[name] for r, _ in inside})
                for op in (">=", "<="):
                    for a, b in zip(v, v[1:]):
                        hit = [bad for r, bad in inside if meets(r, [(name, op, (a + b) / 2)])]
                        if p := sum(hit):
                            gain = p * (np.log2(p / len(hit)) - np.log2(p0 / len(inside)))
                            if gain > best[0] + 1e-12:
                                best = (gain, (name, op, (a + b) / 2))
            if best[1] is None:
                break
            rule.append(best[1])
        worth = []
        for k in range(1, len(rule) + 1):
            hit = [b for r, b, held in rows if held and meets(r, rule[:k])]
            worth.append(((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -k))
        rule = rule[: -max(worth)[1]] if rule else rule
        hit = [b for r, b, held in rows if held and meets(r, rule)]
        if not rule or sum(hit) < 2 or sum(hit) / len(hit) < 0.8:
            break
        found.append(rule)
        rows = [r for r in rows if not meets(r[0], rule)]
    return found


def test_covering_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(6):
        x = rng.integers(0, 9, (120, len(rules.STATS))).astype(float)
        bad = (x[:, 1] > 6) | ((x[:, 3] < 3) & (x[:, 4] > 4)) | (rng.random(120) < 0.03)
        assert rules.learn(x, bad) == brute_learn(x, bad)


def test_rules_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.kept(odd(spark), none).count() == len(ODD) + 1
    docs, labels = labelled_docs(spark, 80)
    assert rules.kept(docs.limit(0), labels).count() == 0


# 7 near-duplicates


def shingle_sets(texts):
    out = []
    for lo, hi, buf, off in W.blocks(pa.array(texts), True):
        s, e = W.split(buf)
        h = W.span_hash(buf, s, e)
        cut = W.rows_of(off, s)
        out += [np.unique(neardup.shingles(h[cut[r] : cut[r + 1]])) for r in range(hi - lo)]
    return out


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(3)
    for j in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(30):
            n = 300
            both = int(2 * n * j / (1 + j))
            base = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = base[:n], base[n - both :]
            k = neardup.sketch_rows(np.concatenate([a, b, base]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + len(base)]))
            assert (np.maximum(k[0], k[1]) == k[2]).all()
            c = neardup.cardinality(k)
            errors.append(neardup.joint_estimate(k[:1], k[1:2], c[:1], c[1:2])[0] - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_groups_equal_brute_force(spark, docs, texts):
    got = {r.doc_id: r.group_id for r in neardup.near_groups(docs).collect()}
    ids = sorted(texts)
    sets = shingle_sets([texts[i] for i in ids])
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids[:x]) if len(sets[x]) and neardup.jaccard(sets[x], sets[y]) >= neardup.THRESHOLD]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {i: find(i) for p in pairs for i in p}
    assert len(pairs) > 10 and sum(got.get(a) == got.get(b) is not None for a, b in pairs) >= 0.97 * len(pairs)
    assert all(want.get(i) == g for i, g in got.items())


def test_members_that_fail_verification_are_compared(spark):
    """One bucket; the leader resembles both members with less than the threshold, they resemble each other."""
    rng = random.Random(21)
    word = lambda n: ["".join(rng.choices("abcdefghijklmno", k=7)) for _ in range(n)]
    found, rows = [], []
    for g in range(0, 60, 3):
        passage = word(200)
        texts = [passage + word(235)] + [passage + word(10) for _ in range(2)]
        rows += [(g + i, " ".join(t)) for i, t in enumerate(texts)]
        found += [(g, g + i) for i in range(3)]
    docs = docs_of(spark, rows)
    buckets = spark.createDataFrame(found, "bucket_id long, rep long").collect()
    pairs = [(g, g + i) for g, i in ((g, i) for g in range(0, 60, 3) for i in (1, 2))]
    neardup_collisions, neardup.collisions = neardup.collisions, lambda *_: spark.createDataFrame(buckets)
    try:
        got = {r.doc_id: r.group_id for r in neardup.near_groups(docs).collect()}
    finally:
        neardup.collisions = neardup_collisions
    sets = shingle_sets([t for _, t in rows])
    assert all(0.37 < neardup.jaccard(sets[a], sets[b]) < 0.5 for a, b in pairs)
    assert got == {g + i: g + 1 for g in range(0, 60, 3) for i in (1, 2)}


def test_links_of_members_that_others_stand_for(spark):
    """One bucket: a and b, c and d are copies, and b resembles c; a resembles neither c nor d, and d not b."""
    rng = random.Random(41)
    word = lambda n: ["".join(rng.choices("abcdefghijklmno", k=7)) for _ in range(n)]
    found, rows = [], []
    for g in range(0, 48, 4):
        both = word(420)
        b, c = both + word(180), both + word(180)
        rows += [(g + i, " ".join(t)) for i, t in enumerate([word(90) + b[90:], c[:330] + word(90) + c[420:], b, c])]
        found += [(g, g + i) for i in range(4)]
    docs, buckets = docs_of(spark, rows), spark.createDataFrame(found, "bucket_id long, rep long").collect()
    before, neardup.collisions = neardup.collisions, lambda *_: spark.createDataFrame(buckets)
    try:
        got = {r.doc_id: r.group_id for r in neardup.near_groups(docs).collect()}
    finally:
        neardup.collisions = before
    sets = shingle_sets([t for _, t in rows])
    for g in range(0, 48, 4):
        a, d, b, c = sets[g : g + 4]
        assert min(neardup.jaccard(a, b), neardup.jaccard(b, c), neardup.jaccard(c, d)) >= 0.5 > max(neardup.jaccard(a, c), neardup.jaccard(a, d), neardup.jaccard(b, d))
    assert got == {g + i: g for g in range(0, 48, 4) for i in range(4)}


def test_pairs_of_a_large_bucket_grow_with_its_members(spark):
    """Members that all resemble each other by about 0.55: few pairs are verified, and they are one group."""
    rng, n = np.random.default_rng(43), 400
    base = np.array(["".join(rng.choice(list("abcdefghijklmno"), 7)) for _ in range(300)])
    rows = []
    for i in range(n):
        at = int(rng.integers(0, 220))
        own = ["".join(rng.choice(list("abcdefghijklmno"), 7)) for _ in range(80)]
        rows.append((i, " ".join([*base[:at], *own, *base[at + 80 :]])))
    docs, pairs = docs_of(spark, rows), []
    before, neardup.verified = neardup.verified, lambda p, *x: (pairs.append(p.count()), before(p, *x))[1]
    try:
        got = {r.doc_id: r.group_id for r in neardup.near_groups(docs).collect()}
    finally:
        neardup.verified = before
    assert got == dict.fromkeys(range(n), 0)
    assert sum(pairs) < n * (n - 1) / 2 / 5


def test_recall_near_the_threshold(spark):
    """Pairs with a similarity of 0.5 to 0.6, where it is hardest: at least 0.9 are found, and no pair below 0.5."""
    rng = random.Random(31)
    word = lambda n: ["".join(rng.choices("abcdefghijklmno", k=7)) for _ in range(n)]
    rows = []
    for k in range(400):
        both, own = word(200), rng.uniform(0.44, 0.56) if k % 2 else rng.uniform(0.30, 0.42)
        n = int(200 * (1 - own) / own / 2)
        rows += [(2 * k, " ".join(both + word(n))), (2 * k + 1, " ".join(both + word(n)))]
    got = {r.doc_id: r.group_id for r in neardup.near_groups(docs_of(spark, rows)).collect()}
    sets = shingle_sets([t for _, t in rows])
    alike = [k for k in range(400) if neardup.jaccard(sets[2 * k], sets[2 * k + 1]) >= 0.5]
    assert len(alike) > 50 and sum(got.get(2 * k + 1) == 2 * k for k in alike) >= 0.9 * len(alike)
    assert set(got) <= {i for k in alike for i in (2 * k, 2 * k + 1)}


def test_near_copies_of_which_passages_were_cut(spark):
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(n))
    uncut, cut = [], []
    for k in range(0, 60, 3):
        parts = [prose(60) for _ in range(6)]
        uncut += [(k, " ".join(parts)), (k + 1, " NEW ".join(parts)), (k + 2, prose(200))]
        cut += [(k, uncut[-3][1]), (k + 1, f"{' '.join(parts[0].split()[-5:])} NEW"), (k + 2, uncut[-1][1])]
    cut += [(100, "not what stood there"), (None, "no id")]  # an id whose uncut text is another one's copy, but not of this row
    uncut += [(100, uncut[0][1])]
    kept = {r.doc_id for r in neardup.drop_near_duplicates(docs_of(spark, cut), docs_of(spark, uncut)).collect()}
    assert kept == {i for k in range(0, 60, 3) for i in (k, k + 2)} | {100, None}
    assert {r.doc_id for r in neardup.drop_near_duplicates(docs_of(spark, cut)).collect()} == {i for i, _ in cut}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 12)] + [(30, 20), (20, 25), (25, 20)]
    got = {r.node: r.root for r in neardup.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, 20: 20, 25: 20, 30: 20}


def test_bucket_of_unlike_members_compares_all(spark):
    """Leaders: members that do not resemble the first are compared with each other."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [base, np.concatenate([base[:190], rng.integers(0, 2**63, 10, dtype=np.uint64)])]
    k = neardup.sketch_rows(np.concatenate(sets), np.arange(0, 200 * 13, 200))
    df = spark.createDataFrame([(1, i, bytearray(r.tobytes())) for i, r in enumerate(k)], "bucket_id long, rep long, sketch binary")
    assert sorted((r.a, r.b) for r in neardup.likely_pairs(df, 0.5).collect()) == [(i, i + 1) for i in range(0, 12, 2)]


def test_near_dedup_edges(spark):
    kept = neardup.drop_near_duplicates(odd(spark).withColumn("group_id", F.lit(1)))
    assert kept.columns == COLUMNS
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(ODD)}) + Counter([(None, None)])
    assert neardup.near_groups(odd(spark).limit(0)).count() == 0
    copies = docs_of(spark, ["a b c d e", "A b, c d e!", "other words stand here", (None, "a b c d e")])
    assert sorted((r.doc_id, r.group_id) for r in neardup.near_groups(copies).collect()) == [(0, 0), (1, 0)]
    assert sorted(((r.doc_id) for r in neardup.drop_near_duplicates(copies).collect()), key=repr) == sorted([0, 2, None], key=repr)


# 8 HTML extraction


def test_wrapper_matches_all_its_streams():
    rng = random.Random(6)
    for _ in range(60):
        streams = []
        for _ in range(5):
            s = ["html"]
            if rng.random() < 0.5:
                s += ["nav", *["li", "#", "/li"] * rng.randint(0, 4), "/nav"]
            for _ in range(rng.randint(0, 3)):
                s += ["p", "#", *rng.choice([[], ["b", "#", "/b"], ["br"]]), "/p"]
            streams.append(s + rng.choice([[], ["footer", "#", "/footer"]]) + ["/html"])
        wrapper, shaped = wrappers.infer([wrappers.fold(list(s)) for s in streams])
        assert shaped == sorted(set(shaped)) and shaped[0] == 0
        for s in streams:
            assert len(wrappers.match(wrapper, s)) == s.count("#")


def brute_fold(items):
    """Shortest block first, then from the left, by comparing all blocks."""
    size = 1
    while 2 * size <= len(items):
        for i in range(len(items) - 2 * size + 1):
            block = items[i : i + size]
            if block == items[i + size : i + 2 * size] and block != ["#"]:
                k = 2
                while items[i + k * size : i + (k + 1) * size] == block:
                    k += 1
                group = block[0] if size == 1 and block[0][0] == "+" else ("+", tuple(block))
                items = items[:i] + [group] + items[i + k * size :]
                size = 0
                break
        size += 1
    return items


def as_expression(items):
    one = lambda x: re.escape(x) + ";" if isinstance(x, str) else f"(?:{as_expression(x[1])}){'?' if x[0] == '?' else '+'}"
    return "".join(map(one, items))


def test_folding_and_matching_equal_brute_force():
    rng = random.Random(5)
    token = lambda: rng.choice("abc#")
    wrapper = lambda depth: [token() if not depth or rng.random() < 0.6 else (rng.choice("?+"), tuple(wrapper(depth - 1))) for _ in range(rng.randint(1, 4))]
    for _ in range(400):
        s = [x for _, x in zip(range(rng.randint(0, 30)), iter(token, None))]
        s = [x for k, x in enumerate(s) if x != "#" or not k or s[k - 1] != "#"]
        assert wrappers.fold(list(s)) == brute_fold(list(s))
        w, s = wrapper(3), [token() for _ in range(rng.randint(0, 7))]
        found = wrappers.match(w, s)
        assert (found is not None) == bool(re.fullmatch(as_expression(w), "".join(x + ";" for x in s)))
        assert found is None or len(found) == s.count("#")


def test_long_pages(spark):
    """Pages of tens of thousands of tags, folding or not, with many groups and deep nesting, take seconds."""
    rng = random.Random(7)
    a = [rng.choice("abcdefgh") + rng.choice("uvwxyz") for _ in range(50_000)]
    b = [x if rng.random() < 0.99 else "new" for x in a]
    wrapper, _ = wrappers.infer([wrappers.fold(a), wrappers.fold(b)])
    assert wrappers.match(wrapper, a) is not None and wrappers.match(wrapper, b) is not None
    groups = [("+", (f"b{k}", "#")) for k in range(5000)]
    assert len(wrappers.match(groups, [x for k in range(5000) for x in (f"b{k}", "#", f"b{k}", "#")])) == 10_000
    page = lambda k: "<html>" + "".join(f"<p class=c{j % 97}>t{k}{j}" for j in range(20_000)) + "<div>" * 3000 + f"deep {k}" + "</div>" * 3000
    df = spark.createDataFrame([(k, "http://h.example/", page(k)) for k in range(3)], "page_id long, url string, html string")
    assert [r.matched for r in wrappers.extract(df).collect()] == [True] * 3


def test_long_streams_are_aligned_like_short_ones():
    """Streams in which all stands twice, so that no item is unique: what they share is not optional, at any length."""
    rng = random.Random(51)
    for n in (20, 600):
        base = [rng.choice("abcdefg") for _ in range(n)]
        less = [x for k, x in enumerate(base) if k % 10]
        base, other = [*base, "m", *base], ["z", "z", *less, "q", *less, "y", "y"]
        merged = wrappers.merge(base, other)
        assert all(wrappers.match(merged, s) is not None for s in (base, other))
        assert sum(x[0] != "?" for x in merged) > 0.5 * len(wrappers.fold(base))


def test_extraction_drops_the_template(spark):
    page = lambda k, n: f"<html><!-- c --><script>var a='<p>';</script><div class='top'>Same &amp; top</div><ul>{''.join(f'<li>item {k}{j}</li>' for j in range(n))}</ul><p>Text {k}</p><footer>Same foot</footer></html>"
    rows = [(k, f"https://h.example/{k}", page(k, k + 1)) for k in range(4)] + [(9, "http://alone.example/", "<p>all &lt;text"), (10, None, None), (11, "bad url", ""), (0, "https://h.example/0", page(0, 1)), (None, "https://h.example/7", page(7, 2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("slot", F.lit(1))
    out = wrappers.extract(df)
    assert out.columns == ["page_id", "host", "text", "slots", "matched"]
    got = [(r.page_id, r.text) for r in out.collect()]
    assert len(got) == len(rows) and (2, "item 20\nitem 21\nitem 22\nText 2") in got and (9, "all <text") in got and (10, "") in got and got.count((0, "item 00\nText 0")) == 2
    assert wrappers.extract(df.limit(0)).count() == 0


def test_all_pages_match(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = wrappers.extract(pages)
    assert out.count() == pages.count() and out.where("not matched").count() == 0


# 9 URL filters


def test_templates_and_purity(spark):
    rows, marks, k = [], [], 0
    for kind, good in (("news", 1), ("spam", 0)):
        for j in range(40):
            rows.append((k, f"https://www.h.example/{kind}/slug{'abcdefghijklmnopqrstuvwxyz'[j % 26]}{j}?b=1&a=2"))
            marks.append((k, good))
            k += 1
    rows += [(k, "https://other.example/x"), (k + 1, None), (None, ""), (k + 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("keep", F.lit("clash")).withColumn("segs", F.lit(1))
    labels = spark.createDataFrame([*marks, (None, 1), (0, None)], "page_id long, good int")
    out = {r.page_id: r for r in urltemplates.filter_urls(pages, labels).collect()}
    assert out[0].template == "/news/*/?a&b" and out[0].keep and out[0].pages == 40
    assert out[45].template == "/spam/*/?a&b" and not out[45].keep
    assert out[45].purity == pytest.approx((0 + 8 * 0.5) / (40 + 8)) and out[k].keep and out[k + 1].host == ""
    assert urltemplates.filter_urls(pages, labels).count() == len(rows)
    assert urltemplates.filter_urls(pages.limit(0), labels).count() == 0
    assert urltemplates.filter_urls(pages, labels.limit(0)).where("not keep").count() == 0


def test_long_urls_and_branches_without_labels(spark):
    rows = [(0, "http://h.example/" + "/".join(f"s{k}" for k in range(5000)))]
    rows += [(k, f"http://h.example/{'spam' if k <= 30 else 'new'}/{k}") for k in range(1, 41)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([*((k, 0) for k in range(1, 31)), *((k, 1) for k in range(100, 130))], "page_id long, good int")
    pages = pages.unionByName(spark.createDataFrame([(k, f"http://good.example/{k}") for k in range(100, 130)], "page_id long, url string"))
    out = {r.page_id: r for r in urltemplates.filter_urls(pages, labels).collect()}
    assert out[0].keep and out[0].template.count("/") == 5000
    assert all(out[k].keep == (k > 30) for k in range(1, 41)) and out[35].labelled == 0


def test_purity_equals_brute_force(spark):
    """On hosts whose segments are evident: counts, purity and decision from the paths themselves."""
    rng = random.Random(13)
    rows, marks = [], []
    for k in range(3000):
        section = rng.choice(["good", "mixed", "bad"])
        rows.append((k, f"http://h{k % 3}.example/{section}/{rng.randrange(10**6)}"))
        if rng.random() < 0.7:
            marks.append((k, int(rng.random() < {"good": 0.98, "mixed": 0.5, "bad": 0.03}[section])))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, good int")
    mean = sum(g for _, g in marks) / len(marks)
    count = defaultdict(lambda: [0, 0, 0])
    for k, url in rows:
        count[url.rsplit("/", 1)[0]][2] += 1
    for k, g in marks:
        count[rows[k][1].rsplit("/", 1)[0]][g] += 1
    for r in urltemplates.filter_urls(pages, labels).collect():
        bad, good, n = count[rows[r.page_id][1].rsplit("/", 1)[0]]
        purity = (good + 8.0 * mean) / (good + bad + 8.0)
        assert (r.pages, r.labelled) == (n, good + bad) and r.purity == pytest.approx(purity) and r.keep == (purity >= 0.6 * mean)


def test_rejected_section_among_many_good_ones(spark):
    sections = [f"good{c}" for c in "abcdefghijklmnopqrst"] + ["spam"]
    rows = [(20 * i + j, f"https://h.example/{s}/{j}") for i, s in enumerate(sections) for j in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spam" not in u)) for i, u in rows], "page_id long, good int")
    out = {r.page_id: r.keep for r in urltemplates.filter_urls(pages, labels).collect()}
    assert all(out[i] == ("spam" not in u) for i, u in rows)


def test_wildcards_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.host, r.segs) for r in urltemplates.url_parts(pages).collect()}
    for r in pages.collect():
        host, path, query = re.match(r"https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?", r.url).groups()
        segs = [re.sub(r"^\d+(\.\w+)?$", lambda m: "*" + (m[1] or ""), s) for s in path.split("/") if s]
        names = sorted({q.split("=")[0] for q in (query or "").split("&") if q})
        assert got[r.page_id] == (re.sub(r"^www\.", "", host), segs + (["?" + "&".join(names)] if names else []))


# 10 line dedup


def windows(texts, n=50):
    seen = defaultdict(set)
    for i, t in texts.items():
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            seen[" ".join(w[k : k + n])].add(i)
    return {g for g, v in seen.items() if len(v) > 1}


def test_planted_passages_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))
    passages = [prose(rng.randint(60, 120)) for _ in range(8)]
    texts = []
    for i in range(80):
        parts = [prose(rng.randint(5, 60)), prose(rng.randint(5, 60))]
        if i % 2:
            parts.insert(1, passages[i % 8])
        texts.append(" ".join(parts))
    out = {r.doc_id: r.text for r in linededup.remove_repeats(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        if i % 2 == 0 or i < 8:
            assert out[i] == t
        else:
            assert sum(passages[i % 8] in x for x in out.values()) == 1
            a, b = t.split(passages[i % 8])
            assert len(out[i]) >= len(a + b) - 40 and out[i].startswith(a[:-20])
    assert not windows(out)


def test_repeated_windows_of_documents_go(spark, docs, texts):
    out = {r.doc_id: r.text for r in linededup.remove_repeats(docs).collect()}
    before = windows(texts)
    assert len(before) > 100 and not before & windows(out)
    once = {i for i, t in texts.items() if not any(" ".join(t.split()[k : k + 50]) in before for k in range(max(0, len(t.split()) - 49)))}
    inner = {r.doc_id for r in linededup.repeated_spans(docs).where("first_doc_id = doc_id").collect()}
    assert all(out[i] == texts[i] for i in once - inner)


def test_bytes_decide_where_hashes_collide(monkeypatch):
    rng = random.Random(3)
    parts = [rng.choice(["ab", "ba", "abc", "c"]) for _ in range(200)]
    end = np.cumsum([len(p) + 1 for p in parts]) - 1
    begin = end - np.array([len(p) for p in parts])
    buf = np.frombuffer((" ".join(parts) + " ").encode(), np.uint8)
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(W, "span_hash", lambda b, s, e: np.zeros(len(s), np.uint64))
        kinds = linededup._classes(buf, begin, end)
        assert len({(p, k) for p, k in zip(parts, kinds.tolist())}) == len(set(parts)) == len(set(kinds.tolist()))


def test_shorter_boilerplate_by_parameter(spark):
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(n))
    footer = prose(10) + "\n" + prose(8) + "\n" + prose(6)
    rows = [f"{prose(40)}\n{footer}\n{prose(5)}" for _ in range(20)]
    kept = {r.doc_id: r.text for r in linededup.remove_repeats(docs_of(spark, rows), min_words=20).collect()}
    assert kept[0] == rows[0] and all(kept[i] == rows[i].replace(footer, "") for i in range(1, 20))
    assert linededup.repeated_spans(docs_of(spark, rows)).count() == 0


def test_line_dedup_edges(spark):
    df = odd(spark)
    rows = linededup.remove_repeats(df)
    assert rows.columns == COLUMNS and rows.count() == len(ODD) + 1
    assert linededup.repeated_spans(df.limit(0)).count() == 0
    long = " ".join(f"w{k}é" for k in range(80))
    copies = docs_of(spark, [(1, long), (1, long), (2, long), (3, f"before {long} after"), (4, None), (None, long)])
    out = Counter((r.doc_id, r.text) for r in linededup.remove_repeats(copies).collect())
    assert out[1, long] == 2 and out[None, long] == 1 and (2, long) not in out and (2, "") not in out
    assert [t.split() for (i, t) in out if i == 3] == [["before", "after"]] and out[4, None] == 1


def test_blocks_of_a_repeated_line_go(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(n))
    texts, lines = [], []
    for n, times in ((1, 120), (2, 92), (3, 40), (8, 12), (12, 10)):
        for _ in range(4):
            line = prose(n)
            lines.append((len(texts), (line + "\n") * times))
            texts += [f"{prose(20)}\n{(line + chr(10)) * times}{prose(20)}" for _ in range(2)]
    out = {r.doc_id: r.text for r in linededup.remove_repeats(docs_of(spark, texts)).collect()}
    for i, block in lines:
        a, b = texts[i].split(block)
        assert out[i].split() == (a + block.split("\n")[0] + " " + b).split()  # within a document the first line stays
        a, b = texts[i + 1].split(block)
        assert out[i + 1].split() == (a + b).split()


def test_no_repeated_window_stays(spark, docs, texts):
    """All 50-word passages are found, short ones behind a corpus too, and every removed word is in a repeated window."""
    rng = random.Random(6)
    vocabulary = sorted({w for t in texts.values() for w in (t or "").split()})
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    first = max(texts) + 1
    planted = []
    for i in range(0, 600, 2):
        passage = prose(rng.choice([50, 51, 55]))
        planted += [(first + i + k, f"{prose(30)} {passage} {prose(30)}") for k in range(2)]
    rows = docs.select(*COLUMNS).unionByName(docs_of(spark, planted))
    seen, want = set(), {}
    for i, t in sorted([*texts.items(), *planted]):
        at = [m.span() for m in re.finditer(r"[^\t-\r ]+", t or "")]
        gone = np.zeros(len(at), bool)
        for k in range(len(at) - 49):
            window = t[at[k][0] : at[k + 49][1]]
            gone[k : k + 50] |= window in seen
            seen.add(window)
        if gone.any():
            want[i] = [at[k] for k in np.flatnonzero(gone)]
    got = defaultdict(list)
    for r in linededup.repeated_spans(rows).orderBy("doc_id", "start").collect():
        t = texts.get(r.doc_id) or dict(planted)[r.doc_id]
        inside = [(r.start + m.start(), r.start + m.end()) for m in re.finditer(r"[^\t-\r ]+", t[r.start : r.end])]
        assert len(inside) == r.n_words >= 50
        got[r.doc_id] += inside
    assert sum(i >= first for i in want) == 300 and got == want


def test_repeated_rows_lose_what_one_row_loses(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(n))
    rows, parts = [], {}
    for i in range(1, 400, 4):
        passage, *ends = prose(52), *(prose(20) for _ in range(6))
        a, b, c, d, e, f = parts[i] = ends
        rows += [(i, f"{prose(20)} {passage} {prose(20)}"), (i + 1, f"{a} {passage} {b}"), (i + 1, f"{a} {passage} {b}")]
        rows += [(i + 2, f"{c} {passage} {d}"), (i + 2, f"{e} {passage} {f}")]  # two texts under one doc_id
    out = Counter((r.doc_id, " ".join(r.text.split())) for r in linededup.remove_repeats(docs_of(spark, rows)).collect())
    for i, (a, b, c, d, e, f) in parts.items():
        assert out[i + 1, f"{a} {b}"] == 2 and out[i + 2, f"{c} {d}"] == 1 and out[i + 2, f"{e} {f}"] == 1


# the pipeline


def test_pipeline(spark, sf, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id").distinct().count()
        docs = stage(spark, docs, sf).cache()
        assert 0 < docs.count() <= before
        if k < 4:
            assert docs.columns == COLUMNS and docs.where("n_chars <> length(text)").count() == 0
    assert docs.where("not round_trip").count() == 0
    run = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()}
    assert run == {(r.doc_id, tuple(r.ids)) for r in docs.collect()}


def test_stages_on_odd_rows(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd(spark), odd(spark).limit(0)):
            out = stage(spark, rows, sf)
            assert out.count() <= len(ODD) + 1
            assert name == "sentencepiece" or out.columns == COLUMNS
