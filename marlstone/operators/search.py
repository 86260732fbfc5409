"""Full-text search over a stored inverted index: phrase matches, BM25, kind priority, greedy de-duplication.

The index is written once: postings in buckets by the hash of their term, sorted by term within a file, the rows'
other columns, and the statistics. A batch of queries reads only the buckets of its terms, and of these the row
groups that hold them; the texts are not looked at again. The cost of a search follows its terms' postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import ACCENTS, PLAIN, kind_priority, phrases, tokens
from marlstone.session import lean, materialise, sized_broadcast, small_batches

K1, B = 1.2, 0.75
#: Folders that postings are spread over by the hash of their term.
BUCKETS = 32
#: Characters of text whose postings of one bucket are one slice, that is about a task's work, times the buckets.
SLICE_CHARS = 4 << 20
#: Characters of text that one task makes postings of; its output, about 15 bytes a character, waits in memory for the shuffle.
TASK_CHARS = 8 << 20
#: Terms of a batch that are given to the scan as values; more are joined.
LITERALS = 4000
#: Rows fetched for each result asked for, before de-duplication.
OVERFETCH = 20


def query_terms(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """query_id, phrase, phrase_size, offset, term of every phrase of the queries."""
    rows = [(q, p, len(terms), o, t) for q, text in queries.items() for p, terms in enumerate(phrases(text)) for o, t in enumerate(terms)]
    return spark.createDataFrame(rows, "query_id long, phrase int, phrase_size int, offset int, term string")


def term_columns(queries: DataFrame) -> DataFrame:
    """The same for a table (query_id, query), without leaving the JVM."""
    parts = F.filter(F.transform(F.regexp_extract_all("query", F.lit(r"(?U)[\w-]+"), F.lit(0)), tokens), lambda t: F.size(t) > 0)
    out = queries.select("query_id", F.posexplode(parts).alias("phrase", "terms"))
    return out.select("query_id", "phrase", F.size("terms").alias("phrase_size"), F.posexplode("terms").alias("offset", "term"))


def token_arrays(chunks: DataFrame, key: str = "source_id", fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """key and, for each indexed field, its token array."""
    return chunks.select(key, *(tokens(F.coalesce(f, F.lit(""))).alias(f) for f in fields))


def postings(chunks: DataFrame, key: str = "source_id", fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """key, field, pos, term: the positional inverted index."""
    arrays = token_arrays(chunks, key, fields)
    stacked = arrays.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields))).alias("x"))
    return stacked.select(key, F.col("x.field").alias("field"), F.posexplode("x.t").alias("pos", "term"))


@dataclass
class Index:
    """A stored index: postings (bucket, term, key, field, tf, positions, dl, kind_priority), rows (all columns but
    content), and counts."""

    postings: DataFrame
    rows: DataFrame
    n_rows: int
    avgdl: float
    key: str
    buckets: int


def _bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _postings_schema(key: str, kind: str) -> str:
    return f"term string, {key} {kind}, field string, tf int, positions array<int>, dl int, kind_priority int"


def grouped_postings(arrays: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """A row for each term of each field of each row of ``arrays`` (key, kind_priority, dl, token arrays)."""
    schema = _postings_schema(key, arrays.schema[key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, field in enumerate(fields, 3):
                lists = b.column(k)
                term = lists.flatten().dictionary_encode()
                if not len(term):
                    continue
                code, size = term.indices.to_numpy(), pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
                order = np.lexsort((pos, code, row))
                row, code = row[order], code[order]
                s = np.flatnonzero(np.insert((row[1:] != row[:-1]) | (code[1:] != code[:-1]), 0, True))
                e = np.append(s[1:], len(row))
                at = pa.array(row[s])
                positions = pa.ListArray.from_arrays(pa.array(np.append(s, len(row)).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
                columns = [term.dictionary.take(pa.array(code[s])), b.column(0).take(at), pa.array([field] * len(s)), pa.array((e - s).astype(np.int32)), positions, b.column(2).take(at), b.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["term", key, "field", "tf", "positions", "dl", "kind_priority"])

    return arrays.select(key, "kind_priority", "dl", *fields).mapInArrow(lean(run), schema)


def write_index(chunks: DataFrame, folder: str, key: str = "source_id", fields: tuple[str, ...] = ("title", "content"), buckets: int = BUCKETS) -> None:
    """Write the index of ``chunks`` into a new folder.

    A bucket is cut into slices of rows, as many as the length of all texts asks for or the session's shuffle
    partitions allow: neither a bucket nor a frequent term is the work of one task, and no task's work grows with the
    texts. A chunk without terms counts as a row of length 0.
    """
    spark = chunks.sparkSession
    kind = kind_priority("kind") if "kind" in chunks.columns else F.lit(0)
    texts = chunks.select(key, kind.alias("kind_priority"), *(F.coalesce(f, F.lit("")).alias(f) for f in fields))
    chars = texts.agg(F.sum(sum((F.length(f) for f in fields), F.lit(0)).cast("long"))).first()[0] or 0
    if chars > TASK_CHARS:  # the scan's tasks may be of any size
        texts = texts.repartition(max(-(-chars // TASK_CHARS), spark.sparkContext.defaultParallelism), key)
    arrays = texts.select(key, "kind_priority", *(tokens(f).alias(f) for f in fields))
    arrays = arrays.withColumn("dl", sum((F.size(f) for f in fields), F.lit(0)))
    rows = grouped_postings(arrays, key, fields).withColumn("bucket", _bucket("term", buckets))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, parts // buckets, -(-chars // (SLICE_CHARS * buckets)))
    place = F.col("bucket") * slices + F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
    with small_batches(spark):
        rows.repartitionById(buckets * slices, place).sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{folder}/postings")
    chunks.drop("content").write.parquet(f"{folder}/rows")
    n = spark.read.parquet(f"{folder}/rows").count()
    total = spark.read.parquet(f"{folder}/postings").agg(F.sum("tf")).first()[0] or 0
    spark.createDataFrame([(n, total / n if n else 0.0, key, buckets)], "n_rows long, avgdl double, key string, buckets int").coalesce(1).write.parquet(f"{folder}/statistics")


def read_index(spark: SparkSession, folder: str) -> Index:
    """An index that ``write_index`` wrote."""
    r = spark.read.parquet(f"{folder}/statistics").first()
    rows = spark.read.parquet(f"{folder}/rows")
    schema = _postings_schema(r["key"], rows.schema[r["key"]].dataType.simpleString()) + ", bucket int"
    return Index(spark.read.schema(schema).parquet(f"{folder}/postings"), rows, r["n_rows"], r["avgdl"], r["key"], r["buckets"])


def lookup(index: Index, terms: DataFrame) -> DataFrame:
    """The columns of ``terms`` with the postings of each; few terms are values that the scan skips row groups by.

    Terms are broadcast where their size is small: a shuffle would bring all postings of a term into one task.
    """
    bucketed = terms.withColumn("bucket", _bucket("term", index.buckets))
    few = bucketed.select("term", "bucket").distinct().limit(LITERALS + 1).collect()
    if len(few) > LITERALS:
        return index.postings.join(sized_broadcast(bucketed), ["bucket", "term"]).drop("bucket")
    chosen = F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few}))
    return index.postings.where(chosen).drop("bucket").join(sized_broadcast(terms), "term")


def asked_phrases(terms: DataFrame) -> DataFrame:
    """query_id, text, terms, times: the different phrases of each query and how often it has them."""
    listed = terms.groupBy("query_id", "phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "term"))), lambda x: x["term"]).alias("terms"))
    asked = listed.groupBy("query_id", F.array_join("terms", " ").alias("text"), "terms").agg(F.count("*").alias("times"))
    few = asked.limit(LITERALS + 1).collect()
    return terms.sparkSession.createDataFrame(few, asked.schema) if len(few) <= LITERALS else asked


def phrase_frequencies(index: Index, asked: DataFrame) -> DataFrame:
    """text, key, dl, kind_priority, tf: rows with each different phrase, adjacent terms within one field, once for
    all queries that ask for it. Positions are read for phrases of several terms only."""
    place = [index.key, "dl", "kind_priority"]
    different = asked.select("text", "terms").distinct()
    single = different.where(F.size("terms") == 1).select("text", F.col("terms")[0].alias("term"))
    several = different.where(F.size("terms") > 1).select("text", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    found = lookup(index, single).groupBy("text", *place).agg(F.sum("tf").alias("tf"))
    if not several.isEmpty():
        starts = F.transform("positions", lambda p: p - F.col("offset"))
        each = lookup(index, several).select("text", "size", "field", *place, starts.alias("starts"))
        each = each.groupBy("text", "size", "field", *place).agg(F.collect_list("starts").alias("starts")).where(F.size("starts") == F.col("size"))
        common = F.aggregate("starts", F.col("starts")[0], F.array_intersect)
        found = found.unionByName(each.select("text", *place, F.size(common).alias("n")).where("n > 0").groupBy("text", *place).agg(F.sum("n").alias("tf")))
    return materialise(asked.sparkSession, found, "phrases")


def conjunctions(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, key, kind_priority, dl, df, tf, times: for rows in which every phrase of a query occurs, each phrase.

    A query's rows are those of its rarest phrase; only for these the others are looked up.
    """
    asked = asked_phrases(terms)
    found = phrase_frequencies(index, asked)
    df = found.groupBy("text").agg(F.count("*").alias("df"))
    known = sized_broadcast(materialise(terms.sparkSession, asked.drop("terms").join(df, "text", "left"), "known"))
    queries = known.groupBy("query_id").agg(F.min_by("text", F.struct("df", "text")).alias("text"), F.count("*").alias("n"), F.count("df").alias("have")).where("n = have")
    rows = found.select("text", index.key).join(sized_broadcast(queries), "text").select("query_id", index.key, "n")
    every = rows.join(known, "query_id").join(found, ["text", index.key])
    return every.withColumn("_all", F.count("*").over(Window.partitionBy("query_id", index.key))).where("_all = n").drop("_all", "n", "text")


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, key: rows in which every phrase of a query occurs."""
    return conjunctions(index, terms).select("query_id", index.key).distinct()


def bm25(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, key, kind_priority, rank of all matches; the more negative a rank, the better.

    A phrase in half of the rows or more has the least weight, 1e-6; one that a query has twice counts twice.
    """
    idf = F.log((F.lit(index.n_rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl))))
    return conjunctions(index, terms).groupBy("query_id", index.key, "kind_priority").agg((-F.sum(part * F.col("times"))).alias("rank"))


def holding(index: Index, texts: DataFrame, rarest: int = 3) -> DataFrame:
    """query_id, key: rows that may hold a text (query_id, query) whole, having its rarest terms.

    A text's terms are counted in the index; the ``rarest`` of them decide, so every row that holds the text is
    in the result. One without terms may be anywhere and gives all rows.
    """
    terms = texts.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    count = lookup(index, terms.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n"))
    known = terms.join(count, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("n", "term")
    few = materialise(texts.sparkSession, known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rarest).select("query_id", "term"), "rarest")
    found = lookup(index, few).select("query_id", "term", index.key).distinct()
    need = few.groupBy("query_id").agg(F.count("*").alias("need"))
    have = found.groupBy("query_id", index.key).agg(F.count("*").alias("have"))
    every = texts.join(need, "query_id", "left_anti").select("query_id").crossJoin(index.rows.select(index.key))
    return have.join(need, "query_id").where("have = need").select("query_id", index.key).unionByName(every)


def greedy(rows: Column, hash_field: str, source_field: str, limit: int | Column) -> Column:
    """Of ordered rows, those that share neither hash nor source with a row kept before, at most ``limit``."""

    def step(kept: Column, row: Column) -> Column:
        clash = F.exists(kept, lambda k: (k[hash_field] == row[hash_field]) | (k[source_field] == row[source_field]))
        return F.when((F.size(kept) >= limit) | clash, kept).otherwise(F.concat(kept, F.array(row)))

    return F.aggregate(rows, F.filter(rows, lambda r: F.lit(False)), step)


def ranked(index: Index, scores: DataFrame, limits: DataFrame | int) -> DataFrame:
    """query_id, position and the row's columns of the best rows of each query.

    Order: kind priority, rank, key. Each query's best OVERFETCH * limit rows are folded in order; a row
    whose content or source was taken before is left out. ``limits`` is one for all or a table (query_id, top_k). Only
    the best rows are joined with the rows' columns.
    """
    key = index.key
    many = scores.withColumn("top_k", F.lit(limits)) if isinstance(limits, int) else scores.join(limits, "query_id")
    order = Window.partitionBy("query_id").orderBy("kind_priority", F.round("rank", 9), key)
    top = many.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= OVERFETCH * F.col("top_k"))
    columns = index.rows.columns
    joined = top.join(index.rows, key).withColumn("_source", F.concat_ws("\u0000", "repository", "path"))
    rows = F.array_sort(F.collect_list(F.struct("_n", "rank", "kind_priority", "_source", *columns)))
    folded = joined.groupBy("query_id", "top_k").agg(rows.alias("rows"))
    kept = folded.select("query_id", F.posexplode(greedy(F.col("rows"), "content_hash", "_source", F.col("top_k"))).alias("position", "r"))
    return kept.select("query_id", (F.col("position") + 1).alias("position"), "r.rank", "r.kind_priority", *(F.col(f"r.{c}").alias(c) for c in columns))


def narrowed(index: Index, scores: DataFrame, filters: DataFrame) -> DataFrame:
    """The scores whose row meets all equalities (query_id, field, value) of its query; others stay."""
    if filters.isEmpty():
        return scores
    fields = [r[0] for r in filters.select("field").distinct().collect()]  # names of columns
    asked = filters.groupBy("query_id").pivot("field", fields).agg(F.first("value"))
    asked = asked.select("query_id", *(F.col(f"`{f}`").alias(f"_{k}") for k, f in enumerate(fields)))
    rows = scores.join(index.rows.select(index.key, *(F.col(f).alias(f"_have{k}") for k, f in enumerate(fields))), index.key).join(asked, "query_id", "left")
    for k in range(len(fields)):
        rows = rows.where(F.col(f"_{k}").isNull() | (F.col(f"_have{k}").cast("string") == F.col(f"_{k}")))
    return rows.select(*scores.columns)


def search(index: Index, queries: dict[int, str], limit: int = 5, filters: dict[str, str] | None = None) -> DataFrame:
    """Best rows of each query; equality filters narrow the rows but not the statistics. Limits are 1 to 20."""
    spark = index.rows.sparkSession
    terms = query_terms(spark, queries)
    asked = [(q, f, v) for q in queries for f, v in (filters or {}).items() if v]
    scores = narrowed(index, bm25(index, terms), spark.createDataFrame(asked, "query_id long, field string, value string"))
    return ranked(index, scores, min(max(limit, 1), 20))


def best_window(text: str, phrases: list[list[str]], width: int) -> str:
    """The window of ``width`` terms that shows most of the phrases, its hits between ** marks, … where text is left out.

    Every hit proposes the window around the hits that follow it and one from the begin of its sentence. A phrase
    counts 1000 at its first hit in a window and 1 at each further one, a sentence's begin 100 and the text's 120; of
    equals the first stays. Without a hit it is the begin of the text.
    """
    tokens_ = [(m.start(), m.end(), m[0].lower().translate(_FOLD)) for m in re.finditer(r"[^\W_]+", text)]
    n = len(tokens_)
    found = sorted((i, p) for p, terms in enumerate(phrases) for i in range(n - len(terms) + 1) if [t for _, _, t in tokens_[i : i + len(terms)]] == terms)
    sentences = [i for i, (start, _, _) in enumerate(tokens_) if not i or text[:start].rstrip(" \t\r\n").endswith((".", ":"))] if n > width else []

    def score(start: int) -> tuple[int, int]:
        inside = [(i, p) for i, p in found if start <= i < start + width]
        kinds = len({p for _, p in inside})
        span = max(i + len(phrases[p]) for i, p in inside[-1:]) - inside[0][0] if inside else 0
        place = (inside[0][0] if inside else 0) - int((width - span) / 2)
        return 1000 * kinds + len(inside) - kinds, max(0, min(place, n - width))

    best = start = 0
    for i, _ in found:
        worth, place = score(i)
        if worth > best:
            best, start = worth, place
        before = [s for s in sentences if s <= i][-1:]
        if before and before[0] < i and (worth := score(before[0])[0] + (100 if before[0] else 120)) > best:
            best, start = worth, before[0]
    spans: list[list[int]] = []
    for i, p in found:
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], i + len(phrases[p]) - 1)
        else:
            spans.append([i, i + len(phrases[p]) - 1])
    stop = start + width - 1
    at = tokens_[start][0] if start else 0
    out = ["…" if start else ""]
    for a, b in spans:
        if start <= a <= stop:
            out += [text[at : tokens_[a][0]], "**", text[tokens_[a][0] : tokens_[min(b, stop)][1]], "**"]
            at = tokens_[min(b, stop)][1]
    return "".join([*out, text[at:] if stop >= n - 1 else text[at : tokens_[stop][1]] + "…"])


def snippet(text: Column | str, phrases: list[list[str]], width: int = 28) -> Column:
    """``best_window`` of a text for the phrases of a search; for the few rows that are shown."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else best_window(t, phrases, width) for t in texts], dtype=object)

    return shown(text)


_FOLD = str.maketrans(ACCENTS, PLAIN)
