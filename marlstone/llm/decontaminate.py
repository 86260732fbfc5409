"""Benchmark decontamination by an FM-index over each shard of the training data.

Symbols are the benchmark's words; every other word is the symbol 0. A window of test words cannot
match across a symbol 0, so only the runs of test words that are at least a window long enter the
index; that filter is exact. Each shard (the documents of one Spark task, in pieces of at most
``SHARD_SYMBOLS`` kept symbols, whole documents only) gets a suffix array, its Burrows-Wheeler
transform in a wavelet tree, and sampled suffix positions. All windows are searched backwards
together; the rows found are walked to a sampled position, and the spans are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import is_small, materialise, table

#: Test phrases are all windows of so many words; an item with fewer words is one phrase as a whole.
WINDOW = 13
#: Every so many text positions the suffix array keeps its value.
SAMPLE_RATE = 8
SHARD_SYMBOLS = 1 << 20

SPAN_SCHEMA = "doc_id long, text_hash long, start int, end int, n_words int, items array<long>"


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of an integer sequence by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Ranks and access over integers below 2**bits, level by level (a wavelet matrix)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.levels: list[tuple[np.ndarray, int]] = []
        v = values.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            one = (v >> b) & 1
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.levels.append((before, self.n - int(before[-1])))
            v = np.concatenate([v[one == 0], v[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for (before, zeros), b in zip(self.levels, range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            l1, h1 = before[lo], before[hi]
            lo = np.where(one, zeros + l1, lo - l1)
            hi = np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        at, out = at.copy(), np.zeros_like(at)
        for before, zeros in self.levels:
            one = before[at + 1] - before[at]
            out = out * 2 + one
            at = np.where(one == 1, zeros + before[at], at - before[at])
        return out


class FMIndex:
    """Count and locate for integer patterns over one integer text (symbols from 1; 0 separates)."""

    def __init__(self, text: np.ndarray, sigma: int, sample_rate: int = SAMPLE_RATE):
        t = np.concatenate([text.astype(np.int64) + 1, [0]])  # a unique least sentinel
        sa = suffix_array(t)
        self.n = len(t)
        self.bwt = WaveletTree(t[sa - 1], max(1, int(sigma + 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 2))])
        marked = sa % sample_rate == 0
        self.sampled = np.concatenate([[0], np.cumsum(marked)])
        self.positions = sa[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows, right-aligned in ``patterns``), stepped together."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - j) & (lo < hi))
            if not len(live):
                continue
            c = patterns[live, j].astype(np.int64) + 1
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to sampled ones."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.sampled[r + 1] > self.sampled[r]
            done = todo[hit]
            out[done] = self.positions[self.sampled[rows[done]]] + steps[done]
            todo = todo[~hit]
            r = rows[todo]
            c = self.bwt.access(r)
            rows[todo] = self.first[c] + self.bwt.rank(c, r)
            steps[todo] += 1
        return out


def _null_first(item: int | None) -> tuple[bool, int]:
    return item is not None, item or 0


class Phrases:
    """The test set: word hashes as symbols, and all windows as right-aligned patterns."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        found: dict[bytes, list[int]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        hashes = [h for _, h in word_hashes(texts)] if items else []
        for (item, _), h in zip(items, hashes):
            n = min(window, len(h))
            for k in range(len(h) - n + 1) if n else ():
                found.setdefault(h[k : k + n].tobytes(), []).append(item)
        keys = [np.frombuffer(k, np.uint64) for k in found]
        self.vocabulary = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.zeros((len(keys), window), np.int32)
        for row, k in zip(self.patterns, keys):
            row[window - len(k) :] = np.searchsorted(self.vocabulary, k) + 1
        self.items = [sorted(set(v), key=_null_first) for v in found.values()]
        self.shortest = int(self.lengths.min()) if keys else window
        bits = 18
        self.mask = np.uint64((1 << bits) - 1)
        self.slot = np.zeros(1 << bits, np.int32)  # symbol by the low bits of the hash
        low = (self.vocabulary & self.mask).astype(np.int64)
        self.slot[low] = np.arange(1, len(low) + 1)
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[np.flatnonzero(np.bincount(low, minlength=1 << bits) > 1)] = True
        self.padded = np.concatenate([np.zeros(1, np.uint64), self.vocabulary])

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 0 for words outside the test set."""
        low = (h & self.mask).astype(np.int64)
        out = self.slot[low]
        out[self.padded[out] != h] = 0
        again = np.flatnonzero(self.crowded[low])
        if len(again):
            at = np.minimum(np.searchsorted(self.vocabulary, h[again]), len(self.vocabulary) - 1)
            out[again] = np.where(self.vocabulary[at] == h[again], at + 1, 0)
        return out


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its lower-cased words), one row after the other."""
    for lo, hi, buf, off in W.blocks(column, lower=True):
        s, e = W.split(buf)
        h = W.span_hash(buf, s, e)
        cut = W.rows_of(off, s)
        for r in range(hi - lo):
            yield lo + r, h[cut[r] : cut[r + 1]]


def shard_hits(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, position) of every occurrence in one shard's symbols."""
    index = FMIndex(symbols, len(phrases.vocabulary))
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, index.locate(rows)


def _kept_runs(sym: np.ndarray, cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of test words, at least so long, that stay within one row."""
    flag = np.zeros(len(sym) + 1, np.int8)
    flag[:-1] = sym > 0
    edge = np.flatnonzero(np.diff(flag, prepend=0))
    s, e = edge[0::2], edge[1::2]
    inner = cut[1:-1]
    inner = inner[(inner > 0) & (inner < len(sym))]
    inner = np.unique(inner[(flag[inner - 1] == 1) & (flag[inner] == 1)]) if len(inner) else inner
    s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
    keep = e - s >= least
    return s[keep], e[keep]


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """Removal spans of test phrases in ``docs`` (doc_id, text): doc_id, start, end, n_words, items.

    start and end are character offsets of the text; items are the benchmark item_ids touched, in
    order. Words are compared lower-cased, so case, white space and punctuation between words do not
    matter. Overlapping or touching spans are one. A null or empty text has no spans; a row with a null
    doc_id is searched and reported with a null doc_id; repeated rows each give their spans, as do rows
    that share a doc_id. Texts of any length are searched whole. Items that are null or have no words are no
    phrase; repeated items count once for each item_id, and a null item_id is an id of its own, the first. Without phrases, or without documents, the result is empty. Further
    columns of either table are ignored. The test set is gathered to the driver and sent to each task:
    its size does not grow with the corpus.
    """
    return _spans(docs, benchmark, window, shard_symbols).drop("text_hash")


def _spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """The spans, with text_hash: xxhash64 of the text that holds them."""
    spark = docs.sparkSession
    items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator()]
    phrases = Phrases(sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), window)
    if not len(phrases.lengths):
        return spark.createDataFrame([], SPAN_SCHEMA)
    shared = spark.sparkContext.broadcast(phrases)
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("items", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        pieces: list[np.ndarray] = []
        runs: list[tuple] = []  # row number, first word, length
        kept: dict[int, tuple] = {}  # the rows with runs: doc_id, hash, text
        size = row = 0

        def flush() -> pa.RecordBatch | None:
            nonlocal pieces, runs, kept, size
            if not runs:
                return None
            which, at = shard_hits(np.concatenate(pieces), p)
            base = np.array([r[2] for r in runs])
            starts = np.cumsum(base + 1) - (base + 1)
            of = np.searchsorted(starts, at, side="right") - 1
            found: dict[int, list[tuple[int, int, int]]] = {}
            for w, o, q in zip(which.tolist(), of.tolist(), (at - starts[of]).tolist()):
                r = runs[o]
                found.setdefault(r[0], []).append((r[1] + q, r[1] + q + int(p.lengths[w]), w))
            rows = []
            for r in sorted(found):
                doc, key, text = kept[r]
                chars = W.word_spans(text)
                merged: list[list] = []
                for s, e, w in sorted(found[r]):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                        merged[-1][2].update(p.items[w])
                    else:
                        merged.append([s, e, set(p.items[w])])
                rows += [(doc, key, chars[s][0], chars[e - 1][1], e - s, sorted(i, key=_null_first)) for s, e, i in merged]
            pieces, runs, kept, size = [], [], {}, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out) if rows else None

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, buf, off in W.blocks(texts, lower=True):
                s, e = W.split(buf)
                sym = p.symbols(W.span_hash(buf, s, e))
                cut = W.rows_of(off, s)
                a, b = _kept_runs(sym, cut, p.shortest)
                at = np.searchsorted(cut, a, side="right") - 1
                for i, j, r in zip(a.tolist(), b.tolist(), at.tolist()):
                    pieces += [sym[i:j], np.zeros(1, sym.dtype)]
                    runs.append((row + lo + r, i - int(cut[r]), j - i))
                    if row + lo + r not in kept:
                        kept[row + lo + r] = ids[lo + r].as_py(), batch.column(2)[lo + r].as_py(), texts[lo + r].as_py()
                    size += j - i + 1
                if size >= shard_symbols and (r := flush()):
                    yield r
            row += len(ids)
        if r := flush():
            yield r

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(W.lean(search), SPAN_SCHEMA)


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The columns of documents with the spans (doc_id, text_hash, start, end) cut out, and ``_cut``: whether any were.

    A text that loses a span gets a new n_chars. Spans apply to the rows with their doc_id and text.
    Spans are broadcast where their size is small. Beyond that only the documents with spans are shuffled, if
    their ids can be broadcast to tell them from the others, else all.
    """
    spark = docs.sparkSession
    by = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    by = materialise(spark, by, "spans").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    if is_small(by):
        joined = base.join(F.broadcast(by), on, "left")
    elif is_small(ids := by.select("_id").distinct()):
        here = F.col("doc_id").eqNullSafe(F.col("_id"))
        joined = base.join(F.broadcast(ids), here, "left_semi").join(by, on, "left")
        joined = joined.unionByName(base.join(F.broadcast(ids), here, "left_anti"), allowMissingColumns=True)
    else:
        joined = base.join(by, on, "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        out = F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, begin - acc["at"]))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("_spans", zero, step, lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))))
    cut = F.col("_spans").isNotNull()
    joined = joined.withColumn("_text", F.when(cut, done).otherwise(F.col("text")))
    n = F.when(cut, F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", F.col("_text").alias("text"), "lang", "source", n.alias("n_chars"), cut.alias("_cut"))


def remove_phrases(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the spans that ``find_spans`` finds, with n_chars made to fit; columns of documents.

    Rows without spans come out as they are, null and empty texts too; so does an empty table. Rows with a null
    doc_id are matched by their text.
    """
    return cut_spans(docs, _spans(docs, benchmark)).drop("_cut")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark spans in all documents."""
    return find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
