"""Line dedup by content-defined line chunks.

A text is re-broken into lines by a rolling hash of ``SEED_WORDS`` words: a line begins wherever that hash
is the least (the last one of equals) among all that lie within some window of ``MIN_WORDS`` words. Whether
a line begins depends on the window alone, so every window that stands in two places has its line begin at the
same word of both, whatever surrounds it. The windows that choose one line begin follow each other; the bytes
that they span are a chunk. Chunks whose line's first words occur more than once in the corpus meet by those
words and are compared byte by byte, whole chunks first, then the windows of different ones. Every window that
stands earlier in the corpus is removed, so no choice of a partner can lose a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.llm.decontaminate import cut_spans
from marlstone.llm.neardup import by_bucket, packed_by_bucket
from marlstone.session import materialise, release, sized_broadcast, table

#: Words that a repeated run has at least, to be removed.
MIN_WORDS = 50
#: Words at the begin of a line that are looked up.
SEED_WORDS = 14

SEEDS = (("doc", np.int64), ("word", np.int32))
#: Of an occurrence of a chunk: document, text, first word and character, and which chunk of its packed row it is.
PLACES = (("doc", np.int64), ("text_hash", np.int64), ("word", np.int32), ("char", np.int32), ("chunk", np.int32))
CHUNKS = "bucket int, " + ", ".join(f"{n} binary" for n, _ in PLACES) + ", sizes binary, bytes binary"
RUNS = "doc long, text_hash long, word int, word_end int, start int, end int, first_doc long"
#: Seeds, or bytes of chunks, that a task packs together.
PACK, PACK_BYTES = 1_000_000, 32 << 20


def window_lines(buf: np.ndarray, off: np.ndarray, n_words: int) -> tuple[np.ndarray, ...]:
    """Of a block of texts: where words start and end, words before each row, the windows' first words and
    the line begins that they choose, and the hash of each line's first words."""
    s, e = W.split(buf, W.NOT_SPACE)
    cut = W.rows_of(off, s)
    seed = min(SEED_WORDS, n_words)
    if len(s) < n_words:
        return s, e, cut, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = W.span_hash(buf, s[: len(s) - seed + 1], e[seed - 1 :])
    n = n_words - seed + 1
    first = np.arange(len(h) - n + 1)
    first = first[first + n_words <= cut[np.searchsorted(cut, first, side="right")]]  # windows within one row
    seen = np.lib.stride_tricks.sliding_window_view(h, n)[first]
    return s, e, cut, first, first + n - 1 - np.argmin(seen[:, ::-1], axis=1), h


def planes(raw: bytes, size: int) -> bytes:
    """Values of ``size`` bytes as all their first bytes, all their second ones and so on: the empty high bytes compress."""
    return np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes()


def values(raw: bytes, kind: type) -> np.ndarray:
    """What ``planes`` packed."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _seeds(buckets: int, n_words: int):
    """Rows (bucket, keys, places ...) of the lines' first words, packed."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), *((n, pa.binary()) for n, _ in SEEDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = packed_by_bucket(buckets, *(np.concatenate(c) for c in zip(*held)))
            held.clear()
            rows = [(b, key, *(planes(c, np.dtype(t).itemsize) for c, (_, t) in zip(place, SEEDS))) for b, key, *place in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _hi, buf, off in W.blocks(batch.column(1), lower=False):
                _s, _e, cut, _first, line, h = window_lines(buf, off, n_words)
                at = np.unique(line)
                row = np.searchsorted(cut, at, side="right") - 1
                held.append((h[at], ids[lo + row], (at - cut[row]).astype(np.int32)))
                size += len(at)
                if size >= PACK:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _repeated_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the seeds that occur more than once; the rows come bucket by bucket."""
    for _, rows in by_bucket(batches):
        key = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        if len(order):
            columns = [np.concatenate([values(r[i], t) for r in rows])[order] for i, (_, t) in enumerate(SEEDS, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n for n, _ in SEEDS])


def _chunks(buckets: int, n_words: int):
    """Rows ``CHUNKS`` of the wanted lines' chunks; equal chunks of a packed row are sent once."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n, _ in PLACES), ("sizes", pa.binary()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number: dict[bytes, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            key, *places = (np.concatenate(c) for c in zip(*held))
            bodies = list(number)
            rows = []
            for b, _keys, *place in packed_by_bucket(buckets, key, *places):
                kinds, chunk = np.unique(np.frombuffer(place[-1], np.int32), return_inverse=True)
                place[-1] = chunk.astype(np.int32).tobytes()
                mine = [bodies[k] for k in kinds.tolist()]
                packed = [planes(c, np.dtype(t).itemsize) for c, (_, t) in zip(place, PLACES)]
                rows.append((b, *packed, np.array(list(map(len, mine)), np.int32).tobytes(), b"".join(mine)))
            held.clear()
            number.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            ids, hashes, wants = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, buf, off in W.blocks(batch.column(2), lower=False):
                s, e, cut, first, line, h = window_lines(buf, off, n_words)
                wanted = np.zeros(len(s) + 1, bool)
                for r in range(lo, hi):
                    wanted[cut[r - lo] + wants[r].values.to_numpy()] = True
                keep = wanted[line]
                first, line = first[keep], line[keep]
                if not len(first):
                    continue
                begin = np.flatnonzero(np.insert(line[1:] != line[:-1], 0, True))
                a, b = first[begin], first[np.append(begin[1:], len(first)) - 1] + n_words
                row = np.searchsorted(cut, a, side="right") - 1
                chars = np.insert(np.cumsum((buf & 0xC0) != 0x80), 0, 0)
                raw = buf.tobytes()
                which = np.empty(len(a), np.int32)
                for k, (i, j) in enumerate(zip(s[a].tolist(), e[b - 1].tolist())):
                    body = raw[i:j]
                    which[k] = number.setdefault(body, len(number))
                    size += j - i
                held.append((h[line[begin]], ids[lo + row], hashes[lo + row], (a - cut[row]).astype(np.int32), (chars[s[a]] - chars[off[row]]).astype(np.int32), which))
                if size >= PACK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _classes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte span, the same for equal bytes: hashes propose, the bytes decide."""
    h = W.span_hash(buf, begin, end)
    order = np.argsort(h, kind="stable")
    head = np.insert(h[order[1:]] != h[order[:-1]], 0, True)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(head) - 1
    raw = buf.tobytes()
    b, e = begin.tolist(), end.tolist()
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]].tolist()
    others: dict[tuple[int, bytes], int] = {}
    for i, f in zip(order.tolist(), first):
        if i != f and raw[b[i] : e[i]] != raw[b[f] : e[f]]:
            number[i] = others.setdefault((int(number[i]), raw[b[i] : e[i]]), len(h) + len(others))
    return number


def _spans_of(mask: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of true windows within a chunk."""
    start = mask.copy()
    start[1:] &= ~mask[:-1] | (chunk[1:] != chunk[:-1])
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | (chunk[1:] != chunk[:-1])
    return np.flatnonzero(start), np.flatnonzero(stop)


def _compare(n_words: int):
    """Runs of windows that stand earlier in the corpus, ``RUNS``, from the chunks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            number: dict[bytes, int] = {}
            which = []
            for r in rows:
                ends = np.cumsum(np.frombuffer(r[5], np.int32)).tolist()
                mine = [number.setdefault(r[6][i:j], len(number)) for i, j in zip([0, *ends], ends)]
                which.append(np.array(mine)[values(r[4], np.int32)])
            doc, text, word, char = (np.concatenate([values(r[i], t) for r in rows]) for i, (_, t) in enumerate(PLACES[:4]))
            chunk = np.concatenate(which)
            order = np.lexsort((word, text, doc, chunk))  # a chunk's occurrences, the first of them ahead
            doc, text, word, char, chunk = (x[order] for x in (doc, text, word, char, chunk))
            new = np.insert((chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (word[1:] != word[:-1]), 0, True)
            doc, text, word, char, chunk = (x[new] for x in (doc, text, word, char, chunk))  # repeated rows give equal places: one document
            at = np.searchsorted(chunk, np.arange(len(number)))
            count = np.diff(np.append(at, len(chunk)))
            buf = np.frombuffer(b"\n".join(number) + b"\n", np.uint8)
            s, e = W.split(buf, W.NOT_SPACE)
            cut = np.searchsorted(s, np.insert(np.cumsum([len(x) + 1 for x in number]), 0, 0))
            n = np.diff(cut) - n_words + 1  # windows of each chunk
            of = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin, end = s[cut[of] + j], e[cut[of] + j + n_words - 1]
            kind = _classes(buf, begin, end)
            first = at[of]
            order = np.lexsort((word[first] + j, text[first], doc[first], kind))
            head = np.insert(kind[order[1:]] != kind[order[:-1]], 0, True)
            group = np.cumsum(head) - 1
            lead = np.empty(len(of), np.int64)  # for each window the one that stands first
            lead[order] = order[np.flatnonzero(head)[group]]
            total = np.empty(len(of), np.int64)
            total[order] = np.add.reduceat(count[of[order]], np.flatnonzero(head))[group] if len(order) else 0
            chars = np.insert(np.cumsum((buf & 0xC0) != 0x80), 0, 0)
            base = chars[s[cut[:-1]]]
            earlier = doc[at[of[lead]]]
            out: list[tuple[np.ndarray, ...]] = []
            for mask, later in ((total > 1, True), ((total > 1) & (lead != np.arange(len(of))), False)):
                a, b = _spans_of(mask, of)
                if not len(a):
                    continue
                c = of[a]
                least = np.minimum.reduceat(np.append(earlier, earlier[-1:]), np.stack([a, b + 1], axis=1).ravel())[::2]
                times = count[c] - 1 if later else np.ones(len(c), np.int64)  # the later occurrences, or the first of the chunk
                run_ = np.repeat(np.arange(len(c)), times)
                place = at[c][run_] + later + np.arange(len(run_)) - np.repeat(np.cumsum(times) - times, times)
                a, b, c = a[run_], b[run_], c[run_]
                out.append((doc[place], text[place], word[place] + j[a], word[place] + j[b] + n_words, char[place] + chars[begin[a]] - base[c], char[place] + chars[end[b]] - base[c], least[run_]))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in RUNS.split(", ")])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the runs of a text that overlap or adjoin in words."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    c = {n: whole.column(n).to_numpy() for n in whole.column_names}
    order = np.lexsort((c["word"], c["text_hash"], c["doc"]))
    doc, text, word, word_end, start, end, first = (c[n][order] for n in whole.column_names)
    group = np.cumsum(np.insert((doc[1:] != doc[:-1]) | (text[1:] != text[:-1]), 0, False)) << 32
    reach = np.maximum.accumulate(group + word_end)
    s = np.flatnonzero(np.insert(group[1:] + word[1:] > reach[:-1], 0, True))
    n = (np.maximum.reduceat(word_end, s) - word[s]).astype(np.int32)
    columns = (doc[s], text[s], start[s], np.maximum.reduceat(end, s), n, np.minimum.reduceat(first, s))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "text_hash", "start", "end", "n_words", "first_doc_id"])


def _spans(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, text_hash (of the text that holds the span), start, end, n_words, first_doc_id."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts

    def placed(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    seeds = texts.mapInArrow(W.lean(_seeds(buckets, n_words)), "bucket int, keys binary, " + ", ".join(f"{n} binary" for n, _ in SEEDS))
    found = placed(seeds).mapInArrow(W.lean(_repeated_seeds), "doc long, word int")
    wants = materialise(spark, found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("word").alias("wants")), "wants")
    affected = texts.join(sized_broadcast(wants.select("doc_id")), "doc_id", "left_semi").join(sized_broadcast(wants), "doc_id")
    affected = affected.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "wants")
    runs = placed(affected.mapInArrow(W.lean(_chunks(buckets, n_words)), CHUNKS)).mapInArrow(W.lean(_compare(n_words)), RUNS)
    spans = runs.repartition("doc").mapInArrow(W.lean(_merge), "doc_id long, text_hash long, start int, end int, n_words int, first_doc_id long")
    spans = materialise(spark, spans, "repeats")
    release(wants)
    return spans


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of ``docs`` to remove: doc_id, start, end, n_words, first_doc_id.

    A span is a union of windows of ``min_words`` words that each stand earlier in the corpus with the same
    bytes; all of these are found, in texts of any length. start and end are character offsets, first_doc_id the
    least document that one of the windows first stands in. The first occurrence, by doc_id, then text and place,
    is not in the result and stays. Repeats within one document count as well; of a block that is
    one line again and again the first line stays. Null and empty texts and rows with a
    null doc_id have no spans. Repeated rows (equal doc_id and text) count as one document and do not
    repeat each other; rows that share a doc_id but not the text each have the spans found in them, as those of
    two documents in the order of their texts' hashes. Further columns are ignored; an empty table gives an
    empty result.
    """
    return _spans(docs, min_words).select("doc_id", "start", "end", "n_words", "first_doc_id")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated spans (see ``repeated_spans``), with n_chars made to fit; columns of documents.

    A text that nothing but white space is left of goes, since all of it stands in other documents.
    Rows without spans, also null, empty and wordless ones, come out as they are; so does an empty table.
    """
    found = cut_spans(docs, _spans(docs, min_words))
    return found.where(~F.col("_cut") | F.col("text").rlike(r"\S")).drop("_cut")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans over all documents."""
    return repeated_spans(table(spark, sf_dir, "documents"))
