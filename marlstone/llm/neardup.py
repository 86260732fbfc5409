"""Near-duplicate groups by SetSketch registers.

Every element (a hash of ``SHINGLE`` consecutive words) drives a Poisson process whose points fall on
random registers; a register holds the least point it got, truncated to the exponential grid
``base ** -k``. Registers are therefore mergeable minima, equal with a probability that grows with the
Jaccard similarity. Bands of registers give candidate buckets; inside a bucket the documents are
compared through the joint likelihood of the registers, and likely pairs are verified on the
exact shingle sets, in rounds, for as long as their documents are not connected. Groups are the connected
components of the verified pairs, the same as if every likely pair had been verified.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import materialise, release, sized_broadcast, table

SHINGLE = 3
REGISTERS = 128
BASE = 1.02
RATE = 20.0
#: Bands of ROWS registers: all registers in order, then some in another order. A pair at the threshold shares one with
#: a probability of about 0.93. A register of unlike documents is equal by chance in 0.5 % of cases, so shorter bands
#: would bring together too many of them at scale.
BANDS, ROWS = 48, 4
BANDED = np.concatenate([np.arange(REGISTERS), np.random.default_rng(1).permutation(REGISTERS)])[: BANDS * ROWS]
#: Verified pairs have at least this Jaccard similarity of their shingle sets.
THRESHOLD = 0.5
#: A pair is verified if its estimate is above the threshold less this (about three standard errors); one that is above
#: the threshold and this is taken for alike until it is verified.
SLACK = 0.13
#: Pairs below that, of each class of a bucket, that the first round verifies.
QUOTA = 2

#: Elements whose points are made, and pairs that are verified, at a time: what a task holds does not grow with its batches.
ELEMENTS, PAIRS = 1 << 15, 500
_POINTS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of k words; a shorter text has one, the whole of it; no words, none."""
    if len(h) >= k or not len(h):
        return W.roll(h, k)
    return W.roll(h, len(h)) ^ np.uint64(len(h))


def _minima(h: np.ndarray, row: np.ndarray, limit: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Least point of each register (rows by m) among points up to the row's limit; inf where none."""
    best = np.full(n_rows * m, np.inf)
    scale = -1.0 / (m * RATE)
    for lo in range(0, len(h), ELEMENTS):
        hh, r = h[lo : lo + ELEMENTS], row[lo : lo + ELEMENTS]
        x, first = np.zeros(len(hh)), 0
        while len(hh):
            steps = (np.arange(first + 1, first + 1 + _POINTS, dtype=np.uint64) * _STEP)[None, :]
            z = W.mix(hh[:, None] + steps)
            u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            points = x[:, None] + np.cumsum(np.log(u) * scale, axis=1)
            keep = points <= limit[r][:, None]
            at = r[:, None] * m + (z & np.uint64(m - 1)).astype(np.int64)
            np.minimum.at(best, at[keep], points[keep])
            alive = keep[:, -1]
            hh, r, x, first = hh[alive], r[alive], points[alive, -1], first + _POINTS
    return best.reshape(n_rows, m)


def sketch_rows(h: np.ndarray, cut: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of each row's elements h[cut[r]:cut[r+1]]; rows without elements are 0.

    Only points up to a limit are made, and the limit doubles for rows with an empty register: the
    result is exactly that of all points.
    """
    n = np.diff(cut)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    limit = (np.log(m) + 3.0) / (RATE * np.maximum(n, 1))
    best = _minima(h, row, limit, rows, m)
    open_ = np.flatnonzero(np.isinf(best).any(axis=1) & (n > 0))
    while len(open_):
        limit[open_] *= 2
        number = np.full(rows, -1)
        number[open_] = np.arange(len(open_))
        mine = number[row] >= 0
        best[open_] = _minima(h[mine], number[row[mine]], limit[open_], len(open_), m)
        open_ = open_[np.isinf(best[open_]).any(axis=1)]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(best) / np.log(BASE))
    k[n == 0] = 0
    return np.clip(k, 0, 65535).astype(np.uint16)


def cardinality(k: np.ndarray) -> np.ndarray:
    """Estimated number of distinct elements of each row of registers."""
    m = k.shape[1]
    return m * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(BASE ** -k.astype(np.float64), axis=1))


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of row pairs that maximises the likelihood of the registers' order."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    low, high = np.zeros(len(u)), top.copy()

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    g = (5**0.5 - 1) / 2
    for _ in range(22):  # golden section: the likelihood is concave in j
        x1, x2 = high - g * (high - low), low + g * (high - low)
        up = likelihood(x1) < likelihood(x2)
        low, high = np.where(up, x1, low), np.where(up, high, x2)
    return (low + high) / 2


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fp (128-bit digest of the word sequence), sketch; rows without a doc_id or words are left out."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for lo, hi, buf, off in W.blocks(batch.column(1), lower=True):
                s, e = W.split(buf)
                h = W.span_hash(buf, s, e)
                cut = W.rows_of(off, s)
                parts = [shingles(h[cut[r] : cut[r + 1]]) for r in range(hi - lo)]
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                k = sketch_rows(np.concatenate(parts), at)
                for r in range(hi - lo):
                    if len(parts[r]):
                        fp = hashlib.blake2b(h[cut[r] : cut[r + 1]].tobytes(), digest_size=16).digest()
                        rows.append((ids[lo + r], fp, k[r].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(W.lean(run), "doc_id long, fp binary, sketch binary")


def packed_by_bucket(buckets: int, keys: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows (bucket, packed columns ...) for the buckets that the keys' high bits choose."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    end = np.append(start[1:], len(order))
    columns = tuple(c[order] for c in (keys, *columns))
    return [(int(b), *(c[s:e].tobytes() for c in columns)) for b, s, e in zip(found, start, end)]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """The rows of each bucket in turn, of rows sorted by bucket; only one bucket is held at a time."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield now, rows


def collisions(reps: DataFrame, buckets: int) -> DataFrame:
    """(bucket_id, rep) of every band bucket with two or more members, buckets of equal members once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("reps", pa.binary())])
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held])
            k = np.concatenate([s for _, s in held]).reshape(len(ids), -1)[:, BANDED]
            packed = np.ascontiguousarray(k).reshape(len(ids), BANDS, ROWS).view(np.uint64)[:, :, 0]
            keys = W.mix(packed + np.arange(BANDS, dtype=np.uint64)[None, :] * _STEP).ravel()
            rows = packed_by_bucket(buckets, keys, np.repeat(ids, BANDS))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)))
            if sum(len(i) for i, _ in held) >= 50_000:
                yield flush()
        if held:
            yield flush()

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            key = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            rep = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
            order = np.argsort(key, kind="stable")
            key, rep = key[order], rep[order]
            same = key[1:] == key[:-1]
            hit = np.append(same, False) | np.insert(same, 0, False)
            key, rep = key[hit], rep[hit]
            if not len(key):
                continue
            group = np.cumsum(np.insert(key[1:] != key[:-1], 0, False))
            start = np.flatnonzero(np.insert(group[1:] != group[:-1], 0, True))
            name = W.mix(np.add.reduceat(W.mix(rep.astype(np.uint64)), start))[group]  # of the set of members
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rep)], names=["bucket_id", "rep"])

    spreaded = reps.select("rep", "sketch").mapInArrow(W.lean(spread), "bucket int, keys binary, reps binary")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spreaded.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(W.lean(collide), "bucket_id long, rep long").dropDuplicates(["bucket_id", "rep"])


def reaches(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, t: float) -> np.ndarray:
    """Whether the joint estimate is at least t: the likelihood is concave in j, so whether it still rises at t."""
    v = 1 - u
    rate, log = (BASE - 1) / BASE, np.log(BASE)
    ok = t < np.minimum(u / v, v / u)
    x, y = np.where(ok, u - v * t, 0.5), np.where(ok, v - u * t, 0.5)
    px, py = -np.log1p(-x * rate) / log, -np.log1p(-y * rate) / log
    dx, dy = v * rate / ((1 - x * rate) * log), u * rate / ((1 - y * rate) * log)
    return ok & (same * (dx + dy) / (1 - px - py) >= more * dx / px + less * dy / py)


def _counted(flags: np.ndarray) -> np.ndarray:
    """How many of each row's flags are set."""
    if flags.shape[1] != REGISTERS:
        return flags.sum(axis=1)
    eight = np.add.reduce(flags.view(np.uint64), axis=1)
    return ((eight * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def bucket_links(rep: np.ndarray, label: np.ndarray, k: np.ndarray, failed: list, least: float, strike: float, quota: int | None) -> tuple[list[np.ndarray], bool]:
    """Pairs (a, b) of one bucket's members with unlike labels to verify, and whether any were put off.

    Pairs of an estimate of at least ``strike`` make one class of their two at once, and what has one class
    is not compared. Of other pairs of at least ``least`` each class gives ``quota`` (None: all), likest
    first, and then rests. Pairs in ``failed`` (of each member, those that it was verified to be unlike, or
    None) are left out. If nothing was put off, all pairs of unlike labels have been told apart or given.
    """
    _, cls = np.unique(label, return_inverse=True)
    size = np.bincount(cls)
    order = np.lexsort((rep, cls, size[cls]))  # small classes look for others, so the largest need not
    rep, cls, k = rep[order], cls[order], np.ascontiguousarray(k[order])
    n, count = cardinality(k), len(rep)
    root, spent, rests = np.arange(len(size)), np.zeros(len(size), np.int64), np.zeros(len(size), bool)
    out: list[np.ndarray] = []
    off = False
    for i in range(count - 1):
        c = cls[i]
        if (cls[i + 1 :] == c).all():
            break
        if rests[c]:
            off = True
            continue
        lo, step = i + 1, 64
        while lo < count:
            who = lo + np.flatnonzero(cls[lo : lo + step] != c)
            lo, step = lo + step, min(4 * step, 4096)
            if not len(who):
                continue
            kk = k[who]
            more, less = _counted(k[i] > kk), _counted(k[i] < kk)
            same, u = k.shape[1] - more - less, n[i] / (n[i] + n[who])
            hit = reaches(more, less, same, u, least)
            if failed[order[i]] is not None:
                hit &= ~np.isin(rep[who], failed[order[i]])
            if not hit.any():
                continue
            who, more, less, same, u = (x[hit] for x in (who, more, less, same, u))
            strong = reaches(more, less, same, u, strike)
            if strong.any():
                joined, first = np.unique(cls[who[strong]], return_index=True)
                out.append(np.stack([np.full(len(first), rep[i]), rep[who[strong][first]]], axis=1))
                root[joined] = c
                cls = root[cls]
                root[:] = np.arange(len(root))
                off |= np.count_nonzero(cls == c) > 2
                weak = cls[who] != c
                who, same = who[weak], same[weak]
            if quota is not None:
                room = quota - spent[c]
                off |= len(who) > room
                who = who[np.argsort(-same, kind="stable")[:room]]
                spent[c] += len(who)
                rests[c] = spent[c] >= quota
            if len(who):
                out.append(np.stack([np.full(len(who), rep[i]), rep[who]], axis=1))
            if rests[c]:
                off |= lo < count
                break
    return out, off


def links(members: DataFrame, least: float, strike: float, quota: int | None) -> DataFrame:
    """Distinct (a, b, open): the pairs of ``bucket_links`` with a < b, and as open the buckets that put off any.

    members: bucket_id, rep, sketch, and if they are there label (else rep) and failed (array of reps). A task
    holds one bucket at a time.
    """
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        found: list[np.ndarray] = []
        opened: list[int] = []

        def close() -> None:
            rep, label, k, failed = (x[0] if len(held) == 1 else sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*held))
            held.clear()
            pairs, off = bucket_links(rep, label, k, failed, least, strike, quota)
            found.extend(pairs)
            if off:
                opened.append(now)

        def flush() -> pa.RecordBatch:
            ab = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            columns = ab.min(axis=1).tolist() + [None] * len(opened), ab.max(axis=1).tolist() + [None] * len(opened), [None] * len(ab) + opened
            found.clear()
            opened.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kind)

        for batch in batches:
            if not len(batch):
                continue
            bucket, rep, label = (batch.column(c).to_numpy() for c in (0, 1, 3))
            k = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(rep), -1)
            failed = [None if x is None else np.array(x, np.int64) for x in batch.column(4).to_pylist()]
            starts = np.flatnonzero(np.insert(bucket[1:] != bucket[:-1], 0, True))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
                if held and bucket[s] != now:
                    close()
                now = int(bucket[s])
                held.append((rep[s:e], label[s:e], k[s:e], failed[s:e]))
            if found or opened:
                yield flush()
        if held:
            close()
        if found or opened:
            yield flush()

    columns = ["bucket_id", "rep", "sketch"]
    columns += ["label" if "label" in members.columns else F.col("rep").alias("label")]
    columns += ["failed" if "failed" in members.columns else F.lit(None).cast("array<long>").alias("failed")]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes are not few tasks
    placed = members.select(*columns).repartition(parts, "bucket_id").sortWithinPartitions("bucket_id", "rep")
    return placed.mapInArrow(W.lean(run), "a long, b long, open long").distinct()


def likely_pairs(members: DataFrame, least: float, strike: float | None = None) -> DataFrame:
    """Distinct (a, b) of members of a bucket (bucket_id, rep, sketch) whose joint estimate is at least ``least``.

    Members that reach ``strike`` (``least`` if None) with another are one with it, so a bucket of n copies costs n
    comparisons and gives n - 1 pairs.
    """
    return links(members, least, least if strike is None else strike, None).where("a is not null").select("a", "b")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two sets of distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (a, b) whose texts have shingle sets of at least this Jaccard similarity."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), PAIRS):
                batch = whole.slice(first, PAIRS)
                sets: list[list[np.ndarray]] = []
                for column in (batch.column(2), batch.column(3)):
                    mine = []
                    for lo, hi, buf, off in W.blocks(column, lower=True):
                        s, e = W.split(buf)
                        h = W.span_hash(buf, s, e)
                        cut = W.rows_of(off, s)
                        mine += [np.unique(shingles(h[cut[r] : cut[r + 1]])) for r in range(hi - lo)]
                    sets.append(mine)
                keep = pa.array([jaccard(x, y) >= threshold for x, y in zip(*sets)], pa.bool_())
                yield batch.select([0, 1]).filter(keep)

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = materialise(spark, ids, "ids")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(sized_broadcast(ids), "id", "left_semi")
    texts = materialise(spark, texts, "texts")
    two = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = two.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    out = materialise(spark, two.select("a", "b", "ta", "tb").mapInArrow(W.lean(run), "a long, b long").distinct(), "verified")
    release(ids, texts)
    return out


def roots_of(found: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(node, root): the components of all pairs of members of a bucket (bucket_id, rep) that are estimated at ``threshold``
    less SLACK or more and verified.

    What is in one component already need not be compared, so each round verifies a few pairs of each class of a
    bucket (``bucket_links``), and the next one goes on between the components that are still apart, with sixteen
    times as many. Rounds end when no bucket has put off any pair: the pairs grow with the members and not
    with their square, and no link is lost.
    """
    spark = docs.sparkSession
    sketch = reps.select("rep", "sketch")
    members, texts, roots, failed, quota = found, docs, None, None, QUOTA
    while True:
        rows = members.join(sketch, "rep")
        if failed is not None:
            rows = rows.join(failed.groupBy("rep").agg(F.collect_set("other").alias("failed")), "rep", "left")
        rows = materialise(spark, links(rows, threshold - SLACK, threshold + SLACK, quota), "links")
        pairs = rows.where("a is not null").select("a", "b")
        alike = verified(pairs, texts, threshold)
        if roots is None or not alike.isEmpty():
            edges = alike if roots is None else alike.unionByName(roots.where("node <> root").toDF("a", "b"))
            roots = components(spark, edges)
        open_ = rows.where("open is not null").select(F.col("open").alias("bucket_id"))
        here = found.join(sized_broadcast(open_), "bucket_id", "left_semi").join(roots.toDF("rep", "label"), "rep", "left")
        here = materialise(spark, here.select("bucket_id", "rep", F.coalesce("label", "rep").alias("label")), "open")
        apart = here.groupBy("bucket_id").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket_id")
        members = materialise(spark, here.join(apart, "bucket_id", "left_semi"), "members")
        unlike = pairs.join(alike, ["a", "b"], "left_anti")
        both = unlike.toDF("rep", "other").unionByName(unlike.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        failed = materialise(spark, both if failed is None else failed.unionByName(both), "failed")
        release(rows, alike, here)
        if members.isEmpty():
            return roots
        ids = materialise(spark, members.select(F.col("rep").alias("doc_id")).distinct(), "ids")  # later rounds have no others
        texts = materialise(spark, texts.select("doc_id", "text").join(sized_broadcast(ids), "doc_id", "left_semi"), "texts")
        quota *= 16


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge: the least node of each component, by alternating large and small stars."""
    edges = materialise(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("b", "m").union(least.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        old, edges = edges, materialise(spark, small, "edges")
        release(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.union(edges.select("b", "b").distinct()).toDF("node", "root")
        before = now


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of all documents that have exact or near copies; group_id is the group's least doc_id.

    Documents whose word sequences are equal are one from the start; others are grouped through pairs
    with a Jaccard similarity of word shingles of at least ``threshold`` (one that just reaches it counts). Null,
    empty and wordless texts resemble nothing; rows with a null doc_id are left out; texts of any length are
    taken whole. Repeated rows and rows that share a doc_id count as one document (with the shingles of any of
    them); a document alone is not in the result. Further columns are ignored; an empty table gives an empty result.
    """
    return _groups(docs, materialise(docs.sparkSession, sketch_documents(docs), "sketches"), threshold)


def _groups(docs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    reps = sketches.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialise(spark, reps, "reps")
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(spark, collisions(reps, buckets), "collisions")
    roots = roots_of(found, reps, docs, threshold)
    grouped = reps.select("fp", "rep", "n").join(roots.toDF("rep", "root"), "rep", "left").where("n > 1 or root is not null")
    grouped = grouped.select("fp", F.coalesce("root", "rep").alias("group_id"))
    out = sketches.select("doc_id", "fp").join(grouped, "fp").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    out = materialise(spark, out, "groups")
    release(reps, found)
    return out


def uncut_groups(docs: DataFrame, uncut: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id): near-duplicates among the rows of ``uncut`` that ``docs`` holds with passages cut out.

    A document counts if its text is what is left of an uncut one under its doc_id, its words being some of that
    one's in their order; group_id is the least of those in the group. Only texts of groups are compared so.
    """
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    sketches = materialise(spark, sketch_documents(uncut).join(ids, "doc_id", "left_semi"), "sketches")
    groups = _groups(uncut, sketches, threshold)
    members = sized_broadcast(groups.select("doc_id"))
    left = docs.select("doc_id", "text").where("text is not null").join(members, "doc_id", "left_semi")
    whole = uncut.select("doc_id", F.col("text").alias("whole")).where("text is not null").join(members, "doc_id", "left_semi")

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text, before in zip(b.column(1), b.column(2)):
                rest = (m.group() for m in re.finditer(r"\S+", before.as_py() or ""))
                keep.append(all(m.group() in rest for m in re.finditer(r"\S+", text.as_py() or "")))
            yield b.select([0]).filter(pa.array(keep, pa.bool_()))

    cut = F.col("text") != F.col("whole")  # texts that nothing was cut out of need no comparison: they go as nulls
    both = left.join(whole, "doc_id").select("doc_id", *(F.when(cut, F.col(c)).alias(c) for c in ("text", "whole")))
    same = both.mapInArrow(W.lean(derived), "doc_id long").distinct()
    held = materialise(spark, groups.join(same, "doc_id", "left_semi"), "held")
    release(sketches, groups)
    least = held.groupBy("group_id").agg(F.min("doc_id").alias("least"))
    return held.join(least, "group_id").select("doc_id", F.col("least").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, uncut: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id; columns of documents.

    ``uncut`` (doc_id, text) may hold the texts before passages were cut out of them: what is left of a near copy
    resembles nothing, so documents whose uncut texts are near-duplicates (see ``uncut_groups``) are then
    of one group too. Rows with a null doc_id, and null, empty and wordless texts stay as they are, unless their
    uncut text has a group. Of repeated rows (equal doc_id and text) one stays. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    sketches = materialise(spark, sketch_documents(docs), "sketches")
    groups = _groups(docs, sketches, threshold)
    if uncut is not None:
        pairs = groups.unionByName(uncut_groups(docs, uncut, threshold))
        groups = components(spark, pairs.toDF("a", "b")).toDF("doc_id", "group_id")
    drop = materialise(spark, groups.where("doc_id <> group_id").select("doc_id"), "drop")
    repeated = materialise(spark, sketches.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    release(sketches)
    kept = base.join(sized_broadcast(drop), "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept
    ids = sized_broadcast(repeated)
    once = kept.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(ids, "doc_id", "left_anti").unionByName(once)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over all documents."""
    return near_groups(table(spark, sf_dir, "documents"))
