"""HTML extraction by inferred wrappers.

The pages of a host are token streams of tags and texts. Repeated blocks of a stream fold into repeated
groups; then the distinct streams of the host are aligned one after the other with the wrapper so far,
and what does not match becomes an optional group. The wrapper is a union-free regular expression of
tags, text slots, optional and repeated groups. Every page is then parsed by its host's wrapper, and
the slots whose text is the same on all pages of the host are template, not content.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import materialise, sized_broadcast, table

#: A token is "#" (text), a tag, ("+", items) a repeated group or ("?", items) an optional one.
Item = str | tuple
#: Shards that the streams of a host are folded and aligned in before what they found is put together.
SHARDS = 64

_TWICE = np.uint64(0xD6E8FEB86659FD93)

_TOKEN = re.compile(r"<!--.*?-->|<!.*?>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([\w-]+)", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def tokens(page: str | None) -> tuple[list[str], list[str]]:
    """The page's tags (lower-case name, first class or id) and "#", and the unescaped texts in order."""
    tags: list[str] = []
    texts: list[str] = []
    for m in _TOKEN.finditer(page or ""):
        if m[3]:
            name = m[2] + m[3].lower()
            mark = _CLASS.search(m[4]) if m[4] and not m[2] else None
            tags.append(f"{name}.{mark[1]}" if mark else name)
        elif m[5]:
            text = " ".join(html.unescape(m[5]).split())
            if text and tags and tags[-1] == "#":
                texts[-1] += " " + text
            elif text:
                tags.append("#")
                texts.append(text)
    return tags, texts


def _squares(a: np.ndarray) -> tuple[int, np.ndarray]:
    """The least period of a block that stands twice in a row, and where such blocks begin; 0 if there are none.

    A text alone is no such block. While no block of a period below p stands twice in a row, the
    L-gram at the begin of one of period p (L <= p <= 2 L) next occurs exactly p further on: an occurrence
    in between would make a shorter one. So the distances of consecutive equal L-grams, L a power of two, hold
    all least periods, in n log n steps for each L.
    """
    n, size = len(a), 1
    h = W.mix(a.astype(np.uint64) + np.uint64(1))
    while 2 * size <= n:
        order = np.argsort(h, kind="stable")
        near = h[order[1:]] == h[order[:-1]]
        at, step = order[:-1][near], np.diff(order)[near]
        ok = (step >= size) & (step <= 2 * size) & (at + 2 * step <= n)
        at, step = at[ok], step[ok]
        ok = (h[at + step - size] == h[at + 2 * step - size]) & ((step > 1) | (a[at] > 0))
        if ok.any():
            period = int(step[ok].min())
            return period, np.sort(at[ok & (step == period)])
        h = W.mix(h[:-size] * _TWICE + h[size:]) if 2 * size <= n else h
        size *= 2
    return 0, np.empty(0, np.int64)


def fold(items: list[Item]) -> list[Item]:
    """Consecutive equal blocks become one repeated group, the shortest blocks first; a text alone does not repeat."""
    number: dict[Item | tuple, int] = {"#": 0}
    a = np.array([number.setdefault(x, len(number)) for x in items], np.int64)
    while True:
        period, begins = _squares(a)
        if not period:
            return items
        differs = np.append(np.flatnonzero(a[period:] != a[:-period]), len(a) - period)
        out: list[Item] = []
        ids: list[np.ndarray] = []
        end = 0
        for i, run in zip(begins.tolist(), (differs[np.searchsorted(differs, begins)] - begins).tolist()):
            if i < end:
                continue
            block = tuple(items[i : i + period])
            group = block[0] if period == 1 and block[0][0] == "+" else ("+", block)
            out += items[end:i]
            ids += [a[end:i], np.array([number.setdefault(group, len(number))])]
            out.append(group)
            end = i + (1 + run // period) * period
        items, a = out + items[end:], np.concatenate([*ids, a[end:]])


def _same(a: Item, b: Item) -> bool:
    """Whether two items can be one: equal tokens, or groups that share their first token."""
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return a[0] == b[0] and _first(a) == _first(b)


def _first(a: Item) -> str:
    while not isinstance(a, str):
        a = a[1][0]
    return a


def _optional(items: list[Item]) -> list[Item]:
    """The items of one side as optional groups; those that are optional already stay alone."""
    out: list[Item] = []
    run: list[Item] = []
    for x in [*items, ("?", ())]:
        if isinstance(x, tuple) and x[0] == "?":
            if run:
                out.append(("?", tuple(run)))
                run = []
            if x[1]:
                out.append(x)
        else:
            run.append(x)
    return out


def merge(w: list[Item], p: list[Item]) -> list[Item]:
    """The wrapper that both token lists match: common items aligned, the rest optional, single
    blocks next to a repeated group of the same block part of it.

    Equal ends and, between them, items that stand once on either side in the same order (a longest
    increasing sequence of them) are fixed; the stretches between are aligned in a table, whatever their length.
    """
    out: list[Item] = []
    i = j = 0
    for a, b in [*_anchors(w, p), (len(w), len(p))]:
        out += _align(w[i:a], p[j:b])
        out += w[a : a + 1]
        i, j = a + 1, b + 1
    return fold(out)


def _anchors(w: list[Item], p: list[Item]) -> list[tuple[int, int]]:
    """Pairs of places of equal items, in order, that an alignment keeps: equal ends, between them what is
    unique by the eight items that begin there, then what is unique alone."""
    n = min(len(w), len(p))
    head = next((k for k in range(n) if w[k] != p[k]), n)
    tail = next((k for k in range(n - head) if w[-1 - k] != p[-1 - k]), n - head)
    fixed = [(k, k) for k in range(head)]
    for width in (8, 1):
        i = j = 0
        found: list[tuple[int, int]] = []
        for a, b in [*fixed, (len(w) - tail, len(p) - tail)]:
            if a > i and b > j:
                found += _unique(w, p, range(i, a), range(j, b), width)
            i, j = a + 1, b + 1
        fixed = sorted({*fixed, *found})
    return fixed + [(len(w) - k, len(p) - k) for k in range(tail, 0, -1)]


def _unique(w: list[Item], p: list[Item], at: range, on: range, width: int) -> list[tuple[int, int]]:
    """A longest increasing sequence of the pairs of places whose next ``width`` items are unique on both sides."""
    once = []
    for side, places in ((w, at), (p, on)):
        keys = [tuple(side[k : min(k + width, places.stop)]) for k in places]
        count = Counter(keys)
        once.append({x: k for x, k in zip(keys, places) if count[x] == 1})
    both = sorted((k, once[1][x]) for x, k in once[0].items() if x in once[1])
    tops: list[int] = []  # least last place of an increasing sequence of each length
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(both):
        place = bisect.bisect_left(tops, j)
        back.append(last[place - 1] if place else -1)
        tops[place : place + 1], last[place : place + 1] = [j], [k]
    chain = []
    k = last[-1] if last else -1
    while k >= 0:
        chain.append(both[k])
        k = back[k]
    return chain[::-1]


def _align(w: list[Item], p: list[Item]) -> list[Item]:
    """The alignment of two stretches by a table of the most common items."""
    n, m = len(w), len(p)

    def width(seq: list[Item], i: int, group: tuple) -> int:
        k = len(group[1])
        return k if tuple(seq[i : i + k]) == group[1] else 0

    score = np.zeros((n + 1, m + 1), np.int32)
    step = np.zeros((n + 1, m + 1), np.uint8)  # which of "wp=og", from 1
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            best, how = 0, 0
            if i < n and score[i + 1, j] >= best:
                best, how = score[i + 1, j], 1
            if j < m and score[i, j + 1] > best or not how and j < m:
                best, how = score[i, j + 1], 2
            if i < n and j < m:
                x = w[i]
                inner = x[1][0] if isinstance(x, tuple) and x[0] == "?" and len(x[1]) == 1 else x
                if _same(inner, p[j]) and score[i + 1, j + 1] + 2 > best:
                    best, how = score[i + 1, j + 1] + 2, 3
                if isinstance(x, tuple) and x[0] == "?" and len(x[1]) > 1 and tuple(p[j : j + len(x[1])]) == x[1]:
                    k = len(x[1])
                    if score[i + 1, j + k] + 2 * k > best:
                        best, how = score[i + 1, j + k] + 2 * k, 4
                if isinstance(inner, tuple) and inner[0] == "+" and (k := width(p, j, inner)) and score[i + 1, j + k] + 2 * k > best:
                    best, how = score[i + 1, j + k] + 2 * k, 4
                if isinstance(p[j], tuple) and p[j][0] == "+" and (k := width(w, i, p[j])) and score[i + k, j + 1] + 2 * k > best:
                    best, how = score[i + k, j + 1] + 2 * k, 5
            score[i, j] = best
            step[i, j] = how
    out: list[Item] = []
    loose: dict[str, list[Item]] = {"w": [], "p": []}
    i = j = 0
    while step[i, j]:
        how = " wp=og"[step[i, j]]
        a, b = i + (how != "p"), j + (how != "w")
        if how == "g":
            a = i + len(p[j][1])
        elif how == "o":
            x = w[i]
            b = j + len((x[1][0] if x[0] == "?" and len(x[1]) == 1 else x)[1])
        if how in "wp":
            loose[how].append(w[i] if how == "w" else p[j])
        else:
            out += _optional(loose["w"]) + _optional(loose["p"])
            loose = {"w": [], "p": []}
            if how == "=":
                x = w[i]
                q = isinstance(x, tuple) and x[0] == "?"
                inner = x[1][0] if q else x
                one = inner if isinstance(inner, str) else (inner[0], tuple(fold(merge(list(inner[1]), list(p[j][1])))))
                out.append(("?", (one,)) if q else one)
            else:
                out.append(w[i] if how == "o" else p[j])
        i, j = a, b
    return out + _optional(loose["w"]) + _optional(loose["p"])


def infer(streams: list[list[Item]]) -> tuple[list[Item], list[int]]:
    """The wrapper of folded token lists, taken in order, and the numbers of those that shaped it.

    A merged wrapper that does not match all of these is given up for one that has the new list as an
    optional group of its own.
    """
    wrapper, shaped = list(streams[0]) if streams else [], [0] if streams else []
    program = Program(wrapper)
    for k, s in enumerate(streams):
        if program.match(s) is None:
            merged = merge(wrapper, s)
            program = Program(merged)
            if any(program.match(streams[j]) is None for j in (k, *shaped)):
                merged = side_by_side(wrapper, s)
                program = Program(merged)
            wrapper = merged
            shaped.append(k)
    for k, s in enumerate(streams):  # those that a later merge lost; a wrapper side by side loses none
        if program.match(s) is None:
            wrapper = side_by_side(wrapper, s)
            program = Program(wrapper)
            shaped.append(k)
    return wrapper, sorted(set(shaped))


def side_by_side(w: list[Item], p: list[Item]) -> list[Item]:
    """A wrapper that surely matches both: the common ends, and between them either middle as optional."""
    head = 0
    while head < min(len(w), len(p)) and isinstance(w[head], str) and w[head] == p[head]:
        head += 1
    tail = 0
    while tail < min(len(w), len(p)) - head and isinstance(w[-1 - tail], str) and w[-1 - tail] == p[-1 - tail]:
        tail += 1
    middle = [("?", tuple(x)) for x in (w[head : len(w) - tail], p[head : len(p) - tail]) if x]
    return w[:head] + middle + (w[len(w) - tail :] if tail else [])


class Program:
    """A wrapper as states: ("c", token, slot), ("s", first choice, other one), ("r", group, path, after it) or ("e",)."""

    def __init__(self, wrapper: list[Item]):
        self.ops: list[tuple] = []
        todo: list[tuple] = [("items", tuple(wrapper), "")]
        while todo:  # groups are put on a stack, so that the depth of a page does not matter
            kind, x, path = todo.pop()
            if kind == "items":
                todo += [("item", y, f"{path}{k}") for k, y in reversed(list(enumerate(x)))]
            elif kind == "split":
                self.ops[x] = ("s", x + 1, len(self.ops))
            elif kind == "again":
                self.ops.append(("s", x, len(self.ops) + 1))
                self.ops[x] = (*self.ops[x][:3], len(self.ops) - 1)
            elif isinstance(x, str):
                self.ops.append(("c", x, path if x == "#" else None))
            elif x[0] == "?":
                todo += [("split", len(self.ops), ""), ("items", x[1], path + ".")]
                self.ops.append(())
            else:
                todo += [("again", len(self.ops), ""), ("items", x[1], path + ".")]
                self.ops.append(("r", x, path + "."))
        self.ops.append(("e",))

    def match(self, stream: list[Item]) -> list[str] | None:
        """The slot of each text of the stream, or None. Optional groups and repetitions are taken if they can be.

        A state that failed at a place is not tried there again, so the steps are at most states times tokens.
        """
        ops, n = self.ops, len(stream)
        names: list[str] = []
        failed: set[int] = set()
        other: list[tuple[int, int, int]] = [(0, 0, 0)]
        while other:
            at, i, size = other.pop()
            del names[size:]
            while True:
                op = ops[at]
                kind = op[0]
                if kind == "c":
                    if i < n and stream[i] == op[1]:
                        if op[2] is not None:
                            names.append(op[2])
                        at, i = at + 1, i + 1
                        continue
                    break
                if kind == "s":
                    key = at * (n + 1) + i
                    if key in failed:
                        break
                    failed.add(key)
                    other.append((op[2], i, len(names)))
                    at = op[1]
                elif kind == "r":
                    x = stream[i] if i < n else ""
                    if not isinstance(x, str) and x[0] == "+":
                        inner = match(list(op[1][1]), list(x[1]))
                        if inner is not None:
                            other.append((at + 1, i, len(names)))
                            names.extend(op[2] + k for k in inner)
                            at, i = op[3], i + 1
                            continue
                    at += 1
                elif i == n:
                    return names
                else:
                    break
        return None


def match(wrapper: list[Item], stream: list[Item]) -> list[str] | None:
    """The slot of each text of the stream (in order), or None if the wrapper does not match.

    The stream may be folded or not. A slot is named by the item numbers on the way to it.
    """
    return Program(wrapper).match(stream)


def to_json(items) -> str:
    return json.dumps(items, separators=(",", ":"))


def from_json(text: str) -> list[Item]:
    def tupled(x):
        return x if isinstance(x, str) else (x[0], tuple(map(tupled, x[1])))

    return [tupled(x) for x in json.loads(text)]


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) that matches all distinct token streams of the host.

    The streams of a host are taken in shards, the commonest first; those that shaped a shard's wrapper shape
    the host's, and any that it then does not match join them, until it matches all.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[str, str], int] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = host, to_json(fold(list(tokens(page)[0])))
                count[key] = count.get(key, 0) + 1
            if count:
                hosts, streams = zip(*count)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(streams, pa.string()), pa.array(list(count.values()))], names=["host", "stream", "n"])

    def shape(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["n", "stream"], ascending=[False, True], kind="stable")
        return ordered.iloc[infer([from_json(s) for s in ordered["stream"]])[1]][["host", "stream", "n"]]

    def induce(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["n", "stream"], ascending=[False, True], kind="stable")
        wrapper, _ = infer([from_json(s) for s in ordered["stream"]])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [to_json(wrapper)]})

    def unmatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Program] = {}
        for b in batches:
            hosts, streams, n, wrappers = (c.to_pylist() for c in b.columns)
            for w in set(wrappers) - set(known):
                known[w] = Program(from_json(w))
            yield b.select([0, 1, 2]).filter(pa.array([known[w].match(from_json(s)) is None for s, w in zip(streams, wrappers)], pa.bool_()))

    spark = pages.sparkSession
    kind = "host string, stream string, n long"
    distinct = pages.select("host", "html").mapInArrow(shapes, kind).groupBy("host", "stream").agg(F.sum("n").alias("n"))
    distinct = materialise(spark, distinct, "streams")
    shaping = distinct.groupBy("host", F.pmod(F.xxhash64("stream"), F.lit(SHARDS)).alias("shard")).applyInPandas(shape, kind)
    shaping = materialise(spark, shaping, "shaping")
    while True:
        wrappers = materialise(spark, shaping.groupBy("host").applyInPandas(induce, "host string, wrapper string"), "wrappers")
        left = distinct.join(sized_broadcast(wrappers), "host").select("host", "stream", "n", "wrapper").mapInArrow(unmatched, kind)
        left = materialise(spark, left, "unmatched")
        if left.isEmpty():
            return wrappers
        more = left.groupBy("host", F.pmod(F.xxhash64("stream"), F.lit(SHARDS)).alias("shard")).applyInPandas(shape, kind)
        shaping = materialise(spark, shaping.unionByName(more), "shaping")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, host, text, slots, matched of every row of ``pages`` (page_id, url, html).

    text joins, by newlines, the texts in slots that differ between the host's pages; of a host with
    one page all texts are content. slots counts the page's texts. Malformed HTML is taken as the tags that it
    has. A null or unparsable url is the host ''; a null html is an empty page, with an empty text. Repeated
    rows and null page_ids are extracted like any other; further columns are ignored; an empty table
    gives an empty result. Pages of any length are taken whole, in time that grows with their tags. Of streams that are
    equally common the first in order shapes the wrapper first. A wrapper matches all pages that it was inferred from,
    so matched is true; where streams cannot be aligned they are optional groups side by side, in which no slot
    stands on all pages and nothing is taken for template.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    wrappers = host_wrappers(base)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Program] = {}
        for b in batches:
            slots, texts, ok = [], [], []
            for page, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if wrapper not in known:
                    known[wrapper] = Program(from_json(wrapper))
                tags, found = tokens(page)
                names = known[wrapper].match(tags)
                ok.append(names is not None)
                slots.append(names if names is not None else [f"text{k}" for k in range(len(found))])
                texts.append(found)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slots, kind), pa.array(texts, kind), pa.array(ok, pa.bool_())], names=["page_id", "host", "slot", "texts", "matched"])

    joined = base.join(sized_broadcast(wrappers), "host").select("page_id", "host", "html", "wrapper")
    parsed = materialise(spark, joined.mapInArrow(parse, "page_id long, host string, slot array<string>, texts array<string>, matched boolean"), "parsed")
    hashed = parsed.where("matched").select("host", F.explode(F.arrays_zip("slot", F.transform("texts", lambda t: F.xxhash64(t)).alias("h"))).alias("s"), F.lit(1).alias("one"))
    hashed = hashed.select("host", F.col("s.slot").alias("slot"), F.col("s.h").alias("h"))
    pages_of = parsed.where("matched").groupBy("host").agg(F.count("*").alias("pages"))
    fixed = hashed.groupBy("host", "slot").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n")).where("a = b").join(pages_of, "host").where("pages > 1 and n >= pages")
    fixed = materialise(spark, fixed.groupBy("host").agg(F.collect_set("slot").alias("fixed")), "fixed")
    out = parsed.join(sized_broadcast(fixed), "host", "left")
    both = F.arrays_zip("slot", "texts")
    content = F.transform(F.filter(both, lambda s: F.col("fixed").isNull() | ~F.array_contains("fixed", s["slot"])), lambda s: s["texts"])
    text = F.when(F.col("matched"), F.array_join(content, "\n")).otherwise(F.array_join("texts", "\n"))
    return out.select("page_id", "host", text.alias("text"), F.size("texts").alias("slots"), "matched")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of all pages."""
    return extract(table(spark, sf_dir, "pages"))
