"""URL filters by a path-template tree.

Each host has a tree of path segments. A segment that is a number, a hash, a date or the like is a wildcard
from the start; where the children of a node have few pages each, the segment is variable too, and the children
with too few labels to be rejected by themselves become one wildcard. Sibling branches whose labels do not
differ statistically are merged. The leaves are the host's templates, and a template is rejected if its
smoothed share of good labels is low.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import materialise, release, sized_broadcast, table

#: A node with two children or more that have fewer pages than this in the mean has a variable segment.
MEAN_PAGES = 4.0
#: Siblings are merged if their label shares differ by fewer standard errors.
MERGE_Z = 1.96
#: Weight, in labels, of the mean over all labelled pages in a template's purity.
PRIOR = 8.0
#: Least purity of a template that is kept, as a part of the mean over all labelled pages.
MIN_PURITY = 0.6

_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)(?:\?([^#]*))?"
_VARIABLE = r"^(?:\d+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,}|\d{4}-\d{2}-\d{2}|(?:[^-_]+[-_]){3,}[^-_]+)$"


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, segs: the host without leading www., the path's segments with evident variables as
    wildcards, and the sorted names of the query's parameters as a last segment "?a&b"."""
    url = F.coalesce("url", F.lit(""))
    path = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")
    stem = F.transform(path, lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).when(F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", "").rlike(_VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z0-9]{1,5})$", 1))).otherwise(s))
    query = F.regexp_extract(url, _URL, 3)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))))
    segs = F.when(F.size(names) > 0, F.concat(stem, F.array(F.concat(F.lit("?"), F.array_join(names, "&"))))).otherwise(stem)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.", "")
    return pages.select("page_id", host.alias("host"), segs.alias("segs"))


def branching(paths: DataFrame, above: int) -> int | None:
    """The least level above the given one on which two templates of a host differ after equal segments."""
    order = Window.partitionBy("host").orderBy("template")
    pair = paths.select("host", "template").distinct().select("template", F.lag("template").over(order).alias("before")).where("before is not null")
    differs = F.filter(F.sequence(F.lit(1), F.least(F.size("template"), F.size("before"))), lambda k: F.element_at("template", k.cast("int")) != F.element_at("before", k.cast("int")))
    level = F.when(F.least(F.size("template"), F.size("before")) > 0, F.try_element_at(differs, F.lit(1)))
    return pair.select(level.alias("level")).where(F.col("level") > above).agg(F.min("level")).first()[0]


def generalise(paths: DataFrame, mean_pages: float = MEAN_PAGES) -> DataFrame:
    """host, segs, n, good, bad, template: variable segments, level by level, become wildcards.

    A node's segment is variable if it has two children or more with less than ``mean_pages`` pages in the
    mean. Its children with so many labels that bad ones alone could reject them stay, to be merged by their
    labels. Only levels on which a host's templates branch are visited: on others there is nothing to generalise,
    so that the length of a single URL costs nothing.

    ``paths`` has one row for each host and list of segments, with its counts.
    """
    spark = paths.sparkSession
    now = materialise(spark, paths.withColumn("template", F.col("segs")), "paths")
    k = branching(now, 0)
    while k is not None:
        here = now.where(F.size("template") >= k)
        node = F.slice("template", 1, k - 1)
        children = here.groupBy("host", node.alias("node"), F.element_at("template", k).alias("child")).agg(F.sum("n").alias("n"), F.sum(F.col("good") + F.col("bad")).alias("labelled"))
        variable = children.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") > 1) & (F.col("n") < mean_pages * F.col("kinds"))).select("host", "node")
        small = children.where(F.col("labelled") <= PRIOR * (1 / MIN_PURITY - 1)).join(variable, ["host", "node"]).select("host", "node", "child", F.lit(True).alias("wild"))
        keys = now.withColumn("node", F.when(F.size("template") >= k, node)).withColumn("child", F.when(F.size("template") >= k, F.element_at("template", k)))
        marked = keys.join(small, ["host", "node", "child"], "left")
        wild = F.concat(node, F.array(F.lit("*")), F.slice("template", k + 1, F.size("template")))
        after = marked.withColumn("template", F.when(F.col("wild") & ~F.col("child").startswith("?"), wild).otherwise(F.col("template"))).drop("node", "child", "wild")
        before, now = now, materialise(spark, after, "paths")
        release(before)
        k = branching(now, k)
    return now


class Node:
    """A branch: its counts (pages, good, bad) at and below it, its children, and the templates that end in it."""

    def __init__(self):
        self.n = self.good = self.bad = 0
        self.children: dict[str, Node] = {}
        self.templates: list[tuple[str, ...]] = []

    def add(self, segs: tuple[str, ...], n: int, good: int, bad: int) -> None:
        at = self
        for name in (*segs, None):
            at.n, at.good, at.bad = at.n + n, at.good + good, at.bad + bad
            if name is not None:
                at = at.children.setdefault(name, Node())
        at.templates.append(segs)


def similar(good_a: int, bad_a: int, good_b: int, bad_b: int) -> bool:
    """Whether two branches' label shares differ by at most MERGE_Z standard errors; one without labels is
    like others without labels only, so that it is never rejected for the labels of another."""
    na, nb = good_a + bad_a, good_b + bad_b
    if not na or not nb:
        return na == nb
    m = (good_a + good_b) / (na + nb)
    return abs(good_a / na - good_b / nb) <= MERGE_Z * (m * (1 - m) * (1 / na + 1 / nb)) ** 0.5


def leaves(root: Node) -> list[tuple[str, list[tuple[str, ...]], int, int, int]]:
    """(merged template, templates in it, pages, good, bad) of a tree.

    Siblings are taken with the most pages first (ties by name) and join the first group that they are similar
    to; leaves of a group become one template with a wildcard, deeper branches are merged child by child.
    """
    out = []
    todo: list[tuple[list[Node], tuple[str, ...]]] = [([root], ())]  # merged branches stay lists of nodes: nothing is copied
    while todo:
        nodes, path = todo.pop()
        kids: dict[str, list[Node]] = {}
        for node in nodes:
            for name, child in node.children.items():
                kids.setdefault(name, []).append(child)
        count = {name: tuple(sum(getattr(c, a) for c in cs) for a in ("n", "good", "bad")) for name, cs in kids.items()}
        own = [t for node in nodes for t in node.templates]
        if own:
            n, good, bad = (sum(getattr(x, a) for x in nodes) - sum(c[i] for c in count.values()) for i, a in enumerate(("n", "good", "bad")))
            out.append(("/" + "/".join(path), own, n, good, bad))
        groups: list[tuple[list[str], list[Node], list[int]]] = []
        for name in sorted(kids, key=lambda x: (-count[x][0], x)):
            _, good, bad = count[name]
            for names, members, labels in groups:
                if (name[0] == "?") == (names[0][0] == "?") and similar(*labels, good, bad):
                    names.append(name)
                    members += kids[name]
                    labels[:] = labels[0] + good, labels[1] + bad
                    break
            else:
                groups.append(([name], list(kids[name]), [good, bad]))
        for names, members, _ in groups:
            todo.append((members, (*path, names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}")))
    return out


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, segs, merged, pages, labelled, purity, keep of every distinct path; see ``filter_urls``."""
    spark = pages.sparkSession
    marks = labels.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    parts = url_parts(pages).join(marks, "page_id", "left")
    counts = parts.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
    paths = generalise(counts)
    good, bad = paths.agg(F.sum("good"), F.sum("bad")).first()
    mean = (good or 0) / ((good or 0) + (bad or 0)) if (good or 0) + (bad or 0) else 1.0

    def induce(group: pd.DataFrame) -> pd.DataFrame:
        root = Node()
        for t, n, g, b in zip(group["template"], group["n"], group["good"], group["bad"]):
            root.add(tuple(t), int(n), int(g), int(b))
        rows = [(group["host"].iloc[0], list(t), m, n, g, b) for m, ts, n, g, b in leaves(root) for t in ts]
        return pd.DataFrame(rows, columns=["host", "template", "merged", "pages", "good", "bad"])

    small = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    tree = small.groupBy("host").applyInPandas(induce, "host string, template array<string>, merged string, pages long, good long, bad long")
    purity = (F.col("good") + PRIOR * mean) / (F.col("good") + F.col("bad") + PRIOR)
    tree = tree.select("host", "template", "merged", "pages", (F.col("good") + F.col("bad")).alias("labelled"), purity.alias("purity"), (purity >= MIN_PURITY * mean).alias("keep"))
    return materialise(spark, paths.select("host", "segs", "template").join(tree, ["host", "template"]).drop("template"), "templates")


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, template, pages, labelled, purity, keep of every row of ``pages`` (page_id, url).

    ``labels`` has page_id and good (1 or 0); null ones are no labels, of several the worst counts.
    purity is (good + PRIOR * mean) / (labelled + PRIOR) over the template, with mean over all
    labelled pages; keep tells purity >= MIN_PURITY * mean, so that a template without labels is kept. Null,
    empty and unparsable urls are the template "/" of host ''. Repeated rows count as often as they
    stand, null page_ids have no label; further columns are ignored; an empty table gives an empty result.
    Urls of any length are taken whole. Branches with equally many pages are taken by name; a purity that just
    reaches the bound is kept.
    """
    found = templates(pages, labels).withColumnsRenamed({"host": "_h", "segs": "_s"})
    parts = url_parts(pages)
    joined = parts.join(sized_broadcast(found), (F.col("host") == F.col("_h")) & (F.col("segs") == F.col("_s")))
    return joined.select("page_id", "host", F.col("merged").alias("template"), "pages", "labelled", "purity", "keep")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, good of pages that show a labelled document: the last number in a page's path is the doc_id."""
    doc = F.regexp_extract(F.coalesce("url", F.lit("")), r"/(\d{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    shown = pages.where("page_id is not null").select("page_id", doc.alias("doc")).where("doc <> ''").select("page_id", F.col("doc").cast("long").alias("doc_id"))
    return shown.join(marks, "doc_id").select("page_id", "good")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of all pages and whether they are kept."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")))
