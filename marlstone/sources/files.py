"""Source trees as tables: scan, classification, decoding, modules."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIPPED = tuple("target dist build node_modules __pycache__ __generated generated .idea .gradle .git".split())
LANGUAGES = {
    "vue": "vue", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "gradle": "groovy", "kt": "kotlin", "kts": "kotlin", "java": "java",
    "properties": "properties", "toml": "toml", "yml": "yaml", "yaml": "yaml", "htm": "html", "html": "html", "mdx": "markdown", "md": "markdown",
}
LIBRARY = r"(-adapter|-model-shared|-facade)$"


def excluded_names(text: str) -> set[str]:
    """Names in an exclusion list: one a line, # begins a comment."""
    return {n for line in text.splitlines() if (n := re.sub("#.*", "", line).strip())}


def discover(root: str, excluded: set[str] = frozenset()) -> list[str]:
    """Repository roots below a folder (they hold .git), sorted, without those nested in another."""
    found: list[str] = []
    for folder, names, _ in os.walk(root):
        if ".git" in names:
            if os.path.basename(folder) not in excluded:
                found.append(folder)
            names.clear()
        names[:] = sorted(n for n in names if n not in SKIPPED)
    return sorted(found)


def valid_revision(sha: Column | str) -> Column:
    """Whether a string is a full commit id."""
    sha = F.col(sha) if isinstance(sha, str) else sha
    return F.coalesce(sha.rlike("^[0-9a-f]{40,64}$"), F.lit(False))


def language_of(path: Column) -> Column:
    """Language by the lower-cased suffix, null for unknown ones."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return names[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def _listed(spark: SparkSession, roots: dict[str, str], *columns: str) -> DataFrame:
    """repository, path (relative) and ``columns`` of all files; content is read only if it is one of these.

    A file that cannot be read is left out where content is asked for.
    """
    out = None
    for name, root in sorted(roots.items()):
        root = os.path.abspath(root) if "://" not in root else root.rstrip("/")
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
        relative = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root) + 2})")
        rows = raw.select(F.lit(name).alias("repository"), relative.alias("path"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def _wanted(paths: DataFrame) -> DataFrame:
    """Files of known languages outside skipped folders, with their language, less translated documentation trees."""
    known = paths.withColumn("language", language_of(F.col("path"))).where("language is not null")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    known = known.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))))
    site = paths.where(F.col("path").rlike(r"^docusaurus\.config\.(js|ts)$")).select("repository").distinct()
    return known.join(known.where(F.col("path").startswith("i18n/")).join(site, "repository").select("repository", "path"), ["repository", "path"], "left_anti")


def paths(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """repository, path, wanted of all files below the roots, without reading them; wanted: ``scan`` should give it."""
    if not roots:
        return spark.createDataFrame([], "repository string, path string, wanted boolean")
    every = _listed(spark, roots)
    return every.join(_wanted(every).select("repository", "path", F.lit(True).alias("wanted")), ["repository", "path"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def scan(spark: SparkSession, roots: dict[str, str], commits: dict[str, str] | None = None) -> DataFrame:
    """repository, path (relative), language, text, commit_sha of the known files of the repositories (name to folder).

    Bytes that are no UTF-8 become replacement characters; translated documentation trees of a Docusaurus site
    are left out. Commits that are not given are read from the folders' .git.
    """
    if not roots:
        return spark.createDataFrame([], "repository string, path string, text string, commit_sha string, language string")
    shas = [(n, (commits or {}).get(n) or head_commit(r)) for n, r in sorted(roots.items())]
    known = _wanted(_listed(spark, roots, "content")).withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")
    return known.join(F.broadcast(spark.createDataFrame(shas, "repository string, commit_sha string")), "repository")  # a row for each root


def head_commit(root: str) -> str:
    """The commit id that a local repository's HEAD names, directly, by a ref or by a packed one; '' if there is none."""
    git = os.path.join(root, ".git")
    try:
        if os.path.isfile(git):  # a worktree: the file names the folder
            with open(git) as f:
                git = os.path.join(root, f.read().partition("gitdir:")[2].strip())
        with open(os.path.join(git, "HEAD")) as f:
            head = f.read().strip()
        if not head.startswith("ref:"):
            return head
        ref = head[4:].strip()
        homes = [git]
        if os.path.isfile(os.path.join(git, "commondir")):
            with open(os.path.join(git, "commondir")) as f:
                homes.append(os.path.join(git, f.read().strip()))
        for home in homes:
            if os.path.isfile(os.path.join(home, ref)):
                with open(os.path.join(home, ref)) as f:
                    return f.read().strip()
            if os.path.isfile(os.path.join(home, "packed-refs")):
                with open(os.path.join(home, "packed-refs")) as f:
                    for line in f:
                        sha, _, name = line.strip().partition(" ")
                        if name == ref:
                            return sha
    except OSError:
        pass
    return ""


def modules(files: DataFrame) -> DataFrame:
    """repository, folder, module: declared modules of settings files whose folder holds a file, every
    folder with a build script, and the root."""
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    every = files.select("repository", F.explode(_ancestors(folder)).alias("folder")).distinct()
    settings = files.where(F.col("path").rlike(r"^settings\.gradle(\.kts)?$"))
    declared = settings.select("repository", F.explode(F.regexp_extract_all("text", F.lit(r"""["'](:[\w:-]+)["']"""), F.lit(1))).alias("module"))
    declared = declared.withColumn("folder", F.translate(F.regexp_replace("module", "^:", ""), ":", "/")).join(every, ["repository", "folder"]).withColumn("rank", F.lit(0))
    built = files.where(F.col("path").rlike(r"(^|/)build\.gradle[^/]*$")).select("repository", folder.alias("folder"))
    roots = files.select("repository", F.lit("").alias("folder")).distinct()
    rest = built.unionByName(roots).distinct().withColumn("module", F.concat(F.lit(":"), F.translate("folder", "/", ":"))).withColumn("rank", F.lit(1))
    best = Window.partitionBy("repository", "folder").orderBy("rank", "module")
    return declared.select("repository", "folder", "module", "rank").unionByName(rest.select("repository", "folder", "module", "rank")).withColumn("n", F.row_number().over(best)).where("n = 1").select("repository", "folder", "module")


def _ancestors(folder: Column) -> Column:
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def with_module(files: DataFrame, found: DataFrame) -> DataFrame:
    """The files with the module of their deepest ancestor that is one, and its folder."""
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    up = files.select("repository", "path", F.explode(F.array_distinct(_ancestors(folder))).alias("folder"))
    deepest = up.join(found, ["repository", "folder"]).groupBy("repository", "path").agg(F.max_by(F.struct("module", F.col("folder").alias("module_folder")), F.length("folder")).alias("m"))
    return files.join(deepest, ["repository", "path"]).select(*files.columns, "m.module", "m.module_folder")


def is_library(module: Column, folder: Column) -> Column:
    """Modules named as libraries, and everything inside a folder that ends in -lib."""
    parts = F.split(folder, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ((module != ":") & F.element_at(parts, -1).rlike(LIBRARY)) | F.exists(above, lambda p: p.endswith("-lib"))


def configuration_set(repository: Column, path: Column, central: list[str]) -> Column:
    """First folder within a central configuration repository (its name for files at the top), else ''."""
    inside = F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), 1)).otherwise(repository)
    return F.when(repository.isin(central), inside).otherwise("") if central else F.lit("")

