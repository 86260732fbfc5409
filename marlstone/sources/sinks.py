"""Sinks: staged Parquet relations, Markdown catalog, JSON report, and packs as checked zip files."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schema
from marlstone.operators import search


def publish(spark: SparkSession, relations: dict[str, DataFrame], target: str, audit: DataFrame | None = None, catalog: DataFrame | None = None) -> None:
    """Write relations with their search index, the audit and the catalog aside, check the relations' schemas, then
    rename into place: readers see the old or the new."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{target.rstrip('/')}.aside-{uuid.uuid4().hex}"
    try:
        for name, df in relations.items():
            if wrong := schema.problems(name, df):
                raise ValueError("; ".join(wrong))
            df.write.parquet(f"{aside}/{name}")
        search.write_index(relations["chunks"], f"{aside}/index")
        for name, df in (("audit", audit), ("catalog", catalog)):
            if df is not None:
                df.write.parquet(f"{aside}/{name}")
        old = f"{target.rstrip('/')}.old-{uuid.uuid4().hex}"
        had = fs.exists(fs_path(target)) and fs.rename(fs_path(target), fs_path(old))
        if not fs.rename(fs_path(aside), fs_path(target)):
            if had:
                fs.rename(fs_path(old), fs_path(target))
            raise OSError(f"cannot rename {aside} to {target}")
        if had:
            fs.delete(fs_path(old), True)
    finally:
        fs.delete(fs_path(aside), True)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations of a published folder, with the stored schemas."""
    return {name: spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in schema.RELATIONS.items()}


def load_extra(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The audit or catalog of a published folder, or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/{name}") if there else None


def catalog_markdown(items: DataFrame) -> DataFrame:
    """id, block: one Markdown block for each catalog item (id, type, status, aliases, sources, capabilities)."""
    names = F.when(F.size("aliases") > 0, F.concat(F.lit("\n- aliases: "), F.array_join("aliases", ", "))).otherwise("")
    block = F.concat(F.format_string("## %s [%s, %s]", "id", "type", F.coalesce("status", F.lit("ready"))), names, F.lit("\n- sources: "), F.array_join("sources", ", "), F.lit("\n- capabilities: "), F.array_join("capabilities", ", "), F.lit("\n"))
    return items.select("id", block.alias("block"))


def report_json(row: DataFrame) -> DataFrame:
    """A one-row table as one JSON text."""
    return row.select(F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"}).alias("json"))


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def stale(report: dict, audit: dict, definition: str, fingerprint: str) -> list[str]:
    """Why a report does not speak for an index: what failed, and what it was made from that has changed since."""
    rules = (
        (report.get("passed"), "the report has not passed"),
        ((report.get("retrieval") or {}).get("passed"), "no retrieval evaluation has passed"),
        ((report.get("dependencies") or {}).get("passed"), "no dependency evaluation has passed"),
        (report.get("definition_sha256") == text_digest(definition), "the report is of another definition"),
        (report.get("fingerprint") == fingerprint, "the report is of another index"),
        (report.get("audit_sha256") == text_digest(json.dumps(audit, sort_keys=True, default=str)), "the report is of another audit"),
        (report.get("schema_version") == schema.VERSION, "the report is of another schema version"),
        (audit.get("fingerprint") == fingerprint, "the audit is of another index"),
    )
    return [text for holds, text in rules if not holds]


def pack(folder: str, target: str, report: dict, audit: dict, definition: str, fingerprint: str, version: str = "0") -> None:
    """Zip a published folder with its report, definition and a manifest of sizes and digests.

    Refused unless the report passed and is of this very index, audit and definition. A pack is a local file; a folder
    on another file system is copied first.
    """
    if wrong := stale(report, audit, definition, fingerprint):
        raise ValueError("nothing is packed: " + "; ".join(wrong))
    files = sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)
    digests = {n: {"size": os.path.getsize(os.path.join(folder, n)), "sha256": _digest(os.path.join(folder, n))} for n in files}
    manifest = {"version": version, "schema_version": schema.VERSION, "pack": audit.get("pack"), "sources": audit.get("source_revisions", []), "fingerprint": fingerprint, "report": report, "definition": definition, "files": digests}
    aside = f"{target}.{uuid.uuid4().hex}"
    with zipfile.ZipFile(aside, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest, sort_keys=True, default=str))
        for n in files:
            z.write(os.path.join(folder, n), f"data/{n}")
    os.replace(aside, target)


def install(packed: str, target: str) -> None:
    """Unpack beside the target, check every file, then swap; a bad pack leaves the target as it was."""
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(target))) as aside, zipfile.ZipFile(packed) as z:
        manifest = json.loads(z.read("manifest.json"))
        if schema.VERSION != manifest.get("schema_version"):
            raise ValueError("the pack has another schema version")
        if {i.filename for i in z.infolist()} != {"manifest.json", *(f"data/{n}" for n in manifest["files"])}:
            raise ValueError("the pack's files are not those of its manifest")
        z.extractall(aside)
        for n, want in manifest["files"].items():
            path = os.path.join(aside, "data", n)
            if os.path.getsize(path) != want["size"] or _digest(path) != want["sha256"]:
                raise ValueError(f"{n} is damaged")
        old = os.path.join(aside, "old")
        if os.path.exists(target):
            os.rename(target, old)
        try:
            os.rename(os.path.join(aside, "data"), target)
        except OSError:
            if os.path.exists(old):
                os.rename(old, target)
            raise
        shutil.rmtree(old, ignore_errors=True)
