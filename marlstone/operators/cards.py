"""Curated context cards and catalogs: validation and derived catalog items."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = tuple("support-module library-suite library application".split())
FIELDS = frozenset("aliases components configuration dependency do_not_use_when entrypoints evidence examples kind modules name purpose related schema_version unknowns use_when".split())
OBJECTS = {"evidence": ("path", "proves", "url"), "examples": ("id", "path", "summary"), "configuration": ("key", "required", "description"), "components": ("module", "context")}
NEEDED = {"evidence": ("path", "proves"), "examples": ("id", "path", "summary"), "configuration": ("key", "description"), "components": ("module", "context")}
EXPLAINED = dict(configuration="description", evidence="proves", examples="summary")
ECOSYSTEMS = {"gradle": "alias", "maven": "coordinates", "npm": "package"}
HEADINGS = ("Когда использовать", "Зависимость", "Минимальный пример", "Обязательная конфигурация", "Ожидаемый результат", "Ограничения и типичные ошибки", "Evidence")
CATALOG_TYPES = (*KINDS, "guide")
URL = re.compile("https?://")
_ABSOLUTE = re.compile(r"~?[\\/]|[a-zA-Z]:[\\/]")


def strings(value) -> list[str]:
    return [v for v in value if isinstance(v, str) and v.strip()] if isinstance(value, list) else []


def objects(value) -> list[dict]:
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def filled(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def load_card(text: str):
    """A card's YAML text; ValueError if it is none."""
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"no valid YAML: {e}") from e


def list_errors(card: dict, field: str) -> list[str]:
    """What is wrong with a list of objects; an absent one is fine."""
    value = card.get(field)
    if value is None:
        return []
    if not isinstance(value, list):
        return [f"{field}: not a list"]
    out = []
    for n, entry in enumerate(value, 1):
        if type(entry) is not dict:
            out.append(f"{field}[{n}]: not an object")
            continue
        out += [f"{field}[{n}]: unknown field {k}" for k in sorted(entry.keys() - set(OBJECTS[field]))]
        out += [f"{field}[{n}].{k}: empty" for k in NEEDED[field] if not filled(entry.get(k))]
    return out


def card_paths(card: dict) -> list[tuple[str, str]]:
    """(field, path) of all files that a card refers to."""
    out = [(f, v if isinstance(v, str) else v["path"]) for f in ("examples", "evidence") if isinstance(card.get(f), list) for v in card[f] if isinstance(v, str) or isinstance(v, dict) and isinstance(v.get("path"), str)]
    return out + [("components", v["context"]) for v in objects(card.get("components")) if isinstance(v.get("context"), str)]


def path_error(value: str, files: set[str]) -> str | None:
    """Why a path is not that of a file in the repository (its relative paths), or None."""
    value = value.strip()
    if URL.match(value):
        return f"{value}: a URL, not a path"
    if _ABSOLUTE.match(value):
        return f"{value}: an absolute path"
    plain = os.path.normpath(value)
    if plain.startswith(".."):
        return f"{value}: outside of the repository"
    return None if plain in files else f"{value}: no such file"


def usage_errors(text: str, files: set[str]) -> list[str]:
    """What is wrong with a usage document."""
    out = [] if re.search(r"(?m)^#\s+\S", text) else ["no title"]
    out += [f"no heading {h}" for h in HEADINGS if not re.search(rf"(?m)^## {re.escape(h)}\s*$", text)]
    if re.search(r"[a-zA-Z]:[\\/]|/Users/|/home/", text):
        out.append("a local path")
    _, mark, rest = text.partition("## Evidence")
    if mark:
        section = re.match(r"(?s).*?(?=^##\s|\Z)", rest, re.M)[0]
        named = [m[1:-1] for m in re.findall("`[^`]+`", section)]
        out += [] if named else ["Evidence names no file"]
        out += [f"Evidence {e}" for v in named if (e := path_error(v, files))]
    return out


def card_errors(card, files: dict[str, str], explanation: str = r"[А-Яа-яЁё]") -> list[str]:
    """What is wrong with a card. ``files``: relative path to text of the repository's files; explanations must
    hold a character of the given class."""
    if not isinstance(card, dict):
        return ["not an object"]
    names = set(files)
    out = [f"unknown field {k}" for k in sorted(set(card) - FIELDS)]
    out += [] if card.get("schema_version") == 1 else ["schema_version is not 1"]
    kind = card.get("kind")
    out += [] if kind in KINDS else [f"kind is none of {', '.join(KINDS)}"]
    out += [f"{f}: empty" for f in ("name", "purpose") if not filled(card.get(f))]
    out += [] if strings(card.get("use_when")) else ["use_when: empty"]
    out += [] if isinstance(card.get("evidence"), list) and card["evidence"] else ["evidence: empty"]
    for field in EXPLAINED:
        out += list_errors(card, field)
    out += [f"configuration {v.get('key')}: required is neither true nor false" for v in objects(card.get("configuration")) if not isinstance(v.get("required", True), bool)]
    out += [f"evidence {v.get('path')}: url is no permalink" for v in objects(card.get("evidence")) if "url" in v and not URL.match(str(v["url"]))]
    if kind == "library-suite":
        out += [] if card.get("components") else ["components: a suite needs them"]
        out += list_errors(card, "components")
        out += [f"{f}: belongs to the components of a suite" for f in "configuration dependency entrypoints examples".split() if card.get(f)]
    elif card.get("components"):
        out.append("components: only a suite has them")
    for field in "aliases do_not_use_when entrypoints modules related unknowns use_when".split():
        if field in card and strings(card[field]) != card[field]:
            out.append(f"{field}: not a list of filled strings")
    out += dependency_errors(card.get("dependency"))
    said = [("purpose", card.get("purpose"))] + [(f, v) for f in ("use_when", "do_not_use_when", "unknowns") for v in strings(card.get(f))]
    said += [(f"{f}.{t}", v.get(t)) for f, t in EXPLAINED.items() for v in objects(card.get(f))]
    out += [f"{f}: not in the language of explanations" for f, v in said if filled(v) and not re.search(explanation, v)]
    seen = set()
    for field, value in card_paths(card):
        if error := path_error(value, names):
            out.append(f"{field} {error}")
        plain = os.path.normpath(value.strip())
        placed = re.fullmatch(r"(.*/)?docs/usage/[^/]*[^/]\.md", plain)
        if field == "examples" and not placed:
            out.append(f"examples {value}: not in docs/usage")
        elif field == "examples" and plain in names - seen:
            seen.add(plain)
            out += [f"examples {value}: {e}" for e in usage_errors(files[plain], names)]
        if field == "components" and os.path.basename(plain) != "project-context.yaml":
            out.append(f"components {value}: no context card")
    return out


def dependency_errors(value) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, dict):
        return ["dependency: not an object"]
    system = value.get("ecosystem")
    key = ECOSYSTEMS.get(system)
    out = [f"dependency: unknown field {k}" for k in sorted(set(value) - {"ecosystem", "declaration", key})]
    if not key:
        return [*out, f"dependency.ecosystem is none of {', '.join(ECOSYSTEMS)}"]
    if not filled(value.get("declaration")):
        return [*out, "dependency.declaration: empty"]
    if not filled(value.get(key)):
        out.append(f"dependency.{key}: empty")
    elif system == "gradle" and not (value["alias"].startswith("libs.") and value["alias"] in value["declaration"]):
        out.append("dependency.alias: not the alias of the declaration")
    return out


def catalog_item(card: dict, repository: str, module: str) -> dict:
    """The catalog item of a valid card."""
    has = [c for c, f in (("usage", "examples"), ("api", "entrypoints"), ("configuration", "configuration")) if card.get(f)]
    names = dict.fromkeys([card["name"], *strings(card.get("aliases"))])
    return dict(
        id=card["name"], type=card["kind"], status="curated", aliases=list(names), sources=[repository + module], capabilities=["context", *has],
        purpose=card["purpose"], use_when=strings(card.get("use_when")), examples=[p for f, p in card_paths(card) if f == "examples"],
    )


ITEM = "id string, type string, status string, aliases array<string>, sources array<string>, capabilities array<string>, purpose string, use_when array<string>, examples array<string>"


def validated(files: DataFrame) -> DataFrame:
    """repository, path, module, errors, item of every context card; item is null if there are errors.

    ``files`` has a row for every file of the repositories: repository, path, module, kind, text (needed for
    cards and usage documents only). Each repository is validated by itself, so no driver holds its files.
    """

    def check(group: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(group["path"], group["text"].where(group["text"].notna(), "")))
        rows = []
        for r in group[group["kind"] == "context"].itertuples():
            try:
                card = load_card(r.text or "")
                errors = card_errors(card, texts)
            except ValueError as e:
                card, errors = None, [str(e)]
            item = None if errors else catalog_item(card, r.repository, r.module or ":")
            rows.append((r.repository, r.path, r.module, errors, item))
        return pd.DataFrame(rows, columns=["repository", "path", "module", "errors", "item"])

    needed = F.when(F.col("kind") == "context", F.col("text")).when(F.col("path").rlike(r"(^|/)docs/usage/[^/]+\.md$"), F.col("text"))
    slim = files.select("repository", "path", "module", "kind", needed.alias("text"))
    cards_of = slim.join(slim.where("kind = 'context'").select("repository").distinct(), "repository", "left_semi")
    return cards_of.groupBy("repository").applyInPandas(check, f"repository string, path string, module string, errors array<string>, item struct<{', '.join(c.replace(' ', ': ', 1) for c in ITEM.split(', '))}>")


def guessed_items(modules: DataFrame) -> DataFrame:
    """Catalog items of the modules (repository, module, folder) that are named as libraries."""
    from marlstone.sources.files import is_library

    name = F.element_at(F.split("folder", "/"), -1)
    return modules.where(is_library(F.col("module"), F.col("folder"))).select(
        F.concat("repository", F.replace("module", F.lit(":"), F.lit("-"))).alias("id"), F.lit("library").alias("type"), F.lit("discovered").alias("status"),
        F.array(F.replace(name, F.lit("-"), F.lit(" "))).alias("aliases"), F.array(F.concat("repository", "module")).alias("sources"), F.array(F.lit("api"), F.lit("examples")).alias("capabilities"),
        F.lit(None).cast("string").alias("purpose"), F.array().cast("array<string>").alias("use_when"), F.array().cast("array<string>").alias("examples"),
    )


def manifest_catalog(spark: SparkSession, manifest: dict) -> DataFrame:
    """The catalog items of a manifest (sources with modules, catalog entries); ValueError tells what is wrong with it."""
    sources = [(f"{s['id']}:{m['id']}",) for s in manifest.get("sources", []) for m in s.get("modules", [])]
    known = spark.createDataFrame(sources, "source_id string")
    rows = [(e.get("id"), e.get("type"), e.get("status") or "ready", e.get("aliases") or [], e.get("source_modules") or [], e.get("capabilities") or []) for e in manifest.get("catalog", [])]
    entries = spark.createDataFrame(rows, "id string, type string, status string, aliases array<string>, source_modules array<string>, capabilities array<string>")
    if wrong := [f"{r['id']}: {r['error']}" for r in manifest_errors(entries, known).orderBy("id", "error").collect()]:
        raise ValueError("; ".join(wrong))
    return entries.withColumnRenamed("source_modules", "sources").orderBy("id")


def merge_catalog(items: DataFrame) -> DataFrame:
    """Catalog items (id, status, sources, ...) where a curated one replaces the guessed ones that share a source."""
    curated = items.where("status = 'curated'")
    taken = curated.select(F.explode("sources").alias("s")).distinct()
    guessed = items.where("status <> 'curated'")
    covered = guessed.select("id", "sources", F.explode("sources").alias("s")).join(taken, "s").select("id", "sources").distinct()
    return curated.dropDuplicates(["id", "sources"]).unionByName(guessed.join(covered, ["id", "sources"], "left_anti").dropDuplicates(["id", "sources"]))


def manifest_errors(entries: DataFrame, source_ids: DataFrame) -> DataFrame:
    """id, error of catalog entries (id, type, source_modules, capabilities) that are incomplete, of unknown type, or
    name an unknown source (source_id)."""
    empty = [F.when(F.coalesce(F.size(c) if c != "type" else F.length(c), F.lit(0)) <= 0, F.lit(f"{c} is missing")) for c in ("type", "source_modules", "capabilities")]
    kind = F.when(F.length("type") > 0, F.when(~F.col("type").isin(*CATALOG_TYPES), F.concat(F.lit("unknown type "), "type")))
    own = entries.select("id", F.explode(F.array_compact(F.array(*empty, kind))).alias("error"))
    strange = entries.select("id", F.explode("source_modules").alias("source_id")).join(source_ids, "source_id", "left_anti")
    return own.unionByName(strange.select("id", F.concat(F.lit("unknown source "), "source_id").alias("error")))
