"""Text functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"
TAGS = "table|thead|tbody|tr|td|th|ul|ol|li|h[1-6]|p|pre|code|br|em|strong|span|a|img|div|section|article|aside|header|footer|main|nav|details|script|style"
TAG = rf"(?i)</?(?:{TAGS})\b[^>]*>"
BLOCKS = ("script", "style", "nav", "header", "footer")
SECRET = r"(?:[\w.-]+[._-])?(?:api[-_]?key|credential|password|private[-_]?key|secret|token)"
KIND_ORDER = {"context": 0, "usage": 1, "docs": 2, "example": 3, "source": 4}


def tokens(text: Column | str) -> Column:
    """Index terms: runs of letters and digits, lower-cased, Latin accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTS, PLAIN), F.lit(TOKEN), F.lit(0))


def phrases(query: str) -> list[list[str]]:
    """A search string as its phrases: each run of word characters and hyphens is one phrase of adjacent
    terms, all phrases must occur, and those without a term are left out."""
    out = []
    for part in re.findall(r"[\w-]+", query):
        terms = re.findall(r"[^\W_]+", part.lower().translate(str.maketrans(ACCENTS, PLAIN)))
        if terms:
            out.append(terms)
    return out


def match_expression(query: str) -> str:
    """The search string with every run of word characters quoted."""
    return " ".join('"' + t.replace('"', '""') + '"' for t in re.findall(r"[\w-]+", query))


def kind_priority(kind: Column | str) -> Column:
    """Rank of a source kind; unknown kinds come last."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(len(KIND_ORDER))
    for name, rank in reversed(KIND_ORDER.items()):
        out = F.when(kind == name, rank).otherwise(out)
    return out


def content_kind(path: Column, language: Column) -> Column:
    """Kind of a file by its path and language; the order of the cases matters."""
    low = F.lower(path)
    return (
        F.when(path.rlike(r"(^|/)project-context\.yaml$"), "context")
        .when((language == "markdown") & path.rlike(r"(^|/)docs/usage/[^/]+$"), "usage")
        .when(low.contains("example") | low.contains("test"), "example")
        .when(language.isin("yaml", "toml", "properties"), "configuration")
        .when(language.isin("markdown", "html"), "docs")
        .otherwise("source")
    )


def title(text: Column | str, fallback: Column) -> Column:
    """First level-one heading, else the first declared type's name, else the fallback."""
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    symbol = F.regexp_extract(text, r"(?m)^\s*(?:(?:abstract|data|final|open|private|protected|public|sealed)\s+)*(?:enum|class|record|object|interface)\s+([_a-zA-Z]\w*)", 1)
    return F.trim(F.coalesce(F.nullif(heading, F.lit("")), F.nullif(symbol, F.lit("")), fallback))


def blank_lines(text: Column | str, pattern: str) -> Column:
    """Replace what the pattern matches by as many newlines as it held, so that line numbers stay.

    A reference to the pattern's own first group is written {group}.
    """
    found = F.regexp_extract_all(text, F.lit("(" + pattern.replace("{group}", "2") + ")"), F.lit(1))
    parts = F.split(text, pattern.replace("{group}", "1"), -1)
    both = F.zip_with(parts, found, lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.regexp_replace(F.coalesce(f, F.lit("")), r"[^\n]+", "")))
    return F.array_join(both, "")


def clean_html(text: Column | str) -> Column:
    """Blank script, style, navigation, header and footer blocks, listed tags to spaces, character references unescaped."""
    from marlstone.functions.lexer import unescaped

    out = F.col(text) if isinstance(text, str) else text
    names = "|".join(BLOCKS)
    out = blank_lines(out, rf"(?is)<({names}).*?</\{{group}}>")
    return unescaped(F.regexp_replace(out, TAG, " "))


def clean_markdown(text: Column | str) -> Column:
    """Blank front matter, drop import and export lines, delete listed tags."""
    out = blank_lines(text, r"(?s)\A---\s*\n.*?\n---\s*\n")
    out = F.regexp_replace(out, r"(?m)^\s*(?:export|import)\s.*$", "")
    return F.regexp_replace(out, TAG, "")


def redact_lines(text: Column | str) -> Column:
    """Values of secret-looking keys become a mark; the key stays."""
    return F.regexp_replace(text, rf"(?im)^(\s*{SECRET}\s*[:=]).*$", "$1 <redacted>")


def secret_lines(text: Column | str) -> Column:
    """Assignments to secret-looking keys that are not redacted."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^(\s*{SECRET}\s*[:=].*)$"), F.lit(1))
    return F.filter(found, lambda m: ~m.contains("<redacted>"))


def accessor(alias: Column | str) -> Column:
    """Catalog alias to accessor: separators become single dots."""
    return F.array_join(F.filter(F.split(alias, r"[-_.]+"), lambda p: p != ""), ".")


def letters_only(text: Column | str) -> Column:
    """Lower-cased with everything but letters and digits of any script removed."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def ascii_only(text: Column | str) -> Column:
    """Lower-cased with everything but a-z and 0-9 removed."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def short_commit(sha: Column | str) -> Column:
    return F.substring(sha, 1, 12)


def source_name(repository: Column | str, path: Column | str) -> Column:
    return F.concat_ws(":", repository, path)


def sync_progress(status: Column | str) -> Column:
    """The status of a source, with what a dirty working tree means."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == "sync_skipped_dirty", F.concat(status, F.lit(" (sync skipped; the dirty working tree is indexed)"))).otherwise(status)
