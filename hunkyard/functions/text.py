"""Column functions on texts, paths and tokens; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of word characters or one other visible character; lines end as Python's splitlines says.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\x0b\x1c-\x1f\x{85}\p{Z}\p{L}\p{N}_]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Languages by suffix, for providers and for the symbol index, and path parts that the index leaves out.
PROVIDER_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash"}
INDEX_LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "json": "json"}
REVIEWER_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c"}
FIXER_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust"}
INDEX_SKIPPED_PARTS = [".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", "node_modules", ".venv", "venv", "env", "dist", "build"]

# Paths left out of a review, first match wins, and the provider's own list.
IGNORED_PATHS = [r"package-lock\.json$", r"yarn\.lock$", r"poetry\.lock$", r"Pipfile\.lock$", r"\.lock$", r"\.min\.js$", r"\.min\.css$", r"(^|/)dist/", r"(^|/)build/", r"\.pb\.go$", r"_generated\.", r"\.svg$", r"\.png$", r"\.jpg$", r"\.jpeg$", r"\.gif$", r"\.ico$", r"\.woff2?$", r"\.ttf$", r"\.eot$"]
PROVIDER_SKIPPED = [r"package-lock\.json$", r"yarn\.lock$", r"poetry\.lock$", r"Pipfile\.lock$", r"\.lock$", r"\.min\.js$", r"\.min\.css$", r"dist/", r"build/", r"\.pb\.go$", r"_generated\.", r"\.svg$", r"\.png$", r"\.jpg$", r"\.gif$", r"\.ico$", r"\.woff", r"\.ttf$", r"\.eot$"]


def tokens(c: Column) -> Column:
    """The estimated number of tokens of a text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def lines(c: Column) -> Column:
    """The lines of a text without their ends; a last line end opens no further line; null and empty texts have none."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def suffix(path: Column) -> Column:
    """The part after the last dot in small letters, or null without a dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.element_at(F.split(path, r"\."), -1)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def provider_language(path: Column) -> Column:
    """The language a hosting provider would give a path, ``unknown`` where it has none."""
    return F.coalesce(_lookup(PROVIDER_LANGUAGES, suffix(path)), F.lit("unknown"))


def reviewer_language(path: Column) -> Column:
    """The language by suffix as reviewers are told it, ``unknown`` where it has none."""
    return F.coalesce(_lookup(REVIEWER_LANGUAGES, suffix(path)), F.lit("unknown"))


def fixer_language(path: Column) -> Column:
    """The language by suffix as the fix loop takes it, ``python`` where it has none."""
    return F.coalesce(_lookup(FIXER_LANGUAGES, suffix(path)), F.lit("python"))


def index_language(path: Column) -> Column:
    """The language under which the symbol index takes a path, or null where it leaves it out."""
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, INDEX_SKIPPED_PARTS)))
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(~skipped & F.rlike(name, F.lit(r"[^.]\.")), _lookup(INDEX_LANGUAGES, suffix(path)))


def first_match(path: Column, patterns: list[str]) -> Column:
    """The first of the patterns found in a path, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.rlike(path, F.lit(p)), F.lit(p)).otherwise(out)
    return out


def added_text(patch: Column) -> Column:
    """The added lines of a patch without their mark, file headers left out, joined by line feeds."""
    kept = F.filter(lines(patch), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 1_000_000_000)), "\n")


def normal_line(c: Column) -> Column:
    """A line as compared when a snippet is located: trimmed, one leading + or - dropped, trimmed again."""
    t = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(F.rlike(t, F.lit(r"^[+-]")), F.regexp_replace(F.substring(t, 2, 1_000_000_000), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise(t)
