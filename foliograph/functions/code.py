"""Expressions on source code, markdown, paths and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Path parts of code that isn't a repository's own.
NOISE = ("site-packages", ".venv", "__pycache__", "node_modules", "dist-packages")
#: Language labels by file suffix.
LANGUAGES = {".py": "lang:python", ".js": "lang:javascript", ".ts": "lang:typescript", ".rs": "lang:rust", ".go": "lang:go", ".java": "lang:java", ".c": "lang:c", ".cpp": "lang:cpp", ".md": "lang:markdown"}


def clean_path(path: Column) -> Column:
    """Whether no part of the path is noise."""
    out = F.lit(True)
    for part in NOISE:
        out = out & ~path.contains(part)
    return out


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[suffix]


def import_roots(code: Column) -> Column:
    """First parts of imported modules, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(T.empty(code), F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def symbols(code: Column) -> Column:
    """Names of functions and classes that don't start with an underscore, in order, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(T.empty(code), F.lit(r"(?m)^\s*(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda s: ~s.startswith("_")))


def code_summary(code: Column, most: int = 400) -> Column:
    """The docstring, else up to five signatures, else the first five lines."""
    doc = F.trim(F.regexp_extract(T.empty(code), r'(?s)"""(.*?)"""', 1))
    heads = F.array_join(F.slice(F.regexp_extract_all(T.empty(code), F.lit(r"(?m)^\s*((?:def|class)\s+[^\n:]*)"), F.lit(1)), 1, 5), "\n")
    first = F.array_join(F.slice(T.lines(code), 1, 5), "\n")
    return F.substring(F.coalesce(F.nullif(doc, F.lit("")), F.nullif(heads, F.lit("")), first), 1, most)


def clean_markdown(text: Column) -> Column:
    """Markdown without fences, images, link targets, tags and marks, white space collapsed."""
    for pattern, by in ((r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]*>", " "), (r"[`#*]", " ")):
        text = F.regexp_replace(text, pattern, by)
    return T.collapse(text)


def repair_lines(lines: Column) -> Column:
    """Lines joined by blanks; a hyphen at a line's end goes if the next starts in lower case."""
    joined = F.array_join(F.filter(F.transform(lines, T.collapse), lambda s: s != ""), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"([A-Za-z])-\n([a-z])", "$1$2"), "\n", " ")


def id_year(paper_id: Column) -> Column:
    """The year in an identifier: after a slash 90 to 99 are 19xx, plain ones are 20xx; null otherwise."""
    old, new = F.regexp_extract(paper_id, r"/([0-9]{2})[0-9]*", 1), F.regexp_extract(paper_id, r"^([0-9]{2})[0-9]{2}", 1)
    yy = old.try_cast("int")
    return F.when(paper_id.contains("/"), F.when(yy >= 90, 1900 + yy).otherwise(2000 + yy)).otherwise(2000 + new.try_cast("int"))


def rfc_date(text: Column) -> Column:
    """The date of 'Mon, 2 Apr 2007 19:18:42 GMT'; null if it can't be read."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1), F.lit("d MMM yyyy")))


def iso_date(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date")


def block_type(text: Column) -> Column:
    """pseudo_code, equation_block, abstract or body."""
    low = F.lower(T.empty(text))
    return F.when(low.contains("algorithm") | low.rlike(r"\b(while|for|return)\b.*:"), "pseudo_code").when(low.rlike(r"[=<>].*[=<>]|\\frac|\\sum"), "equation_block").when(low.startswith("abstract"), "abstract").otherwise("body")
