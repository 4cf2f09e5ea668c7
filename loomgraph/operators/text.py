"""Column functions for the texts that workflow documents carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = "[A-Za-z_][A-Za-z0-9_]*"


def template_variables(template: str) -> Column:
    """Sorted distinct names of `{name}` and `{{ name }}` placeholders."""
    found = F.regexp_extract_all(F.col(template), F.lit(rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{{_NAME}\}}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[{}\s]", ""))))


def redacted(text: str) -> Column:
    """API keys replaced by a mark."""
    return F.regexp_replace(text, r"\bsk-[A-Za-z0-9_-]{8,}", "sk-[redacted]")


def safe_link(url: str) -> Column:
    """The URL if it is http or https, else null: documents are untrusted."""
    return F.when(F.col(url).rlike("^https?://"), F.col(url))


def snake(name: str | Column) -> Column:
    """lower_snake_case that keeps acronyms together; `x` for nothing."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")
    return F.when(c == "", F.lit("x")).otherwise(c)


def location(file: str, start: str, end: str) -> Column:
    """`file:start-end`, without what is absent, the end only where it differs."""
    span = F.when(F.col(end).isNotNull() & (F.col(end) != F.col(start)), F.concat(F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))).otherwise(F.col(start).cast("string"))
    return F.concat_ws(":", F.col(file), span)


def escaped(text: str | Column) -> Column:
    """Safe inside XML and HTML text and attributes."""
    c = F.col(text) if isinstance(text, str) else text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def permalink(repository: Column, commit: Column, root: Column, file: Column, start: Column, end: Column, url: Column) -> Column:
    """A link to lines of a file at a commit, null where it is not known; a reference's own `url` goes first, if it is safe.

    Repositories of one public host only, whose links have a known form.
    """
    place = F.regexp_extract(repository, r"^https?://github\.com/([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    path = F.when(root != "", F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), file)).otherwise(file)
    lines = F.when(start > 0, F.concat(F.lit("#L"), start.cast("string"), F.when((end > 0) & (end != start), F.concat(F.lit("-L"), end.cast("string"))).otherwise(""))).otherwise("")
    made = F.when((place != "") & (commit != ""), F.concat(F.lit("https://github.com/"), place, F.lit("/blob/"), commit, F.lit("/"), path, lines))
    return F.when(url != "", F.when(url.rlike("^https?://"), url)).otherwise(made)
