"""String functions on columns; all of them stay in the JVM and give null for null unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it; Java's and RE2's classes are narrower. The same text serves both engines.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

# Lines of an archive's export that do not belong to an article.
EXPORT_LINES = (
    r"^Page\s+\d+\s+of\s+\d+\s*$",
    r"^Load-Date:.*$",
    r"^End of Document\s*$",
    r"^Bekijk de oorspronkelijke pagina:.*$",
    r"^Lees ook:.*$",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_blanks(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def undouble(title: Column) -> Column:
    """A title that was written twice, with or without a character between, once; else the stripped title."""
    half = F.floor(F.length(title) / 2).cast("int")
    first, longer, second = F.substring(title, F.lit(1), half), F.substring(title, F.lit(1), half + 1), F.substring(title, half + 1, F.length(title))
    same = (strip(first) == strip(second)) | (strip(longer) == strip(second))
    return F.when(same & (F.length(title) > 0), strip(first)).otherwise(strip(title))


def drop_export_lines(body: Column) -> Column:
    """Without the lines of ``EXPORT_LINES``; runs of three or more line feeds become two. Only LF ends a line."""
    text = F.regexp_replace(body, "(?mid)" + "|".join(EXPORT_LINES), "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(rf"[^\t\n\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}]+")).cast("long")


def count_hits(c: Column, terms: Column) -> Column:
    """Sum over an array of terms of their non-overlapping occurrences, regardless of case; 0 for null."""
    some = F.filter(terms, lambda k: F.length(k) > 0)
    hits = lambda t, k: ((F.length(t) - F.length(F.replace(t, F.lower(k), F.lit("")))) / F.length(k)).cast("long")
    # the text is bound to a variable, so that it is put in lower case once and not for each term
    each = F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), lambda t: F.aggregate(some, F.lit(0).cast("long"), lambda n, k: n + hits(t, k)))
    return F.get(each, F.lit(0))


def parse_list(c: Column) -> Column:
    """The quoted items of a list literal; null for malformed ones."""
    well = c.rlike(r"^\s*\[\s*('[^']*'\s*(,\s*'[^']*'\s*)*)?\]\s*$")
    return F.when(well, F.transform(F.regexp_extract_all(c, F.lit("'([^']*)'"), 1), strip))


def yes_no(c: Column) -> Column:
    """yes, no or null for anything else."""
    v = F.lower(strip(c))
    return F.when(v.isin("yes", "no"), v)


def excerpt(c: Column, n: int) -> Column:
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def parse_date(c: Column) -> Column:
    """Timestamp of the accepted layouts, null for others."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy")])


def dashes(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{2010}-\x{2015}]", "-")


def found_list(c: Column, pattern: str) -> Column:
    """The sorted distinct lower-cased matches; none for null."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0), F.lower)))


def found_set(c: Column, pattern: str, n: int) -> Column:
    """First n of the sorted distinct lower-cased matches, joined by ``; ``."""
    return F.array_join(F.slice(found_list(c, pattern), 1, n), "; ")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
