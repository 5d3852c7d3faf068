"""Scalar text functions, all as built-in Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

TAB = 8


def fill(template: str, group: Callable[[int], Column], groups: int) -> Column:
    """Column for a template with ``{1}``, ``{2}``... for the groups."""
    parts, rest = [], template
    while rest:
        places = [(rest.find(f"{{{i}}}"), i) for i in range(1, groups + 1)]
        places = [p for p in places if p[0] >= 0]
        if not places:
            parts.append(F.lit(rest))
            break
        at, i = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(group(i))
        rest = rest[at + len(f"{{{i}}}"):]
    return F.concat(*parts) if parts else F.lit("")


def trimmed_right(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between runs of white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def spaces_to_tabs(line: Column) -> Column:
    """Leading blanks of a line as tabs of 8 and the remaining blanks.  Null
    for a line that holds a tab already."""
    indent = F.length(line) - F.length(F.ltrim(line))
    tabs = F.floor(indent / TAB).cast("int")
    return F.when(~line.contains("\t"), F.concat(
        F.repeat(F.lit("\t"), tabs), F.repeat(F.lit(" "), indent - tabs * TAB), F.ltrim(line)))


def tabs_to_spaces(line: Column) -> Column:
    """Each tab moves to the next column that is a multiple of 8."""
    def expand(pieces: Column) -> Column:
        return F.concat(
            F.aggregate(
                F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(""),
                lambda done, piece: let(F.concat(done, piece), lambda s: F.rpad(
                    s, (F.floor(F.length(s) / TAB) * TAB + TAB).cast("int"), F.lit(" ")))),
            F.element_at(pieces, -1))
    return let(F.split(line, "\t", -1), expand)


def sentence(names: Column, one: str, many: str) -> Column:
    """``one`` with ``{1}`` for a single name, else ``many`` with the list."""
    listed = F.array_join(names, ", ")
    return F.when(F.size(names) == 1, fill(one, lambda _: listed, 1)).otherwise(
        fill(many, lambda _: listed, 1))


def quoted(text: Column, mark: str = "> ") -> Column:
    """Each line trimmed and marked as quoted."""
    return F.array_join(F.transform(
        F.split(text, "\n", -1), lambda l: F.concat(F.lit(mark), stripped(l))), "\n")


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from the page ``base``: absolute links stay, links from
    the root get scheme and host, others the folder of the page."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(
        F.regexp_replace(page, r"[^/]*$", ""))
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link == "", base)
            .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
            .when(link.startswith("?"), F.concat(page, link))
            .otherwise(F.concat(folder, link)))
