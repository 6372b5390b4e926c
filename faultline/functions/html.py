"""The prose of HTML pages, by one pass over each."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_LIMIT = 10_000
# Elements that are no prose, those whose content is raw text, and those without content.
REMOVED = frozenset(("script", "style", "header", "footer", "nav"))
RAW = frozenset(("script", "style"))
VOID = frozenset(("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"))

_NAME = re.compile(r"</?([a-zA-Z][^\s/>\0]*)")
_WITHIN = re.compile(r"""=\s*"[^"]*"|=\s*'[^']*'|>|[^=>]+|=""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _tag_end(page: str, at: int) -> int:
    """Behind the > that ends a tag, those in quoted values left out; the page's end if there is none."""
    for part in _WITHIN.finditer(page, at):
        if part[0] == ">":
            return part.end()
    return len(page)


def named_only(names: Mapping[str, str]) -> Callable[[str], str]:
    """Replaces just these references (with their & and semicolon), in one pass; all other signs stay as they are."""
    any_name = re.compile("|".join(map(re.escape, names)))
    return lambda text: any_name.sub(lambda m: names[m[0]], text)


def prose(page: str, limit: int = HTML_LIMIT, decode: Callable[[str], str] = unescape) -> str:
    """Text outside of tags, comments and REMOVED elements (to their end tag, or that of an element around them), white space collapsed, `limit` characters at most.

    Unclosed comments, tags and raw elements reach to the page's end. `decode` replaces character references; by default all of HTML, old ones without a semicolon too.
    """
    texts: list[str] = []
    open_: list[str] = []  # elements around this place, and how many of each
    count: Counter[str] = Counter()
    hidden = at = 0
    while at < len(page):
        mark = page.find("<", at)
        while mark >= 0 and not (page[mark + 1 : mark + 2].isalpha() and page[mark + 1].isascii()) and page[mark + 1 : mark + 2] not in ("/", "!", "?"):
            mark = page.find("<", mark + 1)  # a sign of its own
        end = mark if mark >= 0 else len(page)
        if not hidden and end > at:
            texts.append(decode(page[at:end]))
        if mark < 0:
            break
        name = _NAME.match(page, mark)
        if page.startswith("<!--", mark):
            at = page.find("-->", mark + 4) + 3
            at = at if at > 2 else len(page)
        elif not name:  # declarations and the like
            at = page.find(">", mark) + 1 or len(page)
        elif page[mark + 1] == "/":
            at, tag = page.find(">", name.end()) + 1 or len(page), name[1].lower()
            while count[tag]:
                last = open_.pop()
                count[last] -= 1
                hidden -= last in REMOVED
                if last == tag:
                    break
        else:
            at, tag = _tag_end(page, name.end()), name[1].lower()
            if tag in VOID or page.endswith("/>", mark, at):
                continue
            if tag in RAW:
                found = _RAW_END[tag].search(page, at)
                at = (page.find(">", found.end()) + 1 or len(page)) if found else len(page)
                continue
            open_.append(tag)
            count[tag] += 1
            hidden += tag in REMOVED
    return " ".join(" ".join(texts).split())[:limit]


def html_text(html: Column, limit: int = HTML_LIMIT, names: Mapping[str, str] | None = None) -> Column:
    """prose() of each page; null stays null. names: the only references that are replaced, and by what (none: all of HTML)."""
    decode = unescape if names is None else named_only(names)

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else prose(p, limit, decode))

    return of(html)
