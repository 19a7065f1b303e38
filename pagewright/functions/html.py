"""Page expressions: metadata and links pulled from raw HTML with regexes."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import url_domain


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Names of character references and their code points (HTML's Latin, symbol
# and special sets, from the standard library).
_NAMED = {name: code for name, code in name2codepoint.items()} | {"apos": 39}


def _char(code) -> Column:
    """The character of a code point; U+FFFD outside Unicode."""
    ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    code = F.when(ok, code).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(s) -> Column:
    """Decode numeric and named character references (``&#8217;``, ``&#x2019;``,
    ``&mdash;``); an unknown one stays as it is."""
    s = _c(s)
    names = F.create_map(*[F.lit(x) for kv in sorted(_NAMED.items()) for x in kv])

    def one(p, i):
        dec = F.regexp_extract(p, r"^#([0-9]{1,7})(?![0-9])", 1)
        hexa = F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]{1,6})(?![0-9a-fA-F])", 1)
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.regexp_replace(p, r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", "")
        named = F.try_element_at(names, name)
        return (F.when(i == 0, p)
                .when(dec != "", F.concat(_char(F.nullif(dec, F.lit("")).cast("int")), rest))
                .when(hexa != "", F.concat(_char(F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("int")), rest))
                .when(named.isNotNull(), F.concat(_char(named), rest))
                .otherwise(F.concat(F.lit("&"), p)))

    return F.when(s.contains("&"), F.array_join(F.transform(F.split(s, "&"), one), "")).otherwise(s)


# An attribute list in which quoted values may hold '>'.
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""


def _attribute(tag, name: str) -> Column:
    """Value of an attribute of a start tag, in either quotes or none, in any
    place and case, references decoded; NULL when the tag lacks it."""
    pat = rf"""(?is)[\s"'/]{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    raw = F.regexp_extract(tag, pat, 1)
    return F.when(raw != "", unescape(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")))


def html_title(html) -> Column:
    return unescape(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_tags(html) -> Column:
    """The start tags of all ``<meta>`` elements."""
    return F.regexp_extract_all(_c(html), F.lit(r"(?is)<meta(?=[\s/])" + _IN_TAG), F.lit(0))


def meta_content(tags, name: str) -> Column:
    """``content`` of the first ``<meta name="...">`` among the tags ('' when absent)."""
    tags = _c(tags)
    mine = F.filter(tags, lambda t: F.lower(F.trim(F.coalesce(_attribute(t, "name"), F.lit("")))) == name.lower())
    return F.coalesce(_attribute(F.try_element_at(mine, F.lit(1)), "content"), F.lit(""))


def page_metadata(html, tags=None) -> dict:
    """Title, description and keywords; ``tags`` is a column of ``meta_tags``, so
    that a page is searched for them once."""
    tags = meta_tags(html) if tags is None else tags
    return {"title": html_title(html), "description": meta_content(tags, "description"),
            "keywords": meta_content(tags, "keywords")}


def hrefs(html) -> Column:
    """All ``<a href>`` values of a page, in document order, whatever the
    attributes' order, quotes and case."""
    tags = F.regexp_extract_all(_c(html), F.lit(r"(?is)<a(?=[\s/])" + _IN_TAG), F.lit(0))
    return F.filter(F.transform(tags, lambda t: _attribute(t, "href")), lambda h: h.isNotNull())


def same_host(url_a, url_b) -> Column:
    return F.lower(url_domain(url_a)) == F.lower(url_domain(url_b))


def article_text(html) -> Column:
    """Text inside the first ``<article>`` element, tags removed, entities decoded."""
    inner = F.regexp_extract(_c(html), r"(?is)<article[^>]*>(.*?)</article>", 1)
    return unescape(F.regexp_replace(inner, r"<[^>]*>", ""))
