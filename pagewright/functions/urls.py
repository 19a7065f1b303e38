"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# netloc of a URL: everything between '//' and the first '/', '?' or '#'
# (user-info and port kept, as a URL parser's netloc does)
NETLOC_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_domain(url) -> Column:
    """Network location of a URL; '' when the URL has no scheme."""
    return F.regexp_extract(_c(url), NETLOC_RE, 1)


def url_scheme(url) -> Column:
    return F.regexp_extract(_c(url), SCHEME_RE, 1)


def url_strip_query(url) -> Column:
    """Cut at the first '?'."""
    return F.substring_index(_c(url), "?", 1)


def url_valid(url, pattern, is_regex) -> Column:
    """Empty pattern: every URL; regex: match anchored at the start; else substring.

    Site patterns are Python regexes, whose ``\\w``/``\\d`` are Unicode: ``(?U)``
    gives Java the same classes.
    """
    url, pattern, is_regex = _c(url), _c(pattern), _c(is_regex)
    anchored = F.concat(F.lit("(?U)^(?:"), pattern, F.lit(")"))
    return (F.when(F.coalesce(pattern, F.lit("")) == "", F.lit(True))
            .when(is_regex, F.regexp_like(url, anchored))
            .otherwise(F.contains(url, pattern)))


def url_canonical_host(url, contains, excluded, host_from, host_to) -> Column:
    """Replace a mirror host by the main host unless the URL names an excluded host."""
    url = _c(url)
    hit = F.contains(url, _c(contains)) & ~F.contains(url, _c(excluded))
    return F.when(hit, F.replace(url, _c(host_from), _c(host_to))).otherwise(url)


def regexp_group_or_null(s, pattern: str, idx: int = 1) -> Column:
    """First match group, NULL (not '') when there is no match."""
    return F.nullif(F.regexp_extract(_c(s), pattern, idx), F.lit(""))


def url_news_id(url) -> Column:
    """Trailing numeric path segment."""
    return regexp_group_or_null(url, r"/(\d+)$")


def url_news_id_param(url) -> Column:
    return regexp_group_or_null(url, r"NewsID=(\d+)")


def url_category_id(url) -> Column:
    return regexp_group_or_null(url, r"PageGroupID=(\d+)")


def url_category(url, pattern) -> Column:
    """Category from the URL path with a per-site pattern (group 1); NULL if absent.

    ``pattern`` may be a Python string or a column (a rule table joined in).
    """
    if isinstance(pattern, str):
        return regexp_group_or_null(url, pattern)
    return F.nullif(F.call_function("regexp_extract", _c(url), pattern, F.lit(1)), F.lit(""))


def _without_dots(path) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(kept, seg):
        return (F.when(seg == ".", kept)
                .when(seg == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
                .otherwise(F.concat(kept, F.array(seg))))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    clean = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), clean).otherwise(path)


def resolve_link(page_url, href) -> Column:
    """Make an href absolute against its page URL, as a URL join does."""
    page_url, href = _c(page_url), F.trim(_c(href))
    scheme = url_scheme(page_url)
    origin = F.concat(scheme, F.lit("://"), url_domain(page_url))
    path = F.regexp_extract(page_url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)       # the href's path
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)   # its query and fragment
    full = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (F.when(F.regexp_like(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
            .when(href == "", page_url)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("#"), F.concat(F.regexp_extract(page_url, r"^([^#]*)", 1), href))
            .when(href.startswith("?"), F.concat(origin, path, href))
            .otherwise(F.concat(origin, _without_dots(full), tail)))
