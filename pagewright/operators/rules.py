"""Per-site cleaning and publish-time rules, plugged in by site name.

A rule set is plain data (patterns); ``register_site`` adds or replaces one.
``clean_content`` / ``site_content`` / ``site_publish_time`` compile the
registry into a single ``CASE site WHEN ...`` projection, so all sites run in
one whole-stage-codegen pass with no Python on the data path.  Sites that are
not registered get the base behaviour.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse_and_strip, cut, first_match, publish_time_extract

# Cuts applied to every site's content, in this order.
COMMON_CUTS = [r"分享\s*推薦.*?$", r"相關新聞\s*推薦.*?$", r"影音推薦.*?$"]

# Extra first-level cuts by site.
BASE_SITE_CUTS = {
    "tvbs": [r"相關新聞：.*?$"],
    "udn": [r"延伸閱讀：.*?$"],
    "setn": [r"三立新聞網[／\s]", r"記者[\u4e00-\u9fff]+?／[^／]+?報導"],
}

# Date patterns of the site rules.
DASH_DATE = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})"
SLASH_DATE = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2})"
SLASH_DATE_LOOSE = r"(\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2})"


@dataclass
class SiteRules:
    """Second-level rules of one site.

    ``steps``: patterns removed in order after the base cleaning.
    ``collapse``: collapse blank lines and strip afterwards.
    ``publish``: (pattern, mode) where mode is ``add_seconds`` (slashes become
    dashes, ':00' appended), ``as_is`` (slashes become dashes) or ``parse``
    (loose date parsed; a bad date keeps the base value).
    ``category``: URL pattern whose group 1 is the category.
    ``content_fn``: optional Column -> Column hook run after ``steps``.
    """
    steps: list = field(default_factory=list)
    collapse: bool = False
    publish: tuple | None = None
    category: str | None = None
    content_fn: Callable[[Column], Column] | None = None


# Second-level rules of the configured sites.
_REGISTRY: dict[str, SiteRules] = {
    "udn": SiteRules(steps=[r"加入會員.*?閱讀無上限", r"延伸閱讀.*?$", r"贊助商文章.*?$"],
                     publish=(DASH_DATE, "add_seconds"), category=r"udn\.com/news/([^/]+)/"),
    "tvbs": SiteRules(steps=COMMON_CUTS + [r"加入TVBS會員.*?$", r"更多.*?資訊.*?請見.*?$"],
                      collapse=True, publish=(SLASH_DATE, "add_seconds"),
                      category=r"https://news\.tvbs\.com\.tw/([^/]+)/"),
    "setn": SiteRules(steps=[r"三立新聞網[／\s]", r"記者[\u4e00-\u9fff]+?／[^／]+?報導",
                             r"延伸閱讀.*?$", r"推薦閱讀.*?$", r"▲.*?$"],
                      collapse=True, publish=(SLASH_DATE_LOOSE, "parse")),
    "businessweekly": SiteRules(steps=list(COMMON_CUTS), publish=(SLASH_DATE, "as_is")),
    "gonews": SiteRules(steps=list(COMMON_CUTS), publish=(SLASH_DATE, "as_is")),
    "ebc": SiteRules(steps=list(COMMON_CUTS), publish=(SLASH_DATE, "as_is")),
    "ftnn": SiteRules(steps=list(COMMON_CUTS), publish=(SLASH_DATE, "as_is")),
    "sportsv": SiteRules(steps=list(COMMON_CUTS), publish=(SLASH_DATE, "as_is")),
    "tvbs_woman": SiteRules(steps=list(COMMON_CUTS), publish=(SLASH_DATE, "as_is"),
                            category=r"https://woman\.tvbs\.com\.tw/([^/]+)/"),
    "mobile01": SiteRules(publish=(DASH_DATE, "as_is")),
    "Newtalk": SiteRules(publish=(DASH_DATE, "as_is")),
    "ctee": SiteRules(publish=(DASH_DATE, "as_is")),
    "thenewslens": SiteRules(publish=(DASH_DATE, "as_is")),
    "businessToday": SiteRules(publish=(DASH_DATE, "as_is")),
    "pixnet": SiteRules(publish=(DASH_DATE, "as_is")),
    "ftvtv": SiteRules(publish=(DASH_DATE, "as_is")),
    "chinatimes": SiteRules(publish=(DASH_DATE, "as_is")),
}


def register_site(name: str, rules: SiteRules) -> None:
    """Plug in (or replace) the rules of one site."""
    _REGISTRY[name] = rules


class scoped_site:
    """Register rules for the duration of a ``with`` block (expressions built
    inside keep them; the registry is restored afterwards)."""

    def __init__(self, name: str, rules: SiteRules):
        self.name, self.rules, self.old = name, rules, None

    def __enter__(self):
        self.old = _REGISTRY.get(self.name)
        _REGISTRY[self.name] = self.rules
        return self

    def __exit__(self, *exc):
        if self.old is None:
            _REGISTRY.pop(self.name, None)
        else:
            _REGISTRY[self.name] = self.old
        return False


def registered_sites() -> dict[str, SiteRules]:
    return dict(_REGISTRY)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(content: Column, patterns) -> Column:
    for p in patterns:
        content = cut(content, p)
    return content


def clean_common(content) -> Column:
    return _chain(_c(content), COMMON_CUTS)


def clean_content(site, content) -> Column:
    """Base cleaning: the common cuts, then the site's first-level cuts."""
    site, base = _c(site), clean_common(content)
    expr = None
    for name, pats in BASE_SITE_CUTS.items():
        branch = _chain(base, pats)
        expr = F.when(site == name, branch) if expr is None else expr.when(site == name, branch)
    return expr.otherwise(base)


def _site_level(content: Column, rules: SiteRules) -> Column:
    out = _chain(content, rules.steps)
    if rules.content_fn is not None:
        out = rules.content_fn(out)
    if rules.collapse:
        out = collapse_and_strip(out)
    return out


def _grouped(key_fn) -> list:
    """Sites grouped by identical rules: [(rules, [site, ...])] in registry order,
    so the compiled CASE has one branch per distinct rule set."""
    groups: dict = {}
    for name, rules in _REGISTRY.items():
        k = key_fn(rules)
        if k is None:
            continue
        groups.setdefault(k, (rules, []))[1].append(name)
    return list(groups.values())


def _content_key(r: SiteRules):
    if not r.steps and not r.collapse and r.content_fn is None:
        return None
    return (tuple(r.steps), r.collapse, id(r.content_fn) if r.content_fn else None)


def site_level(site, base) -> Column:
    """Second-level rules applied to already base-cleaned content."""
    site, base = _c(site), _c(base)
    expr = None
    for rules, names in _grouped(_content_key):
        branch = _site_level(base, rules)
        cond = site.isin(*names)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return base if expr is None else expr.otherwise(base)


def site_content(site, content) -> Column:
    """Full cleaning: base cleaning, then the site's second-level rules."""
    return site_level(site, clean_content(site, content))


def _override(content: Column, publish) -> Column:
    pattern, mode = publish
    hit = first_match(content, pattern)
    if mode == "add_seconds":
        return F.concat(F.translate(hit, "/", "-"), F.lit(":00"))
    if mode == "as_is":
        return F.translate(hit, "/", "-")
    if mode == "parse":
        ts = F.try_to_timestamp(hit, F.lit("yyyy/M/d H:m"))
        return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    raise ValueError(mode)


def site_publish_from(site, base, full) -> Column:
    """Publish time: the site's own match in the fully cleaned text, else the
    base extraction from the base-cleaned text (the fetcher's order)."""
    site, base_pt = _c(site), publish_time_extract(_c(base))
    full = _c(full)
    expr = None
    for rules, names in _grouped(lambda r: r.publish):
        branch = F.coalesce(_override(full, rules.publish), base_pt)
        cond = site.isin(*names)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return base_pt if expr is None else expr.otherwise(base_pt)


def site_publish_time(site, content) -> Column:
    base = clean_content(site, content)
    return site_publish_from(site, base, site_level(site, base))


def site_category(site, url) -> Column:
    site, url = _c(site), _c(url)
    expr = None
    for name, rules in _REGISTRY.items():
        if rules.category is None:
            continue
        branch = first_match(url, rules.category)
        expr = F.when(site == name, branch) if expr is None else expr.when(site == name, branch)
    return F.lit(None).cast("string") if expr is None else expr


# ------------------------------------------------------------ staged form
# The Column functions above nest every step inside one expression.  For large
# texts the staged form below is faster: each step is its own projection over
# a column, guarded by a substring test for the pattern's literal start (rows
# without it skip the regex and its string decoding).  Each projection refers
# to the previous column by name, so the plan grows linearly with the steps.

def _stage(df, col: str, pattern: str, cond: Column | None = None):
    from ..functions.text import java, literal_prefix
    c = F.col(col)
    lit = literal_prefix(pattern)
    guard = F.contains(c, F.lit(lit)) if lit else F.lit(True)
    if cond is not None:
        guard = cond & guard
    return df.withColumn(col, F.when(guard, F.regexp_replace(c, java(pattern), "")).otherwise(c))


def stage_common(df, content: str, out: str):
    df = df.withColumn(out, F.col(content))
    for p in COMMON_CUTS:
        df = _stage(df, out, p)
    return df


def stage_base(df, site: str, content: str, out: str):
    """``out`` = clean_content(site, content), one projection per step."""
    df = stage_common(df, content, out)
    for name, pats in BASE_SITE_CUTS.items():
        for p in pats:
            df = _stage(df, out, p, F.col(site) == name)
    return df


def stage_site_level(df, site: str, base: str, out: str):
    """``out`` = site_level(site, base), one projection per step."""
    df = df.withColumn(out, F.col(base))
    s = F.col(site)
    for rules, names in _grouped(_content_key):
        cond = s.isin(*names)
        for p in rules.steps:
            df = _stage(df, out, p, cond)
        if rules.content_fn is not None:
            df = df.withColumn(out, F.when(cond, rules.content_fn(F.col(out))).otherwise(F.col(out)))
        if rules.collapse:
            df = df.withColumn(out, F.when(cond, collapse_and_strip(out)).otherwise(F.col(out)))
    return df


def stage_clean(df, site: str, content: str, base_out: str = "_base", full_out: str = "_full",
                publish_out: str | None = "publish_time"):
    """Base and site cleaning (and the publish time) as staged projections."""
    df = stage_base(df, site, content, base_out)
    df = stage_site_level(df, site, base_out, full_out)
    if publish_out:
        df = df.withColumn("_base_pt", publish_time_extract(F.col(base_out)))
        s, full, base_pt = F.col(site), F.col(full_out), F.col("_base_pt")
        expr = None
        for rules, names in _grouped(lambda r: r.publish):
            branch = F.coalesce(_override(full, rules.publish), base_pt)
            cond = s.isin(*names)
            expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
        df = df.withColumn(publish_out, base_pt if expr is None else expr.otherwise(base_pt)).drop("_base_pt")
    return df
