"""DuckDB oracle SQL: fixture views and helpers for writing expected results.

The oracle is independent SQL run by DuckDB over the same parquet tables; it
checks the Spark operators.  Fixture views are prepended as CTEs, only those a
query names (with their dependencies).
"""

from __future__ import annotations

import re

from ..operators import rules as R
from ..functions.text import PUBLISH_TIME_PATTERNS

FX = {
    "fx_site": """SELECT site, CASE WHEN n = 19 THEN 18 ELSE n END AS site_id, n AS ord,
  CASE n % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'forum' WHEN 2 THEN 'blog' ELSE 'finance_news' END AS website_category,
  concat('https://www.', site, '.example.com/') AS start_url,
  concat('www.', site, '.example.com') AS domain,
  CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '/en/' ELSE '^https://www[.]src[0-9]+[.]example[.]com/[a-z]+/[0-9]+$' END AS url_pattern,
  n % 3 = 2 AS is_regex,
  CAST(CASE WHEN n % 5 = 0 THEN NULL ELSE 1.5 + n % 4 END AS DOUBLE) AS domain_delay,
  n % 10 = 7 AS extract_only_metadata
FROM (SELECT DISTINCT source AS site, CAST(substr(source, 4) AS INT) AS n FROM documents) t""",
    "fx_article": """SELECT doc_id, source AS site, CAST(substr(source, 4) AS INT) AS site_id, lang AS website_category,
  CASE doc_id % 6 WHEN 0 THEN 'tvbs' WHEN 1 THEN 'udn' WHEN 2 THEN 'setn' WHEN 3 THEN 'ebc' WHEN 4 THEN 'ctee' ELSE 'other' END AS rule_site,
  concat('https://www.', source, '.example.com/', lang, '/', doc_id, CASE WHEN doc_id % 4 = 0 THEN '?page=1' ELSE '' END) AS url,
  split_part(text, chr(10), 1) AS title,
  concat(CASE doc_id % 5 WHEN 0 THEN '2024-01-05 10:20 ' WHEN 1 THEN '2024/02/06 11:21:31 ' WHEN 2 THEN '2024.03.07 12:22 ' WHEN 3 THEN '2024/3/8 9:05 ' ELSE '' END,
    text,
    CASE doc_id % 7 WHEN 0 THEN concat(chr(10), '影音推薦 tail', chr(10)) WHEN 1 THEN concat(chr(10), '分享  推薦 x', chr(10), 'y')
      WHEN 2 THEN concat(chr(10), '相關新聞：tail') WHEN 3 THEN concat(chr(10), '延伸閱讀：tail', chr(10), chr(10), 'z')
      WHEN 4 THEN ' 三立新聞網 記者王小明／台北報導 body' WHEN 5 THEN ' 加入會員 a 閱讀無上限 b' ELSE '' END) AS content,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat(lang, ',', source) END AS keywords,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '7' MINUTE AS scraped_time
FROM documents""",
    "fx_fetch": """SELECT event_id, ts, concat('www.src', user_id % 20, '.example.com') AS domain, concat('src', user_id % 20) AS site,
  concat('https://www.src', user_id % 20, '.example.com/a/', event_id % 50) AS url,
  CAST(event_id % 3 AS INTEGER) AS depth,
  event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN 200 ELSE CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE NULL END END AS status_code,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'JSONDecodeError' WHEN 2 THEN 'OSError' ELSE 'SSLError' END END AS error_name,
  props
FROM events""",
    "fx_existing": "SELECT url FROM fx_article WHERE doc_id % 3 = 0",
    "fx_edge": """SELECT DISTINCT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem WHERE l_linenumber % 2 = 1
UNION SELECT DISTINCT concat('s', l_suppkey), concat('p', l_partkey) FROM lineitem WHERE l_linenumber % 2 = 0""",
    "fx_snapshot": "SELECT conv_id AS page_key, turn AS seq, text AS element_text FROM conversations",
    "fx_link": """SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href,
  concat(regexp_extract(url, '^([a-z]+)://', 1), '://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), href) AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages) t""",
    "fx_message": "SELECT event_id, ts, CASE WHEN event_id % 10 = 0 THEN '  ' ELSE props END AS value FROM events",
    "fx_failure": """SELECT event_id, url,
  concat(coalesce(error_name, 'HTTPError'), ' while fetching ', url, ' (event ', CAST(event_id AS VARCHAR), ', props ', coalesce(props, ''), ')') AS reason,
  CASE WHEN status_code IS NOT NULL THEN CAST(status_code AS VARCHAR) WHEN error_name IS NOT NULL THEN 'Exception' ELSE 'Unknown' END AS status_code,
  ts AS failed_time
FROM fx_fetch WHERE NOT success""",
    "fx_failed": """SELECT left(url, 255) AS url_key,
  arg_min(url, (failed_time, event_id)) AS url,
  arg_max(reason, (failed_time, event_id)) AS reason,
  arg_max(status_code, (failed_time, event_id)) AS status_code,
  max(failed_time) AS failed_time,
  CAST(count(*) - 1 AS INTEGER) AS retry_count,
  min(failed_time) AS created_at
FROM fx_failure GROUP BY left(url, 255)""",
}

RECURSIVE_FX: set[str] = set()


def _deps(sql: str) -> list[str]:
    found = []
    for name in FX:
        if re.search(r"\b" + name + r"\b", sql):
            found.append(name)
    return found


def with_fixtures(sql: str) -> str:
    """Prepend the fixture CTEs that ``sql`` uses (transitively, in dependency order)."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for d in _deps(FX[name]):
            if d != name:
                visit(d)
        order.append(name)

    for n in _deps(sql):
        visit(n)
    if not order:
        return sql
    body = sql.lstrip()
    recursive = body[:14].upper().startswith("WITH RECURSIVE")
    ctes = ",\n".join(f"{n} AS ({FX[n]})" for n in order)
    if not recursive and RECURSIVE_FX.intersection(order):
        if body[:4].upper() == "WITH":
            return "WITH RECURSIVE " + ctes + ",\n" + body[4:].lstrip()
        return "WITH RECURSIVE " + ctes + "\n" + body
    if recursive:
        return "WITH RECURSIVE " + ctes + ",\n" + body[len("WITH RECURSIVE"):].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + ctes + ",\n" + body[4:].lstrip()
    return "WITH " + ctes + "\n" + body


# ------------------------------------------------------- regex translation
# Python-syntax pattern -> RE2 for DuckDB.  \s is widened to Python's
# Unicode whitespace, \d to Unicode digits, and a trailing '.*?$' keeps the
# final newline that Python's '$' stops before.

_WS = r"\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}"


def re2(pattern: str) -> tuple[str, str]:
    """(RE2 pattern, replacement) for removing matches of a Python pattern."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nx = pattern[i + 1]
            if nx == "s":
                out.append(_WS if in_class else "[" + _WS + "]")
                i += 2
                continue
            if nx == "d":
                out.append(r"\p{Nd}")
                i += 2
                continue
            if nx == "u":
                out.append(r"\x{" + pattern[i + 2:i + 6] + "}")
                i += 6
                continue
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    body = "".join(out)
    if body.endswith(".*?$"):
        return "(?s)" + body[:-1] + "(\n?)$", "\\1"
    return "(?s)" + body, ""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_cut(expr: str, pattern: str) -> str:
    p, rep = re2(pattern)
    return f"regexp_replace({expr}, {sql_str(p)}, {sql_str(rep)}, 'g')"


def d_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str('^[' + _WS + ']+|[' + _WS + ']+$')}, '', 'g')"


def d_collapse(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str('(?s)' + chr(10) + '[' + _WS + ']*' + chr(10))}, " \
           f"{sql_str(chr(10) * 2)}, 'g')"


def d_chain(expr: str, patterns) -> str:
    for p in patterns:
        expr = d_cut(expr, p)
    return expr


def d_clean_common(expr: str) -> str:
    return d_chain(expr, R.COMMON_CUTS)


def d_clean_content(site: str, expr: str) -> str:
    base = d_clean_common(expr)
    parts = [f"WHEN {site} = {sql_str(n)} THEN {d_chain(base, pats)}" for n, pats in R.BASE_SITE_CUTS.items()]
    return "CASE " + " ".join(parts) + f" ELSE {base} END"


def _in(site: str, names) -> str:
    return f"{site} IN (" + ", ".join(sql_str(n) for n in names) + ")"


def d_site_level(site: str, base: str) -> str:
    parts = []
    for rules, names in R._grouped(R._content_key):
        out = d_chain(base, rules.steps)
        if rules.collapse:
            out = d_strip(d_collapse(out))
        parts.append(f"WHEN {_in(site, names)} THEN {out}")
    return "CASE " + " ".join(parts) + f" ELSE {base} END"


def d_first(expr: str, pattern: str) -> str:
    p, _ = re2(pattern)
    return f"nullif(regexp_extract({expr}, {sql_str(p)}, 1), '')"


def d_publish_extract(expr: str) -> str:
    hit = "coalesce(" + ", ".join(d_first(expr, p) for p in PUBLISH_TIME_PATTERNS) + ")"
    norm = f"translate({hit}, '/.', '--')"
    return f"CASE WHEN length({norm}) = 16 THEN concat({norm}, ':00') ELSE {norm} END"


def d_override(expr: str, publish) -> str:
    pattern, mode = publish
    hit = d_first(expr, pattern)
    if mode == "add_seconds":
        return f"(replace({hit}, '/', '-') || ':00')"
    if mode == "as_is":
        return f"replace({hit}, '/', '-')"
    if mode == "parse":
        return f"strftime(try_strptime({hit}, '%Y/%m/%d %H:%M'), '%Y-%m-%d %H:%M:%S')"
    raise ValueError(mode)


def d_site_publish(site: str, base: str, full: str) -> str:
    base_pt = d_publish_extract(base)
    parts = [f"WHEN {_in(site, names)} THEN coalesce({d_override(full, r.publish)}, {base_pt})"
             for r, names in R._grouped(lambda r: r.publish)]
    return "CASE " + " ".join(parts) + f" ELSE {base_pt} END"


# The character references that occur in the pages (``&amp;`` last).
PAGE_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                   ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


def d_unescape(expr: str) -> str:
    for ent, ch in PAGE_REFERENCES:
        expr = f"replace({expr}, {sql_str(ent)}, {sql_str(ch)})"
    return expr
