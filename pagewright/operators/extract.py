"""Field extraction from HTML with CSS selectors, per site spec.

Pages are joined to their site's selector spec (a small, broadcast table) and
parsed partition by partition with ``mapInPandas``: the stdlib HTML parser
builds a light element tree, and a small selector matcher supports tag,
``.class`` chains, ``#id``, attribute tests, ``:nth-child(an+b)``, first and
last child, escaped characters, the descendant and ``>`` combinators and lists;
any other selector raises an error.  Texts of all matches of a ``multiple`` field are joined with a
newline.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import broadcast_bounded

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# elements whose start closes an open <p> (HTML's implied end tag)
CLOSES_P = {"p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "footer", "nav", "aside", "main", "blockquote", "pre", "form", "hr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "texts", "place", "order")

    def __init__(self, tag, attrs, parent, order=0):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children, self.texts = [], []
        self.place = len(parent.children) + 1 if parent else 1  # among its siblings
        self.order = order

    def text(self) -> str:
        """All text below the node, in order (a stack, so depth costs no recursion)."""
        out, todo = [], [self]
        while todo:
            piece = todo.pop()
            if isinstance(piece, str):
                out.append(piece)
            else:
                todo.extend(reversed(piece.texts))
        return "".join(out)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root
        self.skip = self.count = 0

    def _add(self, tag, attrs):
        self.count += 1
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur, self.count)
        self.cur.children.append(node)
        self.cur.texts.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p", stop_at_block=True)
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.cur = node
        if tag in ("script", "style"):
            self.skip += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def _close(self, tag, stop_at_block=False):
        n = self.cur
        while n is not None and n.tag != "#root":
            if n.tag == tag:
                self.cur = n.parent
                return
            if stop_at_block and n.tag != "p" and n.tag not in ("b", "i", "em", "strong", "span", "a"):
                return
            n = n.parent

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            self.cur.texts.append(data)


_NAME = r"(?:\\.|[^\s.#\[:>,()\\])+"
_SIMPLE = re.compile(
    rf"""(?P<tag>^(?:\*|{_NAME}))|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]*)\s*)?\]
    |:(?P<pseudo>first-child|last-child|nth-child\((?P<nth>[^)]*)\))""", re.X)
_ATTRIBUTE_TESTS = {
    None: lambda have, want: True, "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(), "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: bool(want) and have.startswith(want), "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have}


def _nth(text: str) -> tuple[int, int]:
    """'2n+1', 'odd', 'even', '3', 'n' -> (a, b) of a*n + b."""
    t = text.replace(" ", "").lower()
    t = {"odd": "2n+1", "even": "2n"}.get(t, t)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", t)
    if not m:
        raise ValueError(f"unsupported :nth-child({text})")
    if m.group(3):
        return 0, int(m.group(3))
    a = m.group(1)
    return (int(a + "1") if a in ("", "+", "-") else int(a)), int(m.group(2) or 0)


def _parse_compound(s: str) -> list:
    """Tests of one compound selector, such as div.a#x[id^=y]:nth-child(2n+1)."""
    tests, at = [], 0
    while at < len(s):
        m = _SIMPLE.match(s, at)
        if not m or m.end() == at:
            raise ValueError(f"unsupported selector {s!r}")
        at = m.end()
        plain = lambda x: re.sub(r"\\(.)", r"\1", x)
        if m["tag"]:
            tests.append(("tag", m["tag"].lower()))
        elif m["cls"]:
            tests.append(("class", plain(m["cls"])))
        elif m["id"]:
            tests.append(("id", plain(m["id"])))
        elif m["attr"]:
            val = m["val"] or ""
            tests.append(("attr", m["attr"].lower(), m["op"], val[1:-1] if val[:1] in "\"'" and val else val))
        elif m["pseudo"] == "last-child":
            tests.append(("last",))
        else:
            tests.append(("nth", *_nth(m["nth"] or "1")))
    return tests


def _parse_selector(sel: str) -> list:
    """Selector list -> alternatives, each a list of (combinator, tests).
    An unsupported selector raises ValueError."""
    out = []
    for one in re.split(r",(?![^\[(]*[\])])", sel):
        parts, comb = [], " "
        for m in re.finditer(r"\s*(>)\s*|(\s+)|((?:\\.|\[[^\]]*\]|\([^)]*\)|[^\s>])+)", one.strip()):
            if m.group(1):
                comb = ">"
            elif m.group(3):
                parts.append((comb, _parse_compound(m.group(3))))
                comb = " "
        if not parts:
            raise ValueError(f"empty selector {sel!r}")
        out.append(parts)
    return out


def check_spec(spec: dict) -> dict:
    """Parse every selector of a spec, so that a bad one fails before any job."""
    _parse_selector(spec.get("baseSelector") or "*")
    for f in spec.get("fields", []):
        _parse_selector(f["selector"])
    return spec


def _matches(node: _Node, tests: list) -> bool:
    for t in tests:
        kind = t[0]
        if kind == "tag":
            ok = t[1] == "*" or node.tag == t[1]
        elif kind == "class":
            ok = t[1] in node.attrs.get("class", "").split()
        elif kind == "id":
            ok = node.attrs.get("id") == t[1]
        elif kind == "attr":
            ok = t[1] in node.attrs and _ATTRIBUTE_TESTS[t[2]](node.attrs[t[1]], t[3])
        else:
            place = node.place
            if kind == "last":
                ok = place == len(node.parent.children)
            else:
                a, b = t[1], t[2]
                ok = place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0
        if not ok:
            return False
    return True


def _descendants(node: _Node) -> Iterator[_Node]:
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        yield n
        todo.extend(reversed(n.children))


def _select(root: _Node, alternatives: list) -> list:
    """Matching nodes below ``root`` in page order."""
    found: dict[int, _Node] = {}
    for parts in alternatives:
        current = [root]
        for comb, tests in parts:
            hits: dict[int, _Node] = {}
            for n in current:
                # below a node that stands under another of the list nothing new is found
                for c in n.children if comb == ">" else _descendants(n):
                    if id(c) not in hits and _matches(c, tests):
                        hits[id(c)] = c
            current = list(hits.values())
        found.update({id(n): n for n in current})
    return sorted(found.values(), key=lambda n: n.order)


def extract_fields(html: str, spec: dict) -> dict:
    """Values of the spec's fields for one page (within the first base element)."""
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    bases = _select(b.root, _parse_selector(spec.get("baseSelector") or "*")) or []
    out = {}
    for f in spec.get("fields", []):
        texts = []
        for base in bases[:1]:
            texts = [m.text() for m in _select(base, _parse_selector(f["selector"]))]
        if f.get("multiple"):
            out[f["name"]] = "\n".join(texts) if texts else None
        else:
            out[f["name"]] = texts[0] if texts else None
    return out


def extract_by_selector(pages: DataFrame, specs: DataFrame | dict, field_names, key: str = "site",
                        html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """pages (id, key, html) x specs (key, spec JSON) -> (id, key, field...).

    ``specs`` is a table of per-site specs (joined on ``key``, size-checked
    broadcast) or one spec dict used for every page (no join).
    """
    from ..session import ship_package
    ship_package(pages.sparkSession)
    names = list(field_names)
    if isinstance(specs, dict):
        j = pages.select(id_col, key, html_col).withColumn("spec", F.lit(json.dumps(check_spec(specs))))
    else:
        j = pages.select(id_col, key, html_col).join(broadcast_bounded(specs.select(key, "spec")), key)
    out_schema = f"{id_col} long, {key} string, " + ", ".join(f"`{n}` string" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = {}
        for pdf in batches:
            rows = []
            for pid, k, html, spec in pdf[[id_col, key, html_col, "spec"]].itertuples(index=False):
                s = cache.get(spec)
                if s is None:
                    s = cache[spec] = json.loads(spec)
                vals = extract_fields(html, s)
                rows.append([pid, k] + [vals.get(n) for n in names])
            yield pd.DataFrame(rows, columns=[id_col, key] + names)

    return j.mapInPandas(run, out_schema)
