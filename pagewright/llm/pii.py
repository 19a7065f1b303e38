"""Personal data by weak supervision (DataFrame functions only).

Base kinds (email, ip, card, phone) are fixed patterns with checks and always
stay.  Further candidate spans (secrets, numbers, names, addresses) get votes
of three labelers: a strict pattern, a gazetteer of telling words and a context
labeler that reads the characters before the span.  Votes are counted by
pattern over all documents, base spans included; expectation-maximisation on
those counts estimates each labeler's reliability and each pattern's posterior,
and the posteriors train the final span classifier (naive Bayes over the span's
kind, length, digits and neighbour), which decides on every candidate.

Texts are only scanned by the JVM; what reaches the driver is the table of vote
and feature counts, whose size is bounded by the number of their values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns.  The lookbehinds and possessive quantifiers
# select the same leftmost matches without trying every place of a long run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

# Candidate patterns beyond the base, tried in this order.
EXTRA = {
    "secret": r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?"
              r"(?:\"[^\s\"]{4,}+\"?|'[^\s']{4,}+'?|[^\s,;\"']{4,}+)",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "address": r"(?<![0-9])[0-9]{1,5}\x20[A-Z][a-z]{2,20}\x20(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard)\b",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.?\x20"
            r"[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
# Every match of an extra pattern holds a match of this.
_EXTRA_HINT = (r"[0-9]{2}|[=:]\x20?\S{4}|AKIA[A-Z0-9]|gh[pousr]_[A-Za-z0-9]|sk-[A-Za-z0-9]{2}|[0-9]\x20[A-Z][a-z]|"
               r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señora?)[.\x20]")

# Labelers.  Strict pattern of each extra kind.
STRICT = {
    "secret": r"(?i:pass(?:word|wd)?|pwd|secret|token|key)[\"']?\x20?[=:]\x20?(?=[^\s]*[0-9])[^\s]{6,}",
    "key": r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,34}",
    "local_phone": r"\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "address": r"[0-9]{1,5}\x20[A-Z][a-z]+\x20(?:Street|Road|Avenue|Lane|Drive|Boulevard)",
    "name": r"\S+\x20[A-Z][a-z]+\x20[A-Z][a-z]+",
}
# Gazetteer: words inside a span that speak for it.
GAZETTEER = (r"(?i)password|passwd|secret|api.?key|token|example\.(?:com|org|net)|street|avenue|boulevard|"
             r"\b(?:mr|mrs|herr|frau|monsieur|madame)\b|^(?:DE|FR|ES|GB|IT|NL|AT|CH)[0-9]{2}|^AKIA|^\+1 |"
             r"\b(?:anna|james|john|maria|mary|michael|peter|thomas|julia|marie|jean|carlos)\b")
# Context: words shortly before a span.
CONTEXT = (r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|ssn|social|password|login|"
           r"user|address|live[sd]? (?:at|in)|name|ip|host|server)\W{0,4}(?:is|at|to|no|number)?\W{0,4}$")
AGAINST = r"(?i)(?:section|page|version|isbn|figure|table|chapter|vol|article)\W{0,4}$"

_FAR = (1 << 31) - 1
_RANK = {k: i for i, k in enumerate([*BASE, *EXTRA])}
_VOTES = ("strict", "gazetteer", "context")
_FEATURES = ("kind", "length", "digits", "edge")


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _most(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


_RUN_BITS = 6


def running(values: Column, merge, zero) -> Column:
    """For each element of an array of numbers what the elements before it
    merge to.  Runs of 64 are merged first, so the work grows little faster
    than the array (a growing array is copied once for each run)."""
    def run(i):  # where the run of element i begins
        return F.shiftleft(F.shiftright(i, _RUN_BITS), _RUN_BITS) + 1

    def inside(vs):
        last = F.shiftright(F.greatest(F.size(vs) - 1, F.lit(0)), _RUN_BITS)
        runs = F.transform(F.sequence(F.lit(0), last), lambda r: F.aggregate(
            F.slice(vs, F.shiftleft(r, _RUN_BITS) + 1, 1 << _RUN_BITS), F.lit(zero), merge))
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("s"))
        heads = F.aggregate(runs, start, lambda acc, r: F.struct(
            merge(acc["at"], r).alias("at"), F.concat(acc["s"], F.array(acc["at"])).alias("s")), lambda acc: acc["s"])
        return _let(heads, lambda hs: F.transform(vs, lambda v, i: F.aggregate(
            F.slice(vs, run(i), i.bitwiseAND(F.lit((1 << _RUN_BITS) - 1))), hs[F.shiftright(i, _RUN_BITS)], merge)))

    return _let(values, inside)


def find(text: Column, pattern: str, hint: str) -> Column:
    """Spans (start, end, value) of the pattern's matches in code points.

    Splitting gives the gaps between the matches, so that running lengths of
    gaps and matches are the places.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # after the last match the match side is null
    parts = F.filter(F.zip_with(gaps, hits, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("v"))),
                     lambda p: p["v"].isNotNull())

    def spans(ps):
        before = running(F.transform(ps, lambda p: p["gap"] + F.length(p["v"])), lambda x, y: x + y, 0)
        return F.zip_with(ps, before, lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["v"])).alias("end"), p["v"].alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(hint), _let(parts, spans)).otherwise(none)


def _wide(text: Column) -> Column:
    """The text with four bytes for each code point: any part is found at once."""
    return F.encode(text, "UTF-32")


def _part(wide: Column, start: Column, n: Column) -> Column:
    return F.decode(F.substr(wide, start * 4 + 1, n * 4), "UTF-32")


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap no base span; (start, end, value) each, by start.

    All are laid out by their start: a base span that began before reaches in
    if the latest end so far lies beyond the start, one that begins later if
    the next base start lies before the end."""
    def marked(xs, is_base):
        return F.transform(xs, lambda x: F.struct(x["start"], F.lit(0 if is_base else 1).alias("own"), x["end"], x["value"]))

    def inside(xs):
        ends = running(F.transform(xs, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), _most, 0)
        starts = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(_FAR))),
                                   _least, _FAR))
        put = F.zip_with(F.zip_with(xs, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts,
                         lambda y, n: F.struct(y["x"].alias("x"), y["e"].alias("e"), n.alias("n")))
        free = F.filter(put, lambda y: (y["x"]["own"] == 1) & (y["e"] <= y["x"]["start"]) & (y["n"] >= y["x"]["end"]))
        return F.transform(free, lambda y: F.struct(y["x"]["start"], y["x"]["end"], y["x"]["value"]))

    both = F.array_sort(F.concat(marked(base, True), marked(spans, False)))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_let(both, inside))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Luhn sum of the digits is divisible by ten."""
    each = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    twice = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & _luhn(value)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    """Spans that pass the kind's check as (start, rank, kind, end, value)."""
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), lambda s: F.struct(
        s["start"], F.lit(_RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"], s["value"]))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_<kind> for each base kind and ``base``: its checked spans, an
    array of (start, rank, kind, end, value) in order."""
    out = docs
    for kind, pattern in BASE.items():
        out = out.withColumn(f"s_{kind}", _checked(kind, find(F.col(text), pattern, _HINT[kind])))
    lists = [f"s_{k}" for k in BASE]
    out = out.withColumn("base", F.array_sort(F.concat(*lists)))
    for kind in BASE:
        out = out.withColumn(f"n_{kind}", F.size(f"s_{kind}").cast("long"))
    return out.drop(*lists)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``extra``: candidate spans that overlap no base span, with votes
    and features."""
    # one pass for all extra kinds; the first kind whose pattern fits the match names it
    joined = "|".join(f"(?:{p})" for p in EXTRA.values())
    raw = _let(find(F.col(text), joined, _EXTRA_HINT), lambda spans: _apart(spans, F.col("base")))

    def named(s, before):
        kind = None
        for k, p in EXTRA.items():
            fits = s["value"].rlike(rf"^(?:{p})$")
            kind = F.when(fits, k) if kind is None else kind.when(fits, k)
        kind = kind.otherwise("name")
        return F.struct(s["start"], kind.alias("kind"), s["end"], s["value"], before.alias("before"))

    out = docs.withColumn("named", _let(raw, lambda spans: F.zip_with(spans, _contexts(F.col(text), spans), named)))
    return out.withColumn("extra", F.transform("named", lambda s: F.struct(
        s["start"], _rank(s["kind"]).alias("rank"), s["kind"], s["end"], s["value"],
        *_votes(s["kind"], s["value"], s["before"], False), *_features(s["value"], s["before"])))).drop("named")


def _rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), kind)


def _votes(kind: Column, value: Column, before: Column, base: bool) -> list[Column]:
    """1 for, -1 against, 0 no opinion."""
    if base:
        strict = F.lit(1)
    else:
        strict = None
        for k, p in STRICT.items():
            vote = F.when(value.rlike(rf"^(?:{p})$"), 1).otherwise(-1)
            strict = F.when(kind == k, vote) if strict is None else strict.when(kind == k, vote)
        strict = F.coalesce(strict, F.lit(0))
    return [strict.alias("strict"), F.when(value.rlike(GAZETTEER), 1).otherwise(0).alias("gazetteer"),
            F.when(before.rlike(AGAINST), -1).when(before.rlike(CONTEXT), 1).otherwise(0).alias("context")]


def _features(value: Column, before: Column) -> list[Column]:
    share = F.length(_digits(value)) / F.greatest(F.length(value), F.lit(1))
    return [F.least(F.length(value) / 8, F.lit(6)).cast("int").cast("string").alias("length"),
            (share * 4).cast("int").cast("string").alias("digits"),
            F.when(before == "", "start").when(before.rlike(r"\s$"), "space")
            .when(before.rlike(r"[\p{L}\p{N}]$"), "word").otherwise("mark").alias("edge")]


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (votes, features, n) over all spans of all documents."""
    spans = candidates(base_spans(docs.select(F.coalesce(text, F.lit("")).alias("text"))))
    known = F.zip_with("base", _contexts(F.col("text"), F.col("base")), lambda b, before: F.struct(
        b["kind"], *_votes(b["kind"], b["value"], before, True), *_features(b["value"], before)))
    new = F.transform("extra", lambda s: F.struct(*[s[n] for n in ("kind", *_VOTES, "length", "digits", "edge")]))
    keys = [*_VOTES, *_FEATURES]
    both = spans.select(F.explode(F.concat(known, new)).alias("s"))
    return both.select(*[F.col(f"s.{k}") for k in keys]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _contexts(text: Column, spans: Column) -> Column:
    """The (up to) 32 characters before each span."""
    def of(wide):
        return F.transform(spans, lambda s: _part(wide, F.greatest(s["start"] - 32, F.lit(0)), F.least(s["start"], F.lit(32))))

    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(_let(_wide(text), of))


# Prior opinion of a labeler: how often its votes are right, worth this many spans.
_PRIOR_RIGHT, _MOST_RIGHT = 0.75, 0.98
_PRIOR_SPANS = 20.0


class SpanModel:
    """Labeler reliabilities by expectation-maximisation and the span
    classifier they train, from (votes, features, n) counts.

    A labeler that votes is right with a probability of its own; no vote says
    nothing.  Base spans have passed their checks and count as true; whether a
    candidate is true is the hidden variable.
    """

    def __init__(self, rows: list[dict], rounds: int = 30):
        self.prior = 0.5  # of candidates
        self.right = dict.fromkeys(_VOTES, _PRIOR_RIGHT)
        hidden = [r for r in rows if r["kind"] not in BASE]
        for _ in range(rounds):
            post = [self._posterior(r) for r in rows]
            true = sum(self._posterior(r) * r["n"] for r in hidden)
            total = sum(r["n"] for r in hidden)
            self.prior = (true + _PRIOR_SPANS / 2) / (total + _PRIOR_SPANS)
            for v in _VOTES:
                voted = [(p if r[v] > 0 else 1 - p, r["n"]) for p, r in zip(post, rows) if r[v]]
                self.right[v] = min(_MOST_RIGHT, (_PRIOR_SPANS * _PRIOR_RIGHT + sum(p * n for p, n in voted)) / (
                    _PRIOR_SPANS + sum(n for _, n in voted)))
        self.weights: dict[str, dict[str, float]] = {}
        for f in _FEATURES:
            yes: dict[str, float] = {}
            every: dict[str, float] = {}
            for r in hidden:
                yes[r[f]] = yes.get(r[f], 0.0) + self._posterior(r) * r["n"]
                every[r[f]] = every.get(r[f], 0.0) + r["n"]
            n, true = sum(every.values()), sum(yes.values())
            # both sides are smoothed towards the value's overall share
            share = {k: _PRIOR_SPANS * x / n for k, x in every.items()}
            self.weights[f] = {k: round(math.log((yes[k] + share[k]) / (true + _PRIOR_SPANS)) - math.log(
                (every[k] - yes[k] + share[k]) / (n - true + _PRIOR_SPANS)), 6) for k in every}

    def _posterior(self, row: dict) -> float:
        if row["kind"] in BASE:
            return 1.0
        odds = math.log(self.prior / (1 - self.prior)) + sum(row[v] * self._weight(v) for v in _VOTES)
        return 1 / (1 + math.exp(-odds))

    def _weight(self, labeler: str) -> float:
        return math.log(self.right[labeler] / (1 - self.right[labeler]))

    def log_odds(self, span: Column) -> Column:
        """The classifier's log odds of a span: prior, votes, features."""
        total = F.lit(round(math.log(self.prior / (1 - self.prior)), 6))
        for v in _VOTES:
            total = total + span[v] * F.lit(round(self._weight(v), 6))
        for f, weights in self.weights.items():
            table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None
            if table is not None:
                total = total + F.coalesce(F.try_element_at(table, span[f]), F.lit(0.0))
        return total


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Model over all spans of all rows; only counts reach the driver."""
    rows = [r.asDict() for r in vote_counts(docs, text_col).collect()]
    return SpanModel(sorted(rows, key=lambda r: [str(r[k]) for k in (*_VOTES, *_FEATURES)]))


def find_personal_data(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, ``base`` and ``found``: all spans
    (start, rank, kind, end) in order.

    A null or empty text has none; repeated rows are searched each, very long
    texts whole; of equal starts the kinds' order decides; an empty table stays
    empty.  Columns of ``docs`` that bear one of the added names, or one that is
    used here on the way (pii_text, extra, named, s_<kind>), are replaced by it
    or dropped.
    """
    held = docs.withColumn("pii_text", F.coalesce(text_col, F.lit("")))
    out = candidates(base_spans(held, "pii_text"), "pii_text")
    kept = F.transform(F.filter("extra", lambda s: model.log_odds(s) > 0), lambda s: F.struct(
        s["start"], s["rank"], s["kind"], s["end"]))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    return (out.withColumn("base", plain).withColumn("found", F.array_sort(F.concat("base", kept)))
            .drop("extra", "pii_text"))


def listing(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; where spans
    overlap the first one's mark stands for all."""
    def cut(wide):
        def parts(reach):
            # of the spans that begin behind all before them: what lies between, and the mark
            return F.zip_with(spans, reach, lambda s, at: F.when(s["start"] >= at, F.concat(
                _part(wide, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))

        reach = running(F.transform(spans, lambda s: s["end"]), _most, 0)
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(_let(reach, parts), ""),
                        _part(wide, end, F.greatest(F.length(text) - end, F.lit(0))))

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(_let(_wide(F.col(text)), cut))
