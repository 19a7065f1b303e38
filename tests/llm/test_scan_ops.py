"""License scan, language ID, token counts, packing: brute force and edges."""

import collections
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import catalog, packing
from pagewright.llm.langid import ContextTrees, fit, identify
from pagewright.llm.licenses import BASE_PHRASES, NOTICES, NoticeSearch, fold, scan_licenses, seeds_of
from pagewright.llm.packing import Packer, pack
from pagewright.llm.tokencount import LongestMatch, count_tokens, load_vocabulary
from odd_rows import nothing, odd  # noqa: F401

SF001 = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


def test_license_query_against_words(spark):
    docs = texts_of(spark)
    for r in catalog.op1_license_scan(spark, SF001).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in BASE_PHRASES for i in range(len(words))
                  if words[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_license_edits_and_spans():
    search = NoticeSearch()
    got = search.scan("Foo. Permision is hereby granted, free of chrge, to any person obtaining a copy of it; bar")
    assert got["labels"] == "mit" and got["n_base"] == 0
    assert [(s["first"], s["last"], s["edits"]) for s in got["spans"]] == [(1, 13, 2)]
    assert search.scan("MIT\nLicense, mit-license")["n_base"] == 2
    assert search.scan("submit license")["n_base"] == 0
    assert search.scan("Licensed under CC BY-SA 4")["labels"] == "cc-by-sa"
    for notice, _ in NOTICES:  # the pieces make up the notice
        k = max(1, len(notice) // 10)
        assert "".join(p for _, p in seeds_of(notice, k)) == notice and len(seeds_of(notice, k)) == k + 1


def test_language_held_out(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = catalog.op7_language_id(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    good = [docs[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"] and docs[r["doc_id"]]]
    assert np.mean(good) > 0.97


def test_code_length_against_plain_ppm():
    """Code lengths equal a direct PPM computation over context counts."""
    samples = {"x": ["abra cadabra", "abba"], "y": ["zebra bar"]}
    order, text = 2, "cab zab"
    trees = ContextTrees(samples, order)

    def framed(t):
        return b"\0" * order + b" " + t.encode() + b" "

    for j, lang in enumerate(trees.langs):
        count = collections.Counter()
        for t in samples[lang]:
            s = framed(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    count[s[i - k:i], s[i]] += 1
        total, s = 0.0, framed(text)
        for i in range(order, len(s)):
            for k in range(order, -2, -1):
                if k < 0:
                    total += 8
                    break
                seen = {b: c for (ctx, b), c in count.items() if ctx == s[i - k:i]}
                n, q = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total -= np.log2(seen[s[i]] / (n + q))
                    break
                if q:
                    total -= np.log2(q / (n + q))
        assert trees.code_lengths([text])[0][0][j] == pytest.approx(total, rel=1e-4)


def test_longest_match_against_greedy():
    def greedy(word, pieces):
        n = 0
        while word:
            size = max((len(p) for p in pieces if word.startswith(p)), default=1)
            word, n = word[size:], n + 1
        return n

    rng = np.random.default_rng(3)
    for _ in range(30):
        pieces = {bytes(rng.choice(list(b"abc"), rng.integers(1, 7))) for _ in range(rng.integers(1, 40))}
        automaton = LongestMatch(pieces)
        for _ in range(60):
            word = bytes(rng.choice(list(b"abcd"), rng.integers(0, 20)))
            assert automaton.count(word) == greedy(word, pieces)


def test_token_counts_against_greedy(spark):
    vocabulary = load_vocabulary(catalog.tokenizer_path("piece_bpe_32k.model"))
    known, longest = set(vocabulary), max(map(len, vocabulary))

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), at + 1)
            at, n = end, n + 1
        return n

    docs = texts_of(spark)
    for r in catalog.op10_token_counts(spark, SF001).filter("doc_id % 5 = 0").collect():
        words = docs[r["doc_id"]].split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(greedy(("▁" + w).encode()) for w in words)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer_path("word_bpe_49k.json"))
    docs, pieces, sequences = texts_of(spark), collections.defaultdict(list), collections.defaultdict(list)
    for r in catalog.op3_packing(spark, SF001).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for d, text in docs.items():
        ids, at = tokenizer.encode(text, add_special_tokens=False).ids + [2], 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all


def plain_distances(notice, text):
    """Least edit distance of the notice to any part of the text that ends at
    each place."""
    column = list(range(len(notice) + 1))
    out = []
    for c in text:
        before, column = column, [0]
        for j, x in enumerate(notice):
            column.append(min(before[j] + (c != x), before[j + 1] + 1, column[j] + 1))
        out.append(column[-1])
    return out


def test_notices_against_all_places():
    """Every text that holds a notice within its edits gives a span of it, with
    the fewest edits there; others give none."""
    rng = random.Random(4)
    notices = (("all rights reserved", "rights"), ("this file is in the public domain", "public"))
    search = NoticeSearch(notices, (("odd phrase", "odd"),))
    for _ in range(300):
        notice, label = rng.choice(notices)
        own = list(notice)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(own))
            rng.choice([lambda: own.pop(at), lambda: own.insert(at, rng.choice("abx ")),
                        lambda: own.__setitem__(at, rng.choice("abx"))])()
        text = fold("".join(rng.choice("ab dr") for _ in range(rng.randrange(0, 30))) + " " + "".join(own) + " zz zz")
        best = min(plain_distances(notice, text.decode("latin-1")))
        allowed = len(notice) // 10
        got = [x for x in search.spans(text) if notices[x[2]][1] == label]
        assert bool(got) == (best <= allowed), (text, best)
        if got:
            assert min(x[3] for x in got) == best
            assert all(x[3] == min(plain_distances(notice, text[x[0]:x[1]].decode("latin-1"))) for x in got)
    both = search.scan("all rights reservxd all rights reserved, an odd phrase")
    assert [(x["first"], x["edits"]) for x in both["spans"]] == [(0, 1), (3, 0)]
    assert both["base_labels"] == "odd" and both["n_base"] == 1


def test_near_misses_of_notices_are_cheap():
    import time
    search = NoticeSearch()
    for text in ("permission is hereby granted free " * 500, "gnu general public licens " * 4000):
        began = time.process_time()
        search.scan(text)
        assert time.process_time() - began < 8


def test_word_ids_equal_the_tokenizer():
    """On every letter that normalises to more than letters, and on random
    strings of letters, marks, punctuation and blanks of all scripts."""
    words = packing.WordIds(catalog.tokenizer_path("word_bpe_49k.json"))

    def plain(texts):
        return [np.array([*e.ids, 2], dtype="<u4").tobytes()
                for e in words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalnum()]
    odd_letters = [c for c in every if not unicodedata.normalize("NFC", c).lower().isalnum()]
    assert "\u0130" in odd_letters and len(odd_letters) > 50
    texts = [t for c in odd_letters for t in (c, f"{c}.", f"{c}, x", f"a{c}!b", f"{c}'s", f"({c})")]
    texts += ["T\u0308 x", "aT\u0308.", "H\u0331, W\u030a; Y\u030a J\u030c!"]
    assert words(texts) == plain(texts)
    rnd = random.Random(1)
    latin = [chr(i) for i in [*range(32, 0x250), *range(0x300, 0x370), *range(0x370, 0x530)]]
    letters = latin + odd_letters + list(" .,!'-_<|>\n\t\r") * 40
    wide = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    for _ in range(100):
        texts = ["".join(rnd.choice(letters if rnd.random() < 0.7 else wide) for _ in range(rnd.randrange(1, 14)))
                 for _ in range(1000)]
        assert words(texts) == plain(texts)


def test_packer_tiers_and_steps():
    packer = Packer((4, 8, 16))
    done = packer.take([(i, b"\1\0\0\0" * n) for i, n in enumerate([40, 3, 9, 7, 1, 1, 12, 2, 5])])
    assert all(sum(p.length for p in w) in (4, 8, 16) for w in done)
    left = packer.rest()
    assert sum(p.length for w in done + left for p in w) == 80
    assert all((n := sum(p.length for p in w)) & (n - 1) == 0 for w in left)


@pytest.mark.parametrize("which", ["licenses", "tokens", "packing", "language"])
def test_odd_rows(spark, odd, nothing, which):
    run = {"licenses": scan_licenses, "tokens": lambda d: count_tokens(d, [b"a", b"wor", "▁word".encode()]),
           "packing": lambda d: pack(d, catalog.tokenizer_path("word_bpe_49k.json")),
           "language": lambda d: identify(d, fit(d))}[which]
    assert run(nothing).collect() == []
    rows = run(odd).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r.asDict())
    assert set(by) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert len(by[6]) == (2 if which != "packing" else len(by[6]))
    if which == "licenses":
        assert by[2][0]["n_words"] == 0 and by[2][0]["score"] == 0 and by[2][0]["first_word"] is None
        assert by[7][0]["n_words"] == 100_000
    if which == "tokens":
        assert by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == by[4][0]["n_tokens"] == 0
        assert by[9][0]["n_tokens"] == 1
    if which == "packing":
        assert sum(r["length"] for r in by[2]) == 1 and sum(r["length"] for r in by[6]) == 2 * by[6][0]["doc_tokens"]
    if which == "language":
        assert [by[i][0]["lang_pred"] for i in (2, 3, 4, 5)] == ["und"] * 4
        assert by[1][0]["lang_pred"] == "en" and by[7][0]["lang_pred"] == "en"  # the only language learned
        none = identify(odd, fit(odd.withColumn("lang", F.lit(None).cast("string")))).collect()
        assert {r["lang_pred"] for r in none} == {"und"}
