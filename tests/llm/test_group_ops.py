"""Near duplicates, decontamination, personal data, chat formatting,
fingerprints, main text and the pipeline: brute force and edges."""

import collections
import hashlib
import html
import json
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import catalog, chatformat, pii
from pagewright.llm.decontam import MultiIndex, find_leaks, report, simhash, weighted_jaccard
from pagewright.llm.htmltree import extract, main_text, parse
from pagewright.llm.iblt import CELLS, compare_versions, differences, likeness, paragraph_digests, sketch
from pagewright.llm.probminhash import (components, near_duplicates, probability_jaccard, signatures,
                                        weighted_shingles)
from pagewright.llm.textkernel import shingle_hashes, word_hashes
from odd_rows import nothing, odd  # noqa: F401

SF001 = "/root/testdata/sf0.001"


def table(spark, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{SF001}/{name}.parquet").collect()]


# ---- near duplicates

def plain_jp(u, v):
    return sum(1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in u.keys() | v.keys())
               for d in u.keys() & v.keys())


def test_probability_jaccard_and_registers():
    rng = np.random.default_rng(5)
    for _ in range(20):
        u = {int(k): float(rng.uniform(1, 4)) for k in rng.choice(60, 30, replace=False)}
        v = {int(k): float(rng.uniform(1, 4)) for k in rng.choice(60, 30, replace=False)}
        arrays = [x for w in (u, v) for x in (np.array(sorted(w), dtype=np.uint64), np.array([w[k] for k in sorted(w)]))]
        assert probability_jaccard(*arrays) == pytest.approx(plain_jp(u, v))
        ptr = np.array([0, 30, 60])
        sig = signatures(ptr, np.concatenate(arrays[::2]) * np.uint64(0x9E3779B97F4A7C15),
                         np.concatenate(arrays[1::2]), 2000)
        assert np.mean(sig[0] == sig[1]) == pytest.approx(plain_jp(u, v), abs=0.05)


def test_size_and_register_bounds_lose_nothing(spark):
    from pagewright.llm.probminhash import _may_reach, marks
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        a = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        keep = int(rng.uniform(0.3, 1) * 200)
        b = np.concatenate([a[:keep], rng.integers(1, 1 << 62, int(rng.uniform(0, 200 - keep + 1))).astype(np.uint64)])
        both = [np.unique(x) for x in (a, b)]
        sig = signatures(np.cumsum([0] + [len(x) for x in both]), np.concatenate(both),
                         np.ones(sum(map(len, both))), 96)
        doc = [(len(x), float(len(x)), 1.0, m.tolist()) for x, m in zip(both, marks(sig))]
        like = len(np.intersect1d(*both)) / len(np.union1d(*both))
        rows.append((like, float(np.mean(sig[0] == sig[1])), *doc))
    kind = "struct<n:bigint,total:double,top:double,marks:array<bigint>>"
    df = spark.createDataFrame(rows, f"like double, est double, x {kind}, y {kind}")
    got = df.withColumn("ok", _may_reach(F.col("x"), F.col("y"), 0.8, 96)).collect()
    assert all(r["ok"] for r in got if r["like"] >= 0.8)
    assert not any(r["ok"] for r in got if r["like"] < 0.4)


def test_near_duplicates_against_all_pairs(spark):
    docs = table(spark)
    ptr, h, w = weighted_shingles([d["text"] or "" for d in docs])
    where = collections.defaultdict(list)
    for i in range(len(docs)):
        for x in h[ptr[i]:ptr[i + 1]].tolist():
            where[x].append(i)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {p for v in where.values() for p in combinations(v, 2)}:
        part = [x[ptr[i]:ptr[i + 1]] for i in (a, b) for x in (h, w)]
        if probability_jaccard(*part) >= 0.8 and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = collections.defaultdict(set)
    for i, d in enumerate(docs):
        want[root(i)].add(d["doc_id"])
    got = collections.defaultdict(set)
    for r in catalog.op4_minhash(spark, SF001).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {min(x): x for x in want.values()} == dict(got)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (30, 25), (25, 22), (22, 30)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, 5: 5, **{i: 22 for i in (22, 25, 30)}}


def test_large_group_of_near_copies(spark):
    """A chain of edits and many copies: one class, without pairs of all."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = list(words)
        own[(i * 7) % 300] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "other " + " ".join(f"v{i}_{j}" for j in range(50))) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == (0 if i < 1000 else i) for i in got) and len(got) == 420


def test_template_crowd(spark):
    """Texts that share a template below 0.8, and pairs above it whose sizes
    lie many members apart; with one register a band, bands hold crowds."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(240):
        own = [f"o{i}x{j}" for j in range(50 + i % 40)]
        rows.append((i, " ".join([f"t{j}" for j in range(240)] + own)))
        want[i] = i  # 236 shingles shared with others, at least 50 and 50 not: 0.71 at most
        if i % 10 == 0:  # the same text and at most 45 words more: 0.86 at least
            rows.append((5000 + i, rows[-1][1] + " " + " ".join(f"p{i}x{j}" for j in range(int(rng.integers(25, 45))))))
            want[5000 + i] = i
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string"), bands=8, rows=1).collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == 264


def crowd(rng, n, size=120):
    """Copies of one text with between none and half of its words replaced."""
    base = [f"b{j}" for j in range(size)]
    rows = []
    for i in range(n):
        own = list(base)
        for j in rng.choice(size, int(rng.integers(0, size // 6)), replace=False):
            own[j] = f"e{rng.integers(0, 400)}"
        rows.append((i, " ".join(own)))
    return rows


def test_crowd_of_edits_against_all_pairs(spark, monkeypatch):
    """Every pair at 0.8 or more is linked, with few of the others verified;
    lists of more than a block's rows too."""
    from pagewright.llm import probminhash
    monkeypatch.setattr(probminhash, "LIST_ROWS", 16)
    verified = []
    plain = probminhash._verified
    monkeypatch.setattr(probminhash, "_verified", lambda p, *a: (verified.append(p.count()), plain(p, *a))[1])
    rows = crowd(np.random.default_rng(7), 260)
    ptr, h, w = weighted_shingles([t for _, t in rows])
    part = [(h[ptr[i]:ptr[i + 1]], w[ptr[i]:ptr[i + 1]]) for i in range(len(rows))]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if probability_jaccard(*part[a], *part[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string"), bands=12, rows=1).collect()}
    assert got == {i: root(i) for i in range(len(rows))}
    assert 1 < len(set(got.values())) and verified[1] < 260 * 259 // 2 // 8


def test_shared_shares_bound_the_likeness():
    """J_P <= 1 / (1/s_u + 1/s_v - 1), and texts lack at least as many
    shingles of each other as parities differ."""
    from pagewright.llm.probminhash import parity_bits, rare_first
    rng = np.random.default_rng(9)
    for _ in range(300):
        pool = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        sets = [np.sort(rng.choice(pool, int(rng.integers(20, 55)), replace=False)) for _ in range(2)]
        weights = [rng.uniform(1, 4, len(x)) for x in sets]
        both = np.intersect1d(*sets)
        s = [w[np.isin(x, both)].sum() / w.sum() for x, w in zip(sets, weights)]
        like = probability_jaccard(sets[0], weights[0], sets[1], weights[1])
        assert like <= 1 / (1 / s[0] + 1 / s[1] - 1) + 1e-9
        ptr = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        bits = parity_bits(ptr, np.concatenate(sets))
        apart = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        assert apart <= len(sets[0]) + len(sets[1]) - 2 * len(both)
        count = rng.integers(0, 50, 1 << 18)
        at, listed, before = rare_first(ptr, np.concatenate(sets), np.concatenate(weights), count, 0.5)
        if like >= 0.5:  # their rarest shared shingle is listed by both
            assert len(np.intersect1d(listed[:at[1]], listed[at[1]:]))
        assert before[0] == 0 and before.max() <= 0.5 + 1e-9


def test_texts_under_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " else"), (8, "alone in all of this"), (2, a)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == [(2, 2), (5, 2), (5, 2), (6, 2), (7, 2), (8, 8)]


# ---- decontamination

def test_multi_index_finds_all():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2 ** 63, 200, dtype=np.uint64)
    queries = prints[:50].copy()
    for i, n in enumerate(rng.integers(0, 30, 50)):
        for b in rng.choice(64, n, replace=False):
            queries[i] ^= np.uint64(1 << int(b))
    got = set(zip(*(x.tolist() for x in MultiIndex(prints).near(queries))))
    assert got == {(q, i) for q in range(50) for i in range(200)
                   if int(queries[q] ^ prints[i]).bit_count() <= 19}


def test_leaks_against_all_windows(spark):
    docs, bench = table(spark), table(spark, "benchmark")
    ip, ih = shingle_hashes(*word_hashes([b["text"] for b in bench]), 5)
    dp, dh = shingle_hashes(*word_hashes([d["text"] or "" for d in docs]), 5)
    want = {}
    for d in range(len(docs)):
        own = dh[dp[d]:dp[d + 1]]
        for i in range(len(bench)):
            item = ih[ip[i]:ip[i + 1]]
            if len(own) and np.isin(own, item).any():
                n = min(len(item), len(own))
                best = max(weighted_jaccard(own[a:a + n], item) for a in range(len(own) - n + 1))
                if best >= 0.8:
                    want[docs[d]["doc_id"], bench[i]["item_id"]] = best
    docs_df = spark.read.parquet(f"{SF001}/documents.parquet")
    leaks = find_leaks(docs_df, spark.read.parquet(f"{SF001}/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks.collect()} == pytest.approx(want) and want
    numbered = docs_df.withColumn("row", F.col("doc_id"))
    rows = report(numbered, leaks.withColumnRenamed("doc_id", "row")).collect()
    assert len(rows) == len(docs) and sum(r["n_items"] for r in rows) == len(want)


def test_leaks_edits_and_short_items(spark):
    item = " ".join(f"word{i}" for i in range(60))
    edit = item.replace("word30", "other")
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (None, item)],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "before " * 50 + edit.upper() + " after" * 70_000 + " " + item), (2, "two; words"),
                                  (3, None), (4, item[:200]), (5, " ".join(item.split()[:52]))],
                                 "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 2) for r in find_leaks(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (5, 1): round(48 / 56, 2)}
    assert simhash(np.array([5], dtype=np.uint64)) == 5


# ---- personal data

def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data_query(spark):
    docs = {d["doc_id"]: d["text"] or "" for d in table(spark)}
    for r in catalog.op5_personal_data(spark, SF001).collect():
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            len(re.findall(f"(?:^|,){k}:", want)) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_personal_data_odd_texts(spark):
    rng = np.random.default_rng(2)
    alphabet = list("0123456789") * 3 + list("+-. ().@ab_ñ漢\n ")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(300)]
    texts += ["a@b.c_d@e.f x@y@z.com a@b..c", "1.2.3.4.5 256.1.1.1 0255.01.1.1 99999999999.1.1.1", "4242 4242-4242 4242",
              "4242  4242 4242 4242", "9" * 30_000, "a" * 30_000 + "@", "+1 " + "." * 20_000, "", None,
              "x😀 me@x.org 4012888888881881", "+1 (222) 333-4444 +49 30 1234567."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("found", F.lit(1))
    df = df.select("doc_id", "text")
    model = pii.fit(df)
    out = pii.find_personal_data(df, model).select("doc_id", "text", pii.listing("base").alias("b"),
                                                   pii.redacted("text", "found").alias("r"))
    for r in out.collect():
        assert r["b"] == base_spans(r["text"] or "")
        if r["text"] is None:
            assert r["r"] is None
        elif not r["b"] and "[" not in r["r"]:
            assert r["r"] == r["text"]


def test_personal_data_model_and_redaction(spark):
    rows = [(i, f"Mail u{i}@x.org, password=ab{i}cd99ef, from 10.0.0.{i} by Dr. John Smith") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pii.find_personal_data(df, pii.fit(df)).select(pii.redacted("text", "found").alias("r")).distinct().collect()
    assert [r["r"] for r in got] == ["Mail [EMAIL], [SECRET], from [IP] by [NAME]"]
    empty = pii.SpanModel([])
    assert empty.prior == 0.5


def test_personal_data_quoted_long_and_digit_poor(spark):
    long = "eyJ" + "aB3x" * 150
    rows = [(i, f'x token = "{i:040x}" y') for i in range(100)]
    rows += [(100, f"token={long} end"), (101, "5 Main Street is home"), (102, "use sk-" + "abcdefgh" * 12 + " now"),
             (103, "AKIA" + "ABCDEFGH" * 2 + " it is"), (104, "ghp_" + "abcdef" * 6 + " is"), (105, "Madame Marie Curie"),
             (106, '{"password": "ab1,cd2;ef"}'), (107, "x token = '" + "a1" * 20 + "'.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = pii.candidates(pii.base_spans(df)).select("doc_id", F.transform("extra", lambda s: s["value"]).alias("v"))
    got = {r["doc_id"]: r["v"] for r in spans.collect()}
    assert all(got[i] == [f'token = "{i:040x}"'] for i in range(100))
    assert got[100] == [f"token={long}"] and got[101] == ["5 Main Street"] and got[105] == ["Madame Marie Curie"]
    assert [got[i] for i in (102, 103, 104)] == [[dict(rows)[i].replace("use ", "").split()[0]] for i in (102, 103, 104)]
    assert got[106] == ['password": "ab1,cd2;ef"'] and got[107] == ["token = '" + "a1" * 20 + "'"]
    clean = {r["doc_id"]: r["r"] for r in pii.find_personal_data(df, pii.fit(df)).select(
        "doc_id", pii.redacted("text", "found").alias("r")).collect()}
    assert all(clean[i] == "x [SECRET] y" for i in range(100)) and clean[100] == "[SECRET] end"


def test_reliabilities_are_recovered():
    """Votes drawn with known reliabilities: the model estimates them, the
    share of true spans and each pattern's posterior as plain EM over single
    spans does, and the classifier follows the truth."""
    rng = np.random.default_rng(12)
    right, n = {"strict": 0.93, "gazetteer": 0.82, "context": 0.74}, 30_000
    true = rng.random(n) < 0.4
    votes = {v: np.where(rng.random(n) < p, 1, -1) * np.where(true, 1, -1) * (rng.random(n) < 0.9)
             for v, p in right.items()}
    digits = np.where(rng.random(n) < np.where(true, 0.8, 0.3), "3", "0")
    count = collections.Counter(zip(*(votes[v].tolist() for v in right), digits.tolist()))
    rows = [{**dict(zip(right, k[:3])), "kind": "secret", "length": "1", "digits": k[3], "edge": "space", "n": c}
            for k, c in count.items()]
    model = pii.SpanModel(rows)
    prior, guess = 0.5, dict.fromkeys(right, 0.75)
    for _ in range(60):  # one span at a time, no prior opinion
        odds = np.log(prior / (1 - prior)) + sum(votes[v] * np.log(guess[v] / (1 - guess[v])) for v in right)
        post = 1 / (1 + np.exp(-odds))
        prior = post.mean()
        guess = {v: np.where(votes[v] > 0, post, 1 - post)[votes[v] != 0].mean() for v in right}
    assert model.prior == pytest.approx(prior, abs=0.02) and prior == pytest.approx(0.4, abs=0.05)
    for v in right:
        assert model.right[v] == pytest.approx(guess[v], abs=0.02)
        assert model.right[v] == pytest.approx(right[v], abs=0.05)
    assert model.weights["digits"]["3"] > 0.5 and model.weights["digits"]["0"] < -0.5
    assert abs(model.weights["edge"]["space"]) < 0.05


def test_running_values(spark):
    rng = np.random.default_rng(2)
    rows = [[int(x) for x in rng.integers(0, 100, n)] for n in (0, 1, 63, 64, 65, 200, 4097)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<int>")
    got = df.select("v", pii.running(F.col("v"), lambda x, y: x + y, 0).alias("s"),
                    pii.running(F.col("v"), lambda x, y: F.greatest(x, y), 0).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]
        assert r["m"] == [max([0, *r["v"][:i]]) for i in range(len(r["v"]))]


def test_candidates_apart_from_base_spans(spark):
    rng = np.random.default_rng(3)
    kind = "array<struct<start:int,end:int,value:string>>"
    rows = []
    for _ in range(60):
        spans = [sorted((int(a), int(a + n), "v") for a, n in zip(rng.integers(0, 300, k), rng.integers(1, 30, k)))
                 for k in rng.integers(0, 25, 2)]
        rows.append(tuple(spans))
    df = spark.createDataFrame(rows, f"spans {kind}, base {kind}")
    for r in df.withColumn("got", pii._apart(F.col("spans"), F.col("base"))).collect():
        want = [s for s in r["spans"] if not any(b["start"] < s["end"] and s["start"] < b["end"] for b in r["base"])]
        assert sorted(map(tuple, r["got"])) == sorted(map(tuple, want))


def test_many_spans_in_one_text(spark):
    """Four times the spans take little more than four times as long, and all
    are found and replaced, behind characters of every width."""
    import time
    took = []
    for n in (16_000, 64_000):
        text = "é漢\U0001F600 " + " ".join(f"a{i}@b.org" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        model = pii.SpanModel([])
        began = time.time()
        out = pii.find_personal_data(df, model).select("text", "n_email", pii.redacted("text", "found").alias("r")).collect()
        took.append(time.time() - began)
        assert out[0]["n_email"] == n and out[0]["r"] == "é漢\U0001F600 " + " ".join(["[EMAIL]"] * n)
    assert took[1] < 4.5 * took[0] + 2


# ---- chat formatting

def test_chat_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "a</s>"}, {"role": "assistant", "content": "b\\n"}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "[INST]"}], "extra": None},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "[INST]"}]},
               {"turns": [{"speaker": "user", "text": None}]},
               {"prompt": '[{"x": 1}]', "completion": "<\\s>"}, {"instruction": "i", "input": "", "output": "o"},
               {"question": "?", "answer": "!"}, {"odd": {"deep": 1}}, [], None]
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(records)],
                               "id int, record string")
    out = {r["id"]: r for r in chatformat.format_records(df).withColumn(
        "back", chatformat.read_back(F.col("formatted"))).collect()}
    assert [out[i]["layout"] for i in range(10)] == [
        "messages", None, "sharegpt", "dialog", "completion", "instruction", "question", None, None, None]
    for i in (0, 2, 3, 4, 5, 6):
        assert [(t["role"], t["text"]) for t in out[i]["turns"]] == [(t["role"], t["text"]) for t in out[i]["back"]]
        assert [t["loss"] for t in out[i]["back"]] == [t["role"] == "assistant" for t in out[i]["turns"]]
    assert [t["role"] for t in out[2]["turns"]] == ["user", "assistant"]


def test_chat_escapes(spark):
    rng = np.random.default_rng(4)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "a", "\n", "</s>", "[INST]"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chatformat.escape(F.col("t")))
    for r in df.withColumn("u", chatformat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"] and not re.search(r"</?s>|\[/?INST\]", r["e"])


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x"), (2, 1, "assistant", ""),
                                (None, 0, "tool\nuse", "y"), (3, 0, "assistant", "z" * 200_000)],
                               "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chatformat.digests(chatformat.format_records(chatformat.as_records(df)), "conv_id")
           .collect()}
    whole = {1: "user\n\nuser\n\n", 2: "\nx\nassistant\n\n", None: "tool\nuse\ny\n", 3: "assistant\n" + "z" * 200_000 + "\n"}
    for i, text in whole.items():
        assert got[i]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[3]["loss_chars"] == 200_000 and got[1]["n_turns"] == 2
    assert chatformat.digests(chatformat.format_records(chatformat.as_records(df.limit(0))), "conv_id").count() == 0


# ---- document fingerprints

def test_differences_against_sets():
    rng = np.random.default_rng(6)
    lines = [f"line number {i}." for i in range(400)]
    a = ["\n".join(rng.choice(lines, rng.integers(0, 300))) for _ in range(60)]
    b = [t if i % 3 == 0 else "\n".join(rng.choice(lines, rng.integers(0, 300))) for i, t in enumerate(a)]
    da, db = paragraph_digests(a), paragraph_digests(b)
    x, y = differences(da, db)
    for i in range(60):
        ca, cb = collections.Counter(a[i].split("\n")), collections.Counter(b[i].split("\n"))
        assert (x[i], y[i]) == (sum(((ca - cb) - collections.Counter([""])).values()),
                                sum(((cb - ca) - collections.Counter([""])).values())) or "" in (a[i], b[i])
    assert (likeness(da, db)[::3] == 1).all()


def plain_likeness(a, b):
    """Shared over all paragraphs, as bags: lines, cut after sentence ends."""
    bags = [collections.Counter(filter(None, re.split(r"\n|(?<=[.!?]) ", t))) for t in (a, b)]
    both, every = sum((bags[0] & bags[1]).values()), sum((bags[0] | bags[1]).values())
    return both / every if every else 1.0


def test_versions_query(spark):
    docs = sorted(table(spark), key=lambda d: -d["doc_id"])
    got = {r["doc_id"]: r for r in catalog.op9_fingerprints(spark, SF001).collect()}
    assert len(got) == len(docs)
    for d, after in zip(docs, docs[1:] + docs[:1]):
        t, r = d["text"] or "", got[d["doc_id"]]
        half = len(t) // 2
        changed = t[:len(t) - half] + (after["text"] or "")[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == changed) or t != changed
        assert r["near_edited"] == pytest.approx(plain_likeness(t, changed))
        assert r["near_next"] == pytest.approx(plain_likeness(t, after["text"] or ""))
    same = collections.defaultdict(set)
    for d in docs:
        same[d["text"]].add(got[d["doc_id"]]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_versions_odd_rows(spark, odd, nothing):
    assert compare_versions(nothing).collect() == [] and sketch(nothing).collect() == []
    got = collections.Counter(r["doc_id"] for r in compare_versions(odd).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 1, 8: 1, 9: 1, None: 1}
    one = compare_versions(odd.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and CELLS % 3 == 0
    assert sketch(odd).count() == 11


# ---- main text

def test_main_text_markup():
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav>menu</nav>"
            "<div class='cookie-notice'>ok?</div><article><header><h1>Head &amp; line</h1></header><p><b>One<br>two"
            "<p>three\n  four&nbsp;five</p><ul><li>a<li>b</ul><form>f<input></form><div id=comments>c</div>"
            "<a title=\"x>y\">link</a> tail</article><footer>&copy;</footer>")
    assert main_text(parse(page)[0], set()) == "Head & line\nOne\ntwo\nthree four five\na\nb\nlink tail"
    assert main_text(parse("a < b")[0], set()) == "a < b" and main_text(parse("")[0], set()) == ""
    assert main_text(parse("<div>x</div><main>y<aside>z</aside></main>")[0], set()) == "y"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p title='open>after"
    assert main_text(parse(deep)[0], set()) == "deep\nafter"


def test_site_tree_removes_repeated_branches(spark):
    rows = [(i, f"https://www.a.org/{i}", f"<body><div class=x1><p>Welcome to our site</p></div><div class=x2>"
             f"<p>Story {i} of the day {i * i}</p></div><div class=x3>All the same</div></body>") for i in range(30)]
    rows += [(100, "https://b.org/", rows[0][2]), (101, None, None), (102, "::", ""), (103, None, "<p>z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert all(got[i] == f"Story {i} of the day {i * i}" for i in range(30))
    assert got[100].count("\n") == 2 and got[101] == got[102] == "" and got[103] == "z"
    assert extract(df.limit(0)).collect() == []


def story(i, body):
    return (i, f"https://www.c.org/{i}", f"<html><body>{body}</body></html>")


def test_tree_decides_inside_and_outside_the_article(spark):
    """A nameless repeated branch inside the article goes, a title and a lead
    outside stay, a menu without a name doesn't, and an article shown under many
    addresses is no template."""
    def page(i):
        return (f"<div>Menu {i % 3} of <a>here</a></div><main><h1>Title {i}</h1><p>Lead {i * 7}</p><article><p>Body {i} is {i * i}.</p>"
                "<section><p>Share this story</p></section></article><div><p>Read more</p></div></main>")

    rows = [story(i, page(i)) for i in range(40)] + [story(100 + i, page(5)) for i in range(60)]
    rows += [(200, "https://few.org/", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for i in range(40):
        assert got[i] == f"Title {i}\nLead {i * 7}\nBody {i} is {i * i}."
    assert {got[100 + i] for i in range(60)} == {got[5]}
    # one page says nothing about its host: the mark of the article stands
    assert got[200] == "Body 0 is 0.\nShare this story"


def test_importance_against_plain_counts(spark):
    """Entropies of layouts and texts over distinct contents, path by path."""
    import math
    from pagewright.llm.htmltree import _prefixes, style_tree
    rng = np.random.default_rng(6)
    pages = []
    for i in range(60):
        extra = "".join(f"<p>{rng.integers(0, 4)}</p><b>x</b>" for _ in range(rng.integers(0, 4)))
        pages.append((i, f"https://h{i % 2}.org/", f"<body><article><h2>{rng.integers(0, 3)}</h2><p>{rng.integers(0, 30)}</p>{extra}"
                                                   f"</article><div class=k>{rng.integers(0, 2)}</div></body>"))
    pages += pages[:7]
    values, done = collections.defaultdict(list), {}
    for _, url, page in pages:
        blocks, children = parse(page)
        level = max(b.article for b in blocks if not b.noise)
        content = (url, "\n".join(b.text for b in blocks if not b.noise and b.article == level))
        nodes = {(path, "p"): "|".join(k for j, k in enumerate(kids) if not j or kids[j - 1] != k)
                 for path, kids in children.items()}
        for b in blocks:
            for path in _prefixes(b.path):
                nodes[path, "c"] = nodes.get((path, "c"), "") + "\n" + b.text
        done.setdefault(content, []).append(nodes)
    ties = [k for k, v in done.items() if any(x != v[0] for x in v)]
    for (url, text), found in done.items():
        for (path, kind), value in found[0].items():
            values[url[8:-1], path, kind].append(value)
    tree = {(r["host"], r["path"]): r for r in style_tree(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"), "url", "html").collect()}
    for (host, path, kind), seen in values.items():
        if ties and "/div.k" in path or path in ("", "/body"):
            continue  # pages of equal content that differ outside it: either may stand for them
        n, row = len(seen), tree[host, path]
        want = -sum(c / n * math.log(c / n) for c in collections.Counter(seen).values()) / math.log(n) if n > 1 else 1.0
        assert row["texts" if kind == "c" else "layouts"] == pytest.approx(want, abs=1e-9)
        assert row["pages"] >= n


def test_main_text_query(spark):
    pages = {p["page_id"]: p["html"] or "" for p in table(spark, "pages")}
    rows = catalog.op6_main_text(spark, SF001).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip()
                 for x in re.split("</?(?:p|h1|br)>", inner)]
        assert r["text"] == "\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


# ---- edges of the others, pipeline

def test_near_duplicates_odd_rows(spark, odd, nothing):
    assert near_duplicates(nothing).collect() == []
    rows = [(r["doc_id"], r["class_id"]) for r in near_duplicates(odd).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (6, 1), (7, 7), (8, 8), (9, 9),
                                            (None, None)], key=str)


def test_leaks_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "A plain text with seven words here.")], "item_id bigint, text string")
    assert find_leaks(nothing, bench).collect() == [] and find_leaks(odd, bench.limit(0)).collect() == []
    assert sorted(r["doc_id"] for r in find_leaks(odd, bench).collect()) == [1, 6, 6]
    twice = bench.unionByName(bench.withColumn("item_id", F.lit(9))).unionByName(bench.withColumn("text", F.lit(None)))
    assert sorted(tuple(r)[:2] for r in find_leaks(odd, twice).collect()) == [(1, 1), (6, 1), (6, 1)]


def test_rows_without_id_and_under_a_shared_id_are_judged_by_their_text(spark, tmp_path):
    """The query's rows and the stage's, on a table of its own."""
    leak, clean = "A plain text with seven words here.", "something else that no benchmark has at all"
    rows = [(None, leak), (None, clean), (5, leak), (5, clean), (6, clean), (6, clean), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("lang", "source", "row", "item_id", "id"):
        docs = docs.withColumn(c, F.lit("x"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.n_items, r.item_ids, r.similarity)
                 for r in catalog.op2_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), int(t == leak), "1" if t == leak else "", float(t == leak)) for i, t in rows)
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(
        map(str, [(i, t) for i, t in rows if t != leak]))


def test_pipeline_stages(spark, odd, tmp_path):
    docs = {d["doc_id"]: d for d in table(spark)}
    frame = spark.read.parquet(f"{SF001}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, frame, SF001).write.parquet(out)
        before, frame = frame, spark.read.parquet(out)
        if name != "packing":
            assert frame.columns == corpus_pipeline.COLUMNS
            assert frame.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if name == "near_dedup":
            assert 0 < frame.count() < before.count()
        if name == "decontamination":
            gone = {r["doc_id"] for r in before.select("doc_id").exceptAll(frame.select("doc_id")).collect()}
            assert gone == {r["doc_id"] for r in find_leaks(before, spark.read.parquet(f"{SF001}/benchmark.parquet"))
                            .collect()}
        if name == "personal_data":
            for r in frame.collect():
                assert base_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
                if base_spans(docs[r["doc_id"]]["text"]) == "" and "[" not in r["text"]:
                    assert r["text"] == docs[r["doc_id"]]["text"]
    assert frame.select("doc_id").distinct().count() == before.count()
    rows = odd.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, SF001).count() > 0
        assert stage(spark, rows.limit(0), SF001).count() == 0


def test_near_dedup_keeps_rows_without_id(spark, odd):
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(9, "another text under the id nine"), (None, "A plain text with seven words here.")],
        "doc_id bigint, text string"))
    for c in ("lang", "source"):
        rows = rows.withColumn(c, F.lit("s"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, rows, SF001).collect()]
    want = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NULL OR doc_id != 6").collect()]
    assert sorted(kept, key=str) == sorted([*want, (9, "another text under the id nine")], key=str)
