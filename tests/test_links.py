from pyspark.sql import functions as F

from pagewright.operators import links as LK

EDGES = [("p1", "s1"), ("p1", "s2"), ("s1", "p2"), ("s2", "p3"), ("p2", "s3"), ("s3", "p1"), ("p3", "s4"),
         ("s4", "p5"), ("p5", "s5"), ("p2", "s2")]


def py_walk(edges, seed, max_depth, max_pages=None):
    seen = {seed: 0}
    frontier = [seed]
    taken = 1
    for d in range(1, max_depth + 1):
        nxt = sorted({b for a, b in edges if a in frontier} - set(seen))
        if max_pages is not None:
            if taken >= max_pages:
                break
            nxt = nxt[:max_pages - taken]
            taken += len(nxt)
        if not nxt:
            break
        for n in nxt:
            seen[n] = d
        frontier = nxt
    return seen


def test_frontier_walk_uncapped_and_capped(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    seeds = spark.createDataFrame([("p1",)], "node string")
    for depth, cap in ((3, None), (6, None), (6, 4), (2, 2)):
        got = {r["node"]: r["depth"] for r in LK.frontier_walk(e, seeds, depth, cap).collect()}
        assert got == py_walk(EDGES, "p1", depth, cap)


def test_site_walks_are_each_sites_own_walk(spark):
    """Walks with budgets and seeds of their own, over shared nodes."""
    import random
    rnd = random.Random(4)
    edges = sorted({(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(150)})
    e = spark.createDataFrame([*edges, *edges[:20]], "src string, dst string")
    seeds = [("a", "n1", None), ("b", "n1", 7), ("b", "n2", 7), ("c", "n5", 1), ("d", "nowhere", 5), ("e", "n9", 30),
             ("e", "n9", 30), ("f", "n3", 0)]
    df = spark.createDataFrame(seeds, "site string, node string, max_pages int")

    def walk(site, depth):
        start = sorted({n for s, n, _ in seeds if s == site})
        limit = next(m for s, _, m in seeds if s == site)
        limit = 10 ** 9 if limit is None else limit
        taken = {n: 0 for n in start[:limit]}
        level = list(taken)
        for d in range(1, depth + 1):
            found = sorted({b for a, b in edges if a in level} - taken.keys())[:limit - len(taken)]
            taken.update({n: d for n in found})
            level = found
        return {(site, n, d) for n, d in taken.items()}

    for depth in (0, 1, 4):
        got = [tuple(r) for r in LK.site_walks(e, df, depth).collect()]
        want = set().union(*[walk(s, depth) for s in "abcdef"])
        assert len(got) == len(want) and set(got) == want
    assert LK.site_walks(e, df.limit(0), 3).count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"


def test_page_links_internal_only(spark):
    html = '<a href="/x">x</a><a href="https://other.com/y">y</a><a href="z?q=1">z</a>'
    p = spark.createDataFrame([(1, "https://site.com/dir/page", html)], "page_id long, url string, html string")
    got = [r["link"] for r in LK.page_links(p).orderBy("pos").collect()]
    assert got == ["https://site.com/x", "https://site.com/dir/z?q=1"]


def test_first_n_and_anti(spark):
    links = spark.createDataFrame([("a", f"u{i}") for i in range(6)] + [("b", "v1")], "site string, url string")
    existing = spark.createDataFrame([("u0",), ("u2",)], "url string")
    new = LK.new_links_anti(links, existing)
    got = sorted((r["site"], r["url"]) for r in LK.frontier_first_n(new, 3).collect())
    assert got == [("a", "u1"), ("a", "u3"), ("a", "u4"), ("b", "v1")]


def test_links_except_is_distinct_except(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "link string")
    right = spark.createDataFrame([("a",), ("d",)], "url string")
    assert sorted(r[0] for r in LK.links_except(left, right).collect()) == ["b", "c"]
    assert sorted(r[0] for r in LK.links_union(left, right).collect()) == ["a", "b", "c", "d"]
