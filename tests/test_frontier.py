"""Crawl frontiers within a scope, against a walk in plain Python."""

import random

import pytest
from auditlake.operators import graphs

HOST = "https://s.example"


def walk(seeds, links, max_depth, nofollow, scope):
    """Depths by breadth-first search; links: (src, dst, follow, internal, redirect)."""
    depth, todo = {s: 0 for s in seeds}, sorted(seeds)
    while todo:
        found = {}
        for src, dst, follow, internal, redirect in links:
            if src not in todo or not depth[src] >= 0 or not src.startswith(HOST):
                continue
            if not (follow or nofollow or redirect):
                continue
            if internal:
                if scope.parameters == "strip":
                    dst = dst.split("?")[0]
                if scope.list_mode and not redirect or any(x in dst for x in scope.exclude) or (scope.include and not any(x in dst for x in scope.include)) or (not scope.binaries and dst.endswith(".pdf")):
                    continue
            elif not scope.external:
                continue
            d = depth[src] + (0 if redirect else 1)
            if d <= max_depth and (internal or d <= 1):
                found[dst] = min(d, found.get(dst, d))
        todo = sorted(u for u in found if u not in depth)
        depth |= {u: found[u] for u in todo}
    return depth


@pytest.mark.parametrize("scope", [graphs.Scope(), graphs.Scope(parameters="strip", exclude=("p3",)), graphs.Scope(include=("p1", "p2"), binaries=False), graphs.Scope(list_mode=True), graphs.Scope(external=False, exclude=("p7", "p8"))])
def test_frontier(spark, scope):
    rnd = random.Random(2)
    names = [f"{HOST}/p{i}" for i in range(40)] + [f"{HOST}/p1{i}.pdf" for i in range(4)]
    links = []
    for src in names:
        for _ in range(rnd.randrange(4)):
            internal = rnd.random() < 0.85
            links.append((src, rnd.choice(names) + rnd.choice(["", "?a=1"]) if internal else f"https://x{rnd.randrange(5)}.example/", int(rnd.random() < 0.8), int(internal), int(rnd.random() < 0.15)))
    table = spark.createDataFrame(links, "src_url string, dst_url string, follow int, is_internal int, is_redirect int").repartition(3)
    seeds = spark.createDataFrame([(names[0],), (names[1],), (names[1],)], "url string")
    for nofollow in (True, False):
        want = walk({names[0], names[1]}, links, 3, nofollow, scope)
        got = {r.url: r.depth for r in graphs.frontier(seeds, table, 3, None, nofollow, scope=scope).collect()}
        assert got == want
    first = [r.url for r in graphs.frontier(seeds, table, 3, 6, True, scope=scope).collect()]
    whole = walk({names[0], names[1]}, links, 3, True, scope)
    assert first == sorted(whole, key=lambda u: (whole[u], u))[:6]
