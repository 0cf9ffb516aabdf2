"""Walks of three hops: questions answered by direct neighbours are not walked on, the others are walked in full."""

import random

from lexspark.operators import graph_walk
from lexspark.operators.graph_build import Graph


def _graph(spark, cites, links, mentions):
    provisions = spark.createDataFrame(cites, "id string, cite string")
    return Graph(provisions, spark.createDataFrame(mentions, "term string, id string"), spark.createDataFrame([(*link, "CITES") for link in links], "src string, dst string, type string"))


def _brute(seeds, cites, links, mentions, limit, max_hops):
    around = {}
    for a, b in [*links, *((f"term:{t}", i) for t, i in mentions)]:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    cite_of, want = dict(cites), set()
    for query, cite in seeds:
        pairs = []
        for seed in (i for i, c in cites if c == cite):
            reached, edge = {seed: 0}, {seed}
            for hop in range(1, max_hops + 1):
                edge = {n for e in edge for n in around.get(e, ())} - set(reached)
                reached |= dict.fromkeys(edge, hop)
            pairs += [(h, cite_of[n], n, seed) for n, h in reached.items() if h and n in cite_of]
        want |= {(query, seed, n, c, h) for h, c, n, seed in sorted(pairs)[:limit]}
    return want


def test_answered_questions_are_not_walked_on(spark, monkeypatch):
    rng = random.Random(4)
    cites = [(f"P{i:02d}", f"c{i % 12:02d}") for i in range(48)]
    links = [("P00", f"P{i:02d}") for i in range(20, 40)] + [(f"P{rng.randrange(48):02d}", f"P{rng.randrange(48):02d}") for _ in range(40)]
    cites, links = cites + [(f"Z{i}", f"z{i}") for i in range(5)], links + [(f"Z{i}", f"Z{i + 1}") for i in range(4)]
    mentions = [(f"t{rng.randrange(5)}", f"P{i:02d}") for i in range(0, 48, 3)]
    graph = _graph(spark, cites, links, mentions)
    seeds = [(f"q{i:02d}", f"c{i:02d}") for i in range(12)] + [("z", "z0")]
    walk = lambda rows: {tuple(r) for r in graph_walk.two_hops(spark.createDataFrame(rows, "query_id string, cite string"), graph, 9, 3).collect()}
    want = _brute(seeds, cites, links, mentions, 9, 3)
    assert {w[4] for w in want if w[0] == "q00"} == {1} and {w[4] for w in want if w[0] == "z"} == {1, 2, 3}
    assert walk(seeds) == want
    steps = []
    cut = graph_walk.cut_lineage
    monkeypatch.setattr(graph_walk, "cut_lineage", lambda df: steps.append(df.columns) or cut(df))
    assert walk(seeds[:1]) == {w for w in want if w[0] == "q00"}
    assert not any("other" in columns and "node" in columns for columns in steps)  # no walk was begun
