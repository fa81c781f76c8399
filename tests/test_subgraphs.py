"""Typed subgraphs and project graphs against small sequential versions, at budgets that bind."""

import random

import pytest

from sparkmem.operators import graph


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(6)
    obs = [(i, draw.choice(["bugfix", "manual"]), f"t{i}", draw.choice(["p1", "p1", "p2"]), draw.randrange(6), draw.choice([None, "ann", "bo"])) for i in range(60)]
    edges = [(100 + k, draw.randrange(60), draw.randrange(60), draw.choice(["follows", "references"])) for k in range(110)]
    entities = [(draw.randrange(60), k := draw.choice(["file", "url"]), f"{k}:{draw.randrange(9)}") for _ in range(90)]
    entities = sorted({(i, k, key, key.upper()) for i, k, key in entities})
    return (
        (obs, edges, entities),
        spark.createDataFrame(obs, "id long, type string, title string, project string, session_id int, created_by string"),
        spark.createDataFrame(edges, "id long, from_id long, to_id long, relation string"),
        spark.createDataFrame(entities, "id long, kind string, key string, value string"),
    )


def typed(related, obs, edges, entities, most):
    """One root's nodes, in order, and edges."""
    of = {o[0]: o for o in obs}
    order = sorted(related, key=lambda i: (related[i], i))[:most]
    nodes = [f"observation:{i}" for i in order]
    links = [(f"observation:{a}", f"observation:{b}", r) for _, a, b, r in edges if a in order and b in order]
    for i, kind, key, _ in sorted(entities, key=lambda e: (e[1], e[2])):
        if i in order:
            if f"entity:{key}" not in nodes:
                if len(nodes) >= most:
                    continue
                nodes.append(f"entity:{key}")
            links.append((f"observation:{i}", f"entity:{key}", "mentions"))
    for i in order:
        for node, how in ((of[i][5] and f"actor:{of[i][5]}", "created_by"), (f"session:{of[i][4]}", "produced_in"), (f"project:{of[i][3]}", "belongs_to")):
            if node and node not in nodes and len(nodes) < most:
                nodes.append(node)
    for i in order:
        for node, how in ((of[i][5] and f"actor:{of[i][5]}", "created_by"), (f"session:{of[i][4]}", "produced_in"), (f"project:{of[i][3]}", "belongs_to")):
            if node in nodes:
                links.append((f"observation:{i}", node, how))
    return nodes, sorted(links)


@pytest.mark.parametrize("most", [4, 17, 200])
def test_typed_subgraph(spark, tables, most):
    (obs, edges, entities), *frames = tables
    draw = random.Random(most)
    related = {root: {root: 0, **{draw.randrange(60): draw.randrange(1, 4) for _ in range(9)}} for root in (3, 20, 41)}
    for root in related:
        related[root][root] = 0
    df = spark.createDataFrame([(r, i, h) for r, x in related.items() for i, h in x.items()], "root long, id long, hop int")
    nodes, links = graph.typed_subgraph(df, *frames, most_nodes=most)
    got, met = {}, {}
    for r in nodes.orderBy("place").collect():
        got.setdefault(r.root, []).append(r.node)
    for r in links.collect():
        met.setdefault(r.root, []).append((r.source, r.target, r.type))
    for root, x in related.items():
        want = typed(x, obs, edges, entities, most)
        assert (got[root], sorted(met.get(root, []))) == want


def walk(seeds, obs, edges, project, depth, most):
    of = {o[0]: o[3] for o in obs}
    nodes, taken, ended = {}, set(), False
    for s in seeds:
        if len(nodes) >= most:
            return nodes, taken, True
        nodes[s] = 0
    front = list(seeds)
    for level in range(1, depth + 1):
        new = []
        for u in front:
            for e in sorted((e for e in edges if u in e[1:3] and e[1] != e[2]), key=lambda e: str(e[0])):
                v = e[2] if e[1] == u else e[1]
                if v not in nodes:
                    if project is not None and of[v] != project:
                        continue
                    if len(nodes) >= most:
                        return nodes, taken, True
                    nodes[v] = level
                    new.append(v)
                taken.add(e[:3])
        front = new
    return nodes, taken, ended


@pytest.mark.parametrize(("project", "depth", "most"), [(None, 2, 200), (None, 3, 9), ("p1", 2, 14), ("p1", 10, 200), ("p2", 1, 3)])
def test_project_graph(spark, tables, project, depth, most):
    (obs, edges, _), frame, links, _ = tables
    seeds = [o[0] for o in obs if project is None or o[3] == project][:5]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(seeds, 1)], "id long, place int")
    nodes, taken, ended = graph.project_graph(df, frame, links, project, depth, most)
    want = walk(seeds, obs, edges, project, depth, most)
    assert [r.id for r in nodes.orderBy("place").collect()] == list(want[0])
    assert {r.id: r.hop for r in nodes.collect()} == want[0] and ended == want[2]
    assert {tuple(r) for r in taken.collect()} == want[1]
