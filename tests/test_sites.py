import itertools
import random

from emberline.operators import linkage
from emberline.operators.components import connected


def brute(pebbles, pixel, reach, apart):
    nodes = {}
    for z, x, y, d in pebbles:
        nodes.setdefault((z, x // pixel, y // pixel), []).append((d, x, y))
    order = sorted(nodes)
    links = []
    for a, b in itertools.combinations(order, 2):
        d2 = (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
        if a[0] == b[0] and d2 <= reach * reach:
            links.append((d2, a, b))
    group = {n: n for n in order}
    for _, a, b in sorted(links):
        i, j = sorted((group[a], group[b]))
        if i == j:
            continue
        left = [p for n in order if group[n] == i for p in nodes[n]]
        right = [p for n in order if group[n] == j for p in nodes[n]]
        if any(p[0] == q[0] and (apart is None or (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 > apart * apart) for p in left for q in right):
            continue
        for n in order:
            if group[n] == j:
                group[n] = i
    return group


def test_linkage_matches_brute_force_in_any_order(spark):
    rng = random.Random(4)
    pebbles = [(rng.choice([31, -31]), 1_000_000 + rng.randrange(30) * 900, 2_000_000 + rng.randrange(30) * 900, f"2024-01-{rng.randrange(1, 6):02d}") for _ in range(220)]
    for rule in (linkage.DAY, {"pixel": 2000, "reach": 3, "apart": None}):
        want = brute(pebbles, **rule)
        number = lambda n: ((n[0] + 64) * linkage._AXIS + n[1]) * linkage._AXIS + n[2]
        for _ in range(2):
            rng.shuffle(pebbles)
            got = {r.node: r.site for r in linkage.sites(spark.createDataFrame(pebbles, "z int, x long, y long, d string"), **rule).collect()}
            assert got == {number(n): number(s) for n, s in want.items()}


def test_no_pebbles_no_sites(spark):
    assert linkage.sites(spark.createDataFrame([], "z int, x long, y long, d string")).count() == 0


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(50)}, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
