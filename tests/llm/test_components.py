import random

from sentimetry.llm.components import components


def brute(links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def table(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def got(df):
    return {r.node: r.root for r in df.collect()}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 160)]
    zigzag = list(zip(ids := rng.sample(range(1000, 1060), 60), ids[1:]))
    star = [(2030, 2000 + i) for i in range(60) if i != 30]
    loose = [(rng.randrange(3000, 3080), rng.randrange(3000, 3080)) for _ in range(50)]
    links = [(a, b) for a, b in path + zigzag + star + loose + path[:3] if a != b]
    assert got(components(table(spark, links))) == brute(links)


def test_more_links_extend_known_components(spark):
    first, more = [(1, 2), (5, 6), (7, 8), (20, 21)], [(6, 7), (2, 9), (30, 31), (21, 20)]
    assert got(components(table(spark, more), components(table(spark, first)))) == brute(first + more)
    assert got(components(table(spark, more[:0]), components(table(spark, first)))) == brute(first)


def test_no_links(spark):
    assert got(components(table(spark, [(1, 1)]))) == {}
