import random

import duckdb

from helixloom.operators import graph
from helixloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_all_links(spark):
    links = duckdb.sql(f"select l_partkey, l_suppkey + 100000000 from '{SF}/lineitem.parquet'").fetchall()
    got = catalog.QUERIES["graph_components_all"](spark, SF).collect()
    assert {r.node: r.component for r in got} == plain(links) and len(got) == len(plain(links))


def test_chains_and_hubs(spark):
    rng = random.Random(3)
    chain = list(range(1000, 1400))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(5000, 5001 + i) for i in range(300)] + [(9000, 9000), (1, 2), (2, 1)]
    rng.shuffle(links)
    got = graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == plain(links) and len(got) == len(plain(links))
