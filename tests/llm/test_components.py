import random

import pytest

from gapwright.llm import components


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root if find(x) != x}


def cases():
    r = random.Random(3)
    names = [r.getrandbits(64) - (1 << 63) for _ in range(600)]
    path = list(zip(names, names[1:]))
    stars = [(min(names), n) for n in names[:300]] + [(n, n) for n in names[:9]]
    # every node of a group joined to the smaller ones it shares a key with, as near copies are
    groups = [(names[i], names[j]) for g in range(0, 600, 60) for i in range(g, g + 60) for j in r.sample(range(g, g + 60), 4)]
    return [("path", path, 12), ("sorted path", list(zip(sorted(names), sorted(names)[1:])), 12), ("stars", stars + stars, 1), ("groups", groups, 4), ("none", [], 1)]


@pytest.mark.parametrize("name,links,most", cases(), ids=lambda x: x if isinstance(x, str) else "")
def test_components(spark, monkeypatch, name, links, most):
    writes = []
    keep = components.kept
    monkeypatch.setattr(components, "kept", lambda df, n: writes.append(n) or keep(df, n))
    rows = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [tuple(r) for r in components.components(rows).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(found) == len(set(found)) and set(found) == plain(links)
    assert len(writes) <= most
