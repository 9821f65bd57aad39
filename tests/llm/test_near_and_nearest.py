import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duebook.llm import components, nearest, simhash
from tests.llm.helpers import documents, groups_of, words


def test_components_agree_with_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    links += [(5, 5), links[0]]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    want = groups_of(links, sorted({n for link in links for n in link}))
    assert got == {n: want[n] for n in nodes}
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("most,partitions,crowd", [(2, 3, 200), (2, 3, 0), (3, 4, 5), (1, 2, 0)])
def test_links_connect_what_pairs_connect(spark, most, partitions, crowd):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for one in list(prints)[:25]:
        for _ in range(6):
            one ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 3))})
            prints.add(one)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r.u, r.v) for r in simhash.links(df, most, partitions, crowd).collect()]
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(distance(a, b) <= most for a, b in found)
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if distance(a, b) <= most]
    assert groups_of(found, signed) == groups_of(pairs, signed)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(5)
    costs = np.cumsum(rng.random((40, 3, 4)), axis=2)
    costs[:, :, 0] = 0
    got, price = simhash.allot_thresholds(costs, 0)
    for row in range(40):
        options = [t for t in itertools.product(range(-1, 3), repeat=3) if sum(t) == 0]
        best = min(sum(costs[row, k, t + 1] for k, t in enumerate(o)) for o in options)
        assert sum(got[row]) == 0 and price[row] == pytest.approx(best)
        assert sum(costs[row, k, t + 1] for k, t in enumerate(got[row])) == pytest.approx(best)


def test_near_duplicates_of_documents(spark):
    rng = random.Random(6)
    long = words(rng, 400, "abcdefghijklm")
    texts = [long, long.upper(), long + " tail", None, "", " \n", "one", "ONE", "two words", words(rng, 30000)]
    docs = documents(spark, texts).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit("mine"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: simhash.fingerprint((t or "").encode()) for k, t in enumerate(texts)}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = groups_of(pairs, list(prints))
    assert {k: r.component_id for k, r in got.items()} == want
    assert want[1] == 0 and want[4] == want[5] == 3 and got[3].fp == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((600, 24))
    vectors[100:140] = vectors[100]
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(vectors)]
    rows += [(600, None, "x"), (601, [0.0] * 24, "x"), (602, [float("nan")] + [1.0] * 23, "x"), (603, [1.0], "x")]
    rows += [(604, [None] + [1.0] * 23, "x"), (620, [float("inf")] * 24, "x"), (None, [1.0] * 24, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got: dict = {}
    found = nearest.nearest(df, F.col("vec_id") % 20 == 0, k=10, rows_in_block=100, queries_in_block=7)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, near in got.items():
        scores = (vectors * vectors[q]).sum(axis=1)
        want = [k for k in np.lexsort((np.arange(600), -scores)) if k != q][:10]
        assert [n[2] for n in near] == list(range(1, 11))
        assert all(abs(s - scores[k]) < 1e-9 for k, s, _ in near)
        hits += len({n[0] for n in near} & set(want))
    assert hits / (10 * len(got)) >= 0.9
    assert [n[0] for n in got[100]] == list(range(101, 111))


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    rows = nearest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 4.0)]
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0


def linked_texts(rng, most=2):
    """Three texts in a chain: the outer two are near the middle one, but not near each other."""
    base = words(rng, 60, "abcdefghijklm").split()
    near = lambda a, b: (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= most
    middle = " ".join(base)
    others = []
    while True:
        changed = list(base)
        changed[rng.randrange(len(base))] = words(rng, 1)
        one = " ".join(changed)
        if one != middle and near(one, middle):
            for other in others:
                if not near(one, other):
                    return one, middle, other
            others.append(one)


def test_rows_without_an_id_link_and_are_kept(spark):
    rng = random.Random(17)
    one, middle, other = linked_texts(rng)
    clean, copied = words(rng, 80, "nopqrst"), words(rng, 80, "uvwxyz")
    rows = [(7, one), (None, middle), (5, other), (None, clean), (None, copied), (None, copied), (9, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], documents(spark, []).schema)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1)] * 3 + [(-1, 5), (-1, 9), (5, 5), (7, 5), (9, 9)]
    kept = sorted((r.doc_id or -1, r.text or "") for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(5, other), (-1, clean), (-1, copied), (9, "")])
