import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duebook.llm import conversation_trie, dual_tree, resharding
from duebook.llm.scratch import Scratch
from duebook.session import fresh_dir
from tests.llm.helpers import documents, words

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    length = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + own[c][h:]
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out, sums = set(), {}
    for node in sorted(members, key=len, reverse=True):
        own_words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(sums[b][0] for b in below[node]) or 1
        saved = (len(members[node]) - 1) * own_words + sum(sums[b][1] for b in below[node])
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if length[c] == len(node))
        above = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(members[node]), len(node), above, len(members[node]), len(below[node]), leaves, saved, digest))
    return out


def trie(spark, rows, in_one_task):
    table = spark.createDataFrame(rows, TURNS).repartition(3).withColumn("node", F.lit("mine"))
    scratch = Scratch(spark, "trie")
    turns = conversation_trie.rebuilt(conversation_trie.numbered_turns(table, scratch), scratch)
    return [tuple(r) for r in conversation_trie.prefix_trie(*turns, scratch, in_one_task).collect()]


@pytest.mark.parametrize("in_one_task", [1 << 14, 40])
def test_trie_against_brute_force(spark, in_one_task):
    rng = random.Random(31)
    rows = [(c, t, "u" if t % 2 else None, rng.choice(["a b", "a  c d", "", None, "é"])) for c in range(0, 90, 2) for t in range(rng.randint(1, 6))]
    rows += [(200 + c, t, "u", "same turn") for c in range(60) for t in range(3)]  # a group of copies
    rows += [(401, t, "u", f"t{t}") for t in range(150)]  # one long conversation
    rows += [(7, None, None, None), (7, None, "x", "first"), (7, 1, "u", "q"), (7, 1, "u", "q"), (None, 1, "u", "lost"), (-25, 1, "u", "low")]
    got = trie(spark, rows, in_one_task)
    assert set(got) == plain_trie(rows) and len(got) == len(set(got))


def test_trie_of_nothing(spark):
    assert trie(spark, [], 10) == [] and trie(spark, [(None, 1, "u", "x")], 10) == []


def test_components_split_in_memory():
    rng = np.random.default_rng(32)
    for shape in ("random", "path", "star"):
        n = 300
        parent = np.array([-1] + [int(rng.integers(k)) if shape == "random" else (k - 1) * (shape == "path") for k in range(1, n)])
        parent[100] = -1
        values = rng.integers(0, 9, (n, 2))
        want, weight, depth = values.copy(), np.ones(n, np.int64), np.zeros(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 0
        for k in range(n - 1, 0, -1):
            if parent[k] >= 0:
                want[parent[k]] += want[k]
                weight[parent[k]] += weight[k]
        mixed = rng.permutation(n)
        place = np.argsort(mixed)
        moved = np.where(parent[mixed] < 0, -1, place[parent[mixed]])
        assert (conversation_trie.split_components(moved, depth[mixed], weight[mixed], values[mixed]) == want[mixed]).all()


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(33)
    for _ in range(20):
        supply = [rng.randint(0, 50) for _ in range(5)]
        room = resharding.even_capacities(sum(supply), [0] * 7)
        assert sum(room) == sum(supply) and max(room) - min(room) <= 1
        flow = resharding.fewest_bytes_moved(supply, room)
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(5)] == supply
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= room[k] for k in range(7))
        assert sum(n for (i, j), n in flow.items() if i != j) == sum(max(0, s - r) for s, r in zip(supply, room, strict=False))
    prices = [[1, 5], [2, 9]]
    assert resharding.fewest_bytes_moved([3, 3], [3, 3], lambda i, j: prices[i][j]) == {(0, 1): 3, (1, 0): 3}
    assert resharding.even_capacities(10, [100, 0, 3]) == [0, 7, 3] or sum(resharding.even_capacities(10, [100, 0, 3])) == 10
    with pytest.raises(ValueError):
        resharding.fewest_bytes_moved([5], [4])


def test_resharding_keeps_every_row(spark):
    rng = random.Random(34)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(400)] + [None, "", "same"] * 40 + ["z" * 30_000]
    docs = documents(spark, texts).withColumn("shard", F.lit("mine")).withColumn("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("doc_id")))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    folder = fresh_dir(spark, "shards")
    resharding.lay_out(docs, folder, F.when(F.rand(7) < 0.4, 0).otherwise((F.rand(8) * 6).cast("int")), 6)
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    for shards in (10, 4):
        info = resharding.reshard(spark, folder, docs, shards)
        rows = resharding.read_layout(spark, folder, docs).select("doc.doc_id", "doc.text", "doc.shard", "size", F.col("shard").alias("at"), "slot").collect()
        assert Counter((r.doc_id, r.text) for r in rows) == want and {r.shard for r in rows} == {"mine"}
        slots, filled = defaultdict(list), Counter()
        for r in rows:
            slots[r.at].append(r.slot)
            filled[r.at] += r.size
            assert r.size == len((r.text or "").encode()) + 16
        assert sorted(slots) == list(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        others = sorted(filled.values())[:-1]
        assert others[-1] - others[0] <= 600 and [filled[j] for j in range(shards)] == info["largest"]
        assert info["moved"] <= info["planned"] + 35_000


def test_resharding_nothing(spark):
    docs, folder = documents(spark, []), fresh_dir(spark, "shards")
    resharding.lay_out(docs, folder, F.lit(0), 3)
    resharding.reshard(spark, folder, docs, 5)
    assert resharding.read_layout(spark, folder, docs).count() == 0


def plain_search(docs, items, k):
    def terms(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))

    counts = [(d, terms(t)) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def by_rank(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0))


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "ITEMS_AT_ONCE", 30)
    rng = random.Random(35)
    common = [words(rng, 1, "abc") for _ in range(40)] + ["ÉTÉ", "été", "a1", "Straße", "東京"]
    texts = [" ".join(rng.choices(common, k=rng.randint(0, 40))) for _ in range(700)] + [None, "", "?!"] + ["one text, MANY copies"] * 90
    docs = [(k if k % 97 else None, t) for k, t in enumerate(texts)] + [(5, "the same id")]
    items = [(k, " ".join(rng.choices(common, k=rng.randint(1, 6)))) for k in range(40)] + [(50, "many COPIES id"), (51, None), (52, "unheard")]
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string").repartition(4)
    got = dual_tree.search(table, spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert by_rank(map(tuple, got)) == by_rank(plain_search(docs, items, 10))


def test_search_in_nothing(spark):
    none, items = documents(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dual_tree.search(none, items).count() == 0
    assert dual_tree.search(documents(spark, ["a"]), items.where("false")).count() == 0


def test_search_prunes_pairs():
    rng = np.random.default_rng(36)
    n, terms = 4096, 60
    rows = np.sort(rng.integers(0, terms // 3, n))
    columns = np.stack([rows * 3, rows * 3 + 1], 1).ravel()
    impacts = rng.integers(1, 1000, 2 * n)
    items = [np.array([3 * k, 3 * k + 1]) for k in range(20)]
    task = dual_tree.Search(dual_tree.item_tree(items, np.ones(terms, np.int64)), items, np.ones(terms, np.int64), np.zeros(20, np.int64), 10)
    task.batch(np.arange(n), np.arange(n), np.full(n, 2), columns, impacts)
    scores = impacts.reshape(-1, 2).sum(1)
    for k, best in enumerate(task.best):
        want = sorted((-scores[d], d) for d in np.flatnonzero(rows == k))[:10]
        assert [(s, d) for s, d, _ in best] == [(int(s), int(d)) for s, d in want]
    assert task.computed < n * 20 / 5
