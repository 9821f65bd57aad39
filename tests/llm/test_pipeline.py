import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from duebook.llm import queries, simhash
from tests.llm.helpers import documents, words


def test_stages_follow_their_contract(spark, tmp_path):
    rng = random.Random(16)
    base = [words(rng, 120, "abcdefghijklmnop") for _ in range(40)]
    passage = words(rng, 100, "abcdefghijklmnop")
    texts = [*base, base[0], base[1].upper().lower(), base[2] + " " + passage, passage + " " + base[3], None, "", "few words", "$ # " * 50]
    rows = documents(spark, texts)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == rows.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality_rules"]) == set(range(44))
    assert len(kept["language_id"]) >= 43
    prints = {k: simhash.fingerprint(t.encode()) for k, t in kept["language_id"].items()}
    assert all(
        any((prints[k] ^ prints[j]).bit_count() <= 2 for j in kept["simhash_near_duplicates"] if j < k)
        for k in set(kept["language_id"]) - set(kept["simhash_near_duplicates"])
    )
    assert 40 not in kept["simhash_near_duplicates"]
    before, after = kept["simhash_near_duplicates"], kept["suffix_array_dedup"]
    size = corpus_pipeline.REPEAT_BYTES
    seen = Counter(t.encode()[i : i + size] for t in before.values() for i in range(len(t.encode()) - size + 1))
    for key, text in after.items():
        repeated = any(
            seen[before[key].encode()[i : i + size]] > 1 for i in range(len(before[key].encode()) - size + 1)
        )
        assert (text != before[key]) == repeated
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in after.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == total
    assert len({r.sequence_id for r in packed}) == -(-total // 2048)


def test_every_operator_has_its_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 14))
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    rng = random.Random(18)
    long = [words(rng, 120, "abcdefghijklmnop") for _ in range(30)]
    shared = words(rng, 100, "abcdefghijklmnop")
    rows = [(k, t) for k, t in enumerate(long)] + [(3, long[3])] * 2 + [(None, words(rng, 120, "abcdefghijklmnop"))]
    rows += [(50, shared + " " + words(rng, 200, "abcdefghijklmnop")), (50, words(rng, 250, "abcdefghijklmnop"))]
    rows += [(51, words(rng, 220, "abcdefghijklmnop") + " " + shared)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], documents(spark, []).schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-2]:
        docs = stage(spark, docs, str(tmp_path))
    kept = Counter((r.doc_id, r.text) for r in docs.collect())
    assert kept == Counter(set(rows))
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.suffix_stage(spark, docs, str(tmp_path)).collect())
    size = corpus_pipeline.REPEAT_BYTES
    seen = Counter(t[i : i + size] for _, t in kept for i in range(len(t) - size + 1))
    want: Counter = Counter()
    for k, t in kept:
        gone = {i + n for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1 for n in range(size)}
        want[k, "".join(c for n, c in enumerate(t) if n not in gone)] += 1
    assert left == want and want[3, long[3]] == 1 and sum(want[r] == 0 for r in kept) == 2
