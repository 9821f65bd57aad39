import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duebook.llm import language_id, lattice, lattice_lm, packing, piece_sampling, suffix_dedup, token_files, tokens
from tests.llm.helpers import documents, words

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [None, "", " ", "a\xa0 b  c\n\nd \x1c e", "x's. y've, ▁ \ud7ff", "<|endoftext|> !\n", "\n\nno  漢字 😀é.", "a" * 5000]


def plain_ids(text):
    tokenizer = Tokenizer.from_file(BPE)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_looked_up_give_the_same_ids():
    rng = random.Random(8)
    texts = [t or "" for t in AWKWARD]
    texts += ["".join(rng.choice(["a", "The", " ", " ", "\n", ".", ",", "'s", "é", "7", "%"]) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    small = tokens.Encoder(BPE, most_kept=20)
    for text in texts * 2:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == plain_ids(text)[:-1], text


def test_pieces_are_looked_up_once_and_kept_if_repeated(monkeypatch):
    own = tokens.Encoder(BPE)
    monkeypatch.setattr(tokens, "encoder", lambda path: own)
    texts = ["all our words", None, "and our own", *(f"once q{chr(97 + k)}x words" for k in range(20)), *AWKWARD]
    want = [plain_ids(t) for t in texts]
    assert [list(np.frombuffer(x, np.uint32)) for x in tokens.encode_stream(BPE, texts, 0)] == want
    assert {"our", "words"} <= set(own.after_blank) and not {"own", "qax", "qtx"} & set(own.after_blank)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    assert [list(np.frombuffer(x, np.uint32)) for x in tokens.encode_stream(BPE, iter(texts), 0)] == want


def test_token_files_read_back(spark):
    rng = random.Random(9)
    texts = [*AWKWARD, words(rng, 3000), words(rng, 50)]
    docs = documents(spark, texts, first=-3).repartition(3)
    folder = token_files.new_folder(spark)
    token_files.write_token_files(docs, folder, BPE, block_ids=100)
    at, rows = 0, {r.doc_id: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = np.array(plain_ids(text), "<u4")
        row = rows[k - 3]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(row.ids) == ids.tobytes()
        at += len(ids)


@pytest.mark.parametrize("with_ids", [True, False])
def test_long_blocks_are_read_by_checkpoint(spark, monkeypatch, with_ids):
    """Documents over many checkpoints, several in one, and ids that repeat, read as cut blocks and as whole ones."""
    rng = random.Random(19)
    texts = [*AWKWARD, words(rng, 4000), "b", words(rng, 2500), words(rng, 20), None]
    docs = documents(spark, texts, first=-3).repartition(2)
    docs = docs.union(docs.where("doc_id = 1")).withColumn("start", F.lit("mine"))
    monkeypatch.setattr(token_files.encode_block, "__defaults__", (16, 4))
    folder = token_files.new_folder(spark)
    token_files.write_token_files(docs, folder, BPE, block_ids=900)
    whole = sorted(map(tuple, token_files.read_token_files(spark, folder, with_ids).collect()))
    for limit in (0, 1500):
        cut = token_files.read_token_files(spark, folder, with_ids, whole_up_to=limit)
        assert sorted(map(tuple, cut.collect())) == whole
    assert len(whole) == len(texts) + 1 and sum(r[2] for r in whole) == sum(len(plain_ids(t)) for t in [*texts, texts[4]])
    longest = max(whole, key=lambda r: r[2])
    assert longest[3] == zlib.crc32(np.array(plain_ids(texts[longest[0] + 3]), "<u4").tobytes())


def test_checksums_are_joined():
    rng = random.Random(20)
    for a, b in ((0, 0), (0, 5), (5, 0), (7, 3), (100, 3_000_001)):
        one, two = rng.randbytes(a), rng.randbytes(b)
        assert token_files.joined_crc32(zlib.crc32(one), zlib.crc32(two), b) == zlib.crc32(one + two)


def test_token_files_of_no_documents(spark):
    folder = token_files.new_folder(spark)
    token_files.write_token_files(documents(spark, []), folder, BPE)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_token_blocks_and_checkpoints():
    rng = np.random.default_rng(10)
    for n in (0, 1, 511, 513, 30_000):
        ids = np.minimum(rng.zipf(1.4, n), 5000).astype(np.uint32)
        table = token_files.Table(token_files.scaled(np.bincount(ids, minlength=5001)))
        data = token_files.encode_block(ids, table, lanes=64, between=32)
        assert (token_files.decode_block(data, table) == ids).all()
        points = list(token_files.checkpoints(data))
        assert len(points) == -(-n // (64 * 32))
        parts = [point.decode(table) for point in points]
        assert np.concatenate([np.zeros(0, np.uint32), *parts]).tolist() == ids.tolist()
    points[1].check ^= 1
    with pytest.raises(token_files.CorruptBlock):
        points[1].decode(table)
    with pytest.raises(token_files.CorruptBlock):
        token_files.decode_block(data[:100] + bytes([data[100] ^ 1]) + data[101:], table)
    with pytest.raises(ValueError):
        token_files.encode_block(np.array([5000 - 1], np.uint32), token_files.Table(token_files.scaled(np.array([1, 0]).repeat(2500))))


@pytest.mark.parametrize("counts", [[5], [1] * 300, [10**12, 1, 1, 0], [0, 0]])
def test_scaled_frequencies(counts):
    freq = token_files.scaled(np.array(counts))
    assert freq.sum() == ((1 << 20) if any(counts) else 0)
    assert ((freq > 0) == (np.array(counts) > 0)).all()


def test_bins_hold_every_piece_once():
    for seed in range(60):
        rng = random.Random(seed)
        room = rng.choice([5, 10, 50, 2048])
        counts: Counter = Counter(max(1, min(room, int(rng.expovariate(3 / room)))) for _ in range(rng.randint(0, 400)))
        got: Counter = Counter()
        for times, lengths in packing.plan_bins(dict(counts), room):
            assert sum(lengths) <= room
            for length in lengths:
                got[length] += times
        assert got == counts
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, 10)


def test_two_replace_the_smallest():
    assert sorted(packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][1]) == [2, 2, 6]


def test_packing_documents(spark):
    rng = random.Random(11)
    texts = [*AWKWARD, words(rng, 3000), *["same text"] * 50]
    cut = packing.pieces(documents(spark, texts).repartition(4), BPE, longest=64, with_ids=True)
    rows = packing.pack(cut, 64).collect()
    places: dict = {}
    by_doc: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for one in places.values():
        at = 0
        for offset, length in sorted(one):
            assert offset == at
            at += length
        assert at <= 64
    for k, text in enumerate(texts):
        parts = sorted(by_doc[k], key=lambda r: r.piece)
        ids = np.array(plain_ids(text), "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in parts) == ids
        assert all(p.length == 64 for p in parts[1:]) and all(p.ids_crc32 == zlib.crc32(p.ids) for p in parts)
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 64) * 1.1 + 1
    assert packing.pack(packing.pieces(documents(spark, []), BPE), 2048).count() == 0


def test_packing_leaves_columns_of_any_other_name(spark):
    cut = packing.pieces(documents(spark, ["a b c", None, "a b c", "d " * 90]), BPE, longest=64)
    plain = {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in packing.pack(cut, 64).collect()}
    names = ["number", "_part", "_Block", "_own", "before", "n", "_metadata", "a.b"]
    for name in [*names, "offset"]:
        cut = cut.withColumn(name, F.lit(f"mine {name}"))
    rows = packing.pack(cut, 64).collect()
    assert {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in rows} == plain
    assert all([r[name] for name in names] == [f"mine {name}" for name in names] for r in rows)


def plain_repeats(docs, length):
    seen = Counter(d[i : i + length] for d in docs.values() for i in range(len(d) - length + 1))
    out = {}
    for key, d in docs.items():
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key] = (len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,group", [(400, 20_000), (400, 1), (130, 2)])
def test_repeats_agree_with_plain_ones(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_AT_ONCE", group)
    rng = random.Random(length + group)
    shared = [words(rng, 120, "abcdefghijklmnop") for _ in range(6)]
    texts = [None, "", "short", "é" * 400, "ab" * 700, "Der " * 300, "Der " * 250 + "x", "a" * 1500]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [words(rng, rng.randint(1, 40)), s[a : a + rng.randint(100, 600)]]
        texts.append(" ".join(parts))
    texts += [texts[20]] * 4 + [texts[21][1:], texts[22] + "!"]
    docs = documents(spark, texts).withColumn("data", F.lit("mine"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs.repartition(5), length).collect()}
    assert got == plain_repeats({k: (t or "").encode() for k, t in enumerate(texts)}, length)


def test_stripped_rows_keep_their_columns(spark):
    rng = random.Random(12)
    shared = words(rng, 150)
    docs = documents(spark, [shared + " é one", "two " + shared, None, "clean " + words(rng, 100)])
    docs = docs.withColumn("row", F.lit(1)).withColumn("packed", F.lit("x"))
    stripped = suffix_dedup.strip_repeats(docs)
    rows = {r.doc_id: r for r in stripped.collect()}
    assert stripped.columns == docs.columns
    assert len(rows[0].text) < 20 and rows[0].n_chars == len(rows[0].text) and rows[2].text is None
    assert rows[3].text == docs.where("doc_id = 3").first().text
    assert suffix_dedup.strip_repeats(docs.limit(0)).count() == 0


def language_rows(spark):
    rng = random.Random(13)
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "äöüßk"}
    rows = []
    for k in range(400):
        lang = rng.choice(sorted(kinds))
        rows.append((k, words(rng, rng.randint(5, 60), kinds[lang]), lang))
    return rows


def test_language_of_held_out_rows(spark):
    rows = language_rows(spark)
    docs = spark.createDataFrame([*rows, (None, "abc", "xx"), (401, None, "xx"), (402, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where(~language_id.held_out()), per_language=60)
    assert model.languages == ["xx", "yy", "zz"] and (model.weights == 0).any()
    asked = docs.withColumn("held", language_id.held_out()).withColumn("score", F.lit("old"))
    got = language_id.predict(asked, model).collect()
    held = [r for r in got if r.held and r.text and r.lang]
    assert len(held) > 50 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame(language_rows(spark), "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=50)
    odd = documents(spark, [None, "", "123 .,!", "a", "abc " * 100_000, "漢字"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[4][0] == "xx" and got[3][0] == "xx" and got[5][0] in model.languages
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    kept = language_id.keep(docs.withColumn("_judged", F.lit(1)))
    assert kept.columns == [*docs.columns, "_judged"] and kept.count() >= 395


def test_sampled_pieces_are_lossless_and_repeatable(spark):
    rng = random.Random(14)
    texts = [*AWKWARD, "\ud7ff▁ x", *[words(rng, 40) for _ in range(20)]]
    docs = documents(spark, texts)
    once = {r.doc_id: bytes(r.ids) for r in piece_sampling.encode(docs, PIECES).collect()}
    again = {r.doc_id: bytes(r.ids) for r in piece_sampling.encode(docs.repartition(7), PIECES).collect()}
    other = {r.doc_id: bytes(r.ids) for r in piece_sampling.encode(docs, PIECES, seed=1).collect()}
    assert once == again and once != other
    back = {r.doc_id: r.text for r in piece_sampling.decode(piece_sampling.encode(docs, PIECES), PIECES).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    digests = piece_sampling.encode(docs, PIECES, digest=True).collect()
    assert all(r.lossless and r.ids_crc32 == zlib.crc32(once[r.doc_id]) for r in digests)
    assert piece_sampling.encode(docs.limit(0), PIECES).count() == 0


def test_lattices_of_repeated_units_are_made_once(monkeypatch):
    made, match = [], lattice.Matcher.match
    monkeypatch.setattr(lattice.Matcher, "match", lambda self, units: made.extend(units) or match(self, units))
    rng = random.Random(16)
    texts = [words(rng, 30, "abcé\n") for _ in range(40)] + ["", " ", "一 ▁ 一", "once"]
    keys = list(range(len(texts)))
    own, small = piece_sampling.Sampler(PIECES), piece_sampling.Sampler(PIECES)
    whole = [x.tolist() for x in own.encode(keys * 2, texts * 2)]
    assert whole[: len(texts)] == whole[len(texts) :]
    made.clear()
    assert [x.tolist() for x in own.encode(keys, texts)] == whole[: len(texts)] and not made
    small.lattices.most = 20
    assert [small.encode([k], [t])[0].tolist() for k, t in zip(keys, texts, strict=True)] == whole[: len(texts)]


def segmentations(word, ids):
    if not word:
        return [()]
    return [(ids[word[:n]], *rest) for n in range(1, len(word) + 1) if word[:n] in ids for rest in segmentations(word[n:], ids)]


def test_sampled_pieces_follow_the_lattice():
    own = piece_sampling.Sampler(PIECES, alpha=0.3)
    vocabulary = lattice.load_vocabulary(PIECES)
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if p}
    ways = segmentations("theme", ids)
    weights = np.exp([own.log_p[list(w)].sum() for w in ways])
    drawn = Counter(tuple(own.encode([k], ["theme"])[0].tolist()) for k in range(4000))
    for way, share in zip(ways, weights / weights.sum(), strict=True):
        assert abs(drawn[way] / 4000 - share) < 0.03


def test_lattice_sums_agree_with_all_segmentations():
    vocabulary = lattice.load_vocabulary(PIECES)
    log_p, ids = lattice.rank_log_probabilities(vocabulary), {p: i for i, p in enumerate(vocabulary.pieces) if p}
    units = ["▁there", "▁a", "x", "nation", "▁"]
    edges = lattice.Matcher(vocabulary).match(units)
    weights = edges.weights(log_p)
    forward, backward = edges.forward(weights), edges.backward(weights)
    for k, unit in enumerate(units):
        want = np.logaddexp.reduce([log_p[list(w)].sum() for w in segmentations(unit, ids)])
        assert edges.totals(forward)[k] == pytest.approx(want)
        assert backward[edges.first[k]] == pytest.approx(want)


def test_scores_of_documents(spark):
    rng = random.Random(15)
    texts = [None, "", "The the THE", *[words(rng, 60, "abcde") for _ in range(40)], "漢字 ▁ \ud7ff", "z" * 3000]
    docs = documents(spark, texts).withColumn("word", F.lit("mine")).withColumn("batch", F.lit(1))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = {r.doc_id: r for r in lattice_lm.score(docs, PIECES, held).collect()}
    counts: Counter = Counter()
    for k, text in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    for k, text in enumerate(texts):
        found = [*(text or "").encode().lower().split(), "end"]
        row = rows[k]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(found), sum(counts[w] > 0 for w in found), n)
        assert row.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in found))
        assert row.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert np.isfinite(row.score) and row.score < 0 and row.score >= row.lattice_score - 2 * row.n_tokens
    seen = [r for r in rows.values() if r.n_known > 30]
    assert np.mean([r.score > r.lattice_score for r in seen]) > 0.95
    untrained = lattice_lm.score(docs.limit(3), PIECES, F.lit(True)).collect()
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in untrained)
    assert lattice_lm.score(docs.limit(0), PIECES, held).count() == 0
