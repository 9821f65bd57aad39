import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from duebook.llm import packing, token_files, tokens
from tests.llm.helpers import documents

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


def library_ids(text):
    return Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_special_tokens_give_the_ids_of_the_library():
    rng, tokenizer = random.Random(19), Tokenizer.from_file(BPE)
    texts = [f"a {SPECIAL} b", SPECIAL, f" {SPECIAL} ", f"x{SPECIAL}{SPECIAL}\n", f"a \n{SPECIAL}\t b", f"\xa0{SPECIAL} "]
    parts = [SPECIAL, "<|endof", "text|>", "The", "a", " ", " ", "\n", "\t", "'s", ".", "é", "7", "\xa0"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += [" ".join(rng.choice(parts[:5]) for _ in range(8)) for _ in range(500)]
    small = tokens.Encoder(BPE, most_kept=20)
    for text in texts * 2:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(small.encode(text), "<u4").tolist() == want, text
    assert library_ids(texts[0]) == [64, 220, 50256, 275]


def test_special_tokens_in_files_and_packing(spark):
    texts = [f"a {SPECIAL} b", "plain text", SPECIAL]
    docs, folder, at = documents(spark, texts).coalesce(1), token_files.new_folder(spark), 0
    token_files.write_token_files(docs, folder, BPE, block_ids=100)
    rows = {r.doc_id: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    packed = {r.doc_id: r for r in packing.pack(packing.pieces(docs, BPE, longest=64, with_ids=True), 64).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*library_ids(text), 0], "<u4").tobytes()
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        assert bytes(rows[k].ids) == bytes(packed[k].ids) == ids and packed[k].ids_crc32 == zlib.crc32(ids)
        at += len(ids) // 4
