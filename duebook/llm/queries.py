"""One query per operator over its whole table, each with the SQL that must give the same rows, if there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.llm import (
    conversation_trie,
    dual_tree,
    language_id,
    lattice_lm,
    nearest,
    packing,
    piece_sampling,
    quality_rules,
    resharding,
    simhash,
    suffix_dedup,
    token_files,
    url_filters,
)
from duebook.llm.scratch import Scratch
from duebook.session import fresh_dir

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    rows = quality_rules.ledger(quality_rules.measure(docs).drop("text"))
    base, verdict = quality_rules.POLICIES[0], quality_rules.POLICIES[-1]
    judged = quality_rules.apply_policy(rows, verdict).withColumn(
        "base_failed", quality_rules.fails("failure_bits", base)
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (F.col("kept") & ~F.col("base_failed")).alias("kept"),
        "failure_bits",
    )


_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), places AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS five
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), doubled AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM places) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM doubled, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END
    + CASE WHEN n_letters >= 40 AND 2 * n_upper > n_letters THEN 64 ELSE 0 END)::BIGINT AS failure_bits
  FROM m
)
"""

ORACLES["op9_quality_rules"] = f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM b
"""


@query
def quality_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy keeps out, and what it alone does, from the stored ledger."""
    store = fresh_dir(spark, "quality-ledger")
    quality_rules.store(_table(spark, folder, "documents"), store, "documents")
    return quality_rules.ablations(quality_rules.stored(spark, store))


ORACLES["quality_ablations"] = f"""{_LEDGER_SQL}
, cases(policy, policy_mask, rule, mask) AS (
  VALUES ('base', 3, 'few_words', 1), ('base', 3, 'repeated_words', 2),
    ('v1', 15, 'few_words', 1), ('v1', 15, 'repeated_words', 2), ('v1', 15, 'symbols', 4), ('v1', 15, 'duplicate_lines', 8),
    ('v2', 127, 'few_words', 1), ('v2', 127, 'repeated_words', 2), ('v2', 127, 'symbols', 4), ('v2', 127, 'duplicate_lines', 8),
    ('v2', 127, 'word_length', 16), ('v2', 127, 'few_letters', 32), ('v2', 127, 'shouting', 64)
)
SELECT policy, rule, count(*) FILTER (WHERE failure_bits & mask <> 0) AS failed,
  count(*) FILTER (WHERE failure_bits & policy_mask = mask) AS failed_by_it_alone,
  count(*) FILTER (WHERE failure_bits & policy_mask <> 0) AS rejected_by_policy
FROM b, cases GROUP BY policy, rule
"""


@query
def op10_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = simhash.near_duplicates(docs, words_in_shingle=3, most=2)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~held), "doc_id", "text", "lang")
    rows = language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, longest=2048)
    return packing.pack(cut, 2048)


@query
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    mined = url_filters.mine(pages, _table(spark, folder, "labels"), min_confidence=0.4, min_pages=10)
    stated = [
        url_filters.rule("allow", "org/"),
        url_filters.rule("block", "example.org/es/"),
        url_filters.rule("block", "example.org/en/1"),
        url_filters.rule("allow", "com/fr/"),
        url_filters.rule("block", "com/de/"),
    ]
    judged = url_filters.judge(pages, stated, mined)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_block")


@query
def op2_one_bit_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    return nearest.nearest(rows, F.col("vec_id") % 20 == 0, "vec_id", "embedding", k=20)


@query
def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = suffix_dedup.remove_repeats(docs, 400, "doc_id", "text")
    kept = F.octet_length("kept").cast("long").alias("n_kept")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept)


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    files = token_files.new_folder(spark)
    token_files.write_token_files(docs, files, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, files)


@query
def op4_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@query
def op6_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model"), held)


ORACLES["op2_one_bit_neighbours"] = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) AS score
  FROM good q, good r WHERE q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scored)
WHERE rank <= 20
"""


ORACLES["op7_suffix_array_dedup"] = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(array_slice(b, i + 1, i + 400)) AS h
  FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)
), marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS times FROM w) WHERE times > 1
), islands AS (
  SELECT doc_id, min(i) AS first, max(i) + 400 AS beyond FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM marked))
  GROUP BY doc_id, island
), cuts AS (
  SELECT doc_id, list(first ORDER BY first) AS firsts, list(beyond ORDER BY first) AS beyonds, sum(beyond - first) AS gone
  FROM islands GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(len(firsts), 0) AS BIGINT) AS n_spans,
  CASE WHEN firsts IS NULL THEN sha256(b) ELSE sha256(list_reduce(list_transform(range(1, len(firsts) + 2),
    lambda k: array_slice(b, CASE WHEN k = 1 THEN 1 ELSE beyonds[k - 1] + 1 END, CASE WHEN k > len(firsts) THEN n ELSE firsts[k] END)),
    lambda x, y: x || y)) END AS kept_sha256,
  CAST(n - coalesce(gone, 0) AS BIGINT) AS n_kept
FROM d LEFT JOIN cuts ON cuts.doc_id = d.doc_id
"""

ORACLES["op1_url_filters"] = r"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), labelled_hosts AS (
  SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS ls FROM parts
), tokens AS (
  SELECT page_id, url, host, path, CASE WHEN instr(url, '://') > 0 THEN list_distinct(list_concat(
    list_transform(range(1, len(ls) + 1), lambda i: 'host=' || array_to_string(ls[i:], '.')),
    list_transform(ls, lambda x: 'word=' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '0', 'g')),
    list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query=' || split_part(x, '=', 1)),
    ['scheme=' || split_part(url, '://', 1)])) ELSE [] END AS items
  FROM labelled_hosts
), judged AS (
  SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id
), baskets AS MATERIALIZED (
  SELECT row_number() OVER () AS basket, items, bad FROM tokens JOIN judged ON page_id = doc_id
), frequent AS (
  SELECT token, list(basket ORDER BY basket) AS places
  FROM (SELECT basket, bad, unnest(items) AS token FROM baskets) GROUP BY token HAVING count(*) FILTER (WHERE bad) >= 10
), classes AS (
  SELECT list_sort(list(token)) AS members, any_value(places) AS places FROM frequent GROUP BY frequent.places
), shorter AS (
  SELECT basket, list_sort(list(members[1])) AS items FROM (SELECT members, unnest(places) AS basket FROM classes) GROUP BY basket
), sets AS (
  SELECT list_filter(s.items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS held, bad
  FROM (SELECT *, unnest(range(1, 1 << len(items))) AS mask FROM shorter) AS s JOIN baskets USING (basket)
), kept_sets AS (
  SELECT held FROM sets GROUP BY held
  HAVING count(*) FILTER (WHERE bad) >= 10 AND count(*) FILTER (WHERE bad) >= 0.4 * count(*)
), mined AS (
  SELECT k.held AS names, flatten(list(members)) AS held
  FROM (SELECT held, unnest(held) AS name FROM kept_sets) AS k JOIN classes ON members[1] = name GROUP BY k.held
), hits AS (
  SELECT DISTINCT url FROM tokens JOIN mined ON list_has_all(items, mined.held)
), stated AS (
  SELECT page_id, url, host, path, arg_max(text, length(text)) AS rule, arg_max(decides, length(text)) AS decides
  FROM parts LEFT JOIN (VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'),
    ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'),
    ('block', 'com', '/de/', 'com/de/')) AS t(decides, h, p, text)
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(decides, CASE WHEN hits.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  hits.url IS NOT NULL AS mined_block
FROM stated LEFT JOIN hits ON hits.url = stated.url
"""


@query
def op11_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns = conversation_trie.numbered_turns(_table(spark, folder, "conversations"), scratch)
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns, scratch), scratch)


@query
def op12_min_cost_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """From 32 shards by a hash of the id to 40 of near equal bytes; the rows are read from the new files."""
    docs, store = _table(spark, folder, "documents"), fresh_dir(spark, "shards")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    resharding.lay_out(docs, store, number % 32, 32)
    resharding.reshard(spark, store, docs, 40)
    rows = resharding.read_layout(spark, store, docs)
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"),
        "size",
        F.crc32(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


ORACLES["op11_conversation_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, g,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS place
  FROM (SELECT conv_id, turn, coalesce(text, '') AS x,
      sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda r, bit: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT conv_id, words, g, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM (
    SELECT convs.conv_id, words, g, place, 0 AS part FROM convs JOIN turns ON turns.conv_id = base AND place <= h
    UNION ALL SELECT convs.conv_id, words, g, place, 1 FROM convs JOIN turns ON turns.conv_id = convs.conv_id AND place > h)
), prefixes AS (
  SELECT conv_id, depth, words, string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), members AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, min(above) AS above, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY key, depth
), children AS (
  SELECT above, count(*) AS n FROM nodes GROUP BY above
), valued AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * words AS tokens FROM nodes LEFT JOIN children ON children.above = nodes.key
), sums AS (
  SELECT m.key, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.tokens) AS saved
  FROM valued v JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.key
)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
  n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums ON sums.key = v.key LEFT JOIN valued p ON p.key = v.above
"""

_TERMS = r"""unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

ORACLES["op13_dual_tree_search"] = f"""
WITH counts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), totals AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0) WHERE rank <= 10
"""
