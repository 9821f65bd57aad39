import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duebook.llm import quality_rules, url_filters
from tests.llm.helpers import documents, words


def plain_measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_agree_with_plain_ones(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "x " * 3000, "a b c d e a b c d e", "é😀 漢 # $ a", "\x0b\x0c\r"]
    texts += ["\n".join(rng.choice(["a b c d e f", "", "b c d", "ä ö"]) for _ in range(30)) for _ in range(20)]
    texts += [words(rng, 2000, "ab")]
    rows = quality_rules.measure(documents(spark, texts)).collect()
    for row in rows:
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert got == plain_measures(texts[row.doc_id]), texts[row.doc_id]


def test_measures_replace_columns_of_their_name_and_pass_others(spark):
    docs = documents(spark, ["a b"]).withColumn("n_words", F.lit("old")).withColumn("_text", F.lit("mine"))
    row = quality_rules.measure(docs).first()
    assert row.n_words == 2 and row.source == "s"


def test_measures_leave_columns_of_any_other_name(spark):
    names = ["_text", "_words", "_Lines", "_hashes", "_windows", "__text", "a.b", "rules", "run"]
    docs = documents(spark, ["a b c d e a b c d e\nx", None])
    for name in names:
        docs = docs.withColumn(name, F.lit(f"mine {name}"))
    for row in quality_rules.measure(docs).collect():
        assert [row[name] for name in names] == [f"mine {name}" for name in names]
        assert (row.n_words, row.n_repeat_words) == ((11, 10) if row.doc_id == 0 else (0, 0))


def test_a_stored_ledger_answers_for_all_policies(spark, tmp_path):
    """Runs replace only themselves, null keys and repeated rows stay, another rule set is refused."""
    folder, texts = str(tmp_path / "ledger"), [words(random.Random(3), 60), "short", None, "# " * 40]
    docs = documents(spark, texts).withColumn("run", F.lit("clash"))
    docs = docs.union(docs.where("doc_id = 1")).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    quality_rules.store(docs.limit(0), folder, "a")
    quality_rules.store(docs, folder, "a")
    quality_rules.store(docs.where("doc_id = 1"), folder, "b")
    quality_rules.store(docs, folder, "a")
    rows = quality_rules.stored(spark, folder)
    assert {r.run: r["count"] for r in rows.groupBy("run").count().collect()} == {"a": 5, "b": 2}
    fresh = quality_rules.ledger(quality_rules.measure(docs))
    columns = ["doc_id", *quality_rules.MEASURES, "failure_bits"]
    assert sorted(map(str, rows.where("run = 'a'").select(*columns).collect())) == sorted(map(str, fresh.select(*columns).collect()))
    once = {tuple(r) for r in quality_rules.ablations(rows.where("run = 'a'")).collect()}
    assert once == {tuple(r) for r in quality_rules.ablations(fresh).collect()}
    with pytest.raises(Exception, match="written with the rules"):
        quality_rules.stored(spark, folder, quality_rules.RULES[:3]).agg(F.sum("failure_bits")).collect()


def test_keep_returns_rows_as_they_were(spark):
    good = words(random.Random(2), 60)
    docs = documents(spark, [good, good, "short", None]).withColumn("failure_bits", F.lit("mine"))
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]
    assert quality_rules.keep(docs.limit(0)).count() == 0


def test_policies_and_ablations_read_the_bits(spark):
    rows = spark.createDataFrame([(0, 3), (1, 1), (2, 0), (3, 4), (4, 4)], "doc_id long, failure_bits long")
    by_rule = {(r.policy, r.rule): r for r in quality_rules.ablations(rows).collect()}
    assert by_rule["v2", "few_words"].failed == 2
    assert by_rule["v2", "few_words"].failed_by_it_alone == 1
    assert by_rule["base", "few_words"].rejected_by_policy == 2
    assert by_rule["v2", "symbols"].failed_by_it_alone == 2
    kept = quality_rules.apply_policy(rows, quality_rules.POLICIES[0]).where("kept").count()
    assert kept == 3
    with pytest.raises(KeyError):
        quality_rules.policy_mask(quality_rules.Policy("x", ("unknown",)))


URLS = [
    ("https://A.Example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("ftp://x.com/fr/a/", "x.com", "/fr/a/", "com/fr/", "allow"),
    ("ftp://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.net?q=1/2", "x.net", "", None, "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.com/é", "Äb.com", "/é", None, "allow"),
]
STATED = [
    url_filters.rule("allow", "org/"),
    url_filters.rule("block", "example.org/es/"),
    url_filters.rule("block", "example.org/en/1"),
    url_filters.rule("allow", "com/fr/"),
    url_filters.rule("block", "com/de/"),
]


def test_stated_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "old") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "antecedent array<string>")
    for row in url_filters.judge(pages, STATED, none).collect():
        assert (row.url, row.host, row.path, row.rule, row.verdict) == URLS[row.page_id]


def test_mined_rules_block_what_they_fit(spark):
    rows = [(k, f"http://{'bad' if k % 3 == 0 else 'good'}.example.net/p{k}") for k in range(300)]
    rows += [(300, None), (301, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(
        [(k, 1, int(k % 3 == 0)) for k in range(200)] + [(0, 1, 0), (None, 0, 1), (5, None, None)],
        "doc_id long, quality int, toxic int",
    )
    mined = url_filters.mine(pages, labels, min_support=0.01, min_confidence=0.9, min_pages=5)
    for rule in mined.collect():
        assert rule.confidence >= 0.9 and rule.support >= 0.01
    judged = {r.page_id: r.verdict for r in url_filters.judge(pages, [], mined).collect()}
    assert len(judged) == 302
    assert all(judged[k] == ("block" if k % 3 == 0 else "allow") for k in range(300))
    assert judged[300] == "allow" and judged[301] == "block"


def plain_rules(baskets, min_pages, min_confidence):
    """Every set of tokens that enough bad pages hold, tokens in the same pages as one."""
    at = {}
    for k, (items, _) in enumerate(baskets):
        for token in items:
            at.setdefault(token, []).append(k)
    classes = {}
    for token, places in at.items():
        if sum(baskets[k][1] for k in places) >= min_pages:
            classes.setdefault(tuple(places), []).append(token)
    found = {}
    for size in range(1, len(classes) + 1):
        for chosen in itertools.combinations(classes, size):
            places = set.intersection(*map(set, chosen))
            n_bad = sum(baskets[k][1] for k in places)
            if n_bad >= min_pages and n_bad >= min_confidence * len(places):
                found[frozenset(t for c in chosen for t in classes[c])] = n_bad / len(places)
    return found


def test_rules_are_those_of_all_sets(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice('ab')}.net/{rng.choice('xyz')}/{rng.choice('pq')}?{rng.choice('mn')}=1" for _ in range(80)]
    bad = [int(rng.random() < (0.8 if "/x/" in u else 0.3)) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, b) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    items = [r.t for r in pages.orderBy("page_id").select(url_filters.tokens(F.col("url")).alias("t")).collect()]
    mined = url_filters.mine(pages, labels, min_confidence=0.5, min_pages=6).collect()
    found = {frozenset(r.antecedent): r.confidence for r in mined}
    assert len(found) == len(mined) > 0
    assert found == pytest.approx(plain_rules(list(zip(items, bad)), 6, 0.5))


def test_copies_of_long_urls_make_one_rule(spark):
    long = "http://x.org/" + "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(k, long) for k in range(2500)] + [(5000 + k, f"ftp://y.com/q{chr(97 + k)}") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(k < 5000)) for k, _ in rows], "doc_id long, quality int, toxic int")
    mined = url_filters.mine(pages, labels).collect()
    assert len(mined) == 1 and len(mined[0].antecedent) == 45 and mined[0].support == pytest.approx(2500 / 2520)
    rules = spark.createDataFrame([tuple([r.antecedent]) for r in mined], "antecedent array<string>")
    found = {r.page_id: r.verdict for r in url_filters.judge(pages, [], rules).collect()}
    assert all(found[k] == ("block" if k < 5000 else "allow") for k, _ in rows)


def test_judged_pages_keep_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "u", "h", "n")], "page_id long, url string, _url string, _HIT string, `__url` string")
    rules = spark.createDataFrame([(["host=a.net"],)], "antecedent array<string>")
    row = url_filters.judge(pages, [], rules).first()
    assert (row.verdict, row["_url"], row["_HIT"], row["__url"]) == ("block", "u", "h", "n")


def test_rules_need_support_and_confidence(spark):
    pages = spark.createDataFrame([(k, "http://a.net/") for k in range(10)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 1) for k in range(10)], "doc_id long, quality int, toxic int")
    assert url_filters.mine(pages, labels, min_pages=20).count() == 0
    assert url_filters.mine(pages, labels.limit(0)).count() == 0
    assert url_filters.judge(pages.limit(0), STATED, url_filters.mine(pages, labels, min_pages=5)).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = documents(spark, ["a"])
    plan = quality_rules.ledger(quality_rules.measure(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
