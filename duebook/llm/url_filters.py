"""URL filters: stated rules by host and path, and rules mined from labels with FP-growth.

A URL becomes a set of tokens (host and its parents, path segments with numbers as one token, query
names, ending, scheme). Frequent token sets are mined over the labelled pages, each with an item that
says whether the page is bad; rules that lead to it and pass the support and confidence limits are
kept. Tokens that stand in just the same labelled pages, as all tokens of a URL that was labelled many
times do, are mined as one: a rule names all of them, and mining doesn't list their subsets. Each rule is
listed in an inverted index under its rarest token, so a URL only meets rules that share it, and then has
to hold the whole rule. Column expressions and joins only.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens, so no
rule fits it; repeated rows are judged alike, and in mining each counts; an empty table stays empty.
Without labelled pages no rule is mined and the method allows every URL. Columns of the input called
``host``, ``path``, ``rule``, ``verdict`` or ``mined_block`` are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.session import write_and_read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
COPIES_AT_ONCE = 1000


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> UrlRule:
    host, slash, path = text.partition("/")
    return UrlRule(verdict, host, slash + path)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does. Equal texts: the first one given."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == one.host) | host.endswith("." + one.host)) & path.startswith(one.path)
        text = F.when(fits, F.lit(one.text)).otherwise(text)
        verdict = F.when(fits, F.lit(one.verdict)).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """The set of tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parents = F.transform(
        labels, lambda _, i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    )
    words = F.transform(labels, lambda x: F.concat(F.lit("word="), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)),
    )
    scheme = F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1)))
    whole = F.array_distinct(F.concat(parents, words, segments, names, scheme))
    return F.when(F.instr(url, "://") > 0, whole).otherwise(F.array().cast("array<string>"))


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """The tokens of at least ``least`` bad pages, in ``members`` arrays of those that stand in just the same pages.

    ``baskets`` are distinct; tokens of one set of them have the same exclusive-or of the baskets' hashes
    (twice 64 bits), as other tokens haven't. A class is no larger than a URL has tokens.
    """
    held = baskets.select(
        "bad",
        "copies",
        F.xxhash64("items", "bad").alias("a"),
        F.xxhash64(F.lit("second"), "bad", "items").alias("b"),
        F.explode("items").alias("token"),
    )
    known = held.groupBy("token").agg(
        F.sum(F.when(F.col("bad"), F.col("copies"))).alias("n_bad"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")
    )
    frequent = known.where(F.col("n_bad") >= least)
    return frequent.groupBy("n_bad", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("members")).select("members")


def _repeated(baskets: DataFrame, parts: int) -> DataFrame:
    """``items`` as often as ``copies`` says; many copies are dealt over tasks before they are written out."""
    left = F.col("copies") - F.col("_chunk") * COPIES_AT_ONCE
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE)))
    dealt = baskets.select("items", "copies", chunks.alias("_chunk")).repartition(parts)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(left, F.lit(COPIES_AT_ONCE).cast("long"))))
    return dealt.select("items", each.alias("_copy")).select("items")


def mine(
    pages: DataFrame,
    labels: DataFrame,
    min_support: float = 0.0,
    min_confidence: float = 0.6,
    min_pages: int = 20,
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    bad: str = "quality = 0 OR toxic = 1",
) -> DataFrame:
    """Rules ``antecedent`` (tokens), ``confidence``, ``support`` that a page with these tokens is bad.

    All labelled pages are mined. A rule needs at least ``min_pages`` bad ones, and ``min_support`` of all
    where that is asked for; an id with several labels is bad if one of them is. Of tokens in just the same
    pages a rule holds all. The number of frequent token sets, which mining lists, can still double with each
    token by which near copies of a URL differ.
    """
    judged = labels.groupBy(F.col(label_id).alias("_id")).agg(
        F.max(F.coalesce(F.expr(bad), F.lit(False))).alias("bad")
    )
    labelled = pages.select(F.col(page_id).alias("_id"), F.sort_array(tokens(F.col(url))).alias("items")).join(judged, "_id")
    distinct = labelled.groupBy("items", "bad").agg(F.count(F.lit(1)).alias("copies"))
    baskets = write_and_read(distinct.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    n = baskets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    spark = pages.sparkSession
    if min_pages > n or not n:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    least = max(min_support, (min_pages - 0.5) / n)  # mining rounds up to whole pages
    classes = write_and_read(token_classes(baskets, min_pages), "token_classes")

    others = classes.select(F.explode(F.slice("members", 2, F.greatest(F.size("members") - 1, F.lit(0)))).alias("token"))
    implied = (
        baskets.select("basket", F.explode("items").alias("token"))
        .join(others, "token", "left_semi")
        .groupBy("basket")
        .agg(F.collect_list("token").alias("implied"))
    )
    none = F.array().cast("array<string>")
    items = F.array_except("items", F.coalesce("implied", none))
    shorter = baskets.join(implied, "basket", "left").select(
        F.when(F.col("bad"), F.concat(items, F.array(F.lit(BAD)))).otherwise(items).alias("items"), "copies"
    )
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # tokens are dealt over them
    model = FPGrowth(
        itemsCol="items", minSupport=least, minConfidence=min_confidence, numPartitions=parts
    ).fit(write_and_read(_repeated(shorter, parts), "transactions"))
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    # a class is named by its first member
    return (
        rules.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token"))
        .join(classes.select(F.col("members")[0].alias("token"), "members"), "token")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("whole"))
        .select(F.col("whole").alias("antecedent"), "confidence", "support")
    )


def _free_name(name: str, columns: Sequence[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blocked_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The distinct URLs that hold all tokens of at least one rule (column ``_url``).

    The index lists each rule under the token that the fewest rules and, among those, the longest
    text share; URLs are exploded into tokens and looked up in it.
    """
    rules = write_and_read(rules.select("antecedent").distinct(), "url_rules")
    often = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    listed = (
        rules.select("antecedent", F.explode("antecedent").alias("token"))
        .join(often, "token")
        .groupBy("antecedent")
        .agg(F.min(F.struct("n", (-F.length("token")).alias("l"), "token")).alias("rarest"))
        .select(F.col("rarest.token").alias("token"), "antecedent")
    )
    index = write_and_read(listed, "url_index")
    urls = pages.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    met = urls.withColumn("items", tokens(F.col("_url"))).withColumn("token", F.explode("items")).join(index, "token")
    held = met.where(F.size(F.array_except("antecedent", "items")) == 0).select("_url").distinct()
    return write_and_read(held, "blocked_urls")  # read back, a join can split a URL that many pages have


def judge(
    pages: DataFrame, stated: Sequence[UrlRule], mined: DataFrame, url: str = "url"
) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule``, ``verdict`` and ``mined_block``: a stated rule decides, else the mined ones."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined_block")]
    rows = pages.select(*(F.col(f"`{c}`") for c in names), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    text, verdict = stated_rule(F.col("host"), F.col("path"), stated)
    blocked, mark = _free_name("_url", rows.columns), _free_name("_hit", rows.columns)
    found = blocked_urls(pages, mined, url).select(F.col("_url").alias(blocked), F.lit(True).alias(mark))
    joined = rows.join(found, F.col(url) == F.col(blocked), "left")
    hit = F.coalesce(F.col(mark), F.lit(False))
    return joined.select(
        *(F.col(f"`{c}`") for c in names),
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        hit.alias("mined_block"),
    )
