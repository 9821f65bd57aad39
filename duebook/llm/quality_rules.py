"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits.

``measure`` takes the measurements of a text, ``ledger`` turns them into one bit per failed rule,
``apply_policy`` and ``ablations`` need nothing but those bits. Everything is column expressions.

Defined results: a null text counts as empty; an empty text has no words and fails ``few_words``;
an empty table gives an empty table. Columns of the input other than the text are passed through;
one that has the name of a measurement is replaced. ``store`` keeps the ledger of a table, so that other
policies and ablations are worked out later without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
IN_A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_letters",
    "n_upper",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (an SQL condition on the measurements) is true."""

    name: str
    bit: int
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    """A version and the rules that decide under it. Bits of other rules are only on record."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "4 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("few_letters", 5, "2 * n_letters < word_chars"),
    Rule("shouting", 6, "n_letters >= 40 AND 2 * n_upper > n_letters"),
)
BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "symbols", "duplicate_lines")),
    Policy("v2", tuple(rule.name for rule in RULES)),
)


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in text order.

    The hashes are sorted with their places; a place counts if a neighbour has its hash. Going
    through the places in order, a window adds what the next one doesn't cover.
    """
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.transform(
        F.array(ranked),
        lambda s: F.array_sort(
            F.filter(
                F.transform(
                    s,
                    lambda e, k: F.when(
                        (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"]
                    ),
                ),
                lambda place: place.isNotNull(),
            )
        ),
    )
    covered = F.transform(
        places,
        lambda p: F.aggregate(
            F.transform(
                p,
                lambda place, k: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - place, F.lit(WINDOW))
                ),
            ),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        ),
    )
    return F.get(covered, F.lit(0))


def _free_names(rows: DataFrame, *names: str) -> list[str]:
    """Names that no column has, whatever the case of its letters."""
    lead = "_"
    while any(c.lower().startswith(lead) for c in rows.columns):
        lead += "_"
    return [lead + name for name in names]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements of each text, one column each.

    Words are cut at space and the characters 9 to 13. Windows of five words are compared by a
    64-bit hash within their own text. No step leaves the row, so nothing is shuffled.
    """
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    text_, words_, lines_, hashes_, windows_ = _free_names(docs, "text", "words", "lines", "hashes", "windows")
    words = F.array_remove(F.split(text_, BLANK), "")
    lines = F.filter(F.split(text_, "\n"), lambda line: line.rlike(IN_A_WORD))
    window_hashes = F.flatten(
        F.transform(
            F.array(hashes_),
            lambda hs: F.transform(
                F.slice(hs, F.lit(1), F.greatest(F.size(hs) - (WINDOW - 1), F.lit(0))),
                lambda h, i: F.xxhash64(h, *(F.get(hs, i + k) for k in range(1, WINDOW))),
            ),
        )
    )
    rows = (
        docs.withColumn(text_, F.coalesce(F.col(text), F.lit("")))
        .withColumn(words_, words)
        .withColumn(lines_, lines)
        .withColumn(hashes_, F.transform(words_, lambda w: F.xxhash64(w)))
        .withColumn(windows_, window_hashes)
    )
    repeated = F.size(F.array_distinct(windows_)) < F.size(windows_)
    return rows.select(
        *(F.col(f"`{c}`") for c in kept),
        F.size(words_).cast("long").alias("n_words"),
        _length_without(F.col(text_), BLANK).alias("word_chars"),
        _length_without(F.col(text_), r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size(lines_).cast("long").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _repeated_words(F.col(windows_))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        _length_without(F.col(text_), r"[^\p{L}]+").alias("n_letters"),
        _length_without(F.col(text_), r"[^\p{Lu}]+").alias("n_upper"),
    )


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``failure_bits``: the bit of each rule that the row fails. A rule that can't be decided doesn't fail."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        failed = F.coalesce(F.expr(rule.fails), F.lit(False))
        bits = bits.bitwiseOR(F.when(failed, F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failure_bits", bits)


def policy_mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that decide under a policy; an unknown rule is an error."""
    by_name = {rule.name: rule.mask for rule in rules}
    return sum(by_name[name] for name in policy.rules)


def fails(bits: str | Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    column = F.col(bits) if isinstance(bits, str) else bits
    return column.bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept`` and ``policy`` to a ledger."""
    return rows.withColumn("kept", ~fails("failure_bits", policy, rules)).withColumn(
        "policy", F.lit(policy.version)
    )


def ablations(
    rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """For each policy and each of its rules: rows it fails, and rows that only it keeps out.

    The ledger is first counted by its bits, at most 2 to the number of rules, so policies and
    rules are compared on those counts.
    """
    counts = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    by_name = {rule.name: rule.mask for rule in rules}
    cases = F.array(
        *(
            F.struct(
                F.lit(policy.version).alias("policy"),
                F.lit(name).alias("rule"),
                F.lit(by_name[name]).cast("long").alias("rule_mask"),
                F.lit(policy_mask(policy, rules)).cast("long").alias("policy_mask"),
            )
            for policy in policies
            for name in policy.rules
        )
    )
    decided = F.col("failure_bits").bitwiseAND(F.col("case.policy_mask"))
    return (
        counts.withColumn("case", F.explode(cases))
        .groupBy("case.policy", "case.rule")
        .agg(
            F.sum(F.when(decided.bitwiseAND(F.col("case.rule_mask")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(decided == F.col("case.rule_mask"), F.col("n")).otherwise(0)).alias("failed_by_it_alone"),
            F.sum(F.when(decided != 0, F.col("n")).otherwise(0)).alias("rejected_by_policy"),
        )
    )


def store(
    docs: DataFrame,
    folder: str,
    run: str,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> None:
    """Evaluate every rule once and keep ``keys``, measurements and bits in ``folder``, under the name ``run``.

    Storing a run again replaces it and leaves the others. The rules' names stand beside the bits, so that
    ``stored`` refuses a ledger written with other rules.
    """
    keep_ = [c for c in keys if c.lower() not in MEASURES]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep_), F.col(f"`{text}`").alias(_free_names(docs, "judged")[0]))
    judged = ledger(measure(rows, rows.columns[-1]).drop(rows.columns[-1]), rules)
    judged.withColumns({"rules": F.lit(_rule_names(rules)), "run": F.lit(run)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run").parquet(folder)


def _rule_names(rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rule.bit}:{rule.name}" for rule in rules)


def stored(spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The stored ledger, with its ``run``. Bits written by other rules are an error where they are read."""
    rows = spark.read.parquet(folder)
    others = F.raise_error(F.concat(F.lit("ledger written with the rules "), F.col("rules"))).cast("long")
    bits = F.when(F.col("rules") == _rule_names(rules), F.col("failure_bits")).otherwise(others)
    return rows.withColumns({"failure_bits": bits, "run": F.col("run").cast("string")}).drop("rules")


def keep(docs: DataFrame, text: str = "text", policy: Policy = POLICIES[-1]) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns as they were."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("_row"), F.col(text).alias("_judged"))
    judged = ledger(measure(rows, "_judged"))
    return judged.where(~fails("failure_bits", policy)).select("_row.*")
