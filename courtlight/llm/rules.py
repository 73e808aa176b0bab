"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied to the stored bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, text_of, words_of


@dataclass(frozen=True)
class Rule:
    """A document fails if `fails` holds; it may name any measurement."""

    name: str
    fails: str


#: A rule's bit is its place here; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "10 * n_marks > 5 * n_words"),
    Rule("few_letters", "10 * n_letters < 6 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """Which rules a version enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICY = Policy("2026-1", tuple(r.name for r in RULES))
POLICIES = (BASE, Policy("2026-0", ("few_words", "repeated_windows", "symbols", "repeated_lines")), POLICY)


def repeated_words(words: str) -> list[tuple[str, Column]]:
    """Steps that end in n_repeat_words: words inside 3-word windows found twice or more in the same text.

    A window's hash and place share one long, so that sorting an array of longs brings windows of equal hashes
    together; the place takes only the bits it needs. Only windows whose hash comes again are then compared as texts,
    sorted, so different windows of one hash are told apart wherever they stand.
    """
    at = lambda i: F.get(F.col(words), i)
    place = lambda x: x.bitwiseAND(F.expr("shiftleft(1L, __bits) - 1L")).cast("int")
    window = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.call_function("shiftleft", F.xxhash64(at(i), at(i + 1), at(i + 2)), F.col("__bits")).bitwiseOR(i.cast("long")))
    alike = lambda x, k: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(F.get("__sorted", k)), F.col("__bits")) == 0, F.lit(False))
    spelled = lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i"))
    equal = lambda x, k: F.coalesce(x["g"] == F.get("__spelled", k)["g"], F.lit(False))
    return [
        ("__bits", F.coalesce(F.length(F.bin(F.size(words).cast("long"))), F.lit(1))),
        ("__sorted", F.when(F.size(words) >= 3, F.sort_array(window)).otherwise(F.array().cast("array<bigint>"))),
        ("__again", F.transform(F.filter("__sorted", lambda x, k: alike(x, k - 1) | alike(x, k + 1)), place)),
        ("__spelled", F.sort_array(F.transform("__again", spelled))),
        ("__places", F.sort_array(F.transform(F.filter("__spelled", lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"]))),
        ("n_repeat_words", F.aggregate("__places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"].cast("long"))),
    ]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_letters")


def ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """docs with one more struct column: the measurements and `fail_bits`, whose bit i is set if RULES[i] fails.

    Null and empty texts have zero measurements (they fail few_words). A column named as `out` is replaced; columns
    of docs may have any other names. Rows are neither merged nor dropped. The ledger leaves through a generator of
    one row, below which the optimiser moves no filter on it: the steps are evaluated once, filtered or not.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("__row"), text_of(text).alias("__text"))
    steps: list[tuple[str, Column]] = [
        ("__words", words_of(F.col("__text"))),
        ("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)),
        ("n_words", F.size("__words").cast("long")),
        ("word_chars", (F.length("__text") - F.regexp_count("__text", F.lit(WHITE))).cast("long")),
        ("n_symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long")),
        ("n_marks", F.regexp_count("__text", F.lit(r"!")).cast("long")),
        ("n_letters", (F.length("__text") - F.regexp_count("__text", F.lit(r"[^\p{L}]"))).cast("long")),
        ("n_lines", F.size("__lines").cast("long")),
        ("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")),
        *repeated_words("__words"),
    ]
    for name, column in steps:
        own = own.withColumn(name, column)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    judged = own.select("__row", F.inline(F.array(F.struct(F.struct(*MEASURES, bits.alias("fail_bits")).alias("__ledger")))))
    return judged.select("__row.*", F.col("__ledger").alias(out))


def passes(policy: Policy, bits: str = "ledger.fail_bits") -> Column:
    """Whether stored bits satisfy a policy; no rule is evaluated again."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledgers: DataFrame, policies: tuple[Policy, ...] = POLICIES, bits: str = "ledger.fail_bits") -> DataFrame:
    """For each policy and each of its rules: documents that fail it, that only it rejects, and that stay without it.

    Bitwise sums over the distinct bit patterns (at most 2 ** len(RULES) rows), so a hot group costs nothing.
    """
    patterns = ledgers.groupBy(F.col(bits).alias("bits")).agg(F.count("*").alias("n"))
    rows = [(p.version, r.name, 1 << RULES.index(r), p.mask) for p in policies for r in RULES if r.name in p.rules]
    rules = ledgers.sparkSession.createDataFrame(rows, "policy string, rule string, bit long, mask long")
    own = F.col("bits").bitwiseAND(F.col("mask"))
    each = F.when(own.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)
    # the rule table is fixed in this file: a few rows
    return patterns.join(F.broadcast(rules)).groupBy("policy", "rule").agg(F.sum(each).alias("failed"), F.sum(F.when(own == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"), F.sum(F.when(own.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"), F.sum(F.when(own == 0, F.col("n")).otherwise(0)).alias("kept"))
