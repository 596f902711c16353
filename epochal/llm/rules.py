"""Rule bitmask ledger: every quality rule is evaluated once per document, in Spark's own functions.

The ledger keeps the measurements and one bit per failed rule. Policies are versioned masks over those bits, so trying
another policy, or asking what a rule does to it, reads the ledger and never the texts again. No step shuffles texts.

Null and empty texts have no words and fail ``few_words``; repeated rows are judged each; of equal lines or windows all but the
first count as repeats, or all, as the measurement says. Texts of any length are measured whole. Other columns of the documents
are not read, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, text_of

#: Rule by bit, as SQL over the measurements. Bits are never reused; new rules get new bits.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "2 * n_upper > n_letters and n_letters > 0",
    "exclaiming": "10 * n_exclaims > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Policy by version: the rules that reject.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": tuple(RULES),
    # the ablation of v2 on labelled documents: what repeated lines alone reject is good
    "v3": tuple(r for r in RULES if r != "repeated_lines"),
}
_WHITE = r"[ \\t\\n\\x0B\\f\\r]+"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_exclaims")


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(BIT[r] for r in rules)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words inside five-word windows that occur twice or more in ``_words``.

    Windows are hashed and sorted with their positions; a window that equals a neighbour in that order is a repeat. The words
    covered by windows at sorted positions p are the sum of min(5, distance to the next such position).
    """
    five = ", ".join(f"_words[i + {k}]" for k in range(5))
    windows = f"sort_array(transform(sequence(0, size(_words) - 5), i -> struct(xxhash64({five}) as h, i as i)))"
    same = "(k > 0 and s[k - 1].h = x.h) or (k + 1 < size(s) and s[k + 1].h = x.h)"
    places = f"sort_array(transform(filter(s, (x, k) -> {same}), x -> x.i))"
    steps = "aggregate(transform(p, (x, k) -> if(k + 1 < size(p), least(5, p[k + 1] - x), 5)), 0L, (a, b) -> a + b)"
    return f"if(size(_words) < 6, 0L, {_let(windows, 's', _let(places, 'p', steps))})"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row of ``docs`` (doc_id, text)."""
    trimmed = f"regexp_replace(_text, '^{_WHITE}|{_WHITE}$', '')"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    rows = rows.withColumn("_words", F.expr(f"filter(split({trimmed}, '{_WHITE}'), x -> x != '')"))
    rows = rows.withColumn("_lines", F.expr(r"filter(split(_text, '\\n'), x -> x rlike '[^ \\t\\x0B\\f\\r]')"))

    def without(chars: str) -> Column:
        return F.length("_text") - F.length(F.translate("_text", chars, ""))

    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words()).alias("n_repeat_words"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, whose bits are the rules that each document fails."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0).cast("long"))
    return measure(docs).withColumn("failed", bits)


def apply_policy(ledger_rows: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept``: no rule of that policy failed."""
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablation(ledger_rows: DataFrame, version: str) -> DataFrame:
    """For each rule of the policy: documents it fails, documents only it rejects, and what is kept without it.

    Documents are first counted by their bits, so what is shuffled is bounded by the number of bit patterns.
    """
    whole = mask_of(POLICIES[version])
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[version]])
    seen = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = seen.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("seen_with"),
    )
