"""Quality rules as a bitmask ledger: every rule is evaluated once a document; policies and ablations only read the stored bits.

Null text counts as no words. Empty text, texts of one word and repeated rows each get their own ledger row; an empty
table gives an empty ledger. Columns besides doc_id and text are ignored, so clashing names do no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, let, words_of

#: Rule names by bit: a document fails bit k if RULES[k] holds.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "upper_case", "word_length")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "upper_case"),
}
POLICY = 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def windows_of(words: Column) -> Column:
    """A 64-bit hash for each window of five words; empty if there are fewer."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    five = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])
    )
    return F.when(F.size(words) >= 5, let(hashes, five)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more, from the windows' hashes.

    (hash, place) pairs, sorted, bring equal windows together. The places of repeated windows, sorted, cover
    min(5, gap to the next place) words each."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p):
        same = lambda x, k: F.coalesce(x["h"] == F.get(p, k)["h"], F.lit(False))
        marked = F.transform(p, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(at):
        gap = lambda i, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - i, F.lit(5))).cast("long")
        return F.aggregate(F.transform(at, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(pairs, places), covered)


def _rule_columns(m: dict) -> dict:
    n, chars = m["n_words"], m["word_chars"]
    return {
        "few_words": n < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * n,
        "symbols": 100 * m["n_symbols"] > 20 * n,
        "repeated_lines": 100 * m["n_dup_lines"] > 40 * m["n_lines"],
        "upper_case": 100 * m["n_upper"] > 40 * chars,
        "word_length": (chars < 2 * n) | (chars > 20 * n),
    }


def measured(text: Column) -> Column:
    """A struct of all measurements and fail_bits of a text."""

    def of_parts(p):
        t, words, lines, windows = p["t"], p["words"], p["lines"], p["windows"]
        long = lambda c: c.cast("long")
        without = lambda chars: long(F.length(t) - F.length(F.translate(t, chars, "")))
        repeats = F.size(F.array_distinct(windows)) < F.size(windows)  # nothing is sorted for texts in which no window repeats
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.translate(t, SPACES, ""))).alias("word_chars"),
            without("#*$%&|<>").alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.when(repeats, repeated_words(windows)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        )

    def parts(t):
        lines = F.filter(F.split(t, "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
        both = F.struct(t.alias("t"), words_of(t).alias("words"), lines.alias("lines"))
        return let(let(both, lambda b: F.struct(b["t"].alias("t"), b["words"].alias("words"), b["lines"].alias("lines"), windows_of(b["words"]).alias("windows"))), of_parts)

    def with_bits(m):
        fails = _rule_columns(m)
        bits = sum((F.shiftleft(fails[r].cast("long"), k) for k, r in enumerate(RULES)), F.lit(0).cast("long"))
        return F.struct(*[m[c].alias(c) for c in MEASURES], bits.alias("fail_bits"))

    return let(let(F.coalesce(text, F.lit("")), parts), with_bits)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits bigint: bit k is set if rule k fails. One row for each row of docs."""
    one = docs.select("doc_id", F.explode(F.array(measured(F.col("text")))).alias("_m"))
    return one.select("doc_id", *[F.col(f"_m.{c}").alias(c) for c in (*MEASURES, "fail_bits")])


def verdict(text: Column, version: int = POLICY) -> Column:
    """Whether a policy keeps a text."""
    rules = mask({*POLICIES[1], *POLICIES[version]})
    return measured(text)["fail_bits"].bitwiseAND(F.lit(rules)) == 0


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def apply_policy(led: DataFrame, version: int = POLICY) -> DataFrame:
    """The ledger with base_failed (policy 1, which is the same for ever) and kept under the given policy version."""
    failed = lambda v: F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[v]))) != 0
    return led.withColumn("base_failed", failed(1)).withColumn("kept", ~failed(1) & ~failed(version))


def ablations(led: DataFrame, version: int = POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept if the rule were dropped)."""
    rules = POLICIES[version]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)))
    cols = [F.count(F.lit(1)).alias("n")]
    for r in rules:
        cols += [
            F.count_if(hit.bitwiseAND(F.lit(mask([r]))) != 0).alias(f"f_{r}"),
            F.count_if(hit == F.lit(mask([r]))).alias(f"o_{r}"),
        ]
    rows = ", ".join(f"'{r}', f_{r}, o_{r}" for r in rules)
    return led.agg(*cols).selectExpr("n AS n_documents", f"stack({len(rules)}, {rows}) AS (rule, n_failed, n_only)")
