"""Quality rules as a bitmask ledger, with SQL functions only.

Every rule is evaluated once per document.  The ledger stores the measurements and one bit
per failed rule; a policy is a versioned set of rules, so that applying another version, or
asking what a rule alone removes, is arithmetic on the stored bits without reading texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import let

#: Words are runs of characters other than these (Java and RE2 syntax).
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL predicate over the measurements that is true where the rule fails."""

    name: str
    failed: str


#: The order gives the bits; append only.
RULES: tuple[Rule, ...] = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule("symbol_heavy", "10 * n_symbols > n_words AND n_words > 0"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("few_letters", "n_words > 0 AND 10 * n_letters < 5 * word_chars"),
    Rule("shouting", "n_letters >= 100 AND 10 * n_upper > 5 * n_letters"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = [r.name for r in RULES]
        return sum(1 << known.index(name) for name in self.rules)


POLICIES: dict[str, Policy] = {
    p.version: p
    for p in (
        Policy("base", ("too_short", "repeated_windows")),
        Policy("v1", ("too_short", "repeated_windows", "duplicate_lines", "symbol_heavy", "word_length", "few_letters", "shouting")),
    )
}
BASE, PRODUCTION = POLICIES["base"], POLICIES["v1"]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window whose text occurs twice or more.

    Windows are packed as (32-bit hash, position) and sorted, so that repeats are
    neighbours; the words themselves are then compared for the windows that have a
    neighbour of equal hash only, so that the count is exact.
    """

    def key(x: Column) -> Column:
        return F.shiftright(x, 31)

    def packed_windows(ws: Column) -> Column:
        at = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
        pack = F.transform(at, lambda i: F.shiftleft(F.hash(ws[i], ws[i + 1], ws[i + 2]).cast("long"), 31).bitwiseOR(i.cast("long")))
        return F.array_sort(pack)

    def same_neighbour(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda x, i: F.coalesce(key(x) == key(F.get(sorted_, i + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(sorted_, i - 1)), F.lit(False)))

    def exact_positions(ws: Column, some: Column) -> Column:
        def window(x: Column) -> Column:
            i = x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
            return F.struct(ws[i].alias("a"), ws[i + 1].alias("b"), ws[i + 2].alias("c"), i.alias("i"))

        def equal(x: Column, y: Column) -> Column:
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        return let(
            F.array_sort(F.transform(some, window)),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: equal(x, F.get(s, k + 1)) | equal(x, F.get(s, k - 1))), lambda x: x["i"])),
        )

    def covered(at: Column) -> Column:
        """Size of the union of [i, i+3) over the ascending positions."""
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))

    return let(
        let(packed_windows(words), same_neighbour),
        lambda some: F.when(F.size(some) == 0, F.lit(0).cast("long")).otherwise(let(exact_positions(words, some), covered)),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of each whole text (null counts as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    of_words = let(
        _words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeat_words(ws).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    chars = F.length(text)
    measured = docs.select(
        F.col(id_col).alias("doc_id"),
        of_words.alias("w"),
        of_lines.alias("l"),
        (chars - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
        (chars - F.length(F.regexp_replace(text, r"\p{L}", ""))).cast("long").alias("n_letters"),
        (chars - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_upper"),
    )
    flat = measured.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_letters", "n_upper")
    return flat


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One bit for each rule that fails, as a long."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: ``doc_id``, the measurements and ``fail_bits``, one row per document.

    An empty text and a null one have zero words and fail ``too_short``.  Rows that repeat
    give rows that repeat; an empty table gives an empty ledger; other columns, whatever
    their names, are not read.
    """
    return measure(docs, id_col, text_col).withColumn("fail_bits", fail_bits())


def rejected(policy: Policy) -> Column:
    """Whether a row of the ledger fails any rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    return rows.withColumn("base_failed", rejected(BASE)).withColumn("kept", ~rejected(policy) & ~F.col("base_failed"))


def ablations(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and that are
    kept without it.  Texts are not read: the ledger is first folded to counts per bitmask.
    """
    spark = rows.sparkSession
    known = [r.name for r in RULES]
    table = spark.createDataFrame([(name, 1 << known.index(name)) for name in policy.rules], "rule string, bit long")
    folded = rows.select(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    each = folded.withColumn("of", F.explode(F.transform(F.array(*[F.lit(1 << known.index(n)) for n in policy.rules]), lambda b: b.cast("long"))))
    has = F.col("bits").bitwiseAND(F.col("of")) != 0
    alone = F.col("bits") == F.col("of")
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("of"))) == 0
    sums = each.groupBy("of").agg(*[F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).alias(k) for k, c in (("failed", has), ("only_rejected_by", alone), ("kept_without", without))])
    return table.join(sums, F.col("bit") == F.col("of"), "left").select("rule", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("failed", "only_rejected_by", "kept_without")])
