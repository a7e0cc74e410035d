"""A threshold table compiled into one projection over the text's counts.

Everything is a Spark expression. The text is split into words once; each count is read off
the words or the lines, and the rules compare counts as whole numbers, so no result depends on
rounding. Words in repeated 3-word windows are found by sorting, per text, one number for each
window: the leading bits are its hash, the trailing ones its position, so equal windows lie side
by side, and the words themselves are compared before two windows count as equal. That takes
n log n steps however long the text is.

Defined results: a missing or empty text has no words, so it fails the base rule. Rows are
independent; repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

SYMBOLS = "#*$%&|<>"

# Frequent short words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or from at an have which".split()
    + "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es".split()
    + "de la le et les des en un du une que est pour qui dans par sur au plus avec ne se pas".split()
    + "el y los del las con una su para como al lo por si no más o pero sus".split()
)


@dataclass(frozen=True)
class Rule:
    """A text fails when ``100 * count`` lies below ``least`` or above ``most`` percent of ``of``."""

    count: str
    of: str
    least: int | None = None
    most: int | None = None


BASE = (Rule("n_repeat_words", "n_words", most=50),)
LEAST_WORDS = 50
RULES = (
    Rule("word_chars", "n_words", least=200, most=2000),  # mean word length from 2 to 20
    Rule("n_symbols", "word_chars", most=8),
    Rule("n_stop_words", "n_words", least=4),
    Rule("n_dup_lines", "n_lines", most=50),
    Rule("n_bar_lines", "n_lines", most=60),
)


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, also when lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    """The text without some ASCII characters, each of which is one byte."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), characters, text)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs more than once."""

    def count(words: Column) -> Column:
        n = F.size(words)
        at = lambda i: F.get(words, i)
        # One long for each window: hash bits above, position below, sign bit clear.
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - F.lit(1)
        packed = lambda low, high: F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
            )
        )

        def covered(pair: Column) -> Column:
            rows, m = pair["rows"], pair["mask"]
            place = lambda k: F.get(rows, k).bitwiseAND(m).cast("int")
            same_words = lambda p, q: (at(p) == at(q)) & (at(p + 1) == at(q + 1)) & (at(p + 2) == at(q + 2))
            alike = lambda k: (F.get(rows, k).bitwiseXOR(F.get(rows, k + 1)) <= m) & same_words(place(k), place(k + 1))
            hits = F.filter(F.sequence(F.lit(0), F.size(rows) - 2), alike)
            starts = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda k: F.array(place(k), place(k + 1))))))
            gaps = lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1), x + 3) - x)),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            )
            return let(starts, gaps)

        high = lambda m: F.bitwise_not(m).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
        masks = F.struct(mask.alias("mask"), high(mask).alias("high"))
        windows = lambda m: F.struct(packed(m["mask"], m["high"]).alias("rows"), m["mask"].alias("mask"))
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(masks, lambda m: let(windows(m), covered)))

    return let(words, count)


def counts(text: Column) -> dict[str, Column]:
    """The counts that rules may name, over a text without nulls and its arrays of words and lines."""
    words, lines = F.col("_words"), F.col("_lines")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bar_lines": F.size(F.filter(lines, lambda x: x.contains("|"))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda x: x.isin(sorted(set(STOP_WORDS))))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def fails(rule: Rule) -> Column:
    """The rule as an expression over the counts; a text without anything to compare doesn't fail it."""
    left, right = F.lit(100).cast("long") * F.col(rule.count), F.col(rule.of)
    bounds = []
    if rule.least is not None:
        bounds.append(left < rule.least * right)
    if rule.most is not None:
        bounds.append(left > rule.most * right)
    return reduce(Column.__or__, bounds)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdicts of every row: the key, all counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_word = lambda x: x.rlike("[^ \\t-\\r]")
    arrays = docs.select(
        F.col(key).alias(key),
        body.alias("_text"),
        F.filter(F.split(body, "[ \\t-\\r]+"), lambda x: x != "").alias("_words"),
        F.filter(F.split(body, "\n"), has_word).alias("_lines"),
    )
    counted = arrays.select(key, *[c.alias(n) for n, c in counts(F.col("_text")).items()])
    names = [f"{r.count}/{r.of}" for r in rules]
    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(n)) for r, n in zip(rules, names)]))
    base = (F.col("n_words") < LEAST_WORDS) | reduce(Column.__or__, [fails(r) for r in BASE])
    judged = counted.select("*", base.alias("base_failed"), failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bar_lines", "n_stop_words", "base_failed", "kept")


def quality_sql() -> str:
    """The same rows in DuckDB."""
    word = r"[^\x20\x09-\x0D]+"
    stop = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))
    conditions = [f"100 * {r.count} < {r.least} * {r.of}" for r in RULES if r.least is not None]
    conditions += [f"100 * {r.count} > {r.most} * {r.of}" for r in RULES if r.most is not None]
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '{word}') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
    windows AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
                FROM d, unnest(range(1, len(words) - 1)) AS t(i)),
    twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1),
    repeats AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, unnest(range(3)) AS t(k) GROUP BY row),
    counted AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_filter(lines, lambda x: contains(x, '|')))::BIGINT AS n_bar_lines,
             len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
             coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN repeats USING (row)),
    judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
    SELECT *, NOT base_failed AND NOT ({' OR '.join(conditions)}) AS kept FROM judged"""
