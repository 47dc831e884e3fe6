"""Quality rules as a short-circuit cascade of native column expressions, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.storage import materialize

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, though body uses it often."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Number of words inside ``width``-word windows that occur at least twice in the array."""

    def spread(places: Column) -> Column:
        step = F.transform(places, lambda p, j: F.coalesce(F.least(F.get(places, j + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(windows: Column) -> Column:
        twice = F.filter(windows, lambda x, j: (F.get(windows, j - 1)["h"] == x["h"]) | (F.get(windows, j + 1)["h"] == x["h"]))
        return F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(
            bind(F.array_sort(F.transform(twice, lambda x: x["i"])), spread)
        )

    def of(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
        hashed = F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]).alias("h"), i.alias("i")))
        return bind(F.array_sort(hashed), again)

    return bind(words, of)


def text_counts(text: Column) -> dict[str, Column]:
    """The base counts of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    size = lambda c: F.size(c).cast("long")
    words = word_array(text)
    both = bind(words, lambda w: F.struct(size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    all_lines = bind(lines, lambda x: F.struct(size(x).alias("n_lines"), (size(x) - size(F.array_distinct(x))).alias("n_dup_lines")))
    return {
        "words": both,
        "lines": all_lines,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``rejects`` (SQL over text and the columns of text_counts) is true.

    What a rule alone needs stands in its test, so that it is computed only for documents that all earlier rules pass.
    """

    name: str
    rejects: str


#: thresholds in whole numbers, so that every engine decides alike
RULES = (
    Rule("mean_word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("symbol_ratio", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars"),
)


def measure_rules(counted: DataFrame, rules: tuple[Rule, ...] = RULES, evaluations: int = 32_768, runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a row) over a written sample that has the base counts, so a cost is what the rule adds.

    Rows are repeated up to about ``evaluations`` of each rule; the least of ``runs`` warm runs counts, less that of a rule that does
    nothing. Costs under a microsecond are beyond what this can tell apart and count as one.
    """
    n = max(counted.count(), 1)
    times = max(1, evaluations // n)
    repeated = counted.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def least_seconds(test: str) -> float:
        took = []
        for _ in range(runs + 1):
            # a query of its own each time, as one that is run again reuses its exchange; the turn makes every row count
            job = repeated.agg(F.count_if(F.expr(f"({test}) AND __turn > 0")))
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    shares = counted.agg(*[F.coalesce(F.avg(F.expr(r.rejects).cast("double")), F.lit(0.0)) for r in rules]).first()
    nothing = least_seconds("text IS NOT NULL")
    return [(r, share, max((least_seconds(r.rejects) - nothing) / (n * times), 1e-6)) for r, share in zip(rules, shares, strict=True)]


def order_rules(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejected share per cost, greatest first; ties keep the given order."""
    return [rule for rule, share, cost in sorted(measured, key=lambda x: -x[1] / x[2])]


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(out)
    return out


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2_000
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept is false for these and
    for documents that any rule rejects. The sample (about ``sample_rows`` rows of the whole table) sets only the
    order in which rules are tried, never the verdict, so reruns agree.

    Null and empty texts have no words and fail. Null ids and repeated rows are rows like others. An empty table
    gives no rows; columns other than id and text are ignored.
    """
    counts = text_counts(F.col("text"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("id", "text", *[c.alias(k) for k, c in counts.items()]).select("id", "text", "words.*", "lines.*", "word_chars", "n_symbols")

    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialize(table.sample(min(1.0, sample_rows / max(table.count(), 1)), seed=1), "rules")
    ordered = order_rules(measure_rules(materialize(counted(sample), "rules"), rules))
    table = counted(table)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(cascade(ordered).isNull())
    return table.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"),
    )


#: the same verdicts in DuckDB SQL
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i:i + 2] AS gram FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 1))) AS i)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
      FROM w LEFT JOIN cover USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars > 20 * n_words OR word_chars < 2 * n_words) AND NOT 10 * n_symbols > 3 * n_words
       AND NOT (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) AND NOT 2 * n_upper > word_chars AS kept
FROM f
"""
