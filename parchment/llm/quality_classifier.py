"""Quality classifier: a sparse rule ensemble over text statistics, compiled into one Spark column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.quality_rules import SPACES, SYMBOLS, bind, word_array
from parchment.llm.storage import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(text: Column) -> Column:
    """Struct of doubles that describe one whole text; nulls count as empty, and a share of nothing is 0."""
    text = F.coalesce(text, F.lit(""))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    solid = F.length(text) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))
    # few characters are capitals, digits or signs: classes are counted among these
    marks = F.regexp_replace(text, r"[^!-@A-Z\[-`{-~]+", "")

    def of(x: Column) -> Column:
        w, n = x["w"], F.size(x["w"])
        chars = lambda kind: F.length(x["marks"]) - F.length(F.translate(x["marks"], kind, ""))
        twin = F.size(F.filter(w, lambda y, i: y == F.get(w, i - 1)))
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            share(F.size(F.array_distinct(w)), n).alias("distinct_words"),
            share(twin, n).alias("twin_words"),
            share(x["solid"], n).alias("word_length"),
            share(chars(SYMBOLS), n).alias("symbols"),
            share(chars("!"), n).alias("shouts"),
            share(chars(".,;:?"), n).alias("stops"),
            share(chars(UPPER), x["solid"]).alias("capitals"),
            share(chars("0123456789"), x["solid"]).alias("digits"),
        )

    words = bind(F.struct(word_array(text).alias("w"), marks.alias("marks"), solid.alias("solid")), of)
    line = bind(
        lines,
        lambda x: F.struct(
            share(F.size(x), F.lit(1)).alias("lines"),
            (1.0 - share(F.size(F.array_distinct(x)), F.greatest(F.size(x), F.lit(1)))).alias("repeated_lines"),
        ),
    )
    # both parts are bound, or each field would make them anew
    both = F.struct(words.alias("w"), line.alias("l"))
    return bind(both, lambda x: F.struct(*[x["w"][c].alias(c) for c in WORD_STATS], *[x["l"][c].alias(c) for c in LINE_STATS]))


WORD_STATS = ("log_words", "distinct_words", "twin_words", "word_length", "symbols", "shouts", "stops", "capitals", "digits")
LINE_STATS = ("lines", "repeated_lines")
STATS = (*WORD_STATS, *LINE_STATS)

Test = tuple[str, bool, float]  # statistic, True for > and False for <=, threshold


@dataclass(frozen=True)
class RuleModel:
    """Logistic weights of conjunctive rules; ``score`` is the chance of label 1."""

    intercept: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for tests, weight in self.rules:
            total = total + F.when(holds(tests, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(tests: tuple[Test, ...], stats: Column) -> Column:
    out = F.lit(True)
    for name, above, at in tests:
        out = out & ((stats[name] > at) if above else (stats[name] <= at))
    return out


def tree_rules(debug: str) -> list[tuple[Test, ...]]:
    """The path to every node below the root of one printed decision tree, as a conjunction of tests."""
    path: list[Test] = []
    rules = []
    for line in debug.splitlines():
        if found := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = (len(found[1]) - 2) // 1
            while path and path[-1][3] >= depth:
                path.pop()
            path.append((STATS[int(found[2])], found[3] == ">", float(found[4]), depth))
            rules.append(_tight(tuple(x[:3] for x in path)))
    return rules


def _tight(path: tuple[Test, ...]) -> tuple[Test, ...]:
    """One test for each statistic and side, the tightest, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, at in path:
        now = best.get((name, above), at)
        best[name, above] = max(now, at) if above else min(now, at)
    return tuple((n, a, t) for (n, a), t in sorted(best.items()))


def fit_rules(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """RuleModel from (stats struct, label int): forest paths as rules, then a lasso logistic fit over the rules.

    Without labelled rows the score is 0.5; with a single class it is that class's smoothed share.
    """
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        import math

        return RuleModel(math.log((ones + 0.5) / (n - ones + 0.5)), ())
    data = labelled.select(F.col("label").cast("double").alias("label"), *[F.col("stats")[c].alias(c) for c in STATS])
    data = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(data)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=3, featureSubsetStrategy="onethird", minInstancesPerNode=5)
    model = forest.fit(data.select("label", "features"))
    rules = sorted({r for tree in model.trees for r in tree_rules(tree.toDebugString)})
    if not rules:
        import math

        return RuleModel(math.log(ones / (n - ones)), ())
    flags = [holds(r, F.struct(*STATS)).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    flagged = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(data.select("label", *flags))
    fit = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(flagged.select("label", "features"))
    weights = zip(rules, fit.coefficients.toArray().tolist(), strict=True)
    return RuleModel(float(fit.intercept), tuple((r, w) for r, w in weights if w))


def training_rows(labels: DataFrame, fold: Column, label_col: str, id_col: str, most: int) -> DataFrame:
    """(id, label) of at most about ``most`` rows with ``fold`` true, drawn by a hash of the id; an id's labels are one, the greatest."""
    rows = labels.where(fold & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, most / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000
) -> RuleModel:
    """Fit on the documents of the training fold; ``max_train`` bounds the labelled rows used (and so the broadcast)."""
    train = training_rows(labels, ~held_out(id_col, 3, 1), label_col, id_col, max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(train), "id")
    return fit_rules(materialize(rows.select(statistics(F.col("text")).alias("stats"), "label"), "train"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = 20_000,
) -> DataFrame:
    """One row per document: id, held_out, score and predicted.

    Null and empty texts have all statistics 0 and get the score of such texts. Null labels, labels without a
    document and labels of the held-out fold are not learned from. Null ids count as the empty text for the fold and
    have no label. Repeated rows are rows like others. An empty table gives no rows. Only id, text and the label are
    read, so other columns and clashing names don't matter.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_train)
    scored = docs.select(F.col(id_col), bind(statistics(F.col(text_col)), model.score).alias("score"))
    return scored.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
