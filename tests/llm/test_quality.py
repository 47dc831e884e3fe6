import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from parchment.llm.quality_classifier import RuleModel, fit_quality, quality_scores, statistics, tree_rules
from parchment.llm.quality_rules import RULES, Rule, cascade, measure_rules, order_rules, quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = W.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_rule_counts(documents, awkward, empty):
    for docs in (documents, awkward):
        texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
        rows = quality_rules(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r.doc_id is None:
                continue
            n, chars, symbols, dup, again, lines = counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
            failed = n < 50 or 100 * again > 50 * n
            upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in texts[r.doc_id] or "")
            bad = chars > 20 * n or chars < 2 * n or 10 * symbols > 3 * n or (dup > 2 and 10 * dup > 3 * lines) or 2 * upper > chars
            assert r.base_failed == failed and r.kept == (not failed and not bad)
    assert quality_rules(empty).collect() == []


def test_order_changes_no_verdict(documents):
    from parchment.llm.quality_rules import text_counts

    rows = documents.select("text", *[c.alias(k) for k, c in text_counts(F.col("text")).items()]).select("text", "words.*", "lines.*", "word_chars", "n_symbols")
    measured = measure_rules(rows)
    assert [m[0] for m in measured] == list(RULES) and all(0 <= share <= 1 and cost >= 1e-6 for _, share, cost in measured)
    ordered = order_rules(measured)
    gain = {rule.name: share / cost for rule, share, cost in measured}
    assert [gain[r.name] for r in ordered] == sorted(gain.values(), reverse=True)
    a = [r[0] for r in rows.select(cascade(ordered).isNull()).collect()]
    assert a == [r[0] for r in rows.select(cascade(list(reversed(RULES))).isNull()).collect()]


def test_order_follows_rejection_per_cost():
    a, b, c = RULES[:3]
    assert order_rules([(a, 0.1, 1e-5), (b, 0.1, 1e-6), (c, 0.5, 1e-5)]) == [b, c, a]
    assert order_rules([(a, 0.0, 1e-6), (b, 0.0, 1e-5), (c, 0.0, 1e-6)]) == [a, b, c]


def test_an_expensive_rule_costs_more(documents):
    """A cost is what a rule adds to counts that are there."""
    rows = documents.where("text is not null").select("text", F.lit(1).alias("n_words"))
    dear = Rule("dear", "length(regexp_replace(text, '[a-m]+', '-')) < 0")
    (_, _, low), (_, _, high) = measure_rules(rows, (Rule("cheap", "n_words > 5"), dear))
    assert high > 3 * low


def test_rules_equal_a_plain_evaluation(documents, labels):
    """Scores are the logistic sum of the rules that hold, and the weights are at the optimum of the lasso."""
    model = fit_quality(documents, labels)
    stats = {r.doc_id: r.s for r in documents.select("doc_id", statistics(F.col("text")).alias("s")).collect()}
    holds = lambda tests, s: all((s[n] > at) if above else (s[n] <= at) for n, above, at in tests)
    total = {i: model.intercept + sum(w for tests, w in model.rules if holds(tests, s)) for i, s in stats.items()}
    for r in quality_scores(documents, labels).collect():
        assert abs(r.score - 1 / (1 + math.exp(-total[r.doc_id]))) < 1e-9 and r.predicted == (r.score >= 0.5)
    # at the optimum the loss's slope is the penalty against the weight's sign, in units of a rule's deviation
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [i for i in stats if i in truth and zlib.crc32(str(i).encode()) % 3 != 1]
    for tests, w in model.rules:
        flags = [float(holds(tests, stats[i])) for i in rows]
        mean = sum(flags) / len(rows)
        deviation = math.sqrt(sum((f - mean) ** 2 for f in flags) / (len(rows) - 1))
        slope = sum(f * (1 / (1 + math.exp(-total[i])) - truth[i]) for f, i in zip(flags, rows, strict=True)) / len(rows)
        assert abs(slope / deviation + math.copysign(5e-4, w)) < 3e-3


def test_statistics_of_plain_python(documents, awkward):
    for docs in (documents, awkward):
        for r in docs.select("text", statistics(F.col("text")).alias("s")).collect():
            text, s = r.text or "", r.s
            w = W.findall(text)
            solid, lines = sum(map(len, w)), [x for x in text.split("\n") if W.search(x)]
            share = lambda a, b: a / b if b else 0.0
            count = lambda kind, text=text: sum(c in kind for c in text)
            want = {
                "log_words": math.log1p(len(w)), "distinct_words": share(len(set(w)), len(w)), "word_length": share(solid, len(w)),
                "twin_words": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), "symbols": share(count("#*$%&|<>"), len(w)),
                "shouts": share(count("!"), len(w)), "stops": share(count(".,;:?"), len(w)), "digits": share(count("0123456789"), solid),
                "capitals": share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), solid), "lines": len(lines), "repeated_lines": 1 - share(len(set(lines)), len(lines)) if lines else 1.0,
            }
            assert all(abs(s[k] - v) < 1e-9 for k, v in want.items()), (want, s)


def test_quality_held_out(documents, labels, awkward, empty):
    rows = quality_scores(documents, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.85 * len(held)
    rows = quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(empty, labels).collect() == []


def test_labels_of_no_use(awkward, spark):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert {r.score for r in quality_scores(awkward, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality_scores(awkward, one).collect())


def test_paths_are_rules(spark):
    tree = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 4 <= 0.5)\n    Predict: 0.0\n   Else (feature 4 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    a, b = ("log_words", False, 1.5), ("symbols", False, 0.5)
    assert tree_rules(tree) == [(a,), (a, b), (a, ("symbols", True, 0.5)), (("log_words", True, 1.5),)]
    rows = spark.createDataFrame([("a b c $ $ $",), ("a",)], "text string").select(RuleModel(0.0, (((("symbols", True, 0.2),), 2.0),)).score(statistics(F.col("text"))).alias("s"))
    assert [round(r.s, 3) for r in rows.collect()] == [0.881, 0.5]
