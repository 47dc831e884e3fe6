"""Queries over documents, labels, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as X
from parchment.operators import diff, gates, inventory, paragraphs, review, similarity
from parchment.plans.registry import Tables, query

#: a vocabulary of frequent words by language, in place of one of trades
TOPICS = {
    "de": ["und", "der", "die", "das", "mit"],
    "en": ["the", "and", "that", "with", "from"],
    "es": ["los", "las", "que", "para", "del"],
    "fr": ["les", "des", "une", "dans", "pour"],
}
TOPIC_SQL = ", ".join(f"('{t}', '{x}')" for t, xs in TOPICS.items() for x in xs)
ACCENTED = ((0xC0, 0xFF),)


def verdicts(t: Tables, groups: int = 100) -> DataFrame:
    """Samples (project, status): labelled documents as verdicts, in groups by id."""
    status = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "irrelevant").when(F.col("quality").isNotNull(), "relevant").otherwise("unknown")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.pmod("doc_id", F.lit(groups)).alias("project"), status.alias("status"))


VERDICTS = """
  SELECT d.doc_id, d.doc_id % 100 AS project,
         CASE WHEN toxic = 1 OR quality = 0 THEN 'irrelevant' WHEN quality IS NOT NULL THEN 'relevant' ELSE 'unknown' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
GATES = f"""
WITH v AS ({VERDICTS}),
p AS (SELECT project, count(*) AS samples, count(*) FILTER (status = 'relevant') AS relevant, count(*) FILTER (status = 'irrelevant') AS irrelevant
      FROM v GROUP BY project),
b AS (SELECT *, coalesce(irrelevant / nullif(relevant + irrelevant, 0) > 0.5, false) AS blocked FROM p),
f AS (SELECT *, (SELECT count(*) FILTER (blocked) / count(*) FROM b) > {{limit}} AS fused FROM b)
SELECT *, CASE WHEN fused THEN 'BATCH_FUSED' WHEN blocked THEN 'BLOCKED_IRRELEVANT' ELSE 'PREFLIGHT_PASSED' END AS status FROM f
"""


@query(GATES.format(limit=0.2))
def gate_by_group(t: Tables) -> DataFrame:
    return gates.gate_status(gates.batch_fuse(gates.project_gate(verdicts(t), "project"), 0.2))


@query(GATES.format(limit=0.1))
def gate_by_group_strict(t: Tables) -> DataFrame:
    return gates.gate_status(gates.batch_fuse(gates.project_gate(verdicts(t), "project"), 0.1))


@query(f"WITH g AS ({GATES.format(limit=0.2)}) SELECT count(*) FILTER (status <> 'PREFLIGHT_PASSED') AS failures FROM g")
def failed_projects(t: Tables) -> DataFrame:
    return gates.failure_count(gate_by_group(t), applied=True)


@query("""
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'SKIPPED_MISSING_LABEL' WHEN d.doc_id IS NULL THEN 'SKIPPED_MISSING_DOCUMENT'
       ELSE 'READY' END AS status
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 > 0) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def pair_audit(t: Tables) -> DataFrame:
    return review.pair_audit(t.documents.where("doc_id % 3 > 0"), t.labels, ["doc_id"], names=("DOCUMENT", "LABEL"))


@query(f"""
WITH v(topic, term) AS (VALUES {TOPIC_SQL})
SELECT doc_id, topic, term, ((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::INTEGER AS hits
FROM documents, v WHERE contains(lower(text), term)
""")
def term_hits(t: Tables) -> DataFrame:
    return similarity.term_hits(t.documents, "doc_id", "text", TOPICS)


def doc_paragraphs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "para"))


@query(f"""
WITH v(topic, term) AS (VALUES {TOPIC_SQL}),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))[11:]) AS para FROM documents),
h AS (SELECT doc_id, topic, term, (length(lower(para)) - length(replace(lower(para), term, ''))) // length(term) AS hits FROM p, v)
SELECT doc_id, topic, term, sum(hits)::BIGINT AS hits FROM h WHERE hits > 0 GROUP BY ALL
""")
def late_hits(t: Tables) -> DataFrame:
    return similarity.late_hits(doc_paragraphs(t), "doc_id", "idx", "para", TOPICS)


CONFLICT = f"""
WITH d AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS title, string_split(lower(text), chr(10)) AS ps FROM documents),
b AS (SELECT doc_id, title, CASE WHEN title = '' THEN array_to_string(ps, chr(10)) ELSE replace(array_to_string(ps, chr(10)), title, '') END AS body,
             CASE WHEN title = '' THEN array_to_string(ps[11:], chr(10)) ELSE replace(array_to_string(ps[11:], chr(10)), title, '') END AS late FROM d),
v(topic, term) AS (VALUES {TOPIC_SQL}),
c AS (SELECT doc_id, topic, contains(title, term) AS titled, (length(body) - length(replace(body, term, ''))) // length(term) AS hits,
             (length(late) - length(replace(late, term, ''))) // length(term) AS late_hits FROM b, v),
w AS (SELECT *, bool_or(titled) OVER (PARTITION BY doc_id, topic) AS own FROM c),
t AS (SELECT doc_id, count(*) FILTER (titled) AS terms, coalesce(sum(hits) FILTER (titled), 0) AS title_hits,
             count(*) FILTER (titled AND hits = 0) AS absent, coalesce(sum(late_hits) FILTER (titled), 0) AS late_hits FROM w GROUP BY doc_id),
o AS (SELECT doc_id, max(n) AS strongest FROM (SELECT doc_id, topic, sum(hits) AS n FROM w WHERE NOT own GROUP BY ALL) WHERE n >= 5 GROUP BY doc_id),
g AS (SELECT doc_id, list_transform(['of', 'in', 'is', 'to'], lambda x: (length(body) - length(replace(body, x, ''))) // 2) AS ops, length(trim(body)) < 80 AS short FROM b),
j AS (SELECT t.*, coalesce(strongest, 0) AS strong, list_sum(ops) AS n_ops, list_min(ops) AS least_op, short FROM t JOIN g USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT doc_id, CASE WHEN NOT short AND terms > 0 AND (strong > 0 AND (absent >= 2 OR (title_hits <= 3 AND strong >= 8)
         OR (strong >= 8 AND strong > title_hits AND late_hits <= 1)) OR (absent = terms AND n_ops >= 20 AND least_op > 0))
       THEN 'review_topic_mismatch' ELSE 'unknown' END AS status,
       CASE WHEN short THEN 'too little text' WHEN terms = 0 THEN 'no term in the title'
         WHEN strong > 0 AND (absent >= 2 OR (title_hits <= 3 AND strong >= 8) OR (strong >= 8 AND strong > title_hits AND late_hits <= 1)) THEN 'another topic is stronger than the title''s'
         WHEN absent = terms AND n_ops >= 20 AND least_op > 0 THEN 'only generic terms, none of the title''s' ELSE 'no conflict found' END AS reason,
       title_hits::INTEGER AS title_hits, absent::INTEGER AS absent, strong::INTEGER AS strongest_other
FROM j
"""


@query(CONFLICT)
def topic_conflict(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.split("text", "\n").alias("paras")).withColumn("title", F.get("paras", F.lit(0)))
    return similarity.topic_conflict(docs, "doc_id", "title", "paras", TOPICS, ("of", "in", "is", "to"))


@query("""
SELECT doc_id, 'License' AS category FROM documents
WHERE contains(text, 'License') AND NOT contains(lang, 'en') AND NOT contains(lang, 'de')
""")
def category_mismatch(t: Tables) -> DataFrame:
    return similarity.category_mismatch(t.documents, [("License", ("en", "de"))], "doc_id", "lang", "text")


@query("""
WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS ts, doc_id % 40 AS own,
                  trim(text) = '' AS blank FROM documents),
r AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS ts FROM benchmark),
a AS (SELECT doc_id, unnest(ts) AS token, len(ts) AS n FROM t), b AS (SELECT item_id, unnest(ts) AS token, len(ts) AS n FROM r),
p AS (SELECT doc_id, item_id, count(*) / sqrt((any_value(a.n) * any_value(b.n))::DOUBLE) AS score FROM a JOIN b USING (token) GROUP BY ALL),
s AS (SELECT t.doc_id, blank, coalesce(max(score) FILTER (item_id = own), 0.0) AS own_score, coalesce(max(score) FILTER (item_id <> own), 0.0) AS best_other,
             (max(row(score, item_id)) FILTER (item_id <> own)) AS other
      FROM t LEFT JOIN p ON t.doc_id = p.doc_id GROUP BY ALL)
SELECT doc_id, round(own_score, 6) AS own_score, round(best_other, 6) AS best_other, coalesce(other[2], -1) AS best_ref,
       CASE WHEN blank THEN 'unknown' WHEN own_score >= 0.08 THEN 'relevant' WHEN best_other >= 0.08 AND best_other - own_score >= 0.05 THEN 'irrelevant' ELSE 'unknown' END AS status,
       round(CASE WHEN blank THEN 0.0 WHEN own_score >= 0.08 THEN least(0.99, own_score + 0.85)
             WHEN best_other >= 0.08 AND best_other - own_score >= 0.05 THEN least(0.99, best_other + 0.86) ELSE 0.4 END, 6)::DOUBLE AS confidence,
       CASE WHEN blank THEN 'no text' WHEN own_score >= 0.08 THEN 'like its own reference' WHEN best_other >= 0.08 AND best_other - own_score >= 0.05
            THEN 'more like ' || other[2] ELSE 'too little in common with any' END AS reason
FROM s
""")
def batch_relevance(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", F.pmod("doc_id", F.lit(40)).alias("own"))
    out = similarity.batch_relevance(docs, t.benchmark.withColumnRenamed("text", "ref_text"), "doc_id", "own", "item_id", "text", "ref_text", X.GENERIC_TERMS)
    return out.select("doc_id", F.round("own_score", 6).alias("own_score"), F.round("best_other", 6).alias("best_other"), F.coalesce("best_ref", F.lit(-1)).alias("best_ref"), "status", F.round("confidence", 6).alias("confidence"), F.regexp_replace("reason", r" \(.*", "").alias("reason"))


@query("""
SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_texts(t: Tables) -> DataFrame:
    return inventory.duplicate_keys(t.documents, X.compact_text(F.col("text")))


@query("""
SELECT doc_id, contains(text, chr(65533)) AS replacement, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') AS control,
       contains(text, 'Ã') OR contains(text, 'Â') OR contains(text, 'â€') AS mojibake,
       regexp_matches(text, '[\\x{C0}-\\x{FF}]') AS accented, n_chars BETWEEN 700 AND 1300 AS in_band, contains(text, 'License') AS license,
       trim(regexp_replace(translate(text, chr(13) || chr(10), ''), '\\s+', ' ', 'g')) AS clean
FROM documents
""")
def damage_and_bands(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select(
        "doc_id", X.text_damage(text)["replacement"].alias("replacement"), X.text_damage(text)["control"].alias("control"),
        X.text_damage(text)["mojibake"].alias("mojibake"), X.contains_script(text, ACCENTED).alias("accented"),
        X.in_band(F.col("n_chars"), 700, 1300).alias("in_band"), text.contains("License").alias("license"), X.clean_text(text).alias("clean"),
    )


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)
SELECT doc_id, idx::INTEGER AS idx,
       array_to_string(list_filter([CASE WHEN trim(t) = '' THEN 'empty' END, CASE WHEN regexp_matches(t, '[0-9]') THEN 'digit' END,
                    CASE WHEN regexp_matches(t, '[()（）]') THEN 'parenthesis' END,
                    CASE WHEN regexp_matches(t, ',,|\\.\\.|;;|::|!!|\\?\\?') THEN 'punctuation' END,
                    CASE WHEN NOT (contains(t, 'tion') OR contains(t, 'ing')) THEN 'verb' END], lambda x: x IS NOT NULL), ',') AS violations
FROM p
""")
def field_violations(t: Tables) -> DataFrame:
    return doc_paragraphs(t).select("doc_id", "idx", F.array_join(X.field_violations(F.col("para"), verbs=("tion", "ing")), ",").alias("violations"))


@query("""
SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*[0-9]+[.)、]\\s*', '', 'g'), '[()（）]', ',', 'g'), '["“”]', '', 'g'),
    '(,),+|(\\.)\\.+|(;);+|(:):+|(!)!+|(\\?)\\?+', '\\1\\2\\3\\4\\5\\6', 'g') AS text,
  len(regexp_extract_all(text, '(?m)^\\s*[0-9]+[.)、]\\s*'))::INTEGER AS ordinal_markers_removed,
  len(regexp_extract_all(regexp_replace(text, '(?m)^\\s*[0-9]+[.)、]\\s*', '', 'g'), '[()（）]'))::INTEGER AS parentheses_to_commas,
  len(regexp_extract_all(text, '["“”]'))::INTEGER AS quotes_removed,
  len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*[0-9]+[.)、]\\s*', '', 'g'), '[()（）]', ',', 'g'), '["“”]', '', 'g'),
    ',,+|\\.\\.+|;;+|::+|!!+|\\?\\?+'))::INTEGER AS duplicate_punctuation_removed
FROM documents
""")
def field_repair(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.repair_field(F.col("text")).alias("r")).select("doc_id", "r.*")


@query("""
WITH r AS (SELECT doc_id, text AS before, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*[0-9]+[.)、]\\s*', '', 'g'), '[()（）]', ',', 'g'), '["“”]', '', 'g'),
    '(,),+|(\\.)\\.+|(;);+|(:):+|(!)!+|(\\?)\\?+', '\\1\\2\\3\\4\\5\\6', 'g') AS after FROM documents)
SELECT doc_id, before, after, true AS shrinks FROM r WHERE before <> after
""")
def repair_changes(t: Tables) -> DataFrame:
    """What field repair changes in a text, and both texts as the changes give them: repairs never make a text longer."""
    pairs = t.documents.select("doc_id", "text", X.repair_field(F.col("text"))["text"].alias("repaired")).where("text <> repaired")
    out = diff.text_diff(pairs, "doc_id", "text", "repaired")
    side = lambda name: F.array_join(F.transform("changes", lambda x: x[name]), "")
    shrinks = F.forall("changes", lambda x: F.length(x["after"]) <= F.length(x["before"]))
    return out.select("doc_id", side("before").alias("before"), side("after").alias("after"), (shrinks & (F.col("edits") > 0)).alias("shrinks"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS s FROM conversations),
p AS (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w)
SELECT conv_id, turn, round(CASE WHEN len(s) = 0 OR len(before) = 0 THEN 0.0 ELSE len(list_intersect(s, before)) / sqrt((len(s) * len(before))::DOUBLE) END, 6)::DOUBLE AS likeness
FROM p WHERE before IS NOT NULL
""")
def turn_likeness(t: Tables) -> DataFrame:
    """Likeness of each turn to the one before, by the cosine of their word sets."""
    rows = t.conversations.select("conv_id", "turn", X.semantic_tokens(F.col("text"), ("",)).alias("s"))
    before = F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(X.set_cosine(F.col("s"), F.col("before")), 6).alias("likeness"))


@query("""
SELECT doc_id, CASE WHEN trim(text) <> '' AND list_bool_or(list_transform(regexp_extract_all(lang || ' ' || source, '[A-Za-z0-9]{2,}'),
         lambda x: contains(lower(text), lower(x)))) THEN 'relevant' ELSE 'unknown' END AS status,
       CASE WHEN trim(text) = '' THEN 0.0 WHEN list_bool_or(list_transform(regexp_extract_all(lang || ' ' || source, '[A-Za-z0-9]{2,}'),
         lambda x: contains(lower(text), lower(x)))) THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence
FROM documents
""")
def default_relevance(t: Tables) -> DataFrame:
    r = X.default_relevance(F.col("text"), F.col("lang"), F.col("source"))
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("""
WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'relevant' ELSE 'odd' END AS s, 0.8 + 0.1 * quality AS c,
                  CASE WHEN doc_id % 2 = 0 THEN 'long enough' ELSE 'short' END AS e FROM labels)
SELECT doc_id, CASE WHEN s = 'odd' OR (s = 'irrelevant' AND e = 'short') THEN 'unknown' ELSE s END AS parsed,
       CASE WHEN s = 'odd' OR (s = 'irrelevant' AND c < 0.85) THEN 'unknown' ELSE s END AS normalised, c::DOUBLE AS confidence
FROM p
""")
def verdicts_from_text(t: Tables) -> DataFrame:
    s = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "relevant").otherwise("odd")
    rows = t.labels.select("doc_id", s.alias("s"), F.when(F.col("quality") == 1, 0.9).otherwise(0.8).alias("c"), F.when(F.col("doc_id") % 2 == 0, "long enough").otherwise("short").alias("e"))
    reply = F.format_string('Sure:\n```json\n{"status": "%s", "confidence": %.1f, "evidence": "%s"}\n```\nDone.', "s", "c", "e")
    rows = rows.select("doc_id", X.parse_verdict(reply).alias("v"), X.normalise_relevance(F.col("s"), F.col("c")).alias("n"))
    return rows.select("doc_id", F.col("v.status").alias("parsed"), F.col("n.status").alias("normalised"), F.col("v.confidence").alias("confidence"))


@query("""
WITH c AS (SELECT doc_id AS name, sha256(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0),
p AS (SELECT doc_id AS name, sha256(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS sha256 FROM documents WHERE doc_id % 3 <> 0)
SELECT c.name, c.sha256, CASE WHEN p.name IS NULL THEN 'NEW' WHEN p.sha256 = c.sha256 THEN 'REUSED' ELSE 'CHANGED' END AS state
FROM c LEFT JOIN p ON c.name = p.name
""")
def manifest_diff(t: Tables) -> DataFrame:
    cur = t.documents.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    old = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))
    prior = t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("name"), F.sha2(old, 256).alias("sha256"))
    return inventory.diff_manifest(cur, prior)


@query("""
SELECT conv_id, turn, role, text, place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user')
WHERE place = 0 OR n <= 2 OR place = n - 1
""")
def bounded_review(t: Tables) -> DataFrame:
    return gates.bounded_review_sample(t.conversations, "conv_id", ["turn"], 2, F.col("role") == "user")


@query("""
WITH n AS (SELECT *, lead(text) OVER w AS label, lead(role) OVER w AS next FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, label FROM n WHERE role = 'user' AND next = 'assistant'
""")
def cover_block(t: Tables) -> DataFrame:
    return paragraphs.cover_block(t.conversations, "conv_id", "turn", "text", F.col("role") == "user", F.col("role") == "assistant")


@query("SELECT conv_id, arg_min(text, turn) AS first, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id")
def conversation_edges(t: Tables) -> DataFrame:
    return paragraphs.edges(t.conversations, "conv_id", "turn", "text")


@query("SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM conversations QUALIFY place <= 2")
def conversation_head(t: Tables) -> DataFrame:
    return paragraphs.head_per_key(t.conversations, "conv_id", "turn", 2)


@query("""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, length(text) < 60 AS b FROM conversations),
p AS (SELECT *, turn // 2 + 1 AS page FROM c),
h AS (SELECT a.conv_id, a.turn, min(l.turn) AS label_order FROM p a JOIN p l ON a.conv_id = l.conv_id AND a.page = l.page AND l.turn BETWEEN a.turn + 1 AND a.turn + 10
      WHERE a.role = 'user' AND a.page >= 2 AND l.role = 'assistant' GROUP BY ALL)
SELECT h.conv_id, h.turn::INTEGER AS turn, h.label_order::INTEGER AS label_order,
  coalesce((SELECT max(x.turn) + 1 FROM p x WHERE x.conv_id = h.conv_id AND x.turn < h.turn AND NOT x.b), 1)::INTEGER AS first,
  coalesce((SELECT min(x.turn) - 1 FROM p x WHERE x.conv_id = h.conv_id AND x.turn BETWEEN h.label_order + 1 AND h.label_order + 3 AND NOT x.b),
           (SELECT max(x.turn) FROM p x WHERE x.conv_id = h.conv_id AND x.turn BETWEEN h.label_order + 1 AND h.label_order + 3), h.label_order)::INTEGER AS last
FROM h
""")
def duplicate_covers(t: Tables) -> DataFrame:
    rows = paragraphs.head_per_key(t.conversations, "conv_id", "turn", 1 << 30).select("conv_id", F.col("place").alias("turn"), "role", "text")
    rows = rows.withColumn("page", F.expr("turn div 2 + 1"))
    return paragraphs.duplicate_covers(rows, "conv_id", "turn", "page", F.col("role") == "user", F.col("role") == "assistant", F.length("text") < 60)


@query()
def paragraph_collapse(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("text", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))).withColumn("emptied", F.col("turn") % 4 == 1)
    return paragraphs.collapse_blanks(rows, "conv_id", "turn", "text", "emptied")


@query("""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS b, string_split(text, chr(10)) AS ps FROM documents),
c AS (SELECT doc_id, list_transform(b, lambda x: lower(regexp_replace(x, '\\s+', '', 'g'))) AS b,
             list_transform(CASE WHEN doc_id % 9 = 0 THEN list_concat([ps[1] || 'x'], ps[2:]) ELSE ps END, lambda x: lower(regexp_replace(' ' || x || '  ', '\\s+', '', 'g'))) AS p FROM a)
SELECT doc_id, sha256(array_to_string(b, chr(10))) = sha256(array_to_string(p, chr(10))) AS preserved FROM c
""")
def content_preserved(t: Tables) -> DataFrame:
    rows = doc_paragraphs(t)
    after = rows.withColumn("para", F.when((F.col("doc_id") % 9 == 0) & (F.col("idx") == 0), F.concat("para", F.lit("x"))).otherwise(F.concat(F.lit(" "), "para", F.lit("  "))))
    return inventory.preserved(rows, after, "doc_id", "idx", "para")
