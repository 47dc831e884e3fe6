"""Queries over orders, lineitem, parts, customers, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import media, years
from parchment.functions import text as X
from parchment.operators import diff, gates, inventory, paragraphs, recovery, review, similarity
from parchment.plans.registry import Tables, query
from parchment.streaming.progress import progress_stream

KEEP, UPDATE = ("YEAR.{0,8}(?:HIGH|LOW)", "(?:since).{0,8}YEAR"), ("(?:current|now).{0,16}YEAR",)
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT coalesce(bool_or(l_returnflag = 'R'), false) THEN 'R' END,
         CASE WHEN NOT coalesce(bool_or(l_returnflag = 'A'), false) THEN 'A' END, CASE WHEN NOT coalesce(bool_or(l_returnflag = 'N'), false) THEN 'N' END],
         lambda x: x IS NOT NULL), ',') AS missing,
       coalesce(bool_or(l_returnflag = 'R'), false) AND coalesce(bool_or(l_returnflag = 'A'), false) AND coalesce(bool_or(l_returnflag = 'N'), false) AS complete
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def completeness(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"), "o_orderkey", "left")
    out = inventory.completeness(rows, "o_orderkey", "l_returnflag", ("R", "A", "N"))
    return out.withColumn("missing", F.array_join("missing", ","))


@query("""
SELECT l_orderkey, coalesce(bool_and(l_quantity <= 45), false) AND coalesce(bool_and(l_tax < 0.08), true) AS passed,
       array_to_string(list_filter([CASE WHEN NOT bool_and(coalesce(l_quantity <= 45, false)) THEN 'small' END,
         CASE WHEN NOT bool_and(coalesce(CASE WHEN l_linestatus = 'F' THEN l_tax < 0.08 END, true)) THEN 'taxed' END], lambda x: x IS NOT NULL), ',') AS failures
FROM (SELECT * FROM lineitem) GROUP BY l_orderkey
""".replace("coalesce(bool_and(l_tax < 0.08), true)", "bool_and(coalesce(CASE WHEN l_linestatus = 'F' THEN l_tax < 0.08 END, true))"))
def all_checks(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", (F.col("l_quantity") <= 45).alias("small"), F.when(F.col("l_linestatus") == "F", F.col("l_tax") < 0.08).alias("taxed"))
    return gates.all_checks(rows, "l_orderkey", ["small"], ["taxed"]).withColumn("failures", F.array_join("failures", ","))


@query("""
SELECT n_name, c_mktsegment, count(*) AS documents, count(*) FILTER (o_orderstatus = 'P') AS failed, sum(o_orderkey % 3)::BIGINT AS deletions,
       CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS rollup_status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)
""")
def status_rollup(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", "c_mktsegment", F.when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("READY").alias("s"), (F.col("o_orderkey") % 3).alias("d"))
    return gates.status_rollup(rows, ["n_name", "c_mktsegment"], "s", deletions="d")


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
n AS (SELECT *, least(total, greatest(4, ceil(total * 0.25::DOUBLE)))::BIGINT AS n FROM r)
SELECT * EXCLUDE (total, n) FROM n
WHERE list_contains(CASE WHEN n = 1 THEN [0] ELSE list_transform(range(n), lambda i: round_even(i * (total - 1) / (n - 1), 0)::BIGINT) END, place)
""")
def equidistant_sample(t: Tables) -> DataFrame:
    return gates.equidistant_sample(t.lineitem, "l_orderkey", LINE_ORDER)


@query("""
WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL),
m AS (SELECT p_brand, arg_min(p_size, struct_pack(a := -n, b := p_size)) AS modal FROM c GROUP BY p_brand)
SELECT part.*, modal FROM part JOIN m USING (p_brand) WHERE p_size <> modal
""")
def modal_outliers(t: Tables) -> DataFrame:
    return gates.modal_outliers(t.part, "p_brand", "p_size")


@query("""
WITH m AS (SELECT p_type, median(p_retailprice) AS middle FROM part GROUP BY p_type)
SELECT p_partkey, p_type, round(p_retailprice, 4) AS price, round(middle, 4) AS middle FROM part JOIN m USING (p_type) WHERE abs(p_retailprice - middle) > 40
""")
def median_outliers(t: Tables) -> DataFrame:
    out = gates.median_outliers(t.part, "p_type", "p_retailprice", 40.0)
    return out.select("p_partkey", "p_type", F.round("p_retailprice", 4).alias("price"), F.round("middle", 4).alias("middle"))


HASHES = """
  SELECT vec_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda i: (embedding[i] > embedding[i + 1])::BIGINT)),
                                    lambda a, b: a * 2 + b) AS hash FROM embeddings
"""


@query(HASHES)
def gradient_hash(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", media.gradient_hash(F.col("embedding")).alias("hash"))


@query(f"""
WITH h AS ({HASHES}), f AS (SELECT label, min(vec_id) AS first, arg_min(hash, vec_id) AS fh FROM h GROUP BY label)
SELECT h.label, first, vec_id, bit_count(xor(hash, fh))::INTEGER AS distance FROM h JOIN f USING (label) WHERE vec_id > first AND bit_count(xor(hash, fh)) <= 24
""")
def similar_to_first(t: Tables) -> DataFrame:
    return similarity.similar_to_first(gradient_hash(t), "label", "vec_id", "hash", 24)


@query("""
SELECT vec_id, vec_id % 3 <> 1 AND NOT (vec_id % 3 = 2 AND vec_id % 2 = 0) AS signature_ok, 200 * (label + 50) >= 10500 AS substantial
FROM embeddings
""")
def image_checks(t: Tables) -> DataFrame:
    kind = F.col("vec_id") % 3
    suffix = F.when(kind == 0, ".png").when(kind == 1, ".gif").otherwise(".jpeg")
    head = F.when(kind == 0, "89504E470D0A1A0A").when(F.col("vec_id") % 2 == 0, "FFD900").otherwise("FFD8FF")
    body = F.hex(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))
    content = F.unhex(F.concat(head, body))
    size = 200 * (F.col("label") + 50)
    return t.embeddings.select(
        "vec_id", media.image_signature_ok(content, suffix).alias("signature_ok"),
        media.substantial(size, media.gradient_hash(F.col("embedding")), 10_500).alias("substantial"),
    )


def dated_orders(t: Tables) -> DataFrame:
    """(o_orderkey, text): sentences with a year, of three kinds."""
    d = F.date_format("o_orderdate", "yyyy")
    n = F.col("o_orderkey") % 3
    text = F.when(n == 0, F.concat(F.lit("current plan "), d, F.lit(" of "), "o_orderpriority")).when(
        n == 1, F.concat(F.lit("since "), d, F.lit(", order "), F.col("o_orderkey").cast("string"))
    )
    return t.orders.select("o_orderkey", text.otherwise(F.concat("o_orderpriority", F.lit(" in "), d, F.lit("/x"))).alias("text"))


DATED = """
  SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, o_orderpriority AS p, CASE o_orderkey % 3 WHEN 0 THEN 'current plan ' || strftime(o_orderdate, '%Y') || ' of ' || o_orderpriority
    WHEN 1 THEN 'since ' || strftime(o_orderdate, '%Y') || ', order ' || o_orderkey ELSE o_orderpriority || ' in ' || strftime(o_orderdate, '%Y') || '/x' END AS text,
    CASE o_orderkey % 3 WHEN 0 THEN 13 WHEN 1 THEN 6 ELSE length(o_orderpriority) + 4 END AS pos FROM orders
"""


@query(f"""
WITH d AS ({DATED})
SELECT o_orderkey, pos::INTEGER AS "at", y AS year, substr(text, greatest(pos - 32, 0) + 1, least(pos, 32) + 36) AS context FROM d
UNION ALL SELECT o_orderkey, 18, o_orderkey::VARCHAR, text FROM d WHERE o_orderkey % 3 = 1 AND o_orderkey BETWEEN 1900 AND 2099
""")
def year_mentions(t: Tables) -> DataFrame:
    return dated_orders(t).select("o_orderkey", F.explode(years.year_mentions(F.col("text"))).alias("m")).select("o_orderkey", "m.*")


@query(f"""
WITH d AS ({DATED}),
c AS (SELECT *, CASE WHEN y::INTEGER >= 1999 THEN 'KEEP' WHEN regexp_matches(text, y || '.{{0,8}}(HIGH|LOW)') OR regexp_matches(text, 'since.{{0,8}}' || y) THEN 'KEEP'
                     WHEN regexp_matches(text, '(current|now).{{0,16}}' || y) THEN 'UPDATE' ELSE 'REVIEW' END AS decision,
             CASE WHEN y::INTEGER >= 1999 THEN 1.0 WHEN regexp_matches(text, y || '.{{0,8}}(HIGH|LOW)') OR regexp_matches(text, 'since.{{0,8}}' || y)
                    OR regexp_matches(text, '(current|now).{{0,16}}' || y) THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM d),
r AS (SELECT *, CASE WHEN decision = 'UPDATE' THEN replace(text, y, '1999') ELSE text END AS rewritten FROM c)
SELECT o_orderkey, rewritten AS text, 0 AS place, y AS source, decision, confidence FROM r
UNION ALL SELECT o_orderkey, rewritten, 1, o_orderkey::VARCHAR, CASE WHEN o_orderkey >= 1999 THEN 'KEEP' ELSE 'REVIEW' END, CASE WHEN o_orderkey >= 1999 THEN 1.0 ELSE 0.5 END
FROM r WHERE o_orderkey % 3 = 1 AND o_orderkey BETWEEN 1900 AND 2099
""")
def year_rewrite(t: Tables) -> DataFrame:
    rows = dated_orders(t).select("o_orderkey", years.rewrite_years(F.col("text"), 1999, KEEP, UPDATE).alias("r"))
    rows = rows.select("o_orderkey", "r.text", F.posexplode("r.decisions").alias("place", "d"))
    return rows.select("o_orderkey", "text", "place", "d.source", "d.decision", "d.confidence")


def date_texts(t: Tables) -> DataFrame:
    """(o_orderkey, text): a date in one of five forms, some of them impossible."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM")).when(k == 2, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-31")))
        .when(k == 3, F.concat(F.lit("order "), F.date_format(d, "yyyy"))).otherwise(F.concat(F.date_format(d, "M"), F.lit("月 "), F.date_format(d, "yyyy")))
    )
    return t.orders.select("o_orderkey", F.concat(F.lit("on "), text, F.lit(" done")).alias("text"))


DATE_TEXTS = """
  SELECT o_orderkey, o_orderkey % 5 AS k, strftime(o_orderdate, '%Y')::INTEGER AS y, 'on ' || CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-31' WHEN 3 THEN 'order ' || strftime(o_orderdate, '%Y')
    ELSE strftime(o_orderdate, '%-m') || '月 ' || strftime(o_orderdate, '%Y') END || ' done' AS text,
    CASE o_orderkey % 5 WHEN 4 THEN 5 + length(strftime(o_orderdate, '%-m')) ELSE 3 END AS pos,
    CASE o_orderkey % 5 WHEN 0 THEN try_cast('1999' || strftime(o_orderdate, '-%m-%d') AS DATE) IS NOT NULL
      WHEN 2 THEN try_cast(strftime(o_orderdate, '%Y-%m') || '-31' AS DATE) IS NOT NULL WHEN 3 THEN false ELSE true END AND strftime(o_orderdate, '%Y')::INTEGER < 1999 AS ok FROM orders
"""


@query(f"""
WITH d AS ({DATE_TEXTS}) SELECT o_orderkey, text, CASE WHEN ok THEN pos::INTEGER ELSE -1 END AS "at",
  CASE WHEN ok THEN substr(text, 1, pos) || '1999' || substr(text, pos + 5) ELSE text END AS rewritten FROM d
""")
def date_year_rewrite(t: Tables) -> DataFrame:
    rows = date_texts(t).select("o_orderkey", "text", years.date_years(F.col("text"), 1999).alias("done"))
    at = F.coalesce(F.get("done.spans", F.lit(0))["at"], F.lit(-1))
    return rows.select("o_orderkey", "text", at.alias("at"), F.col("done.text").alias("rewritten"))


@query(f"""
WITH d AS ({DATE_TEXTS}), l AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::INTEGER AS q, max(l_partkey % 100)::INTEGER AS x FROM lineitem GROUP BY ALL)
SELECT o_orderkey, l_linenumber, least(q, x) AS "left", least(x, 7) AS top, greatest(q, x) + 1 AS "right", greatest(x, 7) + 1 AS bottom, pos::INTEGER AS "at", (pos + 4)::INTEGER AS stop
FROM l JOIN d ON l_orderkey = o_orderkey WHERE ok
""")
def line_fields(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.max(F.col("l_partkey") % 100).cast("int").alias("x"))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = lines.join(date_texts(t), F.col("l_orderkey") == F.col("o_orderkey"))
    polygon = F.array(point(F.col("q"), F.col("x")), point(F.col("x"), F.lit(7)))
    return rows.select("o_orderkey", "l_linenumber", F.explode(years.line_date_fields(polygon, F.col("text"), 1999)).alias("f")).select("o_orderkey", "l_linenumber", "f.*")


def customer_notes(t: Tables, after: bool) -> DataFrame:
    note = F.concat("c_name", F.lit(" "), "c_mktsegment")
    if after:
        note = F.when(F.col("c_custkey") % 4 == 0, F.replace(note, F.lit("Customer"), F.lit("Client"))).otherwise(note)
    rows = t.customer.select("c_custkey", note.alias("note"))
    return rows.where("c_custkey % 11 > 0") if after else rows.where("c_custkey % 13 > 0")


CUSTOMER_NOTES = """
  a AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS note FROM customer WHERE c_custkey % 13 > 0),
  b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN replace(c_name || ' ' || c_mktsegment, 'Customer', 'Client') ELSE c_name || ' ' || c_mktsegment END AS note
        FROM customer WHERE c_custkey % 11 > 0)
"""


@query(f"""
WITH {CUSTOMER_NOTES} SELECT c_custkey, CASE WHEN a.note IS NULL THEN 'added' WHEN b.note IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b USING (c_custkey) WHERE a.note IS DISTINCT FROM b.note
""")
def version_diff(t: Tables) -> DataFrame:
    digest = lambda df: df.select("c_custkey", F.sha2("note", 256).alias("d"))
    return inventory.version_diff(digest(customer_notes(t, False)), digest(customer_notes(t, True)), ["c_custkey"], "d")


@query()
def text_diff(t: Tables) -> DataFrame:
    pairs = customer_notes(t, False).join(customer_notes(t, True).withColumnRenamed("note", "new_note"), "c_custkey")
    return diff.text_diff(pairs.where("note <> new_note"), "c_custkey", "note", "new_note")


EVENT_STEPS = "(json_extract_string(props, '$.k')::INTEGER)"


def event_steps(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", "ts", "user_id", "event_type", k.alias("k"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("bad"))


@query(f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, {EVENT_STEPS} AS k, (event_type = 'error')::INTEGER AS bad FROM events),
w AS (SELECT *, max(k) OVER r AS done, max(bad) OVER r AS failed, s - min(s) OVER (PARTITION BY user_id) AS elapsed FROM e
      WINDOW r AS (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, done, failed, elapsed, greatest(100 - done, 0) AS remaining,
       round(CASE WHEN done > 0 THEN elapsed / done * greatest(100 - done, 0) ELSE -1 END, 3)::DOUBLE AS eta FROM w
""")
def progress(t: Tables) -> DataFrame:
    rows = event_steps(t).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("total", F.lit(100))
    out = paragraphs.progress(rows, "user_id", ["s", "event_id"], F.col("s"), "k", "total", "bad")
    return out.select("event_id", "done", "failed", "elapsed", "remaining", F.round(F.coalesce("eta", F.lit(-1.0)), 3).alias("eta"))


@query(f"""
SELECT user_id, max({EVENT_STEPS}) AS current, max((event_type = 'error')::INTEGER) AS failures,
       arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, max(ts) AS updated FROM events GROUP BY user_id
""")
def progress_snapshot(t: Tables) -> DataFrame:
    rows = event_steps(t).withColumn("at", F.struct("ts", "event_id"))
    out = progress_stream(rows, "user_id", "at", "k", "bad", "event_type")
    return out.withColumn("updated", F.col("updated.ts"))


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, {EVENT_STEPS} AS k FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-21'),
b AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 END) AS r FROM e WHERE user_id % 3 > 0 OR event_type <> 'view' GROUP BY user_id HAVING r IS NOT NULL),
j AS (SELECT b.user_id, event_id, CASE WHEN r = 1 AND event_type = 'purchase' THEN 'WAIT_MANUAL_FLOW' WHEN r = 2 AND event_type = 'error' AND k % 2 = 0 AND event_id % 5 > 0 THEN 'PLAN_ONLY' END AS action
      FROM b JOIN e ON b.user_id = e.user_id)
SELECT user_id::VARCHAR AS batch_no, action, count(*) AS orders, array_to_string(list_sort(list(event_id)), ',') AS order_ids,
       CASE action WHEN 'PLAN_ONLY' THEN 'preview: recoverable orders found' ELSE 'needs manual handling' END AS label
FROM j WHERE action IS NOT NULL GROUP BY ALL
""")
def plan_recovery(t: Tables) -> DataFrame:
    e = recovery.date_range(event_steps(t), "ts", "2024-01-05", "2024-01-20").withColumn("batch_no", X.coalesce_keys(F.lit(" "), F.col("user_id").cast("string")))
    status = F.when(F.col("event_type") == "view", "in_progress").when(F.col("event_type") == "click", " Partial ")
    batches = e.where("user_id % 3 > 0 or event_type <> 'view'").select("batch_no", status.alias("status")).where("status is not null")
    state = F.when(F.col("event_type") == "purchase", "PAUSED").when(F.col("event_type") == "error", "failed").otherwise("done")
    orders = e.select(
        "batch_no", F.col("event_id").alias("order_id"), state.alias("status"), F.when(F.col("k") % 2 == 0, "code_gen").otherwise("pack").alias("step"),
        F.when(F.col("event_id") % 5 > 0, F.col("event_id").cast("string")).alias("code_order_no"),
    )
    out = recovery.plan_recovery(batches, orders)
    return out.select("batch_no", "action", "orders", F.array_join("order_ids", ",").alias("order_ids"), X.action_label(F.col("action")).alias("label"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(*) FILTER (value > 50)::BIGINT AS large FROM events GROUP BY event_type
""")
def batch_totals(t: Tables) -> DataFrame:
    out = gates.batch_totals(t.events, "event_type", {"total": F.col("value"), "large": (F.col("value") > 50).cast("long")})
    return out.withColumn("total", F.round("total", 2))


def indexed_nations(t: Tables) -> DataFrame:
    return paragraphs.with_index(t.nation, None, "n_name")


@query("""
WITH n AS (SELECT *, row_number() OVER (ORDER BY lower(n_name), n_name)::INTEGER AS index FROM nation)
SELECT r_regionkey, index, n_name, list_contains([1, 3, 4, 5, 7, 8, 9], index + r_regionkey - r_regionkey) AS kept FROM n JOIN region ON n_regionkey = r_regionkey
WHERE list_contains([1, 3, 4, 5, 7, 8, 9], index)
""")
def selection(t: Tables) -> DataFrame:
    n = indexed_nations(t)
    text = F.lit("1, 3-5；9~7")
    chosen = n.agg(F.count("*").cast("int").alias("n")).select(F.explode(X.parse_selection(text, F.col("n"))["indexes"]).alias("index"))
    kept = review.apply_selection(n, chosen).withColumn("kept", F.lit(True))
    return kept.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "index", "n_name", "kept")


@query("""
WITH n AS (SELECT *, row_number() OVER (ORDER BY lower(n_name), n_name)::INTEGER AS index FROM nation)
SELECT index, n_name FROM n WHERE index NOT IN (1, 3, 4, 5, 7, 8, 9)
""")
def rejected(t: Tables) -> DataFrame:
    n = indexed_nations(t)
    chosen = n.agg(F.count("*").cast("int").alias("n")).select(F.explode(X.parse_selection(F.lit("1,3-5,9-7"), F.col("n"))["indexes"]).alias("index"))
    return review.apply_selection(n, chosen, mode="drop").select("index", "n_name")


@query("""
SELECT DISTINCT lower('x' || c_mktsegment) AS name FROM customer
UNION SELECT DISTINCT lower(c_mktsegment) FROM customer WHERE lower(c_mktsegment) NOT IN (SELECT lower(n_name) FROM nation)
""")
def unknown_keys(t: Tables) -> DataFrame:
    asked = t.customer.select(F.explode(F.array("c_mktsegment", F.concat(F.lit("x"), "c_mktsegment"))).alias("name")).unionByName(t.nation.select(F.col("n_name").alias("name")))
    return review.unknown_keys(asked, t.nation.select(F.col("n_name").alias("name")), "name")


@query("""
SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0
INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 4
""")
def common_keys(t: Tables) -> DataFrame:
    return review.common_keys(
        t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation")),
        t.nation.where("n_regionkey < 4").select(F.col("n_nationkey").alias("nation")),
    )


SHIPPED = "SELECT l_orderkey AS key, max(l_shipdate) AS done FROM lineitem WHERE l_orderkey % 6 > 0 GROUP BY 1"


@query(f"""
WITH s AS ({SHIPPED}) SELECT o_orderkey AS key, o_orderdate, done IS NULL OR done < o_orderdate AS stale FROM orders LEFT JOIN s ON o_orderkey = key
""")
def stale_exports(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_orderkey % 6 > 0").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_shipdate").alias("done"))
    return inventory.stale_exports(t.orders.select(F.col("o_orderkey").alias("key"), "o_orderdate"), done, "key", "o_orderdate", "done")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, bool_or(l_quantity > 10) AS t, sum((l_returnflag = 'R')::INTEGER) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS sections, bool_and(t AND n = 1) AS ok FROM s GROUP BY l_orderkey
""")
def section_layout(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("text"), (F.col("l_returnflag") == "R").alias("page"))
    return gates.section_layout(rows, "l_orderkey", "l_linenumber", "text", "page")


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
""")
def unique_names(t: Tables) -> DataFrame:
    return inventory.unique_names(t.part, "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""
SELECT p_partkey, p_name || ' says "' || p_brand || '" and ' || p_name AS text, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS safe, p_name || ' V1.0' AS header
FROM part
""")
def names_and_quotes(t: Tables) -> DataFrame:
    c = F.concat(F.lit('"'), "p_name", F.lit('" says "'), "p_brand", F.lit('" and “'), "p_name", F.lit("”"))
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("  v 1.0 "))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.unquote_name(c, F.col("p_name")).alias("text"), X.safe_name(F.col("p_brand"), True).alias("safe"), X.header_text(title).alias("header"))


@query("""
SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'ADD_COVER' END, CASE WHEN s_nationkey % 3 = 0 THEN 'REMOVE_DUPLICATE_COVER_TEXT' END,
         CASE WHEN s_acctbal >= 0 AND s_nationkey % 2 = 0 OR s_suppkey % 5 = 0 AND s_suppkey % 5 > 0 THEN 'NORMALIZE_COVER_STYLE' END,
         CASE WHEN s_suppkey % 5 = 0 THEN 'REMOVE_COVER_VERSION' END,
         CASE WHEN s_suppkey % 5 = 0 AND NOT (s_acctbal >= 0 AND s_nationkey % 2 = 0) THEN 'NORMALIZE_COVER_STYLE' END,
         CASE WHEN s_suppkey % 7 = 0 THEN 'NORMALIZE_HEADER' END, 'EXPORT_PDF'], lambda x: x IS NOT NULL), ',') AS actions,
       CASE WHEN s_nationkey IN (1, 2, 3) THEN 'pass' ELSE 'fail' END AS status
FROM supplier
""")
def action_plans(t: Tables) -> DataFrame:
    flags = {
        "cover_found": F.col("s_acctbal") >= 0, "duplicate_cover": F.col("s_nationkey") % 3 == 0, "residual_label": F.lit(None).cast("boolean"),
        "cover_style_ok": F.col("s_nationkey") % 2 != 0, "title_has_version": F.col("s_suppkey") % 5 == 0, "header_ok": F.col("s_suppkey") % 7 != 0,
        "body_style_differs": F.lit(False), "first_heading_differs": F.lit(None).cast("boolean"),
    }
    rows = t.supplier.select("s_suppkey", "s_nationkey", *[c.alias(k) for k, c in flags.items()])
    status = X.result_status(F.format_string(" state %d ", "s_nationkey"), ("state 1", "state 2", "state 3"))
    return rows.select("s_suppkey", F.array_join(review.plan_actions(), ",").alias("actions"), status.alias("status"))


@query("""
WITH a AS (SELECT c_custkey::VARCHAR AS folder, c_mktsegment || (c_custkey % 700) AS name FROM customer),
i AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS folder, c_mktsegment || (c_custkey % 700) AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'),
u AS (SELECT name, count(*) AS n, min(folder) AS f FROM a GROUP BY name),
e AS (SELECT CASE WHEN i.folder <> '' THEN i.folder WHEN n = 1 THEN f END AS folder FROM i LEFT JOIN u USING (name)),
c AS (SELECT folder, count(*) AS errors FROM e WHERE folder IS NOT NULL GROUP BY folder)
SELECT row_number() OVER (ORDER BY a.folder)::INTEGER AS index, a.name, a.folder, coalesce(errors, 0) AS errors,
       CASE WHEN a.folder::INTEGER % 4 = 1 THEN 'pass' ELSE 'fail' END AS status
FROM a LEFT JOIN c ON a.folder = c.folder
""")
def review_table(t: Tables) -> DataFrame:
    name = F.concat("c_mktsegment", (F.col("c_custkey") % 700).cast("string"))
    audit = t.customer.select(F.col("c_custkey").cast("string").alias("folder"), name.alias("name"))
    folder = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("")
    issues = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(folder.alias("folder"), name.alias("name"))
    results = t.customer.where("c_custkey % 4 < 3").select(F.col("c_custkey").cast("string").alias("folder"), F.format_string(" result %d", F.col("c_custkey") % 4).alias("final"))
    return review.review_table(audit, results, issues, ("result 1",))


@query("""
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE NOT (o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
""")
def resolved_findings(t: Tables) -> DataFrame:
    found = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    done = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return review.drop_resolved(found, done, "o_custkey", "o_orderpriority", "1-URGENT", "c_mktsegment", "BUILDING")


@query("""
SELECT o_orderkey, CASE WHEN l <> 'UPDATE' AND l <> 'KEEP' OR l = 'UPDATE' AND c < 0.85 THEN 'REVIEW' ELSE l END AS decision, c::DOUBLE AS confidence
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'KEEP' ELSE 'HM' END AS l, (o_orderkey % 21) / 20 AS c FROM orders)
""")
def year_decisions(t: Tables) -> DataFrame:
    n = F.col("o_orderkey") % 3
    label = F.when(n == 0, "update").when(n == 1, "Keep").otherwise("hm")
    got: Column = years.normalise_decision(label, (F.col("o_orderkey") % 21) / 20)
    return t.orders.select("o_orderkey", got.alias("d")).select("o_orderkey", "d.*")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_seen(t: Tables) -> DataFrame:
    return paragraphs.first_seen(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS deleted, count(*) FILTER (o_orderstatus = 'O') AS uncertain,
       array_to_string(list(o_orderkey || o_orderstatus ORDER BY o_orderkey), ',') AS findings FROM orders GROUP BY o_custkey
""")
def findings_report(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "deleted").when(F.col("o_orderstatus") == "O", "uncertain").otherwise("none")
    rows = t.orders.select("o_custkey", "o_orderkey", kind.alias("kind"), "o_orderstatus")
    out = gates.findings_report(rows, "o_custkey", "o_orderkey", "kind", "o_orderstatus", ("deleted", "uncertain"))
    parts = F.transform("findings", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    return out.select("o_custkey", "deleted", "uncertain", F.array_join(parts, ",").alias("findings"))


@query("SELECT c_name, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY lower(c_name), c_name)::INTEGER AS index FROM customer")
def folded_index(t: Tables) -> DataFrame:
    return paragraphs.order_folded(paragraphs.with_index(t.customer, "c_mktsegment", "c_name").select("c_name", "c_mktsegment", "index"), "c_name")


@query("SELECT count(*) FILTER (o_orderstatus <> 'F' OR o_totalprice > 200000) AS failures FROM orders")
def cover_failures(t: Tables) -> DataFrame:
    failures = F.when(F.col("o_totalprice") > 200000, F.array(F.lit("large"))).otherwise(F.array().cast("array<string>"))
    return gates.cover_failures(t.orders.select(F.when(F.col("o_orderstatus") == "F", "OK").otherwise("BAD").alias("status"), failures.alias("failures")))


@query("SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_log_status(t: Tables) -> DataFrame:
    from parchment.sources.files import last_json_status

    line = F.concat(F.regexp_replace("props", r"\}\s*$", ', "status": "'), "event_type", F.lit('"}'))
    logs = t.events.select("user_id", (F.col("event_id") * 2).alias("seq"), line.alias("line"))
    noise = t.events.select("user_id", (F.col("event_id") * 2 + 1).alias("seq"), F.lit("no json {").alias("line"))
    return last_json_status(logs.unionByName(noise), "user_id", "seq", "line")


