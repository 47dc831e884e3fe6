"""Secret scans with corpus-wide ownership frequency, in native DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.years import cut, running_max, running_sum, text_blocks
from parchment.llm.quality_rules import bind
from parchment.llm.storage import materialize


@dataclass(frozen=True)
class Kind:
    """Leftmost non-overlapping matches of ``pattern``; the value is group ``group``, of at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


#: fixed patterns and lengths; a run that is too short can't hold a longer one, so lengths may stand in the pattern
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: spans that the method adds where their value is owner-specific: runs of 20 or more characters of Base64 (either alphabet, "/" aside, as
#: it parts paths), of any length, that mix upper case, lower case and digits, with the padding behind them
ADDED = (
    Kind("opaque", r"(?<![A-Za-z0-9+_-])(?=[A-Za-z+_-]*+[0-9])(?=[A-Z0-9+_-]*+[a-z])(?=[a-z0-9+_-]*+[A-Z])[A-Za-z0-9+_-]{20,}+={0,2}+"),
)


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, stop, kind, value) of one kind, in code points; the text between matches gives the places."""
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,value:string>>")

    def placed(matches: Column) -> Column:
        def at(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

            def build(stops: Column) -> Column:
                return F.transform(
                    matches,
                    lambda m, i: F.struct(
                        (F.get(stops, i) - F.length(m)).alias("start"),
                        F.lit(rank).alias("rank"),
                        F.get(stops, i).alias("stop"),
                        F.lit(kind.name).alias("kind"),
                        (F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m).alias("value"),
                    ),
                )

            return bind(bind(steps, lambda s: running_sum(s)), build)

        return bind(F.split(text, kind.pattern, -1), at)

    found = bind(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)
    if kind.least:
        found = F.filter(found, lambda x: F.length(x["value"]) >= kind.least)
    return F.when(text.rlike(kind.pattern), found).otherwise(empty)


def all_spans(text: Column, kinds: tuple[Kind, ...]) -> Column:
    """The spans of all kinds; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[spans_of(text, kind, i) for i, kind in enumerate(kinds)])


def _listed(spans: Column) -> Column:
    parts = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    return F.array_join(parts, ",")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    shared_from: int = 3,
    copied_from: int = 10,
    base: tuple[Kind, ...] = BASE,
    added: tuple[Kind, ...] = ADDED,
    whole: bool = False,
) -> DataFrame:
    """One row per input row: rid, id, owner, spans (array with kind, start, stop, live) and, with ``whole``, the row as doc.

    Candidates of all kinds are hashed, and each hash is counted over the whole corpus by distinct texts
    (repositories) and distinct owners. A value of ``shared_from`` owners or more is a widely copied example, and so is
    one of two owners that ``copied_from`` repositories or more hold; any other is live. Base spans stay in either case,
    with the flag; an added span stays only if it is live and does not overlap a base span. Counts are made per
    (hash, owner, repository) first, so a value that a third of all rows hold is a few rows per task.

    Null text is empty, a null owner is an owner of its own, and repeated rows are rows like others. An empty table
    gives no rows; columns other than the three are ignored.
    """
    found = all_spans(F.col(text_col), (*base, *added))
    hashed = F.transform(found, lambda x: x.withField("value", F.xxhash64(x["value"])))
    owner = F.coalesce(F.concat(F.lit("o"), F.col(owner_col)), F.lit(""))
    row = [F.struct(*docs.columns).alias("doc")] if whole else []
    table = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), owner.alias("owner"), F.xxhash64(text_col).alias("repo"), hashed.alias("spans"), *row)
    table = materialize(table, "secrets")

    each = table.where(F.size("spans") > 0).select("rid", "owner", "repo", F.explode("spans").alias("span"))
    each = each.select("rid", "owner", "repo", "span", F.col("span.value").alias("value"))
    owners = each.groupBy("value", "owner", "repo").count().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    owners = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    copied = (F.col("owners") >= shared_from) | ((F.col("owners") > 1) & (F.col("repos") >= copied_from))
    judged = each.join(owners.select("value", (~copied).alias("live")), "value")
    # a base span that begins before an added one overlaps it if it goes on beyond its start; one that begins later, if it begins before its end
    is_base = F.col("span.rank") < len(base)
    of_row = Window.partitionBy("rid")
    earlier = of_row.orderBy("span.start", "span.rank").rowsBetween(Window.unboundedPreceding, -1)
    later = of_row.orderBy(F.desc("span.start"), F.desc("span.rank")).rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("reach", F.max(F.when(is_base, F.col("span.stop"))).over(earlier)).withColumn("next", F.min(F.when(is_base, F.col("span.start"))).over(later))
    alone = F.coalesce(F.col("reach") <= F.col("span.start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("span.stop"), F.lit(True))
    kept = F.when(is_base | (F.col("live") & alone), F.struct("span.start", "span.rank", "span.stop", "span.kind", "live"))
    spans = judged.groupBy("rid").agg(F.array_sort(F.collect_list(kept)).alias("spans"))
    columns = ["rid", "id", "owner", *(["doc"] if whole else [])]
    bare = table.where(F.size("spans") == 0).select(*columns, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return bare.unionByName(table.where(F.size("spans") > 0).select(*columns).join(spans, "rid"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", **options) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_shared.

    spans lists kind:start:end of all spans by start, then kind; base_sha256 digests the base ones. n_live and
    n_shared count the values that look owner-specific and those that are widely copied. See scan_secrets for the
    method and for nulls, repeated rows and empty tables.
    """
    rows = scan_secrets(docs, id_col, text_col, owner_col, **options)
    spans = F.coalesce(F.col("spans"), F.array())
    of = lambda name: F.size(F.filter(spans, lambda x: x["kind"] == name)).cast("long")
    base = F.filter(spans, lambda x: x["kind"].isin([k.name for k in BASE]))
    return rows.select(
        F.col("id").alias(id_col), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_shared"),
    )


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each of the sorted spans replaced; spans that overlap are one. Each gap is cut once, the parts joined once."""

    def built(spans: Column, ends: Column, blocks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(ends, i), F.lit(0))
        part = lambda x, i: F.when(x["start"] >= end(i - 1), F.concat(cut(blocks, end(i - 1), x["start"] - end(i - 1)), F.lit(mark))).otherwise("")
        rest = end(F.size(spans) - 1)
        return F.concat(F.array_join(F.transform(spans, part), ""), cut(blocks, rest, F.length(text) - rest))

    stops = lambda s: running_max(F.transform(s, lambda x: x["stop"]))
    return bind(spans, lambda s: bind(stops(s), lambda e: bind(text_blocks(text), lambda b: built(s, e, b))))


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "<secret>", **options
) -> DataFrame:
    """docs with every live span of the text replaced by ``mark``; all rows and columns stay, in any order.

    Each text is scanned once; rows with a candidate are joined with their verdicts by a row number, all others pass
    straight through. Nulls, repeated rows and empty tables are as in scan_secrets; clashing names don't matter.
    """
    rows = scan_secrets(docs, id_col, text_col, owner_col, whole=True, **options)
    live = F.filter("spans", lambda x: x["live"])
    text = F.when(F.coalesce(F.size(live), F.lit(0)) > 0, _masked(F.col("doc")[text_col], live, mark)).otherwise(F.col("doc")[text_col])
    return rows.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


#: the report in DuckDB SQL, which has no look-around: an added span is a whole run, tested for length and characters
_RE2_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RE2 = ((_RE2_ASSIGN, 1), ("AKIA[A-Z0-9]{16,}", 0), ("[0-9a-f]{24,}", 0), ("[A-Za-z0-9+_-]+={0,2}", 0))
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('o' || source, '') AS owner FROM documents),
m AS ({" UNION ALL ".join(
    f"SELECT rid, {i} AS rank, '{kind.name}' AS kind, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, "
    f"string_split_regex(text, '{pattern}') AS gs FROM d WHERE regexp_matches(text, '{pattern if i < 3 else '[A-Za-z0-9+_-]{20,}'}')"
    for i, (kind, (pattern, group)) in enumerate(zip((*BASE, *ADDED), _RE2, strict=True))
)}),
u AS (SELECT rid, rank, kind, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM m),
p AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM u),
f AS (SELECT rid, rank, kind, stop - length(m) AS start, stop, v FROM p WHERE CASE rank WHEN 0 THEN length(v) >= 6
        WHEN 3 THEN length(rtrim(m, '=')) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') ELSE true END),
o AS (SELECT v, count(DISTINCT owner) >= 3 OR (count(DISTINCT owner) > 1 AND count(DISTINCT text) >= 10) AS shared FROM f JOIN d USING (rid) GROUP BY v),
j AS (SELECT f.*, shared FROM f JOIN o USING (v)),
k AS (SELECT * FROM j WHERE rank < 3 UNION ALL SELECT * FROM j x WHERE rank = 3 AND NOT shared
        AND NOT EXISTS (SELECT 1 FROM j b WHERE b.rid = x.rid AND b.rank < 3 AND b.start < x.stop AND x.start < b.stop)),
t AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
             count(*) FILTER (NOT shared) AS n_live, count(*) FILTER (shared) AS n_shared FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN t USING (rid)
"""
