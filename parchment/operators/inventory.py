"""Inventory: archive classes, file roles, projects, completeness, manifests, delivery files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import fold
from parchment.operators import ordered

#: fixed values: archives that can be read, those with two suffixes, and those that can be delivered
SUFFIXES = (
    ".7z", ".rar", ".rarx", ".zip", ".jar", ".iso", ".cab", ".tar", ".gz", ".tgz", ".bz2", ".tbz", ".tbz2", ".xz",
    ".txz", ".lz4", ".lzma", ".lz", ".zst", ".zstd", ".z", ".pax", ".zpaq", ".ace", ".arj", ".lzh", ".lha", ".wim",
    ".msi", ".deb", ".rpm", ".dmg", ".hfs", ".pet", ".vhd", ".vhdx", ".gem",
)
COMPOUND = (".tar.gz", ".tar.bz2", ".tar.xz", ".tar.lz4")
DELIVERY = (".zip", ".rar")
#: fixed values: patterns of the roles, first match wins
ROLES = (
    ("temp", r"(?i)(^~\$|\.(tmp|temp)$)"),
    ("backup", r"(?i)\.backup-"),
    ("txt", r"(?i)\.txt$"),
    ("code_docx", r"(?i)代码\s*\.docx$"),
    ("code_pdf", r"(?i)代码\s*\.pdf$"),
    ("manual_docx", r"(?i)说明\.docx$"),
    ("manual_pdf", r"(?i)说明\.pdf$"),
)


def archive_suffix(name: Column) -> Column:
    """The folded suffix with its dot, compound ones whole; empty without one."""
    low = F.lower(F.element_at(F.split(name, "/"), -1))
    both = F.regexp_extract(low, "(" + "|".join(x.replace(".", r"\.") for x in COMPOUND) + ")$", 1)
    return F.when(both != "", both).otherwise(F.regexp_extract(low, r"^.+(\.[^.]+)$", 1))


def classify_archive(name: Column) -> Column:
    """Struct: suffix, is_archive, and the delivery format (zip, rar, or empty)."""
    suffix = archive_suffix(name)
    return F.struct(
        suffix.alias("suffix"),
        suffix.isin(*SUFFIXES, *COMPOUND).alias("is_archive"),
        F.when(suffix.isin(*DELIVERY), F.substring(suffix, 2, 9)).otherwise("").alias("delivery"),
    )


def classify_role(name: Column, roles=ROLES) -> Column:
    """The first role whose pattern the name matches, else other."""
    out = F.lit("other")
    for role, pattern in reversed(roles):
        out = F.when(name.rlike(pattern), role).otherwise(out)
    return out


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def with_project_name(files: DataFrame, folder: str = "folder", name: str = "name", role: str = "role") -> DataFrame:
    """files with project: the stem of the folder's first TXT, else the folder's last part."""
    txt = F.min(F.when(F.col(role) == "txt", stem(F.col(name)))).over(Window.partitionBy(folder))
    return files.withColumn("project", F.coalesce(txt, F.element_at(F.split(folder, "/"), -1)))


def completeness(files: DataFrame, key: str, role: str, required: tuple[str, ...]) -> DataFrame:
    """(key, missing, complete): required roles that no file of the key has, in the given order."""
    has = [F.bool_or(F.coalesce(F.col(role) == r, F.lit(False))).alias(f"has_{i}") for i, r in enumerate(required)]
    missing = F.array_compact(F.array(*[F.when(~F.col(f"has_{i}"), F.lit(r)) for i, r in enumerate(required)]))
    return files.groupBy(key).agg(*has).select(key, missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def _hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.contains(".backup-"))


def discover_projects(files: DataFrame, batch: str = "batch", folder: str = "folder", name: str = "name") -> DataFrame:
    """(batch, folder): folders with a TXT beside a DOCX or PDF; all top folders of a batch that has none. Hidden ones are left out."""
    low = F.lower(F.col(name))
    seen = files.where(~_hidden(F.col(folder)) & ~_hidden(F.col(name)))
    per = seen.groupBy(batch, folder).agg((F.bool_or(low.endswith(".txt")) & F.bool_or(low.rlike(r"\.(docx|pdf)$"))).alias("is_project"))
    any_ = F.bool_or("is_project").over(Window.partitionBy(batch))
    per = per.withColumn("found", any_)
    own = per.where("is_project").select(batch, folder)
    top = per.where(~F.col("found")).select(batch, F.substring_index(folder, "/", 1).alias(folder)).distinct()
    return own.unionByName(top)


def delivery_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Files to deliver: none in hidden or backup folders, no temporary ones."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return files.where(~_hidden(F.col(path)) & ~name.rlike(r"\.(tmp|temp)$") & ~name.startswith("~$"))


def leftover(archives: DataFrame, dirs: DataFrame, path: str = "path", dir_path: str = "dir") -> DataFrame:
    """archives with is_leftover: a folder of the same path without the suffix exists."""
    bare = F.expr(f"substr({path}, 1, length({path}) - length(regexp_extract({path}, '([.][^./]+)$', 1)))")
    known = dirs.select(F.col(dir_path).alias("__dir")).distinct().withColumn("is_leftover", F.lit(True))
    return archives.join(known, bare == F.col("__dir"), "left").withColumn("is_leftover", F.coalesce("is_leftover", F.lit(False))).drop("__dir")


def pending_archives(archives: DataFrame, dirs: DataFrame, path: str = "path", done: str = "_已处理_") -> DataFrame:
    """Archives that are neither outputs of earlier runs nor already unpacked beside themselves."""
    fresh = archives.where(classify_archive(F.col(path))["is_archive"] & ~F.col(path).contains(done))
    return leftover(fresh, dirs, path).where(~F.col("is_leftover")).drop("is_leftover")


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """(key, n): folded keys that occur more than once."""
    return df.groupBy(fold(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def common_root(files: DataFrame, key: str, folder: str) -> DataFrame:
    """(key, root): the longest common leading parts of a key's folders; one part less if all files share one folder."""
    # what the least and the greatest list of parts share, all between share; as strings they won't do, as "-" sorts before "/"
    parts = F.split(folder, "/")
    ends = files.groupBy(key).agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = F.arrays_zip(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))))
    unlike = F.array_position(F.transform(both, lambda x: x["0"] != x["1"]), True)
    n = F.when(unlike > 0, unlike - 1).otherwise(F.size(both))
    n = F.when(a == b, n - 1).otherwise(n)
    return ends.select(key, F.array_join(F.slice(a, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "/").alias("root"))


def detect_format(files: DataFrame, batch: str, name: str, mtime: str) -> DataFrame:
    """(batch, format): that of the newest delivery archive named as the batch; else the only format there is; else null."""
    kind = classify_archive(F.col(name))["delivery"]
    rows = files.select(batch, kind.alias("fmt"), (fold(stem(F.col(name))) == fold(F.col(batch))).alias("named"), F.col(mtime).alias("at"))
    rows = rows.withColumn("fmt", F.nullif(F.col("fmt"), F.lit("")))
    named = F.max(F.when(F.col("named") & F.col("fmt").isNotNull(), F.struct("at", "fmt")))["fmt"]
    only = F.when(F.count_distinct("fmt") == 1, F.min("fmt"))
    return rows.groupBy(batch).agg(F.coalesce(named, only).alias("format"))


def diff_manifest(cur: DataFrame, prior: DataFrame, name: str = "name", digest: str = "sha256", force: bool = False) -> DataFrame:
    """cur with state: REUSED if the prior manifest has the name with the same digest, CHANGED with another, else NEW."""
    old = prior.select(F.col(name).alias("__name"), F.col(digest).alias("__digest"))
    same = F.lit(not force) & (F.col("__digest") == F.col(digest))
    state = F.when(F.col("__name").isNull(), "NEW").when(same, "REUSED").otherwise("CHANGED")
    return cur.join(old, F.col(name) == F.col("__name"), "left").withColumn("state", state).drop("__name", "__digest")


def is_stale(source: Column, output: Column) -> Column:
    """A derived file that is missing or older than its source."""
    return output.isNull() | (output < source)


def stale_exports(sources: DataFrame, outputs: DataFrame, key: str, source_time: str, output_time: str) -> DataFrame:
    """sources with stale, by the output of the same key."""
    out = outputs.select(F.col(key).alias("__key"), F.col(output_time).alias("__time"))
    joined = sources.join(out, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("stale", is_stale(F.col(source_time), F.col("__time"))).drop("__key", "__time")


def unique_names(df: DataFrame, base: str, order: str) -> DataFrame:
    """df with unique_name: base, base_2, base_3 in the given order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", base, n.cast("string"))))


def fingerprint(df: DataFrame, key: str, order: str, value: str, chunk: int | None = ordered.CHUNK) -> DataFrame:
    """(key, n, fingerprint): SHA-256 over a key's values in order, one a line; of more than ``chunk`` values as a tree, see ordered.digest_tree.

    Without a chunk it is one SHA-256 over all values, however many, see ordered.digest_chain.
    """
    if chunk is None:
        return ordered.digest_chain(df, [key], [order], F.col(value))
    return ordered.digest_tree(df, [key], [order], F.col(value), chunk=chunk)


def version_diff(before: DataFrame, after: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, change): changed, added or removed; rows with equal digests are left out."""
    a = before.select(*keys, F.col(digest).alias("__a"))
    b = after.select(*keys, F.col(digest).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change is not null")


def preserved(before: DataFrame, after: DataFrame, key: str, order: str, text: str, edits: DataFrame | None = None) -> DataFrame:
    """(key, preserved): whether the texts of a key, white space aside, are the same before and after.

    Rows of ``edits`` (key, order) are allowed to differ.
    """
    from parchment.functions.text import compact_text

    def digest(df: DataFrame) -> DataFrame:
        if edits is not None:
            df = df.join(edits.select(key, order), [key, order], "left_anti")
        return fingerprint(df.select(key, order, compact_text(F.col(text)).alias("value")), key, order, "value")

    a, b = digest(before).select(key, F.col("fingerprint").alias("a")), digest(after).select(key, F.col("fingerprint").alias("b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("preserved"))
