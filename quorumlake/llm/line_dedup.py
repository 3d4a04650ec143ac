"""Removal of repeated passages, by windows of three lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs without later occurrences of any three consecutive lines; every row and column stays.

    Lines are what lies between newlines, compared exactly. Of each window of three lines the
    occurrence with the smallest (id, line) stays; the lines of all others are removed, runs that
    overlap or touch being merged. An occurrence that overlaps the first one of its own window
    loses only the lines beyond it. Windows are known by 128 bits of hash.

    Null texts stay null; texts of fewer than three lines stay as they are; a text that loses all
    lines becomes empty. Rows that agree in id and text are one document (they lose the same lines).
    Null ids come first. removed_col, if named, gets the number of lines removed and replaces a
    column of that name; other columns are passed on, whatever their names.
    """
    names = docs.columns
    lines = F.split(F.col(text_col), "\n", -1)
    keyed = docs.withColumn("__ql_key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g")))
    hashed = keyed.select("__ql_key", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("l")).where(F.size("l") >= WIDTH)
    windows = hashed.select(
        "__ql_key",
        F.posexplode(
            F.zip_with(
                F.slice("l", 1, F.size("l") - 2),
                F.zip_with(F.slice("l", 2, F.size("l") - 2), F.slice("l", 3, F.size("l") - 2), lambda y, z: F.struct(y.alias("y"), z.alias("z"))),
                lambda x, t: F.struct(F.xxhash64(x["a"], t["y"]["a"], t["z"]["a"]).alias("a"), F.xxhash64(x["b"], t["y"]["b"], t["z"]["b"]).alias("b")),
            )
        ).alias("pos", "w"),
    ).select("__ql_key", "pos", F.col("w.a").alias("wa"), F.col("w.b").alias("wb"))
    firsts = windows.groupBy("wa", "wb").agg(F.min(F.struct("__ql_key", "pos")).alias("first"), F.max(F.struct("__ql_key", "pos")).alias("last")).where("first <> last").drop("last")
    same = F.col("first.__ql_key") == F.col("__ql_key")
    later = windows.join(firsts, ["wa", "wb"]).where(F.col("first") != F.struct("__ql_key", "pos"))
    covered = later.select("__ql_key", F.sequence(F.when(same, F.greatest("pos", F.col("first.pos") + WIDTH)).otherwise(F.col("pos")), F.col("pos") + WIDTH - 1).alias("gone"))
    merged = covered.groupBy("__ql_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    # one byte for each line up to the last that goes: 0 stays, 1 goes; each line that goes brings those since the one before it
    steps = F.transform("gone", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1), F.lit("1")))
    masks = merged.select(F.col("__ql_key").alias("__ql_at"), F.encode(F.array_join(steps, ""), "utf-8").alias("__ql_mask"))
    joined = keyed.join(masks, F.col("__ql_key").eqNullSafe(F.col("__ql_at")), "left")
    kept = F.filter(lines, lambda _, i: (i >= F.length("__ql_mask")) | (F.substring(F.col("__ql_mask"), i + 1, F.lit(1)) == F.lit(bytearray(b"0"))))
    out = joined.withColumn("__ql_kept", F.when(F.col("__ql_mask").isNotNull(), kept))
    text = F.when(F.col("__ql_mask").isNull(), F.col(text_col)).otherwise(F.array_join("__ql_kept", "\n"))
    columns = [text.alias(text_col) if c == text_col else F.col(c) for c in names if c != removed_col]
    if removed_col:
        columns.append(F.coalesce(F.size(lines) - F.when(F.col("__ql_mask").isNotNull(), F.size("__ql_kept")), F.lit(0)).alias(removed_col))
    return out.select(columns)


ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
w as (select doc_id, unnest(range(0, len(ls) - 2)) pos, ls from l where len(ls) >= 3),
k as (select doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] win from w),
r as (select *, first_value(doc_id) over o fd, first_value(pos) over o fp from k window o as (partition by win order by doc_id, pos)),
c as (select doc_id, case when fd = doc_id then greatest(pos, fp + 3) else pos end s, pos + 2 e from r where not (fd = doc_id and fp = pos)),
m as (select doc_id, list(distinct p) gone from (select doc_id, unnest(range(s, e + 1)) p from c) group by doc_id)
select l.doc_id,
       case when gone is null then text
            else array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text,
       cast(coalesce(len(gone), 0) as int) as lines_removed
from l left join m on m.doc_id = l.doc_id
"""
