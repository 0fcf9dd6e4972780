"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Consecutive lines are hashed in windows of three; a window found anywhere before (by doc_id, then position) is a later
occurrence, and the lines under later occurrences, merged where they overlap, are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sized, whole_text

WIDTH = 3
#: Any character but ASCII white space: lines without one are blank.
FILLED = r"[^\x20\x09-\x0D]"
#: A window found more often than this is hot.
HOT = 10_000


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, text (without the removed lines), n_lines, n_removed, kept_sha256.

    Lines are what newlines part. A line is blank if it holds nothing but ASCII white space (blank, tab, vertical tab, form feed, carriage
    return); windows of blank lines alone don't count and stay. Documents with fewer lines than a window stay whole. Null text counts
    as empty (one empty line). Rows that repeat doc_id and text are one document and are treated alike. Other columns are ignored; an
    empty table gives no rows.

    Windows (a hash and a place, no text) are written once. Their counts are partial sums before the shuffle; windows found more
    than once find their places again by a broadcast where they are counted to be few. Beyond that by a shuffle, but for hot windows:
    these are broadcast always, as there can't be many (``HOT`` grows with the table, so that at most half a million are hot), so no task
    holds all places of one window. Texts stay where they are, unless covered places are too many to broadcast.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    base = base.withColumn("tie", F.xxhash64("text")).withColumn("lines", F.split("text", "\n", -1))
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.array_join(F.slice("lines", i + 1, width), "\n")
    hashed = F.transform(starts, lambda i: F.when(F.rlike(F.array_join(F.slice("lines", i + 1, width), " "), F.lit(FILLED)), F.unhex(F.md5(window(i)))))
    windows = base.select("doc_id", "tie", F.posexplode(hashed).alias("pos", "h")).filter("h is not null")
    windows = saved(windows.select("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie", "pos"), "windows")
    at = F.struct("id", "tie", "pos")
    seen = saved(windows.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1"), "seen")
    hot = max(HOT, windows.count() // 500_000)
    parts = [windows.join(F.broadcast(seen.filter(F.col("n") > hot)), "h"), windows.join(sized(seen.filter(F.col("n") <= hot), 80), "h")]
    later = parts[0].unionByName(parts[1]).filter(at > F.col("first")).groupBy("id", "tie")
    later = saved(later.agg(F.sort_array(F.collect_set("pos")).alias("covered")), "later")
    later = sized(later, 48 + 4 * F.size("covered"))
    both = base.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(later, ["id", "tie"], "left")
    covered = F.coalesce("covered", F.array().cast("array<int>"))
    # lines that stay lie between the end of a covered window and the start of the next
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(covered, lambda s: s + width)).alias("a"), F.concat(covered, F.array(F.size("lines"))).alias("b"))
    gaps = F.filter(gaps, lambda g: g["b"] > g["a"])
    both = both.withColumn("gaps", gaps).withColumn("stay", F.flatten(F.transform("gaps", lambda g: F.slice("lines", g["a"] + 1, g["b"] - g["a"]))))
    text = F.when(F.size(covered) > 0, F.array_join("stay", "\n")).otherwise(F.col("text"))
    n_removed = F.when(F.size(covered) > 0, F.size("lines") - F.size("stay")).otherwise(0)
    out = both.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
    return out.withColumn("kept_sha256", F.sha2("text", 256))


#: The same rows in DuckDB, without the texts.
ORACLE = r"""
with base as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents),
w as (select doc_id, text, unnest(range(0, len(l) - 2)) as pos, l from base where len(l) >= 3),
h as (select doc_id, text, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] as h,
             regexp_matches(l[pos + 1] || l[pos + 2] || l[pos + 3], '[^\x20\x09-\x0D]') as filled from w),
r as (select *, row_number() over (partition by h order by doc_id, pos) as k from h where filled),
c as (select distinct doc_id, pos + unnest([0, 1, 2]) as line from r where k > 1),
ln as (select doc_id, unnest(range(0, len(l))) as line, unnest(l) as s from base),
k as (select ln.doc_id, count(*) as n_lines, count(c.line) as n_removed,
             coalesce(string_agg(case when c.line is null then ln.s end, chr(10) order by ln.line), '') as t
      from ln left join c on ln.doc_id = c.doc_id and ln.line = c.line group by ln.doc_id)
select doc_id, n_lines, n_removed, sha256(t) as kept_sha256 from k
"""
