"""Changes of an index without building it anew: a segment for each update, and one segment again by compaction.

An update reads the documents it replaces and those it brings, no others: their terms say how the dictionary and the field
statistics change. What is replaced stays in its segment and is left out when it is read. Terms that are new get numbers
between those of their neighbours, so what older segments wrote stays in order. The results are those of an index of the
same documents that is built at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.plans.index import ROOM_BITS, Index, field_sums, postings, write_segment
from wayfold.plans.ordered import range_begins, ranged
from wayfold.sources.scratch import fresh_path, scope, stored
from wayfold.sources.store import last_by_id


def placed(terms: DataFrame) -> DataFrame:
    """``terms`` (``field, term`` and ``ord``, null where a term is new) with its place ``pos`` in the order, numbers for the
    new ones, and ``step``: the distance to the numbers beside a new one, 0 where there was no room for it.

    New terms between two old ones divide what lies between their numbers; behind the last one they stand as far apart as
    in a new dictionary. Neighbours in other ranges are found among the ends of the ranges, a row for each.
    """
    rows = ranged(terms, "field", "term")
    rows = rows.join(F.broadcast(range_begins(rows)), "_range").withColumn("pos", F.col("_begin") + F.col("_in_range"))
    known = F.when(F.col("ord").isNotNull(), F.struct("pos", "ord"))
    ends = rows.groupBy("_range").agg(F.min(known).alias("bottom"), F.max(known).alias("top"))
    earlier = lambda order: W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("_range", F.last("top", True).over(earlier("_range")).alias("under"), F.last("bottom", True).over(earlier(F.desc("_range"))).alias("over"))
    up, down = (W.partitionBy("_range").orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in ("_in_range", F.desc("_in_range")))
    rows = rows.withColumns({"below": F.last(known, True).over(up), "above": F.last(known, True).over(down)}).join(F.broadcast(ends), "_range")
    zero = F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("ord"))
    rows = rows.withColumns({"below": F.coalesce("below", "under", zero), "above": F.coalesce("above", "over")})
    between = F.expr("(above.ord - below.ord) div (above.pos - below.pos)")
    step = F.when(F.col("ord").isNotNull(), 1).when(F.col("above").isNull(), 1 << ROOM_BITS).otherwise(between).cast("bigint")
    rows = rows.withColumn("step", step)
    number = F.coalesce("ord", F.col("below.ord") + (F.col("pos") - F.col("below.pos")) * F.col("step"))
    return rows.withColumn("ord", number).drop("_range", "_in_range", "_begin", "below", "above", "under", "over")


def changed_terms(index: Index, added: DataFrame, lost: DataFrame) -> DataFrame:
    """``field, term, df, ord, changed``: the dictionary with the postings ``added`` and without those ``lost``; ``ord`` is
    null where a term is new. Terms that no document holds any more are left out."""
    count = lambda rows, n: rows.groupBy("field", "term").agg((F.sum("copies") * n).alias("n"))
    change = count(added, 1).unionByName(count(lost, -1)).groupBy("field", "term").agg(F.sum("n").alias("n")).filter("n <> 0")
    both = index.terms.select("field", "term", "df", "ord", "changed").join(change, ["field", "term"], "full_outer")
    df = F.coalesce("df", F.lit(0)) + F.coalesce("n", F.lit(0))
    return both.select("field", "term", df.cast("bigint").alias("df"), "ord", (F.coalesce("changed", F.lit(False)) | F.col("n").isNotNull()).alias("changed")).filter("df > 0")


def changed_sums(index: Index, added: DataFrame, lost: DataFrame) -> DataFrame:
    """``field, docs, total`` after the change."""
    less = field_sums(lost).select("field", (-F.col("docs")).alias("docs"), (-F.col("total")).alias("total"))
    parts = index.fields.select("field", "docs", "total").unionByName(field_sums(added)).unionByName(less)
    return parts.groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).filter("docs > 0")


def updated(index: Index, new: DataFrame, gone: DataFrame | None = None, folder: str | None = None) -> Index:
    """``index`` with the documents ``new`` in place of those of their ids, and without the documents whose ``id`` stands in
    ``gone``, below ``folder`` (a fresh one by default). Of an id's rows in ``new`` the last counts; an id in both stays.

    ``index`` itself is not changed, and what is not there to be taken out does no harm. Ids that are null name nothing.
    Where no number is left between two terms, the index is built anew.
    """
    spark, folder = index.spark, folder or fresh_path(index.spark, "index")
    new = stored(last_by_id(new.filter("id is not null")).select(*index.docs.columns), "", f"{folder}/documents")
    with scope(spark):
        ids = new.select("id") if gone is None else new.select("id").union(gone.select("id"))
        ids = stored(ids.filter("id is not null").distinct(), "touched")
        lost = stored(postings(index.docs.join(ids, "id", "left_semi"), *index.names), "lost")
        added = stored(postings(new, *index.names), "added")
        terms = stored(placed(changed_terms(index, added, lost)), "terms")
        if not terms.filter("step = 0").isEmpty():
            kept = index.docs.join(ids, "id", "left_anti").unionByName(new)
            return Index.of(kept, index.names, f"{folder}/anew")
        terms = stored(terms.drop("step"), "", f"{folder}/terms")
        dead = ids.withColumn("segment", F.lit(len(index.segments) - 1))
        if index.gone is not None:
            dead = dead.unionByName(index.gone).groupBy("id").agg(F.max("segment").alias("segment"))
        stored(dead, "", f"{folder}/gone")
        segments = [*((s.folder, s.buckets, s.columns) for s in index.segments), write_segment(new, added, terms, added.count(), folder)]
        return Index.commit(spark, folder, index.names, segments, terms, changed_sums(index, added, lost))


def compacted(index: Index, folder: str | None = None) -> Index:
    """The same index in one segment below ``folder``: terms are numbered again and dead rows are left behind; documents are
    not taken apart again."""
    folder = folder or fresh_path(index.spark, "index")
    terms = index.terms.select("ord", "field", "term")
    posted = index.postings.join(terms, "ord").select("field", "term", "id", "tf", "dl", "copies")
    return Index.laid(stored(index.docs, "", f"{folder}/documents"), stored(posted, "", f"{folder}/field-postings"), index.names, folder)
