"""Index tables out of documents: words, prefixes, shingles, completion inputs, and the statistics that scoring needs.

The terms of all fields stand in one sorted dictionary and are numbered in its order, so a prefix is an interval of
numbers, looked up in a stored table of prefixes. Postings name their term by number and are bucketed and sorted by
blocks of numbers: what a batch asks is turned into blocks, and no posting moves to meet it. Misspellings meet their
terms through stored deletions, and each short head of a completion input has its heaviest entries beside it.

An index is a list of segments under one dictionary. A build makes the first; an update (``plans.updates``) adds one more
and leaves the others as they are. The numbers of a dictionary stand apart, so new terms find theirs between them.
"""

from __future__ import annotations

import dataclasses
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators.fuzzy import STEM, Neighbours
from wayfold.plans.ordered import numbered
from wayfold.sources.scratch import exists, fresh_path, stored

#: Longest edge n-gram; a longer typed prefix is looked up by its head and compared in full.
LONGEST_GRAM = 20
# Characters of a completion input that count, longest name that is kept whole.
COMPLETION_LENGTH, LONGEST_NAME = 50, 256
#: Fields that only the shingle method reads: runs of two and of three words.
SHINGLES = {"search_text_2": ("search_text", 2), "search_text_3": ("search_text", 3), "primary_name_2": ("primary_name", 2), "primary_name_3": ("primary_name", 3)}
#: Fields whose words are also looked up by what they start with.
OPENED = ("search_text", "primary_name", "aliases", "postcode", "name_start", *SHINGLES)
#: Characters of a query, so no more of a name is ever asked for.
LONGEST_QUERY = 120
#: Numbers from one term of a new dictionary to the next, and terms of a block of it, as powers of two.
ROOM_BITS, BLOCK_BITS = 20, 8
#: Postings of a bucket at most, and at least where there would be more buckets than cores have use for.
BUCKET_ROWS, LEAST_ROWS = 4_000_000, 50_000
#: Heads of completion inputs up to so many characters have their heaviest entries stored, so many of each type.
SHORT_HEAD, HEAVIEST = STEM + 1, 50


def fields() -> dict[str, Column]:
    """The searchable fields as folded text."""
    return {
        "search_text": F.col("search_text"),
        "primary_name": F.col("primary_name_norm"),
        "aliases": X.normalize(F.array_join("aliases", " ")),
        "municipality_name": X.normalize(F.col("municipality_name")),
        "post_name": X.normalize(F.coalesce("post_name", F.lit(""))),
        "postcode": F.coalesce("postcode", F.lit("")),
    }


def shingles(tokens: Column, size: int) -> Column:
    """All runs of ``size`` tokens."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " ")), F.array().cast("array<string>"))


def field_terms() -> dict[str, Column]:
    """The terms of every field: words, whole names (``name``: one term), what names start with, and runs of words."""
    terms = {k: X.words(v) for k, v in fields().items()}
    name = F.col("primary_name_norm")
    none = F.array().cast("array<string>")
    terms["name"] = F.when(F.length(name).between(1, LONGEST_NAME), F.array(name)).otherwise(none)
    # what names start with; addresses are not sought by it
    terms["name_start"] = F.when((name != "") & (F.col("doc_type") != "address"), F.array(F.left(name, F.lit(LONGEST_QUERY)))).otherwise(none)
    return terms | {k: shingles(terms[f], n) for k, (f, n) in SHINGLES.items()}


def postings(docs: DataFrame, *names: str) -> DataFrame:
    """``field, term, id, tf, dl, copies``: how often each term stands in each field of each document, the field's length,
    and how many documents the row stands for (``copies`` of ``docs``; one without it)."""
    every = field_terms()
    chosen = {k: every[k] for k in names or fields()}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("terms")) for k, v in chosen.items()))).alias("f")
    rows = docs.select("id", copies_of(docs).alias("copies"), each).select("id", "copies", "f.field", F.size("f.terms").cast("bigint").alias("dl"), F.explode("f.terms").alias("term"))
    # a document's terms lie in one row, so its counts are complete before anything is shuffled
    return rows.groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"), F.max("copies").alias("copies"))


def copies_of(docs: DataFrame) -> Column:
    """How many documents a row stands for."""
    return F.col("copies") if "copies" in docs.columns else F.lit(1).cast("bigint")


def term_stats(posted: DataFrame) -> DataFrame:
    """``field, term, df``."""
    return posted.groupBy("field", "term").agg(F.sum("copies").alias("df"))


def field_sums(posted: DataFrame) -> DataFrame:
    """``field, docs, total``: documents that have the field and the sum of its lengths; sums of parts can be added."""
    lengths = posted.groupBy("field", "id").agg(F.max("dl").alias("dl"), F.max("copies").alias("copies"))
    return lengths.groupBy("field").agg(F.sum("copies").alias("docs"), F.sum(F.col("dl") * F.col("copies")).alias("total"))


def field_stats(posted: DataFrame) -> DataFrame:
    """``field, docs, avgdl``: documents that have the field and its mean length."""
    return with_mean(field_sums(posted)).drop("total")


def with_mean(sums: DataFrame) -> DataFrame:
    return sums.withColumn("avgdl", F.col("total") / F.col("docs"))


def heads(term: Column, longest: int = LONGEST_GRAM) -> Column:
    """Every prefix of a term, up to ``longest`` characters."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(term), F.lit(longest))), lambda i: F.left(term, i))


def edge_grams(terms: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """``gram, term``: every prefix of every distinct term; the vocabulary is expanded, not the postings."""
    return terms.select("term").distinct().select(F.explode(heads(F.col("term"), longest)).alias("gram"), "term")


def shingle_rows(docs: DataFrame) -> DataFrame:
    """``size, shingle, id`` of the haystack's runs of two and three tokens."""
    tokens = X.words(F.col("search_text"))
    each = F.array(*(F.struct(F.lit(n).alias("size"), shingles(tokens, n).alias("s")) for n in (2, 3)))
    return docs.select("id", F.explode(each).alias("e")).select("id", "e.size", F.explode("e.s").alias("shingle")).distinct()


def completion_entries(docs: DataFrame) -> DataFrame:
    """``doc_type, input, weight, id``: each folded completion input, cut to the length that counts."""
    inputs = F.explode(X.completion_inputs(F.col("primary_name"), F.col("aliases")))
    rows = docs.select("id", "doc_type", X.completion_weight(F.col("popularity")).alias("weight"), inputs.alias("raw"))
    return rows.select("doc_type", F.left(X.normalize(F.col("raw")), F.lit(COMPLETION_LENGTH)).alias("input"), "weight", "id").filter("input <> ''").distinct()


def numbered_terms(stats: DataFrame, folder: str) -> DataFrame:
    """``field, term, df, ord, pos, changed``: the dictionary in order, each term's place in it, and its number, which leaves
    room for others; ``changed`` tells terms whose ``df`` is no longer what stands beside the postings: none yet."""
    terms = numbered(stats, "field", "term", name="pos", path=f"{folder}/ranged-terms")
    return terms.select("field", "term", "df", F.shiftleft(F.col("pos") + 1, ROOM_BITS).alias("ord"), "pos", F.lit(False).alias("changed"))


def intervals(terms: DataFrame) -> DataFrame:
    """``field, gram, lo, hi, first, last``: the numbers of the first and the last term of every prefix of up to LONGEST_GRAM
    characters, and their places."""
    opened = terms.filter(F.col("field").isin(*OPENED)).select("field", F.explode(heads(F.col("term"))).alias("gram"), "ord", "pos")
    return opened.groupBy("field", "gram").agg(*_ends())


def _ends() -> list[Column]:
    """The ends of an interval, by number and by place."""
    return [F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("pos").alias("first"), F.max("pos").alias("last")]


def block_of(number: Column) -> Column:
    return F.shiftright(number, ROOM_BITS + BLOCK_BITS)


def _bucketed(df: DataFrame, path: str, buckets: int, by: str, *order: str) -> None:
    """``df`` in ``buckets`` files by the hash of ``by``, each in ``order``."""
    name = f"wayfold_{uuid.uuid4().hex}"
    laid = df.repartition(buckets, by).sortWithinPartitions(*order)
    laid.write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay


def _open_bucketed(spark: SparkSession, path: str, buckets: int, by: str, columns: str) -> DataFrame:
    name = f"wayfold_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def buckets_of(spark: SparkSession, rows: int) -> int:
    """As many as a shuffle has partitions, more for many rows and fewer for few: every lookup has a task for each."""
    some = max(4 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), some), -(-rows // BUCKET_ROWS))


#: The columns of stored postings.
_POSTING = "block bigint, ord bigint, id string, tf bigint, dl bigint, df bigint, copies bigint"


def write_segment(docs: DataFrame, posted: DataFrame, terms: DataFrame, rows: int, folder: str) -> tuple[str, int, str]:
    """The documents, the postings (``rows`` of them) under their terms' numbers and the completion inputs below ``folder``;
    returned are the folder, the buckets and the documents' columns, which files of an empty table would not tell."""
    buckets = buckets_of(docs.sparkSession, rows)
    laid = posted.join(terms, ["field", "term"]).select(block_of(F.col("ord")).alias("block"), "ord", "id", "tf", "dl", "df", "copies")
    _bucketed(laid, f"{folder}/postings", buckets, "block", "block", "ord", "id")
    _bucketed(docs.withColumn("_falling", -F.col("popularity")), f"{folder}/docs", buckets, "id", "doc_type", "_falling", "id")
    stored(completion_entries(docs), "", f"{folder}/completions")
    return folder, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


@dataclasses.dataclass(frozen=True)
class Segment:
    """What a build or an update added. ``gone``: the ids that later updates replaced or took out."""

    folder: str
    buckets: int
    columns: str
    docs: DataFrame
    postings: DataFrame
    entries: DataFrame
    gone: DataFrame | None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int, columns: str, gone: DataFrame | None) -> Segment:
        docs = _open_bucketed(spark, f"{folder}/docs", buckets, "id", f"{columns}, `_falling` bigint").drop("_falling")
        posted = _open_bucketed(spark, f"{folder}/postings", buckets, "block", _POSTING)
        return cls(folder, buckets, columns, docs, posted, spark.read.parquet(f"{folder}/completions"), gone)

    def alive(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` whose ``id`` still counts here."""
        if self.gone is None:
            return rows
        # an anti-join would be moved below the join that finds the rows, and ask for all postings by id
        return rows.join(self.gone.withColumn("_gone", F.lit(True)), "id", "left").filter("_gone is null").drop("_gone")


@dataclasses.dataclass
class Index:
    """A corpus and its index tables: segments, and the dictionary, prefixes and field statistics of all of them below
    ``folder``. Tables that only some methods read are made when they are first asked for, or all at once by ``complete``."""

    folder: str
    names: tuple[str, ...]
    segments: tuple[Segment, ...]
    terms: DataFrame
    prefixes: DataFrame
    fields: DataFrame
    gone: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, names: tuple[str, ...] = (), folder: str | None = None) -> Index:
        """Builds and stores the tables of the fields in ``names`` (all by default) below ``folder`` (a fresh one by default)."""
        spark, names = docs.sparkSession, names or tuple(field_terms())
        folder = folder or fresh_path(spark, "index")
        plain = stored(docs, "", f"{folder}/documents")
        return cls.laid(plain, stored(postings(plain, *names), "", f"{folder}/field-postings"), names, folder)

    @classmethod
    def laid(cls, docs: DataFrame, posted: DataFrame, names: tuple[str, ...], folder: str) -> Index:
        """The index of stored ``docs`` and their stored postings, in one segment."""
        spark = docs.sparkSession
        terms = stored(numbered_terms(term_stats(posted), folder), "", f"{folder}/terms")
        return cls.commit(spark, folder, names, [write_segment(docs, posted, terms, posted.count(), folder)], terms, field_sums(posted))

    @classmethod
    def commit(cls, spark: SparkSession, folder: str, names: tuple[str, ...], segments: list[tuple[str, int, str]], terms: DataFrame, sums: DataFrame) -> Index:
        """Writes what lookups read of all segments, the layout last: an index without it is not there."""
        stored(with_mean(sums).coalesce(1), "", f"{folder}/fields")
        stored(intervals(terms).sort("field", "gram"), "", f"{folder}/prefixes")
        layout = spark.createDataFrame([(list(names), segments)], "names array<string>, segments array<struct<folder:string,buckets:int,columns:string>>")
        stored(layout.coalesce(1), "", f"{folder}/layout")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        layout = spark.read.parquet(f"{folder}/layout").first()
        last = len(layout.segments) - 1
        gone = spark.read.parquet(f"{folder}/gone") if last else None
        dead = lambda k: gone.filter(F.col("segment") >= k).select("id") if k < last else None
        segments = tuple(Segment.open(spark, s.folder, s.buckets, s.columns, dead(k)) for k, s in enumerate(layout.segments))
        return cls(folder, tuple(layout.names), segments, *(spark.read.parquet(f"{folder}/{t}") for t in ("terms", "prefixes", "fields")), gone)

    def _of_all(self, rows) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, (s.alive(rows(s)) for s in self.segments))

    @functools.cached_property
    def docs(self) -> DataFrame:
        return self._of_all(lambda s: s.docs)

    @functools.cached_property
    def entries(self) -> DataFrame:
        return self._of_all(lambda s: s.entries)

    @functools.cached_property
    def postings(self) -> DataFrame:
        """``block, ord, id, tf, dl, df, copies`` of all segments."""
        return self.with_df(self._of_all(lambda s: s.postings))

    def with_df(self, rows: DataFrame) -> DataFrame:
        """``rows`` of postings with the ``df`` of now: segments keep what it was when they were written."""
        if len(self.segments) == 1:
            return rows
        changed = self.terms.filter("changed").select("ord", F.col("df").alias("_df"))
        return rows.join(changed, "ord", "left").withColumn("df", F.coalesce("_df", "df")).drop("_df")

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @functools.cached_property
    def haystacks(self) -> int:
        """How many documents have a haystack."""
        found = self.fields.filter("field = 'search_text'").select("docs").first()
        return found.docs if found else 1

    def _made(self, name: str, make) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            stored(make(), "", path)
        return self.spark.read.parquet(path)

    def neighbours(self, kind: str) -> Neighbours:
        """What misspellings are sought among: ``words`` of the haystack, ``grams`` (these words' heads too), short ``heads``
        of completion inputs, and whole ``inputs``."""
        haystack = F.col("field") == "search_text"

        def texts() -> DataFrame:
            if kind == "words":
                return self.terms.filter(haystack).select("term")
            if kind == "grams":
                return self.prefixes.filter(haystack).select(F.col("gram").alias("term")).union(self.terms.filter(haystack).select("term"))
            if kind == "heads":
                return self.head_inputs().select(F.col("head").alias("term"))
            return self.entries.select(F.col("input").alias("term"))

        made = Neighbours.of(texts())
        return Neighbours(self._made(f"near-{kind}-variants", lambda: made.variants), self._made(f"near-{kind}-members", lambda: made.members))

    def head_inputs(self) -> DataFrame:
        """``head, input``: the inputs behind every head of up to SHORT_HEAD characters."""
        inputs = self.entries.select("input").distinct()
        return self._made("head-inputs", lambda: inputs.select(F.explode(heads(F.col("input"), SHORT_HEAD)).alias("head"), "input"))

    def heaviest(self) -> DataFrame:
        """``doc_type, head, input, weight, id``: of each type, the HEAVIEST entries behind every short head."""

        def make() -> DataFrame:
            each = self.entries.select("doc_type", "input", "weight", "id", F.explode(heads(F.col("input"), SHORT_HEAD)).alias("head"))
            order = W.partitionBy("doc_type", "head").orderBy(F.desc("weight"), "id", "input")
            return each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= HEAVIEST).drop("n").sort("head")

        return self._made("heaviest", make)

    def complete(self) -> Index:
        """Makes everything that any method reads."""
        for kind in ("words", "grams", "heads", "inputs"):
            self.neighbours(kind)
        self.heaviest()
        return self


# ------------------------------------------------------------------ lookups

UNIT = ("field", "open", "text")


def unit_ranges(units: DataFrame, index: Index) -> DataFrame:
    """Units (a text in a field, as a whole word or as a word's start) with the interval ``lo`` to ``hi`` of the terms they
    mean, by number, and ``first`` to ``last``, by place."""
    asked = units.select(*UNIT).distinct()
    terms = index.terms.select("field", F.col("term").alias("text"), F.col("ord").alias("lo"), F.col("pos").alias("first"))
    whole = asked.filter("not open").join(terms, ["field", "text"]).withColumns({"hi": F.col("lo"), "last": F.col("first")})
    opened = asked.filter("open").withColumn("gram", F.left("text", F.lit(LONGEST_GRAM))).join(index.prefixes, ["field", "gram"]).drop("gram")
    # the few texts longer than any stored prefix are narrowed down among the terms of its interval
    long = opened.filter(F.length("text") > LONGEST_GRAM).withColumn("block", F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi")))))
    narrow = long.join(index.terms.select(block_of(F.col("ord")).alias("block"), "ord", "pos", "term"), "block").filter(F.col("ord").between(F.col("lo"), F.col("hi")) & F.startswith("term", "text"))
    narrow = narrow.groupBy(*UNIT).agg(*_ends())
    columns = (*UNIT, "lo", "hi", "first", "last")
    return whole.select(*columns).unionByName(opened.filter(F.length("text") <= LONGEST_GRAM).select(*columns)).unionByName(narrow.select(*columns))


def range_postings(ranges: DataFrame, index: Index) -> DataFrame:
    """``ranges`` by the postings of their terms: the blocks asked for go to the buckets, postings stay where they are."""
    asked = ranges.withColumn("block", F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi")))))
    within = F.col("ord").between(F.col("lo"), F.col("hi"))
    return functools.reduce(DataFrame.unionByName, (s.alive(asked.join(s.postings, "block").filter(within)) for s in index.segments))
