"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``, rows they keep unchanged but for the text that stage 4
shortens. Rows without doc_id cannot be named by a decision of stages 2 and 3 and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import fresh_name, new_path, read_table, without, written
from wayfold.llm.encoder import tokenizer_path
from wayfold.llm.lsh_forest import near_dedup
from wayfold.llm.lsm_dedup import exact_dedup, sha256
from wayfold.llm.packing import pack_documents
from wayfold.llm.queries import WORD_BPE
from wayfold.llm.suffix_dedup import remove_repeats
from wayfold.llm.toxicity import fit, score_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5, row by row: null and empty texts, null and repeated doc_ids included. Without
    labels nothing is toxic; an empty table gives no rows."""
    name = fresh_name(docs, "toxicity")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")), name=name)
    return scored.filter(F.col(name) < 0.5).drop(name)


def _reused(docs: DataFrame) -> DataFrame:
    """The doc_ids of more than one row."""
    return docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id; a row met twice stays once, and rows of one doc_id with
    different texts are decided each for itself."""
    gone = exact_dedup(docs).filter(~F.col("kept"))
    left, twice = without(docs, gone), _reused(docs)
    if twice.isEmpty():
        return left
    digest = fresh_name(docs, "digest")
    rows = docs.join(twice, "doc_id", "left_semi").withColumn(digest, sha256(F.coalesce("text", F.lit(""))))
    gone = gone.select(F.col("doc_id").alias("_wf_id"), F.col("digest").alias("_wf_digest"))
    stay = rows.join(gone, (F.col("doc_id") == F.col("_wf_id")) & (F.col(digest) == F.col("_wf_digest")), "left_anti").dropDuplicates(["doc_id", digest])
    return without(left, twice).unionByName(stay.drop(digest))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest doc_id; rows that share a doc_id are decided
    each for itself and rank after all others."""
    twice = _reused(docs)
    if twice.isEmpty():
        return without(docs, near_dedup(docs).filter(~F.col("kept")))
    row = fresh_name(docs, "row_id")
    after = docs.agg(F.max("doc_id")).first()[0] + 1
    again = docs.join(twice, "doc_id", "left_semi").withColumn(row, F.lit(after) + F.monotonically_increasing_id())
    rows, _ = written(without(docs, twice).withColumn(row, F.col("doc_id").cast("long")).unionByName(again), "numbered")
    gone = near_dedup(rows.select(F.col(row).alias("doc_id"), "text")).filter(~F.col("kept"))
    return without(rows, gone.select(F.col("doc_id").alias(row)), row).drop(row)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that earlier documents (by doc_id) hold already.

    A character of which a cut leaves only some bytes goes; a null text that loses nothing stays null. ``n_chars``
    follows the text.
    """
    cut = remove_repeats(docs, carry=docs.columns)
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("rest")["text"]).otherwise(_text(F.col("kept")))
    columns = [text.alias("text") if c == "text" else F.when(whole, F.col("rest")[c]).otherwise(F.char_length(text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns]
    return cut.select(*columns)


#: A replacement character, and a noncharacter that escapes it and itself.
_REPLACED, _ESCAPE = "\ufffd", "\ufdd0"


def _text(kept):
    """The whole characters among ``kept`` bytes. What a cut left of others becomes replacement characters, which go;
    the text's own ones are written in escapes meanwhile."""
    own = F.replace(F.replace(kept.cast("string"), F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_REPLACED), F.lit(_ESCAPE + "1"))
    left = F.replace(F.make_valid_utf8(own), F.lit(_REPLACED), F.lit(""))
    return F.replace(F.replace(left, F.lit(_ESCAPE + "1"), F.lit(_REPLACED)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: a null or empty text is its end id alone, rows that share a doc_id are packed
    each for itself, an empty table gives no rows."""
    pieces = pack_documents(docs, tokenizer_path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix dedup", cut_repeats),
    ("packing", pack),
]

#: No SQL: learned scores, MinHash components and a tokenizer's ids; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
