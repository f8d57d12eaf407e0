"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import read_table
from wayfold.llm.encoder import tokenizer_path

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.token_frames import read_token_files, write_token_files

    manifest, _ = write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.bpe_chunks import encode_decode

    coded = encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.pivot_dedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.lsm_dedup import exact_dedup

    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""


def op6_count_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.count_transducer import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), 1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.common import texts_of
    from wayfold.llm.toxicity import fit, held_out, score_documents

    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(texts_of(docs), fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.lsh_forest import near_dedup

    return near_dedup(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.packing import pack_documents

    pieces = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those labelled to be of good quality."""
    from wayfold.llm.lm_scoring import score_documents

    good = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return score_documents(read_table(spark, sf_dir, "documents"), good, tokenizer_path(WORD_BPE))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.divergence import divergence

    return divergence(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct k) >= 10),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct d.lang, source, coalesce(v, 0) as v from d left join v using (lang)),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, g.v from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p,
        1 + (1000000000::hugeint * (sum(n) over (partition by lang, term) + 2)) // (sum(n) over (partition by lang) + 2 * v) as q from f),
pairs as (select g.lang, g.source, 'pair' as part, h.source as item,
        coalesce((select sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) from p a join p b using (lang, term) where a.lang = g.lang and a.source = g.source and b.source = h.source), 0) as value
    from g join g h on g.lang = h.lang and g.source <> h.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive tab as (select list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) as t),
d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+') as runs from documents),
r as (select doc_id, run, count(*) as c from (select doc_id, unnest(runs) as run from d) where length(run) >= 7 group by all),
x as (select run, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from r),
b as (select run, c, list_transform(range(length(x) // 2), lambda i: 16 * (position(substr(x, (2 * i + 1)::int, 1) in '0123456789ABCDEF') - 1) + position(substr(x, (2 * i + 2)::int, 1) in '0123456789ABCDEF') - 1) as bytes from x),
h as (select run, c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8))) as h from b, tab),
w as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run) + 2)::int) else run end as word, c from h),
v as (select word, sum(c)::bigint as n from w where length(word) >= 7 group by word having sum(c) >= 2),
hole as (select word, n, left(word, i::int) || '*' || substr(word, (i + 2)::int) as k from (select word, n, unnest(range(length(word))) as i from v)),
gone as (select distinct word, n, left(word, i::int) || substr(word, (i + 2)::int) as k from (select word, n, unnest(range(length(word))) as i from v)),
near as (select a.word, a.n, b.word as other, b.n as m from hole a join hole b on a.k = b.k and a.word <> b.word
    union all select g.word, g.n, v.word, v.n from gone g join v on v.word = g.k
    union all select v.word, v.n, g.word, g.n from gone g join v on v.word = g.k),
best as (select word, n, other as form, m from near qualify row_number() over (partition by word order by m desc, other) = 1),
form as (select word, form, m as form_n from best where m >= 10 * n),
chain as (select word, form as root, 1 as step from form union all select chain.word, form.form, step + 1 from chain join form on form.word = chain.root),
ends as (select word, arg_max(root, step) as root from chain group by word)
select v.word, form.form, coalesce(ends.root, v.word) as root, v.n, coalesce(k.n_near, 0) as n_near, form.form_n
from v left join (select word, count(*) as n_near from near group by word) k using (word) left join form using (word) left join ends using (word)
"""


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.posting_lists import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_token_frames": op2_token_frames,
        "op3_bpe_chunks": op3_bpe_chunks,
        "op4_pivot_index": op4_pivot_index,
        "op5_lsm_dedup": op5_lsm_dedup,
        "op6_count_transducer": op6_count_transducer,
        "op7_toxicity": op7_toxicity,
        "op8_lsh_forest": op8_lsh_forest,
        "op9_packing": op9_packing,
        "op10_cross_entropy": op10_cross_entropy,
        "op11_divergence": op11_divergence,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_posting_lists": op13_posting_lists,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {"op5_lsm_dedup": OP5_SQL, "op11_divergence": OP11_SQL, "op12_spelling_variants": OP12_SQL}
