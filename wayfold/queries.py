"""Registered queries over the supplied tables; their DuckDB equivalents are in ``wayfold.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators import evaluation as E
from wayfold.operators import ranking as R
from wayfold.operators import retrieval as M
from wayfold.operators.fuzzy import Neighbours, candidate_terms, fuzzy_terms
from wayfold.plans import corpus as C
from wayfold.plans import index as I  # noqa: E741
from wayfold.plans.parse import parse_queries
from wayfold.plans.updates import compacted, updated
from wayfold.schema import ImportOptions
from wayfold.sources import store as S
from wayfold.sources import tables as T
from wayfold.sources.exports import usable
from wayfold.sources.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]


def current_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_cells(usable(T.register_rows(spark, sf)))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Streets, municipalities and postcodes."""
    return C.build_corpus(usable(T.register_rows(spark, sf)), ImportOptions.level("street"))


def index(spark: SparkSession, sf: str, *names: str) -> M.Index:
    """The street-level index of some fields (all by default), stored."""
    return M.Index.of(corpus(spark, sf), names)


def queries_df(spark: SparkSession, sf: str) -> DataFrame:
    return stored(parse_queries(T.typed_queries(spark, sf)), "queries")


def flat(docs: DataFrame) -> DataFrame:
    """Documents as scalars: coordinates to six places, lists joined."""
    cols = ["id", "doc_type", "label", "place_name", "street_name", "house_number", "box_number", "postcode", "post_name", "municipality_name", "nis_code", "search_text", "primary_name", "primary_name_norm"]
    return docs.select(*cols, F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("popularity").cast("bigint").alias("popularity"), F.array_join("aliases", "|").alias("aliases"), F.col("rank_tier").cast("bigint").alias("rank_tier"))


def docs_text(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents")


def normalize_text(spark, sf):
    return docs_text(spark, sf).select("doc_id", X.normalize(F.col("text")).alias("norm"))


def tokenize_distinct(spark, sf):
    words = docs_text(spark, sf).select(F.explode(X.tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def haystack(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select("p_partkey", X.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("haystack"))


def classify_tokens(spark, sf):
    words = docs_text(spark, sf).select(F.explode(X.tokenize(F.col("text"))).alias("token")).distinct()
    t = F.col("token")
    return words.select("token", X.is_postcode(t).alias("postcode"), X.is_numeric(t).alias("numeric"), X.is_house_number(t).alias("house_number"), X.is_box_marker(t).alias("box_marker"))


def title_case(spark, sf):
    c = T.table(spark, sf, "customer")
    shout = F.upper(F.concat_ws("-", "c_name", F.lit("le"), "c_mktsegment", F.lit("van der aa")))
    return c.select("c_custkey", X.title_case(shout).alias("titled"), X.title_case(F.col("c_name")).alias("untouched"))


def collapse_whitespace(spark, sf):
    return docs_text(spark, sf).select("doc_id", X.collapse_whitespace(F.col("text")).alias("collapsed"))


def name_distances(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    # heads of 4 to 11 letters, against the names that start alike
    tokens = p.select(F.left(X.normalize(F.col("name")), 4 + F.length("name") % 8).alias("token")).distinct()
    # and, so that pairs far apart are measured too, those that end alike
    near = tokens.join(p, F.left("token", F.lit(1)) == F.left("name", F.lit(1))).union(tokens.join(p, F.right("token", F.lit(1)) == F.right("name", F.lit(1)))).distinct()
    return near.select("token", "name", X.name_distance(F.col("token"), X.normalize(F.col("name"))).cast("bigint").alias("distance"), X.max_distance(F.col("token")).cast("bigint").alias("allowed"))


def register_filter(spark, sf):
    rows = usable(T.register_rows(spark, sf))
    return rows.groupBy("region_code", "postcode").agg(F.count(F.lit(1)).alias("usable"))


def street_documents(spark, sf):
    return flat(C.street_documents(current_rows(spark, sf)))


def municipality_documents(spark, sf):
    return flat(C.municipality_documents(current_rows(spark, sf)))


def postcode_documents(spark, sf):
    return flat(C.postcode_documents(current_rows(spark, sf)))


def address_documents_with_popularity(spark, sf):
    return flat(C.address_documents(current_rows(spark, sf)))


def grouping_sets_aggregate(spark, sf):
    g = C.aggregate_all(current_rows(spark, sf))
    return g.select("level", "k_street", "k_postcode", "k_nis", F.col("popularity").cast("bigint").alias("popularity"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def judged(spark, sf):
    return C.judge_places(T.place_rows(spark, sf))


def place_documents(spark, sf):
    return C.place_documents(judged(spark, sf)).select("id", "label", "place_name", "street_name", "postcode", "post_name", "municipality_name", F.array_join("aliases", "|").alias("aliases"))


def place_reject_reasons(spark, sf):
    return C.reject_counts(judged(spark, sf))



def json_name_pick(spark, sf):
    return T.place_rows(spark, sf).select("place_cdbid", "name", C.json_name(C.json_object(F.col("name"))).alias("picked"))


def locality_split(spark, sf):
    n = T.table(spark, sf, "nation").select(F.explode(F.array(F.col("n_name"), F.concat(F.lit("Old  "), "n_name", F.lit(" ("), "n_name", F.lit(")")))).alias("locality"))
    post, municipality = C.split_locality(F.col("locality"))
    return n.select("locality", post.alias("post_name"), municipality.alias("municipality"))


def query_parse(spark, sf):
    q = queries_df(spark, sf)
    return q.select("query", *(F.array_join(c, " ").alias(c) for c in ("tokens", "locative", "detail", "number_tokens", "needed")), "bare_numeric", "typing_locative", "prefix")


def postings(spark, sf):
    return I.postings(corpus(spark, sf)).select("field", "term", "id", "tf", "dl")


def term_stats(spark, sf):
    return I.term_stats(I.postings(corpus(spark, sf)))


def field_stats(spark, sf):
    return I.field_stats(I.postings(corpus(spark, sf))).withColumn("avgdl", F.round("avgdl", 6))


def edge_ngrams(spark, sf):
    return I.edge_grams(I.postings(corpus(spark, sf), "search_text"))


def shingles(spark, sf):
    return I.shingle_rows(corpus(spark, sf)).select(F.col("size").cast("bigint").alias("size"), "shingle", "id")


def completion_inputs(spark, sf):
    return I.completion_entries(corpus(spark, sf)).select("doc_type", "input", F.col("weight").cast("bigint").alias("weight"), "id")


def bm25_scores(spark, sf):
    """Whole-word BM25 over haystacks for the tokens of every query, length norm included."""
    posted = stored(I.postings(corpus(spark, sf), "search_text"), "postings")
    tokens = queries_df(spark, sf).select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    hits = tokens.join(posted, "term").join(I.term_stats(posted), ["field", "term"]).join(I.field_stats(posted), "field")
    part = R.bm25(1.0, R.idf(F.col("docs"), F.col("df")), F.col("tf"), R.length_norm(F.col("dl"), F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 4).alias("score"))


def _gate_counts(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "id").distinct()


def gate_fulltext(spark, sf):
    return M.fulltext_gate(queries_df(spark, sf), index(spark, sf, "search_text")).withColumn("ft_score", F.round("ft_score", 4))


def gate_name_prefix(spark, sf):
    return _gate_counts(M.name_prefix_gate(queries_df(spark, sf), index(spark, sf, "name_start")))


def gate_words(spark, sf):
    """The gate that the clause methods share."""
    return _gate_counts(M.gate(queries_df(spark, sf), index(spark, sf, "search_text")))


def gate_totals(spark, sf):
    return M.totals(M.gate(queries_df(spark, sf), index(spark, sf, "search_text"))).withColumn("total", F.col("total").cast("bigint"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 4).alias("score"), *(["pass"] if "pass" in hits.columns else []))


def suggest_fulltext(spark, sf):
    return _hits(M.suggest_fulltext(queries_df(spark, sf), index(spark, sf, "search_text", "name_start")))


def suggest_fulltext_exact(spark, sf):
    """The exact passes alone."""
    q = queries_df(spark, sf)
    found = M._fulltext_pass(q, index(spark, sf, "search_text", "name_start"), None)
    return _hits(R.top_k(found.withColumn("score", F.round("score", M.PLACES)), 10))


def score_parts(spark, sf):
    """What each part of the additive score gives each candidate of the name-prefix pass."""
    i = index(spark, sf, "name_start")
    q = queries_df(spark, sf)
    rows = M.name_prefix_gate(q, i).join(R.document_side(i.docs), "id").join(R.query_side(q.select(*M._QUERY)), "query_id").withColumn("ft_score", F.lit(0.0))
    scored = R.additive_score(rows, debug=True)
    return scored.select("query_id", "id", F.round("score", 4).alias("score"), *(F.round(f"debug.{k}", 4).alias(k) for k in R.components()))


def _suggest(method: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        names = ("search_text",) if method == "completion" else ()
        return _hits(M.REGISTRY[method](queries_df(spark, sf), index(spark, sf, *names)))

    return run


def recovery_ladder(spark, sf):
    """Which pass answers each query."""
    hits = M.suggest_clauses(queries_df(spark, sf), index(spark, sf), "bool_prefix")
    return hits.groupBy("query_id").agg(F.max("pass").alias("pass"), F.count(F.lit(1)).alias("hits"))


def _number_ladder(method: str) -> Query:
    """Numbered queries against an index of all documents, addresses and their house numbers too."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        asked = stored(parse_queries(T.numbered_queries(spark, sf), house_numbers_indexed=True), "queries")
        # the tables are joined once for the addresses and for their copies
        lines = stored(T.order_lines(spark, sf).filter(T.CURRENT), "lines")
        # the fields that the method reads; addresses alike are looked up and scored once
        names = ("search_text", "name_start") if method == "fulltext" else (*I.fields(), "name")
        found = C.Condensed.of(usable(T.register_rows(spark, sf, lines)), ImportOptions.level("all"))
        return _hits(found.with_copies(M.REGISTRY[method](asked, M.Index.of(found.docs, names)), 10))

    return run


def updated_index(spark: SparkSession, sf: str, *names: str) -> M.Index:
    """The street-level index after two updates: built of streets with their localities left out and of postcodes under
    ids that are taken out again; then postcodes and half of the streets come as they are, then the other half and the municipalities."""
    docs = stored(corpus(spark, sf), "corpus")
    street, early = F.col("doc_type") == "street", F.coalesce(F.col("street_name") < "m", F.lit(False))
    outdated = C.finish(docs.filter(street).withColumns({"municipality_name": F.lit("elsewhere"), "post_name": F.lit(None).cast("string")})).select(*docs.columns)
    extra = docs.filter("doc_type = 'postcode'").withColumn("id", F.concat(F.lit("old:"), "id"))
    first = M.Index.of(outdated.unionByName(extra), names)
    second = updated(first, docs.filter((street & early) | (F.col("doc_type") == "postcode")), extra.select("id"))
    return updated(second, docs.filter((street & ~early) | (F.col("doc_type") == "municipality")))


def updated_term_stats(spark, sf):
    """What the dictionary says after updates."""
    return updated_index(spark, sf, *I.fields()).terms.select("field", "term", "df")


def updated_field_stats(spark, sf):
    return updated_index(spark, sf, *I.fields()).fields.select("field", "docs", F.round("avgdl", 6).alias("avgdl"))


def updated_suggest_fulltext(spark, sf):
    """The additive method over three segments."""
    return _hits(M.suggest_fulltext(queries_df(spark, sf), updated_index(spark, sf, "search_text", "name_start")))


def updated_suggest_bool_prefix(spark, sf):
    """A clause method over three segments."""
    return _hits(M.REGISTRY["bool_prefix"](queries_df(spark, sf), updated_index(spark, sf)))


def compacted_suggest_completion(spark, sf):
    """Completion after the segments became one."""
    return _hits(M.suggest_completion(queries_df(spark, sf), compacted(updated_index(spark, sf, "search_text"))))


def fuzzy_relaxed(spark, sf):
    q = M.relax(queries_df(spark, sf))
    return q.select("query_id", "target", "relaxed", X.max_distance(F.col("target")).cast("bigint").alias("allowed"))


def fuzzy_vocabulary(spark, sf):
    """Vocabulary terms within the edits (exchanges included) of the tokens of the queries."""
    terms = I.postings(corpus(spark, sf), "search_text").select("term").distinct()
    tokens = queries_df(spark, sf).select(F.explode("tokens").alias("token")).distinct()
    return fuzzy_terms(tokens, Neighbours.of(terms)).withColumn("distance", F.col("distance").cast("bigint"))


def candidate_merge(spark, sf):
    h = T.ranked_hits(spark, sf).select(F.col("query").alias("query_id"), "id", "engine", (100 - F.col("rank")).alias("score"))
    passes = [h.filter(F.col("engine") == e).drop("engine") for e in ("click", "error")]
    return R.merge_candidates(passes).select("query_id", "id", "score", F.col("pass_no").cast("bigint").alias("pass_no"))


def function_score(spark, sf):
    return corpus(spark, sf).select("id", F.round(R.popularity_factor(), 6).alias("factor"))


def tier_topk(spark, sf):
    docs = corpus(spark, sf).withColumns({"query_id": F.col("municipality_name"), "score": F.length("label").cast("double")})
    return _hits(R.top_k(docs, 10)).drop("score")


def latency_summary(spark, sf):
    s = E.latency_summary(T.latency_samples(spark, sf), "engine")
    return s.select("engine", "n", *(F.round(c, 4).alias(c) for c in s.columns[2:]))


def latency_by_query(spark, sf):
    s = E.latency_summary(T.latency_samples(spark, sf), "engine", "query")
    # by way of decimals: interpolated values lie on rounding ties
    return s.select("engine", "query", "n", *(F.round(F.col(c).cast("decimal(30,8)"), 4).cast("double").alias(c) for c in s.columns[3:]))


def latency_windows(spark, sf):
    from wayfold.streaming.query_log import windowed_latency

    w = windowed_latency(T.latency_samples(spark, sf))
    return w.select(F.col("window.start").cast("string").alias("start"), "engine", "n", F.round("mean_ms", 4).alias("mean_ms"), "max_ms")


def rolling_median(spark, sf):
    return E.rolling_median(T.latency_samples(spark, sf)).select("engine", "iter", F.round("rolling_ms", 4).alias("rolling_ms"))


def spearman(spark, sf):
    pairs = E.agreement(T.ranked_hits(spark, sf), "click")
    return pairs.select("engine", "query", F.col("overlap").cast("bigint").alias("overlap"), F.round("jaccard", 6).alias("jaccard"), F.round("spearman", 6).alias("spearman"), "same_top")


def agreement_report(spark, sf):
    s = E.agreement_summary(E.agreement(T.ranked_hits(spark, sf), "click"))
    return s.select("engine", "comparable", *(F.round(c, 6).alias(c) for c in ("mean_overlap", "mean_jaccard", "mean_spearman")), F.col("identical_top").cast("bigint").alias("identical_top"))


def worst_disagreements(spark, sf):
    return E.disagreements(E.agreement(T.ranked_hits(spark, sf), "click")).select("engine", "query", F.col("overlap").cast("bigint").alias("overlap"))


def golden(spark, sf) -> DataFrame:
    """Each user's expected value: the one of its first event."""
    e = T.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("query")).agg(F.min_by(F.floor("value").cast("bigint").cast("string"), "event_id").alias("v"))
    return e.select("query", F.array(F.concat(F.lit("value "), "v")).alias("expect"))


def golden_report(spark, sf):
    g = E.golden_summary(E.golden_ranks(golden(spark, sf), T.ranked_hits(spark, sf)))
    return g.select("engine", "entries", *(F.col(c).cast("bigint").alias(c) for c in ("hit_1", "hit_3", "hit_10")), F.round("mrr", 6).alias("mrr"))


def verdict(spark, sf):
    latency = E.latency_summary(T.latency_samples(spark, sf), "engine")
    return E.verdict(latency, E.golden_summary(E.golden_ranks(golden(spark, sf), T.ranked_hits(spark, sf))))


def rank_comparison(spark, sf):
    return E.rank_comparison(T.ranked_hits(spark, sf), "click", "view")


def benchmark_long(spark, sf):
    s = E.latency_summary(T.latency_samples(spark, sf), "engine").withColumn("n", F.col("n").cast("bigint"))
    return E.long_format(s, "latency_overall", ["n", "min_ms", "max_ms"]).withColumn("value", F.col("value").cast("double"))


def upsert_merge(spark, sf):
    """Streets as addresses see them later put over the street documents: the later row of an id counts."""
    old = current_rows(spark, sf).select(F.concat(F.lit("address:"), "region_code", F.lit(":"), "address_id").alias("id"), F.col("house_number").alias("value"), F.lit(0).alias("ord"))
    new = old.filter(F.col("value").cast("int") % 2 == 0).withColumns({"value": F.concat("value", F.lit("b")), "ord": F.col("value").cast("int")})
    return S.merge_by_id(old.dropDuplicates(["id"]).select("id", "value"), new, "ord").select("id", "value")


def type_reset(spark, sf):
    return S.import_summary(S.reset_types(corpus(spark, sf), ["street"]))


def import_summary(spark, sf):
    return S.import_summary(C.build_corpus(usable(T.register_rows(spark, sf)), ImportOptions.level("all")))


def suggestion_json(spark, sf):
    """The first suggestion of each query as JSON, and what a reader finds in it."""
    # the first of the usual ten: a limit of one would leave out the misspelt names that a limit of ten seeks
    out = M.response(M.suggest_fulltext(queries_df(spark, sf), index(spark, sf, "search_text", "name_start")).filter("rank = 1"))
    inside = F.from_json("suggestion", "id string, type string, label string, place_name string, street_name string, house_number string, postcode string, post_name string, municipality_name string, nis_code string, coordinates struct<lat:double,lon:double>, score double, popularity bigint")
    flat_ = out.select("query_id", inside.alias("s")).select("query_id", "s.*")
    return flat_.select("query_id", "id", "type", "label", "street_name", "postcode", "post_name", "municipality_name", "nis_code", F.round("coordinates.lat", 6).alias("lat"), F.round("coordinates.lon", 6).alias("lon"), "score", "popularity")


REGISTERED: dict[str, Query] = {
    f.__name__: f
    for f in (
        normalize_text, tokenize_distinct, haystack, classify_tokens, title_case, collapse_whitespace, name_distances, register_filter, street_documents,
        municipality_documents, postcode_documents, address_documents_with_popularity, grouping_sets_aggregate, place_documents, place_reject_reasons,
        json_name_pick, locality_split, query_parse, postings, term_stats, field_stats, edge_ngrams, shingles, completion_inputs, bm25_scores,
        gate_fulltext, gate_name_prefix, gate_words, gate_totals, suggest_fulltext, suggest_fulltext_exact, score_parts, recovery_ladder, fuzzy_relaxed,
        fuzzy_vocabulary, candidate_merge, function_score, tier_topk, latency_summary, latency_by_query, latency_windows, rolling_median, spearman,
        agreement_report, worst_disagreements, golden_report, verdict, rank_comparison, benchmark_long, upsert_merge, type_reset, import_summary, suggestion_json,
        updated_term_stats, updated_field_stats, updated_suggest_fulltext, updated_suggest_bool_prefix, compacted_suggest_completion,
    )
}
REGISTERED |= {"number_ladder_fulltext": _number_ladder("fulltext"), "number_ladder_clauses": _number_ladder("bool_prefix")}
REGISTERED |= {f"suggest_{m}": _suggest(m) for m in ("edge_ngram", "prefixes", "sayt", "bool_prefix", "completion")}
