"""Who may appear for a query, how the appearing are scored, and what is tried when nobody appears.

All methods take a batch of parsed queries. What a batch asks of the index is a table of *units*: a text to be met in a
field, as a whole word or as the start of one. Each distinct unit is looked up once for the whole batch, as an interval of
the sorted dictionary, so there is no theta join however large the corpus is, and postings stay in their buckets. A gate
opens with the rarest unit of each query and probes the others. Hits, gated pairs and answered queries are stored tables: no pass
carries the plan of the passes before it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators.fuzzy import fuzzy_terms, stem, swap_distance
from wayfold.operators.ranking import FUZZY_PENALTY, additive_score, bm25, document_side, idf, length_norm, popularity_factor, query_side, top_k
from wayfold.plans.index import HEAVIEST, SHINGLES, SHORT_HEAD, UNIT, Index, copies_of, range_postings, shingles, unit_ranges
from wayfold.plans.parse import with_gate, without_numbers
from wayfold.schema import TYPES
from wayfold.sources.scratch import stored

#: Shorter tokens never reach the full-text index.
LEAST_FULLTEXT = 3
#: How many hits are counted for a query.
MOST_TOTAL = 1000
#: Places to which a score counts in an order: the order in which its parts were added does not.
PLACES = 6


# ------------------------------------------------------------------ lookups


def unit_hits(units: DataFrame, index: Index, weight: Column | None = None) -> DataFrame:
    """``field, open, text, id, tf, dl, copies`` of every document that holds a term of a unit; ``tf`` counts all of its terms.

    With ``weight`` (of a posting's ``tf``, ``df``) also ``ft``, its sum.
    """
    rows = range_postings(unit_ranges(units, index), index)
    if weight is not None:
        rows = index.with_df(rows)
    more = [] if weight is None else [F.sum(weight).alias("ft")]
    return rows.groupBy(*UNIT, "id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"), F.max("copies").alias("copies"), *more)


def unit_df(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*UNIT).agg(F.sum("copies").alias("df"))


def meet(slots: DataFrame, hits: DataFrame, allowed: DataFrame | None = None, score: str | None = None) -> DataFrame:
    """``query_id, id``: documents met by every unit among a query's ``slots`` (query_id and units), and the sum of the
    hits' ``score``, if one is named.

    The rarest unit of a query gives its candidates, so a common word costs no more than the rarest one beside it.
    ``allowed`` (ids) restricts the candidates before anything is probed.
    """
    key = _key()
    slots = slots.select("query_id", *UNIT).distinct()
    known = slots.join(unit_df(hits), list(UNIT), "left").select("query_id", F.struct(F.coalesce("df", F.lit(0)).alias("df"), key.alias("key")).alias("u"))
    # queries that ask for the same units are met once
    asks = known.groupBy("query_id").agg(F.sort_array(F.collect_list("u")).alias("units")).filter(F.col("units")[0]["df"] > 0)
    asks = stored(asks.select("query_id", F.min("query_id").over(W.partitionBy("units")).alias("first"), F.col("units")["key"].alias("units")), "asks")
    sets = asks.filter("query_id = first").select("first", F.col("units")[0].alias("key"), F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(1))).alias("others"))
    held = hits.select("id", key.alias("key"), (F.lit(0.0) if score is None else F.col(score)).alias("given"))
    opening = sets.join(held, "key").select("first", "others", "id", "given")
    if allowed is not None:
        opening = opening.join(allowed, "id", "left_semi")
    alone = opening.filter("size(others) = 0").select("first", "id", "given")
    # a document's hits of the batch lie in one row, so a candidate is probed once and not for each unit
    together = held.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "given"))).alias("held"))
    probed = opening.filter("size(others) > 0").join(together, "id").filter(F.size(F.array_except("others", F.map_keys("held"))) == 0)
    met = probed.select("first", "id", F.aggregate("others", F.col("given"), lambda total, k: total + F.element_at("held", k)).alias("given"))
    both = asks.select("query_id", "first").join(alone.unionByName(met), "first")
    return both.select("query_id", "id", *([F.col("given").alias(score)] if score else []))


def _key() -> Column:
    """A unit as one text."""
    return F.concat_ws("|", "field", F.col("open").cast("string"), "text")


def _unit(field: str, opened: bool, text: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(opened).alias("open"), text.alias("text"))


def word_slots(queries: DataFrame, field: str = "search_text") -> DataFrame:
    """The units of a gate: every needed word, and the typed prefix."""
    prefix = F.when(F.col("prefix").isNotNull(), F.array(_unit(field, True, F.col("prefix")))).otherwise(F.array().cast("array<struct<field:string,open:boolean,text:string>>"))
    return queries.select("query_id", F.explode(F.concat(F.transform("needed", lambda t: _unit(field, False, t)), prefix)).alias("u")).select("query_id", "u.*")


def gate(queries: DataFrame, index: Index, field: str = "search_text", types: list[str] | None = None) -> DataFrame:
    """``query_id, id``: documents that hold every needed word and a word of the typed prefix."""
    slots = word_slots(queries, field)
    return meet(slots, unit_hits(slots, index), allowed_ids(index, types))


def allowed_ids(index: Index, types: list[str] | None) -> DataFrame | None:
    """Ids of the documents of some types; nothing where all are asked for."""
    if not types or set(types) == set(TYPES):
        return None
    return index.docs.filter(F.col("doc_type").isin(*types)).select("id")


# ------------------------------------------------------------------ the additive method


def fulltext_gate(queries: DataFrame, index: Index, types: list[str] | None = None) -> DataFrame:
    """``query_id, id, ft_score``: every token a word's prefix, numbers whole words unless the query is all numbers; short
    tokens filter but do not score. The score is the sum of tf times squared log10(N / df) over the words met."""
    tokens = queries.select("query_id", "bare_numeric", F.explode(F.array_distinct(X.sanitize_tokens(F.col("locative")))).alias("text"))
    opened = F.col("bare_numeric") | ~X.is_numeric(F.col("text"))
    slots = stored(tokens.select("query_id", F.lit("search_text").alias("field"), opened.alias("open"), "text"), "slots")
    rare = F.log10(F.lit(index.haystacks) / F.col("df"))
    weight = F.when(F.length("text") >= LEAST_FULLTEXT, rare * rare * F.col("tf")).otherwise(0.0)
    hits = stored(unit_hits(slots, index, weight), "fulltext-hits")
    return meet(slots, hits, allowed_ids(index, types), "ft").withColumnRenamed("ft", "ft_score")


def name_prefix_gate(queries: DataFrame, index: Index, types: list[str] | None = None) -> DataFrame:
    """``query_id, id``: documents other than addresses whose folded name starts with the joined tokens: an interval of names."""
    typed = queries.select("query_id", F.lit("name_start").alias("field"), F.lit(True).alias("open"), F.array_join("locative", " ").alias("text")).filter("text <> ''")
    found = typed.join(unit_hits(typed, index), list(UNIT)).select("query_id", "id")
    allowed = allowed_ids(index, types)
    return found if allowed is None else found.join(allowed, "id", "left_semi")


_QUERY = ("query_id", "tokens", "locative", "bare_numeric", "number_tokens", "typing_locative", "detail", "normalized")


def _fulltext_pass(queries: DataFrame, index: Index, types: list[str] | None, debug: bool = False, gates: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Scored documents of both exact gates. A document in both has the better score of the two, the full-text one, since
    the name gate gives no full-text score; so the gates are united before they are scored."""
    full = fulltext_gate(queries if gates is None else gates, index, types)
    by_name = name_prefix_gate(queries if named is None else named, index, types).withColumn("ft_score", F.lit(0.0))
    pairs = full.unionByName(by_name).groupBy("query_id", "id").agg(F.max("ft_score").alias("ft_score"))
    more = ["target"] if "target" in queries.columns else []
    return additive_score(pairs.join(document_side(index.docs), "id").join(query_side(queries.select(*_QUERY, *more)), "query_id"), debug)


def suggest_fulltext(queries: DataFrame, index: Index, limit: int = 10, types: list[str] | None = None, fuzzy: bool = True, tier_sort: bool = True, debug: bool = False) -> DataFrame:
    """The additive-score method: exact passes; without numbers where these found nothing; misspelt names where there is room."""
    queries = stored(queries, "queries")
    exact = stored(_fulltext_pass(queries, index, types, debug).withColumn("pass", F.lit("exact")), "exact")
    unanswered = queries.filter("size(number_tokens) > 0 and not bare_numeric").join(exact.select("query_id").distinct(), "query_id", "left_anti")
    fewer = stored(unanswered.withColumn("locative", without_numbers(F.col("locative"))), "queries")
    found = exact
    if not fewer.isEmpty():
        found = exact.unionByName(stored(_fulltext_pass(fewer, index, types, debug).withColumn("pass", F.lit("no_number")), "no-number"))
    if fuzzy:
        counts = found.groupBy("query_id").agg(F.sum(copies_of(found)).alias("n"), F.max(F.array_contains("number_tokens", F.col("house_number"))).alias("exact_number"))
        short = queries.join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < limit).filter(~F.coalesce("exact_number", F.lit(False))).drop("n", "exact_number")
        more = fuzzy_pass(stored(short, "queries"), index, types, debug).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        found = found.unionByName(more.withColumn("pass", F.lit("fuzzy")))
    return top_k(found.withColumn("score", F.round("score", PLACES)), limit, tier_sort)


def relax(queries: DataFrame) -> DataFrame:
    """The queries that have a ``target`` (the longest name-like token of over three letters, the last of equals) and its head, ``relaxed``."""
    return with_relaxed(queries).filter("target is not null")


def with_relaxed(queries: DataFrame) -> DataFrame:
    long = F.filter("locative", lambda t: (F.length(t) > LEAST_FULLTEXT) & ~X.is_numeric(t))
    ranked = F.transform(long, lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t")))
    q = queries.withColumn("target", F.array_max(ranked)["t"])
    return q.withColumn("relaxed", F.left("target", F.greatest(F.lit(LEAST_FULLTEXT), F.floor(F.length("target") / 2).cast("int"))))


def fuzzy_pass(queries: DataFrame, index: Index, types: list[str] | None, debug: bool = False) -> DataFrame:
    """Documents for the relaxed queries whose name lies within the allowed distance of the target; penalised by distance."""
    q = relax(queries)
    # the original tokens score; the relaxed ones gate
    gates = q.withColumn("locative", F.concat(F.filter("locative", lambda t: t != F.col("target")), F.array("relaxed")))
    rows = _fulltext_pass(q, index, types, debug, gates, q.withColumn("locative", F.array("relaxed")))
    similar = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance") / F.length("target"))
    rows = rows.withColumn("distance", X.name_distance(F.col("target"), F.col("primary_name_norm")))
    return rows.filter(F.col("distance") <= X.max_distance(F.col("target"))).withColumn("score", F.col("score") * similar - FUZZY_PENALTY).drop("distance", "target")


# ------------------------------------------------------------------ clause methods

# Boosts of the scoring clauses.
EXACT_NAME, NAME_PHRASE, NAME_WORDS, POSTCODE_EXACT, POSTCODE_PARTIAL = 12.0, 8.0, 3.0, 6.0, 3.0
MUNICIPALITY, POST_NAME, DETAIL, ALIAS, FUZZY = 1.5, 1.2, 4.0, 1.8, 0.4
# Terms that a misspelt token, and a phrase's last word, expand to at most.
FUZZY_EXPANSIONS, PHRASE_EXPANSIONS = 30, 20


@dataclasses.dataclass(frozen=True)
class Method:
    """How a clause method reads its fields. ``grams``: prefixes are terms of a field like others, scored by their rarity,
    and misspellings are sought among them; otherwise a typed prefix counts its boost once. ``norms``: the haystack's
    length counts. ``shingled``: runs of two and three words score beside the words."""

    label: str
    grams: bool = False
    norms: bool = False
    shingled: bool = False


METHODS = {
    "edge_ngram": Method("edge n-grams of every word", grams=True),
    "prefixes": Method("words with a prefix index", norms=True),
    "sayt": Method("search as you type: words and their runs", norms=True, shingled=True),
    "bool_prefix": Method("words, the last one a prefix"),
}

_CLAUSE = "array<struct<clause:string,field:string,open:boolean,text:string,boost:double,norms:boolean,flat:boolean>>"


def _clauses(name: str, field: str, tokens: Column, boost: float, opened: bool = False, norms: bool = False, flat: bool = False) -> Column:
    """Clauses for the distinct ``tokens``: BM25 of what they meet in ``field``, or its boost once where ``flat``."""
    one = lambda t: F.struct(F.lit(name).alias("clause"), F.lit(field).alias("field"), F.lit(opened).alias("open"), t.alias("text"), F.lit(boost).alias("boost"), F.lit(norms).alias("norms"), F.lit(flat).alias("flat"))
    return F.transform(F.array_distinct(tokens), one).cast(_CLAUSE)


def _last(tokens: Column) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens), F.lit(1)), F.lit(1))


def _but_last(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def _bool_prefix(name: str, field: str, tokens: Column, boost: float, norms: bool) -> list[Column]:
    """All tokens but the last as words, the last one as a prefix."""
    return [_clauses(name, field, _but_last(tokens), boost, norms=norms), _clauses(name, field, _last(tokens), boost, opened=True, norms=norms, flat=True)]


def clauses(queries: DataFrame, method: str) -> DataFrame:
    """``query_id, clause, field, open, text, boost, norms, flat``: what scores the gated documents of each query, but
    for the phrase and the misspelt words."""
    m, tokens = METHODS[method], F.col("tokens")
    prefix = F.when(F.col("prefix").isNotNull(), F.array("prefix")).otherwise(F.array().cast("array<string>"))
    made = [
        _clauses("gate", "search_text", F.col("needed"), 1.0, norms=m.norms),
        _clauses("gate", "search_text", prefix, 1.0, opened=True, flat=not m.grams),
        _clauses("exact_name", "name", F.filter(F.array("normalized"), lambda t: t != ""), EXACT_NAME),
        _clauses("postcode", "postcode", F.filter(tokens, X.is_postcode), POSTCODE_EXACT),
        _clauses("postcode", "postcode", F.filter(F.array("last_token"), lambda t: F.col("bare_numeric") & t.rlike("^[1-9][0-9]{0,2}$")), POSTCODE_PARTIAL, opened=True),
        _clauses("municipality", "municipality_name", tokens, MUNICIPALITY, norms=True),
        _clauses("post_name", "post_name", tokens, POST_NAME, norms=True),
        _clauses("detail", "search_text", F.filter(F.concat("detail", "number_tokens"), lambda t: ~X.is_box_marker(t) & (t != "b")), DETAIL),
        _clauses("alias", "aliases", tokens, ALIAS, opened=True),
    ]
    if m.grams:
        made.append(_clauses("name", "primary_name", tokens, NAME_WORDS, opened=True))
    else:
        made += _bool_prefix("name", "primary_name", tokens, NAME_WORDS, True)
    if m.shingled:
        for field, (_, size) in SHINGLES.items():
            if field.startswith("primary_name"):
                made += _bool_prefix("name", field, shingles(tokens, size), NAME_WORDS, True)
            else:  # counts only where every run is met, as a gate over the field alone would have it
                runs = F.when(F.col("prefix").isNotNull(), shingles(F.col("gated"), size)).otherwise(F.array().cast("array<string>"))
                made += _bool_prefix(f"gate {field}", field, runs, 1.0, True)
    return queries.select("query_id", F.explode(F.concat(*made)).alias("c")).select("query_id", "c.*")


def near_texts(tokens: DataFrame, index: Index, method: str) -> DataFrame:
    """``token, field, open, text, distance``: the words of the haystack (their heads, where these are terms) within each
    token's edits; the closest FUZZY_EXPANSIONS, then in order of the alphabet."""
    grams = METHODS[method].grams
    near = fuzzy_terms(tokens, index.neighbours("grams" if grams else "words"))
    few = near.withColumn("n", F.row_number().over(W.partitionBy("token").orderBy("distance", "term"))).filter(F.col("n") <= FUZZY_EXPANSIONS)
    return few.select("token", F.lit("search_text").alias("field"), F.lit(grams).alias("open"), F.col("term").alias("text"), "distance")


def _weight() -> Column:
    """What a misspelling's share of edited characters leaves of it."""
    return F.lit(1.0) - F.col("distance") / F.length("token")


def fuzzy_clauses(tokens: DataFrame, near: DataFrame, method: str, boost: float) -> DataFrame:
    rows = tokens.join(near, "token")
    return rows.select("query_id", F.lit("fuzzy").alias("clause"), *UNIT, (F.lit(boost) * _weight()).alias("boost"), F.lit(METHODS[method].norms).alias("norms"), F.lit(False).alias("flat"))


def phrase_scores(queries: DataFrame, pairs: DataFrame, index: Index) -> DataFrame:
    """``query_id, id, clause, part``: the name holds the tokens in order, the last one as the start of a word.

    BM25 with the phrase's frequency; its rarity is that of all words before the last and of the first
    PHRASE_EXPANSIONS words that the last one opens.
    """
    name = F.col("field") == "primary_name"
    asked = queries.filter("size(tokens) > 0").select("query_id", "normalized", _but_last(F.col("tokens")).alias("words"), F.element_at("tokens", -1).alias("token"))
    stats = index.fields.filter(name).select("docs", "avgdl")
    terms = index.terms.filter(name).select("term", "df")
    whole = asked.select("query_id", F.posexplode("words").alias("k", "term")).join(terms, "term").select("query_id", "df")
    lasts = asked.select(F.lit("primary_name").alias("field"), F.lit(True).alias("open"), F.col("token").alias("text")).distinct()
    # places follow the alphabet, so the first terms of an interval are the first in it
    few = unit_ranges(lasts, index).select(F.col("text").alias("token"), F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + (PHRASE_EXPANSIONS - 1)))).alias("pos"))
    opened = few.join(index.terms.select("pos", "df"), "pos").select("token", "df")
    rare = whole.unionByName(asked.select("query_id", "token").join(opened, "token").select("query_id", "df"))
    rarity = rare.crossJoin(F.broadcast(stats)).groupBy("query_id").agg(F.sum(idf(F.col("docs"), F.col("df"))).alias("rarity"))
    named = pairs.join(index.docs.select("id", "primary_name_norm"), "id").join(asked.select("query_id", "normalized"), "query_id")
    held, phrase = F.concat(F.lit(" "), "primary_name_norm"), F.concat(F.lit(" "), "normalized")
    met = named.filter(F.contains(held, phrase)).withColumn("tf", (F.length(held) - F.length(F.replace(held, phrase, F.lit("")))) / F.length(phrase))
    scored = met.join(rarity, "query_id").crossJoin(F.broadcast(stats))
    part = bm25(NAME_PHRASE, F.col("rarity"), F.col("tf"), length_norm(F.size(X.words(F.col("primary_name_norm"))), F.col("avgdl")))
    return scored.select("query_id", "id", F.lit("phrase").alias("clause"), part.alias("part"))


@dataclasses.dataclass
class Batch:
    """A batch of queries with everything a clause method has looked up for it."""

    queries: DataFrame
    index: Index
    method: str
    hits: DataFrame
    clauses: DataFrame
    near: DataFrame | None

    @classmethod
    def of(cls, queries: DataFrame, index: Index, method: str, fuzzy: bool) -> Batch:
        """``queries`` carry ``pass`` and the gate's columns of that pass; one lookup serves all passes."""
        asked = stored(clauses(queries, method), "clauses")
        near = None
        if fuzzy:
            tokens = queries.select(F.explode("tokens").alias("token"))
            near = stored(near_texts(tokens, index, method), "near")
            asked = asked.unionByName(fuzzy_clauses(queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")), near, method, FUZZY))
        units = asked.select(*UNIT).unionByName(word_slots(_reduced(queries)).select(*UNIT))
        return cls(queries, index, method, stored(unit_hits(units, index), "hits"), asked, near)

    def scores(self, queries: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """``query_id, id, clause, part``. Every gated pair asks for its query's clauses, so nothing outside is scored."""
        stats = self.index.fields.join(unit_df(self.hits), "field")
        rows = pairs.join(asked.join(stats, list(UNIT)), "query_id").join(self.hits, [*UNIT, "id"])
        norm = F.when(F.col("norms"), length_norm(F.col("dl"), F.col("avgdl"))).otherwise(1.0)
        part = F.when(F.col("flat"), F.col("boost")).otherwise(bm25(F.col("boost"), idf(F.col("docs"), F.col("df")), F.col("tf"), norm))
        rows = rows.select("query_id", "id", "clause", part.alias("part"))
        if METHODS[self.method].shingled:
            whole = F.startswith("clause", F.lit("gate "))
            asked_n = asked.filter(whole).groupBy("query_id", "clause").agg(F.count(F.lit(1)).alias("asked"))
            runs = rows.filter(whole).groupBy("query_id", "id", "clause").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("met"))
            runs = runs.join(asked_n, ["query_id", "clause"]).filter("met = asked").select("query_id", "id", F.lit("gate").alias("clause"), "part")
            rows = rows.filter(~whole).unionByName(runs)
        return rows.unionByName(phrase_scores(queries, pairs, self.index))


def _reduced(queries: DataFrame) -> DataFrame:
    """The queries of the second pass: their gate without the numbers."""
    fewer = queries.filter("size(number_tokens) > 0 and not bare_numeric").withColumn("fewer", without_numbers(F.col("locative")))
    return with_gate(fewer, "fewer").drop("fewer")


def clause_scores(queries: DataFrame, pairs: DataFrame, index: Index, method: str, fuzzy: bool = True) -> DataFrame:
    """``query_id, id, relevance``: the sum of all clauses for gated ``pairs`` of the strict pass."""
    batch = Batch.of(queries, index, method, fuzzy)
    return batch.scores(queries, batch.clauses, pairs).groupBy("query_id", "id").agg(F.sum("part").alias("relevance"))


def fuzzy_gate(queries: DataFrame, index: Index, near: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Documents that hold, for every token that is no number, a text within the token's edits."""
    tokens = queries.select("query_id", F.explode(F.array_distinct(without_numbers(F.col("locative")))).alias("token")).distinct()
    hits = unit_hits(near, index)
    by_token = near.join(hits, list(UNIT)).select(F.lit("").alias("field"), F.lit(False).alias("open"), F.col("token").alias("text"), "id", "copies").distinct()
    slots = tokens.select("query_id", F.lit("").alias("field"), F.lit(False).alias("open"), F.col("token").alias("text"))
    return meet(slots, by_token, allowed_ids(index, types))


def suggest_clauses(queries: DataFrame, index: Index, method: str, limit: int = 10, types: list[str] | None = None, fuzzy: bool = True, tier_sort: bool = True, explain: bool = False) -> DataFrame:
    """A clause-scored method: strict; for queries without any hit, numbers left out; for those still without, misspellings.

    With ``explain``, ``parts`` maps each clause to what it gave.
    """
    q = stored(queries, "queries")
    batch, allowed = Batch.of(q, index, method, fuzzy), allowed_ids(index, types)
    pairs = [("strict", stored(meet(word_slots(q), batch.hits, allowed), "pairs"))]
    left = stored(q.join(pairs[0][1].select("query_id").distinct(), "query_id", "left_anti"), "queries")
    asked, reread = batch.clauses, q
    if not left.isEmpty():
        fewer = _reduced(left)
        pairs.append(("no_number", stored(meet(word_slots(fewer), batch.hits, allowed), "pairs")))
        answered = pairs[1][1].select("query_id").distinct()
        again = stored(clauses(fewer.join(answered, "query_id", "left_semi"), method).filter("clause like 'gate%'"), "clauses")
        # a query's gate scores as it stands in the pass that answers it
        asked = asked.join(left.select("query_id"), "query_id", "left_anti").unionByName(asked.join(left.select("query_id"), "query_id", "left_semi").filter("not clause like 'gate%'")).unionByName(again)
        if fuzzy:
            rest = stored(left.join(answered, "query_id", "left_anti"), "queries")
            near = batch.near
            pairs.append(("fuzzy", stored(fuzzy_gate(rest, index, near, types), "pairs")))
            tokens = rest.select("query_id", F.explode(F.array_distinct(without_numbers(F.col("locative")))).alias("token"))
            asked = asked.join(rest.select("query_id"), "query_id", "left_anti").unionByName(asked.join(rest.select("query_id"), "query_id", "left_semi").filter("clause <> 'fuzzy'")).unionByName(fuzzy_clauses(tokens, near, method, 1.0))
    every = None
    for name, p in pairs:
        p = p.withColumn("pass", F.lit(name))
        every = p if every is None else every.unionByName(p)
    parts = batch.scores(reread, stored(asked, "clauses"), every.select("query_id", "id"))
    parts = parts.groupBy("query_id", "id", "clause").agg(F.sum("part").alias("part"))
    more = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("clause", "part")))).alias("parts")] if explain else []
    relevance = parts.groupBy("query_id", "id").agg(F.sum("part").alias("relevance"), *more)
    rows = every.join(relevance, ["query_id", "id"]).join(index.docs, "id")
    return top_k(rows.withColumn("score", F.round(F.col("relevance") * popularity_factor(), PLACES)), limit, tier_sort)


# ------------------------------------------------------------------ completion


def suggest_completion(queries: DataFrame, index: Index, limit: int = 10, types: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Documents one of whose inputs starts with the joined tokens, heaviest input first.

    Short texts find the heaviest entries stored beside their heads; longer ones the inputs that share a stem with them.

    With ``fuzzy``, a text of three characters or more also meets inputs one of whose heads lies within its edits and
    shares its first character; an input then weighs as many times as it has leading characters in common with the text.
    The ``limit`` heaviest inputs are taken before a document's further inputs are dropped, so fewer may be returned.
    """
    typed = queries.select("query_id", F.array_join("locative", " ").alias("joined")).filter("joined <> ''")
    texts = typed.select(F.col("joined").alias("token")).distinct()
    factor = common_head(F.col("joined"), F.col("input")) if fuzzy else F.lit(1)
    chosen = F.col("doc_type").isin(*types) if types else F.lit(True)
    # up to SHORT_HEAD - 2 characters: no near head is longer than what the heaviest entries are stored for
    short = F.length("token") <= SHORT_HEAD - 2
    near = (fuzzy_terms(texts.filter(short), index.neighbours("heads")) if fuzzy else texts.filter(short).withColumn("term", F.col("token"))).select(F.col("token").alias("joined"), F.col("term").alias("head"))
    if limit <= HEAVIEST:
        # under a near head all inputs share as much with the text, or more and then a longer near head has them too
        few = near.join(index.heaviest().filter(chosen), "head").select("joined", "input", "weight", "id").distinct()
    else:
        few = near.join(index.head_inputs(), "head").select("joined", "input").distinct().join(index.entries.filter(chosen), "input").select("joined", "input", "weight", "id")
    inputs = long_inputs(texts.filter(~short), index, fuzzy)
    many = inputs.join(index.entries.filter(chosen), "input").select("joined", "input", "weight", "id")
    options = typed.join(few.unionByName(many), "joined").withColumn("score", (F.col("weight") * factor).cast("double"))
    best = options.withColumn("option", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"), F.asc("input")))).filter(F.col("option") <= limit)
    once = best.groupBy("query_id", "id").agg(F.min("option").alias("option"), F.max("score").alias("score"))
    once = once.join(index.docs, "id")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("option")))


def long_inputs(texts: DataFrame, index: Index, fuzzy: bool) -> DataFrame:
    """``joined, input``: for texts (``token``) of about a stem's length and more, the inputs with a head within their edits."""
    near = index.neighbours("inputs")
    if not fuzzy:
        met = texts.withColumn("stem", stem(F.col("token"))).join(near.members, "stem").filter(F.startswith("term", "token"))
        return met.select(F.col("token").alias("joined"), F.col("term").alias("input"))
    met = near.near_stems(texts).join(near.members, "stem").filter(F.col("size") >= F.length("token") - F.col("edits"))
    sizes = F.sequence(F.length("token") - F.col("edits"), F.least(F.length("token") + F.col("edits"), F.col("size")))
    head = F.transform(sizes, lambda n: F.left("term", n))
    close = F.exists(head, lambda h: (F.levenshtein(F.col("token"), h) <= 2 * F.col("edits")) & (swap_distance(F.col("token"), h) <= F.col("edits")))
    return met.filter(close).select(F.col("token").alias("joined"), F.col("term").alias("input"))


def common_head(a: Column, b: Column) -> Column:
    """How many leading characters two texts share."""
    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.when(F.left(a, i) == F.left(b, i), i).otherwise(0))), F.lit(0))


# ------------------------------------------------------------------ answers


def totals(candidates: DataFrame, most: int = MOST_TOTAL) -> DataFrame:
    """``query_id, total, relation``: how many candidates, counted up to ``most``."""
    n = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("query_id", F.least("n", F.lit(most)).alias("total"), F.when(F.col("n") > most, "gte").otherwise("eq").alias("relation"))


#: The registry of methods, in order; the first one selected is the baseline of comparisons.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "fulltext": suggest_fulltext,
    **{m: (lambda q, i, _m=m, **k: suggest_clauses(q, i, _m, **k)) for m in METHODS},
    "completion": suggest_completion,
}
#: What a method is called, and the group it is compared in.
LABELS = {"fulltext": ("additive score over full text", "fulltext"), **{k: (m.label, "clauses") for k, m in METHODS.items()}, "completion": ("completion of whole inputs", "completion")}


def choose_methods(names: str | None) -> list[str]:
    """Registry order; a group's name stands for its methods; unknown or no names mean all."""
    wanted = {n.strip() for n in (names or "").split(",")}
    return [m for m in REGISTRY if m in wanted or LABELS[m][1] in wanted] or list(REGISTRY)


def response(hits: DataFrame, *more: str) -> DataFrame:
    """A hit's outward shape as JSON: scores to four places, coordinates only where both are known. Columns in ``more`` stay."""
    coordinates: Column = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    known = F.when(F.col("doc_type").isin(*TYPES), F.col("doc_type")).otherwise(F.raise_error(F.concat(F.lit("unknown document type "), "doc_type")).cast("string"))
    body = F.struct("id", known.alias("type"), "label", "place_name", "street_name", "house_number", "postcode", "post_name", "municipality_name", "nis_code", coordinates.alias("coordinates"), F.round("score", 4).alias("score"), "popularity")
    return hits.select("query_id", "rank", F.to_json(body).alias("suggestion"), *more)
