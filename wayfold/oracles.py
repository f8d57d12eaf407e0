"""DuckDB equivalents of the registered queries, composed from a few shared pieces of SQL."""

from __future__ import annotations

from wayfold.functions.text import BOX_MARKERS, FOLD_FROM, FOLD_PAIRS, FOLD_TO, PARTICLES
from wayfold.operators import ranking as R
from wayfold.operators import retrieval as M
from wayfold.plans.index import SHINGLES
from wayfold.schema import TYPES


def norm(x: str) -> str:
    y = f"lower({x})"
    for one, two in FOLD_PAIRS:
        y = f"replace({y}, '{one}', '{two}')"
    return f"trim(regexp_replace(translate({y}, '{FOLD_FROM}', '{FOLD_TO}'), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(str_split({norm(x)}, ' '), lambda w: w <> '')"


def ordered_distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda t, i: list_position({xs}, t) = i)"


def titled(x: str) -> str:
    particles = ", ".join(f"'{p}'" for p in PARTICLES)
    bits = rf"regexp_extract_all(lower({x}), '([\s\-'']|[^\s\-'']+)')"
    bit = rf"case when i > 1 and regexp_full_match(({bits})[i - 1], '[\s\-]') and regexp_extract(w, '^(\p{{L}}+)', 1) in ({particles}) then w else upper(substr(w, 1, 1)) || substr(w, 2) end"
    return f"case when {x} = '' or {x} <> upper({x}) then {x} else array_to_string(list_transform({bits}, lambda w, i: {bit}), '') end"


def swapped(x: str) -> str:
    return f"list_transform(range(1, length({x})), lambda i: substr({x}, 1, cast(i - 1 as int)) || substr({x}, cast(i + 1 as int), 1) || substr({x}, cast(i as int), 1) || substr({x}, cast(i + 2 as int)))"


def osa(a: str, b: str) -> str:
    """Edit distance with exchanges of neighbours, up to two."""
    once = f"1 + list_min(list_transform({swapped(a)}, lambda s: levenshtein(s, {b})))"
    return f"least(levenshtein({a}, {b}), coalesce({once}, 99), case when list_has_any({swapped(a)}, {swapped(b)}) then 2 else 99 end)"


#: A score to six places, as it orders, and then to four.
FOUR = "cast(round(cast(score as decimal(30, 6)), 4) as double)"
#: Edits that a token's length allows.
EDITS = "case when length({0}) < 3 then 0 when length({0}) <= 5 then 1 else 2 end"

POSTCODE = "regexp_full_match({0}, '[1-9][0-9]{{3}}')"
NUMERIC = "regexp_full_match({0}, '[0-9]+[a-z]{{0,3}}')"
HOUSE = "(regexp_full_match({0}, '[0-9]{{1,4}}[a-z]{{0,3}}') and not " + POSTCODE + ")"
BOX = "{0} in (" + ", ".join(f"'{b}'" for b in BOX_MARKERS) + ")"
TIER = "case doc_type " + " ".join(f"when '{k}' then {t}" for k, (t, _, _) in TYPES.items()) + " end"

REG = f"""
reg as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, p_name as street, c_nationkey as nis, n_name, r_name,
    50 + l_discount as lat, 3 + l_tax as lon, cast(cast(l_quantity as int) as varchar) as house_number,
    case when l_linenumber > 4 then cast(l_linenumber as varchar) end as box_number,
    cast(1000 + c_nationkey * 100 + c_custkey % 2 as varchar) as postcode, c_custkey % 2 = 1 as odd
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
nat as (select n_nationkey, {titled("n_name")} as m, {titled("r_name")} as r from nation join region on n_regionkey = r_regionkey),
cur as (select * from reg join nat on nis = n_nationkey where l_linestatus = 'O'),
"""

_SEARCH = "coalesce(street_name, '') || ' ' || coalesce(house_number, '') || ' ' || coalesce(postcode, '') || ' ' || coalesce(post_name, '') || ' ' || municipality_name || ' ' || replace(aliases, '|', ' ')"


def _docs(families: str) -> str:
    parts = {
        "s": """select 'street:' || street || '|' || postcode as id, 'street' as doc_type, street || ', ' || postcode || ' ' || m as label, street as street_name,
      cast(null as varchar) as house_number, cast(null as varchar) as box_number, postcode, m as post_name, m as municipality_name, cast(nis as varchar) as nis_code, avg(lat) as lat, avg(lon) as lon, count(*) as popularity,
      case when odd then m || '|' || r else m end as aliases from cur group by street, postcode, m, nis, odd, r""",
        "m": """select 'municipality:' || nis, 'municipality', m, null, null, null, null, null, m, cast(nis as varchar), avg(lat), avg(lon), count(*), '' from cur group by nis, m""",
        "p": """select 'postcode:' || postcode, 'postcode', postcode || ' ' || m, null, null, null, postcode, m, m, cast(nis as varchar), avg(lat), avg(lon), count(*), case when odd then m || '|' || r else m end
      from cur group by postcode, m, nis, odd, r""",
        "a": """select 'address:' || r_name || ':' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, 'address' as doc_type,
      street || ' ' || house_number || coalesce(' bus ' || box_number, '') || ', ' || postcode || ' ' || m as label, street as street_name, house_number, box_number, postcode, m as post_name, m as municipality_name,
      cast(nis as varchar) as nis_code, lat, lon, count(*) over (partition by street, postcode) as popularity, case when odd then m || '|' || r else m end as aliases from cur""",
    }
    body = " union all ".join(parts[f] for f in families)
    return f"""{REG} base as ({body}),
toks as (select *, {tokens(_SEARCH)} as tk from base),
docs as (select id, doc_type, label, cast(null as varchar) as place_name, street_name, house_number, box_number, postcode, post_name, municipality_name, nis_code,
  array_to_string({ordered_distinct("tk")}, ' ') as search_text,
  coalesce(street_name, case when doc_type = 'postcode' then postcode else municipality_name end) as primary_name,
  {norm("coalesce(street_name, case when doc_type = 'postcode' then postcode else municipality_name end)")} as primary_name_norm,
  round(lat, 6) as lat, round(lon, 6) as lon, cast(popularity as bigint) as popularity, aliases, cast({TIER} as bigint) as rank_tier from toks)
"""


CORPUS = _docs("smp")

_TOGETHER = """
occurs as (select p_name, c_nationkey as k, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey group by all),
together as (
  select p_name, n_nationkey, n_name from (
    select p_name, k from (select *, row_number() over (partition by p_name order by n desc, k) as r from occurs) where r = 1
    union select p_name, k from (select *, row_number() over (partition by k order by n desc, p_name) as r from occurs) where r = 1) join nation on k = n_nationkey),
"""

_TYPED = """three as (select distinct p_name, n_nationkey, n_name from part join nation on n_nationkey < 3),
typed as (
  select distinct query from (
    select p_name as query from part union all select substr(p_name, 1, length(p_name) - 2) from part
    union all select substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) from part
    union all select n_name from nation union all select cast(1000 + n_nationkey * 100 as varchar) from nation
    union all select substr(cast(1000 + n_nationkey * 100 as varchar), 1, 2) from nation
    union all select p_name || ' 12 bus 5 ' || n_name from (from together union from three)
    union all select cast(1000 + n_nationkey * 100 as varchar) || ' ' || substr(p_name, 1, length(p_name) - 2) from (from together union from three)))
"""

_NUMBERED = """typed as (
  select distinct p_name || ' ' || (1 + n_nationkey % 50) || ' ' || n_name as query from together
  union select p_name || ' 77 ' || n_name from together
  union select substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) || ' 88b ' || n_name from together
  union select p_name || ' ' || (1 + n_nationkey % 50) || ' bus 5 ' || n_name from together)
"""


def _parsed(typed: str, house: str) -> str:
    """CTEs up to ``q``, the parsed queries of ``typed``; ``house`` says which tokens are detail as house numbers."""
    return f"""{_TOGETHER.strip()} {typed.strip()},
split as (select query, {tokens("query")} as tk from typed),
walk as (
  select query, 1 as i, tk[1] as token, {house.format("tk[1]")} or {BOX.format("tk[1]")} as flag from split where len(tk) > 0
  union all
  select w.query, w.i + 1, s.tk[w.i + 1], {house.format("s.tk[w.i + 1]")} or {BOX.format("s.tk[w.i + 1]")}
    or (s.tk[w.i + 1] = 'b' and (w.flag or {HOUSE.format("w.token")})) or (w.flag and ({BOX.format("w.token")} or w.token = 'b'))
  from walk w join split s on w.query = s.query where w.i < len(s.tk)),
flagged as (select query, i, token, flag and not all_flags as flag from walk join (select query as q2, bool_and(flag) as all_flags from walk group by query) on query = q2),
parsed0 as (
  select query, list(token order by i) as tokens, coalesce(list(token order by i) filter (where not flag), []) as locative, coalesce(list(token order by i) filter (where flag), []) as detail,
    bool_and({NUMERIC.format("token")}) as bare_numeric, arg_max(flag, i) as last_flag, arg_max(token, i) as last_token from flagged group by query),
parsed as (select *, not last_flag and (bare_numeric or not {NUMERIC.format("last_token")}) as typing_locative from parsed0),
q as (select *, query as query_id, case when typing_locative then locative[1:len(locative) - 1] else locative end as needed0, case when typing_locative then locative[len(locative)] end as prefix from parsed)
"""


QUERIES = _parsed(_TYPED, HOUSE)


def _with(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ", ".join(p.strip().rstrip(",") for p in parts)


_BOTH = _with(CORPUS, QUERIES, recursive=True)
#: Numbered queries against all documents, addresses too, so house numbers are no detail.
_ADDRESSES = _with(_docs("smpa"), _parsed(_NUMBERED, "false"), recursive=True)

_FIELDS = {
    "search_text": "search_text",
    "primary_name": "primary_name_norm",
    "aliases": norm("replace(aliases, '|', ' ')"),
    "municipality_name": norm("municipality_name"),
    "post_name": norm("coalesce(post_name, '')"),
    "postcode": "coalesce(postcode, '')",
}


def _postings(*names: str) -> str:
    each = " union all ".join(f"select '{k}' as field, id, list_filter(str_split({v}, ' '), lambda w: w <> '') as tk from docs" for k, v in _FIELDS.items() if not names or k in names)
    return f"fielded as ({each}), posted as (select field, term, id, count(*) as tf, max(dl) as dl from (select field, id, len(tk) as dl, unnest(tk) as term from fielded) group by field, term, id)"


_ONLY = "search_text"
_VOCAB = f"{_postings(_ONLY)}, vocab as (select term, count(*) as df from posted group by term), sized as (select count(distinct id) as docs from posted)"

_FULLTEXT = f"""
{_VOCAB},
slots as (select query_id, bare_numeric, len(list_distinct(locative)) as asked, unnest(list_distinct(locative)) as token from q),
ft as (
  select query_id, id, sum(case when length(token) >= 3 then pow(log10(docs / df), 2) * tf else 0 end) as ft_score, count(distinct token) as met, max(asked) as asked
  from slots join vocab on case when not bare_numeric and {NUMERIC.format("token")} then term = token else starts_with(term, token) end join posted using (term) cross join sized group by query_id, id),
full_gate as (select query_id, id, ft_score from ft where met = asked),
name_gate as (select query_id, id from q join docs on starts_with(primary_name_norm, array_to_string(locative, ' ')) where doc_type <> 'address' and len(locative) > 0)
"""


def _type_case(weights: dict[str, float]) -> str:
    return "case doc_type " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " end"


_PARTS = {
    "fulltext": f"least(ft_score, {R.FULLTEXT_CAP})",
    "hit_query_prefix": f"case when starts_with(primary_name_norm, joined) then {R.W_QUERY_PREFIX} else 0.0 end",
    "hit_exact_name": f"case when primary_name_norm = joined then {R.W_EXACT_NAME} else 0.0 end",
    "hit_last_token": f"case when len(locative) > 1 and starts_with(primary_name_norm, locative[len(locative)]) then {R.W_LAST_TOKEN} else 0.0 end",
    "hit_first_token": f"case when len(locative) > 1 and starts_with(primary_name_norm, locative[1]) then {R.W_FIRST_TOKEN} else 0.0 end",
    "hit_word_prefix": f"case when contains(primary_name_norm, ' ' || locative[len(locative)]) then {R.W_WORD_PREFIX} else 0.0 end",
    "hit_context": f"len(list_filter(locative, lambda t: not regexp_full_match(t, '[0-9]+') and (starts_with(mn, t) or starts_with(pn, t)))) * {R.W_CONTEXT}",
    "hit_postcode": f"case when postcode = list_filter(tokens, lambda t: {POSTCODE.format('t')})[1] then {R.W_POSTCODE} else 0.0 end",
    "hit_house_number": f"case when house_number = hn or (house_number is null and list_contains(str_split(search_text, ' '), hn)) then {R.W_HOUSE_NUMBER} else 0.0 end",
    "type_weight": f"case when hn is not null then {_type_case(R.TYPE_WEIGHTS[True])} else {_type_case(R.TYPE_WEIGHTS[False])} end",
    "popularity": f"log10(10 + popularity) * {R.W_POPULARITY}",
}


def _scored(gate: str, q: str = "q") -> str:
    return f"""(select query_id, id, rank_tier, popularity as pop, {", ".join(f"{v} as {k}" for k, v in _PARTS.items() if k != "popularity")}, {_PARTS["popularity"]} as popularity from (
    select *, array_to_string(locative, ' ') as joined, {norm("municipality_name")} as mn, {norm("coalesce(post_name, '')")} as pn, list_filter(tokens, lambda t: {HOUSE.format("t")})[1] as hn from {gate} join docs using (id) join {q} using (query_id)))"""


_SUM = " + ".join(_PARTS)
_FACTOR = f"least({R.MAX_BOOST}, log10(1.0 + 0.5 * popularity) * case doc_type {' '.join(f'when {k!r} then {w}' for k, (_, w, _) in TYPES.items())} end)"


def _passes(name: str, gates: str, named: str, scored: str) -> str:
    """CTE ``name``: the scored documents of both gates. ``gates`` and ``named`` hold the locative that gates and the one
    that names must start with, ``scored`` the queries as they score."""
    return f"""
{name}_slots as (select query_id, bare_numeric, len(list_distinct(locative)) as asked, unnest(list_distinct(locative)) as token from {gates}),
{name}_ft as (
  select query_id, id, sum(case when length(token) >= 3 then pow(log10(docs / df), 2) * tf else 0 end) as ft_score, count(distinct token) as met, max(asked) as asked
  from {name}_slots join vocab on case when not bare_numeric and {NUMERIC.format("token")} then term = token else starts_with(term, token) end join posted using (term) cross join sized group by query_id, id),
{name}_named as (select query_id, id from {named} join docs on starts_with(primary_name_norm, array_to_string(locative, ' ')) where doc_type <> 'address' and len(locative) > 0),
{name}_pairs as (select query_id, id, max(ft_score) as ft_score from (select query_id, id, ft_score from {name}_ft where met = asked union all select query_id, id, 0.0 from {name}_named) group by 1, 2),
{name} as (select query_id, id, rank_tier, pop, {_SUM} as score from {_scored(f"{name}_pairs", scored)})"""


_NUMBERS = f"list_distinct(list_filter(tokens, lambda t: {NUMERIC.format('t')} and not {POSTCODE.format('t')}))"
_UNNUMBERED = f"case when len(list_filter(locative, lambda t: not {NUMERIC.format('t')})) = 0 then locative else list_filter(locative, lambda t: not {NUMERIC.format('t')}) end"
_NAME_DISTANCE = "list_min(list_transform(list_filter(str_split(primary_name_norm, ' '), lambda w: w <> ''), lambda w: levenshtein(target, substr(w, 1, length(target)))))"
_ADDITIVE_STEPS = f""", {_VOCAB},
{_passes("exact", "q", "q", "q")},
qn as (select * replace ({_UNNUMBERED} as locative) from q where len({_NUMBERS}) > 0 and not bare_numeric and query_id not in (select query_id from exact)),
{_passes("fewer", "qn", "qn", "qn")},
found as (select *, 'exact' as pass from exact union all select *, 'no_number' from fewer),
counted as (select query_id, count(*) as n, bool_or(list_contains({_NUMBERS}, house_number)) as exact_number from found join docs using (id) join q using (query_id) group by 1),
cand as (select query_id, list_filter(locative, lambda t: length(t) > 3 and not {NUMERIC.format('t')}) as l from q left join counted using (query_id) where coalesce(n, 0) < 10 and not coalesce(exact_number, false)),
tgt as (select query_id, (select arg_max(t, length(t) * 1000 + i) from (select unnest(l) as t, generate_subscripts(l, 1) as i)) as target from cand where len(l) > 0),
rel as (select *, substr(target, 1, cast(greatest(3, floor(length(target) / 2)) as int)) as relaxed from tgt),
qg as (select * exclude (target, relaxed) replace (list_filter(locative, lambda t: t <> target) || [relaxed] as locative) from q join rel using (query_id)),
qr as (select * exclude (target, relaxed) replace ([relaxed] as locative) from q join rel using (query_id)),
{_passes("loose", "qg", "qr", "q")},
measured as (select l.*, {_NAME_DISTANCE} as distance, target from loose l join rel using (query_id) join docs using (id) where (query_id, id) not in (select query_id, id from found)),
closest as (select query_id, id, l.rank_tier, pop, score * greatest(0.0, 1.0 - distance / length(target)) - {R.FUZZY_PENALTY} as score, 'fuzzy' as pass from measured l
  where distance <= case when length(target) <= 5 then 1 when length(target) <= 9 then 2 else 3 end),
ranked as (select *, row_number() over (partition by query_id order by rank_tier, round(score, 6) desc, pop desc, id) as rank from (select * from found union all select * from closest))
"""
_ADDITIVE = _BOTH + _ADDITIVE_STEPS


def _runs(tk: str, size: int) -> str:
    return f"list_transform(range(1, len({tk}) - {size} + 2), lambda i: array_to_string({tk}[cast(i as int):cast(i + {size - 1} as int)], ' '))"


def _clause_sql(method: str, both: str = _BOTH) -> str:
    """CTEs up to ``ranked`` (query_id, id, pass, score, rank) of a clause method."""
    m = M.METHODS[method]
    words = lambda v: f"list_filter(str_split({v}, ' '), lambda w: w <> '')"
    fields = {k: words(v) for k, v in _FIELDS.items()} | {"name": "case when length(primary_name_norm) between 1 and 256 then [primary_name_norm] else [] end"}
    if m.shingled:
        fields |= {k: _runs(words(_FIELDS[f]), n) for k, (f, n) in SHINGLES.items()}
    fielded = " union all ".join(f"select '{k}' as field, id, {v} as tk from docs" for k, v in fields.items())

    def req(clause: str, field: str, texts: str, boost: float, opened: bool = False, norms: bool = False, flat: bool = False, where: str = "true") -> str:
        return f"select query_id, '{clause}' as clause, '{field}' as field, {opened} as open, unnest(list_distinct({texts})) as text, cast({boost} as double) as boost, {norms} as norms, {flat} as flat from qa where {where}"

    def bool_prefix(clause: str, field: str, tk: str, boost: float, where: str = "true") -> list[str]:
        return [req(clause, field, f"({tk})[1:len({tk}) - 1]", boost, norms=True, where=f"{where} and len({tk}) > 1"), req(clause, field, f"[({tk})[len({tk})]]", boost, opened=True, flat=True, where=f"{where} and len({tk}) > 0")]

    reqs = [
        req("gate", "search_text", "needed0", 1.0, norms=m.norms),
        req("gate", "search_text", "[prefix]", 1.0, opened=True, flat=not m.grams, where="prefix is not null"),
        req("exact_name", "name", "[array_to_string(tokens, ' ')]", M.EXACT_NAME),
        req("postcode", "postcode", f"list_filter(tokens, lambda t: {POSTCODE.format('t')})", M.POSTCODE_EXACT),
        req("postcode", "postcode", "[last_token]", M.POSTCODE_PARTIAL, opened=True, where="bare_numeric and regexp_full_match(last_token, '[1-9][0-9]{0,2}')"),
        req("municipality", "municipality_name", "tokens", M.MUNICIPALITY, norms=True),
        req("post_name", "post_name", "tokens", M.POST_NAME, norms=True),
        req("detail", "search_text", f"list_filter(detail || {_NUMBERS}, lambda t: not {BOX.format('t')} and t <> 'b')", M.DETAIL),
        req("alias", "aliases", "tokens", M.ALIAS, opened=True),
    ]
    reqs += [req("name", "primary_name", "tokens", M.NAME_WORDS, opened=True)] if m.grams else bool_prefix("name", "primary_name", "tokens", M.NAME_WORDS)
    if m.shingled:
        for field, (_, size) in SHINGLES.items():
            if field.startswith("primary_name"):
                reqs += bool_prefix("name", field, _runs("tokens", size), M.NAME_WORDS)
            else:
                reqs += bool_prefix(f"gate {field}", field, _runs("gated", size), 1.0, "prefix is not null")
    vocabulary = "select distinct term from posted where field = 'search_text'"
    if m.grams:
        vocabulary += " union select substr(term, 1, cast(n as int)) from (select distinct term from posted where field = 'search_text') join (select unnest(range(1, 21)) as n) on n <= length(term)"
    near_req = f"select query_id, 'fuzzy', 'search_text', {m.grams}, text, boost * (1.0 - distance / length(token)), {m.norms}, false"
    norm = f"case when norms then {1 - R.B} + {R.B} * dl / avgdl else 1.0 end"
    idf = "ln(1 + (docs - df + 0.5) / (df + 0.5))"
    return both + f""",
fielded as ({fielded}),
posted as (select field, term, id, count(*) as tf, max(dl) as dl from (select field, id, len(tk) as dl, unnest(tk) as term from fielded) group by all),
vocab as (select field, term, count(*) as df from posted group by all),
fstats as (select field, count(*) as docs, avg(dl) as avgdl from (select field, id, max(dl) as dl from posted group by all) group by field),
qs as (select *, 'strict' as pass, locative as gated from q),
qf as (select * exclude (fewer) replace (case when typing_locative then fewer[1:len(fewer) - 1] else fewer end as needed0, case when typing_locative then fewer[len(fewer)] end as prefix), 'no_number' as pass, fewer as gated
  from (select *, {_UNNUMBERED} as fewer from q where len({_NUMBERS}) > 0 and not bare_numeric)),
both_q as (select * from qs union all by name select * from qf),
gslots as (select distinct query_id, pass, unnest(needed0) as token, false as open from both_q union select query_id, pass, prefix, true from both_q where prefix is not null),
gasked as (select query_id, pass, count(*) as asked from gslots group by all),
gmet as (select query_id, pass, id from (select query_id, pass, id, count(distinct token || case when open then '*' else '' end) as met from gslots join (select * from vocab where field = 'search_text') on case when open then starts_with(term, token) else term = token end
  join (select term, id from posted where field = 'search_text') using (term) group by all) join gasked using (query_id, pass) where met = asked),
strict as (select query_id, pass, id from gmet where pass = 'strict'),
fewer as (select query_id, pass, id from gmet where pass = 'no_number' and query_id not in (select query_id from strict)),
left_q as (select *, 'fuzzy' as pass, {_UNNUMBERED} as named from q where query_id not in (select query_id from strict) and query_id not in (select query_id from fewer)),
vocabulary as ({vocabulary}),
near as (select token, text, distance from (select *, row_number() over (partition by token order by distance, text) as n from (
  select token, term as text, {osa("token", "term")} as distance from (select distinct unnest(tokens) as token from q) join vocabulary on substr(token, 1, 1) = substr(term, 1, 1) and abs(length(token) - length(term)) <= 2 and levenshtein(token, term) <= 4)
  where distance <= {EDITS.format("token")}) where n <= {M.FUZZY_EXPANSIONS}),
ntokens as (select distinct query_id, unnest(named) as token from left_q),
nhits as (select distinct token, id from near join (select term, id from posted where field = 'search_text') on {"starts_with(term, text)" if m.grams else "term = text"}),
loose as (select query_id, 'fuzzy' as pass, id from ntokens join nhits using (token) group by query_id, id having count(*) = (select count(*) from ntokens x where x.query_id = ntokens.query_id)),
pairs as (select * from strict union all select * from fewer union all select * from loose),
qa as (select * from both_q semi join pairs using (query_id, pass) union all by name select * exclude (named) replace ([] as needed0, cast(null as varchar) as prefix), [] as gated from left_q),
reqs as ({" union all ".join(reqs)}
  union all {near_req} from (select query_id, unnest(list_distinct(tokens)) as token, {M.FUZZY} as boost from qa where pass <> 'fuzzy') join near using (token)
  union all {near_req} from (select query_id, token, 1.0 as boost from ntokens) join near using (token)),
units as (select distinct field, open, text from reqs),
uhits as (select u.field, open, text, id, sum(tf) as tf, max(dl) as dl from units u join vocab v on u.field = v.field and case when open then starts_with(term, text) else term = text end join posted p on p.field = v.field and p.term = v.term group by all),
udf as (select field, open, text, count(*) as df from uhits group by all),
parts as (select query_id, p.id, clause, case when flat then boost else boost * {R.K1 + 1} * {idf} * tf / (tf + {R.K1} * {norm}) end as part
  from pairs p join reqs r using (query_id) join uhits h on h.field = r.field and h.open = r.open and h.text = r.text and h.id = p.id join udf d on d.field = r.field and d.open = r.open and d.text = r.text join fstats f on f.field = r.field),
runs as (select query_id, id, sum(part) as part from parts where starts_with(clause, 'gate ') group by query_id, id, clause having count(*) = (select count(*) from reqs x where x.query_id = parts.query_id and x.clause = parts.clause)),
opened as (select token, df from (select token, df, row_number() over (partition by token order by term) as n from (select distinct tokens[len(tokens)] as token from q) join (select * from vocab where field = 'primary_name') on starts_with(term, token)) where n <= {M.PHRASE_EXPANSIONS}),
rare as (select query_id, df from (select query_id, unnest(tokens[1:len(tokens) - 1]) as term from q) join (select * from vocab where field = 'primary_name') using (term) union all select query_id, df from q join opened on token = tokens[len(tokens)]),
rarity as (select query_id, sum({idf}) as rarity from rare cross join (select docs from fstats where field = 'primary_name') group by 1),
phrases as (select query_id, id, {M.NAME_PHRASE} * {R.K1 + 1} * rarity * tf / (tf + {R.K1} * ({1 - R.B} + {R.B} * len(str_split(primary_name_norm, ' ')) / avgdl)) as part
  from (select query_id, p.id, primary_name_norm, (length(' ' || primary_name_norm) - length(replace(' ' || primary_name_norm, ' ' || array_to_string(tokens, ' '), ''))) / length(' ' || array_to_string(tokens, ' ')) as tf
    from pairs p join docs using (id) join q using (query_id) where contains(' ' || primary_name_norm, ' ' || array_to_string(tokens, ' ')))
  join rarity using (query_id) cross join (select avgdl from fstats where field = 'primary_name')),
relevance as (select query_id, id, sum(part) as relevance from (select query_id, id, part from parts where not starts_with(clause, 'gate ') union all select * from runs union all select * from phrases) group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by rank_tier, round(score, 6) desc, popularity desc, id) as rank from (select query_id, id, pass, rank_tier, popularity, relevance * {_FACTOR} as score from pairs join relevance using (query_id, id) join docs using (id)))
"""


_FLAT = "select id, doc_type, label, place_name, street_name, house_number, box_number, postcode, post_name, municipality_name, nis_code, search_text, primary_name, primary_name_norm, lat, lon, popularity, aliases, rank_tier from docs"

def _first(langs: str, one: str) -> str:
    """The first result of ``one`` (over the language ``l``) for the preferred languages, then the members in order."""
    return f"list_filter(list_transform(['nl', 'fr', 'de', 'en'] || {langs}, lambda l: {one}), lambda v: coalesce(v, '') <> '')[1]"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_OBJECT = "json_type({0}) = 'OBJECT'"
_MEMBERS = "case when " + _OBJECT + " then json_keys({0}) else []::varchar[] end"
#: The rows as they are put in, as text, and then what a JSON reader finds in them.
_PLACES = f"""put as (
  select c_custkey as k, c_name, case when c_custkey % 19 = 0 then ' ' else cast(c_custkey as varchar) end as ident,
    case when c_custkey % 23 = 0 then '{{"nl":5,"de":null,"fr":"L''Été ' || c_name || '"}}' when c_custkey % 37 = 0 then '["x"]' when c_custkey % 11 = 0 then '{{}}'
      when c_custkey % 3 = 0 then '{{"fr":"' || c_name || '","nl":"' || c_mktsegment || '  Hall"}}' else '{{"en":"' || c_name || '"}}' end as name,
    '{{"addressCountry":"' || case when c_custkey % 7 = 0 then 'FR' else 'BE' end || '","addressLocality":"' || case when c_custkey % 5 = 0 then 'Old ' || n_name || ' (' || n_name || ')' else n_name end
      || '","postalCode":"' || case when c_custkey % 13 = 0 then '59000' else cast(1000 + c_nationkey * 100 as varchar) end
      || '","streetAddress":"' || case when c_custkey % 4 = 0 then '-' when c_custkey % 4 = 1 then n_name else c_mktsegment || ' street ' || cast(c_custkey % 50 as varchar) end || '"}}' as inside
  from customer join nation on c_nationkey = n_nationkey),
laid as (select *, case when k % 41 = 0 then '[' || inside || ']' when k % 31 = 0 then '{{"nl":[],"de":null,"pt":' || inside || ',"xx":{{}}}}' when k % 29 = 0 then '{{"nl":"-","fr":' || inside || '}}'
  when k % 17 = 0 then '[]' else '{{"nl":' || inside || '}}' end as address from put),
keyed as (select *, {_MEMBERS.format("name")} as nl, {_MEMBERS.format("address")} as al from laid),
spoken as (select *, list_filter(list_transform(nl, lambda l: case when json_type(name, '$.' || l) = 'VARCHAR' then {_collapsed("json_extract_string(name, '$.' || l)")} end), lambda v: coalesce(v, '') <> '') as said,
  coalesce({_first("nl", "case when json_type(name, '$.' || l) = 'VARCHAR' then " + _collapsed("json_extract_string(name, '$.' || l)") + " end")}, '') as nm,
  {_first("al", "case when json_type(address, '$.' || l) = 'OBJECT' then json_extract_string(address, '$.' || l) end")} as found from keyed),
parsed as (select *, coalesce(json_extract_string(found, '$.addressCountry'), '') as land, {_collapsed("coalesce(json_extract_string(found, '$.addressLocality'), '')")} as whole,
  {_collapsed("coalesce(json_extract_string(found, '$.postalCode'), '')")} as pc, {_collapsed("coalesce(json_extract_string(found, '$.streetAddress'), '')")} as st from spoken),
places as (select *, case when trim(ident) = '' then 'unparseable' when found is null then 'no address' when land <> 'BE' then 'not in belgium' when not regexp_full_match(pc, '[1-9][0-9]{{3}}') then 'unusable postcode'
    when nm = '' then 'no name' end as reason, regexp_extract(whole, '^(.+?)\\s*\\((.+)\\)$', 1) as post, case when regexp_matches(whole, '^(.+?)\\s*\\((.+)\\)$') then regexp_extract(whole, '^(.+?)\\s*\\((.+)\\)$', 2) else whole end as muni,
  case when post = '' then muni else post end as loc,
  {norm("st")} as fst, ' ' || {norm("nm")} || ' ' as fnm from parsed)"""


def _in_name(phrase: str) -> str:
    return f"contains(fnm, ' ' || {norm(phrase)} || ' ')"


_ECHOES = ", ".join(norm(e) for e in ("loc", "muni", "pc", "pc || ' ' || loc", "pc || ' ' || muni", "loc || ' ' || pc", "loc || ' ' || muni"))

_HITS = """hits as (
  select engine, query, id, 'Value ' || id as label, rank from (
    select engine, query, id, row_number() over (partition by engine, query order by n desc, id) as rank from (
      select event_type as engine, cast(user_id as varchar) as query, cast(cast(floor(value) as bigint) as varchar) as id, count(*) as n from events group by 1, 2, 3)) where rank <= 10)"""

_PAIRS = f"""{_HITS},
base as (select query, id, rank as rb from hits where engine = 'click'), oth as (select * from hits where engine <> 'click'),
bq as (select e.engine, b.query, b.n_b, b.top_b from (select distinct engine from oth) e cross join (select query, count(*) as n_b, arg_min(id, rb) as top_b from base group by query) b),
oq as (select engine, query, count(*) as n_e, arg_min(id, rank) as top_e from oth group by engine, query),
sh as (select engine, query, row_number() over (partition by engine, query order by rank) - row_number() over (partition by engine, query order by rb) as d from oth join base using (query, id)),
shn as (select engine, query, count(*) as overlap, sum(d * d) as d2 from sh group by engine, query),
pairs as (
  select engine, query, coalesce(overlap, 0) as overlap, coalesce(overlap, 0) / cast(coalesce(n_e, 0) + coalesce(n_b, 0) - coalesce(overlap, 0) as double) as jaccard,
    case when overlap >= 2 then 1 - 6 * d2 / cast(overlap * (overlap * overlap - 1) as double) end as spearman, coalesce(top_e = top_b, false) as same_top
  from bq full join oq using (engine, query) left join shn using (engine, query))"""

_STATS = "count(value) as n, min(value) as min_ms, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99, max(value) as max_ms, avg(value) as mean_ms, coalesce(stddev_samp(value), 0) as stddev_ms"
_ROUNDED = ", ".join(f"round({c}, 4) as {c}" for c in ("min_ms", "p50", "p90", "p95", "p99", "max_ms", "mean_ms", "stddev_ms"))
_DECIMAL = ", ".join(f"cast(round(cast({c} as decimal(30, 8)), 4) as double) as {c}" for c in ("min_ms", "p50", "p90", "p95", "p99", "max_ms", "mean_ms", "stddev_ms"))
_GOLD = f"""{_HITS},
gold as (select cast(user_id as varchar) as query, arg_min(cast(cast(floor(value) as bigint) as varchar), event_id) as v from events group by 1),
ranks as (select e.engine, g.query, (select min(rank) from hits h where h.engine = e.engine and h.query = g.query and contains(lower(h.label), 'value ' || g.v)) as rank from gold g cross join (select distinct engine from hits) e),
golden as (select engine, count(*) as entries, count(*) filter (where rank <= 1) as hit_1, count(*) filter (where rank <= 3) as hit_3, count(*) filter (where rank <= 10) as hit_10, avg(coalesce(1.0 / rank, 0)) as mrr from ranks group by engine)"""

ORACLES: dict[str, str] = {
    "normalize_text": f"select doc_id, {norm('text')} as norm from documents",
    "tokenize_distinct": f"select token, count(*) as n from (select unnest({tokens('text')}) as token from documents) group by token",
    "haystack": f"select p_partkey, array_to_string({ordered_distinct('tk')}, ' ') as haystack from (select p_partkey, {tokens(chr(39).join(['p_name || ', ' ', ' || p_brand || ', ' ', ' || p_type || ', ' ', ' || p_name']))} as tk from part)",
    "classify_tokens": f"select token, {POSTCODE.format('token')} as postcode, {NUMERIC.format('token')} as numeric, {HOUSE.format('token')} as house_number, {BOX.format('token')} as box_marker from (select distinct unnest({tokens('text')}) as token from documents)",
    "title_case": f"select c_custkey, {titled('shout')} as titled, {titled('c_name')} as untouched from (select *, upper(c_name || '-le-' || c_mktsegment || '-van der aa') as shout from customer)",
    "name_distances": f"""with n as (select distinct p_name as name from part), t as (select distinct substr({norm('name')}, 1, cast(4 + length(name) % 8 as int)) as token from n)
select token, name, cast(list_min(list_transform({tokens('name')}, lambda w: levenshtein(token, substr(w, 1, length(token))))) as bigint) as distance, cast(case when length(token) <= 5 then 1 when length(token) <= 9 then 2 else 3 end as bigint) as allowed from t join n on substr(token, 1, 1) = substr(name, 1, 1) or right(token, 1) = right(name, 1)""",
    "register_filter": _with(REG) + " select r_name as region_code, postcode, count(*) as usable from cur group by 1, 2",
    "street_documents": _with(_docs("s")) + _FLAT,
    "municipality_documents": _with(CORPUS) + _FLAT + " where doc_type = 'municipality'",
    "postcode_documents": _with(CORPUS) + _FLAT + " where doc_type = 'postcode'",
    "address_documents_with_popularity": _with(_docs("a")) + _FLAT,
    "grouping_sets_aggregate": _with(REG) + """ select case when g = 1 then 'street' when g = 6 then 'municipality' else 'postcode' end as level, k_street, k_postcode, k_nis, popularity, lat, lon from (
  select street as k_street, postcode as k_postcode, cast(nis as varchar) as k_nis, grouping_id(street, postcode, nis) as g, count(*) as popularity, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon
  from cur group by grouping sets ((street, postcode), (nis), (postcode)))""",
    "place_reject_reasons": _with(_PLACES) + " select reason as reject_reason, count(*) as rows from places where reason is not null group by 1",
    "place_documents": _with(_PLACES) + f""", shown as (select *, fst <> '' and fst not in ({_ECHOES}) and not {_in_name('st')} as ss,
  not {_in_name("pc || ' ' || loc")} or (muni <> '' and {norm('loc')} <> {norm('muni')} and not {_in_name('muni')}) as sl from places where reason is null)
select 'place:' || k as id, case when not ss and not sl then nm when not sl then nm || ' (' || st || ')' else nm || ' (' || case when ss then st || ', ' else '' end || pc || ' ' || loc
    || case when lower(loc) <> lower(muni) then ' (' || muni || ')' else '' end || ')' end as label,
  nm as place_name, nullif(st, '') as street_name, pc as postcode, nullif(post, '') as post_name, muni as municipality_name,
  array_to_string(list_filter(list_filter(said, lambda a: a <> nm) || [post, muni], lambda a: a <> ''), '|') as aliases from shown""",
    "json_name_pick": _with(_PLACES) + " select ident as place_cdbid, name, nm as picked from places",
    "locality_split": "select n_name as locality, '' as post_name, n_name as municipality from nation union all select 'Old  ' || n_name || ' (' || n_name || ')', 'Old  ' || n_name, n_name from nation",
    "query_parse": _with(QUERIES, recursive=True) + f""" select query, array_to_string(tokens, ' ') as tokens, array_to_string(locative, ' ') as locative, array_to_string(detail, ' ') as detail,
  array_to_string({ordered_distinct(f"list_filter(tokens, lambda t: {NUMERIC.format('t')} and not {POSTCODE.format('t')})")}, ' ') as number_tokens,
  array_to_string({ordered_distinct('needed0')}, ' ') as needed, bare_numeric, typing_locative, prefix from q""",
    "postings": _with(CORPUS, _postings()) + " select field, term, id, tf, cast(dl as bigint) as dl from posted",
    "term_stats": _with(CORPUS, _postings()) + " select field, term, count(*) as df from posted group by 1, 2",
    "field_stats": _with(CORPUS, _postings()) + " select field, count(*) as docs, round(avg(dl), 6) as avgdl from (select field, id, max(dl) as dl from posted group by 1, 2) group by field",
    "edge_ngrams": _with(CORPUS, _postings("search_text")) + " select substr(term, 1, cast(n as int)) as gram, term from (select distinct term from posted) join (select unnest(range(1, 21)) as n) on n <= length(term)",
    "shingles": _with(CORPUS) + """, st as (select id, str_split(search_text, ' ') as tk from docs), sn as (select unnest([2, 3]) as size)
select distinct cast(size as bigint) as size, array_to_string(tk[cast(i as int):cast(i + size - 1 as int)], ' ') as shingle, id from st cross join sn join (select unnest(range(1, 60)) as i) on i + size - 1 <= len(tk)""",
    "completion_inputs": _with(CORPUS) + f""" select distinct doc_type, input, weight, id from (select doc_type, substr({norm('raw')}, 1, 50) as input, greatest(1, least(popularity, 1000000)) as weight, id
  from (select *, unnest(list_distinct(list_filter([primary_name] || str_split(aliases, '|'), lambda a: a <> ''))) as raw from docs)) where input <> ''""",
    "gate_fulltext": _BOTH + ", " + _FULLTEXT + " select query_id, id, round(ft_score, 4) as ft_score from full_gate",
    "gate_name_prefix": _BOTH + ", " + _FULLTEXT + " select query_id, id from name_gate",
    "gate_words": _BOTH + f""", {_VOCAB}, slots as (select query_id, unnest(list_distinct(needed0)) as token, false as open from q union all select query_id, prefix, true from q where prefix is not null),
asked as (select query_id, count(*) as asked from slots group by 1)
select query_id, id from (select query_id, id, count(distinct token || case when open then '*' else '' end) as met from slots join vocab on case when open then starts_with(term, token) else term = token end join posted using (term) group by 1, 2) join asked using (query_id) where met = asked""",
    "bm25_scores": _BOTH + f""", {_VOCAB}, fs as (select avg(dl) as avgdl from (select id, max(dl) as dl from posted group by id)),
slots as (select query_id, unnest(list_distinct(tokens)) as term from q)
select query_id, id, round(sum({R.K1 + 1} * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + {R.K1} * ({1 - R.B} + {R.B} * dl / avgdl))), 4) as score from slots join vocab using (term) join posted using (term) cross join sized cross join fs group by 1, 2""",
    "score_parts": _BOTH + ", " + _FULLTEXT + f", zero as (select *, 0.0 as ft_score from name_gate) select query_id, id, round({_SUM}, 4) as score, {', '.join(f'round({k}, 4) as {k}' for k in _PARTS)} from {_scored('zero')}",
    "suggest_fulltext_exact": _BOTH + ", " + _FULLTEXT + f""", zero as (select *, 0.0 as ft_score from name_gate),
both_passes as (select *, {_SUM} as score from {_scored('full_gate')} union all select *, {_SUM} as score from {_scored('zero')}),
best as (select query_id, id, max(score) as score, any_value(rank_tier) as rank_tier, any_value(pop) as pop from both_passes group by 1, 2)
select query_id, rank, id, {FOUR} as score from (select *, row_number() over (partition by query_id order by rank_tier, round(score, 6) desc, pop desc, id) as rank from best) where rank <= 10""",
    "fuzzy_relaxed": _with(QUERIES, recursive=True) + f""", cand as (select query_id, list_filter(locative, lambda t: length(t) > 3 and not {NUMERIC.format('t')}) as l from q), tgt as (select query_id, (select arg_max(t, length(t) * 1000 + i) from (select unnest(l) as t, generate_subscripts(l, 1) as i)) as target from cand where len(l) > 0)
select query_id, target, substr(target, 1, cast(greatest(3, floor(length(target) / 2)) as int)) as relaxed, cast(case when length(target) <= 5 then 1 when length(target) <= 9 then 2 else 3 end as bigint) as allowed from tgt""",
    "fuzzy_vocabulary": _BOTH + f""", {_VOCAB}, tk as (select distinct unnest(tokens) as token from q)
select token, term, cast(distance as bigint) as distance from (select token, term, {osa("token", "term")} as distance from tk join vocab on substr(token, 1, 1) = substr(term, 1, 1))
where distance <= {EDITS.format("token")}""",
    "candidate_merge": f"""with {_HITS}, h as (select query as query_id, id, 100 - rank as score, case engine when 'click' then 0 else 1 end as pass_no from hits where engine in ('click', 'error'))
select query_id, id, score, cast(pass_no as bigint) as pass_no from (select *, row_number() over (partition by query_id, id order by score desc, pass_no) as n from h) where n = 1""",
    "function_score": _with(CORPUS) + f" select id, round({_FACTOR}, 6) as factor from docs",
    "tier_topk": _with(CORPUS) + " select query_id, rank, id from (select municipality_name as query_id, id, row_number() over (partition by municipality_name order by rank_tier, length(label) desc, popularity desc, id) as rank from docs) where rank <= 10",
    "suggest_completion": _BOTH + f""", entries as (select distinct input, weight, id from (select substr({norm('raw')}, 1, 50) as input, greatest(1, least(popularity, 1000000)) as weight, id
    from (select *, unnest(list_distinct(list_filter([primary_name] || str_split(aliases, '|'), lambda a: a <> ''))) as raw from docs)) where input <> ''),
said as (select query_id, array_to_string(locative, ' ') as joined from q where len(locative) > 0),
heads as (select distinct input, substr(input, 1, cast(n as int)) as head from (select distinct input from entries) join (select unnest(range(1, 51)) as n) on n <= length(input)),
near as (select joined, head from (select distinct joined from said) join (select distinct head from heads) on substr(joined, 1, 1) = substr(head, 1, 1) and abs(length(joined) - length(head)) <= 2 and levenshtein(joined, head) <= 4
  where {osa("joined", "head")} <= {EDITS.format("joined")}),
found as (select distinct joined, input from near join heads using (head)),
shared as (select *, list_max(list_transform(range(1, length(joined) + 1), lambda i: case when substr(joined, 1, cast(i as int)) = substr(input, 1, cast(i as int)) then i else 0 end)) as common from found),
options as (select query_id, id, weight * common as weight, row_number() over (partition by query_id order by weight * common desc, id, input) as option from said join shared using (joined) join entries using (input))
select query_id, row_number() over (partition by query_id order by option) as rank, id, cast(score as double) as score from (select query_id, id, min(option) as option, max(weight) as score from options where option <= 10 group by 1, 2)""",
    "collapse_whitespace": r"""select doc_id, trim(regexp_replace(text, '[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(11)) as collapsed from documents""",
    "gate_totals": _BOTH + f""", {_VOCAB}, slots as (select query_id, unnest(list_distinct(needed0)) as token, false as open from q union all select query_id, prefix, true from q where prefix is not null),
asked as (select query_id, count(*) as asked from slots group by 1),
met as (select query_id, id from (select query_id, id, count(distinct token || case when open then '*' else '' end) as met from slots join vocab on case when open then starts_with(term, token) else term = token end join posted using (term) group by 1, 2) join asked using (query_id) where met = asked)
select query_id, least(count(*), 1000) as total, case when count(*) > 1000 then 'gte' else 'eq' end as relation from met group by 1""",
    "upsert_merge": _with(REG) + " select 'address:' || r_name || ':' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, case when cast(house_number as int) % 2 = 0 then house_number || 'b' else house_number end as value from cur",
    "suggest_fulltext": _ADDITIVE + f" select query_id, rank, id, {FOUR} as score, pass from ranked where rank <= 10",
    "suggestion_json": _ADDITIVE + f""" select query_id, id, doc_type as type, label, street_name, postcode, post_name, municipality_name, nis_code, lat, lon, {FOUR} as score, popularity from ranked join docs using (id) where rank = 1""",
    **{f"suggest_{m}": _clause_sql(m) + f" select query_id, rank, id, {FOUR} as score, pass from ranked where rank <= 10" for m in ("edge_ngram", "prefixes", "sayt", "bool_prefix")},
    "number_ladder_fulltext": _ADDRESSES + _ADDITIVE_STEPS + f" select query_id, rank, id, {FOUR} as score, pass from ranked where rank <= 10",
    "number_ladder_clauses": _clause_sql("bool_prefix", _ADDRESSES) + f" select query_id, rank, id, {FOUR} as score, pass from ranked where rank <= 10",
    "recovery_ladder": _clause_sql("bool_prefix") + " select query_id, max(pass) as pass, count(*) as hits from ranked where rank <= 10 group by 1",
    "latency_summary": f"select engine, n, {_ROUNDED} from (select event_type as engine, {_STATS} from events group by 1)",
    "latency_by_query": f"select engine, query, n, {_DECIMAL} from (select event_type as engine, cast(user_id as varchar) as query, {_STATS} from events group by 1, 2)",
    "latency_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type as engine, count(*) as n, round(avg(value), 4) as mean_ms, max(value) as max_ms from events group by 1, 2",
    "rolling_median": "select event_type as engine, event_id as iter, round(quantile_cont(value, 0.5) over (partition by event_type order by event_id rows between 19 preceding and current row), 4) as rolling_ms from events",
    "spearman": f"with {_PAIRS} select engine, query, overlap, round(jaccard, 6) as jaccard, round(spearman, 6) as spearman, same_top from pairs",
    "agreement_report": f"with {_PAIRS} select engine, count(*) as comparable, round(avg(overlap), 6) as mean_overlap, round(avg(jaccard), 6) as mean_jaccard, round(avg(spearman), 6) as mean_spearman, count(*) filter (where same_top) as identical_top from pairs group by engine",
    "worst_disagreements": f"with {_PAIRS} select engine, query, overlap from pairs order by overlap, engine, query limit 20",
    "golden_report": f"with {_GOLD} select engine, entries, hit_1, hit_3, hit_10, round(mrr, 6) as mrr from golden",
    "verdict": f"""with {_GOLD}, lat as (select event_type as engine, {_STATS} from events group by 1)
select (select engine from lat order by p50, engine limit 1) as fastest, (select engine from lat order by p50 desc, engine desc limit 1) as slowest, round(max(p50) / min(p50), 2) as p50_factor,
  round((select p95 from lat order by p50 desc, engine desc limit 1) / (select p95 from lat order by p50, engine limit 1), 2) as p95_factor,
  (select case when count(*) = 1 then max(engine) end from golden where hit_10 = (select max(hit_10) from golden)) as most_relevant from lat""",
    "rank_comparison": f"with {_HITS} select query, id, l.rank as rank_left, r.rank as rank_right, l.rank - r.rank as delta from (select * from hits where engine = 'click') l full join (select * from hits where engine = 'view') r using (query, id)",
    "benchmark_long": """with s as (select event_type as engine, count(*) as n, min(value) as lo, max(value) as hi from events group by 1)
select 'latency_overall' as section, engine, '' as query, metric, value from (select engine, 'n' as metric, cast(n as double) as value from s union all select engine, 'min_ms', lo from s union all select engine, 'max_ms', hi from s)""",
    "type_reset": _with(CORPUS) + " select doc_type, count(*) as documents from docs where doc_type <> 'street' group by 1",
    "import_summary": _with(_docs("smpa")) + " select doc_type, count(*) as documents from docs group by 1",
}
# however an index came about, it answers as one of all documents does
ORACLES |= {f"updated_{q}": ORACLES[q] for q in ("term_stats", "field_stats", "suggest_fulltext", "suggest_bool_prefix")} | {"compacted_suggest_completion": ORACLES["suggest_completion"]}
