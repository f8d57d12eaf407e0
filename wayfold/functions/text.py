"""Text functions as column expressions: folding, tokens, name formatting. All stay inside codegen; there are no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and what they fold to (one to one), in alphabetical order of the result.
FOLD_FROM = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłñńňòóôõöøōřśšşťţùúûüūůýÿźżž"
FOLD_TO = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnooooooorsssttuuuuuuyyzzz"
# Letters that fold to two.
FOLD_PAIRS = (("æ", "ae"), ("œ", "oe"), ("ß", "ss"))
# Particles that stay lower-case inside a name.
PARTICLES = ("de", "den", "der", "het", "ten", "ter", "van", "op", "aan", "bij", "sur", "les", "le", "la", "aux", "au", "sous")
# Words that announce a box number.
BOX_MARKERS = ("bus", "bte", "boite")
# What an ASCII trim strips.
ASCII_WHITE = " \t\n\r\0\x0b"

POSTCODE = "^[1-9][0-9]{3}$"
NUMERIC = "^[0-9]+[a-z]{0,3}$"
HOUSE_NUMBER = "^[0-9]{1,4}[a-z]{0,3}$"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_WHITE))


def normalize(c: Column) -> Column:
    """Lower case, diacritics folded, every other run of characters one space."""
    x = F.lower(trimmed(c))
    for one, two in FOLD_PAIRS:
        x = F.replace(x, F.lit(one), F.lit(two))
    return F.trim(F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), "[^a-z0-9]+", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def tokenize(c: Column) -> Column:
    return words(normalize(F.coalesce(c, F.lit(""))))


def haystack(*parts: Column) -> Column:
    """The distinct tokens of all parts in order of first appearance, space-separated; null parts are skipped."""
    return F.array_join(F.array_distinct(tokenize(F.concat_ws(" ", *parts))), " ")


def is_postcode(t: Column) -> Column:
    return t.rlike(POSTCODE)


def is_numeric(t: Column) -> Column:
    return t.rlike(NUMERIC)


def is_house_number(t: Column) -> Column:
    return t.rlike(HOUSE_NUMBER) & ~t.rlike(POSTCODE)


def is_box_marker(t: Column) -> Column:
    return t.isin(*BOX_MARKERS)


def title_case(c: Column) -> Column:
    """An all-capitals name with capitals at word starts only, particles inside it lower-case; any other name as it is."""
    bits = F.regexp_extract_all(F.lower(c), F.lit(r"([\s\-']|[^\s\-']+)"), F.lit(0))

    def bit(w: Column, i: Column) -> Column:
        after_gap = (i > 0) & F.coalesce(F.try_element_at(bits, i).rlike(r"^[\s\-]$"), F.lit(False))
        particle = F.regexp_extract(w, r"^(\p{L}+)", 1).isin(*PARTICLES)
        return F.when(after_gap & particle, w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))

    return F.when((c == "") | (c != F.upper(c)), c).otherwise(F.array_join(F.transform(bits, bit), ""))


def post_name_parts(c: Column) -> Column:
    """The sub-localities of a slash-separated post name: trimmed, title-cased, distinct."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "/"), lambda p: title_case(trimmed(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def display_post_name(parts: Column, municipality: Column) -> Column:
    return F.when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(title_case(municipality))


def address_line(street: Column, postcode: Column, post_name: Column, municipality: Column) -> Column:
    locality = F.when(post_name == "", municipality).otherwise(post_name)
    head = F.when(street != "", F.concat(street, F.lit(", "))).otherwise("")
    tail = F.when((municipality != "") & (F.lower(locality) != F.lower(municipality)), F.concat(F.lit(" ("), municipality, F.lit(")"))).otherwise("")
    return F.concat(head, trimmed(F.concat(postcode, F.lit(" "), locality)), tail)


def carries(name: Column, phrase: Column) -> Column:
    """Whether the folded name holds the folded phrase at word boundaries."""
    pad = lambda c: F.concat(F.lit(" "), normalize(c), F.lit(" "))
    return (normalize(phrase) != "") & F.contains(pad(name), pad(phrase))


def street_adds(name: Column, street: Column, postcode: Column, locality: Column, municipality: Column) -> Column:
    """Whether a street line says more than the locality (in any of seven spellings) and the name do."""
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    echoes = (locality, municipality, postcode, pair(postcode, locality), pair(postcode, municipality), pair(locality, postcode), pair(locality, municipality))
    folded = normalize(street)
    return (folded != "") & ~F.array_contains(F.array(*map(normalize, echoes)), folded) & ~carries(name, street)


def locality_adds(name: Column, postcode: Column, locality: Column, municipality: Column) -> Column:
    apart = (municipality != "") & (normalize(locality) != normalize(municipality))
    return ~carries(name, F.concat(postcode, F.lit(" "), locality)) | (apart & ~carries(name, municipality))


def place_label(name: Column, street: Column, postcode: Column, post_name: Column, municipality: Column) -> Column:
    """A venue's name, with what its address adds to it in brackets."""
    locality = F.when(post_name == "", municipality).otherwise(post_name)
    show_street = street_adds(name, street, postcode, locality, municipality)
    show_locality = locality_adds(name, postcode, locality, municipality)
    line = F.when(show_locality, address_line(F.when(show_street, street).otherwise(""), postcode, post_name, municipality)).otherwise(street)
    return F.when(show_street | show_locality, F.concat(name, F.lit(" ("), line, F.lit(")"))).otherwise(name)


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space, the Unicode kinds too, as one space."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def pick_name(*names: Column) -> Column:
    """The first name that is not empty; empty where all are."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit(""))


def aliases(translations: list[Column], parts: Column, municipality: Column, municipality_translations: list[Column]) -> Column:
    every = F.concat(F.array(*translations).cast("array<string>"), parts, F.array(municipality), F.array(*map(title_case, municipality_translations)).cast("array<string>"))
    return F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != "")))


def primary_name(doc_type: Column, place: Column, street: Column, postcode: Column, municipality: Column) -> Column:
    return F.coalesce(place, street, F.when(doc_type == "postcode", F.coalesce(postcode, F.lit(""))).otherwise(municipality))


def completion_inputs(name: Column, other: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(name), other), trimmed), lambda x: x != ""))


def completion_weight(popularity: Column) -> Column:
    return F.greatest(F.lit(1), F.least(popularity, F.lit(1_000_000)))


def max_distance(token: Column) -> Column:
    return F.when(F.length(token) <= 5, 1).when(F.length(token) <= 9, 2).otherwise(3)


def name_distance(token: Column, name: Column) -> Column:
    """The least edit distance of a token to the equally long head of any word of a folded name."""
    each = F.transform(words(name), lambda w: F.levenshtein(token, F.left(w, F.length(token))))
    return F.coalesce(F.array_min(each), F.length(token))


def sanitize_tokens(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t: F.left(F.regexp_replace(t, "[^a-z0-9]", ""), F.lit(190))), lambda t: t != "")


def clip(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length - 1)), F.lit("…"))).otherwise(c)


def clean_query(c: Column) -> Column:
    return F.left(trimmed(c), F.lit(120))
