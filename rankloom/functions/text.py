"""Column functions over text: tokens, normal forms, spans, masks, query shapes. All run in the JVM.

Patterns carry (?U): word boundaries, white space and digits are Unicode's, as the semantics ask. Nulls: a function of a
null text is null unless it says otherwise; texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results: patterns and word lists.
TOKEN = r"[A-Za-z0-9_]+"
CAPITALISED_5 = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b"
CAPITALISED_4 = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"
NAMED = r"(?U)\b(?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,}|of|the|and|for|to|in|on)){0,6}\b"
QUOTED = r'"([^"\n]{2,120})"'
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = r"(?U)(?i)\b(?:\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|" + MONTHS + r")\b"
NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
SLOT = r"\[[A-Z_]+\]"
NUMBER_MASK = r"(?U)\b\d{1,4}([-/]\d{1,2})?([-/]\d{1,4})?\b"
DATE_MASK = r"(?U)(?i)\b(" + MONTHS + r")\b( \d{1,2})?(, \d{4})?"
ARTICLES = ("The", "A", "An")
KEPT_CAPITALS = ("The", "A", "An", "Question")
ANCHOR_BANNED = ("the", "a", "an", "who", "what", "where", "when", "which", "how", "question")
NAMED_BANNED = ("Who", "What", "Where", "When", "Which", "How", "Question", "The", "A", "An")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")
BRIDGE_MARKERS = (" that ", " which ", " book that inspired ", " author of the book ", " nationality of the author ", " inspired by ", " score for ")
GENERIC_PHRASES = ("information about", "documents about", "what does", "guidance on", "example disclosures", "illustrative notes")
QUERY_OPENINGS = (
    (("where",), "LOCATION", "location or place relation"),
    (("when",), "DATE", "time or date relation"),
    (("who",), "PERSON", "person or agent relation"),
    (("how many", "how much"), "NUMBER", "quantity relation"),
)
OTHER_OPENING = ("ENTITY", "retrieve evidence for the query relation")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """F1. ASCII word runs, matched before lower-casing."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def content_tokens(text: Column, longer_than: int = 2) -> Column:
    """Tokens over a length that are no stop-words, with repeats."""
    return F.filter(tokens(text), lambda t: (F.length(t) > longer_than) & ~t.isin(*STOPWORDS))


def normal_key(text: Column) -> Column:
    """F2. Lower case, runs of other than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def folded(text: Column) -> Column:
    """F3. Lower case with white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: w != "")


def contains_folded(haystack: Column, needle: Column) -> Column:
    """F4."""
    n = folded(needle)
    return (n != "") & F.contains(folded(haystack), n)


def first_by_key(values: Column, key) -> Column:
    """Order-preserving distinct by key(value): the first of each key stays.

    Values are sorted by key and place, and those stay whose neighbour has another key. The sorted array is bound by an
    outer lambda: within a lambda, an expression that isn't its variable would be evaluated for every element.
    """
    keyed = F.array_sort(F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    firsts = F.transform(F.array(keyed), lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"])))[0]
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, where use has lambdas that read it."""
    return F.transform(F.array(value), use)[0]


def all_answers(answers: Column, aliases: Column, lower=F.lower) -> Column:
    """Answers, then aliases; empty ones dropped, first of each trimmed lower-cased value kept in its own casing."""
    both = F.filter(F.concat(F.coalesce(answers, strings()), F.coalesce(aliases, strings())), lambda a: a.isNotNull() & (a != ""))
    return first_by_key(both, lambda a: lower(F.trim(a)))


def merged(existing: Column, incoming: Column) -> Column:
    """P4. Incoming values appended to existing ones, case-insensitively distinct."""
    both = F.filter(F.concat(F.coalesce(existing, strings()), F.coalesce(incoming, strings())), lambda a: a.isNotNull() & (F.trim(a) != ""))
    return first_by_key(both, lambda a: F.lower(F.trim(a)))


def by_character(text: Column, change) -> Column:
    """F.upper or F.lower of each character alone, as SQL has them: where that is several characters (ß), it stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(change(c)) == 1, change(c)).otherwise(c)), "")


def contains_any(text: Column, aliases: Column) -> Column:
    """F5. Null without aliases; else whether some alias's key is within the text's key."""
    return F.when(F.size(aliases) == 0, F.lit(None).cast("boolean")).otherwise(bound(normal_key(text), lambda key: F.exists(aliases, lambda a: F.contains(key, normal_key(a)))))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def quoted(text: Column) -> Column:
    return extract(text, QUOTED, 1)


def candidates(text: Column) -> Column:
    """F6. Quoted spans, capitalised runs, dates, numbers, in this order; the first of each lower-cased value."""
    spans = F.concat(
        F.filter(F.transform(quoted(text), lambda v: F.trim(v)), lambda v: v != ""),
        F.filter(extract(text, CAPITALISED_5), lambda v: ~v.isin(*ARTICLES)),
        extract(text, DATE),
        extract(text, NUMBER),
    )
    return first_by_key(spans, F.lower)


def anchor_keys(text: Column) -> Column:
    """F7. Keys of capitalised and quoted spans, and every token: a set."""
    keys = F.transform(F.concat(extract(text, CAPITALISED_5), quoted(text)), normal_key)
    return F.array_distinct(F.filter(F.concat(keys, tokens(text)), lambda k: k != ""))


def anchors(text: Column) -> Column:
    """F8. Quoted spans, then capitalised runs of up to four words, without question words; an ordered list."""
    spans = F.filter(F.concat(quoted(text), extract(text, CAPITALISED_4)), lambda v: ~F.lower(v).isin(*ANCHOR_BANNED))
    return first_by_key(spans, F.lower)


def named_anchors(text: Column) -> Column:
    """F9. Quoted spans, then runs of capitalised or all-capital words with small words inside."""
    spans = F.filter(F.transform(F.concat(quoted(text), extract(text, NAMED)), lambda v: F.trim(v)), lambda v: (v != "") & ~v.isin(*NAMED_BANNED))
    return first_by_key(spans, F.lower)


def capitalised_spans(text: Column) -> Column:
    """F10. With repeats."""
    return F.filter(extract(text, CAPITALISED_4), lambda v: ~v.isin(*KEPT_CAPITALS))


def introduced(query: Column, expansion: Column) -> Column:
    """F11. Candidates of the expansion whose key the query does not anchor, the first of each key."""
    new = bound(anchor_keys(query), lambda known: F.filter(candidates(expansion), lambda c: (normal_key(c) != "") & ~F.array_contains(known, normal_key(c))))
    return first_by_key(new, normal_key)


def support_overlap(text: Column, evidence: Column) -> Column:
    """F12. The largest share of the text's distinct tokens in one evidence text; 0 without tokens."""
    share = bound(F.array_distinct(tokens(text)), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(F.array_max(F.transform(evidence, lambda e: F.size(F.array_intersect(own, tokens(e))).cast("double") / F.size(own)))))
    return F.coalesce(share, F.lit(0.0))


def entailed(text: Column, evidence: Column, share: float = 0.75) -> Column:
    """F13. The text's key within an evidence text's, or an overlap of at least share with one that has a key."""
    key = normal_key(text)
    usable = F.filter(evidence, lambda e: normal_key(e) != "")
    return (key != "") & (F.exists(usable, lambda e: F.contains(normal_key(e), key)) | ((F.size(usable) > 0) & (support_overlap(text, usable) >= share)))


def slot_count(text: Column) -> Column:
    return F.size(extract(text, SLOT))


def collapse_slots(text: Column) -> Column:
    """F18."""
    return F.regexp_replace(text, r"(?U)(\[[A-Z_]+\])(\s+\1)+", "$1")


def mask_capitalised(text: Column, query: Column, slot: str = "[ENTITY]") -> Column:
    """F16, F17. Capitalised runs become the slot, unless kept words or anchors of the query.

    The text is cut at each run: what precedes the n-th run, then the run or the slot; so one pass, without a UDF.
    """
    marked = F.regexp_replace(text, CAPITALISED_4, "\u0001$0\u0002")

    def piece(p: Column, known: Column) -> Column:
        span, rest = F.substring_index(p, "\u0002", 1), F.substr(p, F.instr(p, "\u0002") + 1)
        kept = span.isin(*KEPT_CAPITALS) | F.array_contains(known, F.lower(span))
        return F.concat(F.when(kept, span).otherwise(F.lit(slot)), rest)

    parts = F.split(marked, "\u0001", -1)
    after = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.array_join(F.concat(F.slice(parts, 1, 1), bound(F.transform(anchors(query), F.lower), lambda known: F.transform(after, lambda p: piece(p, known)))), "")


def mask_answer(text: Column, query: Column) -> Column:
    """F14. Numbers, then dates, then capitalised runs, as slots."""
    dated = F.regexp_replace(F.regexp_replace(text, NUMBER_MASK, "[NUMBER]"), DATE_MASK, "[DATE]")
    return collapse_slots(mask_capitalised(dated, query))


def generic_mask(text: Column) -> Column:
    """F15."""
    return F.regexp_replace(mask_answer(text, F.lit("")), SLOT, "[MASK]")


def entity_mask(text: Column, query: Column) -> Column:
    """F16."""
    return collapse_slots(mask_capitalised(text, query))


def remove_gold(text: Column, golds: Column) -> Column:
    """F20. Longest first, regardless of case."""
    ordered = F.array_sort(F.filter(golds, lambda g: g.isNotNull() & (g != "")), lambda a, b: F.length(b) - F.length(a))
    quote = lambda g: F.concat(F.lit(r"(?iu)\Q"), F.replace(g, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return collapse_slots(F.aggregate(ordered, text, lambda acc, g: F.regexp_replace(acc, quote(g), F.lit("[ANSWER]"))))


def filler(reference: Column) -> Column:
    return F.array_join(F.array_repeat(F.lit("relevant"), F.greatest(F.size(words(reference)), F.lit(1))), " ")


def neutral_filler(query: Column, reference: Column) -> Column:
    """F21."""
    return F.trim(F.concat(query, F.lit("\n"), filler(reference)))


def filler_then_query(query: Column, reference: Column) -> Column:
    """F22."""
    return F.trim(F.concat(filler(reference), F.lit("\n"), query))


def repeat_to_length(query: Column, reference: Column) -> Column:
    """F23. The query, then its words cycled to as many as the reference has."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words(reference)), F.lit(1)) - 1)
    cycled = bound(words(query), lambda own: F.transform(places, lambda i: F.get(own, i % F.greatest(F.size(own), F.lit(1)))))
    return F.when(F.size(words(query)) == 0, query).otherwise(F.trim(F.concat(query, F.lit("\n"), F.array_join(cycled, " "))))


def shuffled(text: Column, seed: Column) -> Column:
    """F24, portable: words in the order of a hash of seed, place and word."""
    own = words(text)
    keyed = F.transform(own, lambda w, i: F.struct(F.sha2(F.concat_ws("|", seed.cast("string"), i.cast("string"), w), 256).alias("h"), w.alias("w")))
    return F.when(F.size(own) <= 1, text).otherwise(F.array_join(F.transform(F.array_sort(keyed), lambda k: k["w"]), " "))


def random_word_mask(text: Column, seed: int = 13) -> Column:
    """F19, portable: one word, chosen by a hash of seed and text, becomes [MASK]; a text without word characters stays."""
    own = words(text)
    at = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), text), 256), 1, 8), 16, 10).cast("long"), F.size(own).cast("long"))
    masked = F.array_join(F.transform(own, lambda w, i: F.when(i.cast("long") == at, F.lit("[MASK]")).otherwise(w)), " ")
    return F.when(F.regexp_like(text, F.lit(r"(?U)\w")), masked).otherwise(text)


def _opening(query: Column, field: int) -> Column:
    low = F.lower(query)
    out = F.lit(OTHER_OPENING[field])
    for row in reversed(QUERY_OPENINGS):
        out = F.when(reduce(lambda a, b: a | b, [low.startswith(p) for p in row[0]]), F.lit(row[field + 1])).otherwise(out)
    return out


def answer_slot_type(query: Column) -> Column:
    """F25. The type of the answer's slot, without brackets."""
    return _opening(query, 0)


def relation_intent(query: Column) -> Column:
    """F25."""
    return _opening(query, 1)


def obfuscation_type(anchor: Column) -> Column:
    """F26."""
    return F.when(F.regexp_like(anchor, F.lit("[\"“”']")) | (F.size(words(anchor)) >= 3), "WORK").otherwise("ENTITY")


def needs_bridge(query: Column) -> Column:
    """F27."""
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return F.exists(strings(*BRIDGE_MARKERS), lambda m: F.contains(padded, m))


def unique_queries(values: Column, most: int = 6) -> Column:
    """F28."""
    clean = F.filter(F.transform(values, lambda v: F.array_join(words(v), " ")), lambda v: v != "")
    return F.slice(first_by_key(clean, F.lower), 1, most)


def support_terms_of(context: Column) -> Column:
    """F30. The comma-separated terms of `support_terms:` lines, distinct."""
    lines = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(r"(?im)^[ \t]*support_terms[ \t]*:(.*)$"), F.lit(1))
    terms = F.flatten(F.transform(lines, lambda x: F.split(x, ",")))
    clean = F.filter(F.transform(terms, lambda t: F.array_join(words(t), " ")), lambda t: t != "")
    return first_by_key(clean, F.lower)


def deobfuscate(text: Column, entity_map: Column) -> Column:
    """F31. entity_map: array of structs with placeholder and original."""
    return F.trim(F.aggregate(entity_map, F.trim(F.coalesce(text, F.lit(""))), lambda t, m: F.replace(t, m["placeholder"], m["original"])))


def has_support_term(text: Column, terms: Column) -> Column:
    """F32."""
    return bound(folded(text), lambda low: F.exists(terms, lambda t: (folded(t) != "") & F.contains(low, folded(t))))


def generic_penalty(text: Column) -> Column:
    """F33."""
    low = folded(text)
    return F.when(F.exists(strings(*GENERIC_PHRASES), lambda p: F.contains(low, p)), 0.15).otherwise(0.0)


def shape_key(text: Column) -> Column:
    """F34."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS)))), " ")


def answer_form_penalty(text: Column) -> Column:
    """F35."""
    some, n = F.size(candidates(text)) > 0, F.size(tokens(text))
    return F.when(F.lower(F.trim(text)).startswith("the answer is"), 1.0).when(some & (n <= 6), 0.8).when(some & (n <= 12), 0.6).otherwise(0.0)


def first_sentence(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("."), F.lit(1)))


def split_bucket(key: Column) -> Column:
    """F42. The first 8 hex digits of a key's SHA-256 as a share of 2^32 - 1."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295


def hash_strings(values: Column) -> Column:
    """F40. SHA-256 over the values, each followed by NUL."""
    return F.sha2(F.array_join(F.transform(values, lambda v: F.concat(v, F.lit("\0"))), ""), 256)


def slug(text: Column) -> Column:
    """F39."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("dataset")).otherwise(s)


def title_and_text(title: Column, text: Column) -> Column:
    """P2. Title and text by a line break, or the one that is not blank."""
    return F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(text), F.lit("")))


def cleaned_list(values: Column) -> Column:
    """P3. Stripped non-empty values; null is empty."""
    return F.filter(F.transform(F.coalesce(values, strings()), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def weight_suffix(weight: float) -> str:
    """P13. 0.25 to 0p25."""
    return str(weight).replace(".", "p")


def beta_of_method(method: Column) -> Column:
    """F43. The weight that ends a method's name, null if none does."""
    return F.replace(F.nullif(F.regexp_extract(method, r"beta(\d+(?:p\d+)?)$", 1), F.lit("")), F.lit("p"), F.lit(".")).cast("double")
