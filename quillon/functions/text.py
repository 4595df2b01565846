"""Scalar functions over text: query terms, lexical normalisation, hashing, complexity. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no query meaning.
STOP_WORDS = ["the", "a", "an", "to", "of", "for", "and", "or", "with", "in", "on", "by", "how", "are", "is", "after", "before"]
# Words too general to support a rescue match on their own.
WEAK_WORDS = ["class", "code", "const", "does", "export", "file", "function", "import", "return", "something", "still", "thing", "value", "what", "when", "where", "why"]
# What a query may be expanded with, by the words that ask for it.
EXPANSIONS = [
    ("auth|authentication|login|signin|sign-in|session|token|oauth", ["auth", "login", "token", "session", "guard", "oauth"]),
    ("route|routes|routing|router|navigate|navigation|redirect|path", ["router", "route", "navigation", "redirect", "path"]),
    ("config|configuration|configure|setup|register|provider|providers|bootstrap", ["config", "setup", "register", "provider", "bootstrap"]),
    ("role|roles|permission|permissions|authorization|authorisation|access", ["roles", "permissions", "access", "policy", "guard"]),
    ("interceptor|middleware|request|response|http", ["interceptor", "middleware", "http", "request", "response"]),
    ("theme|styles?|styling|palette|color|branding|upload", ["theme", "styles", "palette", "color", "branding", "upload"]),
]
# Words that decide a query's intent, first match first, and the weights of semantic and keyword search.
INTENTS = [
    ("CONFIG", ["config", "setup", "routing", "providers", "configuration", "bootstrap"], 0.5, 0.5),
    ("WIRING", ["provide", "inject", "dependency", "register", "wire", "bootstrap", "module"], 0.5, 0.5),
    ("FLOW", ["navigate", "redirect", "route", "handle", "process", "execute", "trigger", "dispatch"], 0.6, 0.4),
]
#: Decision points of source text. A letter, digit or underscore is a word character here, whatever the locale.
EDGE, STOP = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# A word that a text must hold, and the pattern to count where it does. Patterns begin with the word and look back after it, so that few places are tried.
DECISIONS = [
    ("if", r"if(?<![A-Za-z0-9_]if)[ \t\n\r]*\("), ("else", r"else(?<![A-Za-z0-9_]else)[ \t\n\r]+if[ \t\n\r]*\("), ("for", r"for(?<![A-Za-z0-9_]for)[ \t\n\r]*\("), ("while", r"while(?<![A-Za-z0-9_]while)[ \t\n\r]*\("),
    ("case", r"case(?<![A-Za-z0-9_]case)[ \t\n\r]+"), ("catch", r"catch(?<![A-Za-z0-9_]catch)[ \t\n\r]*\("), ("?", r"\?(?<=[A-Za-z0-9_]\?)[ \t\n\r]*[^:]"), ("&&", "&&"), ("||", r"\|\|"),
]


def has_word(text: Column, alternatives: str) -> Column:
    """Whether one of the alternatives stands in the text as a whole word, in any case."""
    return text.rlike(f"(?i){EDGE}(?:{alternatives}){STOP}")


def query_terms(text: Column) -> Column:
    """Lower-case words of over two characters that are no stop words, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def singular(word: Column) -> Column:
    """The word without a plural ending."""
    w = F.lower(word)
    return F.when((F.length(w) > 5) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(
        (F.length(w) > 4) & w.endswith("s") & ~w.rlike("(ss|us)$"), F.substring(w, F.lit(1), F.length(w) - 1)
    ).otherwise(w)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, camel case taken apart, each without its plural ending."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit("([a-zA-Z0-9]+)"), 1), singular)


def aliases(word: Column) -> Column:
    """The word and what it may be inflected from."""
    stem = F.regexp_replace(word, "(ed|ing)$", "")
    none = F.lit(None).cast("string")
    changed = (stem != word) & (F.length(stem) >= 4)
    doubled = stem.rlike(r"([b-df-hj-np-tv-z])\1$")
    return F.array_distinct(F.filter(F.array(word, F.when(changed, stem).otherwise(none), F.when(changed, F.concat(stem, F.lit("e"))).otherwise(none), F.when(changed & doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(none)), lambda x: x.isNotNull()))


def inflections(alias: Column) -> Column:
    """The words that have ``alias`` among their aliases."""
    bases = F.array(alias, F.concat(alias, F.substring(alias, -1, 1)), F.when(alias.endswith("e"), F.substring(alias, F.lit(1), F.length(alias) - 1)))
    made = F.concat(F.array(alias), F.transform(bases, lambda b: F.concat(b, F.lit("ed"))), F.transform(bases, lambda b: F.concat(b, F.lit("ing"))))
    return F.filter(F.array_distinct(made), lambda w: w.isNotNull() & F.array_contains(aliases(w), alias))


def evidence(text: Column) -> Column:
    """Distinct aliases of all words of a text."""
    return F.array_distinct(F.flatten(F.transform(words(text), aliases)))


def clues(query: Column, most: int = 12) -> Column:
    """The query's discriminating words, up to ``most``; identifiers don't count."""
    plain = F.regexp_replace(query, r"[a-zA-Z_][a-zA-Z0-9_]*(?:[a-z][A-Z]|_)[a-zA-Z0-9_]*|[a-z][A-Z][a-zA-Z0-9_]*|_[a-zA-Z0-9_]*", "")
    return F.slice(F.filter(F.array_distinct(words(plain)), lambda t: (F.length(t) >= 4) & ~t.isin(STOP_WORDS + WEAK_WORDS)), 1, most)


def intent(query: Column) -> Column:
    """What a query asks for, as a struct of ``intent``, ``semantic`` and ``keyword`` weight; the first rule that fits."""
    def out(name: str, a: float, b: float) -> Column:
        return F.struct(F.lit(name).alias("intent"), F.lit(a).alias("semantic"), F.lit(b).alias("keyword"))

    chain = F.when(query.rlike("[a-z][A-Z]"), out("EXACT_NAME", 0.4, 0.6))
    for name, words_, a, b in INTENTS:
        chain = chain.when(reduce(Column.__or__, [F.lower(query).contains(w) for w in words_]), out(name, a, b))
    return chain.otherwise(out("CONCEPTUAL", 0.7, 0.3))


def added_terms(query: Column) -> Column:
    """Terms by which a query is expanded, in order: those of every rule that fits and that it doesn't contain."""
    low = F.lower(query)
    lists = [F.when(has_word(query, pattern), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for pattern, terms in EXPANSIONS]
    return F.filter(F.array_distinct(F.concat(*lists)), lambda t: ~F.contains(low, t))


def variants(query: Column, most: int = 2) -> Column:
    """The query and up to two expansions of it, as an array of ``query`` and ``weight``."""
    added = added_terms(query)
    made = [F.struct(query.alias("query"), F.lit(1.0).alias("weight"))]
    for k, weight in list(enumerate((0.35, 0.25)))[:most]:
        part = F.slice(added, 1 + 6 * k, 6)
        made.append(F.when(F.size(part) > 0, F.struct(F.concat_ws(" ", query, F.array_join(part, " ")).alias("query"), F.lit(weight).alias("weight"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def content_hash(text: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def complexity(code: Column) -> Column:
    """One and the number of decision points; ``else if`` counts as both of its forms."""
    return F.lit(1) + reduce(Column.__add__, [F.when(F.contains(code, F.lit(w)), F.regexp_count(code, F.lit(p))).otherwise(0) for w, p in DECISIONS])


def occurrences(text: Column, identifier: Column) -> Column:
    """How often an identifier stands in a text, neither preceded nor followed by a letter, digit, underscore or dollar sign of any script."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_$])\Q"), identifier, F.lit(r"\E(?![\p{L}\p{N}_$])"))
    return F.when(F.contains(text, identifier), F.regexp_count(text, quoted)).otherwise(0)


def token_estimate(text: Column) -> Column:
    """A quarter of the text's bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def canonical_json(text: Column) -> Column:
    """JSON with its keys in order and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))
