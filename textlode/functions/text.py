"""Scalar text functions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and what they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

#: Other names of predicates.
PREDICATE_ALIASES = {
    "runs_on": "uses", "technology": "uses", "built_with": "uses", "powered_by": "uses", "run_on": "uses", "use": "uses", "utilizes": "uses",
    "works_under": "reports_to", "managed_by": "reports_to", "supervised_by": "reports_to",
    "boss_of": "manages", "leads": "manages", "supervises": "manages", "runs": "manages", "is_boss_of": "manages",
    "employed_by": "works_at", "works_for": "works_at",
    "has": "owns", "possesses": "owns",
    "based_in": "located_at", "lives_in": "located_at", "found_at": "located_at",
    "state": "status", "condition": "status", "health": "status",
    "called": "name", "known_as": "name", "titled": "name",
    "spouse_of": "married_to", "partner_of": "married_to",
    "working_with": "works_with",
}

#: Other names of topics.
TOPIC_ALIASES = {
    "db": "database", "db_technology": "database", "rdbms": "database", "datastore": "database",
    "tech": "technology", "stack": "technology",
    "mgr": "manager", "supervisor": "manager", "boss": "manager",
    "config": "configuration", "cfg": "configuration", "settings": "configuration",
    "env": "environment", "environ": "environment",
    "repo": "repository", "repos": "repository",
    "dir": "directory", "folder": "directory", "path": "directory",
    "auth": "authentication", "authn": "authentication", "authz": "authorization",
    "infra": "infrastructure",
    "loc": "location", "region": "location", "area": "location",
    "lang": "language", "programming_language": "language",
    "os": "operating_system", "platform": "operating_system",
    "ver": "version", "vers": "version",
    "dept": "department", "team": "department",
}

#: The first pattern to match in a message gives the signal.
CORRECTIONS = (
    r"(?i)\bactually[,:]?\s+", r"(?i)\bnot\s+(?:\w+\s){0,3}(?:anymore|any\smore)\b", r"(?i)\bignore\s+(?:that|the|my|what)\b",
    r"(?i)\b(?:i|we)\s+changed\s+(?:my|our)\s+mind\b", r"(?i)\bscratch\s+that\b", r"(?i)\b(?:instead|rather)\s*[,:]\s*",
    r"(?i)\bforget\s+(?:about|what\s+(?:i|we)\s+said)\b", r"(?i)\b(?:no|nope)[,:]?\s+(?:not\s+)?(?:that|this)\b",
    r"(?i)\b(?:that|this)\s+(?:is|was)\s+wrong\b", r"(?i)\b(?:we|i)\s+(?:should|need\s+to)\s+(?:switch|change|move|migrate)\b",
)
UNCERTAINTIES = (
    r"(?i)\b(?:i\sthink|probably|maybe|might|not\ssure|possibly|tentatively)\b", r"(?i)\bfor\s+now\b",
    r"(?i)\b(?:let's|let\s+us)\s+(?:try|see)\b", r"(?i)\b(?:could|might)\s+(?:be|work)\b",
)
PREFERENCES = (
    r"(?i)\b(?:i|we)\s+prefer\b", r"(?i)\b(?:i|we)\s+(?:like|love|enjoy)\s+(?:to\s+)?", r"(?i)\b(?:i|we)\s+(?:don't|do\s+not)\s+(?:want|like|need)\b",
    r"(?i)\bplease\s+(?:don't|do\s+not|never)\b", r"(?i)\b(?:always|never)\s+(?:use|do|show|suggest|include|send)\b",
)
EFFECTIVE = (r"(?i)\bstarting\s+(?:next\s+)?(\w+)\b", r"(?i)\bbeginning\s+(?:next\s+)?(\w+)\b", r"(?i)\bfrom\s+(?:next\s+)?(\w+)\b")
EXPIRY = (
    r"(?i)\bby\s+(?:next\s+)?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|tonight|eod|eow|end\s+of\s+\w{1,10})\b",
    r"(?i)\buntil\s+(\w+)\b", r"(?i)\bbefore\s+(\w+)\b", r"(?i)\bfor\s+the\s+next\s+(\d+)\s+(\w{1,20})\b",
)
BOILERPLATE = (
    r"(?i)©\s*\d{4}.*?reserved\.?", r"(?i)all rights reserved\.?", r"(?i)page\s+\d+\s+of\s+\d+", r"(?i)www\.\w+\.\w+",
    r"(?im)^\s*type your answers? here\.?\s*$", r"(?im)^\s*blank\s*$", r"(?im)^\s*N/A\s*$",
)
#: Urgency of an open task by its words; the first that matches counts.
BLOCKED, URGENT, ASKED = r"\bblocker\b|\bblocking\b|\bdepends?\s+on\b|\bdependenc", r"\burgent\b|\basap\b|\bcritical\b|\bimmediately\b", r"\?|\bquestion\b"
#: Words before a value that is hidden.
SECRET_WORDS = "(?i)(password|secret|token|api[_-]?key)\\s*[:=]\\s*\\S+"


def estimate_tokens(text: Column, per_token: float = 3.8) -> Column:
    """ceil(length / per_token); nothing has 0 tokens."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / F.lit(float(per_token))).cast("long")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), "\\s+", " ")


def hash_prefix(text: Column, n: int) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the first n characters, lower case and trimmed."""
    return F.substring(F.sha2(F.substring(F.trim(F.lower(text)), 1, n).cast("binary"), 256), 1, 16)


def snake(text: Column) -> Column:
    return F.regexp_replace(normalize(text), " ", "_")


def renamed(text: Column, aliases: dict[str, str]) -> Column:
    name = snake(text)
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def normalize_predicate(text: Column) -> Column:
    return renamed(text, PREDICATE_ALIASES)


def normalize_topic(text: Column) -> Column:
    return renamed(text, TOPIC_ALIASES)


def canonical_key(kind: Column, subject: Column, predicate: Column, value: Column, topic: Column | None = None) -> Column:
    """Key under which equal knowledge meets; null where a part is missing or the kind has none. A claim's topic goes before its predicate."""
    full = lambda c: F.when(F.trim(c) != "", normalize(c))
    # null if a part is: each part is written out once
    join = lambda *parts: F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit("::"), p)))
    aspect = normalize_predicate(full(predicate))
    if topic is not None:
        aspect = F.coalesce(normalize_topic(full(topic)), aspect)
    return (
        F.when(kind == "claim", join(F.lit("claim"), full(subject), aspect))
        .when(kind == "decision", join(F.lit("decision"), hash_prefix(full(value), 200)))
        .when(kind == "entity", join(F.lit("entity"), F.coalesce(full(predicate), F.lit("unknown")), full(subject)))
        .when(kind == "relation", join(F.lit("relation"), full(subject), normalize_predicate(full(predicate)), full(value)))
        .when(kind == "loop", join(F.lit("loop"), hash_prefix(full(value), 100)))
        .when(kind == "procedure", join(F.lit("proc"), full(subject), full(predicate)))
        .when(kind == "invariant", join(F.lit("inv"), full(subject)))
        .when(kind == "capability", join(F.lit("capability"), full(predicate), full(subject)))
        .when(kind == "conflict", join(F.lit("conflict"), hash_prefix(full(value), 200)))
    )


def fold(text: Column) -> Column:
    """Lower case without diacritics; texts of ASCII alone have none, and are not translated sign by sign."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(text), MARKED, PLAIN))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """Distinct lower-case words of three or more characters."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_\\s]", " "), "\\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def quoted_query(text: Column) -> Column:
    """A full-text query that requires each word: words in double quotes; null if there is none."""
    words = F.filter(F.split(F.regexp_replace(text, "[^\\p{L}\\p{N}\\s_-]", " "), "\\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " "))


def fallback_snippet(text: Column, terms: list[str]) -> Column:
    """24 characters before and 40 after the first term, else the first 77 of more than 80."""
    low = F.lower(text)
    places = F.filter(F.array(*(F.instr(low, t.lower()) for t in terms)), lambda p: p > 0)
    at = F.array_min(places) - 1
    first = F.array_min(F.transform(F.filter(F.array(*(F.struct(F.instr(low, t.lower()).alias("p"), F.lit(len(t)).alias("n")) for t in terms)), lambda s: s["p"] > 0), lambda s: s))
    start, end = F.greatest(at - 24, F.lit(0)), F.least(F.length(text), at + first["n"] + 40)
    around = F.concat(
        F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise("")
    )
    return F.when(at.isNotNull(), around).when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)


def snippet_around(text: Column, terms: Column) -> Column:
    """As ``fallback_snippet`` for a column of lower-case terms; of terms at one place the first counts."""
    low = F.lower(text)
    found = F.filter(F.transform(terms, lambda t, i: F.struct(F.instr(low, t).alias("p"), i.alias("i"), F.length(t).alias("n"))), lambda x: x["p"] > 0)
    first = F.array_min(found)
    start, end = F.greatest(first["p"] - 25, F.lit(0)), F.least(F.length(text), first["p"] - 1 + F.greatest(first["n"], F.lit(1)) + 40)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    around = F.concat(F.when(start > 0, "...").otherwise(""), strip(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), "...").otherwise(""))
    head = strip(text)
    cut = F.concat(F.regexp_replace(F.substring(head, 1, 77), r"\s+$", ""), F.lit("..."))
    return F.when(F.size(found) > 0, around).when(F.length(head) <= 80, head).otherwise(cut)


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))


def first_signal(text: Column, patterns: tuple[str, ...]) -> Column:
    """The text of the first pattern that matches, trimmed."""
    return F.regexp_replace(first_match(text, patterns), "^\\s+|\\s+$", "")


def loop_priority(text: Column, kind: Column | None = None, deadline: Column | None = None) -> Column:
    """Urgency of an open task by its words, its deadline and its kind."""
    low = F.lower(text)
    kind, due = F.lit("") if kind is None else F.coalesce(kind, F.lit("")), F.lit(False) if deadline is None else deadline.isNotNull()
    ladder = F.when(low.rlike(BLOCKED), 8).when(low.rlike(URGENT), 7).when(due, 6).when(kind == "task", 4)
    return ladder.when(low.rlike(ASKED), 3).when(kind == "reminder", 2).otherwise(4)


def relevance_label(share: Column) -> Column:
    """Dots for a score's place between the worst (0) and the best (1) of its query; null where all are equal."""
    return F.when(share.isNull() | (share >= 0.75), "●●●").when(share >= 0.5, "●●○").when(share >= 0.25, "●○○").otherwise("○○○")


def auto_tags(path: Column, stop: tuple[str, ...] = ("src", "docs", "index", "tmp", "www")) -> Column:
    """Extension and up to two parent folders, 2 to 29 characters, distinct, without stop words."""
    parts = F.filter(F.split(F.lower(path), "[/\\\\]+"), lambda p: p != "")
    extension = F.regexp_extract(F.lower(path), "\\.([a-z0-9]+)$", 1)
    parents = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.array_distinct(F.filter(F.concat(F.array(extension), parents), lambda t: F.length(t).between(2, 29) & ~t.isin(*stop)))


def strip_boilerplate(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), BOILERPLATE, text)


def strip_sensitive(text: Column) -> Column:
    return F.regexp_replace(text, SECRET_WORDS, "$1=[redacted]")


def script_language(text: Column) -> Column:
    """Language by the share of characters of a script; below a tenth it is unknown."""
    ranges = {"en": "a-zA-Z", "zh": "\\u4e00-\\u9fff", "ar": "\\u0600-\\u06ff", "ru": "\\u0400-\\u04ff", "ko": "\\uac00-\\ud7af", "hi": "\\u0900-\\u097f"}
    # what the runs of a script leave is removed at one place each: a text has far fewer runs than signs
    share = [(F.length(text) - F.length(F.regexp_replace(text, f"[{r}]+", ""))) / F.greatest(F.length(text), F.lit(1)) for r in ranges.values()]

    def named(found: Column) -> Column:
        best = F.array_max(found)
        return F.when(best < 0.1, "unknown").otherwise(F.get(F.array(*map(F.lit, ranges)), (F.array_position(found, best) - 1).cast("int")))

    # bound to a variable, as the shares are named several times and cost a pass over the text each
    return F.get(F.transform(F.array(F.array(*share)), named), F.lit(0))


def cut_words(text: Column, words: int) -> Column:
    return F.array_join(F.slice(F.split(F.substring(text, 1, 10_000), "\\s+"), 1, words), " ")


def values_contradict(a: Column, b: Column) -> Column:
    """Different, neither inside the other, and less than about two thirds of the words in common."""
    x, y = normalize(a), normalize(b)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) > 1))
    union = F.size(F.array_union(words(x), words(y)))
    jaccard = F.when(union > 0, F.size(F.array_intersect(words(x), words(y))) / union).otherwise(0.0)
    return (x != y) & ~F.contains(x, y) & ~F.contains(y, x) & (jaccard <= 0.7)


def freshness(days: Column) -> Column:
    """Halves every 30 days, at least 0.1; unknown ages count as one half, future ones as fresh."""
    return F.when(days.isNull(), 0.5).when(days < 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.pow(F.lit(0.5), days / 30.0)))


def recency_weight(days: Column) -> Column:
    return F.when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 90, 0.5).otherwise(0.3)


def effective_confidence(base: Column, mentions: Column, days: Column) -> Column:
    return base * F.least(F.lit(1.0), mentions / 3.0) * recency_weight(days)


def distance_confidence(best: Column) -> Column:
    return F.when(best < 0.5, 0.8).when(best < 0.8, 0.5).when(best < 1.0, 0.3).otherwise(0.1)


def epistemic_label(confidence: Column, contested: Column) -> Column:
    return F.when(contested, "CONTESTED").when(confidence >= 0.9, "FIRM").when(confidence < 0.5, "PROVISIONAL").otherwise("")


def l2_distance(a: Column, b: Column) -> Column:
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, x: s + x))
