"""Relevance of knowledge to a task, and how far a question is to be expanded: column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the signals by the task's mode, scores of influence, and what a status leaves of a score.
MODES = {
    "coding": {"semantic": 0.4, "recency": 0.2, "trust": 0.15, "conflict": 0.1, "influence": 0.15},
    "planning": {"semantic": 0.2, "recency": 0.15, "trust": 0.15, "conflict": 0.25, "influence": 0.25},
    "troubleshooting": {"semantic": 0.25, "recency": 0.3, "trust": 0.15, "conflict": 0.1, "influence": 0.2},
    "recall": {"semantic": 0.5, "recency": 0.1, "trust": 0.1, "conflict": 0.1, "influence": 0.2},
    "default": {"semantic": 0.3, "recency": 0.2, "trust": 0.15, "conflict": 0.15, "influence": 0.2},
}
INFLUENCE = {"critical": 1.0, "high": 0.8, "standard": 0.5, "low": 0.2}
STATUS = {"active": 1.0, "needs_confirmation": 0.9, "stale": 0.3, "superseded": 0.0, "retracted": 0.0}
OTHER = 0.5
WITH_WORD, WITHOUT_WORD = 0.6, 0.5
#: Routing of expansions.
DEPTH, LEAST_DEPTH, MOST_DEPTH, DIRECT_DEPTH, DIRECT_CANDIDATES, HOP_DEPTH, HOP_CANDIDATES = 3, 1, 10, 2, 1, 3, 5
MODERATE, HIGH = 0.35, 0.7
PER_SUMMARY, PER_DEPTH, WITH_MESSAGES, BROAD_FACTOR, HOP_FACTOR = 220, 0.65, 1.9, 1.35, 1.25
BROAD = (
    r"(?i)\b(last|past)\s+(month|months|quarter|quarters|year|years)\b",
    r"(?i)\b(over|across|throughout)\s+(time|months|quarters|years)\b",
    r"(?i)\b(timeline|chronology|history|long[-\s]?term)\b",
    r"(?i)\bbetween\s+[^.]{0,40}\s+and\s+[^.]{0,40}\b",
)
HOPS = (r"(?i)\b(root\s+cause|causal\s+chain|chain\s+of\s+events)\b", r"(?i)\b(multi[-\s]?hop|multi[-\s]?step|cross[-\s]?summary)\b", r"(?i)\bhow\s+did\b.+\blead\s+to\b")
YEAR, YEARS_APART = r"\b(?:19|20)\d{2}\b", 2
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can",
    "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "this", "that", "it", "its", "and", "or", "but", "not", "no", "what", "which",
    "who", "when", "where", "how", "why", "all", "each", "every", "our", "we", "us", "my", "your", "i", "me", "he", "she", "they", "them",
)


def named(c: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in values.items()), F.lit(other))


def relevance(mode: Column | str, semantic: Column, recency: Column, trust: Column, conflict: Column, influence: Column, status: Column) -> Column:
    """The weighted sum of the signals, times what the status leaves; unknown modes weigh like the default."""
    signals = {"semantic": semantic, "recency": recency, "trust": trust, "conflict": conflict, "influence": influence}
    mode = F.lit(mode) if isinstance(mode, str) else mode
    weight = lambda s: named(mode, {m: w[s] for m, w in MODES.items()}, MODES["default"][s])
    return reduce(lambda a, b: a + b, (c * weight(s) for s, c in signals.items())) * named(status, STATUS, OTHER)


def influence_score(weight: Column) -> Column:
    return named(weight, INFLUENCE, OTHER)


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def broad_time(query: Column) -> Column:
    """Does a question span a long time, by its words or by years that lie apart?"""
    years = F.transform(F.regexp_extract_all(query, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    apart = (F.size(years) >= 2) & (F.array_max(years) - F.array_min(years) >= YEARS_APART)
    return F.coalesce((F.trim(query) != "") & (any_of(query, BROAD) | apart), F.lit(False))


def bounded_depth(depth: Column) -> Column:
    return F.when(depth.isNotNull(), F.greatest(F.lit(LEAST_DEPTH), F.least(F.lit(MOST_DEPTH), depth.cast("int")))).otherwise(DEPTH)


def several_hops(query: Column, depth: Column, candidates: Column) -> Column:
    return (bounded_depth(depth) >= HOP_DEPTH) | (candidates >= HOP_CANDIDATES) | F.coalesce(any_of(query, HOPS), F.lit(False))


def routed(query: Column, depth: Column, candidates: Column, cap: Column, messages: Column, probe: Column) -> Column:
    """A struct: action (answer_directly, expand_shallow, delegate_traversal), depth, tokens, ratio, risk, broad, hops.

    A probe is a question that asks nothing to be expanded. A null cap is none.
    """
    n = F.greatest(F.lit(0), F.coalesce(candidates.cast("int"), F.lit(0)))
    at, broad, hops = bounded_depth(depth), broad_time(query), several_hops(query, depth, n)
    each = F.when(messages, PER_SUMMARY * WITH_MESSAGES).otherwise(float(PER_SUMMARY)) * (1 + (at - 1) * PER_DEPTH) * F.when(broad, BROAD_FACTOR).otherwise(1.0) * F.when(hops, HOP_FACTOR).otherwise(1.0)
    tokens = F.ceil(F.round(each * n, 6)).cast("long")
    ratio = tokens / F.greatest(F.lit(1), F.coalesce(cap.cast("long"), F.lit(2**53 - 1)))
    risk = F.when(ratio >= HIGH, "high").when(ratio >= MODERATE, "moderate").otherwise("low")
    direct = (n == 0) | (probe & (at <= DIRECT_DEPTH) & (n <= DIRECT_CANDIDATES) & (ratio < MODERATE) & ~broad & ~hops)
    action = F.when(direct, "answer_directly").when((ratio >= HIGH) | (broad & hops), "delegate_traversal").otherwise("expand_shallow")
    values = {"action": action, "depth": at, "tokens": tokens, "ratio": ratio, "risk": risk, "broad": broad, "hops": hops}
    return F.struct(*(v.alias(k) for k, v in values.items()))


def search_terms(query: Column) -> Column:
    """The first five words of two letters or more that are no stop words, a hundred characters each."""
    words = F.filter(F.split(F.lower(query), r"[\s,;:!?.]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.slice(F.transform(words, lambda w: F.substring(w, 1, 100)), 1, 5)
