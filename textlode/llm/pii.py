"""PII, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for IBANs), and words near a span raise its score. Base kinds (email, ip,
card, phone) are reported whatever the score; the added kinds (iban, card15,
ssn) only from ``LEAST_SCORE`` on.

The patterns are linear: possessive groups do not recurse, and look-behinds let
a run of characters be tried once. Where a pattern's minimal length was moved
into it, runs that are too short fail anyway. Positions are sums of the lengths
of matches and of the pieces between them. Sums run in two levels, and stretches
of a text are cut from pieces of ``PIECE`` code points, so that neither many
matches nor a very long text make the work grow with a square.

Null text counts as empty and has no spans. Each kind's spans are leftmost and do
not overlap; a match that fails its check is consumed. Repeated rows repeat their
spans. Positions are code points, end exclusive. A table without rows gives none.
``digests`` reads doc_id and text only, whatever other columns are named;
``find`` adds (or replaces) base and added, ``mask`` replaces the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.quality import let

#: Characters of the base kinds.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9]){15,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}+(?![A-Z0-9])",
    "card15": "(?<![0-9])3[47](?:[\\x20-]?[0-9]){13}+(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A cheap test that spares the patterns most texts.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t: t.rlike("[0-9](?:[\\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9 ]"),
    "card15": lambda t: t.rlike("3[47](?:[\\x20-]?[0-9]){13}"),
    "ssn": lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card15": 0.4, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "card15": "card|amex|express|credit|payment",
    "ssn": "ssn|social|security",
}
BOOST, NEAR, LEAST_SCORE = 0.2, 40, 0.5


def digits(value: Column) -> Column:
    return F.translate(value, " ().-+", "")


def mod97(value: Column) -> Column:
    """Remainder of an IBAN: its first four characters go to the end, letters count from 10."""
    plain = F.translate(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    step = lambda left, code: F.when(code < 58, left * 10 + code - 48).otherwise(left * 100 + code - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda left, c: F.when(c == "", left).otherwise(step(left, F.ascii(c))))


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        least = lambda p: F.ltrim(p, F.lit("0"))
        part = lambda p: (F.length(least(p)) < 3) | ((F.length(least(p)) == 3) & (least(p) <= "255"))
        return F.forall(F.split(value, "\\."), part)
    if kind in ("card", "card15"):
        n = F.length(digits(value))
        least, most = (16, 19) if kind == "card" else (15, 15)
        return n.between(least, most) & F.call_function("luhn_check", F.when(n <= most, digits(value)).otherwise(F.lit("0")))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return F.length(F.translate(value, " ", "")).between(15, 34) & (mod97(value) == 1)
    return F.lit(True)


#: Elements that one level of a running sum takes, and code points of a piece of text.
LEVEL, PIECE = 256, 512


def running(values: Column) -> Column:
    """Running sums of an array of int that is not empty, by chunks and then over the chunks."""
    sums = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))
    starts = F.sequence(F.lit(1), F.size(values), F.lit(LEVEL))
    inner = F.transform(starts, lambda at: F.slice(sums(F.slice(values, at, F.lit(LEVEL))), 2, LEVEL))

    def joined(chunks: Column) -> Column:
        before = F.slice(sums(F.transform(chunks, lambda c: F.element_at(c, -1))), 1, F.size(chunks))
        return F.flatten(F.zip_with(chunks, before, lambda c, more: F.transform(c, lambda v: v + more)))

    return let(inner, joined)


def in_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end (from 0, exclusive, beyond the end allowed) of the text in ``pieces``."""
    start = F.greatest(start, F.lit(0))
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    whole = F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > start, F.substring(whole, start - first * PIECE + 1, end - start)).otherwise("")


def spans_of_kind(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, value, score) of the confirmed matches of one kind."""
    pattern = PATTERNS[kind]

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = let(gaps, lambda g: F.zip_with(found, F.slice(g, 1, F.size(found)), lambda m, gap: F.length(gap) + F.length(m)))
        ends = let(lengths, running)
        spans = F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))
        checked = F.filter(spans, lambda s: confirmed(kind, s["value"]))

        def scored(pieces: Column) -> Column:
            around = lambda s: F.concat(cut(pieces, s["start"] - NEAR, s["start"]), s["value"], cut(pieces, s["end"], s["end"] + NEAR))
            score = lambda s: F.lit(SCORES[kind]) + F.when(F.lower(around(s)).rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
            return F.transform(
                checked,
                lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(s).alias("score")),
            )

        return let(in_pieces(text), scored)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.when(HINTS[kind](text), let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))).otherwise(none)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``added``: arrays of (kind, start, end, value, score), by kind, then start."""
    plain = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(spans_of_kind(k, plain) for k in BASE))
    added = F.concat(*(spans_of_kind(k, plain) for k in PATTERNS if k not in BASE))
    return docs.withColumns({"base": base, "added": added})


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document: counts by base kind, a digest of the base spans, all spans and their scores, in one order."""
    found = find(docs.select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE]
    sha = F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    scores = F.array_join(F.transform(F.concat("base", "added"), lambda s: F.format_number(s["score"], 1)), ",")
    return found.select("doc_id", *counts, sha, written(F.concat("base", "added")).alias("spans"), scores.alias("scores"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first to start names the stretch."""
    ordered = lambda found: F.array_sort(
        found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    )
    empty = F.array().cast("array<string>")

    def cover(pieces: Column, found: Column) -> Column:
        """Parts in an array: chunks of spans become one string each, so that no array or string is copied for each span."""

        def step(acc: Column, s: Column) -> Column:
            more = F.concat(acc["parts"], F.array(cut(pieces, acc["at"], s["start"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["parts"]).alias("parts"))

        def chunk(acc: Column, at: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), empty.alias("parts"))
            done = F.aggregate(F.slice(found, at, F.lit(LEVEL)), begin, step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["parts"], F.array_join(d["parts"], "")).alias("parts")))

        def end(acc: Column) -> Column:
            return F.concat(F.array_join(acc["parts"], ""), cut(pieces, acc["at"], F.length(text)))

        starts = F.sequence(F.lit(1), F.size(found), F.lit(LEVEL))
        return F.aggregate(starts, F.struct(F.lit(0).alias("at"), empty.alias("parts")), chunk, end)

    covered = lambda found: let(ordered(found), lambda o: let(in_pieces(text), lambda p: cover(p, o)))
    return let(spans, lambda found: F.when(F.size(found) == 0, text).otherwise(covered(found)))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span masked; null texts stay null."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(text, masked(F.col(text), F.concat(*(spans_of_kind(k, plain) for k in PATTERNS))))
