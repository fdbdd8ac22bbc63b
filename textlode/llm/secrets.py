"""Secret scans.

Base spans come from three patterns: values assigned to names such as password
or token, access key ids, and runs of hexadecimal digits. Beside them, every
long token near a sensitive word is judged by dictionary-primed Zstandard: the
text around it is compressed, with a dictionary of common identifiers, once with
the token and once without (its other copies removed from both), and the bytes
that it adds are its novelty. Names, paths and words are cheap, as the dictionary
or the text around explains their parts or their letters; a random key costs
nearly its own length, whatever its alphabet. Tokens that do not compress are
reported as ``novel``; a key is never dropped for its looks.

Candidates inside base spans are measured as all others; base spans stay whatever
their measure is. Tokens below 20 characters are not measured: long ordinary
words do not compress either.

Each text is scanned whole, row by row. Null text counts as empty and has no
spans. Spans are code points, end exclusive. Repeated rows repeat their spans; a
table without rows gives none. Columns other than the key and the text are not
read. Texts of any length are scanned in one pass.
"""

from __future__ import annotations

import functools
import hashlib
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import map_rows

#: The base kinds in order, with the least length of what counts.
ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST = {"assign": 12, "access": 18}

SENSITIVE = re.compile(
    "secret|passw|token|credential|api[_-]?key|auth|bearer|private|signature|access[_-]?key|client[_-]?id|session", re.IGNORECASE | re.ASCII
)
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
IDENTIFIERS = (
    "password secret token api_key apikey access_key private_key client_secret client_id authorization bearer "
    "username credential session_id signature certificate public_key encryption_key connection_string database_url "
    "https://www.example.com/ http://localhost:8080/ application/json content-type user-agent return function import "
    "class public static void string integer boolean export default const require module config settings environment "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxx"
    " account address admin agent alias algorithm allow application archive argument array assets async attribute audit "
    "author await backend backup base batch binary block branch bucket buffer build bundle button cache call callback "
    "cancel catalog category channel char check child client cluster code collection column command comment commit common "
    "component condition connect container content context controller convert cookie copy core count create current cursor "
    "custom data database date debug decode default delete deploy description device dialog directory disable document "
    "domain driver dynamic editor element email enable encode endpoint engine entity entry error event example exception "
    "execute expire extension factory feature field file filter folder format forward frame framework gateway generate "
    "global group handler hash header height helper history host image implementation index info init input insert "
    "instance interface internal invalid item iterator job label language layer layout length level library license link "
    "list listener load local location lock logger login manager map master match member memory message metadata method "
    "metric migration mode model monitor mount name namespace network node notification number object offset operation "
    "option order output owner package page panel parameter parent parse partition path pattern payload permission "
    "platform plugin policy pool port position prefix process product profile project property protocol provider proxy "
    "query queue random range read record redirect reference refresh region register release remote remove render report "
    "repository request required reset resolve resource response result retry role root route router rule runtime sample "
    "scale schedule schema scope screen script search section select sequence server service share signal size source "
    "stage standard start state status storage store stream style submit subscription support switch symbol sync system "
    "table target task template test text thread threshold timeout timestamp title toggle tool topic trace transaction "
    "transfer transform type update upload user util validate value vector verify version view virtual volume warning "
    "widget width window worker workflow workspace write "
    "/usr/local/share/ /usr/local/bin/ /usr/lib/ /usr/share/ /etc/ /var/lib/ /var/log/ /home/ /opt/ /tmp/ /dev/ /src/ /main/ /test/ /docs/ "
    "/application/config/ /modules/module1 /node_modules/ "
).encode()
NEAR = 80  # code points around a candidate in which a sensitive word must stand
AROUND = 1024  # code points on each side that are compressed with a candidate
NOVELTY = 0.66  # added bytes a byte; random letters of one case have some 0.75 where text around them is of such letters


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


@functools.cache
def compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=settings)


def marginal_bytes(text: str, start: int, end: int) -> int:
    """Bytes that text[start:end] adds to the compressed text around it, which holds none of its other copies."""
    token = text[start:end]
    before, after = (x.replace(token, "\n") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
    size = lambda x: len(compressor().compress(x.encode()))
    return size(before + token + after) - size(before + after)


def measured(text: str) -> list[tuple[int, int, float]]:
    """Candidates near a sensitive word, each with its compressed bytes a byte."""
    found, near = [], [m.start() for m in SENSITIVE.finditer(text)]
    if not near:
        return found
    k = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(near) and near[k] < start - NEAR:
            k += 1
        if k == len(near):
            break
        if near[k] <= end + NEAR:
            found.append((start, end, marginal_bytes(text, start, end) / (end - start)))
    return found


def novel_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that the dictionary does not explain."""
    return [(start, end, "novel") for start, end, novelty in measured(text) if novelty >= NOVELTY]


def spans_of(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, by start, then kind as listed."""
    text = text or ""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + novel_spans(text), key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each span: key, kind, start, end, value, and novelty (compressed bytes a byte, of novel ones)."""

    def make():
        def one(k, t):
            novelty = {(s, e): x for s, e, x in measured(t or "")}
            return [(k, kind, s, e, t[s:e], novelty[s, e] if kind == "novel" else None) for s, e, kind in spans_of(t)[1]]

        return one

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, kind string, start long, end long, value string, novelty double"
    return map_rows(df.select(F.col(key), F.col(text)), make, schema, many=True)


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each text: counts by base kind, a digest of the base spans, and all spans."""

    def make():
        def one(k, t):
            base, every = spans_of(t)
            kinds = [x[2] for x in base]
            counts = [kinds.count(n) for n in KINDS[:3]]
            return k, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)

        return one

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)
