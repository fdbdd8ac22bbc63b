"""Which claims are not kept: sensitive ones, those about the machinery itself, and junk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Subjects and predicates of messages' own data, which are no knowledge.
META_SUBJECTS = ("message", "user message", "assistant", "bot", "system", "image", "attachment", "file")
META_PREDICATES = ("sent", "contains", "timestamp", "received", "delivered", "forwarded", "replied", "sender", "sent_by", "from", "file_path", "type", "size", "format")
SENDING = ("sent", "sender", "sent_by")
STATING = (*META_SUBJECTS, "document", "user_note", "general")
PATHS = r"^[a-z]:\\|^/[a-z]|\\users\\|\\home/"
RELATIVE = r"^\./|^\.\./|^src/|^dist/|^node_modules/"
LEAST_CONFIDENCE = 0.35
#: What a claim of secrets holds.
SENSITIVE = (
    "password", "secret", r"api[_\s-]?key", r"token(?:\s|$)", "fingerprint", r"private[_\s-]?key", "credential", r"ssh[_\s-]?key", r"\.pem\b", r"bearer\s",
    r"auth[_\s-]?token", r"access[_\s-]?key", r"secret[_\s-]?key",
)
#: Subjects that are the assistant and its surroundings.
OWN_SUBJECTS = ("document", "agent", "bot", "environment", "user_note", "system", "model", "plugin")
OWN_PARTS = (" vibe", " identity")
TOOL_LIST = r"cc_\w+.*cc_\w+"


def is_junk(subject: Column, predicate: Column, value: Column, confidence: Column) -> Column:
    """Claims about messages, paths and addresses, and those of little confidence."""
    s, p, v = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (subject, predicate, value))
    return (
        (s.isin(*META_SUBJECTS) & p.isin(*META_PREDICATES)) | v.rlike(f"(?i){PATHS}") | s.rlike(f"(?i){PATHS}") | s.rlike("^(http|https|ftp)://")
        | v.rlike(RELATIVE) | (F.coalesce(confidence, F.lit(0.0)) < LEAST_CONFIDENCE) | p.isin(*SENDING) | ((p == "states") & s.isin(*STATING))
    )


def is_sensitive(subject: Column, predicate: Column, value: Column) -> Column:
    """Claims that speak of passwords, keys and the like."""
    said = F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(predicate, F.lit("")), F.coalesce(value, F.lit(""))))
    return said.rlike("|".join(SENSITIVE))


def is_meta(subject: Column, value: Column, names: tuple[str, ...] = ()) -> Column:
    """Claims about the assistant, its tools and ``names`` (of the installation)."""
    s = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    parts = F.contains(s, F.lit(OWN_PARTS[0])) | F.contains(s, F.lit(OWN_PARTS[1]))
    return s.isin(*OWN_SUBJECTS, *(n.lower() for n in names)) | parts | F.lower(F.coalesce(value, F.lit(""))).rlike(TOOL_LIST)
