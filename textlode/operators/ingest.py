"""Ingest from files to stored documents, chunks, metadata and references, as one change of a store.

A store's tables: ``documents`` (document_id, path, content_hash, mtime, size, kind, title, tags, aliases), ``chunks``
(document_id, position, prefix, text, tokens, content_hash, parent), ``metadata`` (document_id, key, value) and
``links`` (document_id, target). A batch is judged against the store as it was, and files with one content among themselves in the order
of their paths. The new store is returned whole; what did not change is not read beyond its keys. Empty tables are fine on either side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators.chunking import chunk_lists
from textlode.sources import documents as parsers
from textlode.sources.shared import durable
from textlode.sources.shared import stored as stored_table

MOST_BYTES = 100_000_000
#: Fixed value: texts that parsers leave where they failed.
PLACEHOLDER = r"^\[(PDF|DOCX|PPTX|EPUB|Image|Audio):\s.*(—|--)\s*(parse failed|no text detected|no speech detected|OCR failed|OCR unavailable|transcription failed|transcription disabled|file not found|file too large|Whisper not installed)"
SCHEMAS = {
    "documents": "document_id string, path string, content_hash string, mtime long, size long, kind string, title string, tags array<string>, aliases array<string>",
    "chunks": "document_id string, position int, prefix string, text string, tokens long, content_hash string, parent int", "metadata": "document_id string, key string, value string",
    "links": "document_id string, target string",
}


@dataclass(frozen=True)
class Store:
    documents: DataFrame
    chunks: DataFrame
    metadata: DataFrame
    links: DataFrame


def empty(spark: SparkSession) -> Store:
    return Store(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def judged(files: DataFrame, store: Store, force: bool = False) -> DataFrame:
    """``files`` (path, text, mtime, size) with content_hash, old_id and action: too large, unreadable, duplicate, add or update.

    A file of a known path is a duplicate if its time or content is the same; one of a new path if its content is known, or
    an earlier new path of the batch has it. ``force`` ends these. Files without text are unreadable.
    """
    known = store.documents.select(F.col("path").alias("old_path"), F.col("document_id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    held = store.documents.select(F.col("content_hash").alias("held")).distinct().withColumn("is_held", F.lit(True))
    # all that is asked of a text is known before the joins, so that texts move through them only where the caller reads them
    rows = files.select("path", "text", "mtime", "size", digest(F.col("text")).alias("content_hash"), F.col("text").isNull().alias("no_text"))
    met = rows.join(known, F.col("path") == F.col("old_path"), "left").join(held, F.col("content_hash") == F.col("held"), "left")
    same = (F.col("old_mtime") == F.col("mtime")) | (F.col("old_hash") == F.col("content_hash"))
    new = F.col("old_id").isNull()
    action = F.when(F.col("size") > MOST_BYTES, "too large").when(F.col("no_text"), "unreadable")
    if not force:
        action = action.when(~new & F.coalesce(same, F.lit(False)), "duplicate").when(new & F.col("is_held").isNotNull(), "duplicate")
    met = met.withColumn("action", action.when(new, "add").otherwise("update"))
    if not force:
        # copies among new files: the first path of each content is a small aggregate, whatever their number
        first = met.filter("action = 'add'").groupBy(F.col("content_hash").alias("of")).agg(F.min("path").alias("first"))
        met = met.join(first, F.col("content_hash") == F.col("of"), "left").withColumn("action", F.when((F.col("action") == "add") & (F.col("path") != F.col("first")), "duplicate").otherwise(F.col("action")))
    return met.select("path", "text", "mtime", "size", "content_hash", "old_id", "action")


def ingested(files: DataFrame, store: Store, tags: tuple[str, ...] = (), force: bool = False, near: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, Store]:
    """Each file's outcome (path, action, chunks, dropped), the counters (added, updated, chunks, duplicates), and the new store.

    Files that no parser reads, placeholders and files without chunks have actions of their own (failed, empty) and change nothing.
    ``near`` gets the chunks (document_id, position, text) and returns those (document_id, position) that are near copies: they are
    dropped, but an update keeps its first chunk; a new document without any other is a duplicate.
    """
    # texts move once, to what is wanted of them, and one copy of them is kept: the chunks, in the row of their document
    seen = durable(judged(files, store, force).drop("text"))
    keep = ("mtime", "size", "content_hash", "old_id", "action")
    wanted = seen.filter("action IN ('add', 'update')").select("path", *keep)
    parsed = parsers.parsed(files.select("path", "text").join(wanted, "path"), keep)
    failed_ = F.col("problem").isNotNull() | F.coalesce(F.trim("text").rlike(PLACEHOLDER), F.lit(False))
    name = F.substring(F.sha2(F.concat_ws("\0", "path", "content_hash"), 256), 1, 32)
    marks = F.transform(F.filter("structure", lambda s: s["type"] == "heading"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["level"].alias("level")))
    read = parsed.filter(~failed_).withColumn("document_id", name).withColumn("stored_kind", F.col("kind")).withColumn("kind", F.coalesce("kind", F.lit("text"))).withColumn("headings", marks)
    made = chunk_lists(read, ["document_id", "path", "stored_kind", "title", "author", "date", "tags", "aliases", "links", *keep]).withColumnRenamed("stored_kind", "kind")
    made = stored_table(made.withColumn("made", F.size("chunks").cast("long")))
    if near is not None:
        every = made.select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.position", "c.text")
        copied = durable(near(every).select("document_id", F.col("position").cast("int").alias("position")).groupBy("document_id").agg(F.collect_set("position").alias("copied")))
        made = made.join(copied, "document_id", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<int>")))
    else:
        made = made.withColumn("copied", F.array().cast("array<int>"))
    is_copy = lambda position: F.array_contains("copied", position)
    action = F.when(F.col("made") == 0, "empty").when((F.col("action") == "add") & (F.col("copies") == F.col("made")), "duplicate").otherwise(F.col("action"))
    made = made.withColumn("copies", F.size(F.filter("chunks.position", is_copy))).withColumn("action", action)
    all_copies = (F.col("copies") == F.col("made")) & (F.col("action") == "update")
    stays = lambda position: ~is_copy(position) | (all_copies & (position == 0))
    docs = durable(made.withColumn("chunks", F.size(F.filter("chunks.position", stays)).cast("long")).drop("copied"))
    is_stored = F.col("action").isin("add", "update")
    stored = docs.filter(is_stored)
    kept = made.filter(is_stored).select("document_id", F.filter("chunks", lambda c: stays(c["position"])).alias("kept"))
    kept = kept.select("document_id", F.posexplode("kept").alias("i", "c"), F.col("kept.position").alias("places")).withColumn("parent", F.when(F.col("i") > 0, F.get("places", F.col("i") - 1)))
    kept = kept.select("document_id", "c.position", "c.prefix", "c.text", "c.tokens", digest(F.col("c.text")).alias("content_hash"), "parent")

    result = docs.select(F.col("path").alias("p"), F.col("action").alias("done"), F.when(is_stored, F.col("chunks")).otherwise(0).alias("chunks"), "made")
    outcome = seen.select("path", "action").join(result, F.col("path") == F.col("p"), "left")
    failed = F.when(F.col("action").isin("add", "update"), F.coalesce("done", F.lit("failed"))).otherwise(F.col("action"))
    dropped = F.when(failed.isin("add", "update", "duplicate"), F.coalesce(F.col("made") - F.col("chunks"), F.lit(0))).otherwise(0)
    outcome = durable(outcome.select("path", failed.alias("action"), F.coalesce("chunks", F.lit(0)).alias("chunks"), dropped.alias("dropped")))
    one = lambda a: F.count(F.when(F.col("action") == a, 1))
    # a file that is a duplicate as a whole counts once, one whose chunks all are by its chunks
    whole_files = F.count(F.when((F.col("action") == "duplicate") & (F.col("dropped") == 0), 1))
    counters = outcome.agg(one("add").alias("added"), one("update").alias("updated"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), (whole_files + F.coalesce(F.sum("dropped"), F.lit(0))).alias("duplicates"))

    merged = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)).cast("array<string>"), T.auto_tags(F.col("path"))))
    documents = stored.select("document_id", "path", "content_hash", "mtime", "size", "kind", "title", merged.alias("tags"), "aliases")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.array(pair("fileType", F.col("kind")), pair("title", F.col("title")), pair("author", F.col("author")), pair("date", F.col("date")))
    tagged = F.transform(merged, lambda t: F.struct(F.concat(F.lit("tag:"), t).alias("key"), t.alias("value")))
    metadata = stored.select("document_id", F.explode(F.concat(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""), tagged)).alias("e")).select("document_id", "e.*")
    links = stored.select("document_id", F.explode(F.array_distinct(F.transform("links", lambda x: x["target"]))).alias("target"))
    gone = durable(stored.filter("action = 'update'").select(F.col("old_id").alias("document_id")).distinct())
    rest = lambda df, new: df.join(gone, "document_id", "left_anti").unionByName(new)
    new = Store(rest(store.documents, documents), rest(store.chunks, kept), rest(store.metadata, metadata), rest(store.links, links))
    return outcome, counters, new


def references(store: Store) -> DataFrame:
    """source, target: documents whose links name another one, by its file's name without its end, else by an alias; case does not count.

    Of several documents of one name the first path counts. Links to nothing or to the document itself are none.
    """
    d = store.documents
    stem = F.lower(F.regexp_replace(T.file_name(F.col("path")), r"\.[^.]+$", ""))
    first = lambda df: df.groupBy("name").agg(F.min_by("document_id", "path").alias("target"))
    names = first(d.select(stem.alias("name"), "document_id", "path"))
    aliases = first(d.select(F.explode("aliases").alias("alias"), "document_id", "path").select(F.lower("alias").alias("name"), "document_id", "path"))
    asked = store.links.select(F.col("document_id").alias("source"), F.lower(F.trim("target")).alias("link"))
    met = asked.join(names.select(F.col("name").alias("n"), F.col("target").alias("by_name")), F.col("link") == F.col("n"), "left").join(aliases.select(F.col("name").alias("a"), F.col("target").alias("by_alias")), F.col("link") == F.col("a"), "left")
    return met.select("source", F.coalesce("by_name", "by_alias").alias("target")).filter("target IS NOT NULL AND source <> target").distinct()


def stale(files: DataFrame, store: Store, most: int | None = None) -> DataFrame:
    """path of stored documents whose file (path, mtime) is newer, the longest outdated first, at most ``most``."""
    old = store.documents.select("path", F.col("mtime").alias("stored"))
    late = files.select("path", "mtime").join(old, "path").filter("mtime > stored").orderBy(F.desc(F.col("mtime") - F.col("stored")), "path")
    return (late if most is None else late.limit(most)).select("path")
