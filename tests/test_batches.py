import pyarrow as pa
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.functions.batches import SLICE_BYTES, SLICE_ROWS, flat_map, slices
from textlode.sources import documents


def test_slices_are_small_and_whole():
    texts = ["x" * (i % 7 * 1000) for i in range(3000)] + ["y" * 3 * SLICE_BYTES, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    parts = list(slices(batch))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= SLICE_ROWS and p.nbytes <= SLICE_BYTES for p in parts)
    assert list(slices(batch.slice(0, 0))) == []


def test_flat_map_gives_all_rows(spark):
    def make(k):
        made.append(k)
        return [(k, len(made))]

    made: list[int] = []
    found = flat_map(spark.range(5000, numPartitions=1), make, "k long, made int")
    assert found.agg(F.count("*"), F.countDistinct("k"), F.max("made")).first() == (5000, 5000, 5000)
    assert flat_map(spark.range(0), make, "k long, made int").count() == 0


def test_parsed_files_keep_columns_with_nulls(spark):
    rows = [(f"a{i}.txt", "t" * (i % 5), None if i % 3 else i, None if i % 2 else f"n{i}") for i in range(1000)]
    files = spark.createDataFrame(rows, "path string, text string, mtime long, note string").coalesce(1)
    found = documents.parsed(files, ("mtime", "note")).select("path", "text", "mtime", "note")
    assert {r.path: tuple(r) for r in found.collect()} == {r[0]: r for r in rows}


def test_script_language_reads_a_text_once_a_script(spark):
    rows = [("en", "plain words"), ("zh", "汉语文本没有空格"), ("ru", "русский текст"), ("ar", "هذا نص"), ("ko", "한국어"), ("hi", "हिन्दी"), ("unknown", "12345 - 67"), ("unknown", ""), (None, None), ("en", "ab 汉语"), ("en", "abc 汉语文")]
    found = spark.createDataFrame(rows, "want string, text string").select("want", T.script_language(F.col("text")).alias("got"))
    assert [r for r in found.collect() if r.want != r.got] == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") <= 6
