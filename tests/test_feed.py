import json
import random

from textlode.sources import feed


def write(folder, number, changes):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{number:09d}.json").write_text(json.dumps(changes))


def plain(pages):
    held = {}
    for changes in pages:
        for c in changes:
            if c.get("deleted"):
                held.pop(c["id"], None)
            elif c["id"] not in held or c["version"] >= held[c["id"]][0]:
                held[c["id"]] = (c["version"], c.get("name"), c.get("size"))
    return held


def held(spark, path):
    return {r.id: (r.version, r.name, r["size"]) for r in feed.current(spark, str(path)).collect()}


def test_a_restart_reads_on(spark, tmp_path):
    spark.dataSource.register(feed.ChangeFeed)
    rng, pages, seen = random.Random(1), [], tmp_path / "seen"
    source, manifest, checkpoint = tmp_path / "feed", tmp_path / "manifest", str(tmp_path / "checkpoint")
    source.mkdir()

    def run():
        stream = spark.readStream.format("change_feed").option("path", str(source)).load()
        query = feed.keep(stream, str(manifest), checkpoint)
        query.awaitTermination()
        raw = stream.writeStream.format("parquet").option("path", str(seen)).option("checkpointLocation", str(tmp_path / "raw")).trigger(availableNow=True).start()
        raw.awaitTermination()

    for round_ in range(4):
        for _ in range(3):
            version = len(pages)
            changes = [{"id": f"f{i}", "version": version, "deleted": rng.random() < 0.3, "name": f"n{version}.{i}", "size": i} for i in rng.sample(range(20), 6)]
            pages.append(changes)
            write(source, version, changes)
        run()
        assert held(spark, manifest) == plain(pages), round_
    run()  # nothing new
    assert held(spark, manifest) == plain(pages)
    read = sorted((r.page, r.place) for r in spark.read.parquet(str(seen)).collect())
    assert read == [(p, k) for p in range(12) for k in range(6)]  # no page lost, none twice
    assert len(feed.versions(spark, str(manifest))) <= feed.KEPT_VERSIONS


def test_changes_of_one_batch_in_order(spark):
    manifest = spark.createDataFrame([("a", 5, "a5", 1), ("b", 1, "b1", 1), ("c", 1, "c1", 1)], "id string, version long, name string, size long")
    rows = [("a", 4, False, "a4", 1, 0, 0), ("b", 2, False, "b2", 2, 0, 1), ("b", 3, True, None, None, 1, 0), ("d", 1, True, None, None, 1, 1), ("d", 2, False, "d2", 7, 2, 0), ("e", 1, True, None, None, 2, 1)]
    got = {r.id: (r.version, r.name, r["size"]) for r in feed.applied(manifest, spark.createDataFrame(rows, feed.SCHEMA)).collect()}
    assert got == {"a": (5, "a5", 1), "c": (1, "c1", 1), "d": (2, "d2", 7)}
    assert feed.applied(manifest, spark.createDataFrame([], feed.SCHEMA)).count() == 3
