from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenseek.config import Settings
from lumenseek.plans.engine import CodeSearch, SearchParams
from lumenseek.providers.embedding import HashProvider
from lumenseek.sources import files as fs
from lumenseek.sources.chunk_store import ChunkStore, DimensionMismatch
from lumenseek.streaming import change_feed as feed

ROW = ("id string, file_path string, start_line int, end_line int, text string, type string, language string, "
       "timestamp bigint, chunk_index_in_file int, vector array<float>")


def rows(spark, *items):
    return spark.createDataFrame([(f"{p}:{n}", p, n, n, t, "block", "ts", 0, 0, v) for p, n, t, v in items], ROW)


def texts(store):
    return sorted((r.file_path, r.text) for r in store.read().collect())


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "index"), buckets=4)


def test_insert_drops_rows_without_vector_and_appends(spark, store):
    assert not store.is_ready() and store.read().count() == 0 and store.storage_size() == 0
    batch = rows(spark, ("a", 1, "x", [1.0]), ("b", 1, "y", []), ("c", 1, "z", None))
    store.insert(batch)
    assert texts(store) == [("a", "x")] and store.is_ready()
    store.insert(batch)
    assert texts(store) == [("a", "x"), ("a", "x")]
    stats = store.stats()
    assert (stats.chunk_count, stats.file_count) == (2, 1) and stats.storage_size > 0
    assert [r.text for r in store.file_rows("a").collect()] == ["x", "x"]


def test_upsert_and_delete(spark, store):
    store.insert(rows(spark, *[(f"f{i}", 1, "old", [1.0]) for i in range(12)]))
    changed = spark.createDataFrame([("f1",), ("f2",), ("f2",), ("new",)], "file_path string")
    store.upsert(changed, rows(spark, ("f1", 1, "new", [1.0]), ("new", 1, "new", [1.0])))
    want = sorted([(f"f{i}", "old") for i in range(12) if i not in (1, 2)] + [("f1", "new"), ("new", "new")])
    assert texts(store) == want
    store.delete_files(store.read().select("file_path"))
    assert texts(store) == []


def test_replacement_is_finished_after_a_crash(spark, store, monkeypatch):
    store.insert(rows(spark, *[(f"f{i}", 1, "old", [1.0]) for i in range(6)]))

    def crash(staged):
        raise RuntimeError("killed")

    paths = spark.createDataFrame([(f"f{i}",) for i in range(6)], "file_path string")
    monkeypatch.setattr(store, "_apply", crash)
    with pytest.raises(RuntimeError):
        store.upsert(paths, rows(spark, ("f0", 1, "new", [1.0])))
    monkeypatch.undo()
    assert len(texts(store)) == 6
    store.recover()
    assert texts(store) == [("f0", "new")]
    store.recover()


def test_metadata_and_dimension(spark, store):
    assert store.metadata() is None
    first = store.set_metadata(1, "m", "p")
    again = store.set_metadata(1, "m2", "p")
    assert again.created_at == first.created_at and again.model == "m2" and store.metadata() == again
    with pytest.raises(DimensionMismatch):
        store.check_dimension(2)
    with pytest.raises(Exception, match="differs from the index dimension"):
        store.insert(rows(spark, ("a", 1, "x", [1.0, 2.0])))
    store.clear()
    assert store.metadata() is None and not store.exists()


def test_deleting_stays_inside_the_store(store):
    with pytest.raises(ValueError):
        store._delete("/tmp/other")


@pytest.fixture
def workspace(tmp_path):
    root = tmp_path / "my ws+1"
    for name, text in {
        "src/auth.ts": "export function validatePassword(password: string): boolean {\n  return password.length >= 8;\n}\n",
        "src/api.js": "// fetch the user\nasync function fetchUserData(userId) {\n  return get(userId);\n}\n\nconst a = 1;\nconst b = 2;\n",
        "src/tool.py": "def f():\n    pass\n", "src/empty.ts": "", "src/blank.ts": "  \n", "src/.hidden.ts": "let h = 1;",
        "node_modules/lib.ts": "let no = 1;", ".git/x.ts": "let no = 1;", "src/big.ts": "let big = 1;\n" * 200,
        "src/style.css": ".a {}\n", "src/view.vue": "<template>\n</template>\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_folder_scan(spark, workspace):
    files = fs.list_files(spark, workspace)
    names = sorted(r.file_path[len(workspace):] for r in files.select("file_path").collect())
    assert names == ["/src/api.js", "/src/auth.ts", "/src/big.ts", "/src/blank.ts", "/src/tool.py", "/src/view.vue"]
    totals = fs.scan_totals(files, 1024).first()
    assert (totals.files, totals.skipped_files) == (5, 1)
    reasons = {r.skip_reason: r.files for r in fs.skip_reasons(files, 1024).collect()}
    assert reasons == {"File too large (2.54 KB > 1.00 KB)": 1}
    summary = fs.scan_summary(files, 1024).first().summary
    assert summary.startswith("Found 5 indexable files\nTotal size: ") and "Skipped 1 files:" in summary


def test_size_rules(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 2000), ("c", 0), ("d", None), ("e", 100000), ("f", 100001)],
                               "file_path string, size bigint")
    assert tuple(fs.scan_totals(df, 100000).first()) == (3, 103000, 3)
    got = {r.skip_reason: r.files for r in fs.skip_reasons(df, 100000).collect()}
    assert got == {"Empty file": 1, "File access error": 1, "File too large (97.66 KB > 97.66 KB)": 1}


@pytest.fixture
def engine(spark, tmp_path):
    settings = Settings(embedding_provider="hash", hash_dimensions=32, max_file_size=1024, min_similarity=0.0)
    return CodeSearch(spark, str(tmp_path / "index"), settings, buckets=4)


def test_index_search_update(spark, engine, workspace):
    assert engine.search(SearchParams("x")).error.startswith("Index not initialized")
    seen = []
    report = engine.index_folder(workspace, on_progress=seen.append)
    assert report.success and (report.total_files, report.total_chunks, report.failed_chunks) == (5, 4, 0)
    assert report.errors == [] and report.error_count == 1
    assert [r.error for r in engine.store.errors().collect()] == [
        f"Failed to chunk {workspace}/src/tool.py: Unsupported file extension: py"]
    assert [p.phase for p in seen] == ["scanning", "chunking", "embedding", "storing", "complete"]
    assert [p.percentage for p in seen] == [0, 10, 80, 80, 100]
    assert report.success_rate == 100 and engine.chunk_count() == 4 and engine.is_ready()

    found = engine.search(SearchParams("validate password", limit=5))
    assert found.error is None and found.total_results == len(found.results) > 0
    assert found.results[0]["file_path"].endswith("auth.ts")
    assert [r["rerank_position"] for r in found.results] == list(range(1, len(found.results) + 1))
    hybrid = engine.search(SearchParams("fetchUserData", hybrid=True))
    assert any(r["file_path"].endswith("api.js") for r in hybrid.results)
    only = engine.search(SearchParams("user", chunk_types=["variable"]))
    assert {r["type"] for r in only.results} <= {"variable"}
    assert engine.search(SearchParams("  \n")).error == "Search query cannot be empty"
    assert engine.search_by_file(SearchParams("user"), workspace).first().relative_path.startswith("src/")
    assert engine.search_tree(SearchParams("user"), workspace).count() > 0

    # A second full index replaces; appending duplicates.
    engine.index_folder(workspace)
    assert engine.chunk_count() == 4
    engine.index_folder(workspace, append=True)
    assert engine.chunk_count() == 8
    engine.index_folder(workspace)

    path = f"{workspace}/src/api.js"
    engine.reindex_files(spark.createDataFrame([(path, "class Fresh {\n  go() {}\n}\n")], "file_path string, text string"))
    kinds = [(r.type, r.start_line) for r in engine.store.file_rows(path).orderBy("start_line").collect()]
    assert kinds == [("class", 1), ("function", 2)] and engine.chunk_count() == 4
    engine.reindex_files(spark.createDataFrame([(path, " ")], "file_path string, text string"))
    assert engine.chunk_count() == 2
    engine.delete_files(spark.createDataFrame([(f"{workspace}/src/auth.ts",)], "file_path string"))
    assert engine.stats().file_count == 1

    histogram = engine.chunk_report(fs.list_files(spark, workspace), str(workspace) + "-dump")
    assert {r.type for r in histogram.collect()} == {"export", "function", "variable", "template"}
    dumped = spark.read.json(workspace + "-dump/metadata").first()
    assert dumped.total_chunks == spark.read.json(workspace + "-dump/chunks").count()
    assert not engine.switch_model(engine.settings)
    assert engine.switch_model(engine.settings.with_values(hash_dimensions=16)) and engine.chunk_count() == 0


def test_late_fetch_equals_one_plan(spark, engine, workspace):
    from lumenseek.operators import ranking
    engine.index_folder(workspace)
    query = "load user"
    vector = engine.provider.embed([engine.provider.model.prepare(query, is_query=True)])[0]
    whole = ranking.rerank(ranking.vector_search(engine.store.read(), vector, 3, 0.0), query)
    cols = ["id", "rank", "similarity", "rerank_score", "rerank_position", "text"]
    want = whole.select(cols).orderBy("rerank_position").collect()
    assert engine.search_frame(SearchParams(query, limit=3)).select(cols).orderBy("rerank_position").collect() == want
    cols = [*cols, "rrf", "score"]
    whole = ranking.rerank(ranking.hybrid_search(engine.store.read(), vector, query, 3, 0.0), query)
    want = whole.select(cols).orderBy("rerank_position").collect()
    params = SearchParams(query, limit=3, hybrid=True)
    assert engine.search_frame(params).select(cols).orderBy("rerank_position").collect() == want


def test_duplicate_rows_are_found_as_often_as_stored(spark, engine, workspace):
    engine.index_folder(workspace)
    once = engine.search(SearchParams("user", limit=10)).results
    engine.index_folder(workspace, append=True)
    twice = engine.search(SearchParams("user", limit=10)).results
    assert len(twice) == 2 * len(once) and engine.search(SearchParams("user", limit=3)).total_results == 3
    hybrid = engine.search(SearchParams("user", limit=10, hybrid=True)).results
    assert len({r["id"] for r in hybrid}) == len(hybrid)
    assert engine.search(SearchParams("zzz", min_similarity=1.0)).results == []


def test_hot_file_is_spread_over_tasks(spark, tmp_path):
    """A file with a third of all rows does not end in one task or one file."""
    store = ChunkStore(spark, str(tmp_path / "index"), buckets=4)
    df = spark.range(60000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot.ts").otherwise(F.concat(F.lit("f"), F.col("id") % 50, F.lit(".ts"))).alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(12)]).alias("text"),
        F.lit("block").alias("type"), F.lit("ts").alias("language"), F.lit(0).cast("bigint").alias("timestamp"),
        F.lit(0).alias("chunk_index_in_file"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        store.insert(df)
        assert store.count() == 60000 and store.file_rows("hot.ts").count() == 20000
        per_bucket = {}
        for name in store.read().inputFiles():
            bucket = name.split("bucket=")[1].split("/")[0]
            per_bucket[bucket] = per_bucket.get(bucket, 0) + 1
        assert max(per_bucket.values()) > 3
        store.upsert(spark.createDataFrame([("f1.ts",)], "file_path string"), None)
        assert store.count() == 60000 - df.where("file_path = 'f1.ts'").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_empty_scan_and_no_chunks(spark, engine):
    none = spark.createDataFrame([], "path string, text string")
    assert engine.index_table(none, "path", "text").errors == ["No files found to index"]
    py = spark.createDataFrame([("a.py", "x")], "path string, text string")
    report = engine.index_table(py, "path", "text")
    assert not report.success and report.errors == ["No code chunks extracted"]


CHANGE = "file_path string, ts timestamp, change_id bigint, op string, text string"


def test_change_feed_over_many_batches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "index"), buckets=4)
    inbox, provider = str(tmp_path / "inbox"), HashProvider(8)

    def at(n):
        return dt.datetime(2024, 1, 1, 0, 0, n)

    def send(*changes):
        spark.createDataFrame(list(changes), CHANGE).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(inbox)
        query = feed.start_change_feed(stream, store, provider, str(tmp_path / "cp"), available_now=True)
        query.awaitTermination()
        return texts(store)

    send(("a.ts", at(1), 1, "write", "let a = 1;"), ("a.ts", at(2), 2, "write", "let a = 2;"),
         ("b.ts", at(1), 3, "write", "let b = 1;"), ("c.py", at(1), 4, "write", "x"))
    assert run() == [("a.ts", "let a = 2;"), ("b.ts", "let b = 1;")]
    send(("b.ts", at(5), 5, "delete", None), ("a.ts", at(1), 0, "write", "let late = 0;"))
    send(("d.ts", at(6), 6, "write", "let d = 1;"), ("b.ts", at(4), 7, "write", "let late = 1;"))
    assert run() == [("a.ts", "let a = 2;"), ("d.ts", "let d = 1;")]


def test_latest_change_of_a_hot_path_combines_in_the_map_tasks(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("file_path"),
        F.timestamp_seconds(F.lit(0)).alias("ts"), F.col("id").alias("change_id"), F.lit("write").alias("op"))
    latest = feed.latest_changes(df)
    assert latest.where("file_path = 'hot'").first().change_id == 999
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_bad_bytes_and_all_errors_are_kept(spark, engine, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / "latin.ts").write_bytes(b"// caf\xe9\nconst a = 1;\n")
    for i in range(30):
        (folder / f"f{i}.py").write_text("x = 1\n")
    report = engine.index_folder(str(folder))
    assert report.success and report.total_files == 31 and report.error_count == 30
    assert engine.store.errors().select("file_path").distinct().count() == 30
    assert "\ufffd" in engine.store.read().first().text


def test_number_of_buckets_is_stored(spark, tmp_path, engine, workspace):
    engine.index_folder(workspace)
    path = str(tmp_path / "index")
    assert ChunkStore(spark, path).buckets == 4 and ChunkStore(spark, path).count() == engine.chunk_count()
    with pytest.raises(ValueError, match="has 4 buckets"):
        ChunkStore(spark, path, buckets=16)
    other = CodeSearch(spark, path, engine.settings)
    query = SearchParams("user", limit=10)
    assert [r["id"] for r in other.search(query).results] == [r["id"] for r in engine.search(query).results]
    other.delete_files(engine.store.read().select("file_path").distinct())
    assert engine.chunk_count() == 0


def test_failed_rebuild_keeps_the_old_table(spark, engine, workspace, monkeypatch):
    engine.index_folder(workspace)
    before = sorted(r.id for r in engine.store.read().collect())
    rows = engine.store.read().withColumn("id", F.concat("id", F.lit("-new")))

    def stop(*_):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_point_to", stop)
        with pytest.raises(RuntimeError):
            engine.store.replace_all(rows)
    assert sorted(r.id for r in engine.store.read().collect()) == before
    engine.store.replace_all(rows)
    assert sorted(r.id for r in engine.store.read().collect()) == [f"{i}-new" for i in before]


def test_limit_is_checked(engine, workspace):
    engine.index_folder(workspace)
    assert "outside" in engine.search(SearchParams("user", limit=0)).error
    assert "outside" in engine.search(SearchParams("user", limit=101)).error


class Stopped(RuntimeError):
    pass


STEPS = ("_write_json", "_point_to", "_delete")


@pytest.fixture
def stop_at(monkeypatch):
    """Run something on a store and stop before or after its k-th step; says whether there was such a step."""
    def run(k, after, action):
        count = 0
        with monkeypatch.context() as m:
            for name in STEPS:
                def step(self, *args, _whole=getattr(ChunkStore, name)):
                    nonlocal count
                    count += 1
                    if count == k and not after:
                        raise Stopped(k)
                    mine, done = count, _whole(self, *args)
                    if mine == k:
                        raise Stopped(k)
                    return done
                m.setattr(ChunkStore, name, step)
            try:
                action()
            except Stopped:
                return True
        return False
    return run


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("kind", ["upsert", "rebuild", "insert"])
def test_a_crash_at_any_step_leaves_the_old_or_the_new_table(spark, tmp_path, stop_at, kind, after):
    old = [(f"f{i}", 1, "old", [1.0]) for i in range(6)]
    change = [("f0", 1, "new", [1.0]), ("g", 1, "new", [1.0])]
    touched = spark.createDataFrame([("f0",), ("f1",), ("g",)], "file_path string")
    before = sorted((p, t) for p, _, t, _ in old)
    wanted = {"upsert": sorted([(p, t) for p, t in before if p not in ("f0", "f1")] + [("f0", "new"), ("g", "new")]),
              "rebuild": [("f0", "new"), ("g", "new")], "insert": sorted([*before, ("f0", "new"), ("g", "new")])}[kind]
    k = 1
    while True:
        path = str(tmp_path / f"{kind}-{k}")
        store = ChunkStore(spark, path, buckets=3)
        store.insert(rows(spark, *old))
        new = rows(spark, *change)
        action = {"upsert": lambda: store.upsert(touched, new), "rebuild": lambda: store.replace_all(new), "insert": lambda: store.insert(new)}[kind]
        stopped = stop_at(k, after, action)
        assert texts(ChunkStore(spark, path)) in (before, wanted), k
        again = ChunkStore(spark, path)
        again.recover()
        found = texts(again)
        assert found in (before, wanted), k
        if not stopped:
            assert found == wanted and k > 1
            return
        assert again._names(f"{path}/_staged") == []
        # What was staged is not laid over a table that was rebuilt meanwhile.
        again.replace_all(rows(spark, *[(f"n{i}", 1, "built", [1.0]) for i in range(5)]))
        again.delete_files(spark.createDataFrame([("n3",)], "file_path string"))
        assert texts(again) == [(f"n{i}", "built") for i in (0, 1, 2, 4)], k
        k += 1


def test_rebuild_between_crash_and_recovery_keeps_its_rows(spark, store, monkeypatch):
    store.insert(rows(spark, *[(f"f{i}", 1, "old", [1.0]) for i in range(20)]))
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_apply", lambda *_: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            store.upsert(spark.createDataFrame([("f1",), ("f2",)], "file_path string"), rows(spark, ("f1", 1, "changed", [1.0])))
    store.replace_all(rows(spark, *[(f"n{i}", 1, "new", [1.0]) for i in range(40)]))
    store.delete_files(spark.createDataFrame([("n0",)], "file_path string"))
    assert texts(store) == sorted((f"n{i}", "new") for i in range(1, 40))


@pytest.mark.parametrize("most", [100, 1])
def test_rows_that_stay_are_not_shuffled_for_few_paths(spark, store, monkeypatch, most):
    monkeypatch.setattr("lumenseek.sources.chunk_store.SENT_PATHS", most)
    store.insert(rows(spark, *[(f"f{i}", 1, "old", [1.0]) for i in range(40)]))
    plans, whole = [], store._replaced
    monkeypatch.setattr(store, "_replaced", lambda *a: plans.append(whole(*a)) or plans[-1])
    store.delete_files(spark.createDataFrame([("f0",), ("f1",)], "file_path string"))
    assert texts(store) == sorted((f"f{i}", "old") for i in range(2, 40))
    store.upsert(spark.createDataFrame([("f2",), ("f3",)], "file_path string"), rows(spark, ("f2", 1, "new", [1.0])))
    assert texts(store) == sorted([("f2", "new"), *((f"f{i}", "old") for i in range(4, 40))])
    spread = [p._jdf.queryExecution().optimizedPlan().toString().count("RebalancePartitions") for p in plans]
    assert spread == ([0, 1] if most == 100 else [1, 2])


def test_half_written_version_is_passed_over(spark, store):
    store.insert(rows(spark, ("a", 1, "x", [1.0])))
    fs_, target = store._fs(f"{store.path}/_versions/v000000000099.json")
    fs_.create(target, False).close()
    assert texts(store) == [("a", "x")]
    store.insert(rows(spark, ("b", 1, "y", [1.0])))
    assert texts(store) == [("a", "x"), ("b", "y")] and store._numbers()[-1] == 100
    with pytest.raises(Exception, match="exist"):
        store._write_json(f"{store.path}/_versions/v000000000100.json", {})


def test_readers_keep_the_version_before_a_rebuild(spark, store):
    store.insert(rows(spark, ("a", 1, "x", [1.0])))
    reading = store.read()
    store.replace_all(rows(spark, ("b", 1, "y", [1.0, 2.0])), store.next_metadata(2, "m", "p"))
    assert [r.text for r in reading.collect()] == ["x"]
    assert store.metadata().dimension == 2 and texts(store) == [("b", "y")]
    for _ in range(12):
        store.replace_all(rows(spark, ("c", 1, "z", [1.0, 2.0])))
    assert len([n for n in store._names(store.path) if n.startswith("chunks-")]) == 2 and len(store._numbers()) <= 10
    assert store.metadata().dimension == 2


def test_change_feed_keeps_no_state_and_repeats_a_batch_that_died(spark, tmp_path, monkeypatch):
    store, provider = ChunkStore(spark, str(tmp_path / "index"), buckets=2), HashProvider(8)
    inbox = str(tmp_path / "inbox")
    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    spark.createDataFrame([("a.ts", at(5), 1, "write", "let a = 1;"), ("b.ts", at(5), 2, "delete", None)], CHANGE).write.parquet(inbox)

    def run():
        stream = spark.readStream.schema(CHANGE).parquet(inbox)
        query = feed.start_change_feed(stream, store, provider, str(tmp_path / "cp"), available_now=True)
        query.awaitTermination()
        return query

    with monkeypatch.context() as m:
        m.setattr(feed.BucketedTable, "upsert", lambda self, *a, _whole=feed.BucketedTable.upsert: (
            _whole(self, *a) if isinstance(self, ChunkStore) else (_ for _ in ()).throw(Stopped())))
        with pytest.raises(Exception):
            run()
    assert texts(store) == [("a.ts", "let a = 1;")]
    query = run()
    assert query.lastProgress is None or not query.lastProgress["stateOperators"]
    spark.createDataFrame([("b.ts", at(4), 9, "write", "let b = 1;"), ("a.ts", at(5), 0, "write", "let a = 0;")], CHANGE).write.mode("append").parquet(inbox)
    run()
    assert texts(store) == [("a.ts", "let a = 1;")]
    applied = feed.applied_changes(ChunkStore(spark, store.path), spark.createDataFrame([], CHANGE))
    assert applied.buckets == 2
    store._point_to(feed_version := store._live().__class__(**{**store._live().__dict__, "buckets": 5}))
    assert feed.applied_changes(ChunkStore(spark, store.path), applied.read()).buckets == 2 and feed_version.buckets == 5
    assert sorted((r.file_path, r.change_id) for r in applied.read().collect()) == [("a.ts", 1), ("b.ts", 2)]
