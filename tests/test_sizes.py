"""Faults that showed at size, on small rows."""

import datetime

from graphloom import model
from graphloom.operators import graph, ingest
from pyspark.sql import functions as F


def test_inference_has_no_end_before_its_fixpoint(spark):
    n = 1100  # more hops than ten doublings reach
    e = spark.range(n).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.lit("supersedes").alias("rel_type"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    made, rounds = graph.infer(e, [graph.RULES[3]])
    assert made.count() == n * (n + 1) // 2 - n
    assert len(rounds) == 12 and sum(sum(r.values()) for r in rounds) == n * (n + 1) // 2 - n


def test_notes_of_one_path_stay_apart(spark):
    import __spark_entry__ as entry

    text = "---\ntitle: A\n---\nsame"
    notes = spark.createDataFrame([(1, "p/a.md", text), (2, "p/a.md", text), (3, "p/a.md", "other")], "doc_id long, path string, raw string")
    got = [(r.doc_id, r.title, r.content) for r in ingest.parse_notes(notes).orderBy("doc_id").collect()]
    assert got == [(1, "A", "same"), (2, "A", "same"), (3, "a", "other")]
    from graphloom.queries_more import s16_parse_notes

    class Tables:
        pass

    t = Tables()
    t.notes = notes
    assert sorted(r.doc_id for r in s16_parse_notes(t).collect()) == [1, 2, 3]
    assert "s16_parse_notes" in entry.queries()


def test_windows_take_whole_seconds_as_their_sql(spark, tmp_path):
    import __spark_entry__ as entry
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = [datetime.datetime(2024, 1, 5, 23, 59, 59, us) for us in (400_000, 500_000, 600_000)] + [datetime.datetime(2024, 1, 5, 23, 59, 58, 500_000)]
    times = [(u, t) for u, t in enumerate(at) for _ in range(9)]
    table = pa.table({
        "event_id": pa.array(range(len(times)), pa.int64()), "ts": pa.array([t for _, t in times], pa.timestamp("us")), "user_id": pa.array([u for u, _ in times], pa.int64()),
        "event_type": ["error"] * len(times), "value": [1.0] * len(times), "props": ["{}"] * len(times),
    })
    pq.write_table(table, tmp_path / "events.parquet")
    got = sorted(map(tuple, entry.queries()["k3_stream_pattern_window"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert got == sorted(duck.execute(entry.oracle_sql()["k3_stream_pattern_window"]).fetchall()) and len(got) == 4 * 14


def test_closures_send_no_pairs_through_the_driver(spark):
    e = spark.createDataFrame([(f"n{i}", "supersedes", f"n{i + 1}", 1.0, "") for i in range(20)], model.EDGES)
    o = spark.range(21).select(F.concat(F.lit("n"), F.col("id")).alias("id"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    out = graph.evolution(e, o)
    assert out.count() == 21 * 21 and out.select("origin", "id").distinct().count() == 21 * 21
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_batches_are_worked_in_slices_of_tokens():
    import pyarrow as pa
    from graphloom.functions import text as X

    sizes = [0, 3, X.BATCH_TOKENS + 5, 1, X.BATCH_TOKENS - 1, 0, X.BATCH_TOKENS, 2]
    offsets = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    words = pa.DictionaryArray.from_arrays(pa.array([i % 3 for i in range(offsets[-1])], pa.int32()), pa.array(["running", "Ponies", "x"])).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
    parts = list(X.by_tokens(pa.RecordBatch.from_arrays([lists], ["t"]), ["t"]))
    assert pa.concat_arrays([p.column("t") for p in parts]).equals(lists)
    assert all(p.num_rows == 1 or len(p.column("t").flatten()) <= X.BATCH_TOKENS for p in parts) and len(parts) > 3
    got = X._stemmed(lists.slice(1, 3))
    assert got.value_lengths().to_pylist() == sizes[1:4] and got[0].as_py() == [X.porter(X.fold(w)) for w in lists[1].as_py()]


def test_many_rows_that_fail_need_no_more_jobs_than_one(spark, monkeypatch):
    from graphloom.plans import pipeline

    def work(key: str) -> str:
        if int(key) % 3 == 0:
            raise ValueError("no")
        return "one"

    stages = 0

    def first(o, _):
        nonlocal stages
        stages += 1
        return o.withColumn("g", pipeline.guarded(work)("id")).withColumn("stage", F.col("g.value")).withColumn(pipeline.ERROR, F.col("g.error")).drop("g")

    rows = spark.range(90).select(F.col("id").cast("string").alias("id"), F.lit("ingest").alias("stage"))
    out, status, held = pipeline.run_isolated([("first", first)], rows)
    assert {r.id: r.stage for r in out.collect()} == {str(i): "ingest" if i % 3 == 0 else "one" for i in range(90)}
    assert stages == 1 and status["first"] == "partial: 30 quarantined"
    assert sorted((int(r.id), r.stage, r.error) for r in held.collect()) == [(i, "first", "no") for i in range(0, 90, 3)]
    assert pipeline.run_isolated([("first", first)], rows, most_bad=29)[1]["first"].startswith("failed")


def test_likest_names_equal_brute_force():
    import difflib
    import random

    import pyarrow as pa
    from graphloom.functions import text as X

    rng = random.Random(4)
    known = list(dict.fromkeys("".join(rng.choice("abcd 12") for _ in range(rng.choice([1, 2, 5, 12, 40, 63, 64, 65, 90]))) for _ in range(150)))

    def changed(s):
        t = list(s)
        for _ in range(rng.randint(1, 8)):
            t.insert(rng.randrange(len(t) + 1), rng.choice("abcd 12")) if rng.random() < 0.5 or not t else t.pop(rng.randrange(len(t)))
        return "".join(t)

    asked = list(dict.fromkeys(c for c in (changed(rng.choice(known)) for _ in range(300)) if c and c not in known))
    want = {}
    for a in asked:
        r, b = max((difflib.SequenceMatcher(None, a, b).ratio(), b) for b in known)
        if r > 0.8:
            want[a] = (b, r)
    got = X.likest(pa.chunked_array([asked]), pa.chunked_array([known]), 0.8).to_pylist()
    assert {r["a"]: (r["b"], r["ratio"]) for r in got} == want and len(want) > 50
    assert X.likest(pa.chunked_array([[]], pa.string()), pa.chunked_array([known]), 0.8).num_rows == 0


def test_only_links_unlike_their_titles_meet_all_of_them(spark, monkeypatch):
    import difflib
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    names = [" ".join(word() for _ in range(rng.randint(1, 14)))[:60].strip() for _ in range(60)]
    names += [n[:-1] + "q" for n in names[:15]] + [n + "z" for n in names[10:25]] + ["ab", "and and and and and and and and and"]
    names = list(dict.fromkeys(names))
    targets = list(dict.fromkeys(n[:12] + "x" + n[12:] for n in names)) + [n[1:] for n in names[30:40]] + [n[3:8] + n[12:] for n in names[40:50]]
    targets = [t.strip() for t in targets if t.strip() and t.strip() not in names]
    known = spark.createDataFrame([(n,) for n in names], "b string")
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "a string")
    less = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
    pairs = {(t, n) for t in targets for n in names if n in less(t) or t in less(n)}
    assert {(r.a, r.b) for r in ingest.one_apart(asked, known).collect()} == pairs and len(pairs) > len(names)
    in_blocks = []
    whole = ingest.likest_in_blocks
    monkeypatch.setattr(ingest, "likest_in_blocks", lambda a, b, n_asked, n_known, least: in_blocks.append((n_asked, n_known)) or whole(a, b, n_asked, n_known, least))
    objects = spark.createDataFrame([(n, n, datetime.datetime(2024, 1, 1)) for n in names], "id string, title string, created_at timestamp")
    links = spark.createDataFrame([("s", t) for t in dict.fromkeys(targets)], "src string, target string")
    got = {r.target: r.id for r in ingest.resolve_links(links, objects).collect()}
    ((n_asked, n_known),) = in_blocks
    assert n_known == len(names) and 0 < n_asked < len(got) / 3
    for t in got:
        ratio, name = max((difflib.SequenceMatcher(None, t, n).ratio(), n) for n in names)
        assert got[t] == (name if ratio > 0.8 else None), t


def test_titles_are_cut_before_texts_are_moved(spark):
    from graphloom.sources.mapping import Sample

    whole = Sample(spark, "/root/testdata/sf0.001")
    cut = whole.titled()
    columns = ("id", "title", "created_at")
    assert sorted(map(str, cut.objects.select(*columns).collect())) == sorted(map(str, whole.objects.select(*columns).collect()))
    assert cut.table("documents").selectExpr("max(length(text))").first()[0] == 60 < whole.table("documents").selectExpr("max(length(text))").first()[0]
