"""Running values by ranges, closures by doubling and the ordered change log against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.api import Engine
from graphloom.operators import graph, temporal
from graphloom.operators.ranges import carry


def _brute(rows, keys, order, values, exclusive):
    """{row: (carried, nth)}"""
    out, held, nth = {}, {}, {}
    for r in sorted(rows, key=lambda r: tuple(r[o] for o in order)):
        k = tuple(r[x] for x in keys)
        nth[k] = nth.get(k, 0) + 1
        before = dict(held.get(k, {}))
        held.setdefault(k, {}).update({v: r[v] for v in values if r[v] is not None})
        seen = before if exclusive else held[k]
        out[r["i"]] = (tuple(seen.get(v) for v in values), nth[k])
    return out


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("keys", [["k"], [], ["k", "j"]])
def test_carry_equals_a_walk(spark, keys, exclusive):
    rng = random.Random(6)
    rows = [{"i": i, "k": rng.choice([None, "hot", "hot", "hot", "a", "b"]), "j": rng.randint(0, 1), "at": rng.randint(0, 90) if i % 3 else 7, "x": rng.choice([None, None, i]), "y": rng.choice([None] * 9 + [f"v{i}"])} for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, k string, j int, at int, x int, y string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.i: (tuple(r.carried), r.nth) for r in carry(frame, keys, [F.col("at"), F.col("i")], ["x", "y"], exclusive).collect()}
        assert carry(frame.limit(0), keys, [F.col("at")], ["x"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == _brute(rows, keys, ["at", "i"], ["x", "y"], exclusive)


def test_as_of_with_all_rows_in_one_second(spark):
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, at + datetime.timedelta(microseconds=i // 50), f"t{i}") for i in range(500)], "event_id int, ts timestamp, tool string")
    events = spark.createDataFrame([(i, at + datetime.timedelta(microseconds=i % 12)) for i in range(700)], "event_id int, ts timestamp")
    got = {r.event_id: r.prev.tool for r in temporal.latest_before(events.repartition(5), log.repartition(3), None).collect()}
    assert got == {i: f"t{min(499, (i % 12) * 50 + 49)}" for i in range(700)}


def _hops(pairs, most=None):
    out = {}
    nodes = {x for p in pairs for x in p}
    near = {n: [b for a, b in pairs if a == n and b != n] for n in nodes}
    for n in nodes:
        front, seen, hop = [n], {n}, 0
        while front and (most is None or hop < most):
            hop += 1
            front = [b for a in front for b in near[a] if b not in seen and not seen.add(b)]
            out.update({(n, b): hop for b in front})
    return out


@pytest.mark.parametrize("most", [None, 1, 5, 10])
def test_closure_by_doubling(spark, most):
    rng = random.Random(9)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"g{rng.randint(0, 20)}", f"g{rng.randint(0, 20)}") for _ in range(30)] + [("c5", "r2"), ("s", "s")]
    got = {(r.src, r.dst): r.hop for r in graph.closure(spark.createDataFrame(pairs, "src string, dst string"), most).collect()}
    assert got == _hops(pairs, most)


def test_rounds_of_a_long_chain_grow_with_its_logarithm(spark, monkeypatch):
    n, written = 300, []
    monkeypatch.setattr(graph, "stored", lambda df, name, f=graph.stored: written.append(name) or f(df, name))
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.closure(chain).count() == n * (n + 1) // 2 and len(written) <= 11


def test_chains_of_all_objects_equal_those_of_each(spark):
    rows = [("b", "causedBy", "a"), ("c", "causedBy", "b"), ("a", "ledTo", "b"), ("b", "ledTo", "c"), ("c", "supersedes", "b"), ("b", "supersedes", "a")]
    edges = spark.createDataFrame([(*r, 1.0, "") for r in rows], model.EDGES)
    objects = spark.createDataFrame([(x, datetime.datetime(2024, 1, i + 1)) for i, x in enumerate("abcd")], "id string, created_at timestamp")
    every = sorted(tuple(r) for r in graph.causal_chain(edges, objects).collect())
    each = sorted(tuple(r) for x in "abcd" for r in graph.causal_chain(edges, objects, objects.where(F.col("id") == x).select("id")).collect())
    assert every == each
    every = sorted(tuple(r) for r in graph.evolution(edges, objects).collect())
    each = sorted(tuple(r) for x in "abcd" for r in graph.evolution(edges, objects, objects.where(F.col("id") == x).select("id")).collect())
    assert every == each and len(every) == 10


def test_changes_are_applied_one_after_another(spark):
    rng = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    objects = spark.createDataFrame([(f"o{i}", f"T{i}", "", "fix", t0) for i in range(6)], "id string, title string, project string, type string, updated_at timestamp")
    log = [(f"o{rng.randint(0, 8)}", s, t0 + datetime.timedelta(hours=s // 3), "delete" if rng.random() < 0.15 else "set", rng.choice([None, "", f"t{s}"]), rng.choice([None, f"p{s}"])) for s in range(120)]
    frame = spark.createDataFrame(log, "id string, seq long, at timestamp, op string, title string, project string").repartition(5)
    now, old = temporal.fold(objects, frame, ("title", "project"))
    state = {r.id: {**r.asDict(), "from": r.updated_at} for r in objects.collect()}
    number, versions = {i: 1 for i in state}, []
    for i, _, at, op, title, project in sorted(log, key=lambda r: r[1]):
        if i in state:
            versions.append((i, number[i], state[i]["title"], state[i]["project"], state[i]["from"], at))
        number[i] = number.get(i, 0) + 1
        if op == "delete":
            state.pop(i, None)
            continue
        s = state.setdefault(i, {"title": None, "project": None, "type": None})
        s |= {c: v for c, v in (("title", title), ("project", project)) if v} | {"from": at}
    assert {(r.id, r.title, r.project, r.type, r.updated_at) for r in now.collect()} == {(i, s["title"], s["project"], s["type"], s["from"]) for i, s in state.items()}
    assert sorted((r.id, r.version_num, r.title, r.project, r.valid_from, r.valid_to) for r in old.collect()) == sorted(versions, key=lambda v: v[:2])


def test_two_updates_in_one_batch_make_two_versions(spark):
    from tests.test_engine import objects as made

    o = made(spark, a="Old", b="B").withColumn("updated_at", F.col("created_at"))
    nothing = lambda schema: spark.createDataFrame([], schema)
    engine = Engine(o, nothing(model.EDGES), nothing(model.ENTITIES), nothing(model.MENTIONS))
    changes = spark.createDataFrame([("a", 1, "Zed"), ("a", 2, "Abe"), ("gone", 1, "X")], "id string, seq long, title string")
    new = engine.update(changes, F.timestamp_seconds(F.lit(1_800_000_000)))
    assert {(r.id, r.title) for r in new.objects.collect()} == {("a", "Abe"), ("b", "B")}
    assert [(r.version_num, r.title) for r in new.history.orderBy("version_num").collect()] == [(1, "Old"), (2, "Zed")]
    again = new.update(changes.where("seq = 1"), F.timestamp_seconds(F.lit(1_800_000_100)))
    assert [(r.version_num, r.title) for r in again.history.orderBy("version_num").collect()] == [(1, "Old"), (2, "Zed"), (3, "Abe")]


def test_rows_that_fail_at_run_time_fail_alone(spark):
    from graphloom.plans import pipeline

    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("ingest").alias("stage"))
    bad = F.col("id").isin("7", "41")
    broken = lambda o, _: o.withColumn("stage", F.when(bad, F.raise_error(F.lit("no")).cast("string")).otherwise("one"))
    counted = lambda o, every: o.withColumn("stage", F.concat("stage", F.lit("+two"))).crossJoin(every.agg(F.count("*").alias("n")))
    out, status, held = pipeline.run_isolated([("first", broken), ("second", counted)], rows)
    got = {r.id: (r.stage, r.n) for r in out.collect()}
    assert got == {str(i): ("ingest", None) if i in (7, 41) else ("one+two", 58) for i in range(60)}
    assert status == {"first": "partial: 2 quarantined", "second": "ok", "pipeline": "partial"}
    assert sorted((r.id, r.stage) for r in held.collect()) == [("41", "first"), ("7", "first")] and all("no" in r.error for r in held.collect())


def test_a_stage_that_is_broken_leaves_all_rows_as_they_were(spark):
    from graphloom.plans import pipeline

    rows = spark.range(20).select(F.col("id").cast("string").alias("id"))
    always = lambda o, _: o.withColumn("x", F.raise_error(F.lit("broken")))
    out, status, held = pipeline.run_isolated([("bad", always), ("worse", lambda o, _: o.select("nothing")), ("good", lambda o, _: o.withColumn("y", F.lit(1)))], rows)
    assert out.columns == ["id", "y"] and out.count() == 20 and held.count() == 0
    assert status["bad"].startswith("failed") and status["worse"].startswith("failed") and status["good"] == "ok" and status["pipeline"] == "partial"
    assert pipeline.run_isolated([("good", lambda o, _: o)], rows.limit(0))[0].count() == 0


def test_links_are_proposed_to_the_newest_objects_before(spark):
    from graphloom.operators import ingest

    rng = random.Random(2)
    rows = [(f"o{i}", datetime.datetime(2024, 1, rng.randint(1, 9))) for i in range(40)]
    objects = spark.createDataFrame(rng.sample(rows, 40), "id string, created_at timestamp").repartition(3)
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    expected = {(x, order[k - d], d) for k, x in enumerate(order) for d in range(1, 6) if k >= d}
    assert {tuple(r) for r in ingest.link_candidates(objects, n=5).collect()} == expected
    new = objects.where("id IN ('o3', 'o7')")
    assert {tuple(r) for r in ingest.link_candidates(objects, new, 5).collect()} == {e for e in expected if e[0] in ("o3", "o7")}
    far = next(x for x in order if ("o3", x) not in {e[:2] for e in expected} and (x, "o3") not in {e[:2] for e in expected} and x != "o3")
    near = next(e[1] for e in expected if e[0] == "o3")
    found = [("o3", "supports", near, 0.9), (near, "ledTo", "o3", 0.8), ("o3", "supports", near, 0.6), ("o3", "likes", near, 0.9), ("o3", "supports", "o3", 0.9), ("o3", "supports", far, 0.9), ("o3", "supports", "none", 0.9), ("o3", "causedBy", near, 0.5)]
    made = ingest.proposed_links(objects, new.where("id = 'o3'"), lambda _: spark.createDataFrame(found, "src string, rel_type string, dst string, confidence double"), 5)
    assert {tuple(r) for r in made.collect()} == {("o3", "supports", near, 0.9), (near, "ledTo", "o3", 0.8)}
    assert ingest.link_candidates(objects.limit(0)).count() == 0
