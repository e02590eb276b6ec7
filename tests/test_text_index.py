"""The stored text index against scans of all texts, through changes, replays and planted faults."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.api import Engine
from graphloom.functions import text as X
from graphloom.operators import learn
from graphloom.plans import hybrid
from graphloom.sources import text_index
from graphloom.sources.text_index import TextIndex
from graphloom.streaming import streams

SCHEMA = "id string, type string, project string, title string, content string, tags string"


def _rows(n, seed=4):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta-ray", "été", "x9", "running", "runs"] + [f"w{i}" for i in range(40)]
    text = lambda m: " ".join(rng.choice(words) for _ in range(rng.randint(0, m)))
    out = [(f"d{i}", rng.choice(["fix", "idea"]), rng.choice(["p", "q", ""]), text(4), text(60), rng.choice(["alpha, beta", "x9", None])) for i in range(n)]
    return out + [("empty", "fix", "p", "", "", ""), ("null", "fix", "p", None, None, None), ("long", "idea", "q", "beta", "alpha " * 5000, "")]


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame(_rows(300), SCHEMA).repartition(3)


def _best(scores, k):
    return [(r.id, round(r.raw, 9)) for r in scores.orderBy(F.desc("raw"), "id").limit(k).collect()]


def _index(spark, tmp_path, **options):
    return TextIndex.create(spark, str(tmp_path / "index"), **options)


@pytest.mark.parametrize(("block", "first"), [(4096, 64), (16, 2), (7, 1)])
def test_search_equals_a_scan_and_skips_blocks(spark, objects, tmp_path, monkeypatch, block, first):
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", first)
    index = _index(spark, tmp_path).apply(objects)
    for query in ("alpha", "gamma w3", "beta alpha x9", "ray", "été", "alpha nowhere", "", "?!"):
        terms = X.search_terms(query)
        assert _best(index.search(terms, 5), 5) == _best(X.bm25(objects, query), 5), query
        assert Counter(_best(index.search(terms), 1000)) == Counter(_best(X.bm25(objects, query), 1000)), query
    for k, p in (("fix", ""), ("", "q"), ("idea", "p")):
        plain = hybrid.keyword_search(objects, "alpha beta", k, p, 7).orderBy("kw_rank").collect()
        assert hybrid.keyword_search(objects, "alpha beta", k, p, 7, index=index).orderBy("kw_rank").collect() == [r for r in plain]


def test_a_query_reads_the_folders_of_its_terms_only(spark, objects, tmp_path):
    index = _index(spark, tmp_path).apply(objects)
    files = {f.split("/postings/")[1].split("/part")[0] for f in index._postings(["alpha"]).inputFiles()}
    assert len(files) == 1 < len(index.manifest["segments"][0]["folders"])


def test_stemmed_index(spark, objects, tmp_path):
    index = _index(spark, tmp_path, stemmed=True).apply(objects)
    got = hybrid.keyword_search(objects, "running ete", limit=9, index=index).collect()
    assert got == hybrid.keyword_search(objects, "running ete", limit=9, stemmed=True).collect() and got


def test_changes_deletions_merges_and_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    index, state, rng = _index(spark, tmp_path), {}, random.Random(2)
    versions = []
    for batch in range(9):
        changed = [(f"d{rng.randint(0, 80)}", *r[1:]) for r in _rows(25, seed=batch)[:25]]
        changed = list({r[0]: r for r in changed}.values())
        gone = [f"d{rng.randint(0, 80)}" for _ in range(5)] + ["never"]
        for g in gone:
            state.pop(g, None)
        state |= {r[0]: r for r in changed}
        index = index.apply(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id string"), ("log", batch))
        again = index.apply(spark.createDataFrame([("d1", "fix", "p", "replayed", "replayed", "")], SCHEMA), None, ("log", batch))
        assert again.manifest == index.manifest
        versions.append(index)
    now = spark.createDataFrame(list(state.values()), SCHEMA)
    assert index.check(now).count() == 0 and index.statistics()[0] == len(state)
    assert len(index.manifest["segments"]) < text_index.MERGE_AT * 4 and index.manifest["next"] > 9  # some were merged
    for query in ("alpha", "beta w3", "x9"):
        assert _best(index.search(X.search_terms(query)), 100) == _best(X.bm25(now, query), 100)
    assert TextIndex.open(spark, index.path).manifest == index.manifest
    everything = spark.createDataFrame([(i,) for i in state], "id string")
    empty = index.apply(gone=everything)
    assert empty.statistics() == (0, 0) and empty.search(["alpha"]).count() == 0 and empty.check(now.limit(0)).count() == 0
    assert versions[-1].statistics()[0] == len(state)  # older versions stay


def test_two_writers_of_one_version(spark, objects, tmp_path):
    index = _index(spark, tmp_path)
    index.apply(objects.limit(3))
    with pytest.raises(Exception, match="exists|Exists"):
        index.apply(objects.limit(5))


def test_check_finds_planted_faults(spark, objects, tmp_path):
    index = _index(spark, tmp_path).apply(objects)
    segment = f"{index.path}/postings/seg=0"
    rows = spark.read.parquet(segment)
    kept = rows.where(~((F.col("term") == "alpha") & (F.col("block") == 0)))
    kept.write.partitionBy("bucket").parquet(str(tmp_path / "less"))
    broken = TextIndex(spark, str(tmp_path / "broken"), index.manifest)
    for name in ("docs", "gone"):
        if (tmp_path / "index" / name).exists():
            (tmp_path / "broken").mkdir(exist_ok=True)
            (tmp_path / "broken" / name).symlink_to(tmp_path / "index" / name)
    (tmp_path / "broken" / "postings").mkdir(parents=True)
    (tmp_path / "less").rename(tmp_path / "broken" / "postings" / "seg=0")
    faults = {(r.id, r.fault) for r in broken.check(objects).collect()}
    holders = {r.id for r in X.bm25(objects, "alpha").collect()}
    assert faults == {(i, "differs") for i in holders} and holders
    changed = objects.where("id <> 'd5'").unionAll(spark.createDataFrame([("new", "fix", "p", "t", "c", "")], SCHEMA))
    assert {(r.id, r.fault) for r in index.check(changed).collect()} == {("d5", "surplus"), ("new", "missing")}


@pytest.mark.parametrize("listed", [2000, 1])
def test_many_queries_in_one_pass(spark, objects, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(text_index, "LISTED", listed)
    index = _index(spark, tmp_path).apply(objects.limit(150)).apply(objects)
    texts = ["alpha", "Alpha!", "gamma w3", "w1 w2", "nowhere", "", None, "beta alpha"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, q string").select("query_id", X.tokens(F.col("q")).alias("terms"))
    got = {}
    for r in index.search_many(asked, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.raw, 9)))
    for i, t in enumerate(texts):
        best = _best(X.bm25(objects, t or ""), 6)
        assert [x[1:] for x in sorted(got.get(i, []))] == best, t


def test_a_diagnosis_takes_scores_alike_to_nine_places_by_id(spark, tmp_path):
    rows = [(f"d{i}", "fix", "p", "", "common " + "w " * (2040 - 3 * i), "") for i in range(9)] + [("z", "fix", "p", "common", "w " * 1500, "")]
    objects = spark.createDataFrame(rows, SCHEMA)
    raw = {r.id: r.raw for r in X.bm25(objects, "common").collect()}
    want = set(sorted(raw, key=lambda i: (-round(raw[i], 9), i))[:4])
    assert want != set(sorted(raw, key=lambda i: (-raw[i], i))[:4])
    missed = objects.select("id", F.lit("common").alias("query"))
    told = learn.diagnose_all(missed, _index(spark, tmp_path).apply(objects), 4).collect()
    assert {r.id for r in told if r.boost == "keyword"} == want and len(told) == len(rows)


def test_a_stream_keeps_the_index_in_step_exactly_once(spark, tmp_path):
    index = _index(spark, tmp_path, attributes=())
    state = {}
    rng = random.Random(8)
    for batch in range(4):
        events = [(batch * 100 + i, f"d{rng.randint(0, 12)}", rng.choice(["delete", "set", "set"]), f"alpha w{i} t{batch}") for i in range(15)]
        spark.createDataFrame(events, "seq long, id string, kind string, content string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{batch}"))
        for _, i, kind, content in events:
            state[i] = None if kind == "delete" else content
    schema = "seq long, id string, kind string, content string"
    index = TextIndex.create(spark, str(tmp_path / "live"), fields=("content",), attributes=())
    sink = index.sink("events", lambda b: b.where("kind = 'delete'"), "seq")
    seen = []

    def twice(batch, number):
        sink(batch, number)
        before = TextIndex.open(spark, index.path).manifest
        sink(batch, number)  # as after a failure between the index's commit and the stream's
        assert TextIndex.open(spark, index.path).manifest == before
        seen.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    streams.run_available(stream, str(tmp_path / "progress"), twice)
    live = {i: c for i, c in state.items() if c is not None}
    now = spark.createDataFrame(list(live.items()), "id string, content string")
    last = TextIndex.open(spark, index.path)
    assert len(seen) == 4 and last.check(now).count() == 0
    expected = Counter((i, t) for i, c in live.items() for t in c.split())
    assert {(r.id, r.term): r.n0 for r in last.postings().collect()} == expected


def test_boost_runs_keep_the_order_and_come_to_rest(spark):
    rng = random.Random(3)
    boosts = [(i, rng.choice(["keyword", "keyword", "semantic", "graph"])) for i in range(500)] + [(1000 + i, "recency") for i in range(3000)]
    frame = spark.createDataFrame(rng.sample(boosts, len(boosts)), "at long, boost string").repartition(5)
    runs = learn.boost_runs(frame, ["at"])
    assert [s for s, n in runs for _ in range(n)] == [b for _, b in boosts]
    weights = {"keyword": 0.4, "semantic": 0.3, "graph": 0.2, "recency": 0.1}
    assert learn.adapt_runs(weights, runs) == learn.adapt(weights, [b for _, b in boosts])
    assert learn.boost_runs(frame.limit(0), ["at"]) == []


def test_engine_keeps_its_index_through_changes(spark):
    from tests.test_engine import objects as made

    now = F.timestamp_seconds(F.lit(1_800_000_000))
    edges = spark.createDataFrame([], "src string, rel_type string, dst string, confidence double, inferred_by string")
    entities, mentions = spark.createDataFrame([], "id string, name string, type string"), spark.createDataFrame([], "obj_id string, entity_id string")
    engine = Engine(made(spark, a="kafka lag", b="kafka", c="other"), edges, entities, mentions).with_index()
    ids = lambda e, q: {r.id for r in e.search(q, now).collect()}
    assert ids(engine, "kafka") == {"a", "b"}
    changed = engine.update(spark.createDataFrame([("b", "redis")], "id string, title string").withColumn("content", F.lit("redis")), now)
    assert ids(changed, "kafka") == {"a"} and ids(changed, "redis") == {"b"} and ids(engine, "kafka") == {"a", "b"}
    left = changed.delete(spark.createDataFrame([("a",)], "id string"), now)
    assert ids(left, "kafka") == set() and left.index.check(left.objects).count() == 0
