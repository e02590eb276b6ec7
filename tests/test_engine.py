"""The engine's operators on small hand-made graphs and texts."""

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import scoring as S
from graphloom.functions import text as X
from graphloom.operators import detect, graph, ingest, learn, metrics, present, store, temporal
from graphloom.plans import hybrid, pipeline


def edges(spark, *pairs):
    return spark.createDataFrame([(a, r, b, 1.0, "") for a, r, b in pairs] or [("", "", "", 1.0, "")], model.EDGES).where("src <> ''")


def objects(spark, **titles):
    rows = [(i, "fix", t, t, "", "p", "", "archive", 0.5, "user", "ingest", None, None) for i, t in titles.items()]
    return spark.createDataFrame(rows, model.OBJECTS).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.ascii("id") * 60))


def chain(n, rel="supersedes"):
    return [(f"n{i}", rel, f"n{i + 1}") for i in range(n - 1)]


def tree(levels):
    return [(f"t{i}", "supersedes", f"t{(i - 1) // 2}") for i in range(1, 2**levels - 1)]


TOPOLOGIES = {
    "chain_5": (chain(5), 6, 3), "chain_10": (chain(10), 36, 5), "chain_11": (chain(11), 45, 5), "star_8": ([(f"s{i}", "supersedes", "hub") for i in range(8)], 0, 1), "tree_4": (tree(4), 20, 3),
    "diamond": ([("a", "supersedes", "b"), ("a", "supersedes", "c"), ("b", "supersedes", "d"), ("c", "supersedes", "d")], 1, 2), "cycle_4": ([(f"c{i}", "supersedes", f"c{(i + 1) % 4}") for i in range(4)], 8, 3),
    "contradicts_5": ([(f"x{i}", "contradicts", f"y{i}") for i in range(5)], 5, 2), "causal_5": ([(f"x{i}", "causedBy", f"y{i}") for i in range(5)], 5, 2),
}


@pytest.mark.parametrize("name", TOPOLOGIES)
def test_inference_reaches_its_fixpoint(spark, name):
    facts, inferred, rounds = TOPOLOGIES[name]
    e = edges(spark, *facts)
    made, counts = graph.infer(e)
    rows = made.collect()
    assert len(rows) == inferred and len(counts) == rounds and all(r.src != r.dst for r in rows)
    whole = e.select("src", "rel_type", "dst").unionByName(made.select("src", "rel_type", "dst"))
    assert graph.infer(whole)[0].count() == 0
    assert sum(r.n for r in graph.pending(whole).collect()) == 0


def test_causal_chain_both_ways_and_through_a_cycle(spark):
    e = edges(spark, ("b", "causedBy", "a"), ("b", "ledTo", "c"), ("c", "ledTo", "b"), ("c", "ledTo", "gone"))
    o = objects(spark, a="A", b="B", c="C")
    got = {(r.id, r.hop) for r in graph.causal_chain(e, o, o.where("id = 'b'").select("id")).collect()}
    assert got == {("a", -1), ("b", 0), ("c", 1)}


def test_evolution_and_neighbourhood(spark):
    e = edges(spark, ("c", "supersedes", "b"), ("b", "supersedes", "a"), ("a", "supports", "z"))
    o = objects(spark, a="A", b="B", c="C", z="Z")
    assert [r.id for r in graph.evolution(e, o, o.where("id = 'b'").select("id")).orderBy("created_at").collect()] == ["a", "b", "c"]
    m = spark.createDataFrame([("a", "e1"), ("b", "e1")], model.MENTIONS)
    got = {(r.id, r.hop, r.via) for r in graph.neighbourhood(spark.createDataFrame([("e1",)], "entity_id string"), m, e).collect()}
    assert got == {("a", 1, None), ("b", 1, None), ("c", 2, "b"), ("z", 2, "a")}


def test_contradictions_need_supersession_and_dependents(spark):
    e = edges(spark, ("n", "supersedes", "o"), ("d", "dependsOn", "o"), ("d", "dependsOn", "n"))
    o = objects(spark, n="N", o="O", d="D")
    assert [(r.id, r.n_dependents, r.dependents) for r in detect.contradictions(o, e).collect()] == [("o", 1, ["d"])]
    assert [(r.src, r.dst) for r in detect.stale_dependencies(o, e).collect()] == [("d", "o")]
    assert detect.contradictions(o, edges(spark, ("n", "supersedes", "o"))).count() == 0
    assert {r.category for r in detect.run_all(o, e, spark.createDataFrame([], model.MENTIONS), F.lit("2024-01-02").cast("timestamp")).collect()} == {"contradiction", "staleness"}


def test_patterns_and_gaps(spark):
    o = objects(spark, a="1", b="2", c="3", d="4")
    m = spark.createDataFrame([(i, "e") for i in "abcc"] + [("a", "f")], model.MENTIONS)
    at = F.lit("2024-01-05").cast("timestamp")
    assert [(r.entity_id, r.n) for r in detect.patterns(o, m, at).collect()] == [("e", 3)]
    assert detect.patterns(o, m, F.lit("2025-01-05").cast("timestamp")).count() == 0
    assert [(r.project, r.n) for r in detect.gaps(o, "project", "fix", "lesson").collect()] == [("p", 4)]


def test_keyword_search_properties(spark):
    o = objects(spark, a="alpha beta", b="gamma", c="delta").withColumn("content", F.when(F.col("id") == "b", "alpha words words words").otherwise("nothing here")).withColumn("title", F.when(F.col("id") == "b", "other").otherwise(F.col("title")))
    got = hybrid.keyword_search(o, "alpha").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].kw == 1.0 and got[1].kw < 1
    assert hybrid.keyword_search(o, "alpha nothing").count() == 1 and hybrid.keyword_search(o, "  ").count() == 0
    for odd in ('"quote', "'; DROP TABLE objects; --", "漢字 😀", "OR AND NOT NEAR(", "x" * 10000):
        hybrid.keyword_search(o, odd).count()


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(S.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_hybrid_floor_and_unknown_entity(spark):
    o = objects(spark, a="alpha", b="alpha beta")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("zz", [1.0, 0.0])], "id string, embedding array<float>")
    e, none = edges(spark, ("a", "supports", "b")), spark.createDataFrame([], model.MENTIONS)
    entities = spark.createDataFrame([("e", "Known", "concept")], model.ENTITIES)
    at = F.lit("2024-01-03").cast("timestamp")
    run = lambda **k: hybrid.search(o, v, e, "alpha", at, [1.0, 0.0], none, entities, **k).collect()
    assert [r.id for r in run()] == ["a", "b"] and run()[0].score > run()[1].score
    assert len(run(min_relevance=0.6)) == 1 and len(run(entity="unknown")) == 2 and not run(entity="unknown", strict_entity=True) and not run(entity="known")


def test_weights():
    assert S.valid_weights("not json") == model.WEIGHTS and S.valid_weights('{"keyword": -1}') == model.WEIGHTS and S.valid_weights('{"keyword": true}') == model.WEIGHTS
    assert S.valid_weights('{"keyword": 1}')["keyword"] == 1 and S.valid_weights('{"keyword":0,"semantic":0,"graph":0,"recency":0}') == model.WEIGHTS
    w = learn.adapt(dict(model.WEIGHTS), ["semantic"] * 40)
    assert w["semantic"] > 0.7 and min(w.values()) > 0 and sum(w.values()) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("roll", "roll"), ("sky", "sky")])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_stemmed_search(spark):
    o = objects(spark, a="Running résumés", b="walks")
    assert [r.id for r in hybrid.keyword_search(o, "run resume", stemmed=True).collect()] == ["a"]


def test_front_matter():
    text = "title: \"A\"\ntags: [x, y]\naliases:\n  - one\n  - two\nnote: >\n  folded\n  text\ncode: |\n  l1\n  l2\n# c"
    assert X.parse_front(text) == {"title": "A", "tags": "x, y", "aliases": "one, two", "note": "folded text", "code": "l1\nl2"}


def test_notes_and_links(spark):
    raw = [("p1/lessons/a.md", "---\ntitle: First Note\ntags: [x]\ndate: 2024-02-03\n---\nSee [[Second]] and [[secnd notee]]"), ("b.md", "plain"), ("c.md", "---\ntype: index\n---\n"), ("d.md", "---\nsource: ingest:web\n---\n")]
    notes = ingest.parse_notes(spark.createDataFrame(raw, "path string, raw string"))
    got = {r.path: r for r in notes.collect()}
    assert set(got) == {"p1/lessons/a.md", "b.md"} and got["p1/lessons/a.md"].type == "lesson" and got["p1/lessons/a.md"].project == "p1" and got["b.md"].title == "b" and got["b.md"].created_at is None
    o = objects(spark, x="Second", y="2024-01-01 Second Note!", z="Unrelated")
    links = spark.createDataFrame([("a", "Second"), ("a", "second note"), ("a", "secnd notee"), ("a", "nowhere to be found")], "src string, target string")
    got = {r.target: (r.id, r.how) for r in ingest.resolve_links(links, o).collect()}
    assert got == {"Second": ("x", "exact"), "second note": ("y", "normal"), "secnd notee": ("y", "fuzzy"), "nowhere to be found": (None, None)}


def test_fuzzy_links_lose_none(spark):
    import datetime
    import difflib
    import random

    rng = random.Random(5)
    names = ["abcdefghijklmnopqrst", *("".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(60))]

    def changed(title):
        t = list(title)
        for _ in range(rng.randint(0, 4)):
            t.insert(rng.randrange(len(t) + 1), rng.choice("abcde")) if rng.random() < 0.5 or not t else t.pop(rng.randrange(len(t)))
        return "".join(t)

    targets = list(dict.fromkeys(["abxcdyefzghuijvklwmn0op1qr2st", *(changed(rng.choice(names)) for _ in range(80))]))
    o = spark.createDataFrame([(str(i), n, datetime.datetime(2024, 1, 1)) for i, n in enumerate(names)], "id string, title string, created_at timestamp")
    links = spark.createDataFrame([("s", t) for t in targets], "src string, target string")
    normal = lambda c, df: {r[0]: r[1] for r in df.select(c, X.normal_title(F.col(c))).collect()}
    of_title, of_target = normal("title", o), normal("target", links)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    n_fuzzy = 0
    for r in ingest.resolve_links(links, o).collect():
        best = max([ratio(of_target[r.target], t) for t in of_title.values() if t and of_target[r.target]], default=0.0)
        if r.how == "fuzzy":
            n_fuzzy += 1
            assert ratio(of_target[r.target], of_title[names[int(r.id)]]) == best > 0.8
        elif r.how is None:
            assert best <= 0.8, r
    assert n_fuzzy > 20


def test_several_changes_and_values(spark):
    o = objects(spark, a="A", b="B")
    at = F.lit("2024-05-05").cast("timestamp")
    twice = spark.createDataFrame([("a", "X", ""), ("a", "Y", "p"), ("zz", "Z", "q")], "id string, title string, project string")
    assert sorted((r.id, r.title, r.project) for r in store.update(o, twice, at).collect()) == [("a", "Y", "p"), ("b", "B", o.where("id = 'b'").first().project)]
    t = spark.createDataFrame([("s", "p", "1"), ("s", "p", "2"), ("s", "q", "3")], "s string, p string, o string")
    assert store.read_subject(t).first().properties == {"p": ["1", "2"], "q": ["3"]}


def test_as_of_over_the_whole_log_and_slices(spark):
    import random

    rng = random.Random(2)
    stamp = lambda: 1_700_000_000 + rng.randrange(40_000)
    log, ev = [(i, rng.choice("abc"), stamp(), f"t{i}") for i in range(60)], [(i, rng.choice("abcd"), stamp()) for i in range(80)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds("ts"))
    events, logs = frame(ev, "event_id int, k string, ts long"), frame(log, "event_id int, k string, ts long, tool string")
    for key in ("k", None):
        got = {r.event_id: r.prev and r.prev.tool for r in temporal.latest_before(events, logs, key).collect()}
        for i, k, ts in ev:
            before = [(x[2], x[0], x[3]) for x in log if x[2] <= ts and (key is None or x[1] == k)]
            assert got[i] == (max(before)[2] if before else None)


def test_rate_limit_of_a_hundred_a_minute(spark):
    rows = [("a", 1_700_000_000 + i * 0.5) for i in range(130)] + [("b", 1_700_000_000.0 + i) for i in range(130)]
    out = temporal.rate_limit(spark.createDataFrame(rows, "client string, at double").select("client", F.col("at").cast("timestamp").alias("ts")))
    assert {r.client: r.n for r in out.groupBy("client").agg(F.count_if(~F.col("allowed")).alias("n")).collect()} == {"a": 130 - 100, "b": 0}


def test_templates(spark):
    row = spark.range(1).select(F.lit("boom").alias("s"), F.lit("").alias("r"), F.lit(" high ").alias("v"))
    content, properties = X.render_template("fix", {"symptom": F.col("s"), "root_cause": F.col("r"), "severity": F.col("v")})
    got = row.select(content.alias("c"), properties.alias("p")).first()
    assert got.c == "## Symptom\nboom\n\n## Severity\nhigh" and got.p == {"symptom": "boom", "severity": "high"}


def test_mutations(spark):
    o, e = objects(spark, a="A", b="B"), edges(spark, ("a", "supports", "b"))
    new = edges(spark, ("a", "supports", "b"), ("a", "supports", "a"), ("b", "dependsOn", "a")).withColumn("inferred_by", F.lit("x"))
    got = {(r.src, r.rel_type, r.dst, r.inferred_by) for r in store.link(e, new).collect()}
    assert got == {("a", "supports", "b", ""), ("b", "dependsOn", "a", "x")}
    assert store.insert(o, objects(spark, b="again", c="C")).count() == 3
    at = F.lit("2024-05-05").cast("timestamp")
    up = {r.id: (r.title, r.updated_at is not None) for r in store.update(o, spark.createDataFrame([("a", ""), ("b", "New")], "id string, title string"), at).collect()}
    assert up == {"a": ("A", True), "b": ("New", True)}
    with pytest.raises(ValueError):
        store.update(o, spark.createDataFrame([("a", "x")], "id string, created_at string"), at)
    with pytest.raises(ValueError):
        store.list_objects(o, "nonsense")


def test_as_of(spark):
    ch = spark.createDataFrame([("d", 1, "2024-01-01", 1.0), ("d", 2, "2024-02-01", 2.0), ("d", 3, "2024-03-01", 3.0)], "doc_id string, seq int, updated_at string, price double").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    v = temporal.versions(ch).drop("seq", "updated_at")
    cur = spark.createDataFrame([("d", "2023-06-01", 9.0)], "doc_id string, created_at string, price double").withColumn("created_at", F.col("created_at").cast("timestamp"))
    at = lambda d: [r.price for r in temporal.state_at(v, cur, F.lit(d).cast("timestamp")).collect()]
    assert at("2024-01-15") == [1.0] and at("2024-02-01") == [2.0] and at("2024-04-01") == [9.0] and at("2023-01-01") == []


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    got = metrics.ranking(ranked, spark.createDataFrame([("q", "a"), ("q", "c"), ("none", "z")], "query string, id string"), 2).collect()
    by = {r.query: r for r in got}
    assert by["q"].recall == 0.5 and by["q"].ap == pytest.approx((1 + 2 / 3) / 2) and by["q"].mrr == 1.0 and by["none"].ndcg == 0.0
    none = spark.createDataFrame([], "id string")
    assert metrics.classification(none, none).first().f1 == 1.0


def test_pipeline_keeps_going(spark):
    o = objects(spark, a="A")
    bad = lambda df: df.select("no_such_column")
    out, status = pipeline.run([("normalize", pipeline.normalize), ("broken", bad)], o)
    assert status["normalize"] == "ok" and status["broken"].startswith("failed") and status["pipeline"] == "partial" and out.first().summary == "A"


def test_vault_round_trip(spark, tmp_path):
    from graphloom.sources import vault

    o = objects(spark, a="Same", b="same", c="Ödd/name").withColumn("project", F.lit("pr"))
    files = vault.vault_files(o, edges(spark, ("a", "supports", "b")), spark.createDataFrame([("a", "e")], model.MENTIONS), spark.createDataFrame([("e", "Ent x", "concept")], model.ENTITIES))
    vault.write_vault(files, f"file://{tmp_path}/v")
    back = {r.path: r.raw for r in vault.read_vault(spark, f"file://{tmp_path}/v").collect()}
    assert len(back) == 4 and "#Ent_x" in back["pr/Same.md"] and "[[b]]" in back["pr/Same.md"] and "pr/Ödd_name.md" in back
    assert vault.snapshot({"objects": o}, f"file://{tmp_path}/s") == {"objects": 3}


def test_streams_equal_batches(spark):
    import __spark_entry__

    from tests.conftest import SF

    q = __spark_entry__.queries()
    assert q["k2_stream_access_counts"](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20 and set(entry.oracle_sql()) <= set(entry.queries())


def test_ontology_reader(spark, tmp_path):
    from graphloom.sources import ontology

    text = '@prefix o: <http://x/> .\n# comment\no:Fix a owl:Class ; rdfs:label "Fix"@en , "Repair" .\no:led owl:inverseOf o:caused .\n'
    (tmp_path / "o.ttl").write_text(text)
    assert ontology.parse_turtle(text) == {("o:Fix", "rdf:type", "owl:Class"), ("o:Fix", "rdfs:label", '"Fix"@en'), ("o:Fix", "rdfs:label", '"Repair"'), ("o:led", "owl:inverseOf", "o:caused")}
    triples, n = ontology.load(spark, f"file://{tmp_path}/o.ttl")
    assert n == 4 and ontology.load(spark, f"file://{tmp_path}/o.ttl", triples)[1] == 0


def test_tool_functions(spark):
    from graphloom.api import Engine

    now = F.lit("2024-01-10").cast("timestamp")
    o = objects(spark, a="alpha python", b="beta").withColumn("tags", F.lit("Python, x")).withColumn("updated_at", F.col("created_at"))
    base = Engine(o, edges(spark, ("a", "supports", "b"), ("b", "causedBy", "a")), spark.createDataFrame([("e", "Py", "technology")], model.ENTITIES), spark.createDataFrame([("a", "e")], model.MENTIONS)).with_vectors()
    assert base.search("alpha", now).first().id == "a" and base.context("alpha", now).columns[-1] == "summary"
    assert base.read("a").first().entities == ["Py"] and base.dossier("py")["objects"].count() == 1
    assert base.delete(spark.createDataFrame([("a",)], "id string")).status().first().relationships == 0
    more, status = base.pipeline()
    assert status["pipeline"] == "complete" and more.edges.where("rel_type = 'ledTo'").count() == 1 and {r.name for r in more.list_entities().collect()} == {"Py", "python", "x"}
    captured = base.capture(spark.createDataFrame([("n1", "New", "it broke")], "id string, title string, s string"), "fix", {"symptom": F.col("s")}, now)
    assert captured.objects.where("id = 'n1'").first().content == "## Symptom\nit broke"
    assert base.graph("b")["causal_chain"].count() == 2 and base.graph_entity("PY").count() == 2 and base.list("fix").count() == 2
    logged = base.log("alpha", ["a"], now)
    assert logged.query_trail().count() == 1 and logged.query_trail(-1).count() == 0
    page, opened = base.log("beta", ["b"], now).open("a", F.lit("2024-01-11").cast("timestamp"))
    assert page.first().id == "a" and opened.access_log.count() == 1 and opened.weights["semantic"] > base.weights["semantic"] * 0.99 and opened.weights != base.weights
    assert base.log("beta", ["a"], now).open("a", now)[1].weights == base.weights and base.stored_weights("nonsense").weights == dict(model.WEIGHTS)
    gone = base.delete(spark.createDataFrame([("a",)], "id string"), now)
    assert [(r.id, r.version_num) for r in gone.history.collect()] == [("a", 1)] and gone.objects.count() == 1
    assert captured.objects.where("id = 'n1'").first().pipeline_stage == "enriched" and {r.name for r in base.debug_memory().collect()} >= {"objects", "edges"} and base.debug_sessions().count() == 0
    twice = base.update(spark.createDataFrame([("a", "T1")], "id string, title string"), now).update(spark.createDataFrame([("a", "T3")], "id string, title string"), now)
    assert sorted((r.version_num, r.title) for r in twice.history.collect()) == [(1, "alpha python"), (2, "T1")]
    up = base.update(spark.createDataFrame([("a", "T2")], "id string, title string"), now)
    assert up.history.first().title == "alpha python" and up.objects.where("id = 'a'").first().title == "T2"
    assert base.graph_data()["edges"].count() == 2 and base.export("a").count() == 1 and base.reason(now).count() >= 0 and base.synthesize(now, 30)["themes"].count() == 1
    seen = base.feedback(spark.createDataFrame([("a", True), ("b", False)], "obj_id string, relevant boolean").withColumn("ts", now))
    assert seen.access_log.count() == 1 and seen.adjust_tiers(now).count() == 2
    assert base.classify(spark.createDataFrame([("a", "nonsense")], "id string, type string"), now).objects.where("id = 'a'").first().type == "idea"
