"""Streams in many batches, with late rows and batches that come twice, against plain loops."""

import random
from datetime import datetime, timedelta

from graphloom.operators import learn
from graphloom.streaming import streams

T0 = datetime(2024, 1, 1)


def test_tiers_by_timers_equal_a_walk_in_any_batches(spark, tmp_path):
    rng = random.Random(5)
    reads = sorted((T0 + timedelta(hours=rng.choice([rng.uniform(0, 400), rng.uniform(300, 1800)])), f"o{rng.randint(0, 5)}") for _ in range(160))
    # Out of order within a day, in eight batches.
    dealt = sorted(reads, key=lambda r: r[0] + timedelta(hours=rng.uniform(0, 20)))
    for b in range(8):
        part = dealt[b * 20 : b * 20 + 20]
        spark.createDataFrame([(i, at) for at, i in part], "obj_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    source = spark.readStream.schema("obj_id string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    with streams.timers(spark):
        streams.run_available(streams.tier_changes(source, promote_at=4, inactive=timedelta(days=5), late="2 days"), str(tmp_path / "state"), lambda b, _: got.extend(tuple(r) for r in b.collect()))
    assert spark.conf.get(streams.ROCKSDB[0]).endswith("HDFSBackedStateStoreProvider")
    ms = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
    now, expected = ms(max(r[0] for r in reads)) - timedelta(days=2), []
    for o in {r[1] for r in reads}:
        n, last, reflex = 0, None, False
        for at in [ms(a) for a, i in reads if i == o and ms(a) <= now] + [None]:
            if reflex and (at or now) - last > timedelta(days=5):
                expected.append((o, last + timedelta(days=5), "demote"))
                reflex = False
            if at is None:
                break
            n, last = n + 1, at
            if n >= 4 and not reflex:
                expected.append((o, at, "promote"))
                reflex = True
    assert sorted(got) == sorted(expected) and {"promote", "demote"} == {c for _, _, c in got} and len(got) > 12


def test_weights_of_a_stream_are_kept_exactly_once(spark, tmp_path):
    rng = random.Random(1)
    log, held = streams.WeightLog(spark, str(tmp_path / "weights")), []
    assert log.read() == ({"keyword": 0.4, "semantic": 0.3, "graph": 0.2, "recency": 0.1}, -1)
    sink = log.sink(["at"])
    for number in range(3):
        boosts = [(number * 100 + i, rng.choice(["keyword", "semantic"])) for i in range(40)]
        held += boosts
        batch = spark.createDataFrame(rng.sample(boosts, 40), "at long, boost string").repartition(3)
        for _ in range(2):  # as after a failure between the file and the stream's own commit
            sink(batch, number)
            assert log.read() == (learn.adapt(dict(log.start), [b for _, b in held]), number)
    sink(spark.createDataFrame([(0, "graph")], "at long, boost string"), 1)
    assert streams.WeightLog(spark, log.path).read()[1] == 2
