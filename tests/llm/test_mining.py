"""Vector joins, collocations and importance draws against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from graphloom.llm import collocations, common, ego_join, importance

from .test_operators import SCHEMA, _row, _texts, same


@pytest.fixture(scope="module")
def rows():
    common_line = "the cat sat on the mat, the cat sat on it."
    texts = _texts() + [common_line] * 11 + ["New York is New York. new\tYORK is", "a b\x0bb c\x0ca b\rc", "x" * 50_000, ("word " * 9 + "end. ") * 300]
    out = [_row(i - 3, t, (None, "en", "fr")[i % 3], None if i % 11 == 0 else f"src{i % 4}") for i, t in enumerate(texts)]
    return out + [out[3], out[3], out[-1], _row(None, "no id at all " * 9, None, None), _row(None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- vectors

VECTORS = "vec_id long, embedding array<float>, label int, node string, n_links string, digest int, `row` int"


def _vectors(seed=3, n=260, dims=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([0.02, 0.1, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), "a", "b", 1, 2))
    for i in range(40):  # equal vectors under other ids, and multiples of one
        out.append((1000 + i, out[7][1], out[7][2], "a", "b", 1, 2))
    out.append((2000, [2 * x for x in out[7][1]], out[7][2], "a", "b", 1, 2))
    odd = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0, 2.0], [1.0, 2.0, 0.0]]
    out += [(3000 + i, v, 1, "a", "b", 1, 2) for i, v in enumerate(odd)]
    return out + [(4000, out[7][1], None, "a", "b", 1, 2), (None, out[7][1], out[7][2], "a", "b", 1, 2), out[5], out[5]]


def _linked(vectors, least):
    def cosine(a, b):
        dot = lambda x, y: math.fsum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b))

    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, links, up = len(vectors), Counter(), list(range(len(vectors)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a[2] is not None and a[2] == b[2] and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= least:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i in range(n):
        if vectors[i][0] is not None:
            ids[root(i)].append(vectors[i][0])
    out = []
    for i, v in enumerate(vectors):
        component = min(ids[root(i)], default=None)
        out.append((v[0], links[i], component, v[0] is not None and v[0] == component))
    return out


@pytest.mark.parametrize(("block", "leaf", "fan", "least"), [(2048, 128, 8, 0.98), (16, 4, 2, 0.98), (16, 4, 3, 0.9)])
def test_vectors_link_as_by_brute_force(spark, monkeypatch, block, leaf, fan, least):
    for name, value in (("BLOCK_ROWS", block), ("LEAF", leaf), ("FAN", fan)):
        monkeypatch.setattr(ego_join, name, value)
    vectors = _vectors()
    out = ego_join.near_vectors(spark.createDataFrame(vectors, VECTORS).repartition(3), min_cosine=least)
    assert set(out.columns) == {"vec_id", "embedding", "label", "node", "n_links", "digest", "row", "component_id", "kept"}
    same([tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()], _linked(vectors, least))


def test_vectors_of_doubles_of_any_size(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 4))
    vectors = [(i, (v * s).tolist(), "x") for s, k in ((1.0, 0), (1e200, 100), (1e-200, 200)) for i, v in enumerate(base, k)]
    out = ego_join.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string"), columns=["vec_id"])
    plain = [(i, (base[i % 100]).tolist(), "x") for i, _, _ in vectors]
    same([tuple(r) for r in out.collect()], _linked(plain, 0.98))


def test_no_vectors(spark):
    out = ego_join.near_vectors(spark.createDataFrame([], VECTORS))
    assert out.count() == 0
    only_odd = [v for v in _vectors() if v[0] is not None and 3000 <= v[0] < 3006]
    out = ego_join.near_vectors(spark.createDataFrame(only_odd, VECTORS), columns=["vec_id"])
    same([tuple(r) for r in out.collect()], [(v[0], 0, v[0], True) for v in only_odd])


def test_border_links_do_not_depend_on_the_block(spark):
    """Pairs at an exact cosine of 0.6: (3, 4) against (1, 0) multiples."""
    vectors = [(0, [3.0, 4.0], 1), (1, [7.0, 0.0], 1), (2, [0.0, 5.0], 1)]
    out = ego_join.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"), min_cosine=0.6, columns=["vec_id"])
    same([tuple(r) for r in out.collect()], [(0, 2, 0, True), (1, 1, 0, False), (2, 1, 0, False)])


# -- collocations

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mined(rows, max_words=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, max_words + 1) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(100 * b >= percent * a for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def _with(module, name, value, run, *args):
    """run with a module's constant set, in the worker that runs it."""
    setattr(module, name, value)
    yield from run(*args)


def test_slices_hold_whole_words(monkeypatch):
    texts = [t or "" for t in _texts()] + ["a" * 200 + " b. c" + "d" * 99, ".." * 60, "é" * 90 + " x"]
    whole = [[w for part in collocations.tokens(t) for w in part] for t in texts]
    cache = importance._Buckets(101)
    runs = [np.sort(np.concatenate([*importance.features(t, cache, 3), np.zeros(0, int)])).tolist() for t in texts]
    monkeypatch.setattr(collocations, "SLICE_BYTES", 16)
    monkeypatch.setattr(importance, "SLICE_BYTES", 16)
    monkeypatch.setattr(importance, "MEMORY_BYTES", 900)
    assert [[w for part in collocations.tokens(t) for w in part] for t in texts] == whole
    cache = importance._Buckets(101)
    assert [np.sort(np.concatenate([*importance.features(t, cache, 3), np.zeros(0, int)])).tolist() for t in texts] == runs


@pytest.mark.parametrize("leaf", [1, 3, 500])
def test_sequences_join_without_what_is_distant(monkeypatch, leaf):
    monkeypatch.setattr(ego_join, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    a = rng.normal(size=(4, 6))[rng.integers(4, size=70)] + rng.normal(size=(70, 6)) * 0.2
    basis = np.linalg.qr(rng.normal(size=(6, 3)))[0]
    a = a[np.lexsort((ego_join._units(a) @ basis).T)]
    for same_, b in ((True, a), (False, a[::-1] * 2)):
        found = np.zeros((len(a), len(b)), bool)
        for i, j, part in ego_join._join(a, b, basis, math.sqrt(2 - 2 * 0.95) + 1e-9, 0.95, same_):
            assert not found[i : i + part.shape[0], j : j + part.shape[1]].any()
            found[i : i + part.shape[0], j : j + part.shape[1]] = part
        every = ego_join._units(a) @ ego_join._units(b).T >= 0.95
        assert (found == (np.triu(every, 1) if same_ else every)).all() and every.sum() > 100


@pytest.mark.parametrize(("chunk", "limits"), [(4 << 20, {}), (200, {}), (300, {"max_words": 4, "min_count": 5, "percent": 90, "top": 7})])
def test_collocations(docs, rows, empty, monkeypatch, chunk, limits):
    chunked = collocations._chunked
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "_chunked", lambda batches: _with(collocations, "CHUNK_BYTES", chunk, chunked, batches))
    names = {"max_words": "max_words", "min_count": "least", "percent": "percent", "top": "top"}
    expected = _mined(rows, **{names[k]: v for k, v in limits.items()})
    assert len(expected) > 15
    out = collocations.mine(docs, **limits)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same([tuple(r) for r in out.collect()], expected)
    if not limits:
        assert collocations.mine(empty).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    grams = [([1], big + 7), ([2], big + 1), ([1, 2], big)]
    (got,) = collocations.scored(spark.createDataFrame(grams, "ids array<long>, n long")).collect()
    assert tuple(got)[1:] == (big, big + 7, big + 1, 1_000_000 * big * big // ((big + 7) * (big + 1)))


@pytest.mark.parametrize(("m", "top"), [(2, 9), (3, 2**21 - 1), (3, 2**21), (3, 2**32 - 1), (5, 70_000)])
def test_packed_keys_sort_like_their_numbers(m, top):
    rng = random.Random(m * top)
    keys = [tuple(rng.choice([1, 2, top - 1, top, rng.randint(1, top)]) for _ in range(m)) for _ in range(500)]
    packing = collocations.Packing(m, top)
    words, counts = collocations.runs(packing.pack([np.array(c) for c in zip(*keys, strict=True)]), None)
    got = list(zip(*(c.tolist() for c in packing.unpack(words)), strict=True))
    assert dict(zip(got, counts.tolist(), strict=True)) == Counter(keys) and got == sorted(set(keys))
    again = collocations._unplaned(collocations._planes(words[0]))
    assert (again == words[0]).all()


def test_filter_hash_agrees_between_columns_and_arrays(spark):
    from pyspark.sql import functions as F

    ids = [(1, 2), (4_000_000_000, 3), (77, 4_294_967_295)]
    (got,) = zip(*spark.createDataFrame(ids, "a long, b long").select(collocations.mixed([F.col("a"), F.col("b")])).collect(), strict=True)
    assert list(got) == collocations.mixed([np.array([a for a, _ in ids]), np.array([b for _, b in ids])]).tolist()


# -- importance

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _weighed(rows, target, percent=10, least=20, buckets=10_000, max_run=1, seed="2024"):
    def bucketed(text):
        w = _WORDS.findall((text or "").translate(_LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, max_run + 1) for i in range(len(w) - m + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(bucketed(r[1])[1])
    for x in target:
        t.update(bucketed(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for r in rows:
        n, found = bucketed(r[1])
        h = int(sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append((r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((i for i in range(len(out)) if out[i][4] >= least), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, -out[i][1], -out[i][2]))
    ranks = {i: k for k, i in enumerate(order[: percent * len(order) // 100], 1)}
    return [(*x[:4], ranks.get(i)) for i, x in enumerate(out)]


@pytest.mark.parametrize("options", [{}, {"percent": 100}, {"percent": 0}, {"percent": 60, "max_run": 3, "buckets": 97, "min_words": 2, "seed": "s"}])
def test_importance(spark, docs, rows, empty, monkeypatch, options):
    monkeypatch.setattr(importance, "SLICE_BYTES", 50)
    monkeypatch.setattr(importance, "MEMORY_BYTES", 5000)
    target = ["the cat sat on a mat", None, "", "Ünïcode x9 ti " * 40]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    names = {"min_words": "least"}
    out = importance.resample(docs, items, **options)
    assert set(out.columns) == {*docs.columns, "n_features", "weight", "score", "rank"}
    same([tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()], _weighed(rows, target, **{names.get(k, k): v for k, v in options.items()}))
    if not options:
        assert importance.resample(empty, items).count() == 0
        assert importance.resample(docs, items.limit(0), columns=["doc_id"]).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_radix_selection_takes_exactly_k(spark):
    rng = random.Random(9)
    values = [rng.choice([0, 5, 5, 4096, 4097, rng.randint(0, 1 << 62)]) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "k0 long")
    for k in (1, 57, 150, 400):
        value, below = importance._kth(rows, "k0", k)
        assert value == sorted(values)[k - 1] and below == sum(v < value for v in values)
        drawn, others = importance._drawn(rows, ["k0"], k)
        assert sorted(r.k0 for r in drawn.collect()) == sorted(values)[:k] and others.count() == 400 - k


def test_numbers_have_no_gaps(spark):
    rows = common.numbered(spark.range(0, 1000, 1, 7).where("id % 3 > 0 and id > 300"), "n", "at").orderBy("id").collect()
    assert [r.at for r in rows] == list(range(len(rows)))


# -- redaction


def test_redaction_of_a_long_log_is_linear(spark):
    import time

    from graphloom.llm import secrets

    line = "x password=hunter{} y\n"
    docs = lambda n: spark.createDataFrame([(1, "".join(line.format(100_000 + i) for i in range(n)), "s", 0)], "doc_id long, text string, source string, n_chars long")
    took = {}
    for n in (100, 20_000, 80_000):
        began = time.perf_counter()
        (row,) = secrets.redact(docs(n)).collect()
        took[n] = time.perf_counter() - began
        assert row.text == "x [secret] y\n" * n and row.n_chars == len(row.text)
    assert took[80_000] - took[100] < 12 * max(1, took[20_000] - took[100])


def test_redaction_joins_overlapping_spans_and_keeps_other_columns(spark):
    from graphloom.llm import secrets

    spans = [(0, 3), (2, 5), (3, 4), (7, 9), (9, 10)]
    assert secrets._without("0123456789ab", [{"start": a, "end": b} for a, b in spans], "*") == "*56**ab"
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.redact(empty).count() == 0 and secrets.redact(empty).columns == empty.columns


def test_near_groups_with_a_shingle_in_most_texts(spark, monkeypatch):
    from graphloom.llm import near_dedup

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "HOT_PARTS", 20)
    monkeypatch.setattr(near_dedup, "CELL", 8)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    head = "the same five first words here "
    texts = [head + " ".join(rng.choice(words) for _ in range(12)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + [head + "only"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    up = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if up[i] != up[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    up[i] = up[j] = min(up[i], up[j])
    assert {r.id: r.keep for r in near_dedup.near_groups(rows).collect()} == dict(enumerate(up))


def test_parities_never_show_more_than_sets_differ_in():
    from graphloom.llm import near_dedup

    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 300, 5000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(-(2**63), 2**63 - 1, n // 3 + 2)]))
        bits = np.bitwise_count((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64)).sum()
        assert len(near_dedup.parity(a)) == near_dedup.PARITY and bits <= len(np.setxor1d(a, b))
