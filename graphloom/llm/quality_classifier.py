"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model gives each document's own evidence, one head for quality and one for toxicity.  The mean of the
posteriors of all other documents of its host and of its path says what to expect there before the text is read: a path is
shrunk toward its host and a host toward the whole corpus, by strengths estimated from the spread between sites (method of
moments).  A document's posterior is its own likelihood ratio times the prior odds that the others of its site give, so its
evidence counts once, and a document alone at its site has the global prior.

The fit takes at most MAX_LABELLED labelled documents, chosen by hash of the id, and WORDS words per head, chosen by
their G-test on those; site statistics are grouped aggregations over all documents.  Texts are read for evidence once.

Defined results: null and empty texts have no words and are judged by shape and site; a null host or path is a site of
its own; repeated rows are judged alike but for themselves; of contradicting labels of one id the less favourable counts (quality 0, toxic
1), null labels don't; without labels, or with labels of one kind, the head is the smoothed rate and everything within 0.5 is kept;
extra columns pass through, whatever their names, but for one that has the name of a result, which gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, tidy

#: Bounds of the fit: labelled documents, marks for each head, documents that a mark must be in, and its G-test at least (10: one in 600 by chance).
MAX_LABELLED, WORDS, LEAST_DOCS, LEAST_GAIN = 10_000, 150, 4, 10.0
#: A mark is a word, or a longer word's first letters.
PREFIX = 5
HEADS = ("quality", "toxic")
_WORD = re.compile(r"[^\W_]+")
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>!"
N_SHAPES = 7


def marks(text: str) -> tuple[Counter, int]:
    """Times of each word and each prefix (marked ^) of longer words, and the number of words."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter(words)
    for w, k in words.items():
        if len(w) > PREFIX:
            out["^" + w[:PREFIX]] += k
    return out, words.total()


def hits(text: str, at: dict[str, int]) -> tuple[list[int], list[float]]:
    """The known marks of a text, and how dense each one is."""
    found, n = marks(text)
    own = found.keys() & at.keys()
    return [at[w] for w in own], [math.log1p(found[w] * 200 / max(n, 20)) for w in own]


def shapes(text: bytes) -> list[float]:
    """Shape of a text: shares of symbols, capitals, repeated words and repeated lines, word length, length."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols, capitals = size - len(text.translate(None, _SYMBOLS)), size - len(text.translate(None, _UPPER))
    if not text:
        symbols = capitals = 0
    return [
        min(1.0, symbols / n), capitals / size * 5, 1 - len(set(words)) / n if words else 0.0, 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        abs(len(text) / n - 6) / 6 if words else 1.0, min(3.0, math.log1p(n) / 3), float(len(words) < 10),
    ]


@lru_cache(1)
def _places(words: tuple[str, ...]) -> dict[str, int]:
    return {x: i for i, x in enumerate(words)}


@dataclass(frozen=True)
class Model:
    """weights: (heads, presence of each mark + density of each + shapes + 1); rates: share of ones among the labels of each head."""

    words: tuple[str, ...]
    weights: np.ndarray
    rates: tuple[float, ...]

    def logits(self, texts: list[str]) -> np.ndarray:
        at, n, w = _places(self.words), len(self.words), self.weights
        out = np.empty((len(texts), len(HEADS)))
        for row, text in enumerate(texts):
            found, dense = hits(text, at)
            out[row] = w[:, found].sum(axis=1) + w[:, n : 2 * n][:, found] @ np.array(dense) + w[:, 2 * n : -1] @ shapes(text.encode()) + w[:, -1]
        return np.clip(out, -30, 30)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _regress(x: np.ndarray, y: np.ndarray, penalty: float = 0.2, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of x is the intercept, not shrunk."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, words: int = WORDS) -> Model:
    """Fit both heads on at most max_labelled labelled documents."""
    label = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    label = label.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    label = label.groupBy("id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    label = label.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(label), "id")
    sample = materialize(sample.groupBy("id").agg(F.min("text").alias("text"), F.first("q").alias("q"), F.first("t").alias("t")).select("text", "q", "t"), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, q, t = Counter(), Counter(), Counter()
        for batch in batches:
            for text, yq, yt in zip(*(batch.column(c).to_pylist() for c in ("text", "q", "t")), strict=True):
                own = marks(text or "")[0].keys()
                n.update(own)
                if yq:
                    q.update(own)
                if yt:
                    t.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([c[w] for w in n], pa.int64()) for c in (n, q, t))], ["word", "n", "q", "t"])

    total, ones_q, ones_t = sample.agg(F.count("*"), F.sum("q"), F.sum("t")).first()
    ones = (ones_q or 0, ones_t or 0)
    rates = tuple((k + 1) / (total + 2) for k in ones)
    if not total or any(k in (0, total) for k in ones):
        weights = np.zeros((len(HEADS), N_SHAPES + 1))
        weights[:, -1] = [_logit(r) for r in rates]
        return Model((), weights, rates)
    counts = sample.mapInArrow(tidy(count), "word string, n long, q long, t long").groupBy("word").agg(*(F.sum(c).alias(c) for c in "nqt")).where(F.col("n") >= LEAST_DOCS)

    def gain(k: str, rate: float) -> Column:  # G-test of one against zero among the texts with the word
        term = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)
        return term(F.col(k), rate) + term(F.col("n") - F.col(k), 1 - rate)

    chosen: dict[str, None] = {}
    for k, one in zip("qt", ones, strict=True):
        score = gain(k, one / total)
        for r in counts.where(score >= LEAST_GAIN).orderBy(F.desc(score), "word").limit(words).collect():
            chosen[r.word] = None
    known = tuple(chosen)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(known)}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, dense = zip(*(hits(t, at) for t in texts), strict=True) if texts else ([], [])
            cols = [pa.array(found, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64())), pa.array([shapes(t.encode()) for t in texts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("q"), batch.column("t")], ["hits", "dense", "shape", "q", "t"])

    rows = sample.mapInArrow(tidy(vectors), "hits array<int>, dense array<double>, shape array<double>, q int, t int").toPandas()  # max_labelled short rows
    n = len(known)
    x = np.zeros((len(rows), 2 * n + N_SHAPES + 1), np.float64)
    for i, (found, dense, shape) in enumerate(zip(rows["hits"], rows["dense"], rows["shape"], strict=True)):
        x[i, np.asarray(found, np.int64)] = 1
        x[i, n + np.asarray(found, np.int64)] = dense
        x[i, 2 * n : -1] = shape
    x[:, -1] = 1
    return Model(known, np.stack([_regress(x, rows[c].to_numpy(np.float64)) for c in "qt"]), rates)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(sites: DataFrame, h: str) -> tuple[float, float]:
    """(mean, pseudo-count of the prior) from the spread of site means beyond what chance makes of them."""
    r = sites.agg(F.sum("n").alias("n"), F.sum(f"s_{h}").alias("s"), F.sum(f"ss_{h}").alias("ss"), F.sum(F.col(f"s_{h}") ** 2 / F.col("n")).alias("b"), F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.count("*").alias("k")).first()
    if not r.n:
        return 0.5, 1.0
    mean = min(max(r.s / r.n, 1e-4), 1 - 1e-4)
    noise = max((r.ss - r.b) / max(1, r.n - r.k), 1e-9)
    scale = r.n - r.nn / r.n
    between = max(0.0, (r.b - r.n * mean**2 - (r.k - 1) * noise) / scale) if scale > 0 else 0.0
    return mean, min(max(noise / between if between > 0 else 1e6, 1.0), 1e6)


@dataclass(frozen=True)
class Sites:
    """statistics: a row per site with n, host_n and the sums of posteriors s_ and host_s_ of each head; strengths: head to (mean, host's pseudo-count, path's)."""

    statistics: DataFrame
    strengths: dict[str, tuple[float, float, float]]

    def prior(self, h: str, own: Column) -> Column:
        """Log odds that the other documents of a site, without the one whose posterior is own, give."""
        mean, k_host, k_path = self.strengths[h]
        at_host = (F.col(f"__host_s_{h}") - own + k_host * mean) / (F.col("__host_n") - 1 + k_host)
        at_path = (F.col(f"__s_{h}") - own + k_path * at_host) / (F.col("__n") - 1 + k_path)
        p = F.least(F.greatest(at_path, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))


def site_statistics(scored: DataFrame) -> Sites:
    """From rows (__host, __path, __logit_quality, __logit_toxic)."""
    moments = [f(F.col(f"p_{h}")).alias(f"{k}_{h}") for h in HEADS for k, f in (("s", F.sum), ("ss", lambda c: F.sum(c * c)))]
    probable = scored.select(_key("__host").alias("host"), site_key("__host", "__path").alias("site"), *(_sigmoid(F.col(f"__logit_{h}")).alias(f"p_{h}") for h in HEADS))
    paths = materialize(probable.groupBy("host", "site").agg(F.count("*").alias("n"), *moments), "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in paths.columns if c not in ("host", "site"))), "quality-hosts")
    strengths = {h: (*_strength(hosts, h), _strength(paths, h)[1]) for h in HEADS}
    of_host = hosts.select("host", "paths", F.col("n").alias("__host_n"), *(F.col(f"s_{h}").alias(f"__host_s_{h}") for h in HEADS))
    told = lookup_join(paths, of_host, "host", "paths")  # a host may have any number of paths
    return Sites(materialize(told.select(F.col("site").alias("__site"), F.col("n").alias("__n"), F.col("n").alias("__weight"), "__host_n", *(c for h in HEADS for c in (F.col(f"s_{h}").alias(f"__s_{h}"), f"__host_s_{h}"))), "quality-sites"), strengths)


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))


def site_key(host: str, path: str) -> Column:
    """One string for (host, path), nulls apart from every value."""
    return F.concat(_key(host), F.lit("/"), _key(path))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", model: Model | None = None, columns: list[str] | None = None, results: tuple[str, str, str] = ("p_quality", "p_toxic", "kept")) -> DataFrame:
    """The columns of docs (all, or those named) plus p_quality, p_toxic (posteriors) and kept: p_quality at least 0.5 and p_toxic at most 0.5.

    The rows are written once with their evidence, which is why a caller who needs no texts should name its columns.
    """
    model = model or fit(docs, labels, id_col, text_col)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in results]

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        made = np.concatenate([model.logits([t.as_py() or ""]) for t in texts]) if len(texts) else np.zeros((0, len(HEADS)))
        return pa.ListArray.from_arrays(np.arange(0, made.size + 1, len(HEADS), dtype=np.int32), pa.array(made.ravel()))

    rows = docs.select(*columns, F.col(host_col).alias("__host"), F.col(path_col).alias("__path"), evidence(F.col(text_col)).alias("__e"))
    scored = rows.select(*columns, "__host", "__path", *(F.col("__e")[i].alias(f"__logit_{h}") for i, h in enumerate(HEADS)))
    scored = materialize(scored, "quality-scored")
    sites = site_statistics(scored)
    out = lookup_join(scored.withColumn("__site", site_key("__host", "__path")), sites.statistics, "__site", "__weight")
    for h, rate, name in zip(HEADS, model.rates, results, strict=False):
        logit = F.col(f"__logit_{h}")
        out = out.withColumn(name, _sigmoid(logit - _logit(rate) + sites.prior(h, _sigmoid(logit))))
    return out.select(*columns, *results[:2], ((F.col(results[0]) >= 0.5) & (F.col(results[1]) <= 0.5)).alias(results[2]))
