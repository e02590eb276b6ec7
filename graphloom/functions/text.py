"""Text functions as column expressions; Python only where no expression says it (stemming, loose YAML, sequence ratio)."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import ENTITY_STOPWORDS, FIELD_WEIGHTS, TECHNOLOGIES, TEMPLATES, V1_TYPES

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, all of which a document must hold; quotes and operators are ordinary separators."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split()))


def search_terms(query: str, stemmed: bool = False) -> list[str]:
    """A query's terms as an index holds them."""
    terms = query_terms(query)
    return list(dict.fromkeys(porter(fold(t)) for t in terms)) if stemmed else terms


def bm25(objects: DataFrame, query: str | list[str], weights: dict[str, float] = FIELD_WEIGHTS, stemmed: bool = False) -> DataFrame:
    """(id, raw): Okapi BM25 over weighted fields, documents that hold every term only.

    One scan counts the query's terms per document and one aggregate row holds the corpus statistics; no postings are
    exploded or shuffled.  A blank query has no rows.
    """
    terms = search_terms(query if isinstance(query, str) else " ".join(query), stemmed)
    if not terms:
        return objects.select("id", F.lit(0.0).alias("raw")).limit(0)
    split = stems if stemmed else tokens
    by_field = objects.select("id", *(split(F.col(f)).alias(f) for f in weights))
    count = lambda f, t: F.size(F.filter(F.col(f), lambda x: x == t))
    tf = [sum((F.lit(w) * count(f, t) for f, w in weights.items()), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = by_field.select("id", *tf, sum((F.size(f) for f in weights), F.lit(0)).alias("len"))
    stats = counted.agg(F.count("*").alias("n_docs"), (F.sum("len") / F.count("*")).alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = counted.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score += idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.select("id", score.alias("raw"))


def fold(term: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Vowel runs that a consonant follows."""
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if a + b == "vc")


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


# Fixed values of the published algorithm: endings of steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(100_000)
def porter(w: str) -> str:
    """Porter's stemmer."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(stem := w[: -len(end)]):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if found := max((x for x in table if w.endswith(x[0])), key=lambda x: len(x[0]), default=None):
            if _measure(w[: -len(found[0])]) > 0:
                w = w[: -len(found[0])] + found[1]
    if end := max((x for x in _STEP4 if w.endswith(x)), key=len, default=None):
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _cvc(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Tokens that a Python task works on at a time.
BATCH_TOKENS = 1 << 18


def by_tokens(batch: pa.RecordBatch, lists: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose lists hold up to BATCH_TOKENS items together, a longer row alone."""
    ends = np.cumsum(sum(batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists))
    at = 0
    while at < batch.num_rows:
        held = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, held + BATCH_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _stemmed(tokens: pa.ListArray) -> pa.ListArray:
    """A slice's tokens, each distinct one stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    known = pa.array([porter(fold(t)) for t in coded.dictionary.to_pylist()], pa.string())
    offsets = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), known.take(coded.indices))


def stems(text: Column) -> Column:
    """Stemmed tokens without diacritics, in batches that stay Arrow's; Python strings are made for distinct tokens only."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        parts = [_stemmed(part.column("t")) for part in by_tokens(pa.RecordBatch.from_arrays([batch], ["t"]), ["t"])]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return run(tokens(text))


# -- notes and their links


def frontmatter(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)^---\s*\n.*?\n---\s*\n", "")


def wiki_links(text: Column) -> Column:
    """Targets of [[links]], each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1))


def normal_title(title: Column) -> Column:
    """Lower case, no leading date, letters, digits and white space only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"^\d{4}-\d{2}-\d{2}[\s-]*", ""), r"[^a-z0-9\s]", ""))


def without_related(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"(?s)\n## Related\b.*", ""))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def safe_filename(title: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_")), 1, 100)


def hashtag(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("#"), kind, F.lit("/"), F.replace(name, F.lit(" "), F.lit("_")))


def local_name(iri: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(iri, "#", -1), "/", -1))


def embed_text(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.substring(content, 1, 2000))


def iso_day(text: Column) -> Column:
    """YYYY-MM-DD as midnight UTC, anything else null."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), F.lit("yyyy-MM-dd"))


def tag_list(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def tag_type(tag: Column) -> Column:
    return F.when(tag.isin(*TECHNOLOGIES), "technology").otherwise("concept")


def v1_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in V1_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(kind)), F.lit("idea"))


def is_stopword(name: Column, more: tuple[str, ...] = ()) -> Column:
    return F.lower(F.trim(name)).isin(*ENTITY_STOPWORDS, *more)


def infer_type(front: Column, path: Column, allowed: tuple[str, ...]) -> Column:
    """The frontmatter's type if known, else the first (alphabetically) that the path has as a folder, single or plural, else idea."""
    out = F.lit("idea")
    for t in sorted(allowed, reverse=True):
        out = F.when(F.concat(F.lit("/"), F.lower(path)).rlike(f"/{t}s?/"), t).otherwise(out)
    return F.when(F.lower(front).isin(*allowed), F.lower(front)).otherwise(out)


def infer_project(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")


def render_template(name: str, fields: dict[str, Column]) -> tuple[Column, Column]:
    """(content, properties) of a capture template; empty fields are left out."""
    required, optional = TEMPLATES[name]
    blocks, pairs = [], []
    for f in (*required, *optional):
        if f in fields:
            value = F.trim(F.coalesce(fields[f], F.lit("")))
            words = f.split("_")
            label, key = " ".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:])
            blocks.append(F.when(value != "", F.concat(F.lit(f"## {label}\n"), value)))
            pairs.append(F.when(value != "", F.struct(F.lit(key), value)))
    return F.concat_ws("\n\n", *blocks), F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def sequence_ratio(a: Column, b: Column, over: float = -1.0) -> Column:
    """Ratio of matching blocks, in batches; 0 where the letters in common already show that it is not more than `over`."""

    def one(p: str, q: str) -> float:
        m = difflib.SequenceMatcher(None, p, q)
        return m.ratio() if over < 0 or (m.real_quick_ratio() > over and m.quick_ratio() > over) else 0.0

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return run.asNondeterministic()(a, b)  # so that no filter on it is pushed to where there are more rows


def _letters(names: list[str], codes: dict[str, int]) -> np.ndarray:
    """(name, place) -> number of the letter, 0 behind the end."""
    out = np.zeros((len(names), max(map(len, names), default=0)), np.int32)
    for i, s in enumerate(names):
        out[i, : len(s)] = [codes[c] for c in s]
    return out


def _bags(letters: np.ndarray, n_codes: int, most: int) -> np.ndarray:
    """Unary counts of each letter, so that a product of two rows is the number of letters in common."""
    counts = np.stack([(letters == c).sum(1) for c in range(1, n_codes + 1)], 1) if n_codes else np.zeros((len(letters), 0))
    return (counts[:, :, None] > np.arange(most)).reshape(len(letters), -1).astype(np.float32)


def _common(of: np.ndarray, masks: np.ndarray, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of pairs of a word-long name (row of masks) and any other (row of letters), all pairs at once by bits."""
    v = np.full(len(of), np.uint64(0xFFFFFFFFFFFFFFFF))
    for p in range(letters.shape[1]):
        u = v & masks[of, letters[at, p]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def likest(asked: pa.ChunkedArray, known: pa.ChunkedArray, over: float) -> pa.Table:
    """(a, b, ratio): for each of asked the known name with the highest ratio of matching blocks over `over`, of equal ones the greatest.

    Matching blocks are a common subsequence, so a ratio is not over twice the longest one's length by both lengths, nor over that of the letters
    in common.  These bounds, the second for all pairs by one product, the first for what it leaves, tell which pairs are worth their
    ratio; a name's pairs are tried from the highest bound down to the best ratio found.
    """
    a, b = asked.to_pylist(), known.to_pylist()
    best: dict[str, tuple[float, str]] = {}
    if a and b:
        codes = {c: i + 1 for i, c in enumerate(sorted(set("".join(a)) | set("".join(b))))}
        la, lb = _letters(a, codes), _letters(b, codes)
        na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        masks = np.zeros((len(a), len(codes) + 1), np.uint64)  # bit p: the letter is at place p; only for names of a word's length
        for p in range(min(64, la.shape[1])):
            rows = np.flatnonzero(na > p)
            masks[rows, la[rows, p]] |= np.uint64(1 << p)
        most = max(max((s.count(c) for c in set(s)), default=0) for names in (a, b) for s in names)
        counted = len(codes) * most <= 4096  # else the letters' counts would take more memory than they save work
        of_a, of_b = (_bags(x, len(codes), most) if counted else None for x in (la, lb))
        for start in range(0, len(a), 256):
            part = slice(start, start + 256)
            total = na[part, None] + nb
            bound = 2 * np.minimum(na[part, None], nb)
            bound = np.minimum(bound, 2 * (of_a[part] @ of_b.T)) if counted else bound
            i, j = np.nonzero(bound > over * total - 1e-6)
            top = bound[i, j] / total[i, j]
            i = i + start
            short = np.flatnonzero(na[i] <= 64)
            for cut in range(0, len(short), 1 << 18):
                at = short[cut : cut + (1 << 18)]
                top[at] = np.minimum(top[at], 2 * _common(i[at], masks, lb, j[at]) / (na[i[at]] + nb[j[at]]))
            kept = np.flatnonzero(top > over - 1e-9)
            for k in kept[np.lexsort((-top[kept], i[kept]))]:
                p, q = a[i[k]], b[j[k]]
                found = best.get(p, (over, ""))
                if top[k] < found[0] - 1e-9:
                    continue
                ratio = difflib.SequenceMatcher(None, p, q).ratio()
                if ratio > over and (ratio, q) > found:
                    best[p] = (ratio, q)
    return pa.table({"a": pa.array(list(best), pa.string()), "b": pa.array([q for _, q in best.values()], pa.string()), "ratio": pa.array([r for r, _ in best.values()], pa.float64())})


def parse_front(text: str | None) -> dict[str, str]:
    """Loose YAML: scalars, inline and block lists (comma-joined), folded and literal blocks."""
    out: dict[str, str] = {}
    key, items, mode = None, [], ""

    def close() -> None:
        if key and items:
            out[key] = {"list": ", ", ">": " ", "|": "\n"}[mode].join(items)

    for line in (text or "").split("\n"):
        bare = line.strip()
        if key and mode == "list" and bare.startswith("- "):
            items.append(bare[2:].strip().strip("\"'"))
        elif key and mode in (">", "|") and (line.startswith((" ", "\t")) or not bare):
            items.append(bare)
        elif ":" in line and not line.startswith((" ", "\t", "#")):
            close()
            key, _, value = (x.strip() for x in line.partition(":"))
            items, mode = [], "list"
            if value[:1] in (">", "|"):
                mode = value[0]
            elif value.startswith("[") and value.endswith("]"):
                items = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
            elif value:
                out[key], key = value.strip("\"'"), None
    close()
    return out


def front_map(front: Column) -> Column:
    @F.pandas_udf("array<struct<k:string,v:string>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [{"k": k, "v": v} for k, v in parse_front(t).items()])

    return F.map_from_entries(run(front))
