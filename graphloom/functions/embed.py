"""Embedding and classification providers.  A provider is a function of a batch; services are the caller's to plug in."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.scoring import classified
from graphloom.functions.text import embed_text

Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dimensions: int = 64) -> Provider:
    """Signed hashes of words, scaled to length one: no model, no network, the same everywhere."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return run


def embed(title: Column, content: Column, provider: Provider | None = None) -> Column:
    """array<float> of title and the start of the content."""
    call = provider or hashing_provider()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(call([t or "" for t in texts])))

    return run(embed_text(title, content))


def topic(content: Column, topics: dict[str, tuple[str, ...]], default: str) -> Column:
    """The topic with most of its keywords in the text; ties go to the last name, none to the default."""
    low = F.lower(content)
    scores = [F.struct(sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)).alias("n"), F.lit(name).alias("name")) for name, keys in topics.items()]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


ANSWER = "struct<type:string,summary:string,tags:array<string>,project:string,confidence:double>"


def parse_answer(answer: Column) -> Column:
    """A service's JSON answer, with or without a code fence; null where it is none."""
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```\w*\s*|\s*```$", "")
    return F.from_json(bare, ANSWER, {"mode": "PERMISSIVE"})


def classification(answer: Column, title: Column) -> Column:
    """(type, summary, tags, project, confidence), checked; without an answer: idea, the title, confidence 0."""
    p = parse_answer(answer)
    kind, confidence = classified(p["type"], p["confidence"])
    ok = p["type"].isNotNull()
    return F.struct(
        F.when(ok, kind).otherwise("idea").alias("type"), F.when(ok, F.coalesce(p["summary"], title)).otherwise(title).alias("summary"), F.coalesce(F.array_join(p["tags"], ", "), F.lit("")).alias("tags"),
        F.coalesce(p["project"], F.lit("")).alias("project"), F.when(ok, confidence).otherwise(0.0).alias("confidence"),
    )


def ask(prompts: Column, service: Callable[[str], str]) -> Column:
    """A service's answers; what it raises becomes an empty answer, so one failure costs one row."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            try:
                return service(p)
            except Exception as e:
                return json.dumps({"error": str(e)[:200]})

        return batch.map(one)

    return run(prompts)
