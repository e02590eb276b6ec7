"""Secret scans with corpus-wide ownership frequency.

Two kinds of finding.  The base kinds (assign, access, hex) are reported wherever they match.  The candidates (kind
`token`: long runs that mix upper case, lower case and digits) are reported only where the corpus says that they are
somebody's own: the hash of every value is counted over distinct owners, and a value that more than `max_owners` owners
and more than `owner_share` of the corpus's owners carry is a copied example, not a live credential.  In how many documents an
owner repeats it does not matter.  Base findings get the same label but stay, and are always redacted.

Defined results: a null text is empty and has no finding; repeated rows each carry their findings; a null owner is one owner
of its own; columns other than those named are passed through `redact` and not read by `scan`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_join, materialize, parted, tidy

KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of all base findings and candidates of a text, in order.

    A candidate that overlaps a base finding is not a finding of its own.
    """
    found = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((s, e) for s, _, e, _ in found)
    at, reach = 0, 0  # base spans that begin before the candidate's end, and how far they go
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][1]), at + 1
        if reach <= m.start() and _mixed(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


SCANNED = "row long, id {id}, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, finds array<struct<kind:int,start:int,end:int,value_hash:binary>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.binary())])
    for batch in batches:
        counts, shas, finds = ([], [], []), [], []
        for cell in batch.column("text"):
            text = cell.as_py()
            found = find(text) if text else []
            for k in range(3):
                counts[k].append(sum(f[1] == k for f in found))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found if k < 3).encode()).hexdigest())
            finds.append([{"kind": k, "start": s, "end": e, "value_hash": hashlib.sha256(v.encode()).digest()[:16]} for s, k, e, v in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("row", "id", "owner")] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(shas, pa.string()), pa.array(finds, pa.list_(made))],
            ["row", "id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "finds"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, owner_share: float = 0.01) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, and findings, an array of (kind, start, end, live) by start and kind.

    live: at most max_owners owners, or at most owner_share of all owners, carry the value.  Candidates that are not live are left out.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x1e")).alias("owner"),
        F.col(text_col).alias("text"),
    )
    scanned = materialize(rows.mapInArrow(tidy(_scan), SCANNED.format(id=rows.schema["id"].dataType.simpleString())), "secrets-scanned")
    each = scanned.select("row", "owner", F.explode("finds").alias("f")).select("row", "owner", "f.*")
    # Distinct owners by two plain aggregations, so that a value in a third of all rows is combined before any shuffle.
    by_owner = each.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    owned = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    most = max(max_owners, int(owner_share * scanned.select("owner").distinct().count()))
    owned = materialize(owned.select("value_hash", (F.col("owners") <= most).alias("live"), "n"), "secrets-owned")
    told = lookup_join(each.select("row", "kind", "start", "end", "value_hash"), owned, "value_hash", "n")
    told = told.where((F.col("kind") < 3) | F.col("live"))
    per_row = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("findings"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    out = scanned.where(F.size("finds") == 0).select("id", "n_assign", "n_access", "n_hex", "base_sha256", none.alias("findings"))
    some = scanned.where(F.size("finds") > 0).drop("finds").join(per_row, "row", "left")
    out = out.unionByName(some.select("id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("findings", none).alias("findings")))
    return out.withColumnRenamed("id", id_col)


def spans(findings: str = "findings") -> F.Column:
    """Findings as `kind:start:end`, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(findings), lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"], f["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", n_chars_col: str = "n_chars", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with every finding's span replaced, base findings always and candidates where live, by `mark` (overlapping spans by one mark), and n_chars_col set to the new length.

    Documents without such a finding pass as they are, where they lie: only texts that may have one are joined to their spans.
    Repeated rows are redacted alike; no document is lost.  Rows are told apart by id and text together, so null and
    repeated ids do no harm; a column of docs may have any name that does not begin with `__`.
    """
    none = F.lit("\x1e")
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), none), none, F.coalesce(F.col(text_col), none)), 256)
    owner = options.pop("owner_col", "source")
    keyed = docs.select(key.alias("__key"), F.col(text_col).alias("__text"), F.col(owner).alias("__owner"))
    found = scan(keyed, id_col="__key", text_col="__text", owner_col="__owner", **options)
    told = found.select("__key", F.col("findings").alias("__found")).where(F.size("__found") > 0).dropDuplicates(["__key"])
    told = materialize(told, "secrets-found")
    untouched, some = parted(docs, key, told, F.col("__key"))
    joined = some.withColumn("__key", key).join(told, "__key", "left")
    schema = docs.schema
    whole = joined.select(*(F.col(f"`{c}`") for c in docs.columns), "__found")
    return untouched.unionByName(whole.mapInArrow(tidy(_redacted(mark, text_col, n_chars_col, schema)), schema))


def _without(text: str, found: list[dict], mark: str) -> str:
    """The text with the sorted spans replaced, overlapping ones by one mark; each piece is copied once."""
    out, at = [], 0
    for f in found:
        if f["start"] >= at:
            out += [text[at : f["start"]], mark]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])


def _redacted(mark: str, text_col: str, n_chars_col: str, schema: T.StructType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in schema.names}
            texts, found = columns[text_col].to_pylist(), batch.column("__found").to_pylist()
            told = [_without(t, f, mark) if f else t for t, f in zip(texts, found, strict=True)]
            if n_chars_col in columns:
                sizes = [len(n) if f else x for n, f, x in zip(told, found, columns[n_chars_col].to_pylist(), strict=True)]
                columns[n_chars_col] = pa.array(sizes, columns[n_chars_col].type)
            columns[text_col] = pa.array(told, columns[text_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema.names)

    return run
