"""The ontology as tables, and a reader of simple Turtle files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphloom import model

_TOKEN = re.compile(r'"""(?:.|\n)*?"""(?:@\w+|\^\^\S+)?|"(?:\\.|[^"\\])*"(?:@\w+|\^\^[^\s;,.]+)?|<[^>]*>|@?[\w:-]+(?:\.[\w-]+)*|[.;,\[\]()]')


def schema_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(classes, relations): every class with its kind, every relation with its algebra."""
    classes = [(c, "object") for c in model.OBJECT_TYPES] + [(c, "entity") for c in model.ENTITY_TYPES]
    inverse = dict(model.INVERSE) | {b: a for a, b in model.INVERSE}
    relations = [(r, r in model.SYMMETRIC, r in model.TRANSITIVE, inverse.get(r)) for r in model.REL_TYPES]
    return spark.createDataFrame(classes, "name string, kind string"), spark.createDataFrame(relations, "name string, symmetric boolean, transitive boolean, inverse string")


def parse_turtle(text: str) -> set[tuple[str, str, str]]:
    """(s, p, o) of statements with `;` and `,` lists; prefixes stay as written, comments go, blank nodes are not read."""
    text = re.sub(r"(?m)(^|\s)#[^\n]*", r"\1", text)
    out, s, p, need = set(), "", "", "s"
    tokens = iter(_TOKEN.findall(text))
    for t in tokens:
        if t in ("@prefix", "@base", "PREFIX", "BASE"):
            for x in tokens:
                if x == "." or t.isupper() and x.startswith("<"):
                    break
        elif t == ".":
            need = "s"
        elif t == ";":
            need = "p"
        elif t == ",":
            need = "o"
        elif need == "s":
            s, need = t, "p"
        elif need == "p":
            p, need = "rdf:type" if t == "a" else t, "o"
        else:
            out.add((s, p, t))
    return out


def load(spark: SparkSession, path: str, have: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(triples, how many are new) of the Turtle files at path; loading again adds none.  An ontology is small: it is read as one text per file."""
    rows = spark.read.text(path, wholetext=True).rdd.flatMap(lambda r: parse_turtle(r[0])).distinct()
    found = spark.createDataFrame(rows, "s string, p string, o string")
    if have is None:
        return found, found.count()
    new = found.join(have, ["s", "p", "o"], "left_anti")
    return have.unionByName(new), new.count()
