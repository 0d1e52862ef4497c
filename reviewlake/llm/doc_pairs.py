"""Problem 2: functions paired with their documentation.

Every function is read with the class hierarchy around it and takes the nearest documentation: its own, or that of the
nearest method of the same name up the hierarchy of its repository; what stays without documentation of substance is
dropped.  The hierarchy is closed by repeated joins over the heads of all classes, those without methods too, until no
class gains an ancestor.

Defined results: null or empty content, unknown languages and invalid texts give no rows; repeated rows give one result;
of functions of one name on one line one with documentation of substance counts, and one without; a class name that a
repository declares several times stands for the declaration with bases in the file of the smallest ``file_id``; of
several nearest methods the smallest documentation counts; cycles end where they began.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .functions_docs import declared
from .substance import clean, has_substance
from .syntax import DEPTH

SCHEMA = "file_id bigint, repository_id string, path string, line_start bigint, name string, kind string, owner string, bases array<string>, signature string, docstring string, has_substance boolean"


def declarations_of(files: DataFrame) -> DataFrame:
    """One row per function, documented or not, and class head (kind ``class``) and input row.  No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(DEPTH, sys.getrecursionlimit()))
        for b in batches:
            rows = []
            for f, r, p, c in zip(b["file_id"], b["repository_id"], b["path"], b["content"]):
                # A Python text is checked by its parser on the way; the grammar of the others refuses invalid ones.
                for d in declared(p, c):
                    head = d.kind == "class"
                    rows.append((f, r, p, d.line_start, d.name, d.kind, d.owner, d.bases, d.signature, None if d.doc is None else clean(d.doc), not head and has_substance(d.doc, d.name)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return spread(files.select("file_id", "repository_id", "path", "content")).mapInPandas(run, SCHEMA)


def _simple() -> Column:
    """The name of the class that ``base`` names."""
    return F.regexp_extract(F.element_at(F.split("base", r"\."), -1), r"^\w+", 0)


def ancestors(heads: DataFrame) -> DataFrame:
    """``repository_id, class, ancestor, distance`` of ``repository_id, class, bases``, with each class its own ancestor.

    Each round joins the closure with itself, which doubles the distance it reaches, and writes it to the checkpoint
    folder; a pair stands once with its least distance, so cycles add nothing.  The last round finds no new pair.
    """
    keys = ["repository_id", "class", "ancestor"]
    edges = heads.select("repository_id", "class", F.explode("bases").alias("base")).select("repository_id", "class", _simple().alias("ancestor"), F.lit(1).alias("distance"))
    nodes = edges.select("repository_id", F.explode(F.array("class", "ancestor")).alias("class")).select("repository_id", "class", F.col("class").alias("ancestor"), F.lit(0).alias("distance"))
    up = cut(edges.unionByName(nodes).groupBy(keys).agg(F.min("distance").alias("distance")))
    known, reached = -1, up.count()
    while reached > known:
        known = reached
        # Pairs of distance 0 keep what is known in the product.
        first = up.withColumnsRenamed({"ancestor": "via", "distance": "d1"})
        then = up.withColumnsRenamed({"class": "via", "distance": "d2"})
        up = cut(first.join(then, ["repository_id", "via"]).select(*keys, (F.col("d1") + F.col("d2")).alias("distance")).groupBy(keys).agg(F.min("distance").alias("distance")))
        reached = up.count()
    return up


def function_doc_pairs(files: DataFrame) -> DataFrame:
    """``file_id, line_start, name, kind, owner, signature, docstring, doc_source``; ``doc_source`` is own or inherited.

    Methods meet the ancestors of their base classes on (repository, class) and the documented methods on (repository,
    class, method), which spreads a repository that holds many of the rows over its classes.  Functions and class heads
    are written to the checkpoint folder first, so that the joins do not read the texts again.  A function's own
    documentation is at distance 0, that of a base class at 1.
    """
    declarations = cut(declarations_of(files).withColumn("head", F.expr("kind = 'class'")).dropDuplicates(["file_id", "line_start", "name", "head", "has_substance"]))
    functions = declarations.filter("not head").drop("head")
    columns = ["file_id", "line_start", "name", "kind", "owner", "signature"]
    own = functions.filter("has_substance").select(*columns, F.lit(0).alias("distance"), "docstring")

    methods = functions.filter("kind = 'method' and owner is not null")
    classes = declarations.filter("head and size(bases) > 0").groupBy("repository_id", F.col("owner").alias("class")).agg(F.min_by("bases", F.struct("file_id", "line_start")).alias("bases"))
    documented_methods = methods.filter("has_substance").groupBy("repository_id", F.col("owner").alias("ancestor"), "name").agg(F.min_by("docstring", "file_id").alias("base_doc"))
    climbing = methods.filter("not has_substance").select(*columns, "repository_id", F.explode("bases").alias("base")).select("*", _simple().alias("class")).drop("base")
    # A base that is no class with bases of its own is its own only ancestor.
    up = climbing.join(ancestors(classes), ["repository_id", "class"], "left").withColumns({"ancestor": F.coalesce("ancestor", "class"), "distance": F.coalesce("distance", F.lit(0))})
    met = up.join(documented_methods, ["repository_id", "ancestor", "name"])
    inherited = met.select(*columns, (F.col("distance") + 1).alias("distance"), F.col("base_doc").alias("docstring"))
    nearest = own.unionByName(inherited).groupBy(columns).agg(F.min(F.struct("distance", "docstring")).alias("nearest"))
    return nearest.select(*columns, "nearest.docstring", F.when(F.col("nearest.distance") == 0, "own").otherwise("inherited").alias("doc_source"))


def found(files: DataFrame) -> DataFrame:
    """Functions whose nearest documentation is their own; what is inherited is paired, but no case."""
    return function_doc_pairs(files).filter("doc_source = 'own'").select("file_id", "line_start")
