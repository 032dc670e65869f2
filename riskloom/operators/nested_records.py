"""Relational form of nested JSON: a node table per type, linked by interval containment.

A depth-first walk gives each node a pre-order and a post-order number; node a encloses node b exactly if a.pre < b.pre
and a.post > b.post. Parents are found from these intervals alone: nodes that could enclose (level l - 1) and nodes that
look for their encloser (level l) of one record are merged in pre-order, and the nearest preceding candidate is the only
one whose interval can contain the node. That is one shuffle and one sort, linear in the nodes, also for one huge record;
candidates travel as three numbers, as the encloser's path is the beginning of the node's own.

Node tables carry a node's own step instead of its path, so their size does not grow with the depth of nesting.

Defined results: null, empty or invalid JSON gives no nodes; a text that is a JSON string which encodes an object or
array is read as that; nested strings stay strings; numbers stay as they are written; repeated keys keep their last value;
rows with the same id and text count once, and of rows with the same id and another text equal result rows count once;
nesting depth is not bounded; an empty table gives empty node tables; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "obs_id bigint, field string, pre bigint, post bigint, depth int, level int, kind string, element boolean, "
    "step string, text string, item string, copy bigint"
)
KINDS = ("object", "array", "string", "number", "boolean", "null")
FIELDS = ("raw_event", "extracted_iocs")
#: Nodes per Arrow batch that goes back to the JVM.
FLUSH = 50_000


def _surrogate_free(text: str | None) -> str | None:
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def labelled_nodes(df: DataFrame, id_column: str = "id", fields: tuple[str, ...] = FIELDS, items: bool = False) -> DataFrame:
    """Every JSON node of the given text columns with its interval labels; with `items` only array elements, with their
    paths. copy is a hash of the text, which tells rows of one id apart; schema NODE_SCHEMA."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(NODE_SCHEMA))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from riskloom.functions import json_walk

        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, field in enumerate(fields):
                texts, copies = (batch.column(n).to_pylist() for n in (2 * k + 1, 2 * k + 2))
                for obs, text, copy in zip(ids, texts, copies):
                    ok, value = json_walk.parse(text)
                    if not ok:
                        continue
                    for pre, post, depth, level, kind, element, step, scalar, item in json_walk.label(value, items):
                        if element or not items:
                            rows.append((obs, field, pre, post, depth, level, kind, element, *map(_surrogate_free, (step, scalar, item)), copy))
                    if len(rows) >= FLUSH:
                        yield flush()
        yield flush()

    return df.select(df[id_column], *[c for f in fields for c in (df[f], F.xxhash64(df[f]))]).mapInArrow(walk, NODE_SCHEMA)


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The nodes of one type (see KINDS), once each: obs_id, field, pre, post, depth, level, element, step and, of scalars,
    text. A node's parent is the node of the same obs_id and field whose interval encloses it and whose depth is one less."""
    columns = ["obs_id", "field", "pre", "post", "depth", "level", "element", "step", *(["text"] if kind in ("string", "number", "boolean") else [])]
    return nodes.where(F.col("kind") == kind).select(*columns).distinct()


def link_elements(nodes: DataFrame) -> DataFrame:
    """Array elements with the innermost array element that encloses each: obs_id, field, item, parent."""

    # a candidate encloses nodes of the next level and brings its path's length; a seeker looks for a candidate of the
    # level above and brings its path
    candidate_side = F.struct(F.col("level").alias("level"), F.lit(None).cast("string").alias("item"), F.length("item").alias("length"))
    seeker_side = F.struct((F.col("level") - 1).alias("level"), F.col("item").alias("item"), F.lit(None).cast("int").alias("length"))
    sides = nodes.where("element").select("obs_id", "field", "copy", "pre", "post", F.explode(F.array(candidate_side, seeker_side)).alias("s"))
    # one placing serves the search for parents and the removal of repeated rows
    merged = sides.select("obs_id", "field", "copy", "pre", "post", "s.*").repartition("obs_id", "field", "level")
    order = Window.partitionBy("obs_id", "field", "level", "copy").orderBy("pre", F.col("length").isNull())
    candidate = F.when(F.col("length").isNotNull(), F.struct("pre", "post", "length"))
    last = F.last(candidate, ignorenulls=True).over(order)
    found = merged.withColumn("last", last).where("item IS NOT NULL")
    inside = (F.col("last.pre") < F.col("pre")) & (F.col("last.post") > F.col("post"))
    parent = F.when(inside, F.substring(F.col("item"), F.lit(1), F.col("last.length"))).otherwise(F.lit(""))
    return found.select("obs_id", "field", "level", "item", parent.alias("parent")).distinct().drop("level")
