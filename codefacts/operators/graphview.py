"""Syntax trees as node and edge lists for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .facts import CodeFacts


def ast_elements(facts: CodeFacts) -> tuple[DataFrame, DataFrame]:
    """Nodes (file_id, id, label, node_type) and edges (file_id, id, source, target) of each file.

    A file holds its package, a group of imports, classes with fields and methods, interfaces with methods, and enums;
    methods hold their statements. Ids count the nodes of a file in display order.
    """
    kind_place = F.when(F.col("kind") == "class", 2).when(F.col("kind") == "interface", 3).otherwise(4)

    def rows(df: DataFrame, node_type: Column | str, label: Column, at: list, parent: list | None) -> DataFrame:
        def place(values: list) -> Column:
            padded = [*values, *[-1] * (6 - len(values))]
            return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in padded])

        none = F.lit(None).cast("array<bigint>")
        return df.select(
            "file_id", (F.lit(node_type) if isinstance(node_type, str) else node_type).alias("node_type"),
            label.alias("label"), place(at).alias("at"), (none if parent is None else place(parent)).alias("parent_at"))

    imports = facts.imports
    counted = imports.groupBy("file_id").agg(F.count("*").alias("n"))
    types = facts.types.withColumn("place", kind_place)
    owners = types.select("file_id", F.col("ord").alias("owner_ord"), "place")
    fields = facts.fields.join(owners, ["file_id", "owner_ord"])
    methods = facts.methods.join(owners, ["file_id", "owner_ord"])
    method_places = methods.select("file_id", F.col("ord").alias("method_ord"), "owner_ord", "place")
    statements = facts.statements.join(method_places, ["file_id", "method_ord"])
    c = F.col
    root: list = [0]
    parts = [
        rows(facts.files, "file", F.substring_index("path", "/", -1), root, None),
        rows(facts.packages, "package", c("package"), [1, 0], root),
        rows(counted, "group", F.format_string("imports (%d)", "n"), [1, 1], root),
        rows(imports, "import", labels.simple_name(c("path")), [1, 1, c("pos")], [1, 1]),
        rows(types, c("kind"), c("name"), [c("place"), c("ord")], root),
        rows(fields, "field", labels.field_label(c("name"), c("type_simple"), c("type_fqn")),
             [c("place"), c("owner_ord"), 0, c("ord"), c("pos")], [c("place"), c("owner_ord")]),
        rows(methods, "method", labels.method_label(c("signature_simple"), c("name"), c("return_type_fqn")),
             [c("place"), c("owner_ord"), 1, c("ord")], [c("place"), c("owner_ord")]),
        rows(statements, "statement", F.concat_ws(": ", "kind", "text"),
             [c("place"), c("owner_ord"), 1, c("method_ord"), c("seq")], [c("place"), c("owner_ord"), 1, c("method_ord")]),
    ]
    order = Window.partitionBy("file_id").orderBy("at")
    numbered = reduce(DataFrame.unionByName, parts).withColumn(
        "id", F.concat(F.lit("ast-"), (F.row_number().over(order) - 1).cast("string")))
    heads = numbered.select("file_id", F.col("at").alias("parent_at"), F.col("id").alias("source"))
    edges = numbered.filter("parent_at IS NOT NULL").select("file_id", F.col("id").alias("target"), "parent_at").join(
        heads, ["file_id", "parent_at"]).select(
        "file_id", F.concat_ws("->", "source", "target").alias("id"), "source", "target")
    return numbered.select("file_id", "id", "label", "node_type"), edges
