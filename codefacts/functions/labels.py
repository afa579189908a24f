"""Column functions for what a graph view shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def scope_label(scope: Column) -> Column:
    """Scope without kind and package: ``Class#signature``; ``(global)`` when there is none."""
    bare = F.regexp_replace(scope, r"^[a-zA-Z_]+:", "")
    cut = F.instr(bare, "#")
    short = F.concat(
        simple_name(F.substring_index(bare, "#", 1)), F.lit("#"), F.substr(bare, cut + F.lit(1))
    )
    return (
        F.when(scope.isNull() | (scope == ""), F.lit("(global)")).when(cut == 0, bare).otherwise(short)
    )


def node_label(label: Column, operation: Column, variable: Column, name: Column, node_id: Column) -> Column:
    """A node's own label, else its access (operation and variable), else its name, else its id."""
    access = F.when(variable.isNotNull(), F.concat_ws(" ", F.nullif(operation, F.lit("")), variable))
    return F.coalesce(label, access, name, node_id.cast("string"))


def method_label(signature_simple: Column, name: Column, return_fqn: Column) -> Column:
    shown = F.coalesce(signature_simple, F.concat(F.coalesce(name, F.lit("")), F.lit("()")))
    back = simple_name(F.coalesce(return_fqn, F.lit("")))
    return F.when(back != "", F.concat(shown, F.lit(": "), back)).otherwise(shown)


def field_label(name: Column, type_simple: Column, type_fqn: Column) -> Column:
    kind = simple_name(F.coalesce(type_simple, type_fqn, F.lit("")))
    return F.when(kind != "", F.concat(name, F.lit(": "), kind)).otherwise(name)


def is_legacy_method(method: Column) -> Column:
    """A stored method (map of attributes) written before return types were resolved."""
    has = lambda key: F.map_contains_key(method, key)
    return has("return_type") & ~has("return_type_fqn") & ~has("signature_simple")


def is_legacy_node(node_type: Column) -> Column:
    return F.coalesce(node_type == "condition", F.lit(False))
