"""Column functions that build the stable identifiers of files, declarations, statements and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_id(repo_id: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(":", repo_id, path), 256)


def chunk_id(repo_id: Column, path: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", repo_id, path, index.cast("string")), 256)


def stmt_key(path: Column, line: Column, kind: Column, text: Column, null_without_line: bool = False) -> Column:
    """``stmt:<path>:<line>:<kind>:<8 hex digits>``; a missing line counts as 0, or gives no key."""
    key = F.concat(
        F.lit("stmt:"), path, F.lit(":"), F.coalesce(line, F.lit(0)).cast("string"), F.lit(":"),
        F.lower(kind), F.lit(":"), F.substring(F.sha1(text), 1, 8),
    )
    return F.when(line.isNotNull(), key) if null_without_line else key


def user_key(tenant: Column, object_id: Column, issuer: Column, subject: Column) -> Column:
    return F.sha2(
        F.coalesce(
            F.concat(F.lit("azure:"), tenant, F.lit(":"), object_id),
            F.concat(F.lit("oidc:"), issuer, F.lit(":"), subject),
        ),
        256,
    )


def fqn(package: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(package, F.lit("")), name)


def file_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def type_key(type_fqn: Column) -> Column:
    return F.concat(F.lit("type:"), type_fqn)


def signature(name: Column, types: Column) -> Column:
    """``name(t1,t2)`` from an array of type names in order."""
    return F.concat(name, F.lit("("), F.array_join(types, ","), F.lit(")"))


def method_key(owner: Column, name: Column, param_types: Column, return_type: Column) -> Column:
    return F.concat(F.lit("method:"), owner, F.lit("#"), signature(name, param_types), F.lit(":"), return_type)


def field_key(owner: Column, name: Column, type_fqn: Column) -> Column:
    return F.concat(F.lit("field:"), owner, F.lit("#"), name, F.lit(":"), type_fqn)


def param_key(method: Column, name: Column) -> Column:
    return F.concat(F.lit("param:"), method, F.lit(":"), name)


def local_key(method: Column, name: Column) -> Column:
    return F.concat(F.lit("local:"), method, F.lit(":0:"), name)


def confidence(type_fqn: Column, type_simple: Column) -> Column:
    return F.when(type_fqn != type_simple, F.lit(1.0)).otherwise(F.lit(0.5))


def source_ref(path: Column, line_start: Column, line_end: Column) -> Column:
    missing = F.lit(None).cast("int")
    return F.struct(
        path.alias("file"), line_start.alias("line_start"), line_end.alias("line_end"),
        missing.alias("col_start"), missing.alias("col_end"),
    )
