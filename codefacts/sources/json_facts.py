"""Typed facts from stored AST documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "file string, key string, package string, "
    "imports array<struct<path:string,static:boolean,wildcard:boolean>>, "
    "classes array<struct<name:string,fqn:string,key:string,line_start:int,"
    "fields:array<struct<name:string,key:string,line_start:int,type_simple:string,type_fqn:string>>,"
    "methods:array<struct<name:string,key:string,line_start:int,return_type_fqn:string,signature_simple:string>>>>, "
    "interfaces array<struct<name:string,fqn:string,key:string,line_start:int,"
    "methods:array<struct<name:string,key:string,line_start:int,return_type_fqn:string,signature_simple:string>>>>, "
    "enums array<struct<name:string,fqn:string,key:string,line_start:int,body:array<string>>>"
)


def parse_ast(df: DataFrame, content: str = "content") -> DataFrame:
    """The JSON column as a struct ``ast`` with a fixed schema; unknown attributes are ignored."""
    return df.withColumn("ast", F.from_json(content, SCHEMA))


def explode_ast(df: DataFrame, content: str = "content") -> dict[str, DataFrame]:
    """Fact tables of stored documents ``(repo_id, file_id, content)``."""
    parsed = parse_ast(df, content)
    ids = ["repo_id", "file_id"]
    types = None
    for kind in ("class", "interface", "enum"):
        plural = "classes" if kind == "class" else f"{kind}s"
        rows = parsed.select(*ids, F.posexplode(f"ast.{plural}").alias("pos", "t")).select(
            *ids, F.lit(kind).alias("kind"), "pos", "t.name", "t.fqn", "t.key", "t.line_start",
            (F.col("t.methods") if kind != "enum" else F.lit(None).cast(
                "array<struct<name:string,key:string,line_start:int,return_type_fqn:string,signature_simple:string>>"
            )).alias("methods"),
            (F.col("t.fields") if kind == "class" else F.lit(None).cast(
                "array<struct<name:string,key:string,line_start:int,type_simple:string,type_fqn:string>>"
            )).alias("fields"),
        )
        types = rows if types is None else types.unionByName(rows)
    return {
        "files": parsed.select(*ids, "ast.file", "ast.key", "ast.package"),
        "imports": parsed.select(*ids, F.posexplode("ast.imports").alias("pos", "i")).select(*ids, "pos", "i.*"),
        "types": types.drop("methods", "fields"),
        "fields": types.select(*ids, F.col("fqn").alias("owner_fqn"), F.posexplode("fields").alias("pos", "f")).select(
            *ids, "owner_fqn", "pos", "f.*"),
        "methods": types.select(*ids, F.col("fqn").alias("owner_fqn"), F.posexplode("methods").alias("pos", "m")).select(
            *ids, "owner_fqn", "pos", "m.*"),
    }


def parse_open(df: DataFrame, content: str = "content") -> DataFrame:
    """The JSON column as a variant ``doc``, whatever its shape, and in ``bad_record`` the text that is no JSON.

    A null text has neither.
    """
    doc = F.try_parse_json(content)
    return df.withColumn("doc", doc).withColumn("bad_record", F.when(F.col("doc").isNull(), F.col(content)))


def read_fields(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed columns of the variant ``doc``, name to (path, type), null where the path or the type does not fit; and in
    ``rest`` the top-level fields no path begins with, as a map from name to JSON text."""
    known = F.array(*(F.lit(p.removeprefix("$.").split(".")[0].split("[")[0]) for p, _ in fields.values()))
    top = F.try_variant_get("doc", "$", "map<string,variant>")
    rest = F.transform_values(F.map_filter(top, lambda k, _: ~F.array_contains(known, k)), lambda _, v: F.to_json(v))
    return df.withColumns({n: F.try_variant_get("doc", path, kind) for n, (path, kind) in fields.items()}).withColumn("rest", rest)
