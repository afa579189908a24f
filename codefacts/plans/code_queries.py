"""Queries over source code.

The given tables hold no source code, so Spark writes one class per row of ``part``: names, numbers and the shape of
the loop come from the row. The SQL states what each query must find for a row, without reading any code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import CodeFacts, facts_by_language, import_map, resolve_types, table_of_all
from ..operators.flow import Flow
from ..operators.graph import align_facts, scope_members
from ..operators.graphview import ast_elements
from ..operators.lexer import by_file
from . import bindings as b
from .registry import query

SOURCE = """package shop.b%1$d;

import java.util.List;
import static java.lang.Math.max;
import x.y.*;

/* %3$s } is no end; nor is "this { */
@Entity(name = "%3$s {")
public class Part%2$d extends Base implements Item, Priced {
    private int total;
    protected static List<String> names = new ArrayList<String>(), more;  // }{ ;

    public int add(int qty, @Named("n") final String name) throws IOException {
        int price = qty;
        if (price > %1$d) {
            total = price;
            return total;
        } else if (qty == 2) log("it's %3$s; {");
        %4$s
        return price;
    }

    abstract Map<String, List<Part%2$d>> find(String... keys);
}

interface Item {
    default void show() { print(this); }
}

enum Color { RED, GREEN(1), BLUE; }
"""
WHILE = "while (price < qty) {\n            price = total;\n        }"
FOR = "for (int i = 0; i < qty; i++)\n            total += i;\n"
TRY = "try {\n            names.add(name);\n        } catch (Error e) { qty = 0; } finally { max(qty, price); }"


def sources(spark: SparkSession, folder: str) -> DataFrame:
    loop = F.when(F.col("p_size") % 3 == 0, WHILE).when(F.col("p_size") % 3 == 1, FOR).otherwise(TRY)
    # the numbers are dealt to all cores before Spark writes the texts, which then stay where they are
    return by_file(b.table(spark, folder, "part").withColumn("file_id", F.col("p_partkey"))).select(
        F.col("p_brand").alias("repo_id"), "file_id",
        F.format_string("src/%d/Part%d.java", "p_size", "p_partkey").alias("path"),
        F.format_string(SOURCE, "p_size", "p_partkey", "p_name", loop).alias("content"),
    )


def facts(spark: SparkSession, folder: str) -> CodeFacts:
    return CodeFacts(sources(spark, folder))


def flow(spark: SparkSession, folder: str) -> Flow:
    return Flow(facts(spark, folder))


P = """p AS (SELECT p_partkey AS file_id, p_size AS s, p_size % 3 AS shape, p_name AS nm, 'shop.b' || p_size AS pkg,
 'shop.b' || p_size || '.Part' || p_partkey AS cls, 'Part' || p_partkey AS name, 'src/' || p_size || '/Part' || p_partkey || '.java' AS path
 FROM part), m AS (SELECT *, 'method:' || cls || '#add(int,java.lang.String):int' AS add_key FROM p)"""



def values(columns: str, rows: list[str], alias: str = "v") -> str:
    return f"(VALUES {', '.join(f'({r})' for r in rows)}) AS {alias}({columns})"


@query("code_imports", f"""WITH {P} SELECT file_id, pos::INTEGER AS pos, path, static, wildcard, simple_name FROM (SELECT file_id FROM p), {values(
    'pos, path, static, wildcard, simple_name', ["0, 'java.util.List', false, false, 'List'", "1, 'java.lang.Math.max', true, false, 'max'", "2, 'x.y', false, true, 'y'"])}""")
def code_imports(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).imports


@query("code_import_map", f"""WITH {P} SELECT file_id, simple_name, path FROM (SELECT file_id FROM p), {values(
    'simple_name, path', ["'List', 'java.util.List'", "'max', 'java.lang.Math.max'"])}""")
def code_import_map(spark: SparkSession, folder: str) -> DataFrame:
    return import_map(facts(spark, folder).imports)


@query("code_files", f"""WITH {P} SELECT file_id, path, 'file:' || path AS key, pkg AS package,
 33 AS total_lines FROM p""")
def code_files(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).files.select("file_id", "path", "key", "package", "total_lines")


@query("code_types", f"""WITH {P}, v AS (SELECT file_id, name, 'class' AS kind, 8 AS line_start, 33 AS line_end, 'public' AS modifiers,
  'Entity(name = "' || nm || ' {{")' AS annotations, 'Base' AS extends, 'Item,Priced' AS implements, NULL AS body, pkg FROM p
 UNION ALL SELECT file_id, 'Item', 'interface', 28, 33, '', '', '', '', NULL, pkg FROM p
 UNION ALL SELECT file_id, 'Color', 'enum', 32, 33, '', '', '', '', 'RED,GREEN,BLUE', pkg FROM p)
 SELECT file_id, name, kind, pkg || '.' || name AS fqn, 'type:' || pkg || '.' || name AS key, modifiers, annotations, extends,
 implements, body, line_start, line_end FROM v""")
def code_types(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.transform("annotations", lambda a: F.concat(a["name"], F.lit("("), F.coalesce(a["element"], F.lit("")), F.lit(")")))
    return facts(spark, folder).types.withColumn("annotations", shown).select(
        "file_id", "name", "kind", "fqn", "key", "line_start", "line_end",
        *[F.array_join(c, ",").alias(c) for c in ("modifiers", "annotations", "extends", "implements", "body")])


@query("code_fields", f"""WITH {P}, v AS (SELECT file_id, cls, name, type_simple, type_fqn, modifiers, line_start, confidence::DOUBLE AS confidence FROM
 (SELECT file_id, cls FROM p), {values('name, type_simple, type_fqn, modifiers, line_start, confidence', [
    "'total', 'int', 'int', 'private', 10, 0.5", "'names', 'List<String>', 'java.util.List', 'protected,static', 11, 1.0",
    "'more', 'List<String>', 'java.util.List', 'protected,static', 11, 1.0"])})
 SELECT * EXCLUDE (cls), cls AS owner_fqn, 'field:' || cls || '#' || name || ':' || type_fqn AS key FROM v""")
def code_fields(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).fields.select(
        "file_id", "name", "type_simple", "type_fqn", F.array_join("modifiers", ",").alias("modifiers"), "line_start",
        "confidence", "owner_fqn", "key")


METHODS = f"""{P}, me AS (SELECT file_id, cls AS owner_fqn, 0 AS pos, 'add(int,String)' AS signature_simple,
  'add(int,java.lang.String)' AS signature_resolved, add_key AS key, 'public' AS modifiers, 'IOException' AS throws, 13 AS line_start,
  24 AS line_end, true AS has_body FROM m
 UNION ALL SELECT file_id, cls, 1, 'find(String)', 'find(java.lang.String)', 'method:' || cls || '#find(java.lang.String):' || pkg || '.Map',
  'abstract', '', 25, 33, false FROM m
 UNION ALL SELECT file_id, pkg || '.Item', 0, 'show()', 'show()', 'method:' || pkg || '.Item#show():void', 'default', '', 29, 33, true FROM m)"""


@query("code_methods", f"WITH {METHODS} SELECT * FROM me")
def code_methods(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).methods.select(
        "file_id", "owner_fqn", "pos", "signature_simple", "signature_resolved", "key", "line_start", "line_end", "has_body",
        F.array_join("modifiers", ",").alias("modifiers"), F.array_join("throws", ",").alias("throws"))


@query("code_params", f"""WITH {METHODS} SELECT file_id, key AS method_key, v.* FROM me, {values('sig, pos, name, type_simple, type_fqn, varargs', [
    "'add(int,String)', 0, 'qty', 'int', 'int', false", "'add(int,String)', 1, 'name', 'String', 'java.lang.String', false",
    "'find(String)', 0, 'keys', 'String', 'java.lang.String', true"])} WHERE sig = signature_simple""".replace("v.*", "v.* EXCLUDE (sig)"))
def code_params(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).params.drop("method_ord")


STATEMENTS = f"""{METHODS}, sv AS (SELECT * FROM {values('shape, sig, seq, kind, line, text', [
    row for shape in range(3) for row in (
        [f"{shape}, 'add(int,String)', 0, 'LocalVarDecl', 14, 'int price = qty'", f"{shape}, 'add(int,String)', 1, 'Assignment', 16, 'total = price'",
         f"{shape}, 'add(int,String)', 2, 'ReturnStatement', 17, 'return total'", f"{shape}, 'add(int,String)', 3, 'MethodInvocation', 18, 'log'"]
        + ([f"{shape}, 'add(int,String)', 4, 'Assignment', 20, 'price = total'", f"{shape}, 'add(int,String)', 5, 'ReturnStatement', 22, 'return price'"],
           [f"{shape}, 'add(int,String)', 4, 'Assignment', 20, 'total += i'", f"{shape}, 'add(int,String)', 5, 'ReturnStatement', 22, 'return price'"],
           [f"{shape}, 'add(int,String)', 4, 'MethodInvocation', 20, 'names.add(name)'", f"{shape}, 'add(int,String)', 5, 'Assignment', 21, 'qty = 0'",
            f"{shape}, 'add(int,String)', 6, 'MethodInvocation', 21, 'max(qty, price)'", f"{shape}, 'add(int,String)', 7, 'ReturnStatement', 22, 'return price'"])[shape]
        + [f"{shape}, 'show()', 0, 'MethodInvocation', 29, 'print(this)'"])])}),
 st AS (SELECT me.file_id, me.key AS method_key, seq, kind, line, path,
  CASE text WHEN 'log' THEN 'log("it''s ' || nm || '; {{")' ELSE text END AS text
  FROM me JOIN p USING (file_id) JOIN sv ON sv.shape = p.shape AND sig = signature_simple)"""


@query("code_statements", f"""WITH {STATEMENTS} SELECT * EXCLUDE (path), 'stmt:' || path || ':' || line || ':' || lower(kind) || ':'
 || substr(sha1(text), 1, 8) AS stmt_key FROM st""")
def code_statements(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).statements.select("file_id", "method_key", "seq", "kind", "line", "text", "stmt_key")


COMMON = ["0-2:", "2-3:", "3-4:true", "3-6:false", "4-5:", "5-1:", "6-7:true"]
LOOP = ["6-8:false", "7-8:", "8-9:true", "9-8:loop", "8-10:false", "10-1:"]
TRIED = ["6-8:false", "7-8:", "6-9:exception", "7-9:exception", "8-11:", "9-10:", "10-11:", "11-12:", "12-13:", "13-1:"]


def edge_rows(shape: int, edges: list[str]) -> list[str]:
    cut = [(e.split(":")[0].split("-"), e.split(":")[1]) for e in edges]
    return [f"{shape}, {src}, {dst}, '{label}'" for (src, dst), label in cut]


CFG_SQL = f"""{METHODS}, ev AS (SELECT * FROM {values('shape, src, dst, label', [
    *edge_rows(0, COMMON + LOOP), *edge_rows(1, COMMON + LOOP), *edge_rows(2, COMMON + TRIED)])}),
 ce AS (SELECT me.file_id, key AS scope, src::BIGINT AS src, dst::BIGINT AS dst, label FROM me JOIN p USING (file_id) JOIN ev ON ev.shape = p.shape
  WHERE signature_simple = 'add(int,String)'
  UNION ALL SELECT file_id, key, 0, 1, '' FROM me WHERE signature_simple = 'find(String)'
  UNION ALL SELECT file_id, key, 0, 2, '' FROM me WHERE signature_simple = 'show()'
  UNION ALL SELECT file_id, key, 2, 1, '' FROM me WHERE signature_simple = 'show()')"""


@query("code_control_flow", f"WITH {CFG_SQL} SELECT * FROM ce")
def code_control_flow(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder).cfg_edges.drop("method_ord")


@query("code_complexity", f"""WITH {CFG_SQL}, e AS (SELECT file_id, scope, count(*) AS edges_count FROM ce GROUP BY ALL),
 n AS (SELECT file_id, scope, count(*) AS nodes_count FROM (SELECT file_id, scope, src AS n FROM ce UNION SELECT file_id, scope, dst FROM ce) GROUP BY ALL)
 SELECT file_id, scope, nodes_count, edges_count, greatest(1, edges_count - nodes_count + 2) AS cyclomatic_complexity FROM n JOIN e USING (file_id, scope)""")
def code_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder).cfg_metrics.drop("method_ord", "components")


DFG_COMMON = "qty:param:def name:param:def qty:local:use price:local:def price:local:use price:local:use total:field:write total:field:use qty:local:use"
DFG_SHAPES = [
    "price:local:use qty:local:use total:field:use price:local:write price:local:use",
    "i:local:def i:local:use qty:local:use i:local:use total:field:write price:local:use",
    "name:local:use e:local:def qty:local:write qty:local:use price:local:use price:local:use",
]


def node_rows() -> list[str]:
    rows = []
    for shape, more in enumerate(DFG_SHAPES):
        for node, item in enumerate(f"{DFG_COMMON} {more}".split()):
            name, kind, op = item.split(":")
            rows.append(f"{shape}, {node}, '{name}', '{kind}', '{op}'")
    return rows


@query("code_data_nodes", f"""WITH {METHODS}, nv AS (SELECT * FROM {values('shape, node, variable, var_kind, op', node_rows())})
 SELECT m.file_id, add_key AS scope, node::BIGINT AS node, variable, var_kind, op, CASE var_kind WHEN 'param' THEN 'param:' || add_key || ':' || variable
 WHEN 'field' THEN 'field:' || cls || '#' || variable || ':int' ELSE 'local:' || add_key || ':0:' || variable END AS var_key
 FROM m JOIN nv ON nv.shape = m.shape
 UNION ALL SELECT file_id, key, 0, 'keys', 'param', 'def', 'param:' || key || ':keys' FROM me WHERE signature_simple = 'find(String)'""")
def code_data_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder).dfg_nodes.select("file_id", "scope", "node", "variable", "var_kind", "op", "var_key")


DFG_EDGES = ["0-2:def-use", "2-3:init", "3-4:def-use", "3-5:def-use", "5-6:flow", "6-7:def-use", "0-8:def-use"]
DFG_EDGES_BY_SHAPE = [
    ["3-9:def-use", "0-10:def-use", "6-11:def-use", "11-12:flow", "12-13:def-use"],
    ["9-10:def-use", "0-11:def-use", "9-12:def-use", "12-13:flow", "3-14:def-use"],
    ["1-9:def-use", "11-12:def-use", "3-13:def-use", "3-14:def-use"],
]


@query("code_data_flow", f"""WITH {METHODS}, ev AS (SELECT * FROM {values('shape, src, dst, type', [
    row for shape, more in enumerate(DFG_EDGES_BY_SHAPE) for row in edge_rows(shape, DFG_EDGES + more)])})
 SELECT m.file_id, add_key AS scope, src::BIGINT AS src, dst::BIGINT AS dst, type FROM m JOIN ev ON ev.shape = m.shape""")
def code_data_flow(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder).dfg_edges.select("file_id", "scope", "src", "dst", "type")


@query("code_data_metrics", f"""WITH {METHODS} SELECT file_id, add_key AS scope, CASE shape WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 6 END::BIGINT AS defs_count,
 CASE shape WHEN 0 THEN 9 WHEN 1 THEN 9 ELSE 9 END::BIGINT AS uses_count, CASE shape WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 2 END::BIGINT AS writes_count,
 CASE shape WHEN 0 THEN 4 ELSE 5 END::BIGINT AS variables_count FROM m
 UNION ALL SELECT file_id, key, CASE signature_simple WHEN 'find(String)' THEN 1 ELSE 0 END, 0, 0, CASE signature_simple WHEN 'find(String)' THEN 1 ELSE 0 END
 FROM me WHERE signature_simple <> 'add(int,String)'""")
def code_data_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder).dfg_metrics.drop("method_ord")


SYMBOLS = f"""{P}, sy AS (SELECT file_id, v.n, v.type, v.short, v.data_type, v.line, CASE v.place WHEN 'pkg' THEN pkg WHEN 'cls' THEN cls
  WHEN 'item' THEN pkg || '.Item' ELSE cls || '.' || v.place END AS scope, CASE v.short WHEN 'Part' THEN p.name ELSE v.short END AS name,
  CASE v.data_type WHEN 'Map' THEN 'Map<String, List<' || p.name || '>>' ELSE v.data_type END AS kind
 FROM p, {values('n, type, short, data_type, line, place', [
    "1, 'class', 'Part', NULL, 8, 'pkg'", "2, 'field', 'total', 'int', 10, 'cls'", "3, 'field', 'names', 'List<String>', 11, 'cls'",
    "4, 'field', 'more', 'List<String>', 11, 'cls'", "5, 'method', 'add', 'int', 13, 'cls'", "6, 'parameter', 'qty', 'int', NULL, 'add'",
    "7, 'parameter', 'name', 'String', NULL, 'add'", "8, 'method', 'find', 'Map', 25, 'cls'", "9, 'parameter', 'keys', 'String', NULL, 'find'",
    "10, 'interface', 'Item', NULL, 28, 'pkg'", "11, 'method', 'show', 'void', 29, 'item'", "12, 'enum', 'Color', NULL, 32, 'pkg'"])}),
 sym AS (SELECT file_id, n, type || '_' || scope || '_' || name || '_' || n AS symbol_id, type, name, scope, kind AS data_type, line FROM sy)"""


@query("code_symbols", f"""WITH {SYMBOLS} SELECT sym.*, p.path AS file, CASE n WHEN 1 THEN 'public' WHEN 2 THEN 'private' WHEN 3 THEN 'protected,static'
  WHEN 4 THEN 'protected,static' WHEN 5 THEN 'public' WHEN 8 THEN 'abstract' WHEN 11 THEN 'default' ELSE '' END AS modifiers,
 CASE n WHEN 1 THEN 'Entity' ELSE '' END AS annotations FROM sym JOIN p USING (file_id)""")
def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).symbols.withColumns({c: F.array_join(c, ",") for c in ("modifiers", "annotations")})


@query("code_scope_members", f"""WITH {SYMBOLS} SELECT file_id || ' ' || scope AS scope, 0::BIGINT AS page, string_agg(symbol_id, ',' ORDER BY n) AS symbol_ids
 FROM sym GROUP BY ALL""")
def code_scope_members(spark: SparkSession, folder: str) -> DataFrame:
    symbols = facts(spark, folder).symbols.withColumn("scope", F.concat_ws(" ", F.col("file_id").cast("string"), "scope"))
    # a scope is no longer than its file
    return scope_members(symbols, bounded=True).withColumn("symbol_ids", F.array_join("symbol_ids", ","))


@query("code_type_names", f"""WITH {P} SELECT file_id, v.type_simple, CASE v.fqn WHEN 'pkg' THEN pkg || '.Foo' ELSE v.fqn END AS type_fqn, pkg AS package
 FROM p, {values('type_simple, fqn', ["'int', 'int'", "'List<String>', 'java.util.List'", "'String', 'java.lang.String'",
                                      "'String[]', 'java.lang.String'", "'Foo<T>', 'pkg'"])}""")
def code_type_names(spark: SparkSession, folder: str) -> DataFrame:
    code = facts(spark, folder)
    kinds = F.array(*[F.lit(k) for k in ("int", "List<String>", "String", "String[]", "Foo<T>")])
    refs = b.table(spark, folder, "part").select(F.col("p_partkey").alias("file_id"), F.explode(kinds).alias("type_simple"))
    return resolve_types(refs, import_map(code.imports), code.packages)


@query("code_aligned", f"""WITH {STATEMENTS}, c AS (SELECT sv.shape, sv.seq, v.accesses FROM sv JOIN {values('shape, seq, accesses', [
    f"{shape}, {seq}, {n}" for shape, counts in enumerate([(2, 2, 1, 0, 2, 1), (2, 2, 1, 0, 2, 1), (2, 2, 1, 0, 1, 1, 2, 1)]) for seq, n in enumerate(counts)])}
  USING (shape, seq) WHERE sig = 'add(int,String)')
 SELECT st.file_id, method_key, st.seq, st.kind, coalesce(c.accesses, 0)::BIGINT AS accesses,
  CASE WHEN st.seq < 2 THEN st.seq * 2 + 2 WHEN st.seq = 2 THEN 5 WHEN st.seq = 3 THEN 7 WHEN p.shape < 2 THEN st.seq + 5
  ELSE CASE st.seq WHEN 4 THEN 8 WHEN 5 THEN 10 WHEN 6 THEN 12 ELSE 13 END END::BIGINT AS node
 FROM st JOIN p USING (file_id) LEFT JOIN c ON c.shape = p.shape AND c.seq = st.seq AND method_key LIKE '%#add(%'""")
def code_aligned(spark: SparkSession, folder: str) -> DataFrame:
    graphs = flow(spark, folder)
    on = ["file_id", "stmt_key"]
    cfg = graphs.cfg_nodes.select(*on, "node")
    return align_facts(graphs.facts.statements, cfg, graphs.dfg_nodes.filter("stmt_key IS NOT NULL"), on).select(
        "file_id", "method_key", "seq", "kind", "accesses", "node")


AST = f"""{METHODS}, fi AS (SELECT file_id, name || '.java' AS label, 'file' AS node_type FROM p UNION ALL SELECT file_id, pkg, 'package' FROM p
 UNION ALL SELECT file_id, v.label, v.t FROM p, {values('label, t', ["'imports (3)', 'group'", "'List', 'import'", "'max', 'import'", "'y', 'import'",
    "'total: int', 'field'", "'names: List<String>', 'field'", "'more: List<String>', 'field'", "'add(int,String): int', 'method'", "'find(String): Map', 'method'",
    "'show(): void', 'method'", "'Item', 'interface'", "'Color', 'enum'"])}
 UNION ALL SELECT file_id, name, 'class' FROM p)"""


@query("code_tree_nodes", f"""WITH {STATEMENTS.replace('WITH ', '')}, {AST.split(METHODS + ', ')[1]}
 SELECT file_id, label, node_type FROM fi UNION ALL SELECT file_id, kind || ': ' || text, 'statement' FROM st""")
def code_tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return ast_elements(facts(spark, folder))[0].drop("id")


def tree_edges(statements: int) -> list[tuple[int, int]]:
    """Display order: the file, its package, three imports in a group, the class with three fields and two methods, the
    statements behind the first method, then the interface with a method and its statement, and the enum."""
    find, item = 11 + statements, 12 + statements
    return [*((0, t) for t in (1, 2, 6, item, item + 3)), *((2, t) for t in (3, 4, 5)), *((6, t) for t in (7, 8, 9, 10, find)),
            *((10, 11 + t) for t in range(statements)), (item, item + 1), (item + 1, item + 2)]


@query("code_tree_edges", f"""WITH {P} SELECT file_id, 'ast-' || v.source || '->ast-' || v.target AS id, 'ast-' || v.source AS source, 'ast-' || v.target AS target
 FROM p, {values('shape, source, target', [f"{shape}, {source}, {target}" for shape, n in enumerate((6, 6, 8)) for source, target in tree_edges(n)])}
 WHERE v.shape = p.shape""")
def code_tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    return ast_elements(facts(spark, folder))[1]


@query("code_annotations", f"""WITH {P} SELECT file_id, name, 'Entity' AS annotation, 'name = "' || nm || ' {{"' AS element FROM p""")
def code_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).types.select("file_id", "name", F.explode("annotations").alias("a")).select(
        "file_id", "name", F.col("a.name").alias("annotation"), "a.element")


def varied_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Classes whose names, number of members and nesting come from the row: types of 1 to 50 levels, 1 to 4 methods, ifs of
    1 to 7 levels and, in every fiftieth class, of 150; two imports share a simple name."""
    levels = F.when(F.col("p_partkey") % 50 == 0, 150).otherwise(F.col("p_partkey") % 7 + 1).cast("int")
    deep = F.concat(F.repeat(F.lit("Map<"), F.col("p_size")), F.lit("String"), F.repeat(F.lit(">"), F.col("p_size")))
    word = F.regexp_extract("p_name", r"^([a-z]+)", 1)
    opened = F.array_join(F.transform(F.sequence(F.lit(1), levels), lambda i: F.concat(F.lit("if (a > "), i.cast("string"), F.lit(") {\n"))), "")
    methods = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda j: F.concat(
        F.lit("int "), word, j.cast("string"), F.lit("(int a) {\n"), opened, F.lit("a = "), F.repeat(F.lit("("), F.col("p_size")), F.lit("a"),
        F.repeat(F.lit(")"), F.col("p_size")), F.lit(";\n"), F.repeat(F.lit("}"), levels), F.lit("\nreturn a;\n}\n"))), "")
    return by_file(b.table(spark, folder, "part").withColumn("file_id", F.col("p_partkey"))).select(
        F.col("p_brand").alias("repo_id"), "file_id", F.format_string("v/%d.java", "p_partkey").alias("path"),
        F.concat(F.lit("package v;\nimport old.Map;\nimport fresh"), F.col("p_size").cast("string"), F.lit(".Map;\nsealed interface S"),
                 F.col("p_size").cast("string"), F.lit(" permits T {}\nrecord R(int a, int b) { int sum() { return a; } }\nclass V"),
                 F.col("p_partkey").cast("string"), F.lit(" {\n"), deep, F.lit(" deep;\n"), methods, F.lit("}\n")).alias("content"))


V = r"""vp AS (SELECT p_partkey AS file_id, p_size AS s, regexp_extract(p_name, '^([a-z]+)', 1) AS word,
  CASE WHEN p_partkey % 50 = 0 THEN 150 ELSE p_partkey % 7 + 1 END::INTEGER AS d FROM part),
 vm AS (SELECT *, j, word || j AS name, 'method:v.V' || file_id || '#' || word || j || '(int):int' AS key,
  8 + (j - 1) * (d + 5) AS line FROM vp, LATERAL unnest(range(1, s % 4 + 2)) AS u(j))"""


@query("code_varied_declarations", f"""WITH {V} SELECT file_id, 'field' AS kind, 'field:v.V' || file_id || '#deep:fresh' || s || '.Map' AS key,
  repeat('Map<', s) || 'String' || repeat('>', s) AS type_simple, 7 AS line FROM vp
 UNION ALL SELECT file_id, 'method', key, 'int', line FROM vm
 UNION ALL SELECT file_id, 'method', 'method:v.R#sum():int', 'int', 5 FROM vp
 UNION ALL SELECT file_id, v.kind, 'type:v.' || v.name || CASE v.name WHEN 'R' THEN '' WHEN 'S' THEN s::VARCHAR ELSE file_id::VARCHAR END, NULL, v.line
  FROM vp, {values('kind, name, line', ["'interface', 'S', 4", "'record', 'R', 5", "'class', 'V', 6"])}""")
def code_varied_declarations(spark: SparkSession, folder: str) -> DataFrame:
    code = CodeFacts(varied_sources(spark, folder))
    line = F.col("line_start").cast("long").alias("line")
    fields = code.fields.select("file_id", F.lit("field").alias("kind"), "key", "type_simple", line)
    methods = code.methods.select("file_id", F.lit("method").alias("kind"), "key", F.col("return_type_simple").alias("type_simple"), line)
    types = code.types.select("file_id", "kind", "key", F.lit(None).cast("string").alias("type_simple"), line)
    return fields.unionByName(methods).unionByName(types)


@query("code_varied_statements", f"""WITH {V} SELECT file_id, key AS method_key, 0 AS seq, 'Assignment' AS kind, line + d + 1 AS line,
  'a = ' || repeat('(', s) || 'a' || repeat(')', s) AS text FROM vm
 UNION ALL SELECT file_id, key, 1, 'ReturnStatement', line + d + 3, 'return a' FROM vm
 UNION ALL SELECT file_id, 'method:v.R#sum():int', 0, 'ReturnStatement', 5, 'return a' FROM vp""")
def code_varied_statements(spark: SparkSession, folder: str) -> DataFrame:
    return CodeFacts(varied_sources(spark, folder)).statements.select("file_id", "method_key", "seq", "kind", F.col("line").cast("long").alias("line"), "text")


@query("code_varied_flow", f"""WITH {V}, vn AS (SELECT file_id, key AS scope, d, i FROM vm, LATERAL unnest(range(2, d + 2)) AS u(i))
 SELECT file_id, key AS scope, 0::BIGINT AS src, 2::BIGINT AS dst, '' AS label FROM vm
 UNION ALL SELECT file_id, scope, i, i + 1, 'true' FROM vn UNION ALL SELECT file_id, scope, i, d + 3, 'false' FROM vn
 UNION ALL SELECT file_id, key, d + 2, d + 3, '' FROM vm UNION ALL SELECT file_id, key, d + 3, 1, '' FROM vm
 UNION ALL SELECT file_id, 'method:v.R#sum():int', v.src, v.dst, '' FROM vp, {values('src, dst', ["0, 2", "2, 1"])}""")
def code_varied_flow(spark: SparkSession, folder: str) -> DataFrame:
    return Flow(CodeFacts(varied_sources(spark, folder))).cfg_edges.drop("method_ord")


JAVA_CLASS = """package shop;
import java.util.List;
public class J%1$d extends Base implements Item {
    private List<String> names = new ArrayList<>();
    public int add(int n) { for (String s : names) { n += %2$d; } return n; }
}
"""
CSHARP_CLASS = """using System.Text;
namespace Shop.N%2$d
{
    [Serializable("no { end")]
    public sealed class C%1$d : Base, IItem
    {
        private readonly Encoding coding = null;
        public string Path => @"c:\\{";
        public int Add(ref int n) { foreach (var s in names) { n += %2$d; } lock (this) { Save(n); } return n; }
    }
}
"""


@query("mixed_corpus", """WITH p AS (SELECT p_partkey AS file_id, p_size AS s, CASE p_partkey % 2 WHEN 0 THEN 'java' ELSE 'csharp' END AS language,
  CASE p_partkey % 2 WHEN 0 THEN 'shop.J' || p_partkey ELSE 'Shop.N' || p_size || '.C' || p_partkey END AS cls,
  CASE p_partkey % 2 WHEN 0 THEN 'add' ELSE 'Add' END AS method FROM part)
 SELECT file_id, language, 'type' AS kind, 'type:' || cls AS key, CASE language WHEN 'java' THEN 'public:Base:Item' ELSE 'public,sealed:Base:IItem' END AS detail FROM p
 UNION ALL SELECT file_id, language, 'field', 'field:' || cls || CASE language WHEN 'java' THEN '#names:java.util.List' ELSE '#coding:Shop.N' || s || '.Encoding' END, 'ast' FROM p
 UNION ALL SELECT file_id, language, 'field', 'field:' || cls || '#Path:string', 'ast' FROM p WHERE language = 'csharp'
 UNION ALL SELECT file_id, language, 'method', 'method:' || cls || '#' || method || '(int):int', method || '(int)' FROM p
 UNION ALL SELECT file_id, language, 'statement', 'method:' || cls || '#' || method || '(int):int', 'n += ' || s FROM p
 UNION ALL SELECT file_id, language, 'statement', 'method:' || cls || '#' || method || '(int):int', 'return n' FROM p
 UNION ALL SELECT file_id, language, 'statement', 'method:' || cls || '#' || method || '(int):int', 'Save(n)' FROM p WHERE language = 'csharp'
 UNION ALL SELECT file_id, language, 'cyclomatic', 'method:' || cls || '#' || method || '(int):int', '2' FROM p""")
def mixed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two languages, told by their suffix; the second is known to the library by its data alone."""
    java = F.col("file_id") % 2 == 0
    texts = by_file(b.table(spark, folder, "part").withColumn("file_id", F.col("p_partkey"))).select(
        F.col("p_brand").alias("repo_id"), "file_id",
        F.concat(F.lit("src/"), F.col("file_id").cast("string"), F.when(java, ".java").otherwise(".cs")).alias("path"),
        F.when(java, F.format_string(JAVA_CLASS, "file_id", "p_size")).otherwise(F.format_string(CSHARP_CLASS, "file_id", "p_size")).alias("content"))
    facts = facts_by_language(texts)

    def rows(kind: str, key: str, detail, table) -> DataFrame:
        return table_of_all(facts, lambda code: table(code).select("file_id", F.lit(kind).alias("kind"), F.col(key).alias("key"), detail.alias("detail")))

    header = F.concat_ws(":", F.array_join("modifiers", ","), F.array_join("extends", ","), F.array_join("implements", ","))
    out = rows("type", "key", header, lambda code: code.types).unionByName(rows("field", "key", F.col("source"), lambda code: code.fields))
    out = out.unionByName(rows("method", "key", F.col("signature_simple"), lambda code: code.methods))
    out = out.unionByName(rows("statement", "method_key", F.col("text"), lambda code: code.statements))
    return out.unionByName(rows("cyclomatic", "scope", F.col("cyclomatic_complexity").cast("string"), lambda code: Flow(code).cfg_metrics))
