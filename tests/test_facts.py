"""Hand-derived facts of small sources."""

from pyspark.sql import functions as F

from codefacts.operators import ordering, reader
from codefacts.operators.facts import CodeFacts, base_type, import_map, plain_type, resolve_types
from codefacts.operators.flow import Flow
from codefacts.operators.graph import scope_members
from codefacts.operators.graphview import ast_elements
from codefacts.operators.language import JAVA
from codefacts.operators.reader import read

from .conftest import rows

CART = """package a.b;

import java.util.List;
import static java.lang.Math.max;
import x.y.*;

public class Cart {
    private int total;
    private List<String> names;

    public int add(int qty, String name) {
        int price = qty;
        if (price > 10) {
            total = price;
            return total;
        }
        while (price < qty) {
            price = total;
        }
        return price;
    }
}"""

HARD = """package a.b;
/* { */
@Ann(x = {"a", "}"}) public class Hard<T extends Foo> extends Base<T> implements P, Q<R> {
    private int[] total = {1, 2}, x;  // {{
    static { init(); }
    Hard(int a) { this.x = a; }
    public int add(final int qty, Map<String, List<Integer>> m, int... rest) throws E, F {
        if (qty > 10)
            foo();
        else if (qty == 2) { bar(y -> { a; b; }); }
        else
            for (int i = 0; i < qty; i++) if (i > 2) one(i); else { two(); }
        do { zap(); } while (qty > 1);
        switch (qty) {
            case 1: case 2: one(qty); break;
            case '{': { two(); }
            default: three();
        }
        Runnable r = new Runnable() { public void run() { q(); } };
        try (R res = open(qty)) { return res.get(); } catch (E | F e) { throw e; } finally { v(); }
        outer: while (true) { }
    }
    abstract String[] nothing();
}
interface I { void a(); default int b() { return 1; } }
enum Color implements P { RED, @Old GREEN(1, 2); int z; }
"""


def code(spark, *texts):
    data = [("r", i, f"f{i}/F.java", t) for i, t in enumerate(texts)]
    return CodeFacts(spark.createDataFrame(data, "repo_id string, file_id long, path string, content string"))


def test_cart_declarations(spark):
    facts = code(spark, CART)
    assert rows(facts.imports, "path", "static", "wildcard") == [
        ("java.lang.Math.max", True, False), ("java.util.List", False, False), ("x.y", False, True)]
    assert rows(import_map(facts.imports), "simple_name") == [("List",), ("max",)]
    assert rows(facts.types, "key", "line_start", "line_end") == [("type:a.b.Cart", 7, 22)]
    assert rows(facts.fields, "key", "confidence") == [
        ("field:a.b.Cart#names:java.util.List", 1.0), ("field:a.b.Cart#total:int", 0.5)]
    assert rows(facts.methods, "key", "signature_simple", "line_start", "line_end") == [
        ("method:a.b.Cart#add(int,java.lang.String):int", "add(int,String)", 11, 22)]
    assert rows(facts.statements, "line", "kind") == [
        (12, "LocalVarDecl"), (14, "Assignment"), (15, "ReturnStatement"), (18, "Assignment"), (20, "ReturnStatement")]


def test_cart_flow(spark):
    flow = Flow(code(spark, CART))
    assert flow.cfg_nodes.count() == 9
    assert rows(flow.cfg_edges, "src", "dst", "label") == sorted([
        (0, 2, ""), (2, 3, ""), (3, 4, "true"), (4, 5, ""), (5, 1, ""), (3, 6, "false"), (6, 7, "true"), (7, 6, "loop"),
        (6, 8, "false"), (8, 1, "")], key=repr)
    assert rows(flow.cfg_metrics, "nodes_count", "edges_count", "cyclomatic_complexity") == [(9, 10, 3)]
    nodes = {r.node: r for r in flow.dfg_nodes.collect()}
    assert len(nodes) == 13
    edges = rows(flow.dfg_edges, "src", "dst", "type")
    assert len(edges) == 11 and sum(t == "init" for *_, t in edges) == 1 and sum(t == "flow" for *_, t in edges) == 2
    last = next(n for n, r in nodes.items() if r.line == 20)
    assert [nodes[s].line for s, d, _ in edges if d == last] == [18]
    assert rows(flow.dfg_metrics, "defs_count", "uses_count", "writes_count", "variables_count") == [(5, 8, 2, 4)]


def test_type_resolution(spark):
    facts = code(spark, CART, "class A {}")
    refs = spark.createDataFrame(
        [(0, t) for t in ("int", "List<String>", "String", "String[]", "Foo<T>")] + [(1, "Foo<T>")], "file_id long, type_simple string")
    got = {(f, s): t for f, s, t in rows(resolve_types(refs, import_map(facts.imports), facts.packages), "file_id", "type_simple", "type_fqn")}
    assert got == {(0, "int"): "int", (0, "List<String>"): "java.util.List", (0, "String"): "java.lang.String",
                   (0, "String[]"): "java.lang.String", (0, "Foo<T>"): "a.b.Foo", (1, "Foo<T>"): "Foo<T>"}


def test_hard_declarations(spark):
    facts = code(spark, HARD)
    kinds = {r["name"]: r for r in facts.types.collect()}
    assert set(kinds) == {"Hard", "I", "Color"}
    hard = kinds["Hard"]
    assert hard.extends == ["Base"] and hard.implements == ["P", "Q"] and hard.modifiers == ["public"]
    assert [tuple(a) for a in hard.annotations] == [("Ann", 'x = {"a", "}"}')]
    assert kinds["Color"].body == ["RED", "GREEN"] and kinds["Color"].implements == ["P"]
    assert rows(facts.fields, "name", "type_simple") == [("total", "int[]"), ("x", "int[]")]
    methods = {r["name"]: r for r in facts.methods.collect()}
    assert set(methods) == {"add", "nothing", "a", "b"}  # the constructor and initialiser are no methods
    assert methods["add"].signature_simple == "add(int,Map<String, List<Integer>>,int)"
    assert [p.varargs for p in methods["add"].params] == [False, False, True]
    assert methods["add"].throws == ["E", "F"] and methods["nothing"].return_type_simple == "String[]"
    # bodies of do and switch are not listed
    assert [t for (t,) in rows(facts.statements.filter("method_key LIKE '%#add(%'").orderBy("seq"), "text")] == sorted([
        "foo()", "bar(y -> { a; b; })", "one(i)", "two()", "Runnable r = new Runnable() { public void run() { q(); } }",
        "return res.get()", "v()"], key=lambda t: repr((t,)))


def test_hard_flow(spark):
    flow = Flow(code(spark, HARD))
    nodes = {r.node: r.label for r in flow.cfg_nodes.filter("scope LIKE '%#add(%'").collect()}
    edges = {(nodes[s], nodes[d], label) for s, d, label in rows(flow.cfg_edges.filter("scope LIKE '%#add(%'"), "src", "dst", "label")}
    anonymous = "Runnable r = new Runnable() { public void run() { q(); } }"
    assert edges == {
        ("ENTRY", "if (qty > 10)", ""), ("if (qty > 10)", "foo()", "true"), ("if (qty > 10)", "if (qty == 2)", "false"),
        ("if (qty == 2)", "bar(y -> { a; b; })", "true"), ("if (qty == 2)", "for (int i = 0; i < qty; i++)", "false"),
        ("foo()", "do", ""), ("bar(y -> { a; b; })", "do", ""),
        ("for (int i = 0; i < qty; i++)", "if (i > 2)", "true"), ("for (int i = 0; i < qty; i++)", "do", "false"),
        ("if (i > 2)", "one(i)", "true"), ("if (i > 2)", "two()", "false"),
        ("one(i)", "for (int i = 0; i < qty; i++)", "loop"), ("two()", "for (int i = 0; i < qty; i++)", "loop"),
        ("do", "switch (qty)", ""), ("switch (qty)", "case 1", "case:1"), ("switch (qty)", "case 2", "case:2"),
        ("switch (qty)", "case '{'", "case:'{'"), ("switch (qty)", "default", "default"), ("case 1", anonymous, ""),
        ("case 2", "one(qty)", ""), ("one(qty)", "break", ""), ("break", anonymous, ""), ("case '{'", "two()", ""),
        ("two()", anonymous, ""), ("default", "three()", ""), ("three()", anonymous, ""),
        (anonymous, "return res.get()", ""), (anonymous, "catch (E | F e)", "exception"), ("return res.get()", "EXIT", ""),
        ("catch (E | F e)", "throw e", ""), ("throw e", "EXIT", ""), ("finally", "v()", ""), ("v()", "while (true)", ""),
        ("while (true)", "while (true)", "loop"), ("while (true)", "EXIT", "false")}
    bodies = flow.cfg_edges.groupBy("scope").count()
    # an interface method without a body has no graph
    assert {r["scope"].split("#")[1].split("(")[0] for r in bodies.collect()} == {"add", "nothing", "b"}
    names = {(r.variable, r.op) for r in flow.dfg_nodes.collect()}
    assert ("res", "def") in names and ("e", "def") in names and ("i", "def") in names and ("public", "def") not in names


def test_else_without_braces(spark):
    text = """class A { void f() {
        for (;;) if (a) x(); else for (;;) if (b) y(); else z();
        if (c) { p(); } else try { q(); } catch (E e) { r(); }
        s();
    } }"""
    flow = Flow(code(spark, text))
    names = {r.node: r.label for r in flow.cfg_nodes.collect()}
    loops = sorted(n for n, label in names.items() if label == "for (;;)")
    edges = {(s, d): label for s, d, label in rows(flow.cfg_edges, "src", "dst", "label")}
    node = {label: n for n, label in names.items()}
    outer, inner = loops
    assert edges[outer, node["if (a)"]] == "true" and edges[node["if (a)"], node["x()"]] == "true"
    assert edges[node["if (a)"], inner] == "false" and edges[inner, node["if (b)"]] == "true"
    assert edges[node["if (b)"], node["z()"]] == "false" and edges[node["z()"], inner] == "loop"
    assert edges[inner, outer] == "loop" and edges[node["x()"], outer] == "loop" and edges[outer, node["if (c)"]] == "false"
    assert edges[node["if (c)"], node["q()"]] == "false" and edges[node["if (c)"], node["catch (E e)"]] == "exception"
    assert edges[node["q()"], node["s()"]] == "" and edges[node["r()"], node["s()"]] == ""


def test_field_writes_through_this(spark):
    text = "class A { int x; void f(int y) { this.x = y; this.z = y; int z = (int) y + arr[q] + o.p + g(x); } }"
    nodes = rows(Flow(code(spark, text)).dfg_nodes, "node", "variable", "var_kind", "op")
    assert nodes == [
        (0, "y", "param", "def"), (1, "y", "local", "use"), (2, "x", "field", "write"), (3, "y", "local", "use"),
        (4, "y", "local", "use"), (5, "arr", "local", "use"), (6, "x", "field", "use"), (7, "z", "local", "def")]


def test_symbols_and_tree(spark):
    facts = code(spark, CART)
    assert [s for (s,) in rows(facts.symbols.orderBy("n"), "symbol_id")] == sorted([
        "class_a.b_Cart_1", "field_a.b.Cart_total_2", "field_a.b.Cart_names_3", "method_a.b.Cart_add_4",
        "parameter_a.b.Cart.add_qty_5", "parameter_a.b.Cart.add_name_6"], key=lambda s: repr((s,)))
    nodes, edges = ast_elements(facts)
    labels = {r.id: r.label for r in nodes.collect()}
    assert labels["ast-0"] == "F.java" and labels["ast-1"] == "a.b" and labels["ast-2"] == "imports (3)"
    pairs = {(labels[r.source], labels[r.target]) for r in edges.collect()}
    assert ("F.java", "Cart") in pairs and ("Cart", "names: List<String>") in pairs and ("Cart", "add(int,String): int") in pairs
    assert ("add(int,String): int", "Assignment: total = price") in pairs and len(nodes.collect()) == len(edges.collect()) + 1


def test_long_texts_do_not_overflow(spark):
    chain = "a" + ".b(c, d)" * 4_000
    text = ("class A { void f() { int[] t = {" + "1, " * 4_000 + "2}; " + chain + "; if (" + "x + " * 4_000 + "y) g(); }\n"
            "String s = \"" + '\\"{' * 4_000 + "\"; /*" + "*{\n" * 4_000 + "*/ int z; }")
    facts = code(spark, text)
    assert rows(facts.fields, "name") == [("s",), ("z",)]
    assert [k for (k,) in rows(facts.statements, "kind")] == ["LocalVarDecl", "MethodInvocation", "MethodInvocation"]


def test_unreadable_files_are_reported(spark):
    facts = code(spark, "class A { void f() { ", "class A { int x; } }", "class A { int y; " + "{" * 200 + "}" * 200 + " }", "class A { int x; }")
    assert rows(facts.failed) == [(0, "braces do not match"), (1, "braces do not match")]
    assert rows(facts.fields, "file_id", "name") == [(2, "y"), (3, "x")]


def test_deep_nesting(spark):
    depth = 150
    text = "class A { int a; void f() { " + "if (a > 0) { " * depth + "a = 1; " + "} " * depth + "} }"
    flow = Flow(code(spark, text))
    labels = [r.label for r in flow.cfg_nodes.collect()]
    assert labels.count("if (a > 0)") == depth and labels.count("a = 1") == 1
    edges = {(r.src, r.dst): r.label for r in flow.cfg_edges.collect()}
    assert sum(label == "true" for label in edges.values()) == depth
    assert rows(flow.facts.methods, "name") == [("f",)]


def test_many_brackets(spark):
    for n in (1, 7, 8, 40):
        text = "class A { int a, b; void f() { if (" + "(" * n + "a > 1" + ")" * n + ") { b = 1; } else { b = 2; } " + "g(" * n + "a" + ")" * n + "; } }"
        facts = code(spark, text)
        flow = Flow(facts)
        kinds = [k for (k,) in rows(facts.statements, "kind")]
        assert kinds.count("MethodInvocation") == 1 and kinds.count("Assignment") == 2, (n, kinds)
        branch = [r.node for r in flow.cfg_nodes.collect() if r.type == "branch"]
        out = [r.label for r in flow.cfg_edges.collect() if r.src in branch]
        assert sorted(out) == ["false", "true"], n
        used = [r.variable for r in flow.dfg_nodes.collect() if r.op == "use"]
        assert used == ["a", "a"], (n, used)


def test_casts_and_calls_in_deep_brackets(spark):
    text = "class A { void f(int q) { x = " + "(" * 9 + "(String) q + g(q) + new Foo(q).bar" + ")" * 9 + "; } }"
    used = [r.variable for r in Flow(code(spark, text)).dfg_nodes.collect() if r.op == "use"]
    assert used == ["q", "q", "q"]


def test_generics_and_names_of_any_script(spark):
    deep = "Map<String, " * 8 + "Long" + ">" * 8
    text = f"package a.ö; class Größe {{ {deep} m; int größe; int été(int née) {{ int ñ = née + größe; return ñ; }} enum E {{ Ä, B((1), new int[]{{2}}), Ç }} }}"
    facts = code(spark, text)
    assert rows(facts.failed) == [] and rows(facts.fields, "name") == [("größe",), ("m",)]
    assert rows(facts.methods, "name") == [("été",)]
    nodes = rows(Flow(facts).dfg_nodes, "node", "variable", "op")
    assert [(v, o) for _, v, o in nodes] == [("née", "def"), ("née", "use"), ("größe", "use"), ("ñ", "def"), ("ñ", "use")]


def test_sealed_types_and_records(spark):
    text = """package a;
sealed interface S permits T, U {}
non-sealed class T implements S { int x; }
public final class U<X> extends Base<X> implements S permits W { }
record P(int a, List<String> b) implements S { static int n; int sum(int c) { return a + c; } }
"""
    facts = code(spark, text)
    kinds = {r["name"]: (r.kind, list(r.modifiers), list(r.extends), list(r["implements"])) for r in facts.types.collect()}
    assert kinds == {"S": ("interface", ["sealed"], [], []), "T": ("class", ["non-sealed"], [], ["S"]),
                     "U": ("class", ["public", "final"], ["Base"], ["S"]), "P": ("record", [], [], ["S"])}
    assert rows(facts.fields, "name") == [("n",), ("x",)] and rows(facts.methods, "key") == [("method:a.P#sum(int):int",)]
    assert rows(facts.statements, "text") == [("return a + c",)]


def test_brackets_of_any_depth(spark):
    for n in (6, 7, 40, 300):
        deep = "Map<K, " * n + "Long" + ">" * n
        squares, braces = "[" * n + "q" + "]" * n, "{" * n + "1" + "}" * n
        text = f"class A {{ {deep} m = new Foo(), k; int v = arr{squares}; Object o = new int[]{braces}; {deep} get({deep} p) {{ x = a[b{squares}] + c; f(() -> {braces}); return o; }} }}"
        facts = code(spark, text)
        assert rows(facts.failed) == [] and rows(facts.fields, "name", "type_simple") == [("k", deep), ("m", deep), ("o", "Object"), ("v", "int")], n
        assert rows(facts.params, "type_simple") == [(deep,)]
        used = [r.variable for r in Flow(facts).dfg_nodes.orderBy("node").collect() if r.op == "use"]
        assert used == ["a", "c", "o"], (n, used)


def test_last_import_of_a_name_wins(spark):
    facts = code(spark, "import a.Foo; import b.Foo; import c.*; class A { Foo f; }")
    assert rows(import_map(facts.imports), "simple_name", "path") == [("Foo", "b.Foo")]
    assert rows(facts.fields, "type_fqn") == [("b.Foo",)]


def test_odd_files(spark):
    facts = code(spark, None, "", ";", "}", "/* open", '"open', "class A { int[] x = {1; }", "outer: { }", "class B { label: { int x = 1; } int y; }")
    assert rows(facts.failed, "file_id") == [(3,), (6,)]
    assert rows(facts.fields, "file_id", "name") == [(8, "y")]


def test_a_second_language_by_its_data(spark):
    from codefacts.operators.facts import facts_by_language, table_of_all

    cs = """using System; using static System.Math; using A.B.Foo;
namespace P.Q {
  [Serializable, Old] [Table("t{")] internal sealed partial class C<T> : Base<T>, IOne, ITwo where T : new() {
    const string S = @"\\"; string q = $"{a}"; public Foo[] foos, more;
    static int F(ref int a, out Foo b, params string[] c) {
      using (var r = Open()) { if (a > 1) { b = null; } else return a; }
      foreach (var x in foos) { a += x; }
      try { G(a); } catch { H(); } finally { K(); }
      Func<int> f = () => { return 1; };
      return a;
    }
  }
  struct D { int z; } enum E { A, B = 2 }
}"""
    data = [("r", 0, "a/F.cs", cs), ("r", 1, "a/F.java", CART), ("r", 2, "a/F.txt", cs)]
    facts = facts_by_language(spark.createDataFrame(data, "repo_id string, file_id long, path string, content string"))
    code = facts["csharp"]
    kinds = {r["name"]: r for r in code.types.collect()}
    assert {n: (r.kind, r.fqn) for n, r in kinds.items()} == {"C": ("class", "P.Q.C"), "D": ("class", "P.Q.D"), "E": ("enum", "P.Q.E")}
    assert kinds["C"].extends == ["Base"] and kinds["C"].implements == ["IOne", "ITwo"] and kinds["C"].modifiers == ["internal", "sealed", "partial"]
    assert [tuple(a) for a in kinds["C"].annotations][-1] == ("Table", '"t{"')
    assert rows(code.imports, "path", "static") == [("A.B.Foo", False), ("System", False), ("System.Math", True)]
    assert rows(code.fields, "name", "type_fqn") == [("S", "string"), ("foos", "A.B.Foo"), ("more", "A.B.Foo"), ("q", "string"), ("z", "int")]
    assert rows(code.methods, "signature_resolved") == [("F(int,A.B.Foo,string[])",)]
    assert [t for (t,) in rows(code.statements.orderBy("seq"), "text")] == sorted(
        ["b = null", "return a", "a += x", "G(a)", "H()", "K()", "Func<int> f = () => { return 1; }", "return a"], key=lambda t: repr((t,)))
    used = {r.variable for r in Flow(code).dfg_nodes.collect() if r.op == "use"}
    assert {"a", "foos", "x"} <= used
    assert rows(table_of_all(facts, lambda c: c.methods).select("language", "name")) == [("csharp", "F"), ("java", "add")]


def test_parts_in_deep_nesting_are_no_longer_than_others():
    deep = "class V { int m(int a) {" + "if (a > 1) {" * 200 + "a = 2;" + "}" * 200 + "return a; } }"
    parts = list(read(deep))
    assert len(parts) == 204
    assert max(len(part[12]) for part in parts) == 1
    mixed = "class V { void m() { while (a) { if (b) { while (c) { do { d(); } while (e); } } } } }"
    assert [list(part[12]) for part in read(mixed) if part[4] == "d()"] == [["while", "if", "do"]]


def test_flow_keeps_no_row_per_enclosing_part(spark):
    depth = 120
    deep = "class V { int m(int a) {" + "if (a > 1) {" * depth + "a = 2;" + "}" * depth + "return a; } }"
    edges = Flow(code(spark, deep)).cfg_edges
    assert "Generate explode(sequence(" not in edges._jdf.queryExecution().optimizedPlan().toString()
    want = [(0, 2, ""), *((i, i + 1, "true") for i in range(2, depth + 2)), *((i, depth + 3, "false") for i in range(2, depth + 2)),
            (depth + 2, depth + 3, ""), (depth + 3, 1, "")]
    assert rows(edges, "src", "dst", "label") == sorted(want, key=repr)


def test_plain_segments_are_read_at_once(monkeypatch):
    """Only segments with literals, comments or parentheses that don't close go token by token."""
    known, seen = reader._patterns(JAVA), []
    monkeypatch.setattr(known, "token", lambda text, at, step=known.token: seen.append(at) or step(text, at))
    assert len(list(read(CART))) == 15 and not seen
    body = 'a = f(b, (c));  d\t= {1, g("x;")}; /* } */ e("{"); while (((((((((h))))))))) k(); for (int i = 0; i < 2; i++) { m(i ); }'
    parts = list(read("class A { void n() {" + body + "} }"))
    assert seen and [part[4] for part in parts[2:]] == [
        "a = f(b, (c))", 'd = {1, g("x;")}', 'e("{")', "while (((((((((h)))))))))", "k()", "for (int i = 0; i < 2; i++)", "m(i )"]
    assert parts[5][5] == "while ((((((\ue000\ue000\ue000h\ue001\ue001\ue001))))))"
    # a parenthesis that is never opened is forgiven until the next one closes it
    assert [part[4] for part in read("class A { x = ); int a; f(b; c) ; }")][1:] == ["x = )", "int a", "f(b", "c)"]


def test_what_is_rare_is_looked_for_where_it_can_be(monkeypatch):
    """The rest of a segment behind a comment is one match, and headers of types are searched where their words stand."""
    known, steps, headers = reader._patterns(JAVA), [], []
    monkeypatch.setattr(known, "token", lambda text, at, step=known.token: steps.append(at) or step(text, at))
    monkeypatch.setattr(known, "type", lambda mask, search=known.type: headers.append(mask) or search(mask))
    body = "".join(f"\n/** why;\n{{ */\tint  m{i}(int a) // {{\n throws X {{ /* c */ return a; }}" for i in range(20))
    parts = list(read("// c\n@A class C {" + body + "\n/* d */ int[] x = { 1, /* e */ 2 }; }"))
    assert [(p[1], p[2], p[3], p[4], p[6]) for p in parts] == [(0, "class", True, "@A class C", 2)] + [
        row for i in range(20) for row in (
            (1, "plain", True, f"int m{i}(int a) throws X", 4 + 3 * i), (2, "plain", False, "return a", 5 + 3 * i))
    ] + [(1, "plain", False, "int[] x = { 1, 2 }", 63)]
    assert headers == [p for p in headers if "class" in p] and len(headers) == 1
    assert sum(at < len("// c\n@A class C {" + body) for at in steps) == 1 + 10 * 20  # 14 of each method before


def test_symbols_read_headers_once(spark):
    kept = []
    facts = CodeFacts(spark.createDataFrame([("r", "f", "A.java", CART)], "repo_id string, file_id string, path string, content string"),
                      keep=lambda df, name: kept.append(name) or df)
    assert [r.name for r in facts.symbols.orderBy("n").collect()] == ["Cart", "total", "names", "add", "qty", "name"]
    assert kept.count("headers") == 1 and "headers" in kept


def test_members_of_a_scope_need_no_swept_table(spark, monkeypatch):
    from codefacts.plans import code_queries

    monkeypatch.setattr(ordering, "_swept", None)
    monkeypatch.setattr(code_queries, "facts", lambda spark, folder: code(spark, CART))
    found = code_queries.code_scope_members(spark, "")
    assert rows(found.select(F.split("scope", " ")[1], "page", F.size(F.split("symbol_ids", ",")))) == [("a.b", 0, 1), ("a.b.Cart", 0, 3), ("a.b.Cart.add", 0, 2)]
    symbols = spark.createDataFrame([("s", n, f"i{n}") for n in range(5)], "scope string, n int, symbol_id string")
    assert rows(scope_members(symbols, bounded=True, page_size=2), "page", "symbol_ids") == [(0, ["i0", "i1"]), (1, ["i2", "i3"]), (2, ["i4"])]


def test_types_as_written(spark):
    df = spark.createDataFrame([("int",), ("Map < String,List<A> > [ ]",), ("A[]",), (None,), ("",), ("Set<?extends B>",), (" C ",)], "t string")
    assert [tuple(r) for r in df.select(plain_type(F.col("t")), base_type(F.col("t"))).collect()] == [
        ("int", "int"), ("Map<String, List<A>>[]", "Map "), ("A[]", "A"), (None, None), ("", ""), ("Set<? extends B>", "Set"), ("C", " C ")]
