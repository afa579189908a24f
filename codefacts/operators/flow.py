"""Control flow and data flow of every method, from the tree of parts.

No join is needed for control flow: each part carries what its siblings (windows inside one file) and its enclosing parts
(``enclosing``) say, and the edges of a statement follow from its own row.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from . import enclosing, lexer
from .enclosing import LOOPS
from .facts import ASSIGNMENT, LOCAL, PREFIX, CodeFacts, plain_type, statement_kind
from .graph import dfg_metrics, graph_counts, link_def_use, one_edge_per_pair
from .lexer import LEFT, NAME, RIGHT, WORD, kind_is

ENTRY, EXIT = 0, 1
# Parts whose body the graph does not enter.
OPAQUE = ("do", "synchronized")
CONTINUES = ("elseif", "else", "catch", "finally")
LABEL_ORDER = ("loop", "true", "false", "exception")

# Names that are not variables (fixed values).
WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends false "
    "final finally float for goto if implements import instanceof int interface long native new null package private "
    "protected public return short static strictfp super switch synchronized this throw throws transient true try void "
    "volatile while var"
).split()
CAST = (
    rf"[({LEFT}]\s*(?:(?:byte|short|int|long|float|double|char|boolean)|\p{{Lu}}[{WORD}.]*(?:{lexer.ANGLES})?)\s*(?:\[\s*\])*\s*[){RIGHT}](?=\s*[{WORD}({LEFT}])"
)
DECLARED = rf"(?:[^,(){{}}<>\[\]]++|{lexer.PARENS}|{lexer.ANGLES}|{lexer.BRACES}|{lexer.SQUARES}|[<>])++"
FOR_EACH = rf"(?s)^((?:final\s+)?[{WORD}.<>\[\], ?]+?)\s+({NAME})\s*(?::(?!:)|\bin\s)(.*)$"
STEP = 1 << 20
VARIABLE = (
    rf"(?<![{WORD}.@])(?:this\s*\.\s*{NAME}(?![{WORD}])(?!\s*[({LEFT}.])|{NAME}(?![{WORD}])(?!\s*(?:[({LEFT}.]|::|->)))"
)


def no_catches() -> Column:
    return F.array().cast("array<bigint>")


def target(node: Column, catches: Column | None = None) -> Column:
    return F.struct(node.cast("bigint").alias("node"), (no_catches() if catches is None else catches).alias("catches"))


class Flow:
    """Control-flow and data-flow tables of a corpus."""

    def __init__(self, facts: CodeFacts) -> None:
        self.facts = facts

    @cached_property
    def steps(self) -> DataFrame:
        """Parts that control flow knows, with node ids in source order after ENTRY and EXIT.

        try, else and bare blocks are passed through and get no node; an empty try does.
        """
        rows = self.facts.in_methods.filter(
            ~F.arrays_overlap("inside", F.array(*map(F.lit, OPAQUE))) & ~kind_is(*lexer.TYPES))
        order = Window.partitionBy("file_id", "method_ord").orderBy("ord")
        block = kind_is("plain") & F.col("opens") & (F.col("mask") == "")
        rows = (
            rows.withColumn("kind", F.when(block, F.lit("block")).otherwise(F.col("kind")))
            .withColumn("filled", F.coalesce(F.lead("parent_ord").over(order) == F.col("ord"), F.lit(False)))
            .filter(~(kind_is("block") & ~F.col("filled")))
            .withColumn("is_node", ~(kind_is("else", "block") | (kind_is("try") & F.col("filled"))))
        )
        before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = rows.withColumn("node", F.when(F.col("is_node"), EXIT + F.sum(F.col("is_node").cast("long")).over(before)))
        return lexer.by_file(self.facts.keep(numbered, "steps"))

    @cached_property
    def cfg_nodes(self) -> DataFrame:
        steps = self.steps.filter("is_node").join(self.facts.files.select("file_id", "path"), "file_id")
        text = F.when(kind_is(*lexer.CASES), F.regexp_replace("text", r"\s*:$", "")).otherwise(F.col("text"))
        kind = F.when(F.col("kind") == "plain", F.coalesce(statement_kind(F.col("mask")), F.lit("stmt"))).when(
            kind_is("elseif"), F.lit("if")).otherwise(F.col("kind"))
        label = F.regexp_replace(text, r"^else\s+if\b", "if")
        branch = kind_is("if", "elseif", "while", "for", "switch")
        shown = steps.select(
            "file_id", "method_ord", F.col("method_key").alias("scope"), "node",
            F.when(branch, F.lit("branch")).otherwise(F.lit("statement")).alias("type"),
            label.alias("label"), "line", keys.stmt_key(F.col("path"), F.col("line"), kind, F.col("text")).alias("stmt_key"),
            label.alias("normalized_text"),
        )
        none = F.lit(None)
        ends = self.scopes.select("file_id", "method_ord", "scope", F.explode(F.array(
            F.struct(F.lit(ENTRY).cast("long").alias("node"), F.lit("entry").alias("type"), F.lit("ENTRY").alias("label")),
            F.struct(F.lit(EXIT).cast("long").alias("node"), F.lit("exit").alias("type"), F.lit("EXIT").alias("label")),
        )).alias("e")).select(
            "file_id", "method_ord", "scope", "e.*", none.cast("int").alias("line"), none.cast("string").alias("stmt_key"),
            none.cast("string").alias("normalized_text"))
        return ends.unionByName(shown)

    @cached_property
    def scopes(self) -> DataFrame:
        """Methods that get graphs: all of classes, and those of interfaces that have a body."""
        return self.facts.methods.filter("owner_kind IN ('class', 'record') OR has_body").select(
            "file_id", F.col("ord").alias("method_ord"), F.col("key").alias("scope"))

    @cached_property
    def cfg_edges(self) -> DataFrame:
        """Edges (file_id, method_ord, scope, src, dst, label), one per pair of nodes."""
        found = self._edges().join(self.scopes, ["file_id", "method_ord"])
        place = F.coalesce(F.array_position(F.array(*map(F.lit, LABEL_ORDER)), F.col("label")), F.lit(0))
        ranked = found.withColumn("_rank", F.when(place == 0, len(LABEL_ORDER) + 1).otherwise(place))
        return one_edge_per_pair(
            ranked, ["file_id", "method_ord", "scope"], ["_rank", "label"]).drop("_rank")

    def _placed(self) -> DataFrame:
        """Steps with what their siblings say: chain of if or try, next statement, first child."""
        case_value = F.trim(F.regexp_extract("text", r"(?s)^case\b(.*):$", 1))
        rows = self.steps.select(
            "file_id", "method_ord", "parent_ord", "ord", "level", "kind", "node", "is_node", "filled",
            F.col("mask").rlike(r"^(?:return|throw)\b").alias("leaves_method"),
            F.when(kind_is("default"), F.lit("default")).when(kind_is("case"), F.concat(F.lit("case:"), case_value)).alias("case_label"))
        # catches and finally of each chain of siblings
        siblings = Window.partitionBy("file_id", "method_ord", "parent_ord").orderBy("ord")
        rows = rows.withColumn("chain", F.sum((~kind_is(*CONTINUES)).cast("int")).over(
            siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        chain = Window.partitionBy("file_id", "method_ord", "parent_ord", "chain")
        rows = rows.withColumn("catches", F.sort_array(F.collect_list(F.when(kind_is("catch"), F.col("node"))).over(chain)))
        rows = rows.withColumn("finally", F.max(F.when(kind_is("finally"), F.col("node"))).over(chain))
        # the first node at or below a part; the tries on the way down lend their catches
        rows = lexer.by_file(enclosing.entries(rows))
        order = Window.partitionBy("file_id", "method_ord").orderBy("ord")
        rows = rows.withColumn("first", F.row_number().over(order) == 1)
        # the nearest following value is the last value in descending order, which one pass finds
        later = Window.partitionBy("file_id", "method_ord", "parent_ord").orderBy(F.desc("ord")).rowsBetween(
            Window.unboundedPreceding, -1)
        plain = ~kind_is(*CONTINUES, *lexer.CASES)
        return rows.withColumns({
            "next": F.last(F.when(plain, F.col("entry")), ignorenulls=True).over(later),
            "child": F.when(F.col("filled"), F.lead("entry").over(order)),
            "_chain_next": F.lead(F.struct("chain", "kind", "entry", "filled")).over(siblings),
        }).withColumn("follow_up", F.when(F.col("_chain_next.chain") == F.col("chain"), F.col("_chain_next"))).drop(
            "_chain_next")

    def _edges(self) -> DataFrame:
        rows = self._placed()
        siblings = Window.partitionBy("file_id", "method_ord", "parent_ord").orderBy("ord")
        rows = rows.withColumn("else_child", F.when(
            F.col("follow_up.kind") == "else", F.lead("child").over(siblings)))
        # where control goes after a part, unless an enclosing part decides
        rows = enclosing.follows(rows, EXIT)

        def go(to: Column, label: Column | str) -> Column:
            name = F.lit(label) if isinstance(label, str) else label
            return F.struct(F.col("node").alias("src"), to["node"].alias("dst"), name.alias("label"), to["catches"].alias("catches"))

        def leave(label: str) -> Column:
            return go(F.col("follow.to"), F.when(F.col("follow.label") == "loop", F.lit("loop")).otherwise(F.lit(label)))

        def into(child: Column, label: str) -> Column:
            return F.when(child.isNotNull(), go(child, label)).otherwise(leave(label))

        plain = F.when(F.col("leaves_method"), go(target(F.lit(EXIT)), "")).otherwise(leave(""))
        otherwise = (
            F.when(F.col("follow_up.kind") == "elseif", go(F.col("follow_up.entry"), "false"))
            .when(F.col("follow_up.kind") == "else", into(F.col("else_child"), "false"))
            .otherwise(leave("false"))
        )
        loop_body = F.when(F.col("child").isNotNull(), go(F.col("child"), "true")).otherwise(go(target(F.col("node")), "loop"))
        from_switch = F.struct(
            F.col("parent_node").alias("src"), F.col("node").alias("dst"), F.col("case_label").alias("label"), no_catches().alias("catches"))
        edges = (
            F.when(kind_is("if", "elseif"), F.array(into(F.col("child"), "true"), otherwise))
            .when(kind_is(*LOOPS), F.array(loop_body, leave("false")))
            .when(kind_is(*lexer.CASES), F.array(from_switch, into(F.col("child"), "")))
            .when(kind_is("catch", "finally"), F.array(into(F.col("child"), "")))
            .when(F.col("is_node"), F.array(plain))
        )
        # a switch with cases is left through them
        own_edges = F.when(F.col("is_node") & ~(kind_is("switch") & F.col("child").isNotNull()), edges)
        start = F.when(F.col("first"), F.array(F.struct(
            F.lit(ENTRY).cast("long").alias("src"), F.col("entry.node").alias("dst"), F.lit("").alias("label"),
            F.col("entry.catches").alias("catches"))))
        none = F.array().cast("array<struct<src:bigint,dst:bigint,label:string,catches:array<bigint>>>")
        every = rows.select("file_id", "method_ord", F.explode(F.concat(
            F.coalesce(start, none), F.coalesce(own_edges, none))).alias("e"))
        # an edge into a try may also end in each of its catches
        thrown = F.transform("e.catches", lambda c: F.struct(c.alias("dst"), F.lit("exception").alias("label")))
        ends = every.select("file_id", "method_ord", "e.src", F.explode(F.concat(
            F.array(F.struct(F.col("e.dst").alias("dst"), F.col("e.label").alias("label"))), thrown)).alias("t"))
        empty = self.scopes.join(self.steps.select("file_id", "method_ord").distinct(), ["file_id", "method_ord"], "left_anti")
        return ends.select("file_id", "method_ord", "src", "t.dst", "t.label").unionByName(empty.select(
            "file_id", "method_ord", F.lit(ENTRY).cast("long").alias("src"), F.lit(EXIT).cast("long").alias("dst"),
            F.lit("").alias("label")))

    @cached_property
    def cfg_metrics(self) -> DataFrame:
        """Size and complexity of each method's graph.

        Each node has an edge to what follows it, so every node leads to EXIT and a graph is always one component. For
        edges from elsewhere use :func:`graph.cfg_metrics`, which counts components.
        """
        on = ["file_id", "method_ord", "scope"]
        parts = self.scopes.withColumn("components", F.lit(1).cast("long"))
        return graph_counts(self.cfg_nodes, self.cfg_edges, parts, on)

    @cached_property
    def accesses(self) -> DataFrame:
        """Variable accesses of each method in order: parameters, then reads before the write of each statement."""
        params = self.facts.methods.filter("owner_kind IN ('class', 'record') OR has_body").select(
            "file_id", "owner_ord", F.col("ord").alias("method_ord"), F.col("key").alias("scope"), F.posexplode("params").alias("pos", "p")
        ).select(
            "file_id", "owner_ord", "method_ord", "scope", F.lit(0).cast("long").alias("ord"), F.lit(0).alias("grp"), F.col("pos").alias("idx"),
            F.col("p.name").alias("variable"), F.lit("def").alias("op"), F.lit("param").alias("origin"), F.lit(False).alias("own"),
            "p.type_simple", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("stmt_text"),
            F.lit(None).cast("string").alias("stmt_kind"))
        unseen = F.array(*map(F.lit, (*OPAQUE, "switch")))
        rows = self.facts.in_methods.filter(~F.arrays_overlap("inside", unseen)).select(
            "file_id", "owner_ord", "method_ord", F.col("method_key").alias("scope"), "ord", "kind", "opens", "text", "mask", "line")
        rows = rows.withColumn("stmt_kind", F.when(kind_is("plain") & ~F.col("opens"), statement_kind(F.col("mask"))))
        items = rows.withColumn("items", _items()).select(
            "file_id", "owner_ord", "method_ord", "scope", "ord", "text", "line", F.coalesce("stmt_kind", "kind").alias("stmt_kind"),
            F.explode("items").alias("a"))
        found = items.select("*", F.posexplode(variables(F.col("a.expr"))).alias("idx", "name"))
        body = found.select(
            "file_id", "owner_ord", "method_ord", "scope", "ord", "a.grp", (F.col("a.step") * STEP + F.col("idx")).alias("idx"),
            F.regexp_replace("name", r"^this\.", "").alias("variable"), "a.op", F.lit("body").alias("origin"),
            F.col("name").startswith("this.").alias("own"), "a.type_simple", "line", F.col("text").alias("stmt_text"), "stmt_kind")
        # names of the owner's fields turn a body access into a field access
        fields = self.facts.fields.select(
            "file_id", "owner_ord", F.col("name").alias("variable"), F.col("key").alias("field_key"), "owner_fqn",
            F.col("type_simple").alias("field_type"), F.col("type_fqn").alias("field_fqn"))
        fields = fields.groupBy("file_id", "owner_ord", "variable").agg(F.max(F.struct("field_key", "owner_fqn", "field_type", "field_fqn")).alias("f"))
        joined = (
            body.unionByName(params).join(fields, ["file_id", "owner_ord", "variable"], "left")
            .join(self.facts.files.select("file_id", "path"), "file_id")
        )
        declares = F.col("type_simple").isNotNull()
        is_field = F.col("f").isNotNull() & ~declares & (F.col("origin") == "body")
        kept = joined.filter(~F.col("own") | F.col("f").isNotNull())
        order = Window.partitionBy("file_id", "method_ord").orderBy("ord", "grp", "idx")
        var_kind = F.when(F.col("origin") == "param", "param").when(is_field, "field").otherwise("local")
        return self.facts.keep(kept.select(
            "file_id", "method_ord", "scope", "ord", "grp", (F.row_number().over(order) - 1).cast("long").alias("node"), "variable",
            var_kind.alias("var_kind"), "op",
            F.when(F.col("origin") == "param", keys.param_key(F.col("scope"), F.col("variable")))
            .when(is_field, F.col("f.field_key")).otherwise(keys.local_key(F.col("scope"), F.col("variable"))).alias("var_key"),
            "line", F.when(F.col("line").isNotNull(), keys.stmt_key(
                F.col("path"), F.col("line"), F.col("stmt_kind"), F.col("stmt_text"))).alias("stmt_key"),
            F.when(is_field, F.col("f.owner_fqn")).alias("owner_fqn"),
            F.when(is_field, F.col("f.field_type")).otherwise(F.col("type_simple")).alias("type_simple"),
            F.when(is_field, F.col("f.field_fqn")).alias("type_fqn"),
        ), "accesses")

    @cached_property
    def dfg_nodes(self) -> DataFrame:
        return self.accesses.drop("ord", "grp")

    @cached_property
    def dfg_edges(self) -> DataFrame:
        """Edges (…, src, dst, type, var_key): definition to use, and use to what its statement defines or writes."""
        scope = ["file_id", "method_ord", "scope"]
        rows = self.accesses
        # a method belongs to one file, whose text bounds the windows
        linked = link_def_use(
            rows.select(F.struct(*scope).alias("scope"), F.col("node").alias("seq"), "var_key", "variable", "op"), bounded=True)
        by_use = linked.filter("def_seq IS NOT NULL").select(
            "scope.*", F.col("def_seq").alias("src"), F.col("seq").alias("dst"), F.lit("def-use").alias("type"), "var_key")
        onward = Window.partitionBy(*scope, "ord", "grp").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
        made = F.last(F.when(F.col("op") != "use", F.struct("node", "op", "var_key")), ignorenulls=True).over(onward)
        inside = rows.withColumn("made", made).filter("op = 'use' AND made IS NOT NULL").select(
            *scope, F.col("node").alias("src"), F.col("made.node").alias("dst"),
            F.when(F.col("made.op") == "def", "init").otherwise("flow").alias("type"), F.col("made.var_key").alias("var_key"))
        order = F.when(F.col("type") == "def-use", 0).when(F.col("type") == "init", 1).otherwise(2)
        ranked = by_use.unionByName(inside).withColumn("_rank", order)
        return one_edge_per_pair(ranked, scope, ["_rank", "var_key"]).drop("_rank").withColumn("confidence", F.lit(1.0))

    @cached_property
    def dfg_metrics(self) -> DataFrame:
        on = ["file_id", "method_ord", "scope"]
        counts = dfg_metrics(self.accesses, on)
        return self.scopes.join(counts, on, "left").fillna(0, [c for c in counts.columns if c not in on])


def variables(mask: Column) -> Column:
    """Names in an expression in order; ``this.x`` keeps its mark until the owner's fields are known."""
    bare = mask
    for pattern in (
        r'"s*"', lexer.BRACES, lexer.SQUARES, rf"\bnew\s+[{WORD}.]+\s*(?:{lexer.ANGLES})?|\binstanceof\s+[{WORD}.]+", CAST,
        rf"(?:[({LEFT}][{WORD},\s]*+[){RIGHT}]|(?<![{WORD}]){NAME})\s*->",
    ):
        bare = F.regexp_replace(bare, pattern, " ")
    names = F.regexp_extract_all(bare, F.lit(VARIABLE), F.lit(0))
    return F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"\s", "")), lambda n: ~n.isin(*WORDS))


def _item(group: Column, op: str, text: Column, type_simple: Column | None = None) -> Column:
    """An expression to read (use), or the target of a definition or write, which comes last in its group."""
    none = F.lit(None).cast("string")
    return F.struct(
        group.cast("int").alias("grp"), F.lit(0 if op == "use" else 1).alias("step"), F.lit(op).alias("op"),
        text.alias("expr"), (none if type_simple is None else type_simple).alias("type_simple"))


def _declarations(text: Column, kind: Column) -> Column:
    """For each declarator its initialiser, then the name it defines."""
    listed = F.regexp_extract_all(text, F.lit(DECLARED), F.lit(0))
    return F.flatten(F.transform(listed, lambda part, i: F.array(
        _item(i, "use", F.regexp_extract(part, r"(?s)^[^=]*=(.*)$", 1)),
        _item(i, "def", F.regexp_extract(part, rf"^\s*({NAME})", 1), kind))))


def _items() -> Column:
    """What one part reads, defines and writes, as an array in order."""
    mask, zero = F.col("mask"), F.lit(0)
    inside = F.regexp_extract(mask, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    kind = F.col("stmt_kind")

    def declared(text: Column) -> Column:
        bare = F.regexp_replace(F.trim(text), PREFIX, "")
        return _declarations(F.regexp_extract(bare, LOCAL, 2), plain_type(F.regexp_extract(bare, LOCAL, 1)))

    assigned = F.array(
        _item(zero, "use", F.regexp_extract(mask, ASSIGNMENT, 2)), _item(zero, "write", F.regexp_extract(mask, ASSIGNMENT, 1)))
    for_each = F.array(
        _item(zero, "use", F.regexp_extract(inside, FOR_EACH, 3)),
        _item(zero, "def", F.regexp_extract(inside, FOR_EACH, 2), plain_type(F.regexp_extract(inside, FOR_EACH, 1))))
    init, condition = F.split_part(inside, F.lit(";"), F.lit(1)), F.split_part(inside, F.lit(";"), F.lit(2))
    tested = F.array(_item(F.lit(STEP), "use", condition))
    counted = F.when(init.rlike(LOCAL), F.concat(declared(init), tested)).otherwise(tested)
    caught = F.array(_item(zero, "def", F.regexp_extract(inside, rf"({NAME})\s*$", 1), plain_type(
        F.regexp_extract(inside, rf"(?s)^(?:final\s+)?(.*?)\s+{NAME}\s*$", 1))))
    return (
        F.when(kind == "LocalVarDecl", declared(mask))
        .when(kind == "Assignment", assigned)
        .when(kind.isin("ReturnStatement", "MethodInvocation", "FieldAccess"), F.array(_item(zero, "use", mask)))
        .when(kind_is("if", "elseif", "while"), F.array(_item(zero, "use", inside)))
        .when(kind_is("for"), F.when(inside.rlike(FOR_EACH), for_each).otherwise(counted))
        .when(kind_is("catch"), caught)
        .when(kind_is("try"), F.flatten(F.transform(F.split(inside, ";"), declared)))
    )
