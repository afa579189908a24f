"""Declarations and statements of a corpus, from the parts table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.paths import detect_language
from ..session import materialize
from . import lexer, reader
from .language import JAVA, REGISTRY, Language
from .lexer import ANGLES, NAME, PARENS, TYPES, WORD

PREFIX = JAVA.prefix
TYPE = rf"{NAME}(?:\s*\.\s*{NAME})*+(?:\s*{ANGLES})?(?:\s*\.\s*{NAME}(?:\s*{ANGLES})?)*(?:\s*\[\s*\])*"
METHOD = rf"(?s)^(?:{ANGLES}\s*)?({TYPE})\s+({NAME})\s*({PARENS})\s*((?:\[\s*\]\s*)*)(?:throws\s+([{WORD}.,\s]+?))?\s*(?:default\b.*)?$"
FIELD = rf"(?s)^({TYPE})\s+({NAME}\s*(?:[\[=,].*)?)$"
PARAMETER = rf"(?:[^,<>()]++|{ANGLES}|{PARENS})++"
PARAMETER_PARTS = rf"(?s)^({TYPE})\s*(\.\.\.)?\s*\b({NAME})\s*((?:\[\s*\]\s*)*)$"
DECLARATOR = rf"(?:^|,)\s*({NAME})\s*(?:\[\s*\]\s*)*(?==[^=]|,|$)"
# Words that start a statement and are no type.
NOT_A_TYPE = "return|throw|new|else|assert|break|continue|case|package|import|goto|yield|instanceof"
LOCAL = rf"(?s)^(?:(?:final|{JAVA.annotation})\s+)*(?!(?:{NOT_A_TYPE})\b)({TYPE})\s+({NAME}\s*(?:\[\s*\]\s*)*(?:[=,].*)?)$"
TARGET = rf"(?:[{WORD}.\s]++|{PARENS}|{lexer.SQUARES})++"
ASSIGNMENT = rf"(?s)^({TARGET})\s*(?:[-+*/%&|^]|<<|>>>?)?=(?!=)(.*)$"
# Bodies whose statements are not listed.
UNLISTED = ("switch", "do", "synchronized")


def union_kinds(kinds: dict[str, DataFrame]) -> DataFrame:
    """Rows of all kinds of declarations in one table; attributes a kind lacks are null."""
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def plain_type(text: Column) -> Column:
    """Type text in one form: no blanks but one after each comma and around words."""
    # most types are one word, which stays as it is
    bare = text.rlike(rf"^[{WORD}]*$")
    tight = F.regexp_replace(F.trim(lexer.unmarked(text)), r"\s*([<>\[\].?&])\s*", "$1")
    return F.when(bare, text).otherwise(F.regexp_replace(F.regexp_replace(tight, r"\s*,\s*", ", "), rf"\?(?=[{WORD}])", "? "))


def base_type(simple: Column) -> Column:
    """A type without its arguments and array marks."""
    return F.substring_index(F.substring_index(simple, "<", 1), "[", 1)


def resolve_type(simple: Column, imports: Column, package: Column, language: Language = JAVA) -> Column:
    """Fully qualified name of a type as written, best effort.

    ``imports`` is the file's map from simple to full name. Order: import, lower-case names as they are, well-known
    types, the same package, and else the name itself. The first and third drop generics and array marks.
    """
    base = base_type(simple)
    imported = F.try_element_at(imports, base)
    return (
        F.when(imported.isNotNull(), imported)
        .when(F.substring(base, 1, 1).rlike(r"^\p{Ll}"), simple)
        .when(base.isin(*language.builtin), F.concat(F.lit(language.builtin_prefix), base))
        .when(package.isNotNull(), F.concat_ws(".", package, base))
        .otherwise(simple)
    )


def resolve_types(refs: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """References ``(file_id, type_simple)`` with ``type_fqn``, by joins on the file."""
    base = base_type(F.col("type_simple"))
    names = imports.select("file_id", F.col("simple_name").alias("_base"), F.col("path").alias("_path"))
    joined = refs.withColumn("_base", base).join(names, ["file_id", "_base"], "left").join(
        packages.select("file_id", "package"), "file_id", "left"
    )
    hit = F.when(F.col("_path").isNotNull(), F.create_map("_base", "_path")).otherwise(
        F.create_map().cast("map<string,string>"))
    return joined.withColumn("type_fqn", resolve_type(F.col("type_simple"), hit, F.col("package"))).drop("_base", "_path")


def import_map(imports: DataFrame) -> DataFrame:
    """Full name per file and simple name; a later import of the same name wins, wildcards do not count."""
    return imports.filter(~F.col("wildcard")).groupBy("file_id", "simple_name").agg(F.max_by("path", "pos").alias("path"))


def line_ends(decls: DataFrame, owner: list[str], total: Column) -> DataFrame:
    """End of each declaration: the line before its next sibling, or the file's last line."""
    following = Window.partitionBy("file_id", *owner).orderBy("ord")
    return decls.withColumn("line_end", F.coalesce(F.lead("line_start").over(following) - 1, total).cast("int"))


def modifiers(prefix: Column, language: Language = JAVA) -> Column:
    bare = F.regexp_replace(prefix, language.annotation, " ")
    return F.regexp_extract_all(bare, F.lit(rf"\b({language.modifiers})\b"), F.lit(1))


def annotations(prefix: Column, language: Language = JAVA) -> Column:
    """Array of (name, element); the element is the source text between the parentheses."""
    found = F.regexp_extract_all(prefix, F.lit(language.annotation), F.lit(0))

    def one(text: Column) -> Column:
        inner = F.regexp_extract(text, r"(?s)\((.*)\)\s*\]?$", 1)
        return F.struct(
            F.regexp_extract(text, rf"^[@\[]\s*({NAME}(?:\.{NAME})*)", 1).alias("name"), F.nullif(inner, F.lit("")).alias("element")
        )

    return F.transform(found, one)


def names_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda n: F.trim(n)), lambda n: n != "")


def groups(text: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that spans the text, found once; an array of one element where it doesn't match."""
    return F.split(F.regexp_replace(text, pattern, "\u0003".join(f"${i + 1}" for i in range(n))), "\u0003", -1)


def _group(array: str, i: int) -> Column:
    return F.element_at(array, i)


def statement_kind(mask: Column) -> Column:
    """Kind of a plain statement, null for those that are not listed (throw, break, …)."""
    return (
        F.when(mask.rlike(r"^return\b"), "ReturnStatement")
        .when(mask.rlike(rf"^(?:throw|break|continue|assert|yield)\b") | (mask == ""), F.lit(None))
        .when(mask.rlike(LOCAL), "LocalVarDecl")
        .when(mask.rlike(ASSIGNMENT), "Assignment")
        .when(mask.rlike(r"^new\b"), "ClassCreator")
        .when(mask.rlike(r"^this\b"), "FieldAccess")
        .when(mask.rlike(rf"(?s)^(?!super\b)[{WORD}.\s]*{NAME}\s*{PARENS}"), "MethodInvocation")
        .otherwise("Expression")
    )


class CodeFacts:
    """Fact tables of a corpus ``(repo_id, file_id, path, content)``.

    The parts are computed once and written to the shared folder; every table below reads them back. Pass ``parts``
    to use a stored table.
    """

    def __init__(self, sources: DataFrame, parts: DataFrame | None = None,
                 keep: Callable[[DataFrame, str], DataFrame] = materialize, language: Language = JAVA) -> None:
        self.sources = sources
        self.language = language
        self.keep = keep
        self.parts = lexer.by_file(keep(reader.parts(sources, language), "parts") if parts is None else parts)

    @property
    def tree(self) -> DataFrame:
        """Parts with their owner type and method (by ``ord``), and the kinds between that method and the part."""
        return self.parts

    @cached_property
    def failed(self) -> DataFrame:
        """Files that could not be read, with the reason; they have no other facts."""
        return self.parts.filter("kind = 'error'").select("file_id", F.col("text").alias("error"))

    @cached_property
    def packages(self) -> DataFrame:
        found = F.regexp_extract("mask", self.language.package, 1)
        return self.parts.filter((F.col("level") == 0) & (F.col("kind") == "plain") & F.col("mask").rlike(self.language.package)).select(
            "file_id", found.alias("package")).filter("package <> ''")

    @cached_property
    def imports(self) -> DataFrame:
        pattern = self.language.imported
        rows = self.parts.filter((F.col("level") == 0) & (F.col("kind") == "plain") & F.col("mask").rlike(pattern))
        order = Window.partitionBy("file_id").orderBy("ord")
        return rows.select(
            "file_id", (F.row_number().over(order) - 1).alias("pos"), F.regexp_extract("mask", pattern, 2).alias("path"),
            (F.regexp_extract("mask", pattern, 1) != "").alias("static"),
            (F.regexp_extract("mask", pattern, 3) != "").alias("wildcard"),
        ).withColumn("simple_name", F.substring_index("path", ".", -1))

    @cached_property
    def files(self) -> DataFrame:
        """Per file: path, key, package, number of lines and the map of its imports."""
        mapped = import_map(self.imports).groupBy("file_id").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("simple_name", "path")))).alias("import_map"))
        rows = self.sources.select(
            "repo_id", "file_id", "path", keys.file_key(F.col("path")).alias("key"),
            (lexer.newlines(F.col("content")) + 1).alias("total_lines"))
        # every other table joins this one, which has a row per file
        return self.keep(rows.join(self.packages, "file_id", "left").join(mapped, "file_id", "left").withColumn(
            "import_map", F.coalesce("import_map", F.create_map().cast("map<string,string>"))), "files")

    def _declared(self, rows: DataFrame) -> DataFrame:
        """Split the annotations and modifiers from the rest of a declaration."""
        size = F.length(F.regexp_extract("mask", self.language.prefix, 0))
        prefix = F.substring(F.col("text"), F.lit(1), size)
        return rows.withColumns({
            "rest": F.trim(F.substring(F.col("mask"), size + 1, F.length("mask"))),
            "modifiers": modifiers(prefix, self.language), "annotations": annotations(prefix, self.language),
        })

    @cached_property
    def _headers(self) -> DataFrame:
        """Type headers with their name and full name."""
        head = rf"(?s)(?:^|[\s)\]])({'|'.join(self.language.types)})\s+({NAME})"
        rows = self._declared(self.tree.filter(F.col("kind").isin(*TYPES))).join(self.files.select("file_id", "package", "total_lines"), "file_id")
        return rows.withColumn("name", F.regexp_extract("rest", head, 2)).select(
            "file_id", "ord", "kind", "line", "rest", "modifiers", "annotations", "total_lines", "name",
            keys.fqn(F.col("package"), F.col("name")).alias("fqn"))

    @cached_property
    def types(self) -> DataFrame:
        bare = F.regexp_replace(F.regexp_replace("rest", ANGLES, ""), r"\s+", " ")
        extends = names_of(F.regexp_extract(bare, self.language.extends, 1))
        constants = self.tree.filter("member AND owner_kind = 'enum'").groupBy("file_id", "owner_ord").agg(
            F.min_by("mask", "ord").alias("body")).select(
            "file_id", F.col("owner_ord").alias("ord"),
            F.regexp_extract_all(lexer.strip_brackets(F.col("body")), F.lit(rf"(?:^|,)\s*(?:@{NAME}\s+)*({NAME})\s*(?=,|$)"), F.lit(1)).alias("constants"))
        found = self._headers.join(constants, ["file_id", "ord"], "left").select(
            "file_id", "ord", "name", "kind", "fqn", keys.type_key(F.col("fqn")).alias("key"), "modifiers",
            "annotations", extends.alias("extends"),
            names_of(F.regexp_extract(bare, self.language.implements, 1)).alias("implements"),
            F.when(F.col("kind") == "enum", F.coalesce("constants", F.array().cast("array<string>"))).alias("body"),
            F.col("line").alias("line_start"), "total_lines",
        )
        return line_ends(found, ["kind"], F.col("total_lines")).drop("total_lines")

    def _members(self, owner_kinds: tuple[str, ...]) -> DataFrame:
        rows = self._declared(self.tree.filter(
            F.col("member") & (F.col("kind") == "plain") & F.col("owner_kind").isin(*owner_kinds)))
        owners = self._headers.select("file_id", F.col("ord").alias("owner_ord"), F.col("fqn").alias("owner_fqn"))
        context = self.files.select("file_id", "path", "package", "import_map", "total_lines")
        return rows.join(owners, ["file_id", "owner_ord"]).join(context, "file_id")

    @cached_property
    def fields(self) -> DataFrame:
        rows = self._members(("class", "record")).filter(
            ~F.col("opens") & F.col("rest").rlike(FIELD) & ~F.col("rest").rlike(METHOD))
        simple = plain_type(F.regexp_extract("rest", FIELD, 1))
        # constructor arguments and generics of the initialisers hold commas of their own
        names = F.regexp_extract_all(
            lexer.strip_brackets(F.regexp_extract("rest", FIELD, 2)), F.lit(DECLARATOR), F.lit(1))
        typed = rows.withColumn("type_simple", simple).withColumn(
            "type_fqn", resolve_type(F.col("type_simple"), F.col("import_map"), F.col("package"), self.language))
        return typed.select("*", F.posexplode(names).alias("pos", "name")).select(
            "file_id", "owner_ord", "owner_fqn", "ord", "pos", "name", "type_simple", "type_fqn",
            keys.field_key(F.col("owner_fqn"), F.col("name"), F.col("type_fqn")).alias("key"),
            "modifiers", "annotations", F.col("line").alias("line_start"),
            keys.confidence(F.col("type_fqn"), F.col("type_simple")).alias("confidence"), F.lit("ast").alias("source"),
        )

    @cached_property
    def methods(self) -> DataFrame:
        rows = self._members(("class", "interface", "record")).filter(F.col("rest").rlike(METHOD))
        listed = F.regexp_extract_all(F.regexp_extract(_group("m", 3), r"(?s)^\((.*)\)$", 1), F.lit(PARAMETER), F.lit(0))
        cut = F.transform(listed, lambda text: groups(F.regexp_replace(F.trim(text), self.language.prefix, ""), PARAMETER_PARTS, 4))
        ps = F.transform(F.filter(cut, lambda g: F.size(g) == 4), lambda g: F.struct(
            g[2].alias("name"), plain_type(F.concat(g[0], g[3])).alias("type_simple"), (g[1] != "").alias("varargs")))
        context = F.col("import_map"), F.col("package"), self.language
        read = rows.withColumn("m", groups(F.col("rest"), METHOD, 5)).withColumns({
            "ps": ps, "return_type": plain_type(F.concat(_group("m", 1), _group("m", 4))),
        }).withColumns({
            "params": F.transform("ps", lambda p: F.struct(
                p["name"].alias("name"), p["type_simple"].alias("type_simple"),
                resolve_type(p["type_simple"], *context).alias("type_fqn"), p["varargs"].alias("varargs"))),
            "return_type_fqn": resolve_type(F.col("return_type"), *context),
            "name": _group("m", 2),
        })
        simple_types = F.transform("params", lambda p: p["type_simple"])
        full_types = F.transform("params", lambda p: p["type_fqn"])
        order = Window.partitionBy("file_id", "owner_ord").orderBy("ord")
        found = read.select(
            "file_id", "owner_ord", "owner_kind", "owner_fqn", "ord", (F.row_number().over(order) - 1).alias("pos"), "name",
            F.col("return_type").alias("return_type_simple"), "return_type_fqn",
            keys.signature(F.col("name"), simple_types).alias("signature_simple"),
            keys.signature(F.col("name"), full_types).alias("signature_resolved"),
            keys.method_key(F.col("owner_fqn"), F.col("name"), full_types, F.col("return_type_fqn")).alias("key"),
            "modifiers", "annotations", names_of(_group("m", 5)).alias("throws"), "params",
            F.col("opens").alias("has_body"), F.col("line").alias("line_start"), F.lit(1.0).alias("confidence"),
            F.lit("ast").alias("source"), "total_lines",
        )
        return self.keep(line_ends(found, ["owner_ord"], F.col("total_lines")).drop("total_lines"), "methods")

    @cached_property
    def params(self) -> DataFrame:
        return self.methods.select(
            "file_id", F.col("ord").alias("method_ord"), F.col("key").alias("method_key"), F.posexplode("params").alias("pos", "p")
        ).select("file_id", "method_ord", "method_key", "pos", "p.*")

    @cached_property
    def in_methods(self) -> DataFrame:
        """Parts inside a method that is listed, with the method's key."""
        scopes = self.methods.select("file_id", F.col("ord").alias("method_ord"), F.col("key").alias("method_key"))
        # the hash on the file id serves every window and join below
        return self.tree.filter(F.col("method_ord").isNotNull()).join(scopes, ["file_id", "method_ord"])

    @cached_property
    def statements(self) -> DataFrame:
        """Listed statements in source order, with parent and a key that control and data flow share."""
        rows = self.in_methods.filter((F.col("kind") == "plain") & ~F.arrays_overlap("inside", F.array(*map(F.lit, UNLISTED))))
        kind = F.when(~F.col("opens"), statement_kind(F.col("mask")))
        order = Window.partitionBy("file_id", "method_ord").orderBy("ord")
        listed = rows.withColumn("stmt_kind", kind).filter("stmt_kind IS NOT NULL").join(
            self.files.select("file_id", "path"), "file_id")
        return listed.select(
            "file_id", "method_ord", "method_key", "ord", "parent_ord", (F.row_number().over(order) - 1).alias("seq"),
            F.col("stmt_kind").alias("kind"), "text", "mask", "line",
            keys.stmt_key(F.col("path"), F.col("line"), F.col("stmt_kind"), F.col("text")).alias("stmt_key"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        """Symbol table: types, fields, methods and parameters with scoped ids, their file, modifiers and annotations, numbered
        within each file.

        Within a type the order is the type, its fields, then each method followed by its parameters.
        """
        # types, fields, methods and the owners below all ask for the headers
        self._headers = self.keep(self._headers, "headers")
        packages = self.packages.select("file_id", "package")
        names = F.transform("annotations", lambda a: a["name"]).alias("annotations")
        place = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "interface", 1).otherwise(2)
        types = self.types.join(packages, "file_id", "left").select(
            "file_id", F.col("kind").alias("type"), "name", F.coalesce("package", F.lit("default")).alias("scope"),
            F.lit(None).cast("string").alias("data_type"), F.col("line_start").alias("line"), "modifiers", names,
            F.struct(place, F.col("ord"), F.lit(0), F.col("ord"), F.lit(0)).alias("at"))
        owners = self._headers.select("file_id", F.col("ord").alias("owner_ord"), place.alias("place"))
        fields = self.fields.join(owners, ["file_id", "owner_ord"]).select(
            "file_id", F.lit("field").alias("type"), "name", F.col("owner_fqn").alias("scope"),
            F.col("type_simple").alias("data_type"), F.col("line_start").alias("line"), "modifiers", names,
            F.struct(F.col("place"), F.col("owner_ord"), F.lit(1), F.col("ord"), F.col("pos")).alias("at"))
        methods = self.methods.join(owners, ["file_id", "owner_ord"])
        declared = methods.select(
            "file_id", F.lit("method").alias("type"), "name", F.col("owner_fqn").alias("scope"),
            F.col("return_type_simple").alias("data_type"), F.col("line_start").alias("line"), "modifiers", names,
            F.struct(F.col("place"), F.col("owner_ord"), F.lit(2), F.col("ord"), F.lit(-1)).alias("at"))
        params = methods.select("*", F.posexplode("params").alias("i", "p")).select(
            "file_id", F.lit("parameter").alias("type"), F.col("p.name").alias("name"),
            F.concat_ws(".", "owner_fqn", "name").alias("scope"), F.col("p.type_simple").alias("data_type"),
            F.lit(None).cast("int").alias("line"), F.array().cast("array<string>").alias("modifiers"),
            F.array().cast("array<string>").alias("annotations"),
            F.struct(F.col("place"), F.col("owner_ord"), F.lit(2), F.col("ord"), F.col("i")).alias("at"))
        columns = ["file_id", "type", "name", "scope", "data_type", "line", "modifiers", "annotations"]
        every = reduce(DataFrame.unionByName, [
            df.select(*columns, F.col("at").cast("struct<a:int,b:bigint,c:int,d:bigint,e:int>").alias("at"))
            for df in (types, fields, declared, params)])
        numbered = every.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("at")))
        return numbered.join(self.files.select("file_id", F.col("path").alias("file")), "file_id").select(
            "file_id", "file", "n", F.concat_ws("_", "type", "scope", "name", F.col("n").cast("string")).alias("symbol_id"),
            *columns[1:])


def facts_by_language(sources: DataFrame, registry: dict[str, Language] = REGISTRY) -> dict[str, CodeFacts]:
    """Facts of each language of the registry, whose files are known by their suffix; other files are in none."""
    named = sources.withColumn("_language", detect_language(F.col("path"), {n: g.suffixes for n, g in registry.items()}))
    return {n: CodeFacts(named.filter(F.col("_language") == n).drop("_language"), language=g) for n, g in registry.items()}


def table_of_all(facts: dict[str, CodeFacts], table: Callable[[CodeFacts], DataFrame]) -> DataFrame:
    """One table of a mixed corpus, with the language of each row."""
    return reduce(DataFrame.unionByName, [table(code).withColumn("language", F.lit(n)) for n, code in facts.items()])
