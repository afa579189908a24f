"""What the library must know of a language, as plain data, and the registry of languages it reads."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.languages import JAVA_LANG_TYPES
from .lexer import NAME, PARENS, WORD


@dataclass(frozen=True)
class Language:
    """A language with braces. Fields without a default have none in common; the defaults are Java's and those of its kin.

    Patterns of the first half are read by the reader (Python's ``regex``), those of the second by Spark.
    """

    name: str
    suffixes: tuple[str, ...]
    #: Comment, literal, one of ``{}();`` or a run of anything else.
    tokens: str = (
        r'"""[\s\S]*?"""|/\*[\s\S]*?\*/|//[^\n]*|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
        + r"|[{}();]|[^/" + r'"' + r"'{}();]++|[\s\S]"
    )
    comments: tuple[str, ...] = ("//", "/*")
    quotes: tuple[str, ...] = ('"', "'")
    #: What may stand before the quote of a literal.
    quote_marks: tuple[str, ...] = ()
    #: Control heads with a condition in parentheses, those without, and those that mean the same as another.
    tested: tuple[str, ...] = ("if", "while", "for", "switch", "synchronized", "catch", "try")
    bare: tuple[str, ...] = ("try", "finally", "do", "else")
    alike: tuple[tuple[str, str], ...] = ()
    cases: str = r"case\b(?:[^:?]|::|\?[^:]*:)*?:(?!:)|default\s*:(?!:)"
    #: Heads that open a level for what follows them in the same segment.
    nesting: tuple[str, ...] = ("if", "elseif", "else", "while", "for", "switch", "do", "synchronized", "try", "catch", "finally")
    types: tuple[str, ...] = ("class", "interface", "enum", "record")
    #: What may stand before a brace that belongs to an expression.
    value_ends: tuple[str, ...] = ("=", "]", "->")
    value_words: tuple[str, ...] = ("return",)
    creator: str = "new"

    #: Groups: the name of the package; static mark, path and wildcard of an import.
    package: str = rf"^package\s+([{WORD}.]+)"
    imported: str = rf"^import\s+(static\s+)?([{WORD}.]+?)(\.\*)?$"
    modifiers: str = "public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|non-sealed|sealed"
    annotation: str = rf"@(?!interface\b){NAME}(?:\.{NAME})*(?:\s*{PARENS})?"
    #: Of a header without type arguments: the names it extends, and those it implements.
    extends: str = rf"\bextends ([{WORD}., ]+?)(?: implements\b| permits\b|$)"
    implements: str = rf"\bimplements ([{WORD}., ]+?)(?: permits\b|$)"
    #: Types that need no import, and what stands before their names.
    builtin: tuple[str, ...] = ()
    builtin_prefix: str = ""

    @property
    def prefix(self) -> str:
        """Annotations and modifiers before a declaration."""
        return rf"(?s)^(?:(?:{self.annotation}|(?:{self.modifiers})\b(?!\s*:))\s*)*+"


JAVA = Language("java", (".java",), builtin=JAVA_LANG_TYPES, builtin_prefix="java.lang.")

# Keywords, modifiers and everyday types of C#.
CSHARP = Language(
    "csharp", (".cs",),
    tokens=(
        r'"""[\s\S]*?"""|/\*[\s\S]*?\*/|//[^\n]*|\$?@\$?"[^"]*+(?:""[^"]*+)*+"|\$?"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
        + r"|[{}();]|[^/" + r'"' + r"'{}();@$]++|[\s\S]"),
    quote_marks=("@", "$"),
    tested=("if", "while", "for", "foreach", "switch", "lock", "using", "fixed", "catch"),
    bare=("try", "finally", "do", "else", "catch"),
    alike=(("foreach", "for"), ("lock", "try"), ("using", "try"), ("fixed", "try"), ("struct", "class")),
    types=("class", "interface", "enum", "record", "struct"),
    value_ends=("=", "]", "=>"),
    package=rf"^namespace\s+([{WORD}.]+)",
    imported=rf"^(?:global\s+)?using\s+(static\s+)?([{WORD}.]+)()$",
    modifiers="public|protected|private|internal|static|readonly|const|abstract|virtual|override|sealed|partial|async|extern|unsafe|volatile|new|required|ref|out|in|params|this",
    annotation=rf"\[\s*{NAME}(?:\.{NAME})*(?:\s*{PARENS})?(?:\s*,\s*{NAME}(?:\.{NAME})*(?:\s*{PARENS})?)*\s*\]",
    extends=rf":\s*((?!I\p{{Lu}})[{WORD}.]+)",
    implements=rf":\s*(?:(?!I\p{{Lu}})[{WORD}.]+\s*,?\s*)?([{WORD}., ]*?)(?: where\b|$)",
    builtin=("Object", "String", "Int32", "Int64", "Double", "Boolean", "Exception", "Math", "Console", "Type", "Attribute", "Action", "Func"),
    builtin_prefix="System.",
)

REGISTRY: dict[str, Language] = {language.name: language for language in (JAVA, CSHARP)}
