"""Language registry, display names, well-known Java types."""

from __future__ import annotations

# Languages that can be analysed, with the suffixes of their files.
LANGUAGE_SUFFIXES: dict[str, tuple[str, ...]] = {"java": (".java",)}

# Extension (no dot, lower case) to display name.
EXTENSION_NAMES: dict[str, str] = {
    "py": "Python", "java": "Java",
    "ts": "TypeScript", "tsx": "TypeScript",
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "cbl": "COBOL", "cob": "COBOL", "cpy": "COBOL",
    "html": "HTML", "htm": "HTML",
    "css": "CSS", "scss": "SCSS", "sass": "SCSS",
    "json": "JSON", "md": "Markdown",
    "sh": "Shell", "bash": "Shell",
    "go": "Go", "rs": "Rust",
    "c": "C", "h": "C",
    "cpp": "C++", "cc": "C++", "hpp": "C++",
    "cs": "C#", "rb": "Ruby", "php": "PHP", "kt": "Kotlin", "swift": "Swift",
    "scala": "Scala", "sc": "Scala",
    "yml": "YAML", "yaml": "YAML",
    "xml": "XML", "sql": "SQL",
}
OTHER_LANGUAGE = "Other"

# Java types that need no import.
JAVA_LANG_TYPES: tuple[str, ...] = (
    "Object", "String", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character",
    "Number", "Math", "System", "Thread", "Runnable", "Comparable", "Iterable", "Class", "Enum",
    "Throwable", "Exception", "RuntimeException", "Error", "StringBuilder", "StringBuffer",
    "Override", "Deprecated", "SuppressWarnings", "FunctionalInterface",
)
