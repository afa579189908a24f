"""Files with what was computed about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_json, truncate_marked, truncate_omitted
from .ordering import paged_lists

MAX_VIEW = 10_000  # fixed value: characters of a shortened file or graph
MAX_PROMPT = 10_000  # fixed value: characters of source and of each graph in a prompt set


def resolve_refs(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Search hits with the id of their file; hits without a file drop out."""
    return hits.join(files.select("repo_id", "path", "file_id"), ["repo_id", "path"])


def file_docs(requests: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """Documentation for requested paths, telling a missing file from missing documentation."""
    found = requests.join(files.select("repo_id", "path", "file_id"), ["repo_id", "path"], "left").join(
        docs.select("file_id", "content"), "file_id", "left"
    )
    status = (
        F.when(F.col("file_id").isNull(), "no_file").when(F.col("content").isNull(), "no_doc").otherwise("ok")
    )
    return found.withColumn("status", status)


def file_graphs(
    files: DataFrame, ast: DataFrame, cfg: DataFrame, dfg: DataFrame,
    page_size: int = 1000, bounded: bool = False,
) -> DataFrame:
    """Each file with its optional AST and its lists of scoped graphs, in pages.

    Every child is listed by itself before the join, so two lists never multiply. Page 0 exists for every file;
    a missing AST is null and a missing list is empty.
    """
    def listed(child: DataFrame, out: str) -> DataFrame:
        return paged_lists(child, ["file_id"], ["seq"], F.struct("scope", "content"), out, page_size, bounded)

    lists = listed(cfg, "cfg").join(listed(dfg, "dfg"), ["file_id", "page"], "full")
    first = files.select("file_id", F.lit(0).cast("long").alias("page"))
    pages = first.join(lists, ["file_id", "page"], "full").join(files, "file_id")
    empty = F.array().cast("array<struct<scope:string,content:string>>")
    return pages.join(ast.select("file_id", F.col("content").alias("ast")), "file_id", "left").select(
        *files.columns, "page", "ast",
        F.coalesce(F.col("cfg").cast(empty_type()), empty).alias("cfg"),
        F.coalesce(F.col("dfg").cast(empty_type()), empty).alias("dfg"),
    )


def empty_type() -> str:
    return "array<struct<scope:string,content:string>>"


def pending_docs(files: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that still need documentation, and the stored text of the others for re-indexing."""
    return (
        files.join(docs.select("file_id"), "file_id", "left_anti"),
        files.join(docs.select("file_id", "content"), "file_id"),
    )


def view_file(files: DataFrame, path: Column, text: Column, full: bool = False) -> DataFrame:
    """A file's source as markdown; long sources are cut unless ``full``."""
    body = text if full else truncate_marked(text, MAX_VIEW)
    content = F.concat(F.lit("### "), path, F.lit("\n```\n"), body, F.lit("\n```"))
    return files.withColumn("view", F.when(text.isNull(), F.concat(F.lit("File not found: "), path)).otherwise(content))


def view_doc(docs: DataFrame) -> DataFrame:
    """Documentation with its heading, or the reason why there is none, from :func:`file_docs`."""
    view = (
        F.when(F.col("status") == "no_file", F.concat(F.lit("File not found: "), F.col("path")))
        .when(F.col("status") == "no_doc", F.concat(F.lit("No documentation found for "), F.col("path"), F.lit(".")))
        .otherwise(F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.col("content")))
    )
    return docs.withColumn("view", view)


NO_SUMMARY = "No metadata found for this repository."  # fixed value


def view_summary(repos: DataFrame, meta: DataFrame) -> DataFrame:
    """The stored summary ``meta(repo_id, content)`` of each repository, or a note that it has none."""
    return repos.join(meta.select("repo_id", "content"), "repo_id", "left").withColumn(
        "view", F.coalesce("content", F.lit(NO_SUMMARY))).drop("content")


def view_graph(graphs: DataFrame, kind: str, json: Column, full: bool = False) -> DataFrame:
    """A graph's JSON as markdown, or a note that the file has none (null JSON)."""
    body = json if full else truncate_marked(json, MAX_VIEW)
    shown = F.concat(
        F.lit("### "), F.col("path"), F.lit(f" ({kind.upper()})\n```json\n"), body, F.lit("\n```")
    )
    plural = "graph" if kind == "ast" else "graphs"
    none = F.concat(F.lit(f"No {kind.upper()} {plural} found for "), F.col("path"), F.lit("."))
    return graphs.withColumn("view", F.when(json.isNull(), none).otherwise(shown))


# The headings of a prompt.
PROMPT_TITLE, PROMPT_SOURCE, PROMPT_INSTRUCTIONS = "File to analyze: ", "Source code", "Instructions"
PROMPT_GRAPHS = ("Abstract Syntax Tree (AST)", "Control Flow Graphs (CFG)", "Data Flow Graphs (DFG)")


def prompt_set(
    files: DataFrame, source: Column, ast: Column, cfg: Column, dfg: Column, language: Column,
    instructions: dict[str, str], limit: int = MAX_PROMPT,
) -> DataFrame:
    """One documentation prompt per file from its source and graphs (null graphs read ``N/A``).

    Graph columns are nested values or JSON strings. The model call is the caller's.
    """
    def graph(value: Column) -> Column:
        if files.select(value).schema[0].dataType.simpleString() == "string":
            return truncate_omitted(value, limit)
        return truncate_json(value, limit)

    block = F.lit(None).cast("string")
    for name, text in instructions.items():
        block = F.when(language == name, F.lit(text)).otherwise(block)

    def section(heading: str, fence: Column | str, body: Column) -> list[Column]:
        opened = F.lit(fence) if isinstance(fence, str) else fence
        return [F.lit(f"## {heading}\n\n```"), opened, F.lit("\n"), body, F.lit("\n```\n\n")]

    prompt = F.concat(
        F.lit(f"# {PROMPT_TITLE}"), F.col("path"), F.lit("\n\n"),
        *section(PROMPT_SOURCE, F.coalesce(language, F.lit("")), F.substring(source, 1, limit)),
        *(part for heading, value in zip(PROMPT_GRAPHS, (ast, cfg, dfg)) for part in section(heading, "json", graph(value))),
        F.lit(f"## {PROMPT_INSTRUCTIONS}\n\n"), F.coalesce(block, F.lit("")),
    )
    return files.withColumn("prompt", prompt)
