"""Links between users and repositories, ownership, and upkeep of the tables that hang off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import icontains


def list_repos(links: DataFrame, repos: DataFrame, user_id: object | None = None, query: str | None = None) -> DataFrame:
    """Repositories of a user with the link's own name. Order the result by ``linked_at`` descending to show it."""
    mine = links.filter(icontains(F.col("name"), query))
    if user_id is not None:
        mine = mine.filter(F.col("user_id") == user_id)
    return mine.join(repos, "repo_id")


def repo_detail(repos: DataFrame, meta: DataFrame) -> DataFrame:
    """Repositories with their optional meta row."""
    return repos.join(meta, "repo_id", "left")


def scoped(df: DataFrame, user_id: object | None = None, repo_id: object | None = None) -> DataFrame:
    """Rows of one owner; both tests are plain equalities that reach the scan."""
    for name, value in (("user_id", user_id), ("repo_id", repo_id)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def owned(df: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    """Rows for which a link exists."""
    return df.join(links.select(*on), on, "left_semi")


def plan_joins(requests: DataFrame, links: DataFrame, repos: DataFrame) -> DataFrame:
    """Decide requests ``(user_id, repo_id)`` to join an existing repository.

    Already linked is a conflict; no link at all, or no user left, is not found; otherwise joined, with the name
    copied from the first link. The conflict is tested first.
    """
    mine = links.select("user_id", "repo_id").distinct().withColumn("_mine", F.lit(True))
    names = links.groupBy("repo_id").agg(F.min_by("name", F.struct("linked_at", "name")).alias("_name"))
    decided = requests.join(mine, ["user_id", "repo_id"], "left").join(names, "repo_id", "left").join(
        repos.select("repo_id", "user_count"), "repo_id", "left"
    )
    decision = (
        F.when(F.col("_mine").isNotNull(), "conflict")
        .when(F.col("_name").isNull() | (F.coalesce("user_count", F.lit(0)) <= 0), "not_found")
        .otherwise("joined")
    )
    joined = decision == "joined"
    return decided.select(
        "user_id", "repo_id", decision.alias("decision"),
        F.when(joined, F.col("_name")).alias("name"),
        F.when(joined, F.col("user_count") + 1).otherwise(F.col("user_count")).alias("user_count"),
    )


def unlink(requests: DataFrame, links: DataFrame, children: dict[str, DataFrame], repos: DataFrame) -> dict[str, DataFrame]:
    """New contents of every table after the requested links are gone: children first, then links, then counts."""
    pair = ["user_id", "repo_id"]
    gone = requests.select(*pair).distinct()
    kept = {name: table.join(gone, pair, "left_anti") for name, table in children.items()}
    removed = links.join(gone, pair, "left_semi").groupBy("repo_id").agg(F.count("*").alias("_gone"))
    rest = [c for c in repos.columns if c not in ("repo_id", "user_count")]
    kept["links"] = links.join(gone, pair, "left_anti")
    kept["repos"] = repos.join(removed, "repo_id", "left").select(
        "repo_id", *rest, (F.col("user_count") - F.coalesce("_gone", F.lit(0))).alias("user_count")
    )
    return kept


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Child rows without a parent."""
    return children.join(parents.select(*on), on, "left_anti")


def unused_repos(repos: DataFrame) -> DataFrame:
    return repos.filter(F.col("user_count") <= 0)


def patch(df: DataFrame, patches: DataFrame, on: str, nullable: list[str], required: list[str]) -> DataFrame:
    """Apply partial updates ``(key, supplied array<string>, values…)``.

    Only supplied columns change. A null clears a nullable column and is ignored for a required one.
    """
    columns = [*nullable, *required]
    renamed = patches.select(on, F.col("supplied").alias("_s"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(renamed, on, "left")

    def value(name: str) -> Column:
        given = F.coalesce(F.array_contains("_s", name), F.lit(False))
        if name in required:
            given = given & F.col(f"_{name}").isNotNull()
        return F.when(given, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in df.columns])
