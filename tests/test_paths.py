import fnmatch
import posixpath
import random
import re

from pyspark.sql import functions as F

from codefacts.functions import paths

AWKWARD = ["a/b.java", "A/B.JAVA", "a/.bashrc", "Makefile", "...a", "a.b/c", "a.tar.gz", "x.", ".x.y", "a/..b.c", "..", ".", "a..b", "a/b.", "é.Ü", "a/...", "x/.y.z.", "-.-"]


def test_extension_equals_splitext(spark):
    df = spark.createDataFrame([(p,) for p in AWKWARD], "path string")
    got = {r.path: r.e for r in df.select("path", paths.extension(F.col("path")).alias("e")).collect()}
    assert got == {p: posixpath.splitext(p)[1].lower() or "(none)" for p in AWKWARD}
    assert got["a/b.java"] == ".java" and got["a/.bashrc"] == "(none)" and got["x."] == "." and got["a.tar.gz"] == ".gz"


def globbed(pattern, path):
    """A plain matcher: ** (with the slash after it) is anything, * and ? stay in one name, all else is itself."""
    if not pattern:
        return not path
    if pattern.startswith("**"):
        rest = pattern[3:] if pattern.startswith("**/") else pattern[2:]
        return any(globbed(rest, path[i:]) for i in range(len(path) + 1))
    if pattern[0] == "*":
        stop = path.find("/") if "/" in path else len(path)
        return any(globbed(pattern[1:], path[i:]) for i in range(stop + 1))
    return bool(path) and (path[0] == pattern[0] or pattern[0] == "?" and path[0] != "/") and globbed(pattern[1:], path[1:])


def test_glob_equals_plain_matcher():
    rng = random.Random(17)
    for _ in range(4_000):
        pattern = "".join(rng.choice(["**/", "*", "?", "k", "m", "/", ".", "+", "(", "|", "$"]) for _ in range(rng.randrange(6)))
        path = "".join(rng.choice("km/.+(|$") for _ in range(rng.randrange(6)))
        assert bool(re.match(paths.glob_regex(pattern), path, re.S)) == globbed(pattern, path), (pattern, path)


def test_shell_match_equals_fnmatch(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("ab.[]!-^") for _ in range(rng.randint(0, 5))) for _ in range(200)]
    patterns = ["*", "a*", "?b", "[ab]*", "[!a]*", "*.b", "a[", "[]a]", "[^a]", "[a-b]?", "*[!.]", "", "a.b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", *[F.col("n").rlike(paths.fnmatch_regex(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for row in got:
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == fnmatch.fnmatchcase(row.n, p), (row.n, p)


def test_small_path_functions(spark):
    df = spark.createDataFrame([("user/1/2/src/z/a/b.java",), ("x",)], "p string")
    got = df.select(paths.relative_path(F.col("p")).alias("r"), paths.ancestors(F.col("p")).alias("a"),
                    paths.detect_language(F.col("p")).alias("l")).collect()
    assert got[0].r == "a/b.java" and got[0].a[:2] == ["user", "user/1"] and got[0].l == "java"
    assert got[1].r == "" and got[1].a == [] and got[1].l is None
    upper = spark.createDataFrame([("A/B.JAVA",)], "p string").select(paths.detect_language(F.col("p"))).first()[0]
    assert upper is None
    assert paths.literal_prefix("src/**/*.py") == "src/" and paths.literal_prefix("*") == ""
