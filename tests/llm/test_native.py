"""Secret scans and quality rules: DataFrame functions against plain versions."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codefacts.llm import quality_rules, secret_scan

from . import brute, data


def test_base_spans(spark):
    rng = random.Random(8)
    rows = data.rows()
    parts = ["token", "API_key", "=", ": ", ":", '"', "'", " ", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "x", "."]
    rows += [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(300)]
    base = F.filter("__spans", lambda s: s["kind"] < 3)
    out = secret_scan.scan(data.table(spark, rows)).select("doc_id", secret_scan.shown(base).alias("spans"))
    assert Counter(tuple(r) for r in out.collect()) == Counter((i, brute.base_spans(t)) for i, t in rows)


PARTS = re.compile("~+|example|sample|placeholder|changeme|dummy|redacted|([a-z0-9+/_=-])\\1{5,}|0123456|1234567|abcdefg", re.I)
UUID = re.compile("(?<![0-9a-f])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])", re.I)


def entropy_spans(text):
    """Entropy spans of a text that is one candidate."""
    spans, at = [], 0
    masked = UUID.sub("~" * 36, text)
    for gap in [*PARTS.finditer(masked), None]:
        piece = masked[at : gap.start() if gap else len(text)]
        if len(piece) >= 16 and re.search("[0-9]", piece) and re.search("[A-Za-z]", piece):
            kind = next(c for c in secret_scan.CLASSES if set(piece) <= set(c.alphabet))
            w = min(kind.window, len(piece))
            hits = []
            for i in range(len(piece) - w + 1):
                bits = -sum(c / w * math.log2(c / w) for c in Counter(piece[i : i + w]).values())
                if bits > kind.more * math.log2(w) / math.log2(kind.window):
                    hits.append(i)
            spans += [(at + hits[0], at + hits[-1] + w)] if hits else []
        at = gap.end() if gap else at
    return spans


def checked(spark, texts):
    """Entropy spans of the operator, each text's held against the plain ones."""
    out = secret_scan.scan(data.table(spark, list(enumerate(texts)))).select("doc_id", "__spans").collect()
    all_found = []
    for r in out:
        inside = [(s["start"], s["end"]) for s in r["__spans"] if s["kind"] < 3]
        found = [(s["start"], s["end"]) for s in r["__spans"] if s["kind"] == 3]
        want = entropy_spans(texts[r.doc_id])
        assert found == [(a, b) for a, b in want if not any(x <= a and y >= b for x, y in inside)], texts[r.doc_id]
        all_found += found
    return all_found


def candidates(rng, n, least, most):
    letters = secret_scan.CLASSES[2].alphabet
    texts = ["".join(rng.choice(letters[: rng.choice([4, 10, 30, 62, 67])]) for _ in range(rng.randrange(least, most))) for _ in range(n)]
    return [t for t in texts if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]


def test_sliding_entropy(spark):
    found = checked(spark, candidates(random.Random(9), 300, 16, 60))
    assert any(b - a < 20 for a, b in found) and any(b - a > 40 for a, b in found)


def test_long_candidates_cross_blocks(spark):
    rng = random.Random(14)
    quiet = ["ab1" * n + "".join(rng.sample(secret_scan.CLASSES[1].alphabet, 30)) + "ab1" * m for n in (160, 170, 171, 341) for m in (0, 50, 400)]
    found = checked(spark, quiet + candidates(rng, 20, 500, 1700))
    assert sum(b - a < 80 for a, b in found) >= len(quiet)


def test_very_long_candidate(spark):
    rng = random.Random(15)
    text = "".join(rng.choice(secret_scan.CLASSES[2].alphabet[:62]) for _ in range(200_000))
    start = time.time()
    (a, b), *_ = checked(spark, ["x1" * 100_000 + "/" + text[:100_000]])
    assert 200_000 - 24 < a <= 200_001 and b > 290_000 and time.time() - start < 60


def test_allow_list_and_redaction(spark):
    rows = [
        (1, "id 123e4567-e89b-12d3-a456-426614174000 end"), (2, "EXAMPLEzq8XV2mk9PL4tr7WY1nb5CD3fg end"),
        (3, "a Zq8xV2mK9pL4tR7wY1nB5cD3fG6hJ0sA b é token=abcdefghijkl0 c"), (4, None), (5, ""),
        (6, "id 12345678-e89b-12d3-a456-426614174000-123e4567-e89b-12d3-a456-426614174000 end"), (7, "sample_0123456789abcde_dummy"),
    ]
    df = secret_scan.scan(data.table(spark, rows))
    out = {r.doc_id: (r.spans, r.out) for r in df.select(
        "doc_id", secret_scan.shown(F.col("__spans")).alias("spans"), secret_scan.redacted(F.col("text"), F.col("__spans")).alias("out")
    ).collect()}
    assert out[1][0] == out[6][0] == out[7][0] == "" and out[4] == ("", None) and out[5] == ("", "")
    # an entry of the allow-list is no secret, what stands beside it may be one
    assert out[2] == ("entropy:7:33", "EXAMPLE[SECRET] end")
    assert out[3][1] == "a [SECRET] b é [SECRET] c"
    assert secret_scan.scan(data.table(spark, [])).count() == 0


def test_short_and_joined_secrets(spark):
    rng = random.Random(12)
    uuid = "123e4567-E89b-12d3-a456-426614174000"
    short = candidates(rng, 200, 16, 30)
    joints = ["======", "AAAAAAAAA", "1234567", "Example", "--------", uuid, f"-{uuid}-{uuid}_", f"{uuid}/"]
    found = checked(spark, short + [a + rng.choice(joints) + b for a, b in zip(short, short[1:])])
    assert sum(b - a < 20 for a, b in found) > 20


def test_sql_says_the_same(spark):
    import duckdb

    from codefacts.llm import queries

    rng = random.Random(16)
    parts = ["======", "AAAAAAAAA", "1234567", "Example", "-", "_", "é", " ", "\n", "token=", "123e4567-e89b-12d3-a456-426614174000", "deadbeef01", "ſK"]
    near = candidates(rng, 60, 3, 40)
    rows = [(i, "".join(rng.choice(parts + near) for _ in range(rng.randrange(12)))) for i in range(400)] + [(1000, None)]
    out = secret_scan.scan(data.table(spark, rows)).select("doc_id", secret_scan.shown(F.col("__spans")).alias("spans"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(f"SELECT doc_id, spans FROM ({queries.SECRETS_SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and sum("entropy" in s for _, s in want) > 50


def test_pipeline_redacts_short_and_joined_secrets(spark):
    from codefacts.llm import pipeline

    key = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZWQyNTUxOQAAACBq7Zr2xWv9Kp4LtYc8Uo1Ns3GhJd5Fe6Mi0Rb"
    rows = [
        (1, "a Zq8xV2mK9pL4tR7w b"), (2, "a Zq8xV2mK/pL4tR7wY+1n b"), (3, f"a {key} b"), (4, "a Zq8xV2mK9pL4tR7wY1nB5cD3====== b"),
        (5, "id 123e4567-e89b-12d3-a456-426614174000 end"), (6, "my_example_placeholder_1 b"), (7, "a 123e4567-e89b-12d3-a456-426614174000/Zq8xV2mK9pL4tR7w b"),
    ]
    out = {r.doc_id: r.text for r in pipeline.secrets(spark, data.table(spark, rows), "").collect()}
    assert out[1] == out[2] == "a [SECRET] b" and out[4] == "a [SECRET]====== b"
    assert "AAAACBq7Zr2xWv9Kp4LtYc8Uo1Ns3GhJd5Fe6Mi0Rb"[6:] not in out[3] and "b3BlbnNzaC1rZXktdjE" not in out[3]
    assert out[5] == rows[4][1] and out[6] == rows[5][1] and "Zq8x" not in out[7]


def test_statistics(spark):
    rng = random.Random(10)
    rows = data.rows() + [(200 + i, "\n".join(" ".join(data.words(rng, rng.randrange(9), 3)) for _ in range(rng.randrange(12)))) for i in range(150)]
    out = quality_rules.judged(data.table(spark, rows), []).select(
        "doc_id", *(f"__stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "__verdict.base_failed", "__verdict.kept",
    ).collect()
    assert Counter(tuple(r)[:7] for r in out) == Counter((i, *brute.statistics(t)) for i, t in rows)
    assert all(r.kept is not r.base_failed for r in out)
    assert quality_rules.judged(data.table(spark, []), []).count() == 0


def test_learning_finds_planted_rules():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 5] <= 0.4))
    rules = quality_rules.learn(x[:2000], bad[:2000])
    hit = np.any([quality_rules.covered(r, x[2000:]) for r in rules], axis=0)
    assert (hit == bad[2000:]).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(len(x), bool)) == [] and quality_rules.learn(x[:0], bad[:0]) == []


def test_list_is_ordered_case(spark):
    rng = random.Random(11)
    good = [(i, " ".join(data.words(rng, 80, 3000))) for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###" for w in data.words(rng, 80, 3000))) for i in range(60)]
    docs = data.table(spark, good + junk)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(None, 1), (7, None), (99999, 0)], "doc_id long, quality int")
    rules = quality_rules.learn_from(docs, labels)
    out = {r.doc_id: r.kept for r in quality_rules.judged(docs, rules).select("doc_id", "__verdict.kept").collect()}
    assert all(out[i] for i, _ in good) and not any(out[i] for i, _ in junk)
    assert quality_rules.learn_from(docs, labels.limit(0)) == []
