import math
import random
from collections import Counter

from pyspark.sql import functions as F

from codefacts.operators import keyword_index, retrieval

from .conftest import rows


def test_knn_in_blocks_equals_brute_force(spark):
    rng = random.Random(4)
    data = [(i, "hot" if i % 3 else "cold", [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    data += [(200 + i, "hot", data[1][2]) for i in range(4)] + [(300, "hot", [0.0] * 8)]
    asked = [(900 + i, g, [rng.gauss(0, 1) for _ in range(8)]) for i, g in enumerate(["hot"] * 7 + ["cold", "none"])]

    def cosine(a, b):
        n = math.dist(a, [0] * 8) * math.dist(b, [0] * 8)
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    want = []
    for q, g, v in asked:
        best = sorted(((-cosine(v, w), i) for i, h, w in data if h == g))[:5]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    queries = spark.createDataFrame(asked, "query_id long, repo_id string, vector array<float>")
    vectors = spark.createDataFrame(data, "id long, repo_id string, vector array<float>")
    for sizes in ((8192, 1024), (10, 2)):
        got = rows(retrieval.knn(queries, vectors, block_rows=sizes[0], query_rows=sizes[1]), "query_id", "id", "rank")
        assert got == sorted([(q, i, r) for q, i, _, r in want], key=repr)


def test_questions_grow_with_the_table_and_ask_all_of_it(spark):
    import numpy as np

    from codefacts.plans.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, unit = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        scores = np.round(unit @ unit[i], 6)
        want += [(int(ids[i]), int(ids[j]), n + 1) for n, j in enumerate(np.lexsort((ids, -scores))[:5])]
    assert rows(QUERIES["vector_neighbours"](spark, folder), "query_id", "id", "rank") == sorted(want, key=repr)


def test_keyword_search_equals_the_formula(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice("ab"), " ".join(rng.choice("red blue, Green! x1 y z".split()) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    asked = [(1, "a", "Green red red"), (2, "b", "z q"), (3, "a", "none")]
    words = lambda t: ["".join(c for c in w if c.isalnum()) for w in t.lower().split()]
    want = []
    for q, g, text in asked:
        own = [(i, words(t)) for i, h, t in docs if h == g and t]
        avg = sum(len(w) for _, w in own) / len(own)
        scores = Counter()
        for term in set(words(text)):
            df = sum(term in w for _, w in own)
            for i, w in own:
                if term in w:
                    tf = w.count(term)
                    scores[i] += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        want += [(q, i, r + 1) for r, (s, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:5])]
    got = keyword_index.keyword_search(spark.createDataFrame(asked, "query_id int, repo_id string, query string"), spark.createDataFrame(docs, "id int, repo_id string, text string"))
    assert rows(got, "query_id", "id", "rank") == sorted(want, key=repr)


def test_chunks_cover_the_text(spark):
    texts = {n: " ".join(f"w{i}" for i in range(n)) for n in (0, 1, 50, 449, 450, 499, 500, 501, 950, 951, 2000)}
    docs = spark.createDataFrame([("r", n, f"p{n}", t) for n, t in texts.items()], "repo_id string, file_id int, path string, content string")
    found = {}
    for r in retrieval.chunk(docs).orderBy("file_id", "chunk_index").collect():
        found.setdefault(r.file_id, []).append(r.text.split(" "))
    assert 0 not in found and len(found[500]) == 1 and len(found[501]) == 2 and len(found[950]) == 2 and len(found[951]) == 3
    for n, parts in found.items():
        rebuilt = parts[0] + [w for p in parts[1:] for w in p[50:]]
        assert rebuilt == texts[n].split(" ") and all(len(p) <= 500 for p in parts)
    header = retrieval.with_header(retrieval.chunk(docs.filter("file_id = 1"))).first()
    assert header.content == "Documentation of the file: p1\n\nw0" and header.chunk_index == 0


def test_fusion_and_rendering(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    assert rows(retrieval.hybrid(a, b), "id", "rank") == [(10, 2), (11, 1), (12, 3)]
    hits = spark.createDataFrame([(1, 2, None, "two"), (1, 1, "p", "one")], "query_id int, rank int, path string, content string")
    assert retrieval.render_hits(hits).first().rendered == "### p\none\n\n---\n\n### unknown\ntwo"


def test_embedding_function(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "content string")
    got = retrieval.embed(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("content")
    assert [r.embedding for r in got.collect()] == [[2.0, 1.0], [1.0, 1.0]]
    assert got.filter(F.size("embedding") != 2).count() == 0


def chunked(text, size, overlap):
    """The same chunks, one piece at a time."""
    pieces = [text]
    for separator in ("\n\n", "\n", " "):
        cut = []
        for p in pieces:
            parts = p.split(separator) if len(p) > size else [p]
            cut += [x + separator for x in parts[:-1]] + parts[-1:]
        pieces = cut
    pieces = [p[i : i + size] for p in pieces for i in range(0, len(p), size)]
    out, run = [], []
    for p in pieces:
        if run and sum(map(len, run)) + len(p) > size:
            out.append("".join(run))
            kept = []
            for x in reversed(run):
                if len(x) + sum(map(len, kept)) > min(overlap, size - len(p)):
                    break
                kept.insert(0, x)
            run = kept
        run.append(p)
    out.append("".join(run))
    return [t for t in (x.strip(" \n") for x in out) if t]


def test_chunks_by_separator(spark):
    rng = random.Random(31)
    texts = ["", " ", "one", "x" * 200, "a\n\n\n\nb", None]
    texts += ["".join(rng.choice(["loaf", "rye bread", " ", " ", "\n", "\n\n", "crumb" * 9, "é"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame([("r", i, "p", t) for i, t in enumerate(texts)], "repo_id string, file_id int, path string, content string")
    got = {}
    for r in retrieval.chunk_by_separator(df, 40, 12).orderBy("file_id", "chunk_index").collect():
        got.setdefault(r.file_id, []).append(r.text)
        assert len(r.text) <= 40
    for i, t in enumerate(texts):
        assert got.get(i, []) == chunked(t or "", 40, 12), repr(t)


def test_keyword_index_in_cells_equals_the_formula(spark, monkeypatch):
    """Small cells, so bounds decide which are opened; ties, a hot term in every chunk, empty and null texts, odd groups."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, "abc"[i % 3], "hot " + " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randrange(30)))) for i in range(400)]
    docs += [(500, "a", ""), (501, "a", None), (502, None, "w1 hot"), (503, "d", "!?")] + [(600 + i, "a", "w7 w7 hot") for i in range(9)]
    asked = [(i, "abcd"[i % 4], " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)) + ["hot"] * (i % 2))) for i in range(40)] + [(99, "a", "w7")]
    want = []
    for q, g, text in asked:
        own = [(i, t.split()) for i, h, t in docs if h == g and t and any(c.isalnum() for c in t)]
        avg = sum(len(w) for _, w in own) / max(1, len(own))
        scores = Counter()
        for term in sorted(set(text.split())):
            df = sum(term in w for _, w in own)
            for i, w in own:
                if term in w:
                    tf = w.count(term)
                    scores[i] += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        want += [(q, i, r + 1) for r, (s, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:5])]
    queries = spark.createDataFrame(asked, "query_id int, repo_id string, query string")
    chunks = spark.createDataFrame(docs, "id int, repo_id string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = rows(keyword_index.keyword_search(queries, chunks, query_rows=7), "query_id", "id", "rank")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want, key=repr)
