"""Spelling variants, whitening and mixing against plain versions."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from codefacts.llm.common import prepare
from codefacts.llm.fm_index import Vocabulary
from codefacts.llm.mixing import mix
from codefacts.llm.queries import op11, op12, op13
from codefacts.llm.spelling import near_words, spelling_groups, variants, word_counts
from codefacts.llm.whitening import whiten

from .data import rows, table

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(data, shortest=6, rarest=5):
    seen = Counter()
    for i, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= rarest}


def plain_variants(n):
    """By deleting each letter in turn: words one edit apart share what is left, or one is it."""
    left = {}
    for w in n:
        for i in range(len(w)):
            left.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for rest, group in left.items():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
            if rest in n:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("letters", ["ab", "abé"])
@pytest.mark.parametrize("side", ["left", "right"])
def test_index_finds_what_comparison_finds(letters, side):
    rng = np.random.default_rng(len(letters))
    make = lambda n, some: sorted({"".join(rng.choice(list(some), rng.integers(3, 9))) for _ in range(n)})
    for size in (1, 5, 80):
        words, asked = make(size, letters), make(60, letters + "z")
        got = {(asked[q], words[w]) for q, w in zip(*Vocabulary(words).near(asked, side), strict=True)}
        same = lambda a, b: b.startswith(a[: len(a) // 2]) if side == "left" else b.endswith(a[len(a) // 2 :])
        assert got == {(a, b) for a in asked for b in words if one_edit(a, b) and same(a, b)}


def test_spelling_on_given_documents(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op11(prepare(spark), SMALL).collect()} == plain_variants(plain_counts(data))


def test_spelling_edge_cases(spark):
    data = rows() * 5 + [(None, "Straße straße STRAßE strase ÀÉÎÕÜ× " * 5), (7, "x" * 4000 + " " + "x" * 3999)] * 6
    assert {tuple(r) for r in spelling_groups(table(spark, data)).collect()} == plain_variants(plain_counts(data))
    assert spelling_groups(table(spark, [])).collect() == []
    assert word_counts(table(spark, [(1, None), (2, "")])).collect() == []


def test_spelling_with_a_hot_half_over_many_blocks(spark):
    """A third of the words share their first letters; blocks of 40 words, so their queries go to many blocks and slices."""
    rng = np.random.default_rng(5)
    words = {"prefix" + "".join(rng.choice(list("abc"), 5)) for _ in range(150)}
    words |= {"".join(rng.choice(list("abcd"), rng.integers(6, 9))) for _ in range(300)}
    n = {w: int(rng.choice([5, 30, 200, 1200])) for w in words}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(r) for r in variants(vocabulary, block=40).collect()} == plain_variants(n)
    assert near_words(vocabulary.limit(0)).collect() == []


def plain_whitening(vectors, k=4):
    """Exact covariances by products of fractions."""
    fine = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in fine]
    fit = sorted({v for _, v in x})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dim)]
    y = [[n * v[d] - sums[d] for d in range(dim)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(dim)] for a in range(dim)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * v[d] - sums[d]) ** 2 for d in range(dim)) for _, v in x]
    white = (np.array([v for _, v in x]) - np.array(sums) / n) @ u / np.sqrt(e)
    return [i for i, _ in x], n, deviation, white, e / np.trace(cov)


def same_whitening(got, want):
    ids, n, deviation, white, explained = want
    k = len(explained)
    got = sorted(got, key=lambda r: (repr(r[0]), r.deviation, r.component))
    order = sorted(range(len(ids)), key=lambda j: (repr(ids[j]), deviation[j]))
    wanted = [(ids[j], c + 1, n, deviation[j]) for j in order for c in range(k)]
    assert [(r[0], r.component, r.n, r.deviation) for r in got] == sorted(wanted, key=lambda w: (repr(w[0]), w[3], w[1]))
    got = [r for c in range(k) for r in got if r.component == c + 1]  # rows of one id and deviation are copies
    shown = np.array([r.whitened for r in got]).reshape(k, -1).T
    sign = np.sign((shown * white[order]).sum(axis=0))
    np.testing.assert_allclose(shown * sign, white[order], atol=1e-7)
    np.testing.assert_allclose([r.explained for r in got[:: len(ids)]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_on_given_vectors(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same_whitening(op12(spark, SMALL).collect(), plain_whitening(vectors))


def vector_table(spark, data):
    return spark.createDataFrame([(i, v, 1, "n", "c") for i, v in data], "vec_id long, embedding array<float>, n int, id string, component string")


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(60)]
    bad = [(70, None), (71, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (72, [float("nan")] * 6), (73, [float("inf")] * 6), (74, [3e38] * 6)]
    data = good + [(None, good[0][1])] * 2 + [(80, good[1][1])] * 50 + [(81, [-0.0] * 6)]
    got = whiten(vector_table(spark, data + bad + [(75, [1.0, 2.0]), (76, [])])).collect()
    same_whitening(got, plain_whitening(data))
    assert whiten(vector_table(spark, bad)).collect() == []
    few = whiten(vector_table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()  # one direction varies
    assert [(r.component, r.whitened is None) for r in few] == [(1, False), (2, True)] * 3
    alone = whiten(vector_table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in alone] == [(1, None, None, None, 0)] * 2


def test_whitening_of_numbers_beyond_longs(spark):
    rng = np.random.default_rng(3)
    for scale in (2.0**20, 2.0**40, 2.0**52):
        data = [(i, [float(np.float32(c * scale)) for c in rng.normal(size=3)]) for i in range(9)]
        ids, n, deviation, white, explained = plain_whitening(data)
        got = sorted(whiten(vector_table(spark, data), k=3).collect(), key=lambda r: (r.vec_id, r.component))
        assert [r.deviation for r in got] == [d if d < 10**38 else None for d in deviation for _ in range(3)]
        np.testing.assert_allclose(np.abs([r.whitened for r in got]), np.abs(white).ravel(), rtol=1e-6)


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = budget - sum(2 * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: float(share[s]) if s in share else 2.0 * sizes[s] for s in names}
        capped |= over


def check_mix(got, data, near):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    totals = Counter()
    for i, _, s in data:
        totals[s] += sizes[i]
    want, taken, source = plain_targets(totals), Counter(), {i: s for i, _, s in data}
    assert sorted(r.doc_id for r in got) == sorted(sizes)
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (sizes[r.doc_id], totals[s])
        assert r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near(s, t), (s, t, taken[s])


def test_mix_of_given_documents(spark):
    for folder, share in ((SMALL, 0.4), ("/root/testdata/sf0.01", 0.01)):  # ten documents a source, and fifty
        data = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
        check_mix(op13(spark, folder).collect(), data, lambda s, t, share=share: share * t)


def test_mix_of_one_hot_source_and_few_words(spark):
    rng = np.random.default_rng(4)
    data = [(i, "w " * int(rng.integers(1, 200)), "hot") for i in range(900)] + [(1000, "long " * 9000, "hot")]
    data += [(2000 + i, "w " * int(rng.integers(1, 40)), f"s{i % 7}") for i in range(300)]
    data += [(3000, None, "empty"), (3001, "", "empty"), (3002, "one two", None), (3003, "x", "\U0001f600"), (3004, "y", "ÿ")]
    df = spark.createDataFrame([(*r, 5, "k", 7) for r in data], "doc_id long, text string, source string, size int, key string, h long")
    got = mix(df, bits=3).collect()
    check_mix(got, data, lambda s, t: max(2, 0.002 * t))
    again = mix(df.repartition(7), bits=9).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_repeated_rows_and_null_ids(spark):
    data = [(None, "a b c", "s"), (None, "a b c", "s"), (None, None, None), (1, "d e", "s"), (1, "d e", "t"), (2, "f", "t")]
    got = mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert len(got) == 6 and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
