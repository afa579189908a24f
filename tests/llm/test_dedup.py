import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codefacts.llm import common, exact_dedup, jaccard_join, line_dedup, substring_dedup
from codefacts.llm.common import Words

from . import brute, data


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def rows():
    return data.rows()


@pytest.mark.parametrize("group", [512, 3])
def test_substring(spark, rows, group):
    out = substring_dedup.remove_repeats(data.table(spark, rows), group=group)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_text") == Counter(brute.remove_repeats(rows, 35))


def test_substring_short_window(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(data.words(rng, rng.randrange(60), 4))) for i in range(60)]
    out = substring_dedup.remove_repeats(data.table(spark, rows), window=6, prefix=3, group=20)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_text") == Counter(brute.remove_repeats(rows, 6))


def test_deep_nodes():
    assert substring_dedup.deep_nodes([b"a b c d", b"x b c", b"b c"], 2) == [(1, 1), (0, 1), (2, 0)] or \
        set(substring_dedup.deep_nodes([b"a b c d", b"x b c", b"b c"], 2)) == {(0, 1), (1, 1), (2, 0)}
    assert substring_dedup.maximal([5, 1, 2, 9, 6]) == [(1, 2), (5, 2), (9, 1)]


def test_lines(spark, rows):
    out = line_dedup.drop_repeated_lines(data.table(spark, rows))
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_text") == Counter(brute.line_dedup(rows))


def test_many_owners_and_full_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_OWNER", 3)
    monkeypatch.setattr(common, "FILTER_BYTES", 8)
    test_lines(spark, rows)
    test_exact(spark, rows)


def test_bloom_loses_nothing():
    rng = np.random.default_rng(1)
    bloom, inside = line_dedup.Bloom(1000), rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    bloom.add(inside)
    assert bloom.has(inside).all()
    assert bloom.has(rng.integers(0, 1 << 63, 10_000).astype(np.uint64)).mean() < 0.02


def test_exact(spark, rows):
    out = exact_dedup.equal_groups(data.table(spark, rows))
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == Counter(brute.exact_groups(rows))
    kept = out.filter("kept").collect()
    assert len(kept) == len({t for *_, t in brute.exact_groups(rows)})
    assert all(r.doc_id == r.keep_id for r in kept)


@given(st.binary(max_size=40_000) | st.integers(0, 300_000).map(lambda n: b"ab" * n))
@settings(max_examples=30, deadline=None)
def test_chunks_are_the_text(text):
    parts = exact_dedup.cut(text)
    assert b"".join(parts) == text
    assert all(len(p) <= exact_dedup.MOST for p in parts) and all(len(p) >= exact_dedup.LEAST for p in parts[:-1])


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard(spark, rows, block):
    out = jaccard_join.near_groups(data.table(spark, rows), block=block)
    assert got(out, "doc_id", "class_id", "n_links") == Counter(brute.near_classes(rows))
    classes = {r.class_id for r in out.collect()}
    assert {r.doc_id for r in out.filter("kept").collect()} == classes


def test_pruning_keeps_what_may_reach():
    needed = jaccard_join.least_matches(0.8)
    assert [n for n, _ in needed] == [32, 64, 96, 128]
    for n, m in needed:  # a pair at the threshold is pruned once in a million at most
        from math import comb
        assert sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m)) < 1e-5


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    found = jaccard_join.shared_counts(sets, 7)
    assert all(found[i, j] == want[i][j] for i in range(9) for j in range(9) if i != j)


@pytest.mark.parametrize("function", [
    substring_dedup.remove_repeats, line_dedup.drop_repeated_lines, exact_dedup.equal_groups, jaccard_join.near_groups,
])
def test_empty_table(spark, function):
    assert function(data.table(spark, [])).count() == 0


def test_words_as_bytes():
    texts = ["a  b\x0bc", "", " ", "é ü x", "\x1c\x00 y"]
    found = Words([t.encode() for t in texts])
    parts = [found.data[s:e].decode() for s, e in zip(found.starts, found.ends)]
    assert parts == [w for t in texts for w in brute.WORD.findall(t)]
    assert found.counts.tolist() == [len(brute.WORD.findall(t)) for t in texts]
    hashes = Words([b"x yy x", b"yy"]).hashes()
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[0] != hashes[1]
