import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codefacts.llm import byte_bpe, packing, pretokens, token_counts

from . import brute, data

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
with open(MULTI, "rb") as f:
    RANKS = byte_bpe.read_ranks(f.read())
LIBRARY = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = byte_bpe.Encoder(RANKS)
PARTS = ["a", "b", "é", " ", "  ", "\n", " \n", "'s", "'ll", "1", "23", "　", "\x1c", "\xa0", "!", "中文", "the", "ing", "🙂", "\t", "aaaa", "<|endoftext|>"]
TEXT = st.lists(st.sampled_from(PARTS)).map("".join) | st.text(max_size=60)


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_encodes_as_the_library(text):
    ids = ENCODER.encode(text)
    assert unpacked(ids) == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode("utf-8")


def test_very_long_pretoken():
    text = "ab" * 20_000 + "a" * 20_000
    assert unpacked(ENCODER.encode(text)) == LIBRARY.encode_ordinary(text)


def test_queue_is_a_priority_queue():
    rng, queue, held = random.Random(1), byte_bpe.RankQueue(50_000), []
    for _ in range(5_000):
        if held and rng.random() < 0.5:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            entry = (rng.choice([rng.randrange(50_000), 7, 300]), rng.randrange(100))
            queue.push(*entry)
            held.append(entry)
    assert [queue.pop() for _ in held] == sorted(held) and queue.pop() is None


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_units_match_alone(text):
    find = pretokens.splitter(public_tokenizers.PATTERN).findall
    assert "".join(pretokens.units(text)) == text
    assert [p for u in pretokens.units(text) for p in find(u)] == find(text)


def test_memo_forgets_and_stays_right():
    memo = pretokens.Memo(len, 10)
    assert all(memo[str(i)] == len(str(i)) for k in range(3) for i in range(100)) and len(memo) <= 10


def test_bpe_query(spark):
    rows = data.rows()
    out = byte_bpe.encode_and_decode(data.table(spark, rows), MULTI)
    want = Counter((i, len(ids := LIBRARY.encode_ordinary(t or "")), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect()) == want
    assert byte_bpe.encode_and_decode(data.table(spark, []), MULTI).count() == 0


def test_counts_are_greedy(spark):
    rng, vocabulary = random.Random(4), {b"ab", b"abc", b"bcdd", b"cd", b"d", b"abcdx", b"xxxx"}
    automaton = token_counts.Automaton(vocabulary)
    for _ in range(2_000):
        x = bytes(rng.choice(b"abcdxy") for _ in range(rng.randrange(14)))
        assert automaton.count(x) == brute.longest_match(x, vocabulary)
    rows = data.rows()
    find = pretokens.splitter(public_tokenizers.PATTERN).findall
    want = Counter(
        (i, len(find(t or "")), sum(brute.longest_match(p.encode(), RANKS) for p in find(t or "")), len((t or "").encode())) for i, t in rows
    )
    out = token_counts.token_counts(data.table(spark, rows), MULTI)
    assert Counter(tuple(r) for r in out.select("doc_id", "n_pretokens", "n_tokens", "n_bytes").collect()) == want
    assert token_counts.token_counts(data.table(spark, []), MULTI).count() == 0


@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_patterns_hold_every_piece(demand):
    patterns = packing.whole_patterns(demand, 32)
    held = Counter()
    for pattern, times in patterns:
        assert sum(s * c for s, c in pattern.items()) <= 32 and times > 0
        held.update({s: c * times for s, c in pattern.items()})
    assert held == Counter({s: n for s, n in demand.items() if n})
    places, sequences = packing.slots(patterns)
    assert sequences == sum(t for _, t in patterns)


def test_packing_is_tight():
    rng = random.Random(6)
    demand = Counter(min(128, int(rng.lognormvariate(3.5, 0.8)) + 1) for _ in range(20_000))
    used = sum(t for _, t in packing.whole_patterns(demand, 128))
    assert used <= sum(s * n for s, n in demand.items()) / 128 * 1.01 + 1 or used <= sum(t for _, t in packing.column_generation(demand, 128)) + 128


def check_packed(rows, got, length=2048):
    library = Tokenizer.from_file(FILE)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {(i, len(x)) for i, every in ids.items() for x in every}
    for (i, n), pieces in by_doc.items():
        texts = [x for x in ids[i] if len(x) == n]
        want = Counter(p for x in texts for p in cut(x, length))
        assert Counter((p.start, p.length, p.ids_crc32) for p in pieces) == want
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and all(p.padded_length == (at if at & (at - 1) == 0 else length) for p in pieces)


def cut(ids, length):
    return [(s, len(p := ids[s : s + length]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for s in range(0, len(ids), length)]


def test_packing(spark):
    rows = data.rows()
    check_packed(rows, packing.pack(data.table(spark, rows), FILE).collect())
    check_packed(rows, packing.pack(data.table(spark, rows), FILE, length=64).collect(), 64)
    assert packing.pack(data.table(spark, []), FILE).count() == 0


@given(TEXT)
@settings(max_examples=100, deadline=None)
def test_tokens_as_the_library(text):
    tokens, library = _both()
    assert unpacked(tokens.encode(text)) == library.encode(text, add_special_tokens=False).ids


def _both(made=[]):
    if not made:
        with open(FILE, encoding="utf-8") as f:
            made += [packing.Tokens(f.read()), Tokenizer.from_file(FILE)]
    return made
