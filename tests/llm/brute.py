"""Plain versions of what the operators compute, over lists of (id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(i):
    return -(1 << 63) if i is None else i


def remove_repeats(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (id_, _), w in zip(rows, words):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((id_, len(w), len(gone), " ".join(kept)))
    return out


def line_dedup(rows, least=10):
    def key(line):
        return line.strip(SPACES).translate(LOWER)

    held = defaultdict(set)
    for id_, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(low(id_))
    out = []
    for id_, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(held[key(x)]) > 1 and low(id_) > min(held[key(x)]))]
        out.append((id_, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def exact_groups(rows):
    groups = defaultdict(list)
    for id_, t in rows:
        groups[(t or "").translate(LOWER)].append(low(id_))
    out = []
    for id_, t in rows:
        g = groups[(t or "").translate(LOWER)]
        keep = max(g)
        out.append((id_, None if keep == low(None) else keep, len(g), sha((t or "").translate(LOWER))))
    return out


def shingles(text, k=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_classes(rows, k=5):
    """(id, smallest id of the class, number of links), by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            both = len(sets[a] & sets[b])
            if a != b and sets[a] and sets[b] and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                old, new = label[b], label[a]
                label = [new if x == old else x for x in label]
    least = {x: min(low(rows[i][0]) for i in range(len(rows)) if label[i] == x) for x in set(label)}
    return [(rows[i][0], None if least[label[i]] == low(None) else least[label[i]], links[i]) for i in range(len(rows))]


BASE = (
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(found))


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
        len(w) < 50 or 100 * len(again) > 50 * len(w),
    )


def longest_match(data, vocabulary, most=40):
    n, i = 0, 0
    while i < len(data):
        i += next((k for k in range(min(most, len(data) - i), 0, -1) if data[i : i + k] in vocabulary), 1)
        n += 1
    return n
