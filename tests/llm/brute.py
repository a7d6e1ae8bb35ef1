"""The same results by plain loops."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def token_stream(rows, encode):
    """(doc_id, start, n_tokens, crc) in ascending order of the id, nulls first, then of the ids."""
    coded = [(r[0], encode(r[1] or "") + [2]) for r in rows]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, packed(x[1])))
    out, at = [], 0
    for doc_id, ids in coded:
        out.append((doc_id, at, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
    return out


def base_spans(text):
    """kind:start:end of the contract's three patterns."""
    text = text or ""
    found = []
    for m in re.finditer(ASSIGN, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def live_spans(rows, owner, repository):
    """Per row the (start, end, value) that few hold and that looks live; ``owner`` and ``repository`` are of a row."""
    held, per_row = {}, []
    for r in rows:
        text = r[1] or ""
        found = [(m.start(2), m.end(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        per_row.append(found)
        for _, _, v in found:
            owners, repositories = held.setdefault(v, (set(), set()))
            owners.add(owner(r) or "")
            repositories.add(repository(r) or "")

    def live(v):
        few = len(held[v][0]) <= 2 and len(held[v][1]) <= 4
        mixed = re.search("[A-Za-z]", v) and re.search("[0-9]", v)
        return few and (len(set(v)) >= 8 or mixed and 4 * len(set(v)) >= 3 * len(v))
    return [{s for s in found if live(s[2])} for found in per_row]


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard_components(rows, k, percent):
    """(doc_id, n_shingles, component) by all pairs; the component of a row without words is its own id."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return [(r[0], len(s), min(least[root(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def language_model(rows, pull=(100.0, 5.0)):
    """(doc_id, held, n_tokens, n_known, N, base, score) with dictionaries of counts."""
    texts = [(r[0], remainder(r[0], 10) == 0, [*words(r[1]), ""]) for r in rows]
    one, two, three, after_word, after_pair = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, held, t in texts:
        if not held:
            read = ["\n", *t]
            one.update(t)
            two.update(zip(read, t))
            three.update(zip(read, t, t[1:]))
            after_word.update(read[:-1])
            after_pair.update(zip(read[:-1], t[:-1]))
    n, v = sum(one.values()), len(one)

    def p(w):
        return (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def p_after(a, w):
        return (two[a, w] + pull[0] * p(w)) / (after_word[a] + pull[0])

    def p_after_two(a, b, w):
        return (three[a, b, w] + pull[1] * p_after(b, w)) / (after_pair[a, b] + pull[1])

    out = []
    for doc_id, held, t in texts:
        base = sum(math.log10(p(w)) for w in t)
        score = math.log10(p_after("\n", t[0])) + sum(
            math.log10(p_after_two(*x)) for x in zip(["\n", *t], t, t[1:]))
        out.append((doc_id, held, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def winnow(text, hash_of, k=5, window=16):
    """Positions kept, given the hash of each gram by its position."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return []
    n = max(1, len(w) - k + 1)
    kept = set()
    for i in range(max(1, n - window + 1)):
        part = range(i, min(i + window, n))
        least = min(hash_of(w[j:j + k]) for j in part)
        kept.add(max(j for j in part if hash_of(w[j:j + k]) == least))
    return sorted(kept)


def edited(rows):
    """The edited text of each row, by position in the list."""
    key = lambda i: -(1 << 63) if i is None else i
    ids = sorted({key(r[0]) for r in rows})
    following = dict(zip(ids, [*ids[1:], *ids[:1]]))
    return following, key


def nearest(ids, vectors, k, asks):
    """(query, rank, id, score) by all distances."""
    once = sorted({(i, tuple(v)) for i, v in zip(ids, vectors)})
    ids, data = np.array([i for i, _ in once]), np.array([v for _, v in once], dtype=np.float64)
    out = []
    for q in np.flatnonzero([asks(i) for i in ids]):
        score = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, score)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r, int(ids[i]), float(score[i])) for r, i in enumerate(order, 1)]
    return out


def all_segments(scores):
    """Maximal scoring segments by recursion on the best one."""
    def best(a, b):
        # Of equal sums the shortest: no part of a maximal segment scores as much.
        top = (0, 0, a, a)
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if (total, i - j) > top[:2]:
                    top = (total, i - j, i, j + 1)
        return top[0], *top[2:]

    def divide(a, b):
        total, i, j = best(a, b)
        return [] if total <= 0 else [*divide(a, i), (i, j, total), *divide(j, b)]

    return divide(0, len(scores))


def digest(data):
    return hashlib.sha256(data).hexdigest()


def token_groups(text, a, b):
    """Groups of (A ids, B ids) and their links, given (id, bytes) of the tokens of either side; no tokens: no groups."""
    whole = b" " + (text or "").encode()
    if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
        return []
    ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
    both, groups = sorted(ends[0] & ends[1]), defaultdict(lambda: ([], []))
    for k, side in enumerate((a, b)):
        at = 0
        for i, t in side:
            at += len(t)
            groups[both[bisect_left(both, at)]][k].append(i)
    return [groups[e] for e in sorted(groups)]


def token_links(grouped):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) per text from the groups of all."""
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in grouped]
    docs = Counter(pair for found in links for pair in found)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for groups, found in zip(grouped, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()),
                    sum(n for p, n in found.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in found.items()),
                    digest(shown.encode()) if groups else ""))
    return out, docs


def filter_fails(rows):
    """The filters that each row fails, as a set of letters."""
    least, out = {}, []
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        out.append({name for name, failed in {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": r[0] is not None and r[0] > least[text]}.items() if failed})
    return out


def filter_steps(rows, labels):
    """Every order and step of every part by taking rows away one filter after the other."""
    from itertools import permutations

    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], quality == 1), max(marks[i][1], toxic == 1)]
    parts, out = defaultdict(list), []
    for r, fails in zip(rows, filter_fails(rows)):
        parts[r[2] or ""].append((fails, *(marks[r[0]] if r[0] in marks else (0, 0))))
    for part, held in parts.items():
        found, total = [], Counter()
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [h for h in left if f in h[0]]
                left = [h for h in left if f not in h[0]]
                total[f] += len(gone)
                found.append(("".join(order), step, len(left), len(gone), sum(f in h[0] for h in held) - len(gone),
                              sum(h[0] == {f} for h in held), sum(h[1] for h in gone), sum(h[2] for h in gone), f))
        out += [(part, *row[:-1], total[row[-1]]) for row in found]
    return out


def benchmark_hits(rows, items, window=10):
    """(doc_id, n_words, n_hit, items, spans) by comparing every place with every window."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, text in items:
        w = pattern.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].add("" if i is None else str(i))
    lengths, out = {len(w) for w in windows}, []
    for r in rows:
        w = pattern.findall(lower(r[1]))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        edges = [p for p in sorted(hit) if p - 1 not in hit], [p + 1 for p in sorted(hit) if p + 1 not in hit]
        out.append((r[0], len(w), len(hit), sorted(found), [x for span in zip(*edges) for x in span]))
    return out
