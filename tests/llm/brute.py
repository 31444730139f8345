"""Plain single-machine versions of the operators' results."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
BLANK_WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=BLANK_WORD):
    return pattern.findall((text or "").translate(LOWER))


def held_out(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


def contaminated(rows, items):
    windows = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text, TERM)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n][tuple(w[k : k + n])].add(item)
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text, TERM), set(), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if items_here := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= items_here
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)), bool(hit)))
    return out


def lm_scores(rows, modulus=7):
    tokens = [[*words(text), None] for _, text, *_ in rows]
    train = [t for t, r in zip(tokens, rows, strict=True) if not held_out(r[0], modulus)]
    count, pairs = Counter(), Counter()
    for t in train:
        count.update(t)
        pairs.update(zip([None, *t[:-1]], t, strict=True))
    follow, cont = defaultdict(lambda: [0] * 4), Counter()
    for (u, v), n in pairs.items():
        follow[u][min(n, 3)] += 1
        cont[v] += 1

    def discounts(values):
        t = Counter(values)
        y = t[1] / (t[1] + 2 * t[2])
        raw = [k - (k + 1) * y * t[k + 1] / t[k] if t[k] else 0 for k in (1, 2, 3)]
        return [0.0, *(d if 0 < d <= k else k / 2 for k, d in enumerate(raw, 1))]

    high, low = discounts(pairs.values()), discounts(cont.values())
    kinds = len(pairs)
    rest = sum(low[min(n, 3)] for n in cont.values()) / kinds / (len(count) + 1)

    def probability(u, v):
        below = (cont[v] - low[min(cont[v], 3)]) / kinds + rest if v in cont else rest
        if u not in count:
            return below
        n = pairs[u, v]
        return max(n - high[min(n, 3)], 0) / count[u] + sum(high[k] * follow[u][k] for k in (1, 2, 3)) / count[u] * below

    total = sum(count.values())
    return [
        (
            r[0], len(t), sum(count[x] > 0 for x in t), total, sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in t),
            sum(math.log10(probability(u, v)) for u, v in zip([None, *t[:-1]], t, strict=True)),
        )
        for r, t in zip(rows, tokens, strict=True)
    ]


def segmented(word, vocabulary):
    """Tokens of one pre-token, by a plain dynamic programme over all its prefixes."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + vocabulary.byte_score * size, -(-best[end - 1][1] + size))]
        for start in range(end):
            if (piece := word[start:end]) in vocabulary.scores:
                options.append((best[start][0] + vocabulary.scores[piece], best[start][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def near_groups(rows, percent):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(r[0], len(s), smallest[find(k)] if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Target of each source from {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in out]
        total = sum(weight[s] for s in open_)
        capped = [s for s in open_ if weight[s] * left / total >= most * sizes[s]]
        if not capped:
            return out | {s: weight[s] * left / total for s in open_}
        out |= {s: most * sizes[s] for s in capped}
        left -= sum(out[s] for s in capped)


def spans(text):
    """Base spans by the plain patterns."""
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def without_repeats(ordered):
    """(kept bytes, removed spans) of texts in order of precedence."""
    seen, out = set(), []
    for text in ordered:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - 99):
            if (part := data[k : k + 100]) in seen:
                cover[k : k + 100] = b"\1" * 100
            else:
                seen.add(part)
        out.append((bytes(b for b, gone in zip(data, cover, strict=True) if not gone), sum(1 for k, x in enumerate(cover) if x and (not k or not cover[k - 1]))))
    return out


def merkle(rows, fanout, columns):
    """[(id, leaf, subroot, root, siblings level by level)]; ``rows`` are dicts with the columns, doc_id and lang."""
    import hashlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in columns])

    def grown(level):
        """Top, and the siblings of each place."""
        paths, own = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, at in enumerate(own):
                first = at // fanout * fanout
                paths[k] += level[first:at] + level[at + 1 : first + fanout]
            own = [at // fanout for at in own]
            level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = grown([x[2] for x in groups[name]])
    if not names:
        return []
    root, above = grown([trees[name][0] for name in names])
    return [
        (x[1] if x[0] else None, x[2], trees[name][0], root, "".join(trees[name][1][k] + above[g]))
        for g, name in enumerate(names) for k, x in enumerate(groups[name])
    ]


def word_counts(rows, slips=199):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(count, factor=5):
    """{word: (n, n_near, form, form_n, root)}"""
    by_length = defaultdict(list)
    for w in count:
        by_length[len(w)].append(w)
    form, out = {}, {}
    for w, n in count.items():
        near = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)]
        best = min(near, key=lambda x: (-count[x], x.encode()), default=None)
        form[w] = best if best and count[best] >= factor * n else None
        out[w] = len(near)
    result = {}
    for w, n in count.items():
        end = w
        while form[end]:
            end = form[end]
        result[w] = (n, out[w], form[w], count.get(form[w]), end)
    return result
