"""Brute-force versions of the operators over small lists of rows."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

ONE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def repeats(rows, length=200):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] of [(doc_id, text)]."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """{source: target} of {source: words} by reshared excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, got = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            got |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            got[s] = cap * sizes[s]
        left -= sum(got[s] for s in over)
        free -= over
    return got


def n_words(t):
    return len(ONE.findall(t or ""))


def contamination(docs, items, window=13):
    found = []
    wins = defaultdict(set)
    for i, t in items:
        w = tuple(TERM.findall(lower(t)))
        for p in range(max(1, len(w) - window + 1)) if w else ():
            wins[w[p:p + window]].add(i)
    lens = {len(w) for w in wins}
    for i, t in docs:
        w = TERM.findall(lower(t))
        hit, ids = set(), set()
        for k in lens:
            for p in range(len(w) - k + 1):
                of = wins.get(tuple(w[p:p + k]))
                if of:
                    hit |= set(range(p, p + k))
                    ids |= of
        ids = sorted(str(x) for x in ids if x is not None)
        found.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                      bool(hit) and 20 * len(hit) >= len(w)))
    return found


def fingerprint(t, k=4):
    w = ONE.findall(lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits=4):
    """Component label (an index) of each fingerprint."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def quality_base(t):
    t = t or ""
    w = ONE.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i:i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if ONE.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed)


_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def personal_base(t):
    """[(start, kind number, stop)] of the base patterns, in order."""
    out = []
    for k, (kind, pattern) in enumerate(_KINDS.items()):
        for m in re.finditer(pattern, t or ""):
            number = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def personal_digest(t):
    found = personal_base(t)
    counts = [sum(k == i for _, k, _ in found) for i in range(4)]
    text = ",".join(f"{list(_KINDS)[k]}:{a}:{b}" for a, k, b in found)
    return (*counts, hashlib.sha256(text.encode()).hexdigest(), text)
