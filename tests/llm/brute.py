"""Plain, quadratic versions of the operators, over lists of dicts."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h_text(s, seed=42):
    return signed(xxhash.xxh64_intdigest(s.encode(), seed & (2**64 - 1)))


def h_long(x, seed=42):
    return signed(xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed & (2**64 - 1)))


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(n, links):
    parent = list(range(n))
    for a, b in links:
        parent[find(parent, a)] = find(parent, b)
    return [find(parent, i) for i in range(n)]


def quality(rows, trusted, smoothing=1.0, cut=2.0):
    n = 4096 * max(2, math.ceil(36 * math.sqrt(sum(len((r["text"] or "").encode()) for r in rows)) / 4096))
    raw, good = Counter(), Counter()
    grams = []
    for r in rows:
        h = [h_text(w) for w in WORD.findall(r["text"] or "")]
        g = [x % n for x in h] + [h_long(b, h_long(a)) % n for a, b in zip(h, h[1:], strict=False)]
        grams.append(g)
        raw.update(g)
        if r["doc_id"] is not None and r["doc_id"] in trusted:
            good.update(g)
    sums = (sum(good.values()), sum(raw.values()))
    share = lambda c, t: (c + smoothing * t / n) / (t * (1 + smoothing))
    weight = {b: struct.unpack("f", struct.pack("f", math.log(share(good[b], sums[0])) - math.log(share(raw[b], sums[1]))))[0] for b in raw} if sums[0] else Counter()
    least = -cut * sum(k * weight[b] for b, k in good.items()) / max(1, sums[0])
    out = []
    for r, g in zip(rows, grams, strict=True):
        text = r["text"] or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        ratio = sum(weight[b] for b in g) / max(1, len(g))
        out.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, not failed and ratio >= least))
    return out


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fps = [fingerprint(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = components(len(fps), links)
    ids = defaultdict(list)
    for r, c in zip(rows, root, strict=True):
        ids[c].append(r["doc_id"])
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    return [(r["doc_id"], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, root, strict=True)]


KINDS = [
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def secrets(rows):
    out, found, owners, repos = [], [], defaultdict(set), defaultdict(set)
    for r in rows:
        text = r["text"] or ""
        base = [(m.start(), i, m.end(), k, m[g]) for i, (k, p, g, least) in enumerate(KINDS) for m in re.finditer(p, text) if len(m[g]) >= least]
        mixed = [(m.start(), 3, m.end(), "mixed", m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{32,}", text) if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")) and not any(b[0] < m.end() and m.start() < b[2] for b in base)]
        for s in base + mixed:
            owners[s[4]].add(r["source"])
            repos[s[4]].add((r["source"], r["lang"]))
        found.append((base, mixed))
    said = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans, key=lambda s: (s[0], s[1], s[2])))
    for r, (base, mixed) in zip(rows, found, strict=True):
        own = lambda s: len(owners[s[4]]) < 3 and len(repos[s[4]]) < 4
        added = [s for s in mixed if own(s)]
        live = sum(map(own, base))
        out.append((r["doc_id"], *(sum(s[3] == k[0] for s in base) for k in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(base + added), live, len(base) - live))
    return out
