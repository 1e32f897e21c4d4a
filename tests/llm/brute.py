"""Plain restatements of the result contracts, one row at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def secrets(text):
    text = text or ""
    found = []
    rules = (
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    for rank, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    n = lambda k: sum(f[2] == k for f in found)
    return n("assign"), n("access"), n("hex"), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))


def decontaminated(docs, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - width) + 1 if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= held
        names = sorted(map(str, found))
        out[doc] = (len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    said = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", said), (1, "assistant", said)]
    out = {}
    for conv, turns in by.items():
        turns.sort()
        taught = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(taught), sha(taught))
    return out


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(0, len(w) - width) + 1))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_classes(docs, width=4, threshold=85):
    sets = {d: shingles(t, width) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    tried, links = set(), []
    for members in where.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                pair = (a, b) if a < b else (b, a)
                if pair not in tried:
                    tried.add(pair)
                    x, y = sets[a], sets[b]
                    both = len(x & y)
                    if 100 * both >= threshold * (len(x) + len(y) - both):
                        links.append(pair)
    part = components(sets, links)
    return {d: (len(s), part[d]) for d, s in sets.items()}


def close_vectors(rows, threshold=0.98):
    import numpy as np

    by, ids = defaultdict(list), [r[0] for r in rows]
    for vec, v, label in rows:
        if label is None or v is None or any(x is None for x in v) or not len(v):
            continue
        v = np.array(v, dtype=np.float64)
        if np.isfinite(v).all() and v.any():
            by[(label, len(v))].append((vec, v / np.linalg.norm(v)))
    n, links = dict.fromkeys(ids, 0), []
    for held in by.values():
        m = np.array([v for _, v in held])
        for i, j in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            links.append((held[i][0], held[j][0]))
            n[held[i][0]] += 1
            n[held[j][0]] += 1
    part = components(ids, links)
    return {i: (n[i], part[i], part[i] == i) for i in ids}
