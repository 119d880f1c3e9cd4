"""Brute-force versions of the operators."""

import re

import numpy as np

LONG = "abc defgh " * 60_000  # 600 kB


def words(text):
    return re.findall(r"[0-9a-z]+", "".join(c if c.isascii() else "z" for c in (text or "").lower()))


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_links(texts, threshold=0.8, n=5):
    """{(a, b)} of ids a < b."""
    s = {k: shingles(t, n) for k, t in texts.items()}
    ids = [k for k in s if s[k]]
    return {(a, b) for a in ids for b in ids if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold - 1e-12}


def cosine_links(rows, threshold=0.98):
    """rows: (id, label, vector)."""
    good = []
    for i, label, v in rows:
        if label is None or v is None or not len(v) or any(x is None for x in v):
            continue
        a = np.array(v, float)
        if np.isfinite(a).all() and a.any():
            good.append((i, label, a))
    return {(i, j) for i, a, u in good for j, b, v in good if i < j and a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold}


def dedup_lines(rows, min_points=20, min_docs=3):
    """rows: (id, text) -> list of (lines, kept lines), null ids untouched."""
    ws = " \t\n\r\x0b\x0c"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(ws).translate(low)
    seen = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_points:
                    seen.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(seen.get(key(x), ())) >= min_docs and i != max(seen[key(x)]) for x in lines]
        out.append((lines, [x for x, g in zip(lines, gone) if not g]))
    return out


def water(sizes, weights, most=3.0):
    """Targets: all sizes shared by weight, none above ``most`` times its source's size."""
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weights[s] / w > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        capped |= over


def partial_pass(items, target, room, near=0.01):
    """Keys that the last, partial pass through one source takes. items: (key, size), keys unlike, sizes above 0."""

    def fill(gap, ahead):
        taken = set()
        for key, size in sorted(items):
            if key not in ahead and size <= gap:
                taken.add(key)
                gap -= size
        rest = [(size, key) for key, size in items if key not in taken and key not in ahead and size < 2 * gap]
        size, closing = min(rest) if rest else (0, None)
        return taken, closing, abs(gap - size)

    ahead = []
    taken, closing, miss = fill(room, ahead)
    while room > 0 and miss > near * target:
        others = [(key, size) for key, size in items if key not in taken and key not in ahead]
        fits = [x for x in others if x[1] <= room]
        if not others:
            break
        key, size = min(fits) if fits else min(others, key=lambda x: (x[1], x[0]))
        tried = fill(room - size, [*ahead, key])
        if tried[2] >= miss:
            break
        (taken, closing, miss), ahead, room = tried, [*ahead, key], room - size
    return taken | set(ahead) | ({closing} - {None})


def mixed(rows, cycle=(5, 2, 1), most=3.0):
    """rows: (name, source, size, key), keys unlike. {name: how often the mix takes it}."""
    sizes = {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, most)
    out = {}
    for s in sizes:
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        some = partial_pass([(key, size) for _, t, size, key in rows if t == s and size], target[s], target[s] - epochs * sizes[s])
        out |= {name: epochs + (key in some) for name, t, _, key in rows if t == s}
    return out
