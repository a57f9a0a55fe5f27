"""Slow versions, written apart from the operators, that tests compare with."""


def chain(a, b, a0, a1, b0, b1):
    """The longest chain of lines unique in both ranges; ties go to the smaller
    places in the first text."""
    x, y = a[a0:a1], b[b0:b1]
    pairs = [(a0 + x.index(t), b0 + j) for j, t in enumerate(y) if x.count(t) == 1 and y.count(t) == 1]
    best = []
    for k, (i, _) in enumerate(pairs):
        before = [(best[p][0], -pairs[p][0], p) for p in range(k) if pairs[p][0] < i]
        n, _, p = max(before, default=(0, 0, None))
        best.append((n + 1, p))
    if not pairs:
        return []
    at = max(range(len(pairs)), key=lambda k: (best[k][0], -pairs[k][0]))
    out = []
    while at is not None:
        out.append(pairs[at])
        at = best[at][1]
    return out[::-1]


def patience(a, b, least=10, a0=0, a1=None, b0=0, b1=None):
    """Matched places of two lists of lines."""
    a1, b1 = len(a) if a1 is None else a1, len(b) if b1 is None else b1
    out = []
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        out.append((a0, b0))
        a0, b0 = a0 + 1, b0 + 1
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        out.append((a1, b1))
    if a0 == a1 or b0 == b1:
        return out
    held = chain(a, b, a0, a1, b0, b1)
    if held:
        i0, j0 = a0, b0
        for i, j in [*held, (a1, b1)]:
            out += patience(a, b, least, i0, i, j0, j)
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
        return out
    heaviest = (0, 0, 0)
    for i in range(a0, a1):
        for j in range(b0, b1):
            n = 0
            while i - n >= a0 and j - n >= b0 and a[i - n] == b[j - n]:
                n += 1
            weight = sum(len(t.split()) for t in b[j - n + 1 : j + 1])
            if weight > heaviest[0]:
                heaviest = (weight, i + 1, j + 1)
    weight, i, j = heaviest
    if weight < least:
        return out
    n = 0
    while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
        n += 1
    out += [(i + k, j + k) for k in range(n)]
    return out + patience(a, b, least, a0, i, b0, j) + patience(a, b, least, i + n, a1, j + n, b1)


def blocks(first, later, least=10):
    """Lines of the later text in aligned runs of enough words."""
    a, b = ([x.strip() for x in t.split("\n")] for t in (first, later))
    matched = sorted(patience(a, b, least))
    gone, run = set(), []
    for k, m in enumerate(matched):
        run = [*run, m] if k and matched[k - 1] == (m[0] - 1, m[1] - 1) else [m]
        if k + 1 == len(matched) or matched[k + 1] != (m[0] + 1, m[1] + 1):
            if sum(len(b[j].split()) for _, j in run) >= least:
                gone |= {j for _, j in run}
    return gone


def without_lines(rows, least=10):
    """(doc_id, kept text, lines, deleted lines): every text against all earlier ones."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    order = sorted((i, t) for t, i in first.items())
    lines = {t: {x.strip() for x in t.split("\n") if x.strip()} for _, t in order}
    lost = {t: set().union(*(blocks(u, t, least) for f, u in order if f < i and lines[u] & lines[t])) for i, t in order}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        if i is not None and first[t or ""] < i:
            gone = set(range(len(parts))) if len((t or "").split()) >= least else set()
        else:
            gone = lost[t or ""] if i is not None else set()
        kept = "" if len(gone) == len(parts) else "\n".join(x for k, x in enumerate(parts) if k not in gone)
        out.append((i, kept, len(parts), len(gone)))
    return out
