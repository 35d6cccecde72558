"""Plain versions of the operators, over all pairs and all places."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x).hexdigest()


def repeated_bytes(docs, length=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                gone[p:p + length] = [True] * length
            seen.add(b[p:p + length])
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))
    return out


def repeated_windows(docs, length=20):
    seen, out = set(), {}
    for d, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if tuple(w[p:p + length]) in seen:
                gone[p:p + length] = [True] * length
            seen.add(tuple(w[p:p + length]))
        out[d] = len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())
    return out


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs, share=75):
    sets = {d: shingles(t) for d, t in docs}
    label = {d: d for d in sets}
    order = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(order) for b in order[i + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def tiling(doc, item, least=5):
    """Words of ``item`` covered by greedy string tiles of at least ``least`` words."""
    a, b = (WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)) for x in (doc, item))
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered, len(b)
        free_a[i:i + n], free_b[j:j + n] = [False] * n, [False] * n
        covered += n
