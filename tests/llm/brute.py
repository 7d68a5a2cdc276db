"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import regex

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def visible(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def contaminated(docs, items, window=10):
    """doc -> (n_words, n_hit, sorted item ids)."""
    wins = []
    for item, text in items:
        w = letters(text)
        n = min(len(w), window)
        wins += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = {}
    for doc, text in docs:
        w, hit, found = letters(text), set(), set()
        for item, k in wins:
            for i in range(len(w) - len(k) + 1):
                if w[i : i + len(k)] == k:
                    hit.update(range(i, i + len(k)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def shingle_set(text):
    w = visible(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_classes(docs):
    """doc -> (set size, smallest doc reachable)."""
    sets = {d: shingle_set(t) for d, t in docs}
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def without_repeats(docs, length=100):
    """doc -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def squeezed(text):
    """Letters as they are, and one blank for a run of other characters."""
    return re.sub(r"[\W\d_]+", " ", text)


def cross_phrases(text, reference):
    """How many phrases the greedy parse of text by substrings of the reference has; what the reference lacks is a phrase of its own."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in reference:
            j += 1
        n, i = n + 1, j
    return n


def detections(text, rules, expression, operands):
    """(start, words, priority, label, how sure) of the rules' matches, without those inside others and those that clash."""
    line = " " + " ".join(letters(text)) + " " if letters(text) else "  "
    found = []
    for r in rules:
        if r["keyword"] in line:
            for m in regex.finditer(r["pattern"], line):
                found.append((line[: m.start()].count(" ") - 1, m.group().count(" ") + 1, r["priority"], r["label"], r["sure"]))
    for e in regex.finditer(expression, line):
        for r in operands:
            for m in regex.finditer(r["pattern"], line[: e.end() + 1], pos=e.start()):
                found.append((line[: m.start()].count(" ") - 1, m.group().count(" ") + 1, r["priority"], r["label"], r["sure"]))
    found.sort(key=lambda d: (d[0], -d[1], *d[2:]))
    outer = [d for i, d in enumerate(found) if not any(e[0] <= d[0] and d[0] + d[1] <= e[0] + e[1] for e in found[:i])]
    kept = []
    for d in sorted(outer, key=lambda d: (d[2], d[0], -d[1], *d[3:])):
        if not any(e[3] != d[3] and e[0] < d[0] + d[1] and d[0] < e[0] + e[1] for e in kept):
            kept.append(d)
    return sorted((d for d in kept if d[3]), key=lambda d: (d[0], -d[1], *d[2:]))
