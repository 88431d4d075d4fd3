"""Plain versions of the operators, over lists of (doc_id, text)."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text, size=5):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def near_classes(rows, threshold=0.8):
    """{doc_id: least id of its class}; rows with NULL ids or texts left out."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    holders = defaultdict(set)
    bags = [(i, t, bag(t)) for i, t in rows]
    for k, (i, t, b) in enumerate(bags):
        others = set().union(*(holders[s] for s in b)) if b else set()
        for o in others:
            if similarity(b, bags[o][2]) >= threshold:
                join(i, bags[o][0])
        for s in b:
            holders[s].add(k)
    first = {}
    for i, t, _ in bags:
        join(i, first.setdefault(t, i))
    return {i: find(i) for i in root}


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = WORD.findall(text)
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if times[tuple(w[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def lines_dropped(rows, least=10):
    """[(doc_id, n_lines, n_dropped, kept)]"""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in split:
        kept = [x for x in ls if held[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out
