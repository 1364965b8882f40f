"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import string

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def kept_words(docs, window=50):
    """docs: (id, text) pairs -> list of (id, words, kept words)."""
    first = {}
    split = [(i, SPACE.findall(t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, w, [x for k, x in enumerate(w) if k not in gone]))
    return out


def shingles(text, n=5):
    w = SPACE.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)])


def components(docs):
    """docs: (id, text) -> {id: (set size, component)}; ids unique."""
    sets = {i: shingles(t) for i, t in docs}
    part = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            if (part[a], part[b]) != (low, low):
                part[a] = part[b] = low
                changed = True
    return {i: (len(sets[i]), part[i]) for i in ids}


def contamination(text, items, window=10):
    """items: (id, text) -> n_words, n_hit, sorted item ids."""
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        v = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def statistics(text):
    t = text or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 5000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {k + d for k, g in enumerate(grams) if g in twice for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
