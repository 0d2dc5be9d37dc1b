"""Plain Python versions of the training-data operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(texts, items, window):
    """(n_words, n_hit, n_items, digest of item ids) of each text."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        if w:
            for a in range(max(1, len(w) - window + 1)):
                windows[tuple(w[a:a + window])].add(i)
    out = []
    for t in texts:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        ids = ",".join(sorted("" if i is None else str(i) for i in found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()))
    return out


def shingles(text, width):
    w = SPACED.findall(lower(text))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[a:a + width]) for a in range(len(w) - width + 1))


def near(rows, width, percent):
    """(n_shingles, component_id) of each (doc_id, text) row."""
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(len(s), rows[k][0] if not s else least.get(group[k])) for k, s in enumerate(sets)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = collections.Counter(tuple(w[a:a + 3]) for a in range(len(w) - 2))
    twice = {a + k for a in range(len(w) - 2) if windows[tuple(w[a:a + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(twice)
