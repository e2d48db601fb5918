"""Plain versions that the tests compare the operators with."""

from __future__ import annotations

import itertools
import re

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - (9 if d > 4 else 0)
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def brute_jaccard(texts, k=5, threshold=0.8):
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        if words:
            sets[i] = {tuple(words[a : a + k]) for a in range(max(len(words) - k + 1, 1))}
    near = {i: set() for i in texts}
    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if shared and shared / (len(sets[a]) + len(sets[b]) - shared) >= threshold:
            near[a].add(b), near[b].add(a)
    return near


def smallest_reachable(near):
    least = {}
    for start in sorted(near):
        stack = [start] if start not in least else []
        while stack:
            node = stack.pop()
            if node not in least:
                least[node] = start
                stack.extend(near[node])
    return least
