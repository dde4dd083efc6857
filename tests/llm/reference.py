"""Plain Python versions of the contracts, row by row and pair by pair."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

WINDOW = 10
_ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return text.encode().lower().decode()


class Sets:
    """Union by smallest member."""

    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(rows: dict[int, str | None]) -> tuple[dict, dict]:
    sets = {i: shingles(t) for i, t in rows.items()}
    groups = Sets(rows)
    for a, b in combinations(rows, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            groups.link(a, b)
    return {i: len(s) for i, s in sets.items()}, {i: groups.find(i) for i in rows}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(text: str | None, items: list[tuple]) -> tuple:
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(WINDOW, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                if doc[at: at + n] == w[s: s + n]:
                    hit.update(range(at, at + n))
                    if item is not None:
                        found.add(str(item))
    return len(doc), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    t = text or ""
    return sorted(
        [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
        + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int]]:
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
