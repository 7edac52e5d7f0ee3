"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_groups(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, int]:
    """The smallest id reachable from each id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    seen = set()
    for own in holders.values():
        for n, a in enumerate(own):
            for b in own[n + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def quality_facts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def good(text: str | None) -> bool:
    """The verdict of the standard rules."""
    text = text or ""
    n, chars, symbols, dup, covered = quality_facts(text)
    lines = sum(1 for line in text.split("\n") if WORD.search(line))
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return not (n < 50 or 100 * covered > 50 * n or 10 * symbols > n or 5 * text.count("!") > n or 2 * upper > upper + lower
                or chars < 2 * n or chars > 15 * n or 100 * dup > 50 * lines)


def without_boilerplate(rows: list[tuple[int, str, str]], ratio: float = 0.1, least: int = 3) -> dict[int, str]:
    """Texts by id without boilerplate; rows are id, host, text."""
    key = lambda line: line.strip(" \t\r")
    different = {(host, text) for _, host, text in rows}
    pages, counts = Counter(host for host, _ in different), Counter()
    for host, text in different:
        counts.update((host, k) for k in {key(line) for line in text.split("\n")} if k)
    bad = {(h, k) for (h, k), n in counts.items() if n >= least and n > pages[h] * ratio}
    return {i: "\n".join(line for line in text.split("\n") if (host, key(line)) not in bad) for i, host, text in rows}
