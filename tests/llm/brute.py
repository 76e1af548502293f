"""Plain versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars = len(w), sum(map(len, w))
    symbols, caps = sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text)
    dup, repeat = len(lines) - len(set(lines)), len(covered)
    failed = n < 10 or 100 * repeat > 20 * n
    bad = chars > 16 * n or chars < 2 * n or 10 * symbols > n or 10 * caps > 4 * chars or 10 * dup > 3 * n
    return n, chars, symbols, dup, repeat, failed, not (failed or bad)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def classes(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for j in range(i):
            e, t = sets[j]
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def leaks(docs: list[tuple], items: list[tuple]) -> dict:
    def terms(text):
        return TERM.findall((text or "").translate(LOWER))

    windows: dict[tuple, set] = {}
    for item, text in items:
        w = terms(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    widths = {len(x) for x in windows}
    out = {}
    for d, text in docs:
        w, hit, found = terms(text), set(), set()
        for k in widths:
            for i in range(len(w) - k + 1):
                own = windows.get(tuple(w[i:i + k]))
                if own:
                    hit.update(range(i, i + k))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def secrets(text: str | None) -> tuple:
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = {
        "assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    order = sorted((a, r, k, b) for r, k in enumerate(kinds) for a, b in kinds[k])
    return (*map(len, kinds.values()), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in order)))


def _luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    text = text or ""

    def digits(s):
        return re.sub("[^0-9]", "", s)

    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    kinds = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in card if 16 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }
    return (*map(len, kinds.values()), sha(",".join(f"{k}:{a}:{b}" for k in kinds for a, b in kinds[k])))


def repeats(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text)."""
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i:i + 50]] = min(d, first.get(b[i:i + 50], d))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - 49):
            if d is not None and first[b[i:i + 50]] < d:
                gone.update(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        out.append((d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
