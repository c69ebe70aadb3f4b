"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, length=35):
    words = [SPACE_WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - length + 1) if seen[tuple(w[s:s + length])] > 1 for p in range(s, s + length)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def contaminated(rows, items, size=13):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[s:s + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s:s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, n):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[s:s + n]) for s in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return [(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s):
    return [int(c) for c in s if c in "0123456789"]


def _luhn(s):
    total = 0
    for k, d in enumerate(reversed(_digits(s))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    checks = (
        ("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", CARD, lambda s: 13 <= len(_digits(s)) <= 19 and _luhn(s)), ("phone", PHONE, lambda s: 9 <= len(_digits(s)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in checks for m in p.finditer(text) if ok(m[0])]


def repeat_words(words, run=8):
    seen = Counter(tuple(words[s:s + run]) for s in range(len(words) - run + 1))
    return len({p for s in range(len(words) - run + 1) if seen[tuple(words[s:s + run])] > 1 for p in range(s, s + run)})


def base_counts(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat_words(words))


PIECE = re.compile(r"[.,;:!?\x0a-\x0d]")
BLANK_WORD = re.compile(r"[^\x20\x09]+")


def collocations(rows, least=30, percent=80, top=2000):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = BLANK_WORD.findall(piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[s:s + k]) for s in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longest[p[s:s + m]] = max(longest[p[s:s + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * longest[p] >= percent * a:
                continue
            score, j = min((2000000 * a // (counts[p[:j]] + counts[p[j:]]), j) for j in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:j]], counts[p[j:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out
