"""Plain-Python restatements of the operators' rules, used only to check them."""

import hashlib
import re
import zlib
from collections import defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingles(text):
    w = words(text)
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, good in rules for m in re.finditer(pattern, text or "") if good(m)]


def secrets(text):
    rules = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, good) in enumerate(rules) for m in re.finditer(p, text or "") if good(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def boilerplate(rows, ratio, least):
    """Texts of (host, text) rows without the lines that too many pages of the host contain."""
    pages, contain = defaultdict(int), defaultdict(int)
    for host, text in rows:
        if text is not None:
            pages[host] += 1
            for line in {x.strip("\x20\t\n\x0b\x0c\r") for x in text.split("\n")} - {""}:
                contain[host, line] += 1
    gone = {k for k, n in contain.items() if n >= least and n > ratio * pages[k[0]]}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip("\x20\t\n\x0b\x0c\r")) not in gone) for h, t in rows]


def collocations(rows, least, longest, top):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text), by counting every phrase."""
    counts, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, longest + 1):
                    if i + m <= len(w):
                        counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if a >= least}
        best = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and b >= a and inside(q) for q, b in often.items()):
                continue
            score, k = min((1000 * a * total[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def damaged(rows):
    """Conversation rows (conv_id, turn, role, text) after the test damage."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash), trying every edit of every row."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, " " if role is None else role, hashlib.md5((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = {}
    for conv, found in talks.items():
        found.sort()
        turns = [t for known, t, *_ in found if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, _, text in found:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [f[2][:1] for f in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

        best = {}
        for i in range(len(found), -1, -1):  # (cost, audit, lines) from row i on, by the last letter written
            for depth in (0, 1, 2):
                for last in allowed:
                    some = [(0, "", [])] if i == len(found) and last in ("", "a") else []
                    for letter in allowed[last]:
                        if letter != "s" and depth:
                            cost, audit, lines = best.get((i, letter, depth - 1), (99**9, "", []))
                            some.append((cost + 2, "I" + audit, [{"u": "user", "a": "assistant"}[letter] + ":", *lines]))
                    if i < len(found):
                        _, _, role, _, text = found[i]
                        after = lambda letter: best.get((i + 1, letter, 2), (99**9, "", []))
                        cost, audit, lines = after(last)
                        some.append((cost + 3, "D" + audit, lines))
                        if faults[i] in ("", "truncated"):
                            late = faults[i] == "truncated"
                            if role[:1] and role[:1] in allowed[last]:
                                cost, audit, lines = after(role[:1])
                                some.append((cost + late, "K" + audit, [f"{role}:{text}", *lines]))
                            for letter, name in (("u", "user"), ("a", "assistant")):
                                if letter in allowed[last]:
                                    cost, audit, lines = after(letter)
                                    some.append((cost + late + 2, "R" + audit, [f"{name}:{text}", *lines]))
                    if some:
                        best[i, last, depth] = min(some)
        cost, audit, lines = best[0, "", 2]
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
