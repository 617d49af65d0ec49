"""Plain versions of the operators' results, one row at a time."""

import re
from itertools import combinations

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def groups(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def alike_sets(sets, percent=75):
    """Pairs of ids whose sets are alike; candidates share an element."""
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def rule_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else None
    if many is None:
        from collections import Counter

        many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def license_places(text, phrases):
    words = WORD.findall((text or "").translate(LOWER))
    out = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        out += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return len(words), sorted(out)


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation's rows (turn, role, text) in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        own = SPACE.findall(text)
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1][-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]

    def after(state, letter):
        good = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        return good[state].get(letter)

    def better(best, state, entry):
        if state is not None and (state not in best or entry < best[state]):
            best[state] = entry

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    better(best, after(state, letter), (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            better(new, state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                better(new, after(state, role[:1]), (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for letter, other in (("u", "user"), ("a", "assistant")):
                    better(new, after(state, letter), (cost + more + 3, audit + "R", [*lines, f"{other}:{text}"]))
        best = new
    cost, audit, lines = min(e for state, e in with_inserts(best).items() if state in ("", "a"))
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in legal for p in zip(initials, initials[1:])), cost, audit, lines)


def collocations(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text) rows."""
    from collections import Counter

    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        longer = (b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
