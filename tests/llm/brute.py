"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def substring_dedup(docs, k=35):
    words = [WORD.findall(t or "") for _, t in docs]
    counts = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if counts[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    shared = Counter((a, b) for rows in at.values() for n, a in enumerate(rows) for b in rows[n + 1 :])
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            up[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(docs)]


def contamination(docs, items, k=10):
    windows = defaultdict(set)
    for item, text in items:
        w = NORMAL.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - k + 1)):
            if w:
                windows[tuple(w[i : i + k])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = NORMAL.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


BASE = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def secrets(text):
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        spans += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(spans)]


def toxicity(text, model, offending=0.5):
    """Score and number of offending words of one text, token by token, with a fitted model's weights."""
    import math

    import xxhash

    low = (text or "").lower().encode("utf-8", "surrogatepass")
    tokens = re.findall(rb"[a-z\x80-\xff]+", low)
    weight = lambda f: float(model.weights[xxhash.xxh64_intdigest(f) % len(model.weights)])
    e = []
    for i, w in enumerate(tokens):
        z = model.bias + weight(w) + weight(b"*" + w[-3:]) + sum(weight(w[:n] + b"*") for n in range(3, 9) if n <= len(w))
        z += weight(b"<" + tokens[i - 1]) if i else 0.0
        z += weight(b">" + tokens[i + 1]) if i + 1 < len(tokens) else 0.0
        e.append(math.exp(max(-30, min(30, z))))
    ot, to, tt = (math.exp(m) for m in model.moves)
    forward = []
    for i, x in enumerate(e):
        forward.append(x * (ot + tt * forward[-1]) / (1 + to * forward[-1]) if i else x)
    squares = surely = n = 0
    back = 1.0
    for i in range(len(e) - 1, -1, -1):
        p = forward[i] * back / (1 + forward[i] * back)
        squares, surely, n = squares + p * p, surely - math.log1p(-min(p * p, 1 - 1e-6)), n + (p >= offending)
        back = (to + tt * e[i] * back) / (1 + ot * e[i] * back)
    c, w, k = model.scale
    return 1 / (1 + math.exp(-max(-40, min(40, c + w * math.log1p(squares) + k * math.log1p(surely))))), n


def language(text, rows, most_n=5, least=2, penalty=-7.0):
    """The language of one text; rows: texts and languages that are learned from. None: no language is known."""
    import math

    letters = lambda t: re.findall(r"(?:[a-z]|[^\x00-\x7f])+", (t or "").lower())
    pad = lambda w, n: [f"\x02{w}\x03"[i : i + n] for i in range(len(w) + 3 - n)] if len(w) + 2 >= n else []
    if not isinstance(rows, dict):
        counts = defaultdict(Counter)
        for t, lang in rows:
            for w in letters(t):
                counts[lang, 0][w] += 1
                for n in range(1, most_n + 1):
                    counts[lang, n].update(pad(w, n))
        rows = {}
        for (lang, n), c in counts.items():
            total = sum(c.values())
            rows[lang, n] = {x: max(penalty, math.log10(k / total)) for x, k in c.items() if k >= least}
    if text is None:
        return rows
    langs = sorted({lang for (lang, _), c in rows.items() if c})
    found = letters(text)
    if not any(c.isalpha() for w in found for c in w):
        return "und"
    score = dict.fromkeys(langs, 0.0)
    for w in found:
        units = [w] if any(w in rows[lang, 0] for lang in langs) else None
        level = 0
        for n in range(most_n, 0, -1):
            if units:
                break
            units, level = [g for g in pad(w, n) if any(g in rows[lang, n] for lang in langs)], n
        for lang in langs:
            score[lang] += sum(rows[lang, level].get(g, penalty) for g in units) / len(units) if units else penalty
    return min(langs, key=lambda lang: (-round(score[lang] / len(found), 6), lang))
