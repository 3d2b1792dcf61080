"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def pii(text):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def rules(text):
    words = SPACE_WORDS.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    found, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered.update(range(i, i + 5))
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPACE_WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated,
        len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def near_duplicates(rows, words=5, percent=75):
    sets, parent = {}, {}
    for i, text in rows:
        w = SPACE_WORDS.findall(lower(text))
        sets[i] = (
            {tuple(w[k:k + words]) for k in range(len(w) - words + 1)}
            if len(w) >= words else {tuple(w)} if w else set()
        )
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(docs, items, size=13):
    owners = defaultdict(set)
    for i, text in items:
        w = LETTER_WORDS.findall(lower(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            owners[tuple(w[k:k + n])].add(str(i))
    out = {}
    for i, text in docs:
        w = LETTER_WORDS.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in owners:
                    hit.update(range(k, k + n))
                    found |= owners[tuple(w[k:k + n])]
        out[i] = (
            len(w), len(hit), len(found), sha(sorted(found)),
            len(hit) > 0 and 20 * len(hit) >= len(w),
        )
    return out


def base_scores(docs):
    def tokens(text):
        return SPACE_WORDS.findall(lower(text)) + [None]

    counts = Counter()
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {
        i: (
            len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
            sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)),
        )
        for i, t in docs
    }


def log_kt(a, b):
    return (
        math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    )


def ctw_scores(docs, depth):
    """Context-tree weighting with a dictionary of (context, level, bit prefix)."""
    nodes = {}

    def steps(text):
        b = b"\xff" * depth + (text or "").encode().lower() + b"\xff"
        for p in range(depth, len(b)):
            for level in range(8):
                yield b[p - depth:p], level, b[p] >> (8 - level), b[p] >> (7 - level) & 1

    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for context, level, prefix, bit in steps(text):
                for d in range(depth + 1):
                    nodes.setdefault((context[depth - d:], level, prefix), [0, 0])[bit] += 1
    below = defaultdict(float)
    for d in range(depth, -1, -1):
        for (context, level, prefix), (a, b) in nodes.items():
            if len(context) == d:
                own = log_kt(a, b)
                if d < depth:
                    low = below[context, level, prefix]
                    top = max(own, low)
                    own = top + math.log(math.exp(own - top) + math.exp(low - top)) - math.log(2)
                if d:
                    below[context[1:], level, prefix] += own

    def one(context, level, prefix):
        path = []
        for d in range(depth + 1):
            key = (context[depth - d:], level, prefix)
            if key not in nodes:
                break
            path.append(key)
        if not path:
            return 0.5
        p = None
        for key in reversed(path):
            a, b = nodes[key]
            here = (b + 0.5) / (a + b + 1)
            if p is None:
                p = here
            else:
                ratio = math.exp(max(-700, min(700, log_kt(a, b) - below[key])))
                p = (ratio * here + p) / (ratio + 1)
        return p

    return {
        i: sum(
            math.log10(one(c, k, p) if bit else 1 - one(c, k, p)) for c, k, p, bit in steps(t)
        )
        for i, t in docs
    }


def hard_negatives(rows, every):
    """rows: (id, components, label)."""
    known = [
        (i, label, [math.floor(256 * float(x)) for x in e])
        for i, e, label in rows
        if i is not None and label is not None and e is not None
        and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for n, (i, label, q) in enumerate(known):
        if i % every:
            continue
        scores = sorted(
            (-sum(a * b for a, b in zip(q, w)), j, other)
            for m, (j, other, w) in enumerate(known) if m != n
        )
        for p, positive, _ in [x for x in scores if x[2] == label][:5]:
            found = [x for x in scores if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(i, positive, r + 1, x[1], -p, -x[0]) for r, x in enumerate(found[:5])]
    return sorted(out)


def aligned(rows, a_encode, a_bytes, b_encode, b_bytes):
    """Per key n_a, n_b, n_groups, n_links, n_best, count_sum, digest; and documents by pair."""

    def spans(ids, spelled):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(spelled(i)), i))
            at = out[-1][1]
        return out

    per, pairs, best = {}, Counter(), defaultdict(int)
    for key, text in rows:
        per[key] = ([], [], [], [])
        a, b = (a_encode(" " + text), b_encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            continue
        left, right = spans(a, a_bytes), spans(b, b_bytes)
        links = [(x[2], y[2]) for x in left for y in right if x[0] < y[1] and y[0] < x[1]]
        groups, low = [], 0
        for end in sorted({x[1] for x in left} & {x[1] for x in right}):
            sides = [[str(x[2]) for x in side if low < x[1] <= end] for side in (left, right)]
            groups.append("|".join(map(",".join, sides)))
            low = end
        per[key] = (a, b, groups, links)
        pairs.update(set(links))
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    return {
        key: (
            len(a), len(b), len(g), len(links), sum(pairs[p] == best[p[0]] for p in links),
            sum(pairs[p] for p in links),
            hashlib.sha256(";".join(g).encode()).hexdigest() if a else "",
        )
        for key, (a, b, g, links) in per.items()
    }, pairs
