"""Plain versions of the operators, for small inputs."""

import itertools
import re

import xxhash

WORD7 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words7(text):
    return WORD7.findall((text or "").translate(LOWER))


def contamination(text, items):
    """n_words, hit positions, items found."""
    w = words7(text)
    hit, found = set(), set()
    for name, body in items:
        i = words7(body)
        n = min(13, len(i))
        windows = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= {str(name)} if name is not None else set()
    return len(w), hit, sorted(found)


def contaminated(text, items):
    n, hit, _ = contamination(text, items)
    return len(hit) > 0 and 20 * len(hit) >= n


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(rows):
    """Per row (id, text): component id."""
    g = Groups()
    sets = [shingles(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            g.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = g.find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [rows[i][0] if not sets[i] else least.get(g.find(i)) for i in range(len(rows))]


def norm_line(line):
    dropped = "!\"'(),.:;?[]`{}¡«·»¿‘’‚“”„…‹›、。"
    w = re.sub(f"[{re.escape(dropped)}]", "", line.lower())
    w = " ".join(re.sub(r"[\x00-\x1F!-/:-@\[-`{-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\u2010-\u2027\u2030-\u205E\u3003]", " ", w).strip(" ").split(" ")).strip()
    return re.sub(" {2,}", " ", w) or line.strip(" \t\r\x0b\x0c")


def simhash(norm):
    words = norm.split(" ")
    votes = [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(words))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_lines(rows, keep_empty=False):
    """Per row (id, text): the text that is left, or False if no line is, unless keep_empty. Rows that repeat are one."""
    g = Groups()
    norms = sorted({norm_line(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    hashes = {n: simhash(n) for n in norms}
    for a, b in itertools.combinations(norms, 2):
        most = max(len(a), len(b)) * 10 // 100
        if (hashes[a] ^ hashes[b]).bit_count() <= 3 and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
            g.join(a, b)
    first = {}
    key = lambda d: (d is None, d if d is not None else 0)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if norm_line(x):
                at = (key(d), i)
                r = g.find(norm_line(x))
                first[r] = min(first.get(r, at), at)
    out = []
    for d, t in rows:
        if t is None:
            out.append(t)
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if not norm_line(x) or first[g.find(norm_line(x))] == (key(d), i)]
        out.append(("\n".join(kept)) if keep_empty or kept == t.split("\n") or any(norm_line(x) for x in kept) else False)
    return out
