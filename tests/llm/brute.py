"""What the corpus queries must return, computed plainly on small lists of (doc_id, text)."""

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def fingerprint(text, width=3):
    words = SPACE_WORD.findall(lower(text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, width=3):
    prints = {i: fingerprint(t, width) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def substrings(rows, window=50):
    own = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in own:
        for x in range(len(w) - window + 1):
            g = tuple(w[x : x + window])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in own:
        gone = set()
        for x in range(len(w) - window + 1):
            if first[tuple(w[x : x + window])] < i:
                gone.update(range(x, x + window))
        kept = " ".join(v for j, v in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_counts(text):
    x = text or ""
    w = SPACE_WORD.findall(x)
    lines = [v for v in x.split("\n") if SPACE_WORD.search(v)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, again = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            again.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", x))
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), failed


def contamination(rows, items, gram=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for x in range(max(1, len(w) - gram + 1)) if w else ():
            windows.setdefault(tuple(w[x : x + gram]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        hit, own = set(), set()
        for size in sizes:
            for x in range(len(w) - size + 1):
                if found := windows.get(tuple(w[x : x + size])):
                    hit.update(range(x, x + size))
                    own |= found
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def secrets(text):
    x, out = text or "", []
    low = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = (("assign", low, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20))
    kinds += (("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),)
    for n, (kind, pattern, right) in enumerate(kinds):
        out += [(m.start(), n, m.end(), kind) for m in pattern.finditer(x) if right(m)]
    told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
    count = Counter(k for *_, k in out)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(told.encode()).hexdigest()


# ---- quality


def grams(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in SPACE_WORD.findall(text or "")]
    return [x % 65536 for x in h] + [(a ^ b >> 17) % 65536 for a, b in zip(h, h[1:], strict=False)]


def quality(rows, labels, smoothing=0.05, good_weight=4.0):
    """(base counts, score, kept) of every row, and how far its score is from the threshold."""
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1):
            known[i] = min(y, known.get(i, 1))
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if known.get(i) == 1:
            target.update(grams(t))

    def share(counts, b):
        total = sum(counts.values())
        return (counts[b] + smoothing * total / 65536) / (total + smoothing * total)

    def ratio(b):
        return round(math.log(share(target, b)) - math.log(share(raw, b)), 5) if target else 0.0

    memo = {}
    scores = []
    for _, t in rows:
        g = grams(t)
        scores.append(sum(memo.setdefault(b, ratio(b)) if b not in memo else memo[b] for b in g) / len(g) if g else 0.0)
    counts = [base_counts(t) for _, t in rows]
    points = sorted({(s, known[i]) for (i, _), s, c in zip(rows, scores, counts, strict=True) if i in known and not c[-1]})
    good, bad = sum(y for _, y in points), sum(1 - y for _, y in points)
    least, at = 1.0, -math.inf
    if target and good and bad:
        for (x, _), (y, _) in zip(points, points[1:], strict=False):
            cut = (x + y) / 2
            loss = sum(good_weight / good for s, v in points if v and s < cut) + sum(1 / bad for s, v in points if not v and s > cut)
            if x < y and loss < least - 1e-9:
                least, at = loss, cut
    return [(c, s, not c[-1] and s >= at, abs(s - at)) for c, s in zip(counts, scores, strict=True)]


# ---- near duplicates


def connected(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def shingle_set(text, width=5):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def first_of_near_duplicates(rows, width=5, least=0.8):
    """Places of the rows that stay; equal rows don't occur."""
    prints, sets = [fingerprint(t, width) for _, t in rows], [shingle_set(t, width) for _, t in rows]

    def near(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 2 or bool(sets[a]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])

    root = connected(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)])
    best = {}
    for n, r in enumerate(root):
        best[r] = min(best.get(r, n), n, key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    return sorted(best.values())


# ---- secrets that the patterns don't know


def secret_spans(text, own):
    """All spans, from a mark for every character; own: the operator's module, for its fixed values."""
    found = [(a, b, k) for kind in ("assign", "access", "hex") for a, b, k in base_matches(text) if k == kind]
    taken = [False] * len(text)
    for a, b, _ in found:
        taken[a:b] = [True] * (b - a)
    marks = [(m.start(), m.end()) for m in re.finditer(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----", text)]
    for _, a in marks:
        b = text.find("-----END", a)
        if b < 0 or "-----BEGIN" in text[a:b] or not text[a:b].strip():
            continue
        while text[a].isspace():
            a += 1
        while text[b - 1].isspace():
            b -= 1
        for x, y in free(taken, a, b):
            if text[x:y].strip():
                found.append((x, y, "novel"))
                taken[x:y] = [True] * (y - x)
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    may = [False] * (len(text) + 1)  # where a candidate may begin, or what is left of one after a base match
    for m in own.SENSITIVE.finditer(text):
        b = min(m.end() + own.BEFORE, len(text))
        while b < len(text) and not text[b].isspace():
            b += 1
        may[m.end() : b] = [True] * (b - m.end())
    base, at = list(taken), 0
    while at < len(text):
        if not may[at] or text[at] not in key:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in key and may[end]:
            end += 1
        if end - at < 16:
            at = end
            continue
        pieces = free(base, at, end)
        keys = [(x, y) for x, y in pieces if y - x >= 16 and own._is_key(text, x, y, own.LEAST_NOVELTY)]
        found += [(x, y, "novel") for x, y in keys]
        if keys or not pieces:
            line = re.compile(r"[^\S\n]*\n[^\S\n]*[A-Za-z0-9+/_=-]{16,}(?!\S)").match(text, end)
            if line:
                may[end : line.end()] = [True] * (line.end() - end)
        at = end
    order = ("assign", "access", "hex", "novel")
    return sorted(found, key=lambda s: (s[0], order.index(s[2]), s[1]))


def free(taken, a, b):
    out = []
    for i in range(a, b):
        if not taken[i]:
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def base_matches(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(*m.span(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def masked(text, own, mask="[secret]"):
    out, end = [], 0
    for a, b, _ in secret_spans(text, own):
        if a >= end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join([*out, text[end:]])


# ---- templates of URLs


def url_verdicts(pages, rules, own):
    """template, purity and verdict of every (host, path), level by level and row by row."""
    rows = []
    for host, path in pages:
        segments = [s for s in path.split("/") if s]
        segments = [re.sub(r"^\d+(?=$|\.)", "{n}", s) for s in segments]
        segments = ["{h}" if re.fullmatch(r"[0-9a-fA-F-]{16,}", s) else s for s in segments]
        rows.append([host, "", segments])
    while True:
        values, counts = {}, Counter()
        for host, template, segments in rows:
            if segments:
                values.setdefault((host, template), set()).add(segments[0])
                counts[host, template] += 1
        wide = {k: len(v) > own.MOST_VALUES and len(v) > own.MOST_SHARE * counts[k] for k, v in values.items() if counts[k] > own.MOST_VALUES}
        if not wide:
            break
        for r in rows:
            if not r[2]:
                continue
            at = (r[0], r[1])
            if at in wide:
                r[1], r[2] = f"{r[1]}/{'*' if wide[at] else r[2][0]}", r[2][1:]
            else:
                r[1], r[2] = f"{r[1]}/{'/'.join(r[2])}", []
    leaves = [(h, t + (f"/{'/'.join(s)}" if s else "")) for h, t, s in rows]
    bad = []
    for (host, path), rule in zip(pages, rules, strict=True):
        if any(w in host for w in own.BAD_WORDS):
            bad.append(1)
        elif rule:
            bad.append(int(rule == "block"))
        else:
            bad.append(1 if re.search(f"(^|[^a-z])({'|'.join(own.BAD_WORDS)})([^a-z]|$)", lower(path)) else None)
    size, known, hits = Counter(leaves), Counter(), Counter()
    for leaf, b in zip(leaves, bad, strict=True):
        known[leaf] += b is not None
        hits[leaf] += b or 0
    prior = (sum(hits.values()) + 1) / (len(pages) + 2)
    branch, weight, ill = {}, Counter(), Counter()
    for leaf in size:
        host = leaf[0]
        n, b = sum(v for k, v in size.items() if k[0] == host), sum(v for k, v in hits.items() if k[0] == host)
        rest = n - size[leaf]
        apart = worse = False
        if rest and 0 < b < n:
            spread = math.sqrt(b / n * (1 - b / n) * (1 / size[leaf] + 1 / rest))
            gap = hits[leaf] / size[leaf] - (b - hits[leaf]) / rest
            apart, worse = abs(gap) / spread > own.MERGE_Z, gap > 0
        branch[leaf] = (host, leaf[1] if apart else "", apart)
        weight[branch[leaf]] += known[leaf] if apart and worse else size[leaf]
        ill[branch[leaf]] += hits[leaf]
    out = []
    for leaf, rule in zip(leaves, rules, strict=True):
        like = (leaf[0], "", False)
        share = (ill[like] + own.PRIOR_ROWS * prior) / (weight[like] + own.PRIOR_ROWS)
        at = branch[leaf]
        purity = (ill[at] + own.PRIOR_ROWS * share) / (weight[at] + own.PRIOR_ROWS)
        out.append((leaf[1], purity, rule or ("block" if purity >= own.LEAST_PURITY else "allow")))
    return out
