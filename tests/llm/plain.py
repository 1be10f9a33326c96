"""Plain Python versions of the query contracts, one document at a time."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words(text, rx=ALNUM):
    return rx.findall((text or "").translate(UPPER))


def sha(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def licenses(text):
    w = words(text)
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def shingles(text):
    w = words(text, SPACED)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def components(docs):
    """doc_id -> (size of the set, smallest doc_id reachable)."""
    sets = {k: shingles(t) for k, t in docs}
    lists = {}
    for k, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, o in Counter(j for x in s for j in lists[x] if j < k).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


def contamination(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(sorted(found)), bool(hit)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
)


def personal(text):
    spans = [[(k, m.start(), m.end()) for m in re.finditer(rx, text or "") if good(m[0])] for k, rx, good in PERSONAL]
    return *(len(s) for s in spans), sha(f"{k}:{a}:{b}" for s in spans for k, a, b in s)


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    return *(sum(k == i for _, k, _ in spans) for i in range(3)), sha(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def quality(text):
    t = text or ""
    w = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


def targets(sizes):
    """source -> target, by sharing the excess again until no target is above twice its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def warc(pages):
    """page rows -> (bytes, digest, type, refers_to) in order."""
    best = {}
    for page, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            best[body] = max(page, best.get(body, page))
    out = []
    for page, html in pages:
        body = (html or "").encode()
        keep = best.get(body, page)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if keep == page else "revisit", None if keep == page else keep))
    return out


def backoff(docs):
    """doc_id -> (words, seen, score) by counts of all other documents."""
    w = {k: words(t) for k, t in docs}
    one, two = Counter(), Counter()
    for x in w.values():
        one.update(x)
        two.update(zip(x, x[1:]))
    total, out = sum(one.values()), {}
    for k, x in w.items():
        o, t, s, seen = Counter(x), Counter(zip(x, x[1:])), 0.0, 0
        n = total - len(x)
        for i, v in enumerate(x):
            c = one[v] - o[v]
            single = math.log(c / n) if c else -math.log(n + 1)
            pair = (x[i - 1], v) if i else None
            if pair and two[pair] > t[pair]:
                s += math.log((two[pair] - t[pair]) / (one[pair[0]] - o[pair[0]]))
                seen += 1
            else:
                s += single + (math.log(0.4) if i else 0)
        out[k] = (len(x), seen, s)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x, y):
    """Adam on the loss with equal weight of both classes, on a dense matrix."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    share = [0.5 / max(1, np.sum((y > 0.5) == (c > 0.5))) for c in y]
    for t in range(1, 151):
        g = x.T @ (share * (_sigmoid(x @ w) - y)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _platt(columns, y, prior):
    x = np.array([np.ones(len(y)), *columns])
    scale = np.maximum(np.abs(x).max(axis=1), 1e-9)
    share = np.array([prior / np.sum(y > 0.5) if c > 0.5 else (1 - prior) / np.sum(y < 0.5) for c in y])
    w = np.zeros(len(x))
    for _ in range(800):
        w = w - 2.0 * ((x / scale[:, None]) @ (share * (_sigmoid(w @ (x / scale[:, None])) - y)) + 1e-3 * w)
    return w / scale


def co_training(views, labels, rounds, handed):
    """views: two dense matrices of all documents. labels: row -> 0 or 1, in the order in which samples are drawn.
    Returns the calibrated probabilities by each view and by both, and the threshold."""
    ones, zeros = ([r for r, y in labels.items() if y == c] for c in (1, 0))
    prior = len(ones) / len(labels)
    held = [[x for i, x in enumerate(c) if i % 5 == 0] for c in (zeros, ones)]
    parts = [[x for c in held for i, x in enumerate(c) if i % 3 == k] for k in range(3)]
    training = [r for r in zeros + ones if r not in held[0] + held[1]]
    rows = [[(r, labels[r]) for r in training] for _ in views]
    pool = [r for r in range(len(views[0])) if r not in labels]
    for r in range(rounds + 1):
        weights = [_logistic(v[[i for i, _ in x]], np.array([float(y) for _, y in x])) for v, x in zip(views, rows)]
        if r == rounds:
            break
        given = set()
        for i, v in enumerate(views):
            score = {k: float(v[k] @ weights[i]) for k in pool}
            ranked = sorted(score.values())
            at = lambda p: ranked[max(0, math.ceil(p * len(ranked)) - 1)]  # noqa: B023, E731
            high, low = at(1 - handed * prior), at(handed * (1 - prior))
            sure = [(k, 1.0) for k in pool if score[k] >= max(high, 1) and score[k] > 1] + [(k, 0.0) for k in pool if score[k] <= min(low, -1) and score[k] < -1]
            rows[1 - i] += sure
            given |= {k for k, _ in sure}
        pool = [k for k in pool if k not in given]
    truth = lambda part: np.array([float(labels[k]) for k in part])
    each = [_platt([v[parts[0]] @ w], truth(parts[0]), prior) for v, w in zip(views, weights)]
    odds = [np.clip(c[0] + c[1] * (v @ w), -30, 30) for c, v, w in zip(each, views, weights)]
    mix = _platt([x[parts[1]] for x in odds], truth(parts[1]), prior)
    both = _sigmoid(mix[0] + mix[1] * odds[0] + mix[2] * odds[1])
    good = sorted(both[k] for k in parts[2] if labels[k] == 1)
    return _sigmoid(odds[0]), _sigmoid(odds[1]), both, min(0.5, good[int(0.005 * (len(good) - 1))])
