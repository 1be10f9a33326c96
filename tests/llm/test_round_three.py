"""Fill-in-the-middle, url filters and whitening against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factline.llm import fim, urls, whitening

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    units = TOKENS.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


ODD = ["a <P> b", "<S", "<M", "< P> <P", "ends in <", "\U0001f600 \U0001f600\t\U0001f600x\U0001f600", " \n", "\n", "x ", " x", "a\u2028b\u0085c d\x1fe", "\x00 \x00", "é" * 3]


def test_fill_in_middle(spark, docs, by_id):
    rows = by_id + [(20_000 + i, t * k) for i, t in enumerate(ODD) for k in (1, 7)] + [(None, "no id here"), (None, None), (5, "same id"), (5, "same id")]
    rows += [(30_000 + 1000 * k + i, t) for i, t in enumerate(ODD) for k in range(6)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fim_text string, n int").repartition(5)
    got = fim.digests(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_fim(d, t) for d, t in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and all(r["restored_sha256"] for r in got)
    kept = fim.transform(df)
    assert kept.columns[:4] == df.columns and kept.columns[-1] == "fim_text_" and kept.where("fim_text = 'x'").count() == len(rows)
    assert fim.digests(df.where("false")).count() == 0


@pytest.mark.parametrize("grammar, pattern", [("tokens", TOKENS.pattern), ("words", r"\s*[^\s]+\s*|\s+"), ("runs", r"\s+|[^\s]+"), ("lines", r"[^\n]*\n|[^\n]+"), ("characters", r"[\s\S]")])
def test_grammars_lose_nothing(spark, texts, grammar, pattern):
    ascii_ = [t for t in texts + ODD if t is None or t.isascii() and not re.search("[\x1c-\x1f]", t)]
    df = spark.createDataFrame([(t,) for t in ascii_], "text string").select("text", fim.units("text", grammar).alias("u"))
    for r in df.collect():
        want = re.findall(pattern, r["text"] or "")
        if grammar == "words" and want and want[0][:1].isspace() and want[0].strip():  # spaces at the start are a unit
            lead = want[0][: len(want[0]) - len(want[0].lstrip())]
            want = [lead, want[0][len(lead) :], *want[1:]]
        assert r["u"] == want and "".join(r["u"]) == (r["text"] or "")


# --- url filters -----------------------------------------------------------------------------------------------------


def plain_urls(rows):
    """(page_id, host, path, rule, verdict, trust, distrust) by dense loops."""
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    judged = []
    for page, url, html in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        judged.append((page, host, path, best, {low(x) for x in re.findall(r"""href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)""", html or "", re.I)}))
    edge, pages, seeds = defaultdict(float), defaultdict(int), {"allow": defaultdict(int), "block": defaultdict(int)}
    for _, host, _, best, targets in judged:
        if host:
            pages[host] += 1
            if best:
                seeds[best.verdict][host] += 1
            for t in targets | {host}:
                edge[host, t] += 1
    known = {x for e in edge for x in e}
    for host in known:
        above = [".".join(host.split(".")[i:]) for i in range(1, host.count(".") + 1)]
        parent = next((p for p in above if p in known), None)
        if parent is not None:
            edge[host, parent] += 1
            edge[parent, host] += 1
    scores = {}
    for kind, forward in (("allow", True), ("block", False)):
        out = defaultdict(dict)
        for (a, b), n in edge.items():
            if a != b:
                out[a if forward else b][b if forward else a] = n

        def ranks(seed):
            score = dict(seed)
            for _ in range(urls.STEPS):
                got = defaultdict(float)
                for h in known:
                    to = out[h] or {h: 1}
                    for t, n in to.items():
                        got[t] += score[h] * n / sum(to.values())
                score = {h: 0.15 * seed[h] + 0.85 * got[h] for h in known}
            return score

        base = ranks(dict.fromkeys(known, 1.0))
        scores[kind] = {h: x / base[h] for h, x in ranks({h: seeds[kind][h] / pages[h] if pages[h] else 0.0 for h in known}).items()}
    for page, host, path, best, _ in judged:
        t, d = (scores["allow"][host], scores["block"][host]) if host else (None, None)
        verdict = best.verdict if best else "block" if host and round(d - t, 9) > urls.BALANCE else "allow"
        yield page, host, path, best and best.text, verdict, t, d


def made_pages():
    rng = random.Random(5)
    hosts = ["spam.example.com", "shop.example.com", "a.b.example.org", "example.org", "b.example.org", "x.net", "www.example.net", "example.net", "Friend.Example.COM", "hub.info", "notexample.net.info"]
    rows = []
    for i in range(300):
        host = hosts[min(rng.randrange(len(hosts)), rng.randrange(len(hosts)))]
        lang = "de" if host.startswith("spam") and rng.random() < 0.9 else rng.choice(["en", "fr", "de"])
        links = "".join(f'<a href="{rng.choice(["http://", "//", "HTTPS://"])}{rng.choice(hosts)}/p?q">x</a>' for _ in range(rng.randrange(3)))
        if host == "hub.info":
            links = "<a href='http://spam.example.com/'>" + "<a href=//only.linked.example/>"
        rows.append((i, f"http://{host}/{lang}/{i}{rng.choice(['', '#x', '?u=http://y.net/'])}", f'<a href="/own">{links}'))
    odd = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "x://UPPER.NET/A?b://c/", "http://example.com/de/", "http://example.com/de", "http://sub.example.com/de/1", "http://a.org?/fr/", "http://a.org/fr/", "http://é.Org/fr/x", "http://xorg/fr/", "a\n://b.net/\n#"]
    return rows + [(1000 + i, u, None if i % 2 else "<a href=") for i, u in enumerate(odd)] + [rows[0], (None, "http://q.org/fr/", "")]


@pytest.mark.parametrize("chunk", [10_000, 2])
def test_url_filter(spark, monkeypatch, chunk):
    monkeypatch.setattr(urls, "CHUNK", chunk)
    rows = made_pages()
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, host string").repartition(4)
    key = lambda r: (str(r[0]), r[1])
    got, want = sorted((tuple(r) for r in urls.judge(df).collect()), key=key), sorted(plain_urls(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for r, w in zip(got, want) for a, b in zip(r[5:], w[5:]))
    assert urls.judge(df.where("false")).count() == 0


def test_who_links_to_blocked_hosts_is_blocked(spark):
    """far.info links to near.info, which links to a blocked host; fan.info links to an allowed one; alone.info to none."""
    rows = [("spam.example.com", "/de/", ""), ("near.info", "/x", "spam.example.com"), ("far.info", "/x", "near.info"), ("fan.info", "/x", "good.org"), ("good.org", "/fr/", ""), ("alone.info", "/", "")]
    pages = [(i, f"http://{h}{p}{i}", f"<a href='//{to}/'>" if to else "") for i, (h, p, to) in enumerate(rows * 3)]
    pages += [(100, "http://good.org/en/1", ""), (101, "http://spam.example.com/en/1", "")]
    got = {r["host"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect() if r["rule"] is None}
    assert {h: r["verdict"] for h, r in got.items()} == {"near.info": "block", "far.info": "allow", "fan.info": "allow", "alone.info": "allow", "good.org": "allow", "spam.example.com": "block"}
    assert got["far.info"]["distrust"] > 0 and got["fan.info"]["distrust"] == 0 and got["good.org"]["trust"] > 0.3


def test_no_rules_and_no_links(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in urls.judge(df, rules=()).collect()] == [(1, "a.net", "/x", None, "allow", 0.0, 0.0)]


# --- whitening -------------------------------------------------------------------------------------------------------


def plain_whitening(rows, most=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:most]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(400, 20)) @ np.diag(np.linspace(3, 0.2, 20)) + 5
    m[100:250] = m[0]  # a third of all rows are copies
    bad = [None, [], [1.0] * 19 + [None], [1.0] * 19 + [float("nan")], [1.0] * 19 + [float("-inf")], [1.0, 2.0]]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(m)] + [(1000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(7)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    ids, n, deviation, white, share = plain_whitening(rows[:400])
    assert got.vec_id.to_list() == [i for i in ids for _ in range(16)] and got.component.to_list() == list(range(1, 17)) * 400
    assert set(got.n) == {n} and (got.deviation.to_numpy()[::16] == deviation).all()
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(-1, 16)), np.abs(white), atol=1e-9)
    assert np.allclose(got.explained[:16], share) and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    distinct = got.groupby("vec_id").first().index.isin([0, *range(1, 100), *range(250, 400)])
    w = got.whitened.to_numpy().reshape(-1, 16)[distinct]
    assert np.allclose(w.T @ w / len(w), np.eye(16), atol=1e-9)  # same signs in all rows
    assert whitening.whiten(df.where("false")).count() == 0


def test_merging_is_exact_for_far_means():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (1000, 4)) + 10**9
    parts = [whitening.moments(p) for p in np.array_split(x, 13)]
    held = None
    for p in parts:
        held = whitening.merged(held, p)
    n, sums, mean, scatter = held
    c = x - x.mean(axis=0)
    assert n == 1000 and (sums == x.sum(axis=0)).all() and np.allclose(scatter, c.T @ c, rtol=1e-11, atol=1e-6)


def test_vectors_without_variance_and_very_large_ones(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, 0.0, 0.0)}
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 8 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None} and all(r["whitened"] is not None for r in got if r["component"] == 1)
