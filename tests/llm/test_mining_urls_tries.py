"""Hard negatives, URL filters and prefix tries against brute force, on hard rows too."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, prefix_trie, queries, url_filters

CLASH = ("score", "rank", "held", "wanted", "dims", "block", "host", "rule", "trust", "depth", "parent", "ids", "key", "id", "size", "n")


# -- hard negatives -----------------------------------------------------------------------------------------


def mined(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (v, label)), (v, label))
    whole = {i: ([math.floor(x * scale) for x in v], label) for i, (v, label) in kept.items()}
    out = []
    for a, (v, label) in whole.items():
        if not is_anchor(a):
            continue
        by = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (w, m) in whole.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in by if x[2] == label][:positives]:
            fit = [x for x in by if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)


def vectors():
    rng = random.Random(3)
    near = lambda base: [x + rng.gauss(0, 0.3) for x in base]
    bases = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, near(bases[i % 4]), rng.randrange(3)) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8, i % 2) for i in range(90)]  # ties, and a hot vector
    rows += [(2000 + i, [rng.uniform(0, 2e5) for _ in range(8)], i % 2) for i in range(30)]
    rows += [(3000 + i, [1.0] * (i % 3), 1 + i % 2) for i in range(20)]  # other lengths, empty ones too
    rows += [(10, [9.0] * 8, 1), (10, [9.0] * 8, 1), (20, bases[0], 0)]  # ids again
    rows += [(None, [1.0] * 8, 1), (4000, None, 1), (4020, [1.0] * 8, None), (4040, [1.0, None] * 4, 1), (4060, [float("nan")] * 8, 1), (4080, [float("inf")] * 8, 0), (4100, [0.0] * 8, 0), (-20, [1.0] * 8, 1)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 16, "GRID_BLOCKS": 3, "KEPT_BYTES": 20_000}, {"BLOCK": 16, "BROADCAST_BYTES": 3000}])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(hard_negatives, name, size)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(7).withColumns({c: F.lit(1) for c in CLASH})
    found = hard_negatives.mine(df, F.col("vec_id") % 20 == 0)
    want = mined(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hard_negatives_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(2**29, 2**29 + 50)) for _ in range(5)], i % 2) for i in range(120)]  # sums pass 2^53 and differ in their last bits
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 20 == 0, high=100, scale=1).collect()))
    assert got == mined(rows, lambda i: i % 20 == 0, high=100, scale=1) and max(r[4] for r in got) > 2**53
    huge = spark.createDataFrame([(i, [1e300, -1e300], i % 2) for i in range(30)], "vec_id bigint, embedding array<double>, label int")
    assert hard_negatives.mine(huge, F.col("vec_id") % 20 == 0).count() >= 0


def test_hard_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0], 1)], none.schema)
    assert hard_negatives.mine(one, F.col("vec_id") % 20 == 0).count() == 0


def test_first_k_of_a_union_are_among_those_of_its_parts():
    rng = np.random.default_rng(5)
    scores, ids = rng.integers(-3, 3, (7, 200)), rng.permutation(200)
    fit = rng.random((7, 200)) < 0.6
    best = hard_negatives.Best(7, 6)
    for part in np.array_split(np.arange(200), 9):
        part = part[np.argsort(ids[part])]
        best.add(scores[:, part], ids[part], fit[:, part])
    for i in range(7):
        want = sorted((-scores[i, j], ids[j]) for j in range(200) if fit[i, j])[:6]
        assert [(-s, d) for s, d in zip(best.score[i], best.id[i])] == want


# -- URL filters --------------------------------------------------------------------------------------------

RULES = queries.RULES


def judged(pages, rules, rounds=url_filters.ROUNDS):
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        return lower(host), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def rule(host, path):
        fit = [(len(r.host + r.path), r.host + r.path, r.verdict) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit)[1:] if fit else (None, None)

    rows = [(i, *split(url), html) for i, url, html in pages]
    hosts = {h for _, h, _, _ in rows if h}
    edges = set()
    for _, h, _, html in rows:
        for part in (html or "").split('href="')[1:]:
            link = part.split('"')[0]
            to = lower(link.split("//", 1)[1].split("/")[0].split("?")[0]) if link.startswith(("//", "http://", "HTTPS://", "https://")) else ""
            if h and to and to != h:
                edges.add((h, to))
    for h in hosts:
        up = h.partition(".")[2]
        if up in hosts:
            edges |= {(h, up), (up, h)}
    rank = {}
    for bad, verdict in ((False, "allow"), (True, "block")):
        n = Counter(h for _, h, p, _ in rows if rule(h, p)[1] == verdict)
        own = [(b, a) if bad else (a, b) for a, b in edges]
        degree = Counter(a for a, _ in own)
        start = {h: k * url_filters.MASS // sum(n.values()) for h, k in n.items()}
        now = dict(start)
        for _ in range(rounds):
            new = defaultdict(int, {h: r * (100 - url_filters.DAMPING) // 100 for h, r in start.items()})
            for a, b in own:
                if a in now:
                    new[b] += now[a] * url_filters.DAMPING // 100 // degree[a]
            now = new
        rank[bad] = now
    out = []
    for i, h, p, _ in rows:
        name, verdict = rule(h, p)
        trust, bad = rank[False].get(h, 0), rank[True].get(h, 0)
        out.append((i, h, p, name, verdict or ("block" if 100 * bad > url_filters.THRESHOLD * trust else "allow"), trust, bad))
    return sorted(out, key=str)


def web():
    rng = random.Random(6)
    hosts = [f"{s}{a}.{d}" for a in ("one", "two", "three", "four") for s in ("", "www.", "m.") for d in ("example.com", "example.net", "example.org", "com", "net")] + ["Com", "www.example.com", "EXAMPLE.com", "notexample.com", "xcom", "hub.org"]
    pages = []
    for i in range(500):
        links = "".join(f'<a href="{rng.choice(["http://", "https://", "//", "HTTPS://"])}{rng.choice(hosts)}{rng.choice(["", "/x", "?q"])}">x</a>' for _ in range(rng.randrange(3)))
        host = "hub.org" if i % 3 == 0 else rng.choice(hosts)
        pages.append((i, f"http://{host}{rng.choice(['', '/', '/en/a', '/es/b?x#y', '/fr/', '/en', '?q=://', '#/en/'])}", f"<p>{links}<a href='/local'>y</a>"))
    pages += [(600, "https://far.org/x", '<a href="http://farther.org">'), (601, "https://farther.org/x", '<a href="https://bad.net/es/">'), (602, "https://bad.net/es/1", None)]
    pages += [(700, None, None), (701, "", ""), (702, "no scheme", '<a href="http://hub.org">'), (703, "://", ""), (704, "a://b://c/en/", ""), (None, "http://x.com/", ""), (705, "http://x.com/" + "y" * 300_000, "z" * 300_000), (706, "http://x.com:80/en/", ""), (706, "http://x.com:80/en/", ""), (707, "x\ny://a.COM/\nb", "")]
    return pages


def test_url_filters(spark):
    pages = web()
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5).withColumns({c: F.lit(1) for c in CLASH})
    got = sorted(map(tuple, url_filters.judge(df, RULES).collect()), key=str)
    assert got == judged(pages, RULES)
    by = {r[0]: r for r in got}
    assert by[600][4] == by[601][4] == "block" and by[600][3] is None and by[600][6] > 0  # who links to a blocked host, at first and second hand
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
    assert [by[i][1:5] for i in (700, 701, 702, 703, 704)] == [("", "", None, "allow")] * 4 + [("b:", "//c/en/", None, "allow")]


def test_url_filters_join_large_tables(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST", 3)
    pages = web()
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert sorted(map(tuple, url_filters.judge(df, RULES).collect()), key=str) == judged(pages, RULES)


def test_url_filters_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filters.judge(none, RULES, 2).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/es/", "")], none.schema)
    assert [r.verdict for r in url_filters.judge(one, [], 2).collect()] == ["allow"]


# -- prefix tries -------------------------------------------------------------------------------------------


def tried(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not below[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], digest(p)) for p, m in list(members.items()))


def talks():
    rng = random.Random(7)
    rows = []

    def talk(c, turns):
        rows.extend((c, i, r, t) for i, (r, t) in enumerate(turns))

    say = lambda n: [("user" if i % 2 == 0 else "assistant", rng.choice(["yes", "no", "maybe", "ünd 𝄞", ""]) + str(rng.randrange(3))) for i in range(n)]
    for c in range(300):
        talk(c, say(rng.randrange(1, 8)))
    shared = say(40)
    for c in range(1000, 1060):
        talk(c, shared + say(rng.randrange(0, 4)))
    for c in range(2000, 2200, 3):  # copies, also of a conversation that is another's beginning
        talk(c, shared[:5])
    talk(3000, say(2500))
    talk(3001, [("user", "x" * 200_000)])
    talk(-150, say(3))
    talk(-100, say(4))
    rows += [(4000, None, None, None), (4000, 0, "user", None), (4000, 0, "user", "b"), (4000, 0, "user", "b"), (4000, 0, "a", "z"), (4100, 5, "a", "ab"), (4200, 5, "aa", "b"), (None, 0, "user", "lost"), (4301, 3, "user", "only")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"LOCAL_CLASSES": 3, "LOCAL_TURNS": 30, "CHUNK": 4, "BROADCAST": 2}, {"LOCAL_CLASSES": 20, "CHUNK": 7}])
def test_prefix_trie(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(prefix_trie, name, size)
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5).withColumns({c: F.lit(1) for c in CLASH})
    got = sorted(map(tuple, prefix_trie.prefix_trie(df).collect()))
    assert got == tried(rows)


def test_prefix_trie_of_few_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0
    rows = [(c, 0, "user", "a") for c in (4301, 4302, 4303, 4304)]  # some have no turns left
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, kind)).collect())) == tried(rows)


def test_quicksort_enters_each_prefix_once():
    rng = random.Random(8)
    ids = list({tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    seen, left = {}, {}

    def enter(parent, d, members):
        prefix = ids[members[0]][:d]
        assert prefix not in seen and all(ids[i][:d] == prefix for i in members) and (parent is None) == (d == 1)
        assert parent is None or parent == prefix[:-1]
        seen[prefix] = sorted(members)
        return prefix

    prefix_trie.quicksort(ids, list(range(len(ids))), 0, enter, lambda node, i: left.update({i: node}))
    assert seen == {p: sorted(i for i, x in enumerate(ids) if x[: len(p)] == p) for p in {x[:d] for x in ids for d in range(1, len(x) + 1)}}
    assert left == dict(enumerate(ids))
