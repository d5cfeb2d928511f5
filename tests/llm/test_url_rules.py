import random
import re
from collections import Counter
from itertools import combinations

from trailmark.llm import url_rules


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def rule_of(host, path):
    fits = [
        (len(h + p), h + p, v) for h, p, v in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def tokens(url):
    host, path = split_url(url)
    query = re.match(r"(?s).*?://[^/?#]*[^?#]*\??([^#]*)", url)[1]
    out = [f"h={x}" for x in host.split(".") if x]
    out += [f"p={x}" for x in re.sub("[0-9]+", "#", path).split("/") if x]
    return set(out + [f"q={x}" for x in re.sub("=[^&]*", "", query).split("&") if x])


def plain(rows):
    seen = [(p, u, *split_url(u)) for p, u in rows]
    own = [rule_of(h, p) for _, _, h, p in seen]
    baskets = [(frozenset(tokens(u)), v) for (_, u, h, _), (_, v) in zip(seen, own) if h]
    everything, blocked = Counter(), Counter()
    for b, v in baskets:
        for n in range(1, len(b) + 1):
            for c in combinations(sorted(b), n):
                everything[c] += 1
                blocked[c] += v == "block"
    least = url_rules.SUPPORT * len(baskets)
    good = [c for c, n in blocked.items() if n >= least and n and n / everything[c] >= url_rules.CONFIDENCE]
    good = [c for c in good if not any(set(d) < set(c) for d in good)]
    out = []
    for (page, url, host, path), (rule, verdict) in zip(seen, own):
        mined = None
        if not verdict and host:
            mined = min((" ".join(c) for c in good if set(c) <= tokens(url)), default=None)
        out.append((page, host, path, rule, verdict or ("block" if mined else "allow"), mined))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, rule string")
    return sorted(map(tuple, url_rules.judge(df).collect()), key=repr)


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.collect()]
    got = run(spark, rows)
    assert got == plain(rows)
    assert {r[5] is not None for r in got} == {True, False}


def test_edge_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/net/"), (4, "a://b.net"), (5, "a://b.net/"), (6, "a://B.NET/x"), (7, "a://net/"),
            (8, "a://xnet/"), (9, "a://example.net/en/1"), (10, "a://example.net/en"), (11, "a://q.example.com/de/?x=1#y"),
            (12, "a://h?x://b.net/c"), (13, "a://h#://b.net/"), (14, "://org/fr/"), (15, "a://\u00c9x.org/fr/"), (None, "a://b.net/"),
            (5, "a://b.net/"), (16, "a://h.net/line\nbreak?q"), (17, "http://"), (18, "a://z.org/" + "deep/" * 3000)]
    got = run(spark, rows)
    assert [r for r in got if r[0] != 18] == plain([r for r in rows if r[0] != 18])
    assert [r[4] for r in got if r[0] == 18] == ["allow"]


def test_nothing_labelled_or_empty(spark):
    assert run(spark, [(1, "a://b.com/x")]) == [(1, "b.com", "/x", None, "allow", None)]
    assert run(spark, []) == []


def test_many_shared_tokens(spark):
    """URLs that share 40 path segments: blocked ones alone, and as many of each kind, where none is a rule."""
    path = "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    blocked = [(i, f"http://a{i}.net/{path}/k") for i in range(60)]
    got = run(spark, blocked + [(100, f"http://b.com/{path}"), (101, "http://c.com/x")])
    assert {r[0]: r[4] for r in got if r[0] >= 100} == {100: "block", 101: "allow"}
    both = blocked + [(100 + i, f"http://b{i}.com/{path}") for i in range(60)]
    assert {r[4] for r in run(spark, both) if r[0] >= 100} == {"allow"}


def test_twins_and_pairs(spark):
    """Combinations of tokens that are no rules alone, some of them twins, against every combination."""
    rows = []
    for i in range(40):
        rows.append((len(rows), f"http://x{i}.net/a/b/c"))  # blocked: a and b are twins, with c a rule
        rows.append((len(rows), f"http://x{i}.com/a/b"))
        rows.append((len(rows), f"http://x{i}.com/c/d"))
    rows += [(len(rows) + i, f"http://y{i}.com/{p}") for i, p in enumerate(["a/b/c", "c/b/a/d", "a/b", "c", "d/a/b"])]
    got = run(spark, rows)
    assert got == plain(rows) and any(r[5] and " " in r[5] for r in got)


def random_rows(k, n=60, seed=2):
    """URLs that each hold most of ``k`` segments, half of them blocked by host: nothing is a rule alone, nor a twin."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        some = [f"seg{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(k) if rnd.random() < 0.85]
        out.append((i, ("http://a.net/" if i % 2 else "http://b.info/") + "/".join(some)))
    return out


def test_levels_equal_growth_and_brute_force(spark, monkeypatch):
    rows = random_rows(9)
    want = plain(rows)
    for wide in (0, 99):
        monkeypatch.setattr(url_rules, "WIDE", wide)
        assert run(spark, rows) == want
    rows = [(i, f"http://b.info/{'/'.join('xyzw'[:1 + i % 4])}/{i % 3}" if i % 5 else f"http://c.net/x/y/{i}") for i in range(80)]
    monkeypatch.setattr(url_rules, "WIDE", 0)
    assert run(spark, rows) == plain(rows)
