import re

from docketry.llm.urlfilter import BLOCKED, RULES, GlobAutomaton, filter_urls


def glob_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "\\Z"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for action, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    if fits:
        _, rule, action = max(fits)
        return host, path, rule, action
    hit = not host or any(re.match(glob_regex(g), host + path) for g in BLOCKED)
    return host, path, None, "block" if hit else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://Blog.Example.ORG/es/1?x#y", "http://example.org", "http://example.org?/es/",
    "http://xexample.org/es/", "http://a.example.org/en/12", "http://a.example.org/en/2", "ftp://com/de/", "http://x.com/de",
    "http://x.com/fr/1", "http://.org/", "http://x.net/login.php", "http://x.net/a/setup.exe?v=1", "http://my-spam.net/", "http://ads.x.net/a", "http://x.net/ads.a/b", "http://x.net/a.js", "http://x.net/a.json", "http://x.net/cart", "http://x.net/carts",
    "http://x.net/spam", "http://spam.net", "http://x.net/a://b", "http://É.net/ü", "http://x.net/" + "a/" * 5000 + "x.zip",
]


def test_matches_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS * 3)] + [(None, "http://x.org/", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(3)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert got == {(i, *brute(u)) for i, u, _ in rows}


def test_few_states_at_once_give_the_same(monkeypatch):
    import numpy as np

    from docketry.llm import urlfilter

    texts = [(u or "").encode() for u in URLS * 9]
    flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = GlobAutomaton(BLOCKED).match(flat, offsets)
    monkeypatch.setattr(urlfilter, "STATES", 1)
    assert (GlobAutomaton(BLOCKED).match(flat, offsets) == whole).all() and len(whole) == len(texts)


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_automaton_spans_many_words():
    import numpy as np

    globs = [f"host{i}.*/**/p?{i}" for i in range(50)]
    texts = [f"host{i}.net/a/b/px{i}".encode() for i in range(50)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hit = GlobAutomaton(globs).match(np.frombuffer(b"".join(texts), np.uint8), offsets)
    want = [[bool(re.match(glob_regex(g), t.decode())) for g in globs] for t in texts]
    assert hit.tolist() == want and np.diag(hit).all()
