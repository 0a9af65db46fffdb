import duckdb
import numpy as np

from tessera.llm import urls

ENTRIES = [*urls.RULES, *((h, urls.LISTED) for h in urls.BLOCKED_HOSTS), ("a.b.net/x", urls.ALLOW), ("net", urls.LISTED), ("", 2), (None, 2), ("org/", urls.LISTED)]
URLS = [
    "http://Foo.Example.ORG/es/1?x", "https://example.org/en/123", "https://example.org/en/2", "http://notexample.org/es/", "https://x.com/fr/1", "https://x.com/de", "https://x.com/de/#a/b",
    "http://spam-farm.example.org", "http://a.spam-farm.example.org?/x", "http://www.cheap-pills.example.com/en/", "http://cheap-pills.example.com/fr/", "http://xcheap-pills.example.com/", "HTTP://ORG/",
    "a.b.net/x", None, "", "://", "://?q", "http://a.b.net/xyz", "http://c.a.b.net/y", "http://İ.com/fr/É", "ftp://u:p@h.org:80/es/://x", "http://org", "http://.org/x", "http://x.com/de/" + "long/" * 20000,
]


def brute(url):
    host, path = urls.split_url(url)
    rules = {e: a for e, a in ENTRIES if e and a}
    fits = [e for e in rules if host and (host == e.split("/")[0] or host.endswith("." + e.split("/")[0])) and path.startswith(e[len(e.split("/")[0]) :])]
    if fits:
        rule = max(fits, key=len)
        return host, path, rule, "block" if rules[rule] == urls.BLOCK else "allow"
    listed = [e for e, a in ENTRIES if e and not a and "/" not in e]
    return host, path, None, "block" if any(host == e or host.endswith("." + e) for e in listed) else "allow"


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "FILE_ENTRIES", 2)
    index = urls.build_index(spark.createDataFrame(ENTRIES, "entry string, action int"))
    assert index.bits
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], "x")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), index).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute(u)) for i, u, _ in rows), key=key)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), index).collect() == []


def test_collisions_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digests", lambda keys: np.full(len(keys), 7, np.uint64))
    (tmp_path / "f").write_bytes(urls.pack([(b"one", [1]), (b"two", [2, 5])]))
    held = urls.DigestFile(f"file://{tmp_path}/f")
    assert held.find(np.array([7, 7, 7], np.uint64), [b"two", b"one", b"three"]) == [[2, 5], [1], None]


def test_no_entries(spark):
    index = urls.build_index(spark.createDataFrame([], "entry string, action int"))
    got = urls.judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), index).collect()
    assert [tuple(r) for r in got] == [(1, "a.org", "/", None, "allow")]


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, urls.op6_url_filters(spark, sf).collect())) == sorted(con.sql("SELECT page_id, host, path, rule, verdict FROM (" + urls.op6_sql() + ")").fetchall())


def test_many_lengths_of_paths(spark):
    """Of a host without entries nothing but the host is looked up, however many lengths other hosts have."""
    entries = [(f"long.org/{'x' * n}", urls.BLOCK) for n in range(1, 400)] + [("plain.net/", urls.ALLOW)]
    index = urls.build_index(spark.createDataFrame(entries, "entry string, action int"))
    assert urls.judge(index, [("a.long.org", "/" + "x" * 250 + "y"), ("long.org", "/y"), ("plain.net", "/" + "x" * 300)]) == [("long.org/" + "x" * 250, "block"), (None, "allow"), ("plain.net/", "allow")]
    seen = []
    real, urls.lookup = urls.lookup, lambda i, keys: seen.extend(keys) or real(i, keys)
    try:
        urls.judge(index, [("a.plain.net", "/" + "x" * 300)])
    finally:
        urls.lookup = real
    assert sorted(seen) == [b"/a.plain.net", b"/net", b"/plain.net", b"plain.net/"]
