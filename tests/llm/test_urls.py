import datetime
import random

from evidex.llm import urls

D = datetime.date


def test_hosts(spark):
    rows = ["http://A.Example.com./x", "https://u:p@h.org:80/", "no url", "", None, "ftp://x?y", "http://[::1]/", "http://a.b#c"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "url string").select(urls.host(urls.F.col("url"))).collect()]
    assert got == ["a.example.com", "h.org", "", "", "", "x", "[", "a.b"]


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    domains = ["a.com", "b.a.com", "com", "x.org", "c.b.a.com"]
    entries = [(r.choice(domains), r.choice(["block", "allow"]), r.choice(["p", "q"]), r.choice(["add", "remove"]), str(D(2024, 1, 1) + datetime.timedelta(r.randint(0, 40)))) for _ in range(60)]
    entries += entries[:5] + [(None, "block", "p", "add", "2024-01-01"), ("x.org", "block", "p", "add", None)]
    hosts = [*domains, "z.c.b.a.com", "ya.com", "other.net"]
    captures = [(i, f"http://{r.choice(hosts)}/p{i}", D(2024, 1, 1) + datetime.timedelta(r.randint(-2, 45))) for i in range(500)]
    captures += [(900, None, D(2024, 1, 5)), (901, "http://a.com", None), (901, "http://a.com", None)]

    def want(url, day):
        if not url or not day:
            return None
        host = url.split("/")[2]
        best = None
        for domain, kind, category, _, _ in {e[:3] + ("", "") for e in entries if e[0] and e[4]}:
            if host != domain and not host.endswith("." + domain):
                continue
            own = sorted((e[4], e[3]) for e in set(entries) if e[:3] == (domain, kind, category) and e[4] and e[4] <= str(day))
            if own and own[-1][1] == "add":
                best = max(best or (0,), (len(domain), own[-1][0], kind, category, domain))
        return best

    df = spark.createDataFrame([(*c, "c") for c in captures], "page_id long, url string, fetched date, domain string")
    for most in (200_000, 0):
        monkeypatch.setattr(urls, "BROADCAST", most)
        got = urls.judge(df, spark.createDataFrame(entries, "domain string, kind string, category string, action string, day string")).collect()
        assert len(got) == len(captures)
        by = {}
        for x in got:
            by[x.page_id] = x
        for i, u, d in captures:
            w = want(u, d)
            assert (by[i].domain, by[i].category, by[i].blocked) == ((w[4], w[3], w[2] == "block") if w else (None, None, False)), (i, u, d)
    empty = spark.createDataFrame([], "domain string, kind string, category string, action string, day string")
    assert not any(r.blocked for r in urls.judge(df, empty).collect())
    assert urls.judge(df.limit(0), empty).count() == 0
