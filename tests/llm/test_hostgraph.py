import random
import re

from tests.llm.helpers import SF, matches_sql
from tidemark.llm import hostgraph
from tidemark.llm.queries import ORACLES, QUERIES, URL_RULES


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2])


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def ranks(links, seeds, rule):
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()} if total else {}
    if not links:
        return start
    out, now = {}, dict(start)
    for (a, _), n in links.items():
        out[a] = out.get(a, 0) + n
    for _ in range(rule.rounds):
        new = {h: s * (1 - rule.damping) for h, s in start.items()}
        for (a, b), n in links.items():
            if a in now:
                new[b] = new.get(b, 0) + now[a] * n / out[a] * rule.damping
        now = new
    return now


def brute(rows, rule=hostgraph.SpreadRule()):
    links, allow, block = {}, {}, {}
    for _, url, html in rows:
        host, path = parse(url)
        r = ruled(host, path)
        if r and host:
            side = allow if r.verdict == "allow" else block
            side[host] = side.get(host, 0) + 1
        for to in re.findall(r"""(?is)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
            if host and to.lower() != host:
                links[host, to.lower()] = links.get((host, to.lower()), 0) + 1
    trust = ranks(links, allow, rule)
    distrust = ranks({(b, a): n for (a, b), n in links.items()}, block, rule)
    out = []
    for i, url, _ in rows:
        host, path = parse(url)
        r = ruled(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        spread = "block" if t + d > rule.floor and d > rule.threshold * (t + d) else "allow"
        out.append((i, host, path, r.name if r else None, r.verdict if r else spread))
    return sorted(out, key=str)


def judged(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], "page_id bigint, url string, html string, trust string, host string, rank string").coalesce(3)


def linked_rows():
    rng = random.Random(6)
    hosts = [f"{n}.example.{t}" for n in ("a", "b", "c", "d") for t in ("com", "org", "net", "info")]
    rows = []
    for i in range(150):
        html = "".join(rng.choice(['<a href="https://{}/x">', "<A HREF='//{}'>", "<a class=k href=http://{}>", '<a href="/own/{}">']).format(rng.choice(hosts).upper() if rng.random() < 0.1 else rng.choice(hosts)) for _ in range(rng.randrange(4)))
        rows.append((i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x'])}/{i}", html))
    return rows


def test_spread_matches_plain_iteration(spark):
    rows = linked_rows()
    found = judged(hostgraph.judge_pages(pages(spark, rows), URL_RULES))
    assert found == brute(rows)
    by_method = {r[4] for r in found if r[3] is None}
    assert by_method == {"allow", "block"}


def test_query_matches_sql(spark, tmp_path):
    matches_sql(QUERIES["op8_url_filter"](spark, SF), ORACLES["op8_url_filter"], SF)
    pages(spark, linked_rows()).select("page_id", "url", "html").toPandas().to_parquet(tmp_path / "pages.parquet")
    matches_sql(QUERIES["op8_url_filter"](spark, str(tmp_path)), ORACLES["op8_url_filter"], str(tmp_path))


def test_hard_rows(spark):
    rows = [
        (1, None, None), (2, "", "<a href=//x.net>"), (3, "no scheme/en/", ""), (4, "http://", None), (5, "HTTP://WWW.Example.COM/en/a?b#c", "x" * 500_000), (5, "HTTP://WWW.Example.COM/en/a?b#c", "x" * 500_000),
        (6, "http://example.com/EN/", None), (7, "a://b://example.com/en/", None), (8, "http://éx.net/es/\n1", None), (9, "http://notexample.com/en/", None), (10, "x://net/fr/", None), (11, "x://h?q=/en/#f", None), (None, "x://com", None),
    ]
    assert judged(hostgraph.judge_pages(pages(spark, rows), URL_RULES)) == brute(rows)
    assert hostgraph.judge_pages(pages(spark, []), URL_RULES).count() == 0
    assert {r[4] for r in judged(hostgraph.judge_pages(pages(spark, rows), ()))} == {"allow"}
