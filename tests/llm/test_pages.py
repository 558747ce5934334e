"""URL filters and main-text extraction."""

import fnmatch
import html
import random
import re

import pytest
from compare import connect, difference

from loadspan.llm import html_template, url_automaton
from loadspan.llm.queries import ORACLES

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://www.example.com/en/x", "http://a.www.example.com/en/",
        "http://example.com/en/1?x=http://b.net/es/", "http://example.com", "https://x.example.com/", "ftp://net/es/", "http://bnet/es/",
        "http://b.net/fr/1#top", "http://b.net/frx", "http://b.org/www.example.com/en/", "http://host?x/en/", "http://É.com/ü", "a://b://c/d",
        "http://my-casino.example.org/", "http://x.org/a.exe", "http://x.org/" + "y" * 50000, "http://b.net/fr/1", "http://b.net/fr/1"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        tail = rest[len(host):]
        path = re.match(r"[^?#]*", tail)[0] if tail.startswith("/") else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_automaton.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    bad = any(fnmatch.fnmatchcase(f".{host}{path}", g) for g in url_automaton.GLOBS)
    return host, path, None, "block" if bad else "allow"


def test_urls_match_brute_force(spark, given):
    rows = [(i, u, -1) for i, u in enumerate(URLS)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, rule int").repartition(2)
    got = {r.page_id: tuple(r)[1:] for r in url_automaton.judge(frame).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    pages = given("pages").collect()
    got = {r.page_id: tuple(r)[1:] for r in url_automaton.judge(given("pages")).collect()}
    assert got == {r.page_id: brute(r.url) for r in pages}
    assert url_automaton.judge(frame.where("false")).count() == 0


def test_urls_match_sql_on_odd_rows(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = url_automaton.judge(frame).toPandas()
    pages = frame.toPandas()  # noqa: F841  read by the SQL below
    import duckdb

    want = duckdb.connect().execute(ORACLES["op10_url_filters"]).df()
    assert difference(got, want) is None


def test_registered_sql(spark, sf_dir):
    from loadspan.llm.queries import op10_url_filters

    got = op10_url_filters(spark, sf_dir).toPandas()
    assert difference(got, connect(sf_dir).execute(ORACLES["op10_url_filters"]).df()) is None


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_globs(seed):
    rng = random.Random(seed)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(80)]
    found = url_automaton.Automaton(globs).matches([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert found[i, j] == fnmatch.fnmatchcase(text, glob), (text, glob)
    assert url_automaton.Automaton([]).matches([b"x"]).shape == (1, 0)


def extracted(spark, pages):
    frame = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string, host string")
    return {r.page_id: r.text for r in html_template.extract(frame.repartition(2)).collect()}


CASES = [
    (None, ""), ("", ""), ("plain &amp; simple\n text", "plain & simple text"), ("<p>a<p>b", "a\nb"), ("<p>a<br>b</p>", "a b"),
    ("<nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z</p></article><footer>f</footer>", "T\nx yz"),
    ("<article><p>a</p><div class='comments'><p>c</p></div><aside>s</aside><p>b</article>", "a\nb"),
    ("<article><p><b>one<br><p>two</p></article>", "one\ntwo"), ("<script>var t='</p><p>no'</script><p>yes</p>", "yes"),
    ("<style>p{}</style><!-- <p>no</p> --><p>yes &#233;&nbsp;x</p>", "yes é x"), ("<div class=ad>buy</div><div>keep</div>", "keep"),
    ("<div class='lead story'>keep</div><div id=\"cookie-notice\">no</div>", "keep"), ("<form><p>no</p></form><p>yes", "yes"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<p title='a > b'>x</p>", "x"), ("<p>open <a href='x", "open"),
    ("<p>1 < 2 & 3</p>", "1 < 2 & 3"), ("<main><header><h1>H</h1></header><p>t</p></main><p>out</p>", "H\nt"), ("<p>" + "w " * 50000, ("w " * 50000).strip()),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("</p></div>x<p></p>", "x"), ("<article></article><p>out</p>", "out"),
    ("<article><p>sum <math><mi>x</mi></math> of</p><div class='related'>part of the story</div></article>", "sum x of\npart of the story"),
]


def test_cases(spark):
    got = extracted(spark, [(f"http://h{i}.org/", page) for i, (page, _) in enumerate(CASES)])
    for i, (page, want) in enumerate(CASES):
        assert got[i] == want, page and page[:80]


def test_template_subtrees_go_and_articles_stay(spark):
    box = "<div><div><p>Read our offers</p></div><p>Since 1990</p></div>"
    pages = [("http://a.org/1", f"{box}<div><p>own text {i}</p></div>") for i in range(8)]
    pages += [("http://b.org/1", f"{box}<div><p>other text</p></div>"), (None, box)]
    pages += [("http://c.org/1", "<article><p>the same passage</p></article>")] * 8
    got = extracted(spark, pages)
    assert [got[i] for i in range(8)] == [f"own text {i}" for i in range(8)]
    assert got[8] == "Read our offers\nSince 1990\nother text" and got[9] == "Read our offers\nSince 1990"
    assert {got[i] for i in range(10, 18)} == {"the same passage"}


def test_boxes_inside_articles_go_and_copies_stay(spark):
    box = "<div class='box'><p>Subscribe to our letter</p></div>"
    pages = [("http://a.org/1", f"<main>{box}<div><p>own text {i}</p><p>a line all have</p></div></main>") for i in range(40)]
    copied = "<article><div><p>first part</p></div><section>second part</section></article>"
    pages += [("http://b.org/1", copied)] * 30 + [("http://b.org/2", f"<article><p>other {i}</p></article>") for i in range(5)]
    got = extracted(spark, pages)
    assert [got[i] for i in range(40)] == [f"own text {i}\na line all have" for i in range(40)]
    assert {got[i] for i in range(40, 70)} == {"first part\nsecond part"}


@pytest.mark.parametrize("seed", range(3))
def test_templates_equal_counts_of_every_host(spark, seed):
    rng = random.Random(seed)
    parts = [f"<div><p>{w}</p></div>" for w in "abcdefgh"]
    pages = []
    for _ in range(120):
        host = rng.choice(["x.org", "y.org", "y.org", "z.org"])
        outer, inner = rng.choices(parts, k=2), rng.choices(parts[:3], k=2)
        pages.append((f"http://{host}/", f"{''.join(outer)}<article>{''.join(inner)}<p>{rng.randrange(40)}</p></article>"))
    hosts = {html_template.page_host(u) for u, _ in pages}
    want = {}
    for host in hosts:
        parsed = [html_template.blocks(p) for u, p in pages if html_template.page_host(u) == host]
        bodies = [" ".join(b[0] for b in found if b[1]) for found in parsed]
        for at in (3, 4):
            for key in {k for found in parsed for b in found for k in b[at]}:
                on = [i for i, found in enumerate(parsed) if any(key in b[at] for b in found)]
                different = len({html_template.signed(html_template.xxhash.xxh64_intdigest("\n".join(b[0] for b in parsed[i] if b[1]))) & 63 for i in on})
                assert different <= len({bodies[i] for i in on})
                if len(on) >= 5 and (len(on) >= 0.1 * len(parsed) if at == 3 else len(on) >= 0.5 * len(parsed) and different >= 5):
                    want.setdefault(host, set()).add(key)
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    got = {r.host: set(r.hashes) for r in html_template.templates(frame).collect()}
    assert got == want and sum(map(len, want.values())) > 10


def test_rows_that_repeat_and_null_ids_are_kept(spark):
    frame = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>")] * 2 + [(None, None, "<p>y</p>"), (None, "http://a.org/", None)], "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_template.extract(frame).collect()), key=str)
    assert got == [(1, "x", 1), (1, "x", 1), (None, "", 0), (None, "y", 1)]


def test_whole_table(given):
    got = {r.page_id: r for r in html_template.extract(given("pages")).collect()}
    for r in given("pages").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_empty_table(given):
    assert html_template.extract(given("pages").where("false")).count() == 0
