"""Neighbours over whole hosts, blocks that are apart, and markup that nothing closes."""

import random
import time

import pytest

from lexigauge.llm import pages

SCHEMA = "page_id long, url string, html string"


def page(own, template=("site menu", "site footer")):
    return f"<body><p>{template[0]}</p><p>{own}</p><p>{template[1]}</p></body>"


def test_a_page_alone_in_its_folder_has_its_neighbour(spark):
    rows = [(h * 100 + i, f"http://h{h}.org/{f}/{i}", page(f"own text of this page {h} {f} {i}", (f"menu of {h}", f"footer of {h}"))) for h in range(12) for f in "ab" for i in range(33)]
    rows += [(5000 + h, f"http://h{h}.org/c/x", page("own text that stands alone", (f"menu of {h}", f"footer of {h}"))) for h in range(12)]
    for run, parts in ((64, 1), (64, 40), (7, 4), (1000, 4), (1, 3)):
        got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA).repartition(parts), run=run).collect()}
        assert all(got[5000 + h] == "own text that stands alone" for h in range(12)) and len(got) == len({r[0] for r in rows})
        assert all(t.startswith("own text") and "\n" not in t for t in got.values())


def test_neighbours_by_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(150):
        url = rnd.choice([None, "", "no scheme", *(f"http://h{h}.org/{'/'.join(rnd.choice('ab') for _ in range(rnd.randint(0, 3)))}" for h in range(4))])
        rows.append((rnd.choice([None, i, i // 3]), url, rnd.choice([None, "", page(rnd.choice("xyzuvw") * rnd.randint(1, 4), rnd.choice([("m", "f"), ("n", "g")]))])))
    rows += rows[:20]

    def parts(url):
        host, _, path = (url or "").removeprefix("http://").partition("/") if (url or "").startswith("http://") else ("", "", url or "")
        return (host, "/" + path if (url or "").startswith("http://") and "/" in url[7:] else path)

    got = [tuple(r)[:3] for r in pages.main_text(spark.createDataFrame(rows, SCHEMA), run=5).collect()]
    assert sorted((i is None, i or 0, u or "") for i, u, _ in got) == sorted((i is None, i or 0, u or "") for i, u, _ in rows)
    texts = {}
    for i, u, t in got:
        texts.setdefault((i, u), set()).add(t)
    for (i, u), found in texts.items():
        host = parts(u)[0]
        others = [pages.blocks(h) for j, v, h in rows if parts(v)[0] == host]
        mine = [pages.blocks(h) for j, v, h in rows if (j, v) == (i, u)]
        may = {"\n".join(pages.main_lines(m, [o])) for m in mine for o in [*others, []]} | {"\n".join(x for _, x in m) for m in mine}
        assert found <= may
    one = pages.main_text(spark.createDataFrame(rows, SCHEMA).repartition(9), run=64).collect()
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)[:3]) for r in one)
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "html",
    ['<p class="advert">ad</p>', '<ul><li class="ad">ad</li></ul>', "<div hidden>ad</div>", '<div style="color:red; display: none">ad</div>', "<p class=ad>ad<br>ad", "<li class=ads>ad<div>ad</div></li>", '<table><tr class="sponsor"><td>ad</td></tr></table>',
     '<h3 class="sponsored">ad</h3>', '<blockquote id="cookie-notice">ad</blockquote>', '<p hidden="until-found">ad</p>', '<dl><dt class="share">ad</dl>', "<p class=ad><b>ad</b> ad</p>"],
)
def test_blocks_apart_inside_an_article(html):
    for after in ("<p>two</p>", "<ul><li>two</ul>", "<h2>two</h2>", "<div>two</div>"):
        found = pages.blocks(f"<article><p>one</p>{html}{after}</article>")
        assert pages.candidates(found) == (pages.OPEN, ["one", "two"])


def test_blocks_that_only_look_apart():
    kept = '<p data-hidden="x">a</p><p class="unhidden">b</p><p title="hidden">c</p><p class="addition">d</p><ul><li class="ad">no<li>e</ul><table><tr><td class="ad">no<td>f</table><p class="ad">no</p>g'
    assert pages.candidates(pages.blocks(f"<article>{kept}</article>"))[1] == list("abcdefg")


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a ">" ', "<a '\"", "<!", "<!--", "<", "<a <a \"'", "<li>", "<p class=ad>", "<script>", "</p>"])
def test_markup_that_nothing_closes_takes_linear_time(unit):
    begin = time.process_time()
    found = pages.blocks("<p>start</p>" + unit * (1_000_000 // len(unit)))
    assert found[0] == (pages.PLAIN, "start") and time.process_time() - begin < 20


def test_unclosed_tags_are_text():
    assert pages.blocks("a <b c") == [(pages.PLAIN, "a <b c")]
    assert pages.blocks("a <b \"c> d</b> e") == [(pages.PLAIN, 'a <b "c> d e')]
    assert pages.blocks("1 < 2 <p>x</p>") == [(pages.PLAIN, "1 < 2"), (pages.PLAIN, "x")]


def test_common_in_little_memory(monkeypatch):
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 25))] for _ in range(2))
        whole = pages.common(a, b)
        monkeypatch.setattr(pages, "CELLS", rnd.choice([1, 10, 60]))
        parts = pages.common(a, b)
        monkeypatch.undo()
        assert len(whole) == len(parts)
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(parts))


def test_without_broadcast(spark, monkeypatch):
    """The join by shuffle, which large key tables get, gives the same texts."""
    rows = [(i, f"http://h{i % 3}.org/{'ab'[i % 2]}/{i}", page(f"own text of this page {i}", (f"menu of {i % 3}", "footer"))) for i in range(60)] + [(None, None, None), (7, "http://h1.org/b/7", page("another text under the same id", ("menu of 1", "footer")))]
    d = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(repr, pages.main_text(d, run=8).collect()))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr("lexigauge.llm.base.BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = pages.main_text(d, run=8)
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
