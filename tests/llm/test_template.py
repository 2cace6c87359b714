import random
import re

import pytest

from gristmill.llm import template

PAGES = "page_id long, url string, html string, host string, template string"
SKIN = (
    '<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home {i}</a></li></ul></nav>'
    '<!-- <p>gone</p> --><div class="ad">Buy {i}</div><article><h1>Head&amp;line {i}</h1>{body}<form>Name <input></form><div id="comments"><p>First!</p></div></article><aside>Side</aside><footer>&copy; me</footer></body></html>'
)


def one(html, known=None):
    return template.extract(html, known)[0]


def test_structure_alone():
    assert one(SKIN.format(i=1, body="<p>A  <b>b</b>c<br>d\n\te<p>f &lt;x&gt; &#233;&nbsp;g</p>")) == ["Head&line 1", "A bc d e", "f <x> é g"]
    assert one("<article><p>open <b>bold<p>next <i>one<footer>no</footer>") == ["open bold", "next one"]
    assert one("a < b and c") == ["a < b and c"]
    assert one("") == [] and one("<p></p>") == [] and one('<a href="x>unclosed') in ([], ['<a href="x>unclosed'], ["unclosed"])
    assert one("<div><div class='sidebar'>" + "s " * 99 + "</div><div>the long text here</div><p>x</p></div>") == ["the long text here"]
    assert one("<main><header><h1>Title</h1><p>by me</p></header><p>t</p></main>") == ["Title", "t"]
    assert one("<ARTICLE><P CLASS=x>A</P></ARTICLE><div hidden>h</div>") == ["A"]
    assert one("<article><p>" + "word " * 200_000 + "</p></article>")[0].count("word") == 200_000


def test_templates_and_slots(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", SKIN.format(i=i, body="".join(f"<p>text {i} {k}</p>" for k in range(i % 4)) + "<p>the same everywhere</p>"), "x", "y") for i in range(12)]
    bare = "<html><body><div class='menu'>m</div><div class='top'>t{i}</div><div class='text'><p>long text of page {i}</p><p>and more</p></div><div class='end'>e</div></body></html>"
    rows += [(100 + i, "http://bare.org/", bare.format(i=i), "x", "y") for i in range(5)]
    rows += [(200, None, None, "", ""), (None, "no host", "<article>solo</article>", "", ""), (200, None, None, "", "")]
    df = spark.createDataFrame(rows, PAGES)
    got = [(r.page_id, r.blocks, r.found_by) for r in template.main_text(df).collect()]
    assert len(got) == len(rows)
    for page_id, blocks, how in got:
        if page_id is not None and page_id < 12:
            assert blocks == [f"Head&line {page_id}", *[f"text {page_id} {k}" for k in range(page_id % 4)], "the same everywhere"] and how == "template"
        elif page_id is not None and page_id < 200:
            assert blocks[0] == f"long text of page {page_id - 100}" and how == "template", (blocks, how)
        else:
            assert blocks == (["solo"] if page_id is None else [])
    known = {r.host: r.template for r in template.templates(df.selectExpr("page_id as page", "regexp_extract(url, '://([^/]*)', 1) as host", "coalesce(html, '') as html")).collect()}
    tags = {t.role for t in template.tokens(rows[0][2])}
    assert len({m.vector for m in known["h0.com"] if m.role in tags}) <= 2 and len([m for m in known["h0.com"] if m.role in tags]) > 10
    # words that all pages have are tokens, too
    assert len([m for m in known["h0.com"] if m.role not in tags]) >= 5
    assert template.main_text(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("junk", ["<", "<<p>>", "</", "<p", "<!--", "<!-- x", "&#xZZ;", "<script>", "\0<p>\0", "<a b='", "</article></article>" * 50, "<div>" * 3000])
def test_malformed(junk):
    template.extract(junk, None)
    assert one("<article><p>kept</p></article>" + junk) == ["kept"]


def test_text_after_boilerplate_in_an_article(spark):
    skin = "<html><body><div class='top'>t{i}</div><article{a}><h1>T{i}</h1><p>P{i}0</p><div class='ad'>buy</div><p>P{i}1</p><div class='share'>tell</div><p>P{i}2</p></article><div class='end'>e</div></body></html>"
    rows = [(i, f"http://a.org/{i}", skin.format(i=i, a=" hidden" if i == 5 else ""), "x", "y") for i in range(6)]
    got = {r.page_id: r for r in template.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(5):
        assert got[i].blocks == [f"T{i}", f"P{i}0", f"P{i}1", f"P{i}2"] and got[i].found_by == "template"


def test_whole_container_without_an_article(spark):
    body = "<h1>T{i}</h1><p>long text a of {i}</p><p>b</p><ul><li>c</li></ul><div class='ad'>buy</div><p>d</p>"
    skin = f"<html><body><div class='menu'>m</div><div class='content'>{body}</div><div class='end'>e</div></body></html>"
    rows = [(i, f"http://c.org/{i}", skin.format(i=i), "x", "y") for i in range(5)]
    for r in template.main_text(spark.createDataFrame(rows, PAGES)).collect():
        assert r.blocks == [f"T{r.page_id}", f"long text a of {r.page_id}", "b", "c", "d"] and r.found_by == "template"
    alone = "<div class='menu'>m</div><div><p>the long text</p><section>s</section><ul><li>l</li></ul><table><tr><td>t</td></tr></table><div><div>n</div></div><aside>no</aside></div><div>o</div>"
    assert one(alone) == ["the long text", "s", "l", "t", "n"]


def strip(page):
    """No tag or name that tells what its content is."""
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
    return re.sub(r" (class|id)=(\"[^\"]*\"|'[^']*')", "", page)


def invented(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("wrapped", [True, False])
def test_articles_without_telling_tags_or_names(spark, wrapped):
    rng = random.Random(4)
    rows, want = [], {}
    notice = invented(rng, 400)
    for i in range(24):
        blocks = [invented(rng, 8), *[invented(rng, rng.randrange(20, 90)) for _ in range(rng.randrange(2, 7))]]
        menu = "".join(f"<li><a href='/{k}'>{invented(rng, 2)}</a></li>" for k in range(rng.randrange(3, 8)))
        article = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        if wrapped:
            article = f"<article>{article}</article>"
        page = f"<html><body><nav><ul>{menu}</ul></nav><div class='notice'>{notice}</div><div class='ad'>{invented(rng, 5)}</div>{article}<div class='related'><p>{invented(rng, 4)}</p></div><footer>&copy; the site &middot; {invented(rng, 6)}</footer></body></html>"
        rows.append((i, f"http://plain.org/{i}", strip(page), "x", "y"))
        want[i] = blocks
    got = template.main_text(spark.createDataFrame(rows, PAGES)).collect()
    alone = [one(r[2]) for r in rows]
    for r in got:
        assert r.found_by == "template" and r.blocks == want[r.page_id]
        assert alone[r.page_id] != want[r.page_id]  # the page alone doesn't tell


def test_words_of_the_template_are_no_prose(spark):
    """Words at a text's ends that are the same on each page don't make its container the article's."""
    rng = random.Random(6)
    said = "aaaaaaaaaa bbbbbbbbbb cccccccccc dddddddddd {i} eeeeeeeeee ffffffffff gggggggggg"
    rows = [(i, f"http://w.org/{i}", f"<html><body><div><p>{said.format(i=i)}</p></div><div><p>{invented(rng, 6)}</p></div></body></html>", "x", "y") for i in range(12)]
    for r in template.main_text(spark.createDataFrame(rows, PAGES)).collect():
        assert r.found_by == "template" and len(r.blocks) == 1 and "aaaa" not in r.blocks[0]


def brute_vectors(pages):
    """Occurrence vectors of tag roles, gathered whole."""
    vectors = {}
    for k, page in enumerate(pages):
        for t in template.tokens(page):
            if t.role:
                vectors.setdefault(t.role, [0] * len(pages))[k] += 1
    classes = {}
    for role, v in vectors.items():
        if max(v) == 1 and sum(v) >= template.SUPPORT * len(pages):
            classes.setdefault(tuple(v), set()).add(role)
    return {frozenset(c) for c in classes.values()}


def test_classes_equal_gathered_vectors(spark):
    rng = random.Random(3)
    parts = ["<div class='a'><p>x</p></div>", "<ul><li>y</li></ul>", "<section><h2>z</h2></section>", "<table><tr><td>q</td></tr></table>"]
    pages = ["<html><body>" + "".join(p * rng.randrange(3) if rng.random() < 0.4 else p for p in parts) + "</body></html>" for _ in range(40)]
    df = spark.createDataFrame([(i, "h.org", p) for i, p in enumerate(pages)], "page long, host string, html string").repartition(5)
    found = template.templates(df).collect()[0].template
    tags = set().union(*({t.role for t in template.tokens(p)} for p in pages))
    by_vector = {}
    for m in found:
        if m.role in tags:
            by_vector.setdefault(m.vector, set()).add(m.role)
    brute = brute_vectors(pages)
    assert {frozenset(c) for c in by_vector.values() if len(c) > 1} == {c for c in brute if len(c) > 1}


def test_words_count_on_all_pages_however_they_are_dealt_out(spark):
    """A word that is on few of a task's pages is counted there, too."""
    both = lambda i: "aaa bbb" if i < 4 or i == 7 else "ccc ddd"  # noqa: E731 # on 5 of 8 pages, of which 1 in the second part
    pages = [(i, "h.org", f"<html><body><p>{both(i)} {i}</p></body></html>") for i in range(8)]
    df = spark.createDataFrame(pages, "page long, host string, html string")
    whole, dealt = ({(m.role, m.vector, m.pages) for m in template.templates(d).collect()[0].template} for d in (df.coalesce(1), spark.createDataFrame(spark.sparkContext.parallelize(pages, 2), df.schema)))
    role = next(t.role for t in template.tokens(pages[0][2]) if t.text.startswith("aaa"))
    assert {(r, p) for r, _, p in dealt} >= {(template._word(role, "aaa"), 5), (template._word(role, "bbb"), 5)}
    assert dealt == whole


def test_classes_nest_in_one_slot():
    page = "<html><body><div class='a'>1</div><div class='b'>2</div></body></html>"
    sequence = template.tokens(page)
    at = template.once(sequence)
    roles = sorted(at, key=at.get)
    member = lambda k, vector, pages: {"role": roles[k], "vector": vector, "pages": pages, "place": k}
    root = [member(k, 1, 9) for k in (0, 1, 4)]
    inside, across, unordered = [member(k, 2, 5) for k in (2, 3)], [member(k, 3, 5) for k in (3, 5)], [member(k, 4, 5) for k in (3, 2)]
    assert set(template.nested(sequence, root + inside).values()) == {roles[k] for k in (0, 1, 2, 3, 4)}
    assert set(template.nested(sequence, root + across).values()) == {roles[k] for k in (0, 1, 4)}
    assert set(template.nested(sequence, root + unordered).values()) == {roles[k] for k in (0, 1, 4)}
