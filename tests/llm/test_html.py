"""Main text of pages: parsing, features, trees, decoding, whole queries."""

import html
import itertools
import re

import numpy as np
import pytest

from sparkloom.llm import html_extract as H
from sparkloom.llm import queries


@pytest.fixture(scope="module")
def model():
    return H.trained_model()


def blocks(source):
    return [t for t in H.parse(source).text if t]


def test_parse_blocks():
    assert blocks("<p>a  b\n c<p>d<br>e</p>f") == ["a b c", "d e", "f"]
    assert blocks("<div>x<b>y</b>z<ul><li>1<li>2 &amp; &lt;3&gt;</ul>w") == ["xyz", "1", "2 & <3>", "w"]
    assert blocks("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><title>t</title><p>yes &#233;&nbsp;x") == ["yes é x"]
    assert blocks("<p><b>title<br><p>next</p></div></div>tail") == ["title", "next", "tail"]
    assert blocks("a < b <3 <p") == ["a < b <3 <p"]
    assert blocks("") == [] and blocks("<<<>>>") and blocks("<a href='>'>q</a>") == ["q"]
    assert blocks("<table><tr><td>a<td>b</tr><tr><td>c</table>") == ["a b", "c"]


def test_unclosed_silent_element_and_depth():
    assert blocks("<p>one</p><script>never closed <p>two</p>") == ["one"]
    assert blocks("<div>" * 3000 + "deep") == ["deep"]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        page = H.Page()
        for i in range(n):
            page.add("div", int(rng.integers(0, i)) if i else -1)
        odds = rng.normal(0, 3, n)
        kept = H.decode(page, odds)
        assert all(kept[page.parent[i]] for i in range(1, n) if kept[i])
        gain = np.clip(odds, -8, 8)
        best = max(
            sum(gain[i] for i in range(1, n) if choice[i])
            for choice in ((True, *c) for c in itertools.product((True, False), repeat=n - 1))
            if all(choice[page.parent[i]] for i in range(1, n) if choice[i])
        )
        assert sum(gain[i] for i in range(1, n) if kept[i]) == pytest.approx(best)


def test_trees_learn_and_repeat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    m = H.BoostedTrees(trees=30, depth=3).fit(x[:1500], y[:1500])
    assert ((m.log_odds(x[1500:]) > 0) == y[1500:].astype(bool)).mean() > 0.95


def test_held_out_pages(model):
    exact = wrong = total = 0
    for k in range(120):
        source, page, label = H.made_page(77_000_000 + k)
        want = [t for t, keep in zip(page.text, label) if t and keep]
        got = H.extract([source], model)[0].split("\n")
        exact += got == want
        wrong, total = wrong + len(set(got) ^ set(want)), total + len(page.text)
    assert exact >= 100 and wrong / total < 0.01


INTRUDERS = {
    "form": "<form>Send us your thoughts<input name=q></form>",
    "form with a paragraph": "<form action=/send><p>Tell us what you think of this report</p><button>Send</button></form>",
    "footer": "<footer><p>Filed under rivers and mills, printed with leave of the editor</p></footer>",
    "aside": "<aside>Our shop sells maps of the whole valley, folded or rolled.</aside>",
    "aside with a paragraph": "<aside><p>Our shop sells maps of the whole valley, folded or rolled.</p></aside>",
    "button": "<button>Read it aloud</button>",
    "label": "<label>Text size</label>",
    "menu": "<nav><ul><li><a href=/a>Towns</a></li><li><a href=/b>Rivers</a></li><li><a href=/c>Hills</a></li></ul></nav>",
    "script": "<script>document.write('<p>x</p>')</script><style>p { color: red }</style>",
}
PARTS = ["The old mill by the river", "The mill has stood by the river for three hundred years, and its wheel still turns in spring.", "Few of those who pass it know who built it, or why the road bends here.", "A clerk found the papers last autumn, in a chest under the stairs.", "They name a woman called Ada Thorn, who owned the land and paid the masons in flour."]


def hand_written(intruder="", place=3, before="", after="", wrap="<article>{}</article>"):
    body = [f"<h1>{PARTS[0]}</h1>", *[f"<p>{p}</p>" for p in PARTS[1:]]]
    body.insert(place, intruder)
    return f"<!DOCTYPE html><html><head><title>Mill</title></head><body>{before}{wrap.format(''.join(body))}{after}</body></html>"


@pytest.mark.parametrize("kind", sorted(INTRUDERS))
@pytest.mark.parametrize("place", [1, 3, 5])
def test_no_part_of_the_article_without_a_class(model, kind, place):
    assert H.extract([hand_written(INTRUDERS[kind], place)], model) == ["\n".join(PARTS)]


@pytest.mark.parametrize("before", ["", "<header><p>News from the valley since 1901</p></header>", "<header><h1>Valley News</h1><nav><ul><li><a href=/>Home</a></li><li><a href=/x>Towns</a></li></ul></nav></header>", "<div class='cookie-notice'><p>We use cookies to count our visitors.</p><button>Fine</button></div>"])
@pytest.mark.parametrize("after", ["", "<footer><p>Valley News, all rights reserved</p></footer>", "<section id=comments><h3>2 comments</h3><ul><li><b>Tom</b><p>I walked there once and saw no mill at all.</p></li><li><b>Eve</b><p>It is behind the trees.</p></li></ul></section>", "<aside><h3>Also read</h3><ul><li><a href=/1>Floods</a></li><li><a href=/2>Bridges</a></li></ul></aside>"])
def test_hand_written_pages(model, before, after):
    assert H.extract([hand_written(before=before, after=after)], model) == ["\n".join(PARTS)]


def test_huge_pages_are_scored_in_slices(model, monkeypatch):
    pages = [H.made_page(78_000_000 + k)[0] for k in range(20)]
    whole = H.extract(pages, model)
    monkeypatch.setattr(H, "_SLICE", 30)
    assert H.extract(pages, model) == whole and any(len(H.parse(p).tag) > 30 for p in pages)


def test_kept_columns_of_clashing_names(spark, model):
    df = spark.createDataFrame([(1, "u", "<p>x", 5, "z")], "page_id long, text string, html string, n_chars int, Text_ string")
    out = H.extract_main_text(df, "page_id", "html", ("text", "n_chars", "page_id", "Text_", "html"), model)
    assert out.columns == ["page_id", "text_", "n_chars_", "page_id_", "Text__", "html", "text", "n_chars"]
    assert out.first()["text_"] == "u"


def test_rows_of_all_kinds(spark, model):
    article = "<html><body><nav><ul><li><a href=/>menu</a></ul></nav><article><h1>Title here</h1>" + "<p>Some words of text, and more of them.</p>" * 5 + "</article><footer>&copy; site</footer>"
    rows = [(1, "u", article, "x"), (2, "v", None, "x"), (3, None, "", "x"), (4, "w", "<nav><a href=/>menu</a></nav>", "x"), (1, "u", article, "x"), (5, "y", article.replace("<p>Some", "<p>Some" + " more" * 40000, 1), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_main_text(df, "page_id", "html", ("url",), model).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[2]["text"] == by[3]["text"] == "" and by[2]["n_chars"] == 0
    assert by[1]["text"].split("\n") == ["Title here", *["Some words of text, and more of them."] * 5] and by[5]["n_chars"] > 200_000
    assert H.extract_main_text(df.limit(0), "page_id", "html", ("url",), model).count() == 0


def test_query_on_the_test_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op1_main_text(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for k, source in pages.items():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", source, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert got[k]["text"] == "\n".join(filter(None, parts)) and got[k]["n_chars"] == len(got[k]["text"])


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for source in ("<a '\"" * 20000, "<b>" * 50000 + "<p>x" * 5000, "<a>" * 50000 + "y", "<div>" * 20000 + "</li>" * 20000, "<" * 100000, "<p \"" + "\"" * 50000, "<li>" * 20000):
        H.parse(source)
    assert time.perf_counter() - began < 20
