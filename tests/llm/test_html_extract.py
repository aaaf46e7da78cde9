from __future__ import annotations

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from boxloom.llm import entry
from boxloom.llm import html_extract as h
from boxloom.llm.html_extract import decide, extract_pages, blocks_of, main_text, spread

PROSE = "The cat is on the mat and it was there for the whole of the day, as it is in all of the stories that we have of it in this land and by the sea."


def test_article_with_furniture_around_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">the home of all</a></li></ul></nav><!-- ad --><div class="ad">The ad is for the one and only.</div>
    <article><h1>Head &amp; more</h1><p><b>{PROSE}<br><p>Short.</p><aside>By the way</aside><form><p>Sign up</p></form>
    <section id="comments"><p>{PROSE}</p></section></article><footer>&copy; x</footer>"""
    assert main_text(page) == f"Head & more\n{PROSE}\nShort."


def test_page_without_an_article():
    page = f"""<body><div class="menu"><a href=x>Home</a></div><div id="cookie-notice">We use cookies for the good of all.</div>
    <h2>Title</h2><p>{PROSE}<p>Brief.<div>{PROSE}</div><div class="sidebar"><p>{PROSE}</p></div><p><a href=x>Read more of the same here and now</a></p></body>"""
    assert main_text(page) == f"Title\n{PROSE}\nBrief.\n{PROSE}"


def test_first_pass_decides_by_links_length_and_stop_words():
    by = {b.text[:5]: decide(b) for b in blocks_of(f"<p>{PROSE}<p>{'Xq zw vb ' * 30}<p>few<p><a>{PROSE}</a>")}
    assert by["Xq zw"] is False and by["few"] is None
    assert [decide(b) for b in blocks_of(f"<p>{PROSE}")] == [True]
    assert [decide(b) for b in blocks_of(f"<p><a>{PROSE}</a>")] == [False]


def test_second_pass_takes_the_nearest_label():
    n = None
    assert spread([n, True, n, n, n, False, n], [False] * 7) == [True, True, True, False, False, False, False]
    assert spread([True, n, True], [False] * 3) == [True, True, True]
    assert spread([False, n, True], [False, True, False]) == [False, True, True]
    assert spread([n, n], [False] * 2) == [True, True]


def test_odd_markup_and_references():
    assert main_text("<p>a&nbsp;&lt;b&gt;  c\n d</p>") == "a <b> c d"
    assert main_text("x < y <p>z") == "x < y\nz"
    assert main_text("<p>open <b>bold <i>x") == "open bold x"
    assert main_text("<!-- never closed <p>gone") == ""
    assert main_text("<script>never closed <p>gone") == ""
    assert main_text("") == "" and main_text(None) == "" and main_text("<nav><p>only menu</nav>") == ""


def test_whole_query(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</article>", 7), (1, "u", f"<article><p>{PROSE}</article>", 7), (2, None, None, 7), (3, "v", "", 7), (4, "w", "<main><p>é " + "long " * 50000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = sorted((r.page_id, r.url, r.n_chars, r.text) for r in extract_pages(pages.where("url is not null")).collect())
    assert out == sorted([(1, "u", len(PROSE), PROSE)] * 2 + [(3, "v", 0, ""), (4, "w", 250001, ("é " + "long " * 50000).strip())])
    assert [tuple(r) for r in extract_pages(pages.where("page_id = 2")).collect()] == [(2, None, "", 0)]
    assert extract_pages(pages.where("page_id > 9")).collect() == []


def test_layout_names_do_not_empty_a_page():
    for name in ("content has-sidebar", "no-sidebar", "nav-open", "header-image", "left-side", "with-ads", "content__header--fixed"):
        assert main_text(f'<div class="{name}"><p>{PROSE}</div>') == PROSE, name
    for name in ("sidebar", "left-sidebar", "site-footer", "ad_slot_1", "cookie-notice", "main-nav", "widget-area", "x menu", "side"):
        assert main_text(f'<div class="{name}"><p>{PROSE}</div>') == "", name


def test_an_article_in_a_marked_wrapper_counts_again():
    assert main_text(f'<div class="header"><p>{PROSE}</p><article><p>Text.</p><div class="share"><p>Send</p></div></article></div>') == "Text."
    assert main_text(f'<main><p>Text.</p><div class="toolbar"><article>{PROSE}</article></div></main>') == "Text."
    assert main_text(f'<p>{PROSE}</p><div class="related-list"><article>{PROSE}</article></div>') == PROSE
    assert main_text(f"<nav><article>{PROSE}</article></nav>") == ""


def test_a_long_block_that_counts_to_c_stays():
    assert main_text(f"<p>{PROSE} It is (a) one, (b) two and (c) three.</p>") == f"{PROSE} It is (a) one, (b) two and (c) three."
    assert main_text(f"<p>{PROSE}</p><p>(c) 2024 by the owner of all of it</p>") == PROSE


class Plain(HTMLParser):
    """Blocks of a page by the standard library's parser: (text, unlinked text, linked characters, elements around)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.around, self.blocks, self.now = [], [], [[], [], []]
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text, free, links = (" ".join("".join(x).split()) for x in self.now)
        if text:
            self.blocks.append((text, free, sum(len(x.strip()) for x in self.now[2]), list(self.around)))
        self.now = [[], [], []]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now[0].append(" ")
            self.now[1].append(" ")
        elif tag in ("meta", "a", "b"):
            self.around += [(tag, None)] if tag == "a" else []
        else:
            self.cut()
            if tag in ("p", "li", "h1") and self.around and self.around[-1][0] in (("p", "li") if tag == "li" else ("p",)):
                self.around.pop()
            self.around.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag == "b":
            return
        if tag != "a":
            self.cut()
        if tag in [t for t, _ in self.around]:
            while self.around.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = {t for t, _ in self.around}
        if not tags & {"script", "style", "title"}:
            self.now[0].append(data)
            self.now[2 if "a" in tags else 1].append(data)


def plain_text(page):
    """Both passes over the blocks of ``Plain``, with every neighbour looked at, and how each block was decided."""
    blocks = Plain(page).blocks
    article = any("article" in dict(around) for *_, around in blocks)
    rows = []
    prose = [re.findall(r"[^\W\d_]+", free.lower()) for _, free, _, around in blocks if not {"nav", "footer"} & dict(around).keys() and not {"ad", "sidebar"} & set(dict(around).values())]
    known = sum(w in h.STOP_WORDS for words in prose for w in words) >= 0.25 * max(1, sum(map(len, prose)))
    for text, free, linked, around in blocks:
        names = dict(around)
        inside = "article" in names
        furniture = "nav" in names or "footer" in names or "ad" in names.values() or "sidebar" in names.values()
        total = -5.5 if "nav" in names or "footer" in names or "ad" in names.values() else -3.0 if furniture else 0.75 if inside else -1.0 if article else 0.0
        words = re.findall(r"[^\W\d_]+", free.lower())
        share = sum(w in h.STOP_WORDS for w in words) / max(1, len(words))
        share = share if known else max(share, 0.25)
        if len(free) >= 140:
            total += -1.0 if share < 0.12 else 0.0 if share < 0.25 else 2.0 if len(free) < 600 else 4.0
        elif len(free) >= 40 and share >= 0.25:
            total += 0.5
        near = [t for t, _ in around if t != "a"][-3:]
        total += 0.5 if "h1" in near else 0.0
        total += 0.0 if linked <= 0.6 * len(text) else -2.0 if "li" in near else -1.5
        total += -1.5 if len(text) < 140 and ("©" in text or "(c)" in text.lower()) else 0.0
        rows.append({"text": text, "inside": inside, "furniture": furniture, "head": "h1" in near, "label": True if total >= 1 else False if total <= -1 else None})
    ways = Counter()
    for part, lean in ([r for r in rows if r["inside"]], True), (rows, False):
        part = [r for r in part if not r["furniture"]]
        decided = [(i, r["label"]) for i, r in enumerate(part) if r["label"] is not None]
        for i, r in enumerate(part):
            if r["label"] is not None:
                ways["first pass"] += not r.get("by")
                continue
            before = [d for d in decided if d[0] < i][-1:]
            after = [d for d in decided if d[0] > i][:1]
            sides = [good for _, good in before + after]
            if len(sides) < 2 or sides[0] == sides[1]:
                good = sides[0] if sides and not lean else all(sides) if not lean else len(sides) < 2 or sides[0]
            elif lean:
                good = True
            elif r["head"]:
                good = after[0][1]
            else:
                good = after[0][1] if after[0][0] - i < i - before[0][0] else before[0][1] if i - before[0][0] < after[0][0] - i else False
            r["new"], r["by"] = good, True
            ways["neighbours" if sides else "alone"] += 1
        for r in part:
            r["label"] = r.pop("new", r["label"])
    return "\n".join(r["text"] for r in rows if r["label"] and not r["furniture"]), ways


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_query_equals_a_plain_two_pass_version(spark, sf):
    got = entry.op3_html_extract(spark, f"/root/testdata/{sf}").collect()
    want, ways = {}, Counter()
    for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect():
        text, how = plain_text(r.html or "")
        want[r.page_id] = (r.url, text, len(text))
        ways += how
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == want and len(got) == len(want)
    assert ways["first pass"] > 0 and ways["neighbours"] > 0


def test_pages_without_an_article_equal_a_plain_two_pass_version(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    ways, kept = Counter(), 0
    for k, page in enumerate(pages):
        bare = page.replace("<article", "<div").replace("</article", "</div")
        for p in (bare, page.replace("<article>", f"<p>{PROSE}</p><ul><li><a href=x>one more link here</a><li><a>two</a></ul><p>Short.</p><article>"), bare.replace("<p>", f"<div class=sidebar><p>{PROSE}</div><p>", 1)):
            text, how = plain_text(p)
            assert main_text(p) == text, k
            ways += how
        kept += main_text(bare) == main_text(page)
    assert ways["first pass"] > 0 and ways["neighbours"] > 0
    assert kept > 0.85 * len(pages)


def test_prose_beside_an_article_stays_and_short_text_there_goes():
    page = f"<p>{PROSE}</p><p>By me</p><h1>Head</h1><article><p>Short.</p></article><p>{PROSE} So.</p><div>Terms of it</div>"
    assert main_text(page) == f"{PROSE}\nHead\nShort.\n{PROSE} So."


def test_tags_and_names_shift_a_score_but_do_not_decide():
    assert main_text(f'<article><p class="side by">{PROSE}</p><div class="entry-header"><h1>Title</h1></div><p>{PROSE}</p></article>') == f"{PROSE}\nTitle\n{PROSE}"
    assert main_text(f'<div class="form"><p>{PROSE * 5}</p></div>') == PROSE * 5
    assert main_text(f"<article><p>See <a>{'the long title of it ' * 4}</a>, which is on the table of all that there is.</p><p>{PROSE}</p></article>").startswith("See the long")
    assert main_text(f"<article><p>{PROSE}</p><ul><li><a>Next one</a></li></ul><p>End.</p></article>") == f"{PROSE}\nEnd."


def test_open_elements_and_lost_quotes():
    assert main_text(f"<nav><ul><li><a>one</a></ul><article><p>Short.</p><p>{PROSE}</p></article>") == f"Short.\n{PROSE}"
    assert main_text(f"<article><p>{PROSE}</p></article><footer>All rights<p>{PROSE}") == PROSE
    assert main_text('<p class="x>one</p><p class="y">two</p>\n<p class="z>three') == "one\ntwo\nthree"
    assert main_text("<p title='a<b>c'>one</p><p title='x>two</p><p>it's three</p><p class='fo") == "one\ntwo\nit's three"


def test_time_grows_with_length_however_deep_elements_nest():
    began = time.perf_counter()
    assert main_text("<div>" * 50_000 + PROSE + "</div>" * 50_000) == PROSE
    for noise in ("<a ", '<p class="', "<!", "</p", "<p title='a<b'", "<svg", "<!--"):
        main_text(noise * 100_000)
    assert time.perf_counter() - began < 20


OTHERS = {
    "Italian": "Il gatto dorme sul tappeto e nessuno lo disturba perché tutti sanno che quando si sveglia comincia a girare per la casa cercando qualcosa da mangiare o qualcuno con cui giocare fino a sera.",
    "Russian": "Кошка спит на ковре, и никто её не беспокоит, потому что все знают: когда она просыпается, она начинает ходить по дому в поисках еды или того, с кем можно поиграть до самого вечера.",
    "Chinese": "猫在地毯上睡觉,没有人打扰它,因为大家都知道它醒来以后会在屋子里到处走动,寻找吃的东西,或者找人一起玩到晚上。",
    "Thai": "แมวนอนอยู่บนพรมและไม่มีใครรบกวนมันเพราะทุกคนรู้ว่าเมื่อมันตื่นขึ้นมามันจะเริ่มเดินไปรอบๆบ้านเพื่อหาอะไรกินหรือหาใครสักคนเล่นด้วยจนถึงเย็น",
    "Turkish": "Kedi halının üzerinde uyuyor ve kimse onu rahatsız etmiyor çünkü herkes uyandığında evin içinde dolaşıp yiyecek bir şeyler ya da akşama kadar oynayacak birini aradığını biliyor.",
    "Arabic": "تنام القطة على السجادة ولا يزعجها أحد لأن الجميع يعلمون أنها عندما تستيقظ تبدأ بالتجول في المنزل بحثا عن شيء تأكله أو شخص تلعب معه حتى المساء وهذا كل ما في الأمر.",
}


@pytest.mark.parametrize("language", sorted(OTHERS))
def test_languages_whose_stop_words_are_not_listed_keep_their_text(language):
    text = OTHERS[language]
    menu = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class='menu'><a href=/x>X</a></div>"
    foot = "<div id='cookie-notice'>" + text + "</div><footer>" + text + "</footer>"
    assert main_text(f"<body><h1>T</h1><p>{text}</p><p>{text}</p></body>") == f"T\n{text}\n{text}"
    assert main_text(f"{menu}<div>{text}</div>{foot}") == text
    assert main_text(f"{menu}<article><h1>T</h1><p>{text}</p><p>{text[:30]}</p></article>{foot}") == f"T\n{text}\n{text[:30]}".strip()
    assert main_text(f"{menu}<h1>T</h1><p>{text}</p><p><a href=/>{text}</a></p><p>{text}</p>{foot}") == f"T\n{text}\n{text}"


def test_other_scripts_in_a_page_of_a_listed_language_stay():
    for language in ("Russian", "Chinese", "Arabic"):
        assert main_text(f"<p>{PROSE}</p><p>{OTHERS[language]}</p><p>{PROSE}</p>") == f"{PROSE}\n{OTHERS[language]}\n{PROSE}"
