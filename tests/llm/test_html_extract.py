import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from cairnlake.llm import html_extract

PROSE = "The fox of the wood was in the house and it is that for which the people of the town have been with him all the time. " * 2


def article_of(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    inner = re.sub("<[^>]*>", "", re.sub("</?(p|h1)>", "\0", inner.replace("<br>", " ")))
    return "\n\n".join(t for p in inner.split("\0") if (t := " ".join(html.unescape(p).split())))


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        assert found[r.page_id].text == article_of(r.html) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_rules_without_an_article_element():
    page = f"""<html><head><title>T</title></head><body><header><a href="/">Home</a> Site</header>
    <div id="content"><h2>A title</h2><p>{PROSE}</p><p>Short &amp; sweet&nbsp;&#33;</p><ul><li><a href="a">one</a></li></ul></div>
    <div class="comments"><p>{PROSE}</p></div><form>{PROSE}</form><div class="cookie-notice">{PROSE}</div>
    <aside>{PROSE}</aside><!-- <p>no</p> --><script>var x = "<p>{PROSE}</p>";</script><footer>&copy; x</footer>"""
    assert html_extract.extract(page) == "\n\n".join(["A title", PROSE.strip(), "Short & sweet !"])


def test_plain_rules_and_neighbours():
    page = f"<p>menu</p><p><a href=1>a</a> <a href=2>b</a></p><p>{PROSE}</p><p>brief</p><p>{PROSE}</p><p><a href=1>{PROSE}</a></p><p>x</p>"
    assert html_extract.extract(page) == "\n\n".join([PROSE.strip(), "brief", PROSE.strip()])


def test_odd_pages(spark):
    pages = [None, "", "<", "a < b", "<p", "<article>x<br>y</article", '<a href="' + "x" * 1000, "<div>" * 3000 + "deep", "<script>never ends", "&am", "<article><p class='ad'>no</p>yes</article>"]
    for page in pages:
        assert isinstance(html_extract.extract(page), str)
    assert html_extract.extract("<article>x<br>y</article>") == "x y"
    frame = spark.createDataFrame([(1, None, None, 2), (1, "u", "<article>ä \U0001f600</article>", 3), (1, "u", "<article>ä \U0001f600</article>", 3)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in html_extract.main_text(frame).collect()] == [("", 0), ("ä \U0001f600", 3), ("ä \U0001f600", 3)]
    assert html_extract.main_text(frame.limit(0)).count() == 0


def test_hidden_is_an_attribute_of_its_own():
    for shown in ('class="overflow-hidden"', "class='hidden-print wide'", 'data-hidden="x"', 'hidden="false"', 'title="a hidden place"', 'aria-hidden="false"', "id=hidden"):
        assert html_extract.extract(f"<div {shown}><p>{PROSE}</p></div>") == PROSE.strip(), shown
    for kept_out in ("hidden", 'hidden=""', "class=x HIDDEN", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display: none"', "style='DISPLAY:NONE'", "hidden='until-found'"):
        assert html_extract.extract(f"<div {kept_out}><p>{PROSE}</p></div>") == "", kept_out


@pytest.mark.parametrize("page", [
    "<script " * 60_000, "<a " * 300_000, "<a '" * 150_000, "<a \">" * 150_000, "<p title=\"" * 100_000, "<!--" * 200_000, "</" * 300_000, "<!" * 300_000,
    "<ul>" * 80_000 + "</p>" * 80_000 + "</ol>" * 80_000, "<div><b><p>" * 80_000, "<script>" * 100_000, "<div class=" * 80_000, "<svg></svg" * 80_000,
    "<div " + "a " * 400_000 + ">", "<div class='" + "x " * 300_000 + "'>", "<article>" + "<p>&amp" * 100_000, "</script " * 100_000, "<p" + " " * 500_000, "\"'" * 300_000 + "<a>",
    '<div class="sidebar">x' * 45_000, "<article>" + '<div class="promo"><p>some words' * 30_000, '<section class=ad><div id="side">y</div>z' * 25_000, '<article class="comments">q' * 35_000,
], ids=lambda p: repr(p[:12]))
def test_time_grows_with_the_length_only(page):
    began = time.process_time()
    html_extract.extract(page)
    took = time.process_time() - began
    assert took < 3 * max(1, len(page) / 1e6), took


def test_densities_decide_over_names():
    assert html_extract.extract(f'<article><div class="ad-free-reading"><p>{PROSE}</p><p>{PROSE}</p></div></article>') == "\n\n".join([PROSE.strip()] * 2)
    assert html_extract.extract(f'<div class="share-story"><p>{PROSE}</p><p>{PROSE}</p></div>') == "\n\n".join([PROSE.strip()] * 2)
    assert html_extract.extract(f'<article><p>{PROSE}</p><div class="promo"><p>{PROSE[:120]}</p></div><p>brief</p></article>') == f"{PROSE.strip()}\n\nbrief"
    assert html_extract.extract(f"<article><p>{PROSE}</p><p>Subscribe to our newsletter</p><p>{PROSE}</p></article>") == "\n\n".join([PROSE.strip()] * 2)
    assert html_extract.extract(f"<main><p>Menu one two three</p><p>{PROSE}</p></main>") == PROSE.strip()
    assert html_extract.extract(f'<article><p>{PROSE}</p><section class="comments"><article><p>{PROSE}</p></article></section></article>') == PROSE.strip()
    assert html_extract.extract(f'<form action="/"><main><p>{PROSE}</p></main></form>') == PROSE.strip()
    assert html_extract.extract(f'<div class="ad">{PROSE}</div><article><h1>Tiny</h1></article>') == "Tiny"


PARAGRAPH = "The people of the town said that it was one of the best days they have had in the last years, and most of them would like to see it again when the summer is over here."


def kept(page, *texts):
    assert html_extract.extract(page) == "\n\n".join(texts)


@pytest.mark.parametrize("opening", ['<article class="post has-comments">', '<article class="post no-comments">', '<article class="entry comments-open">', '<article id="expert-comments">', '<div class="discussion">', '<main class="comments-roundup">'])
def test_no_article_is_lost_by_a_name(opening):
    page = f"{opening}<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></{opening[1:].split()[0]}>"
    kept(page, *[PARAGRAPH] * 3)
    kept(f"<nav>Home</nav>{page}<footer>The end</footer>", *[PARAGRAPH] * 3)


def test_parts_of_an_article_named_like_comments():
    paper = "".join(f'<section id="{name}"><h2>{name}</h2><p>{PARAGRAPH}</p></section>' for name in ("introduction", "methods", "discussion", "references"))
    kept(f"<article>{paper}</article>", "introduction", PARAGRAPH, "methods", PARAGRAPH, "discussion", PARAGRAPH, "references", PARAGRAPH)
    kept(f'<article><p>{PARAGRAPH}</p><div class="survey-responses"><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></article>', *[PARAGRAPH] * 3)


@pytest.mark.parametrize("name", ["comments", "comment", "comment-list", "user-comments", "disqus_thread", "comments-42", "replies", "article-comments", "discussion", "responses"])
def test_comments_after_the_article_are_out(name):
    remark = f'<div class="meta">Ann wrote 2 days ago</div><p>{PARAGRAPH}</p><span><p>Reply</p></span>'
    for n in (1, 2, 9):
        kept(f'<article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class="{name}">{remark * n}</div></article>', PARAGRAPH, PARAGRAPH)
        kept(f'<article><p>{PARAGRAPH}</p></article><section id="{name}">{remark * n}</section>', PARAGRAPH)
        kept(f'<div class="{name}">{remark * n}</div><article><p>{PARAGRAPH}</p>' + f"<p>{PARAGRAPH}</p>" * 20 + "</article>", *[PARAGRAPH] * 21) if name not in ("discussion", "responses") else None
    kept(f'<article><p>{PARAGRAPH}</p><div class="comments"><article><p>{PARAGRAPH}</p></article></div></article>', PARAGRAPH)
    kept(f'<article class="has-comments"><p>{PARAGRAPH}</p><div class="comments"><div class="comments"><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></article>', PARAGRAPH, PARAGRAPH)


def test_beginnings_of_short_lines_are_features():
    for heading in ("Comments from the mayor", "Menu planning for winter", "Sign up of new members grows"):
        kept(f"<article><h1>{heading}</h1><p>{PARAGRAPH}</p><h2>{heading}</h2><p>{PARAGRAPH}</p></article>", heading, PARAGRAPH, heading, PARAGRAPH)
    kept(f"<article><p>{PARAGRAPH}</p><p>Newsletter sales fell in May</p><p>{PARAGRAPH}</p></article>", PARAGRAPH, "Newsletter sales fell in May", PARAGRAPH)
    for line in ("Advertisement", "Sponsored content", "Share this story with your friends", "Read more: ten things of the week", "Newsletter", "<a href=x>Menu of the day</a>", "Comments", "Anzeige"):
        kept(f"<article><p>{PARAGRAPH}</p><p>{line}</p><p>{PARAGRAPH}</p></article>", PARAGRAPH, PARAGRAPH)
    for line in ("Newsletter signup below", "Menu one two three", "Comments (12)"):
        kept(f"<article><p>{line}</p><p>{PARAGRAPH}</p><p>{line}</p></article>", PARAGRAPH)


def test_notices_in_an_article():
    for notice in ("We use cookies to give you the best experience on our website. By continuing you agree to their use.", "This website uses cookies to analyse traffic and to remember the preferences of those who come here."):
        kept(f"<article><p>{PARAGRAPH}</p><p>{notice}</p><p>{PARAGRAPH}</p></article>", PARAGRAPH, PARAGRAPH)
    bakers = "We bake cookies with butter and sugar, and the people of the town come from far away to buy them when the market is open."
    kept(f"<article><p>{PARAGRAPH}</p><p>{bakers}</p></article>", PARAGRAPH, bakers)


def test_one_bad_block_does_not_outvote_paragraphs():
    sign = "© is the sign of copyright, and it has been with us for more than a hundred of years, but most people do not know what it says or for how long it is to be used by them."
    kept(f"<p>{PARAGRAPH}</p><p>{sign}</p><p>{PARAGRAPH}</p>", PARAGRAPH, sign, PARAGRAPH)
    other = "Быстрая лиса перепрыгнула через ленивую собаку и убежала далеко в лес, где жили другие звери и птицы."
    kept(f"<p>{other}</p><p>{other}</p><p>{other}</p><p>© 2024 Газета</p>", other, other, other)
    short = "They came to see the old mill at noon."
    kept(f"<p>{short}</p>" * 4, *[short] * 4)
    kept("<nav><p>One. Two.</p></nav><p>Page not found.</p><footer>The end.</footer>")


def test_quotes_pulled_out_of_an_article():
    kept(f'<article><p>{PARAGRAPH}</p><aside class="pullquote">A day to remember</aside><p>{PARAGRAPH}</p><aside>{PARAGRAPH}</aside></article><aside class="pullquote">No</aside>', PARAGRAPH, "A day to remember", PARAGRAPH)


def test_languages_without_a_list():
    other = "Быстрая лиса перепрыгнула через ленивую собаку и убежала далеко в лес, где жили другие звери и птицы. " * 3
    assert html_extract.extract(f"<p>{other}</p><p>{other}</p>") == "\n\n".join([other.strip()] * 2)
    assert html_extract.extract(f"<article><p>{other}</p></article>") == other.strip()


# --- the same rules from a tree, block by block, with every neighbour looked up anew

class Tree(HTMLParser):
    """Leaves of a well-formed page: (elements around, number of the block, text)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.leaves, self.n, self.k = [], [], 0, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
            return
        self.k += 1
        self.path.append((tag, dict(attrs), self.k))
        self.n += tag in html_extract.BLOCKS

    def handle_endtag(self, tag):
        self.path.pop()
        self.n += tag in html_extract.BLOCKS

    def handle_data(self, data):
        self.leaves.append((list(self.path), self.n, data))


LEVELS = {"comments": "exact", "expert-comments": "mixed", "discussion": "weak"}


def naive(page):
    h = html_extract
    blocks, levels = {}, {}
    for path, n, data in Tree(page).leaves:
        if not any(t in h.DROPPED for t, _, _ in path):
            blocks.setdefault(n, []).append((path, data))
    rows = []
    for parts in blocks.values():
        text = " ".join("".join(d for _, d in parts).split())
        if text:
            linked = " ".join("".join(d for p, d in parts if any(t == "a" for t, _, _ in p)).split())
            path = parts[0][0]
            tags = [t for t, _, _ in path]
            doubted = [k for _, a, k in path if set((a.get("class") or "").split()) & h.NOT_ARTICLE]
            kind = "junk" if set(tags) & h.NOT_ARTICLE_TAGS or "header" in tags and "article" not in tags else "article" if "article" in tags else "plain"
            threads = [k for _, a, k in path if a.get("class") in LEVELS]
            levels.update({k: (LEVELS[a["class"]], "article" not in tags[: tags.index(t) + 1]) for t, a, k in path if a.get("class") in LEVELS})
            rows.append([text, linked, kind, doubted, any(t in h.HEADINGS for t in tags), threads])
    # threads: what comes before each outside other threads, what is in it, what repeats in it
    shown = [r for r in rows if r[2] != "junk"]
    size = [len(t) if len(t) >= 70 and len(l) / len(t) <= 0.33 else 0 for t, l, *_ in shown]
    size = size if any(size) else [len(r[0]) for r in shown]
    out = set()
    for k in dict.fromkeys(k for r in shown for k in r[5]):
        at = next(i for i, r in enumerate(shown) if k in r[5])
        around = shown[at][5][: shown[at][5].index(k)]
        before = sum(n for r, n in zip(shown[:at], size) if set(r[5]) <= set(around))
        inside = sum(n for r, n in zip(shown, size) if k in r[5])
        repeats = sum(len(r[0]) < 70 and bool(re.search(r"\b(reply|ago)\b", r[0].lower())) for r in shown if k in r[5])
        repeats += len({j for r in shown if k in r[5] for j in r[5][r[5].index(k) + 1 :] if levels[j][0] != "weak"})
        level, outside = levels[k]
        beside = outside and any(n and r[2] == "article" for r, n in zip(shown, size))
        if level == "weak":
            gone = before and repeats > 1 or beside
        elif level == "exact" or not before:
            gone = level == "exact" and (before or repeats > 1) or 2 * inside <= sum(size)
        else:
            gone = repeats > 1 or inside <= before or beside
        if gone or out & set(around):
            out.add(k)
    for r in rows:
        r[2] = "junk" if out & set(r[5]) else r[2]
    shares = [sum(w in h._ALL_STOP for w in re.findall(r"[^\W\d_]+", r[0].lower())) / max(1, len(re.findall(r"[^\W\d_]+", r[0].lower()))) for r in rows]
    fits = any(len(r[0]) >= 70 and s >= 0.2 and r[2] != "junk" for r, s in zip(rows, shares))
    labels = []
    for (text, linked, kind, _, heading, _), s in zip(rows, shares):
        n, links = len(text), len(linked) / len(text)
        call = n < 70 and text[-1] not in ".?" and re.match(r"share this\b", text.lower())
        if kind == "junk" or call and (not heading or set(re.findall(r"[^\W\d_]+", text.lower())[2:]) <= h.GO_ON):
            x = "bad"
        elif kind == "article":
            x = "bad" if links > (0.5 if n < 200 else 0.8) else "open" if n < 70 else "good" if not fits or s >= 0.2 else "near"
        elif links > 0.33 or text[0] == "©" or n < 200 and "all rights reserved" in text.lower():
            x = "bad"
        elif n < 70:
            x = "bad" if linked and not heading else "open"
        elif not fits or s >= 0.3:
            x = "good" if n >= 200 else "near"
        else:
            x = "near" if s >= 0.2 else "bad"
        labels.append(x)
    kinds = [r[2] for r in rows]
    articles = sum(len(r[0]) for r in rows if r[2] == "article")
    good = sum(len(r[0]) for r, x in zip(rows, labels) if x == "good")
    for k in {k for r in rows for k in r[3]}:
        own = [i for i, r in enumerate(rows) if k in r[3] and r[2] != "junk"]
        mine = [i for i in own if labels[i] == "good"]
        if own and rows[own[0]][2] == "article":
            sure = 2 * sum(len(rows[i][0]) for i in own) > articles
        else:
            sure = not articles and len(mine) > 1 and 2 * sum(len(rows[i][0]) for i in mine) > good
        if not sure:
            for i in own:
                kinds[i] = "doubted"
    labels = ["bad" if k == "doubted" else x for k, x in zip(kinds, labels)]
    if "good" not in labels and "article" not in kinds:
        if labels.count("near") > 1:
            labels = ["good" if x == "near" else x for x in labels]
        elif "near" not in labels:
            i = 0
            while i < len(labels):
                j = i
                while j < len(labels) and labels[j] == "open":
                    j += 1
                if sum(r[0].endswith((".", "!", "?")) for r in rows[i:j]) > 1:
                    labels[i:j] = ["good"] * (j - i)
                i = j + 1
    out = []
    for i, x in enumerate(labels):
        if x in ("open", "near"):
            same = [j for j in range(len(labels)) if labels[j] in ("good", "bad") and (kinds[i] != "article" or kinds[j] == "article")]
            before, after = max((j for j in same if j < i), default=None), min((j for j in same if j > i), default=None)
            sides = [None if j is None else labels[j] for j in (before, after)]
            if kinds[i] == "article":
                x = "bad" if sides == ["bad", "bad"] else "good"
            elif x == "near":
                x = "good" if "good" in sides or sides == [None, None] else "bad"
            else:
                sides = [v or "bad" for v in sides]
                if sides[0] == sides[1]:
                    x = sides[0]
                elif rows[i][4] and sides[1] == "good":
                    x = "good"
                else:
                    x = sides[0] if after is None or before is not None and i - before <= after - i else sides[1]
        if x == "good":
            out.append(rows[i][0])
    return "\n\n".join(out)


def test_random_pages_against_the_naive_rules():
    rng = random.Random(4)
    texts = [PROSE, PROSE[:90], "brief", "A few words, no more.", "Share this", "Ann, 2 days ago", "Reply", "Zxq vrtl mnbw " * 12, "x " * 30, "the of and to qqq www eee rrr ttt yyy uuu " * 3]

    def part(depth):
        kind = rng.random()
        if kind < 0.45 or depth > 2:
            text = rng.choice(texts)
            text = f"<a href='u'>{text}</a>" if rng.random() < 0.25 else text + (f" <a href=u>{rng.choice(texts)}</a>" if rng.random() < 0.2 else "")
            tag = rng.choice(["p", "p", "li", "h2"])
            return f"<{tag}>{text}</{tag}>"
        tag, name = rng.choice(["div", "div", "section", "ul", "nav", "aside", "footer", "article"]), rng.choice(["", "", "", "", "ad", "promo", "share", *LEVELS])
        if tag == "article" and depth:
            tag = "div"
        inside = "".join(part(depth + 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag} class='{name}'>{inside}</{tag}>" if name and tag not in ("article", "nav") else f"<{tag}>{inside}</{tag}>"

    some = 0
    for _ in range(1500):
        page = "<html><body>" + "".join(part(0) for _ in range(rng.randint(1, 3))) + "</body></html>"
        found = html_extract.extract(page)
        assert found == naive(page), page
        some += bool(found)
    assert some > 400
