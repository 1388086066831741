"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements. The first pass decides blocks by link density, length and the share of stop
words. Elements say what they are (menus, forms, footers, asides and hidden parts are out; an article lowers the thresholds);
names in class, id and role only raise doubt, which falls again if the doubted element holds most of what the densities call
good. Elements named as comments are threads: whether one is out follows from the prose before it and in it, and from what
repeats in it. How a short line begins is one feature of several. Blocks that are short, or long with a middling share, stay
open, and in the second pass take over the label of the nearest decided neighbours; on a page where nothing is good, several
paragraphs with a middling share are, or else rows of short sentences.

A page is read once from left to right, in time that grows with its length whatever its markup: where tags end is worked
out beforehand, from right to left over quotes and closing brackets.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlake.llm.words import dealt, stretches

# Common function words of the languages at hand.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with his they at be this from i have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now people my made over did down only way find use may long little very after our just where most",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können",
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas sur par plus avec tout faire la les des une est aux ou ont sont mais comme nous vous leur cette ces ils sans même aussi",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}
#: Words in class, id and role of reader comments; of what else is not the article; of what is.
COMMENTS = set("comment comments disqus reply replies respond".split())
MAYBE_COMMENTS = set("responses discussion".split())
BESIDE_COMMENTS = set("list area section thread wrap wrapper box container block item body form user reader the id".split())
STATES = set("has have with without no open opened closed allow allows enabled disabled count".split())
QUOTES = set("pullquote pull quote".split())
NOT_ARTICLE = set("ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay dialog nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination sidebar side aside rail widget related recommended share sharing social newsletter subscribe subscription signup login footer foot header masthead topbar toolbar skip search copyright legal disclaimer tags complementary contentinfo".split())
IS_ARTICLE = set("article post entry story main maincontent articlebody postbody entrycontent postcontent storybody articlecontent".split())
#: How short lines begin that stand in an article without belonging to it: calls to the reader, and nouns; words
#: that go on with them.
CALLS = ("subscribe", "sign up", "share this", "follow us", "sponsored by", "related articles", "related posts", "read more", "read also", "skip to", "cookie settings", "accept all", "log in", "back to top", "print this", "leave a comment", "post a comment", "abonnieren", "weiterlesen", "abonnez-vous", "lire aussi", "suscríbete", "leer más")
NOUNS = ("newsletter", "advertisement", "sponsored", "menu", "comments", "anzeige", "werbung", "publicité", "publicidad")
GO_ON = set("a about and article articles by comment comments content email facebook for free friends from here in it linkedin more newsletter newsletters now of on our page post posts reader signup stories story the this to today top twitter up updates us weekly with x you your".split())
#: Elements by how they are treated.
DROPPED = set("script style noscript template textarea svg math iframe object canvas audio video title select datalist".split())
NOT_ARTICLE_TAGS = set("nav footer aside form button dialog menu fieldset label".split())
AROUND_PAGES = set("form button fieldset label".split())
CONTAINERS = set("article main section div header nav footer aside form ul ol dl table button dialog menu fieldset figure blockquote body details label".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre hr address figcaption summary legend option head html center".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_MARK = re.compile("[\"'>]")
_PLAIN_TAG = re.compile("[^<>]*")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in DROPPED}
_HINT = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_CALL = re.compile(rf"(?:{'|'.join(map(re.escape, CALLS))})\b")
_NOUN = re.compile(rf"(?:{'|'.join(map(re.escape, NOUNS))})\b")
_REMARK = re.compile(r"\b(?:reply|report|permalink|upvote|likes?|says|wrote|ago|antworten|sagt|répondre|responder)\b|\b\d{1,2}:\d\d\b|\b\d{4}-\d\d-\d\d\b")
_NOTICE = re.compile(r"\b(?:we|our|(?:this|the) (?:web ?)?site|this page)\b[^.]{0,60}\b(?:uses?|using|stores?|sets?)\b[^.]{0,40}\bcookies?\b|\bcookies? (?:help us|are used)\b")
_CONSENT = re.compile(r"\b(?:accept|agree|browse|browsing|consent|continu\w+|experience|preferences|privacy|settings|traffic)\b")
_RIGHTS = re.compile(r"(?:19|20)\d\d|\ball rights reserved\b")
_ALL_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

# Thresholds of the first pass.
LINKS_HIGH, LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.20, 0.30
#: In an article: link densities of short and of long blocks.
LINKS_SHORT, LINKS_LONG = 0.5, 0.8
#: Up to how many characters a paragraph can be a notice; features that make a short line none of the article; remarks in a thread.
NOTICE_LENGTH, FEATURES, REMARKS = 400, 2, 2
GOOD, BAD, OPEN, NEAR = "good", "bad", "open", "near"
PLAIN, ARTICLE, JUNK, COMMENT, DOUBTED, QUOTE = "plain", "article", "junk", "comment", "doubted", "quote"


class Place:
    """What the elements around a block say of it. A doubted place knows the place around it, how many doubted places lie
    around it, and the place around all of them."""

    __slots__ = ("kind", "tag", "around", "depth", "base")

    def __init__(self, kind: str, tag: str = "", around: "Place | None" = None):
        self.kind, self.tag, self.around = kind, tag, around
        self.depth, self.base = (around.depth + 1, around.base) if kind == DOUBTED else (0, self)

    def without_doubt(self) -> "Place":
        return self.base


#: How surely names say comments.
WEAK, MIXED, EXACT = 1, 2, 3


class Thread:
    """An element named as comments (the one around all is the page): how surely, the thread around it, whether it stands
    outside any article; the prose before it and in it, and how many of its parts look like remarks."""

    __slots__ = ("level", "around", "outside", "before", "own", "inside", "remarks", "out")

    def __init__(self, level: int = 0, around: "Thread | None" = None, outside: bool = True):
        self.level, self.around, self.outside = level, around, outside
        self.before = None if level else 0
        self.own = self.inside = self.remarks = 0
        self.out = False

    def decide(self, whole: int, in_articles: int) -> bool:
        """Whether it is out. Comments follow what they are about; what stands before all other prose is hardly one."""
        repeats = self.remarks >= REMARKS
        if self.level == WEAK:
            return self.before > 0 and repeats or self.outside and in_articles > 0
        if self.level == EXACT:
            return self.before > 0 or repeats or 2 * self.inside <= whole
        return repeats or self.inside <= self.before or self.outside and in_articles > 0 if self.before else 2 * self.inside <= whole


class Block:
    __slots__ = ("parts", "linked", "place", "thread", "heading")

    def __init__(self, place: Place, thread: Thread, heading: bool):
        self.parts, self.linked, self.place, self.thread, self.heading = [], [], place, thread, heading


def _hidden(attributes: str) -> bool:
    """Whether an attribute of its own hides the element; words inside values, such as class="overflow-hidden", do not."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _named(attributes: str) -> tuple[str | None, int]:
    """What the names of an element say: DOUBTED, ARTICLE, QUOTE or nothing, and how surely it holds comments (0: not said)."""
    kind, level = None, 0
    for m in _HINT.finditer(attributes):
        every = []
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[_-]+", name) if w]
            if not COMMENTS.isdisjoint(words):
                if STATES.isdisjoint(words):
                    plain = all(w in COMMENTS or w in BESIDE_COMMENTS or w[-1].isdigit() for w in words)
                    level = max(level, EXACT if plain else MIXED)
            elif not MAYBE_COMMENTS.isdisjoint(words):
                level = max(level, WEAK)
            else:
                every += words
        if kind is None and every:
            if not NOT_ARTICLE.isdisjoint(every):
                kind = DOUBTED
            elif IS_ARTICLE.intersection(every) or IS_ARTICLE.intersection("".join(p) for p in zip(every, every[1:])):
                kind = ARTICLE
            elif not QUOTES.isdisjoint(every):
                kind = QUOTE
    return kind, level


def _enter(tag: str, attributes: str, place: Place, thread: Thread) -> tuple[Place, Thread]:
    """The place and the thread inside an element."""
    if place.kind == JUNK and place.tag not in AROUND_PAGES:
        return place, thread
    if attributes and _hidden(attributes):
        return Place(JUNK, "hidden"), thread
    named, level = _named(attributes) if attributes and tag != "body" else (None, 0)
    if level:
        thread = Thread(level, thread, place.without_doubt().kind != ARTICLE and tag not in ("article", "main"))
    if tag in ("article", "main"):
        return Place(ARTICLE), thread
    if place.kind == JUNK:
        return place, thread
    in_article = place.without_doubt().kind == ARTICLE
    if tag in NOT_ARTICLE_TAGS and not (tag == "aside" and named == QUOTE and in_article) or tag == "header" and not in_article:
        return Place(JUNK, tag), thread
    if named == DOUBTED:
        return Place(DOUBTED, tag, place), thread
    return Place(ARTICLE) if named == ARTICLE and place.kind != ARTICLE else place, thread


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of all " ' and >, and for each the first > at or after it that is outside quotes (-1: none), if it is
    itself outside them."""
    marks = [m.start() for m in _MARK.finditer(page)]
    ends, following = [-1] * (len(marks) + 2), {'"': len(marks), "'": len(marks)}
    for i in reversed(range(len(marks))):
        if (c := page[marks[i]]) == ">":
            ends[i] = marks[i]
        else:
            ends[i] = ends[following[c] + 1]
            following[c] = i
    return marks, ends


def tokens(page: str):
    """(text before, tag or "", closing, attributes) of each tag in order, and at last the text after it. Comments,
    declarations and the elements of DROPPED with their contents are read as a tag without a name."""
    marks, ends = _tag_ends(page)
    last, at, p = page.rfind(">"), 0, page.find("<")
    while 0 <= p:
        name, closing, attributes = "", page.startswith("</", p), ""
        if page.startswith("<!--", p):
            end = page.find("-->", p + 4)
            end = len(page) if end < 0 else end + 3
        elif p > last:
            break
        elif m := _NAME.match(page, p + 1 + closing):
            end = ends[bisect_left(marks, m.end())]
            if end < 0:
                end = _PLAIN_TAG.match(page, m.end()).end()
                if not page.startswith(">", end):
                    p = page.find("<", p + 1)
                    continue
            name, attributes, end = m[0].lower(), page[m.end() : end], end + 1
            if name in DROPPED:
                if not closing and not attributes.endswith("/"):
                    found = _ENDS[name].search(page, end)
                    end = found.end() if found else len(page)
                name = ""
        elif page[p + 1 : p + 2] in ("!", "?", "/"):
            end = page.find(">", p) + 1
        else:
            p = page.find("<", p + 1)
            continue
        yield page[at:p], name, closing, attributes
        at, p = end, page.find("<", end)
    rest = page[at:]
    p = rest.find("<")
    if p >= 0 and re.match(r"<[a-zA-Z/!?]", rest[p : p + 2]):  # a tag that never ends
        rest = rest[:p]
    yield rest, "", False, ""


def blocks(page: str) -> list[Block]:
    place, thread = Place(PLAIN), Thread()
    found, stack, opened, anchor = [Block(place, thread, False)], [], {}, False

    def fresh(place, thread, heading=False):
        if found[-1].parts:
            found.append(Block(place, thread, heading))
        else:
            found[-1].place, found[-1].thread, found[-1].heading = place, thread, heading

    for text, tag, closing, attributes in tokens(page):
        if text:
            found[-1].parts.append(text)
            if anchor:
                found[-1].linked.append(text)
        if tag == "a":
            anchor = not closing
        elif tag in ("br", "img"):
            found[-1].parts.append(" ")
        elif tag in CONTAINERS:
            anchor = False
            if not closing:
                if not attributes.endswith("/"):
                    stack.append((tag, place, thread))
                    opened[tag] = opened.get(tag, 0) + 1
                    place, thread = _enter(tag, attributes, place, thread)
            elif opened.get(tag):
                t = ""
                while t != tag:
                    t, place, thread = stack.pop()
                    opened[t] -= 1
            fresh(place, thread)
        elif tag in BLOCKS:
            own = _enter(tag, attributes, place, thread) if attributes and not closing else (place, thread)
            fresh(*own, tag in HEADINGS and not closing)
    return found


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in _ALL_STOP for w in words) / len(words) if words else 0.0


def begins_like_none(text: str, heading: bool, linked: bool, edge: bool) -> bool:
    """Whether a short line is none of the article: how it begins and goes on, links and its place add up."""
    low = text.lower()
    if text[-1] in ".?" or not (m := _CALL.match(low) or _NOUN.match(low)):
        return False
    features = (2 if _CALL.match(low) and not heading else 1) + (linked and not heading) + (edge and not heading)
    return features + GO_ON.issuperset(_WORD.findall(low[m.end() :])) >= FEATURES


def decide(kind: str, n: int, links: float, stops: float | None, heading: bool, linked: bool, none: bool, rights: bool) -> str:
    """The first pass: the label of a block of n characters in a place of this kind. links and stops are shares of characters
    and words; stops is None where no list of stop words fits the page; none: a line or a notice that is none of the article."""
    if kind in (JUNK, COMMENT) or none:
        return BAD
    if kind == ARTICLE:
        if links > (LINKS_SHORT if n < LENGTH_HIGH else LINKS_LONG):
            return BAD
        if n < LENGTH_LOW:
            return OPEN
        return GOOD if stops is None or stops >= STOP_LOW else NEAR
    if links > LINKS_HIGH or rights:
        return BAD
    if n < LENGTH_LOW:
        return BAD if linked and not heading else OPEN
    if stops is None:
        return GOOD if n >= LENGTH_HIGH else NEAR
    if stops >= STOP_HIGH:
        return GOOD if n >= LENGTH_HIGH else NEAR
    return NEAR if stops >= STOP_LOW else BAD


def _doubted(found: list[tuple[Block, str]]) -> list[Place]:
    """All doubted places around blocks, each once, outer ones first."""
    places: dict[int, Place] = {}
    for block, _ in found:
        place = block.place
        while place.kind == DOUBTED and id(place) not in places:
            places[id(place)] = place
            place = place.around
    return sorted(places.values(), key=lambda p: p.depth)


def _threads_out(found: list[tuple[Block, str]], kinds: list[str], prose: list[int]) -> None:
    """Decides for each thread whether it is out; one in a thread that is out is out as well."""
    order: list[Thread] = []
    whole = in_articles = 0
    for (block, text), kind, n in zip(found, kinds, prose):
        if kind == JUNK:
            continue
        thread, new = block.thread, []
        while thread.before is None:
            new.append(thread)
            thread.before, thread = 0, thread.around
        for thread in reversed(new):  # outer ones first; while a thread is open none around it grows
            thread.before = thread.around.before + thread.around.own
            order.append(thread)
        block.thread.own += n
        block.thread.remarks += len(text) < LENGTH_LOW and bool(_REMARK.search(text.lower()))
        whole += n
        in_articles += n if kind == ARTICLE else 0
    for thread in reversed(order):
        thread.inside += thread.own
        around = thread.around
        around.inside += thread.inside
        around.remarks += thread.remarks + (thread.level > WEAK)
    for thread in order:
        thread.out = thread.around.out or thread.decide(whole, in_articles)


def _undoubted(found: list[tuple[Block, str]], kinds: list[str], labels: list[str], doubted: list[Place]) -> set[int]:
    """The doubted places (by identity) that hold more than half of the text around them: of the article's text if they
    stand in one, else of the text that the densities call good, if no article has any."""
    inside = {id(p): [0, 0, 0] for p in doubted}
    articles = good = 0
    for (block, text), kind, label in zip(found, kinds, labels):
        if kind in (JUNK, COMMENT):
            continue
        articles += len(text) if kind == ARTICLE else 0
        good += len(text) if label == GOOD else 0
        if block.place.kind == DOUBTED:
            sums = inside[id(block.place)]
            sums[0] += len(text)
            sums[1] += len(text) if label == GOOD else 0
            sums[2] += label == GOOD
    for place in reversed(doubted):  # what lies in a place lies in those around it
        if place.around.kind == DOUBTED:
            outer = inside[id(place.around)]
            for k, v in enumerate(inside[id(place)]):
                outer[k] += v
    out = set()
    for place in doubted:
        every, own, n = inside[id(place)]
        if place.base.kind != JUNK and (2 * every > articles if place.base.kind == ARTICLE else not articles and n > 1 and 2 * own > good):
            out.add(id(place))
    return out


def _seeds(found: list[tuple[Block, str]], labels: list[str]) -> None:
    """On a page where nothing is good and no article stands: paragraphs with a middling share, if there are several, else
    rows of open blocks with several sentences."""
    near = [i for i, x in enumerate(labels) if x == NEAR]
    for i in near if len(near) > 1 else ():
        labels[i] = GOOD
    for x, row in groupby(range(len(labels)) if not near else (), key=lambda i: labels[i]):
        row = list(row)
        if x == OPEN and sum(found[i][1][-1] in ".!?。" for i in row) > 1:
            for i in row:
                labels[i] = GOOD


def label(found: list[tuple[Block, str]]) -> list[str]:
    """GOOD or BAD for each block and its text, by both passes."""
    shares = [stop_share(t) if len(t) >= LENGTH_LOW else 0.0 for _, t in found]
    links = [len(_clean(b.linked)) / len(t) if b.linked else 0.0 for b, t in found]
    kinds = [b.place.without_doubt().kind for b, _ in found]
    prose = [len(t) if k != JUNK and len(t) >= LENGTH_LOW and l <= LINKS_HIGH else 0 for (_, t), k, l in zip(found, kinds, links)]
    _threads_out(found, kinds, prose if any(prose) else [len(t) for _, t in found])
    kinds = [COMMENT if b.thread.out and k != JUNK else k for (b, _), k in zip(found, kinds)]
    fits = any(s >= STOP_LOW for s, k in zip(shares, kinds) if k in (PLAIN, ARTICLE))
    paragraphs = [i for i, (n, k) in enumerate(zip(prose, kinds)) if n and k != COMMENT]

    def first(i):
        block, text = found[i]
        low = text[:NOTICE_LENGTH].lower()
        if len(text) < LENGTH_LOW:
            none = begins_like_none(text, block.heading, bool(block.linked), not paragraphs or not paragraphs[0] < i < paragraphs[-1])
        else:
            none = len(text) < NOTICE_LENGTH and bool(_NOTICE.search(low) and _CONSENT.search(low))
        rights = len(text) < LENGTH_HIGH and (bool(_RIGHTS.search(low)) if text[0] == "©" and len(text) >= LENGTH_LOW else text[0] == "©" or "all rights reserved" in low)
        return decide(kinds[i], len(text), links[i], shares[i] if fits else None, block.heading, bool(block.linked), none, rights)

    labels = [first(i) for i in range(len(found))]
    doubted = _doubted(found)
    sure, lost = _undoubted(found, kinds, labels, doubted), set()
    for place in doubted:
        if id(place) not in sure or id(place.around) in lost:
            lost.add(id(place))
    for i, (block, _) in enumerate(found):
        if id(block.place) in lost:
            labels[i], kinds[i] = BAD, DOUBTED
    if GOOD not in labels and ARTICLE not in kinds:
        _seeds(found, labels)

    # the second pass: nearest decided blocks before and after; an article looks at its own blocks only
    def nearest(order, article):
        out, last = {}, None
        for i in order:
            if article and kinds[i] != ARTICLE:
                continue
            out[i] = last
            last = i if labels[i] in (GOOD, BAD) else last
        return out

    n = len(found)
    sides = {a: (nearest(range(n), a), nearest(reversed(range(n)), a)) for a in (False, True)}
    out = list(labels)
    for i, (block, _) in enumerate(found):
        if labels[i] in (GOOD, BAD):
            continue
        before, after = (side[i] for side in sides[kinds[i] == ARTICLE])
        if kinds[i] == ARTICLE:
            out[i] = BAD if all(j is not None and labels[j] == BAD for j in (before, after)) else GOOD
            continue
        own = [BAD if j is None else labels[j] for j in (before, after)]
        if own[0] == own[1] or labels[i] == NEAR:
            out[i] = GOOD if GOOD in own or labels[i] == NEAR and before is None and after is None else BAD
        elif block.heading and own[1] == GOOD:
            out[i] = GOOD
        else:
            out[i] = own[0] if before is not None and (after is None or i - before <= after - i) else own[1]
    return out


def extract(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by a blank line."""
    found = [(b, t) for b in blocks(page or "") if (t := _clean(b.parts))]
    return "\n\n".join(t for (_, t), x in zip(found, label(found)) if x == GOOD)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, then text string and n_chars long (code points), for every row of pages.

    Null and empty pages, and pages without an article, have the empty text. Character references are decoded, white space in
    a block becomes one space, blocks are joined by a blank line. Repeated rows stay, an empty table gives no rows, other
    columns are ignored. Very long and badly nested pages take time in proportion to their length. A task holds some 4 MB of
    pages, or one that is longer; rows are dealt over idle tasks only where the table has fewer splits than the cluster has cores.
    """

    def work(batches):
        for batch in batches:
            for at, to in stretches(batch.column(len(keep)), 4_000_000):
                b = batch.slice(at, to - at)
                texts = [extract(p) for p in b.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return dealt(pages.select(*keep, html_col)).mapInArrow(work, schema)
