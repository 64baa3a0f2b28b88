"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of the page is one line. Text lengths,
without link texts, are summed over sliding windows of lines. The text surges
where the sums rise over a threshold and dives where they fall below it again; a
stretch from a surge to its dive is kept if it weighs enough beside the heaviest
one, and so is all that lies between two kept stretches. Parts that the markup
itself calls menus, footers, adverts and the like, by their elements or by
their class, id or role, are no lines at all. Text inside article and main
elements weighs more, and such an element is one stretch.

Pages are read in one pass by a scanner that looks at every character a bounded
number of times, however broken the markup is. Open elements are kept on a stack;
elements with optional end tags are closed as HTML does.
"""

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines per window.
LINES = 3
#: Characters in a window at which text surges.
SURGE = 80
#: Weight of a character inside an article element.
ARTICLE_WEIGHT = 8
#: Share of the heaviest stretch's weight that another one needs.
LEAST_SHARE = 0.2

# Elements whose content is never article text.
SKIPPED = frozenset(
    "aside button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea".split()
)
# Elements inside a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements that hold nothing.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role names that mark other parts of a page.
OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe widget".split()
)
ARTICLE = frozenset(("article", "main"))

# Elements that are read up to their end tag, whatever they hold.
RAW = frozenset("script style textarea title".split())
# Elements that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Elements without need of an end tag, those that one of them ends, and those it stays inside.
OPTIONAL = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _marks_other_part(name: str, attributes: str) -> bool:
    """Whether class, id or role call an element some other part of the page."""
    if "=" not in attributes:
        return False
    for token in (t for found in _NAMES.findall(attributes) for t in "".join(found).lower().split()):
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if not words or words[0] in ("no", "has", "with", "without"):
            continue
        # An article that is open for comments is none.
        own = [token] if name in ARTICLE else words
        if any(w in OTHER_PARTS for w in own) or words[0] in ("comment", "advert", "sponsor") or (name not in ARTICLE and token.startswith(("comment", "advert", "sponsor"))):
            return True
    return False


def page_tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page's texts ("text") and tags ("open", "close")."""
    tokens, at, size = [], 0, len(page)
    last = {quote: page.rfind(quote) for quote in "\"'"}
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            tokens.append(("text", page[at:begin], ""))
        if begin == size:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        named = _NAME.match(page, begin + 1)
        if not named:
            tokens.append(("text", "<", ""))
            at = begin + 1
            continue
        # The tag ends at the first > outside quotes; a quote opens only behind an equals sign.
        end = named.end()
        while True:
            found = _STOP.search(page, end)
            if not found:
                end = size
                break
            end = found.end()
            if found[0] == ">":
                break
            # Only white space may stand between the sign and the quote; a little of it is looked at.
            if page[max(named.end(), end - 33):end - 1].rstrip()[-1:] == "=" and last[found[0]] >= end:
                end = page.find(found[0], end) + 1
        name, attributes = named[0].lower(), page[named.end():max(named.end(), end - 1)]
        at = end
        if name.startswith("/"):
            tokens.append(("close", name[1:], ""))
            continue
        tokens.append(("open", name, attributes))
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            if close:
                tokens.append(("raw", page[at:close.start()], ""))
                at = close.start()
            else:
                at = size
    return tokens


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, number of its article element or 0) of each block of a page."""
    tokens = page_tokens(page)
    last_close = {name: i for i, (kind, name, _) in enumerate(tokens) if kind == "close"}
    lines: list[tuple[str, int, int]] = []
    pieces: list[str] = []
    #: Open elements: name, whether it is left out, number of its article.
    stack: list[tuple[str, bool, int]] = []
    open_names: dict[str, int] = {}
    own = skipped = articles = 0

    def end_line():
        nonlocal own
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            lines.append((text, own, next((n for _, _, n in reversed(stack) if n), 0) if open_names.get("article") or open_names.get("main") else 0))
        pieces.clear()
        own = 0

    def pop():
        nonlocal skipped
        name, out, _ = stack.pop()
        open_names[name] -= 1
        skipped -= out

    def close(names, inside):
        """Closes the innermost of the names that is not outside one of ``inside``."""
        if not any(open_names.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                while len(stack) > depth:
                    pop()
                return
            if stack[depth][0] in inside:
                return

    for i, (kind, name, attributes) in enumerate(tokens):
        if kind == "text":
            if not skipped:
                pieces.append(name)
                own += 0 if open_names.get("a") else len(name.strip())
            continue
        if kind == "raw":
            continue
        if name not in INLINE and name != "img":
            end_line()
        elif name == "br":
            pieces.append(" ")
        if kind == "close":
            # The end of a part of a line doesn't end the block around it.
            close({name}, BLOCKS - {name} if name in INLINE else ())
            continue
        if name in BLOCKS:
            close({"p"}, BLOCKS - {"p"} | {"button", "td", "th", "li"})
        if name in OPTIONAL:
            close(*OPTIONAL[name])
        if name in ARTICLE:
            # A part without an end tag ends where an article starts.
            for depth, (other, out, _) in enumerate(stack):
                if out and last_close.get(other, -1) < i:
                    while len(stack) > depth:
                        pop()
                    break
        if name in EMPTY or attributes.endswith("/") and name not in BLOCKS:
            continue
        out = name not in ("html", "body") and (name in SKIPPED or name == "title" or _marks_other_part(name, attributes))
        articles += name in ARTICLE
        if out and name in INLINE:
            pieces.append(" ")
        stack.append((name, out, articles if name in ARTICLE else 0))
        open_names[name] = open_names.get(name, 0) + 1
        skipped += out
    end_line()
    return lines


def main_lines(lines: list[tuple[str, int, int]], window: int = LINES, surge: int = SURGE) -> list[str]:
    """The lines of the stretches between surges and dives that weigh enough, and all between them."""
    weights = [own * (ARTICLE_WEIGHT if article else 1) for _, own, article in lines]
    sums = [sum(weights[i:i + window]) for i in range(len(lines))]
    stretches: list[list[int]] = []
    for i, (_, own, article) in enumerate(lines):
        if not own or not (sums[i] >= surge or article):
            continue
        # A window reaches forward: its last line with text is above the threshold with it.
        end = max([j for j in range(i, min(i + window, len(lines))) if weights[j] > 0]) if sums[i] >= surge else i
        same = stretches and (i <= stretches[-1][1] + 1 or article and lines[stretches[-1][1]][2] == article)
        if same:
            stretches[-1][1] = max(stretches[-1][1], end)
        else:
            stretches.append([i, end])
    weighed = [sum(weights[a:b + 1]) for a, b in stretches]
    kept = [s for s, weight in zip(stretches, weighed) if weight >= LEAST_SHARE * max(weighed)]
    return [text for text, _, _ in lines[kept[0][0]:kept[-1][1] + 1]] if kept else []


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(page_lines(page))) if page else ""


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Lines are joined by a blank line. A null or empty page, or one without
    text, has an empty text and 0 characters. The whole page is read; nothing is
    cut. Repeated rows stay repeated.
    """
    texts = pages.select("page_id", "url", _main_text(F.col("html").cast("string")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
