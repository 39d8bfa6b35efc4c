"""Main text of web pages by consensus paths of their hosts.

Each page scores its containers and votes for the generalised tag-class path of the best. Spark counts the votes by
host, and every page is extracted again from the container on its host's winning path; a page without that container,
or without a host, uses its own best.

Words of classes and ids only lower a container's score. Below the winner, what they mark is left out where the winner
holds other text beside it; inline elements are never left out and never part a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, spread_join, with_row
from .url_filter import url_parts

#: Hosts whose winning paths are broadcast; with more the pages are joined to them by a shuffle.
BROADCAST_HOSTS = 20_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[/a-zA-Z][^<>]*\Z""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Elements whose content is no text of the page; up to their end tag nothing is read.
RAW = _words("script style textarea title noscript iframe template svg button select object video audio canvas")
INLINE = _words("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input")
HOLDERS = _words("html body div article main section td table tbody tr center figure details form")
HEAD = _words("meta link title style script base noscript template head")
ITEMS = {"li": _words("ul ol"), "dt": _words("dl"), "dd": _words("dl"), "tr": _words("table"), "td": _words("table"), "th": _words("table")}
#: Elements and roles that are no part of an article, wherever they stand below the winner.
ASIDE = _words("nav footer aside menu dialog head")
ROLES = _words("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar")

PLAIN, WEAK, STRONG, NEVER = range(4)
#: What a mark leaves of a container's score, and what may stand beside a marked container, as a share of its letters,
#: for it to be the article's holder and stay.
FACTOR, BESIDE = (1.0, 0.3, 0.05, 0.05), (0.0, 1.0, 0.02, -1.0)
STRONG_WORDS = _words("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors banner banners sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr popup newsletter signup related recommended recommendation recommendations comment comments commentlist disqus pagination pager toolbar login promo promos promotion werbung anzeige anzeigen publicidad publicite kommentare kommentar commentaires comentarios feedback notice notices notification")
WEAK_WORDS = _words("side widget widgets modal overlay share sharing social search subscribe subscription respond reply replies discussion foot")
#: Elements that names may mark: containers. Headings, paragraphs, quotations and tables are the article's own.
MARKED = _words("div section article aside ul ol dl form details td center")
#: Words that also name the topic of a part of an article. Within an article they mark only what has little text beside links.
TOPICS = _words("sponsor sponsors sponsored banner banners navigation related recommended recommendation recommendations promo promos promotion search share sharing social widget widgets reply replies discussion subscription side foot menu menus login notification")
LITTLE = 80
#: Parts of a name that say nothing of their own beside such words.
NEUTRAL = _words("box bar block wrap wrapper container list area section inner outer left right top bottom site page main post posts article articles entry links link item items icons panel unit slot zone row col primary secondary global user reader text title thread form policy message buttons tools in the and")
HEADER_PARTS = _words("site page top global main header")
HINTS = re.compile(r"(?:^|[^a-z])(?:content|article|post|entry|story|main|body|text)(?![a-z])")


def topical(names: str) -> bool:
    """Whether all words of a name that mark may also name a topic."""
    parts = set(re.split(r"[^a-z]+", names)) & (STRONG_WORDS | WEAK_WORDS)
    return parts <= TOPICS


def mark_of(names: str, inside: bool) -> int:
    """PLAIN, WEAK or STRONG for the names of a class and an id; ``inside`` an article or main element.

    A name marks if all its parts are words of the lists, neutral ones or numbers: "ad-box" does, "market-share" does not.
    """
    found = PLAIN
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x and not (len(x) == 1 and x == "x")]
        if not parts:
            continue
        strong, weak = not STRONG_WORDS.isdisjoint(parts), not WEAK_WORDS.isdisjoint(parts)
        if (strong or weak) and all(x in STRONG_WORDS or x in WEAK_WORDS or x in NEUTRAL for x in parts):
            if inside and parts == ["discussion"]:
                continue
            found = max(found, STRONG if strong else WEAK)
        elif not inside and "header" in parts and HEADER_PARTS.issuperset(parts):
            found = STRONG
    return found


class Page:
    """The text blocks of a page in order and the tree of containers they stand in.

    Node 0 and path 0 are the page itself. Each node has a parent, a path, a mark and letters; nodes of the same path
    (tag and first class of every container above) share its number. All lists are built in one walk, in linear time.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int]] = []  # node, text, letters in links
        self.parent, self.path, self.mark, self.holds = [0], [0], [PLAIN], [True]
        self.steps, self.paths, self.above = [""], {}, [0]
        self.topic: list[int] = []  # marked nodes that may be a part of the article
        self._walk(html)
        self.letters, linked = [0] * len(self.parent), [0] * len(self.parent)
        for node, text, links in self.blocks:
            self.letters[node] += max(0, len(text) - links)
            linked[node] += links
        for n in range(len(self.parent) - 1, 0, -1):
            self.letters[self.parent[n]] += self.letters[n]
            linked[self.parent[n]] += linked[n]
        for n in self.topic:
            if self.letters[n] >= LITTLE and self.letters[n] > linked[n]:
                self.mark[n] = PLAIN

    def _walk(self, html: str) -> None:
        stack: list[tuple[str, int]] = []  # tag, node that holds what is in it
        places: dict[str, list[int]] = {}  # where each tag stands in the stack
        walls: list[int] = []  # where the holders stand
        endless: set[str] = set()
        parts: list[str] = []
        node = links = at = 0

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((node, text, min(links, len(text))))
                parts.clear()
            links = 0

        def close(tag: str, floor: int = -1) -> None:
            """Pop up to the nearest open ``tag`` if it stands above ``floor``."""
            nonlocal node
            where = places.get(tag)
            if not where or where[-1] < floor:
                return
            upto = where[-1]
            while len(stack) > upto:
                gone, _ = stack.pop()
                places[gone].pop()
            while walls and walls[-1] >= upto:
                walls.pop()
            node = stack[-1][1] if stack else 0

        def say(raw: str) -> None:
            nonlocal links
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if places.get("a"):
                links += len(text)

        while at < len(html):
            m = TAG.search(html, at)
            if m is None:
                say(html[at:])
                break
            if m.start() > at:
                say(html[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if tag in RAW:
                if not m[1]:
                    end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if end:
                        at = end.end()
                    else:  # never closed: a script has no text in it, of others only the text up to the next tag is theirs
                        endless.add(tag)
                        after = -1 if tag in ("script", "style") else html.find("<", at)
                        at = after if after >= 0 else len(html)
                continue
            if tag == "br":
                parts.append(" ")
                continue
            inline = tag in INLINE
            if not inline:
                flush()
            if m[1]:
                close(tag, -1 if tag in HOLDERS or tag in ASIDE else walls[-1] if walls else -1)
                continue
            if tag in VOID or inline and m[3].endswith("/"):
                continue
            if inline:
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, node))
                continue
            if tag not in HEAD and places.get("head"):
                close("head")
            close("p", walls[-1] if walls else -1)
            if tag in ITEMS:
                close(tag, max((places[t][-1] for t in ITEMS[tag] if places.get(t)), default=-1))
            self._open(tag, m[3], node, bool(places.get("article") or places.get("main")))
            if len(self.parent) > self._last:
                node = self._last
            places.setdefault(tag, []).append(len(stack))
            if tag in HOLDERS:
                walls.append(len(stack))
            stack.append((tag, node))
        flush()

    def _open(self, tag: str, attributes: str, node: int, inside: bool) -> None:
        """A node for an element that is a step of the path or marked; ``_last`` is the node that holds its content."""
        mark, attrs = PLAIN, {}
        if attributes.strip(" /\t\r\n"):
            attrs = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in ATTR.findall(attributes)}
        names = "" if tag not in MARKED else attrs.get("class", "") if tag == "article" else f"{attrs.get('class', '')} {attrs.get('id', '')}"
        if tag in ASIDE or tag == "header" and not inside or attrs.get("role") in ROLES or "hidden" in attrs:
            mark = NEVER
        elif names.strip():
            mark = mark_of(names, inside)
        if tag == "form" and mark < WEAK:
            mark = WEAK
        step = ""
        if tag in HOLDERS:
            first = attrs.get("class", "").split()
            step = tag + ("." + re.sub(r"\d+", "#", first[0]) if first else "#" + "_".join(re.sub(r"\d+", "#", attrs["id"]).split()) if attrs.get("id") else "")
        if not step and not mark:
            self._last = node
            return
        path = self.path[node]
        if step:
            path = self.paths.setdefault((path, step), len(self.steps))
            if path == len(self.steps):
                self.steps.append(step)
                self.above.append(self.path[node])
        self.parent.append(node)
        self.path.append(path)
        self.mark.append(mark)
        self.holds.append(bool(step))
        if inside and mark in (WEAK, STRONG) and tag != "form" and topical(names):
            self.topic.append(len(self.parent) - 1)
        self._last = len(self.parent) - 1

    def best(self) -> tuple[str | None, float]:
        """The path that scores best, and its score; (None, 0) without text.

        A block is worth its letters outside links and its commas, less by the marks above it. Each level up costs a
        little, so the innermost container of the whole text wins; article, main and telling class names count more.
        """
        if not self.blocks:
            return None, 0.0
        factor = [1.0] * len(self.parent)
        for n in range(1, len(self.parent)):
            factor[n] = max(factor[self.parent[n]] * FACTOR[self.mark[n]], 1e-6)
        scores = [0.0] * len(self.steps)
        for node, text, links in self.blocks:
            scores[self.path[node]] += (max(0.01, len(text) - 2 * links) + 5 * text.count(",")) * factor[node]
        for p in range(len(self.steps) - 1, 0, -1):
            scores[self.above[p]] += 0.97 * scores[p]
        top, most = 0, -1.0
        for p, step in enumerate(self.steps):
            name = re.split("[.#]", step, maxsplit=1)[0]
            weighed = scores[p] * (1.6 if name in ("article", "main") else 1.3 if HINTS.search(step, len(name)) else 1.0)
            if weighed > most:
                top, most = p, weighed
        names = []
        while top:
            names.append(self.steps[top])
            top = self.above[top]
        return " ".join(reversed(names)), most

    def find(self, path: str) -> int | None:
        """The number of a path on this page."""
        at: int | None = 0
        for step in path.split():
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at

    def text_on(self, path: str | None) -> str:
        """The blocks below ``path``, else below the page's own best path, without what is marked there."""
        if not self.blocks:
            return ""
        wanted = None if path is None else self.find(path)
        chosen = self._below(wanted) if wanted is not None else []
        if not chosen:
            chosen = self._below(self.find(self.best()[0] or "") or 0)
        return "\n\n".join(chosen)

    def _below(self, wanted: int) -> list[str]:
        inside, out = [wanted == 0], [False]
        every = 0 if wanted else self.letters[0]
        for n in range(1, len(self.parent)):
            if wanted and self.path[n] == wanted and self.holds[n]:
                every += self.letters[n]
        for n in range(1, len(self.parent)):
            up = self.parent[n]
            if inside[up]:
                inside.append(True)
                kept = self.mark[n] == PLAIN or every - self.letters[n] <= BESIDE[self.mark[n]] * self.letters[n]
                out.append(out[up] or not kept)
            else:
                inside.append(self.path[n] == wanted and self.holds[n])
                out.append(False)
        return [text for node, text, _ in self.blocks if inside[node] and not out[node]]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of ``pages``: row_no, page_id, url, text, n_chars (code points).

    A null html counts as empty and gives an empty text; an empty table gives no rows. A page whose url is null or has no
    host neither votes nor follows a vote. Ties between paths go to the higher score, then to the greater path. Repeated
    rows vote and are extracted each for itself. Other columns are not read.
    """
    ship(pages.sparkSession)
    numbered, row = with_row(pages)
    host, _ = url_parts(F.col(url_col))
    source = numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [Page(h).best() for h in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "path": [p for p, _ in best], "score": [s for _, s in best]})

    votes = source.filter("host <> ''").select("host", "html").mapInPandas(vote, "host string, path string, score double")
    tally = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    order = F.struct(F.col("path").isNotNull().alias("some"), F.col("votes"), F.col("score"), F.col("path"))
    winners = settle(tally.groupBy("host").agg(F.sum("votes").alias("n"), F.max(order).getField("path").alias("path")), "html-paths")

    @F.pandas_udf("string")
    def again(htmls: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([Page(h).text_on(p) for h, p in zip(htmls, paths, strict=True)], dtype=object)

    if winners.count() <= BROADCAST_HOSTS:
        joined = source.join(F.broadcast(winners), "host", "left")
    else:
        alone = source.filter("host = ''").withColumn("path", F.lit(None).cast("string"))
        joined = spread_join(source.filter("host <> ''"), winners, ["host"], "n", F.col("row_no")).drop("n").unionByName(alone)
    out = joined.select("row_no", "page_id", "url", again("html", "path").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", "n_chars")
