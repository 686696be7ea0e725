"""Main text of web pages by consensus of a host's pages on where the article stands.

A page is cut into blocks of text, each under a chain of containers.  A container's generalised path is the tags and classes from the body
down, numbers replaced by a mark.  Containers are scored by the plain text of the blocks in them (linked text counts against it),
in full for the nearest and less for those further up; a container within an article (or main part) votes as that.
Each page votes for its best path; the path with most votes of a host wins, by Spark's aggregation; and all pages of the host are extracted anew
from the containers on the winning path.  A page without such a container uses its own best one.

Never part of the text: scripts, styles and other raw content, forms and controls, navigation, headers (outside an article), footers and asides, and containers
whose class, id or role names them as menus, notices, adverts, sidebars, comments and the like.  Names that an article's own parts may bear too (search,
share, tags, related and so on) count outside articles; within one, such a part goes if most of it is links, or if it is short and
without a sentence.  Formulas, drawings and objects keep their text.  Character references
are decoded, white space within a block becomes one space, and blocks are joined by line ends in page order.

A page is read in time and memory in proportion to its length, however deep it nests.  Winning paths are broadcast while their bytes
are few (summed first), else joined by host.

Edge cases: a null html is empty and gives an empty text; pages without a usable host form a host of their own (the empty one); unclosed and stray
tags are closed and ignored as browsers would, near enough; repeated rows get a row each; null ids are passed by, as are columns besides those
named, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_batches, sliced, stored, unnamed, with_fields

#: Most bytes of winning paths that are broadcast.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|template|iframe|canvas|textarea|title|select|audio|video)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s/\"']))(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)
_SENTENCE = re.compile(r"[.!?\u2026\u3002]\W*$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body main section div td center fieldset figure details table".split())
BLOCKS = CONTAINERS | frozenset("address blockquote dd dl dt figcaption footer form h1 h2 h3 h4 h5 h6 header hr li nav ol p pre summary tbody tfoot th thead tr ul aside br menu".split())
#: Start tags that close an open paragraph.
CLOSES_P = BLOCKS - {"br"}
DROPPED = frozenset("nav footer aside form button menu dialog head datalist label".split())
#: Words of a class, id or role that name what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion sidebar aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay "
    "comment comments commentlist disqus pagination pager contentinfo complementary".split()
)
#: Those that parts of an article may bear too.
MAYBE = frozenset("social share sharing related recommended recommendations respond reply replies widget widgets tags toc skip search".split())
#: Those that only count outside an article, as articles have headers of their own.
HEADS = frozenset("header heading head".split())
#: Characters below which a part of such a name is short.
SHORT = 120


class Page:
    """Blocks of a page: (container, text, characters of it in links). Container 0 is the body; each has its parent and its own step of the path."""

    def __init__(self, source: str) -> None:
        self.steps, self.parents, self.tags = [""], [-1], ["body"]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        # Open elements: tag, container before it, whether it is dropped, and the part in question before it.
        stack: list[tuple[str, int, bool, int]] = []
        open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag, and by kind of tag
        container, dropped, links, articles, doubt = 0, 0, 0, 0, -1
        doubts: list[list] = []  # characters, those in links, and whether there is a sentence
        of_block: list[int] = []
        parts: list[str] = []
        linked = 0
        at = 0

        def kinds(tag: str) -> Iterator[str]:
            yield tag
            if tag in CONTAINERS:
                yield "(container)"
            if tag in ("ul", "ol", "menu"):
                yield "(list)"

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((container, text, min(linked, len(text))))
                    of_block.append(doubt)
                    if doubt >= 0:
                        d = doubts[doubt]
                        d[0], d[1], d[2] = d[0] + len(text), d[1] + min(linked, len(text)), d[2] or bool(_SENTENCE.search(text))
                parts.clear()
            linked = 0

        def close(depth: int) -> None:
            """Close open elements down to `depth`."""
            nonlocal container, dropped, links, articles, doubt
            while len(stack) > depth:
                tag, before, off, asked = stack[-1]
                if tag in BLOCKS:
                    flush()
                stack.pop()
                for kind in kinds(tag):
                    open_at[kind].pop()
                container, doubt = before, asked
                dropped -= off
                links -= tag == "a"
                articles -= tag in ("article", "main")

        def close_last(tag: str, unless: str) -> None:
            """Close the last open element of a tag, unless one of another kind was opened in it."""
            if open_at[tag] and not (open_at[unless] and open_at[unless][-1] > open_at[tag][-1]):
                close(open_at[tag][-1])

        for m in _TOKEN.finditer(source):
            a, b = m.span()
            if a > at and not dropped:
                text = html_lib.unescape(source[at:a])
                parts.append(text)
                if links:
                    linked += len(text)
            at = b
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            if m[2] or m[5]:
                if open_at[tag]:
                    if tag in BLOCKS:
                        flush()
                    close(open_at[tag][-1])
                elif tag in ("p", "br"):
                    flush()
                continue
            if tag in BLOCKS:
                flush()
            if tag in ("html", "body") or tag in VOID:
                continue
            if tag in CLOSES_P:
                close_last("p", "(container)")
            if tag == "a" and links:
                close(open_at["a"][-1])
            if tag == "li":
                close_last("li", "(list)")
            attributes = m[4] if m[3] else m[7]
            off, maybe, step = self._judge(tag, attributes, articles)
            if (attributes or "").endswith("/") and tag not in CONTAINERS and tag not in BLOCKS and tag != "a":
                continue
            for kind in kinds(tag):
                open_at[kind].append(len(stack))
            stack.append((tag, container, off, doubt))
            dropped += off
            links += tag == "a"
            articles += tag in ("article", "main")
            if maybe and doubt < 0 and not dropped:
                doubts.append([0, 0, False])
                doubt = len(doubts) - 1
            if tag in CONTAINERS and not dropped:
                self.steps.append(step)
                self.parents.append(container)
                self.tags.append("article" if tag == "article" or "articlebody" in step else tag)
                container = len(self.steps) - 1
        if at < len(source) and not dropped:
            rest = source[at:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the page ends in
            parts.append(html_lib.unescape(rest[: cut.start()] if cut else rest))
        close(0)
        flush()
        gone = {i for i, (size, links, sentence) in enumerate(doubts) if 2 * links >= size or (size < SHORT and not sentence)}
        if gone:
            self.blocks = [x for x, d in zip(self.blocks, of_block, strict=True) if d not in gone]

    @staticmethod
    def _judge(tag: str, attributes: str | None, articles: int) -> tuple[bool, bool, str]:
        """Whether an element is dropped, whether it may be, by what it holds, and its step in a path."""
        if tag in DROPPED or (tag == "header" and not articles):
            return True, False, tag
        if not attributes or attributes == "/":
            return False, False, tag
        words: set[str] = set()
        step = tag
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, False, tag
            if name in ("class", "id", "role"):
                words.update(re.split(r"[\s_\-]+", value))
            if name == "class":
                step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c).replace(">", "_") for c in value.split()})])
            elif name == "itemprop" and value == "articlebody":
                step += ".articlebody"
        if tag in ("article", "main", "body", "html"):
            return False, False, step
        maybe = bool(words & MAYBE)
        off = bool(words & NAMES) or (not articles and (maybe or bool(words & HEADS) and tag in ("div", "section", "td")))
        return off, maybe and not off, step

    def path(self, c: int) -> str:
        """The generalised path of a container."""
        steps = []
        while c > 0:
            steps.append(self.steps[c])
            c = self.parents[c]
        return "".join(f">{s}" for s in reversed(steps))

    def best(self) -> tuple[str, float]:
        """The generalised path of the best container, and its score."""
        scores: dict[int, float] = defaultdict(float)
        for c, text, linked in self.blocks:
            share, plain = 1.0, len(text) - 2 * linked
            while c >= 0 and share > 1e-4:  # what is further up gets next to nothing
                scores[c] += plain * share
                share = share / 2 if share == 1.0 else share * 2 / 3
                c = self.parents[c]
        if not scores:
            return "", 0.0
        c = max(scores, key=lambda c: (scores[c], -c))
        score, up = scores[c], c
        while up >= 0:  # the outermost article around it, or else the main part
            if self.tags[up] == "article" or (self.tags[up] == "main" and self.tags[c] != "article"):
                c = up
            up = self.parents[up]
        return self.path(c), score

    def text(self, path: str) -> str | None:
        """The text of all containers on a path; None if there are none."""
        steps = path.split(">")[1:]
        # How many steps of the path a container's own path consists of, if it is the beginning of that; within: whether it is on the path or in one that is.
        met, within = [0], [not steps]
        for c in range(1, len(self.steps)):  # parents come before their children
            n = met[self.parents[c]]
            n = n + 1 if 0 <= n < len(steps) and steps[n] == self.steps[c] else -1
            met.append(n)
            within.append(n == len(steps) or within[self.parents[c]])
        return "\n".join(t for c, t, _ in self.blocks if within[c]) if any(within) else None


def host(url: Column) -> Column:
    """The host of a url, in lower case and without a leading www or m; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.|m\.)?([^/?#:]+)", 1)
    return F.coalesce(found, F.lit(""))


def vote(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """host and path: the winning path of each host."""

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sums: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, score = Page(source or "").best()
                if score > 0:
                    s = sums[h, path]
                    s[0] += 1
                    s[1] += round(score)
            hosts, paths = zip(*sums, strict=True) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *(pa.array([s[i] for s in sums.values()], pa.int64()) for i in (0, 1))], names=["host", "path", "votes", "score"])

    votes = pages.select(host_col, html_col).mapInArrow(ballots, "host string, path string, votes bigint, score bigint")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with all their columns but the html, and main_text, in place of a column of that name."""
    pages = pages.drop("main_text")
    bound_batches(pages.sparkSession)
    inner = unnamed(pages)
    url, html = (f"_in{pages.columns.index(c)}" for c in (url_col, html_col))
    hosted = inner.withColumn("_host", host(F.col(url)))
    winners = stored(vote(hosted, "_host", html), "winners").select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    if (winners.agg(F.sum(F.octet_length("_host") + F.octet_length("_path") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        winners = F.broadcast(winners)
    keep = [c for c in inner.columns if c != html]
    joined = hosted.join(winners, "_host", "left").select(*keep, "_path", html)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for path, source in zip(batch.column("_path").to_pylist(), batch.column(html).to_pylist(), strict=True):
                page = Page(source or "")
                text = page.text(path) if path is not None else None
                out.append(text or page.text(page.best()[0]) or "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "main_text"])

    found = joined.mapInArrow(texts, with_fields(inner.select(*keep).schema, "main_text string"))
    return found.toDF(*(c for c in pages.columns if c != html_col), "main_text")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))
