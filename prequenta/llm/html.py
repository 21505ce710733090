"""Main text of web pages by consensus of their host.

Pages of a host share templates, so they agree on where the article is. Three steps:

1. per page, every container (``div``, ``article``, ``section`` ...) is scored by the text it holds,
   by its share of links and by its kind; words of class and role that hint at something beside the
   article count against a container and against the containers around it, but drop no text. Only
   elements that are menus, adverts and the like by tag, role, a whole class name or a whole id are
   dropped, and forms, unless a form holds most of the page. The page votes for the generalised
   tag-class path of its best container (digits out, ids ignored), and lists the paths of the
   elements below it that words of class, role or id hint at;
2. the votes are counted per host and path in Spark (pre-aggregated, so a host may hold any share
   of the pages), and the path with most votes wins (ties: higher total score, then smaller path).
   Hinted elements that stand below the article on half of a host's pages (``COMMON_PAGES`` at least)
   are part of its template and are dropped on all; the slug of one heading is on one page;
3. every page is extracted again with its host's winning path, or with its own best container if
   it has none on that path.

The winners have one short row per host; they are broadcast up to ``BROADCAST_HOSTS`` hosts, and
joined on (host, salt) beyond, which gives the same rows.

Edge cases: a NULL or empty html gives an empty text; a NULL or odd url means no host, so the page
decides alone; tags may be unclosed or wrongly nested; repeated rows are all reported; an empty
table gives an empty result; other columns pass through ``extract_text`` as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prequenta.llm.common import table, written

BROADCAST_HOSTS = 200_000
SALTS = 64
COMMON_PAGES = 3

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)""", re.S
)
RAW = {"script", "style", "template", "iframe", "textarea", "title", "svg", "select", "canvas", "video", "audio", "annotation", "annotation-xml"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr object math semantics mrow mi mn mo ms mtext mspace msub msup msubsup mfrac msqrt mroot mover "
    "munder munderover mstyle mpadded mphantom merror menclose mmultiscripts mprescripts mtable mtr mtd mlabeledtr".split()
)
VOID = set("area base col embed hr input link meta param source track".split())
CONTAINERS = set("article body center div main section td".split())
ASIDE_TAGS = set("nav footer aside menu dialog button fieldset head".split())
SAFE_TAGS = {"html", "body", "main", "article"}
# Whole names of class and role that are never part of the article.
ASIDE_CLASSES = set(
    "ad ads adv ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle advert adverts advertisement advertising banner-ad "
    "breadcrumb breadcrumbs comment comment-body comment-form comment-list comment-thread commentlist comments comments-area comments-list "
    "comments-section cookie cookie-banner cookie-bar cookie-consent cookie-notice cookies disqus disqus-thread masthead nav navbar navigation "
    "newsletter-signup notice notices pagination pager promo promo-box promo-banner reader-comments related-articles related-posts share-buttons "
    "sidebar site-footer site-header site-nav skip-link social-links social-share sponsored sponsored-content user-comment user-comments".split()
)
SIZED_AD = re.compile(r"(?:ad|ads|adv|advert|banner)-?\d+x\d+")
# Whole ids of what pages have once.
ASIDE_IDS = set(
    "ads breadcrumbs comments comments-list commentlist cookie-banner cookie-consent cookie-notice cookies disqus-thread footer masthead nav navbar "
    "navigation pagination reader-comments respond sidebar site-footer site-header user-comments".split()
)
ASIDE_ROLES = set("alertdialog banner dialog menu menubar navigation search toolbar".split())
# Words of class and role that hint at what is not the article; they only weigh.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright dialog disclaimer discussion disqus foot footer gdpr header hidden legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promoted reader related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
BEFORE = {"has", "with", "no", "without"}  # "has-sidebar" is not a sidebar
ASIDE_WEIGHT = 0.25  # of a container with such words
ASIDE_SHARE = -0.1  # of its text in the containers around it
ARTICLE_WORDS = set("article blog body content entry main page post story text".split())
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())


class Page:
    """Blocks of text and the containers around them, read in one pass."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, bool, int]] = []  # (text, link characters, innermost container, marked below it, hinted element)
        self.sides: list[tuple[str, int, int]] = []  # hinted elements: (path, container around, hinted element around or -1)
        self.paths: list[str] = [""]  # by container
        self.parents: list[int] = [-1]
        self.weights: list[float] = [0.5]
        self.marked: list[bool] = [False]  # or below something marked within the container around
        self._read(source)

    def _read(self, source: str) -> None:
        # Open elements: (tag, container, text is left out, inside an article, header of an article, marked below the container, hinted element, form)
        stack: list[tuple[str, int, bool, bool, bool, bool, int, int]] = [("", 0, False, False, False, False, -1, -1)]
        piece: list[str] = []
        linked = links = at = 0
        forms: list[int] = []  # of each block
        around: list[int] = []  # of each form the form around it

        def flush() -> None:
            nonlocal linked
            if piece:
                tag, container, out, _, header, marked, side, form = stack[-1]
                text = "" if out or (header and tag not in HEADINGS) else " ".join(html.unescape("".join(piece)).split())
                if text:
                    self.blocks.append((text, min(linked, len(text)), container, marked, side))
                    forms.append(form)
                piece.clear()
            linked = 0

        def close(tag: str, until: set[str] = frozenset()) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    return
                if stack[i][0] in until:
                    return

        while at < len(source):
            tag_at = source.find("<", at)
            token = TAG.match(source, tag_at) if tag_at >= 0 else None
            end = tag_at if token else (tag_at + 1 if tag_at >= 0 else len(source))
            if end > at:
                piece.append(source[at:end])
                if links:
                    linked += end - at
            if token is None:
                at = end
                continue
            at = token.end()
            if token[2] is None:
                continue
            name = token[2].lower()
            if name in RAW:
                if not token[1] and not token[3].endswith("/>"):
                    done = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = done.end() if done else len(source)
            elif name in INLINE:
                if name == "a":
                    links = 0 if token[1] else 1
                elif name in ("br", "img", "wbr"):
                    piece.append(" ")
            elif token[1]:
                flush()
                links = 0
                close(name)
            else:
                flush()
                links = 0
                if name in CLOSES_P:
                    close("p", CONTAINERS | {"li", "blockquote"})
                if name in CLOSES_SAME:
                    close(name, CLOSES_SAME[name])
                if name not in VOID and not token[3].endswith("/>"):
                    opened = self._opened(name, token[3], stack[-1])
                    if name == "form":
                        around.append(opened[-1])
                        opened = *opened[:-1], len(around) - 1
                    stack.append(opened)
        flush()
        if around:
            # A form around most of the page is how its server works; others are left out.
            held = [0] * len(around)
            for block, form in zip(self.blocks, forms, strict=True):
                if form >= 0:
                    held[form] += len(block[0])
            for form in range(len(around) - 1, -1, -1):
                if around[form] >= 0:
                    held[around[form]] += held[form]
            most = sum(len(block[0]) for block in self.blocks) / 2
            kept: list[bool] = []
            for form, outer in enumerate(around):
                kept.append(held[form] > most and (outer < 0 or kept[outer]))
            self.blocks = [block for block, form in zip(self.blocks, forms, strict=True) if form < 0 or kept[form]]

    def _opened(self, name: str, attributes: str, parent: tuple[str, int, bool, bool, bool, bool, int, int]) -> tuple[str, int, bool, bool, bool, bool, int, int]:
        _, container, out, inside, header, marked, side, form = parent
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)} if len(attributes) > 1 else {}
        kind = _words(found.get("class", ""))
        role = _words(found.get("role", ""))
        slug = _words(found.get("id", ""))
        marks = kind + slug + role
        hinted = False
        if name not in SAFE_TAGS and not out:
            hints = kind + role  # an id is a slug of its title more often than not
            hinted = any(w in ASIDE_WORDS and (i == 0 or hints[i - 1] not in BEFORE) for i, w in enumerate(hints))
            hinted = hinted and ARTICLE_WORDS.isdisjoint(hints)
            classes = found.get("class", "").lower().replace("_", "-").split()
            aside = not ASIDE_CLASSES.isdisjoint(classes) or any(map(SIZED_AD.fullmatch, classes))
            aside = aside or found.get("id", "").lower().replace("_", "-") in ASIDE_IDS or not ASIDE_ROLES.isdisjoint(found.get("role", "").lower().split())
            unseen = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            out = name in ASIDE_TAGS or aside or unseen or (name == "header" and not inside)
            if hinted or not ASIDE_WORDS.isdisjoint(slug):
                label = ".".join([name, *sorted(set(kind + role))]) + "".join(f"#{w}" for w in slug)
                self.sides.append((f"{self.paths[container]}/{label}", container, side))
                side = len(self.sides) - 1
        if name in CONTAINERS:
            label = ".".join([name, *sorted(set(kind))])
            self.paths.append(f"{self.paths[container]}/{label}")
            self.parents.append(container)
            likely = bool(ARTICLE_WORDS.intersection(marks))
            self.weights.append({"article": 2.0, "main": 1.4, "body": 0.5}.get(name, 1.3 if likely else 1.0) * (ASIDE_WEIGHT if hinted else 1.0))
            self.marked.append(marked or hinted)
            container, marked = len(self.paths) - 1, False
        else:
            marked = marked or hinted
        return name, container, out, inside or name == "article", header or (name == "header" and inside), marked, side, form

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; deeper ones win among equals."""
        # Characters of text, of those in links, and of marked text.
        size, link, beside = [0] * len(self.paths), [0] * len(self.paths), [0] * len(self.paths)
        for text, linked, container, marked, _ in self.blocks:
            if marked:
                beside[container] += len(text)
            else:
                size[container] += len(text)
                link[container] += linked
        for i in range(len(self.paths) - 1, 0, -1):  # children come after their parents
            if self.marked[i]:
                beside[self.parents[i]] += size[i] + beside[i]
            else:
                size[self.parents[i]] += size[i]
                link[self.parents[i]] += link[i]
                beside[self.parents[i]] += beside[i]
        scores = [
            (w * (n - a + ASIDE_SHARE * b) * (1 + 0.01 * p.count("/")), p)
            for w, n, a, b, p in zip(self.weights, size, link, beside, self.paths, strict=True)
            if n or b
        ]
        score, path = max(scores, default=(0.0, ""))
        return path, score

    def _within(self, path: str) -> list[bool]:
        within = [p == path for p in self.paths]
        for i in range(1, len(within)):
            within[i] = within[i] or within[self.parents[i]]
        return within

    def sides_below(self, path: str) -> set[str]:
        """Paths of the hinted elements below the containers on a path."""
        within = self._within(path)
        return {side for side, container, _ in self.sides if within[container]}

    def text(self, path: str, common: frozenset[str] = frozenset()) -> str:
        """The blocks below all containers on a path, in page order, without those of hinted elements that are common."""
        within = self._within(path)
        dropped: list[bool] = []
        for side, container, around in self.sides:
            dropped.append((side in common and within[container]) or (around >= 0 and dropped[around]))
        return "\n".join(text for text, _, container, _, side in self.blocks if within[container] and not (side >= 0 and dropped[side]))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; NULL if there is none."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.when(host != "", host)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = []
        for source in batch.column(1).to_pylist():
            page = Page(source or "")
            path, score = page.best()
            votes.append((path, score, sorted(page.sides_below(path)) if path else []))
        kinds = pa.string(), pa.float64(), pa.list_(pa.string())
        columns = [pa.array([v[i] for v in votes], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "path", "score", "sides"])


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, common): the winning path of each host, and its hinted elements that half of the pages have."""
    hosted = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html")).where("host IS NOT NULL")
    votes = hosted.mapInArrow(_votes, "host string, path string, score double, sides array<string>").where("path != ''")
    votes = written(votes, "host-votes")
    # Scores are summed as whole numbers, so that the order of the rows cannot matter.
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("long")).alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    winners = counted.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("host", "path")
    seen = votes.select("host", F.explode("sides").alias("side")).groupBy("host", "side").agg(F.count("*").alias("pages"))
    sizes = counted.groupBy("host").agg(F.sum("n").alias("n"))
    # Each has half of the pages, so a host has no more of them than twice what its pages have.
    common = seen.join(sizes, "host").where((F.col("pages") >= COMMON_PAGES) & (2 * F.col("pages") >= F.col("n")))
    common = common.groupBy("host").agg(F.sort_array(F.collect_list("side")).alias("common"))
    return winners.join(common, "host", "left")


def extract_text(pages: DataFrame, url: str = "url", source: str = "html", output: str = "text") -> DataFrame:
    """pages with the main text in ``output`` (in place of a column of that name)."""
    paths = written(host_paths(pages, url, source), "host-paths")
    hosted = pages.withColumn("_host", host_of(F.col(url)))
    winners = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("common").alias("_common"))
    if paths.count() <= BROADCAST_HOSTS:
        joined = hosted.join(F.broadcast(winners), "_host", "left")
    else:
        salted = winners.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.when(F.col("_host").isNotNull(), F.abs(F.xxhash64(source)) % SALTS).cast("int")
        joined = hosted.withColumn("_s", salt).join(salted, ["_host", "_s"], "left").drop("_s")
    keep = [c for c in pages.columns if c != output]
    schema = T.StructType([f for f in pages.schema.fields if f.name != output] + [T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, path, common in zip(*[batch.column(c).to_pylist() for c in (source, "_path", "_common")], strict=True):
                page = Page(value or "")
                texts.append(page.text(path if path in page.paths else page.best()[0], frozenset(common or ())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, output])

    return joined.select(*dict.fromkeys([*keep, source]), "_path", "_common").mapInArrow(run, schema)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
