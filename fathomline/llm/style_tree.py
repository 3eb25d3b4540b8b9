"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes. An element node is the tags, classes and ids on the path to
it; below it are its content nodes, one for each different text. Importances are entropies over the host's m different
pages that have the element node:

* presentation of an element node: the entropy, to the base m, of the different sequences of child elements found there;
* content of an element node: 1 minus the mean, over the different texts below it, of log(pages with the text) / log(m).
  A text that all pages share has entropy 1 and adds nothing, a text of one page has entropy 0;
* with l different child sequences an element's importance is (1 - d^l) * presentation + d^l * content, with damping d;
* a content node's importance is 1 - log(pages with the text) / log(m).

Copies and near copies of one article count as one page: pages are told apart by the least hash of their 3-word shingles.
Thus what many copies share isn't taken for boilerplate, but what stands beside many different articles is.

Branches of low importance are removed from every page of the host. Tags, roles, classes and ids give a prior, which sets
how low: page furniture (menus, forms, footers and the like) has importance zero by definition, so it isn't in the tree;
what is inside an ``article`` or ``main`` element goes below BARS[0] (a text on nearly all pages), what stands outside of it
on a page that has one goes below BARS[2], anything else goes below BARS[1]. Hosts with few different pages, and hosts on
which nothing varies, have no tree: priors alone decide there.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrowmap import map_texts, slices
from fathomline.llm.common import written

DAMPING, LEAST_PAGES = 0.9, 8
#: Importances below which branches go: inside an article or main element, on pages without one, and outside of one.
BARS = (0.05, 0.3, 0.6)
#: Bytes of the table of removed branches up to which it is broadcast; beyond, pages meet it by salted host.
BROADCAST_BYTES, SALTS = 8 << 20, 32
#: Element nodes that may be broadcast to their content nodes, at about 60 bytes each.
NODES = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
_SCOPE = frozenset("html body article main section aside nav div table ul ol dl td th button footer header form".split())
_FURNITURE_TAGS = frozenset("head nav aside footer form button select option input textarea script style noscript template iframe svg canvas object embed dialog menu title label fieldset audio video search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos "
    "promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription toolbar topbar widget widgets".split()
)
#: Inside an article these name its own heading.
_HEADINGS = frozenset(("header", "banner", "masthead"))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_MAIN = frozenset(("article", "main"))


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _furniture(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in _FURNITURE_TAGS or (tag == "header" and not in_main):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body") or tag in _MAIN:
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    # Words of a name by its case and hyphens, and the name written as one word.
    words = {w.lower() for w in _WORDS.findall(named)} | {re.sub(r"[^a-z0-9]", "", w) for w in named.lower().split()}
    return not words.isdisjoint(_FURNITURE_WORDS - _HEADINGS if in_main else _FURNITURE_WORDS)


def _label(tag: str, attributes: dict[str, str]) -> str:
    named = " ".join(sorted(attributes.get("class", "").lower().split()))
    return f"{tag}.{named}#{re.sub(r'[0-9]+', '0', attributes.get('id', '').lower())}" if attributes else tag


class Page:
    """The blocks of a page in order: (text, node hashes of the path below ``html``, furniture, inside article or main),
    and the child sequences of its nodes."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, tuple[int, ...], bool, bool]] = []
        self.children: dict[int, list[str]] = {}
        self.has_main = False
        # An open element: tag, path hash, path, furniture, inside main.
        root = ("", 0, (), False, False)
        stack, parts = [root], []

        def flush() -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, _, path, furniture, main = stack[-1]
                self.blocks.append((text, path, furniture, main))

        def close(down_to: int) -> None:
            # Inline elements that end don't end the block.
            if any(e[0] not in _INLINE for e in stack[down_to:]) or stack[-1][3] != stack[down_to - 1][3]:
                flush()
            del stack[down_to:]

        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                parts.append(unescape(html[at:]))
                break
            if m.start() > at:
                parts.append(unescape(html[at : m.start()]))
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    parts.append(m[0][9:-3])
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                continue
            ended = {"p"} if tag in _CLOSES_P else _ENDED_BY.get(tag)
            if ended:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ended:
                        close(i)
                        if tag in _CLOSES_P:
                            break
                    elif stack[i][0] in _SCOPE and stack[i][0] not in ("tr", "tbody"):
                        break
            if tag == "br":
                parts.append(" ")
            if tag not in _INLINE and tag not in _RAW and tag != "br":
                flush()
            raw = m[3] or m[6] or ""
            attributes = _attributes(raw) if "=" in raw or raw.strip(" /") else {}
            _, node, path, furniture, main = stack[-1]
            label = _label(tag, attributes)
            if tag not in _INLINE:
                self.children.setdefault(node, []).append(label)
            if tag in _VOID:
                continue
            if tag in _RAW:
                # Their content is no markup; it runs to their own end tag.
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = stop.start() if stop else end
                if stop:
                    close_at = html.find(">", at)
                    at = end if close_at < 0 else close_at + 1
                continue
            if raw.endswith("/") and tag in ("svg", "path"):
                continue
            if tag in _MAIN and not furniture:
                main = self.has_main = True
            if tag in _INLINE:
                # A furnished inline element has a text of its own.
                if attributes and not furniture and _furniture(tag, attributes, main):
                    flush()
                    stack.append((tag, node, path, True, main))
                    continue
                stack.append((tag, node, path, furniture, main))
                continue
            node = xxhash.xxh64_intdigest(f"{node}/{label}".encode("utf-8", "surrogatepass")) >> 1
            stack.append((tag, node, (*path, node), furniture or _furniture(tag, attributes, main), main))
        flush()

    def text(self, bars: tuple[frozenset[int], ...] | None = None) -> str:
        """The blocks that stay, joined by blanks; ``bars`` has the branches below each of BARS, if the host has a tree."""
        out = []
        for text, path, furniture, main in self.blocks:
            if furniture:
                continue
            if bars is None:
                stays = main or not self.has_main
            else:
                low = bars[0 if main else 2 if self.has_main else 1]
                stays = low.isdisjoint(path) and not (low and content_node(path, text) in low)
            if stays:
                out.append(text)
        return " ".join(out)

    def identity(self) -> int:
        """The least hash of the 3-word shingles of what isn't furniture; copies share it, near copies mostly do."""
        digest, least = xxhash.xxh64_intdigest, 2**64 - 1
        for text, _, furniture, _ in self.blocks:
            if not furniture:
                words = text.encode("utf-8", "surrogatepass").split()
                least = min(least, min(map(digest, map(b" ".join, zip(words, words[1:], words[2:]))), default=least), *([digest(text.encode("utf-8", "surrogatepass"))] if len(words) < 3 else ()))
        return least >> 1

    def features(self) -> set[tuple[int, int, int]]:
        """(node, kind, feature) of what isn't furniture: kind 0 a text below an inner node, 1 its child sequence, 2 its
        presence, 3 a text right at it (the feature is its content node)."""
        out: set[tuple[int, int, int]] = set()
        for text, path, furniture, _ in self.blocks:
            if furniture or not path:
                continue
            h = content_node(path, text)
            out.add((path[-1], 3, h))
            out.update((node, 0, h) for node in path[:-1])
            out.update((node, 2, 0) for node in path)
        for node, labels in self.children.items():
            if (node, 2, 0) in out:
                runs = [x for i, x in enumerate(labels) if not i or labels[i - 1] != x]
                out.add((node, 1, xxhash.xxh64_intdigest("/".join(runs).encode("utf-8", "surrogatepass")) >> 1))
        return out


def content_node(path: tuple[int, ...], text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path[-1] if path else 0}~{text}".encode("utf-8", "surrogatepass")) >> 1


def _host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html", damping: float = DAMPING) -> DataFrame:
    """The style trees of all hosts: ``host``, ``node``, ``pages`` (different ones that have it), ``presentation``, ``content``
    and ``importance``; the first is null for content nodes.

    Features are told apart in each batch before they are shuffled, and are partially aggregated again on the way. The
    first shuffle is by feature and page, so that no host and no node gathers in one task.
    """

    def run(batch):
        found = set()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(html or "")
            identity = page.identity()
            found.update((host, identity, *f) for f in page.features())
        if found:
            columns = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["host", "page", "node", "kind", "feature"])

    rows = map_texts(pages.select(_host(pages[url_col]).alias("host"), pages[html_col].alias("html")), run, "host string, page long, node long, kind int, feature long")
    features = rows.distinct().groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    features = written(features, "style-features")
    is_text = F.col("kind").isin(0, 3)
    n = F.col("n").cast("double")
    of = lambda cond, x: F.sum(F.when(cond, x))
    nodes = features.groupBy("host", "node").agg(
        of(F.col("kind") == 2, F.col("n")).alias("pages"),
        of(is_text, F.log(n)).alias("text_logs"),
        of(is_text, F.lit(1)).alias("texts"),
        of(F.col("kind") == 1, n).alias("sequences_all"),
        of(F.col("kind") == 1, n * F.log(n)).alias("sequence_logs"),
        of(F.col("kind") == 1, F.lit(1)).alias("sequences"),
    )
    m = F.col("pages").cast("double")
    many = F.col("pages") > 1
    damp = F.pow(F.lit(damping), F.coalesce("sequences", F.lit(0)).cast("double"))
    elements = (
        nodes.withColumn("content", F.when(many, 1 - F.col("text_logs") / F.col("texts") / F.log(m)).otherwise(1.0))
        .withColumn("presentation", F.when(many & (F.col("sequences_all") > 0), F.greatest(F.lit(0.0), (F.log("sequences_all") - F.col("sequence_logs") / F.col("sequences_all")) / F.log(m))).otherwise(F.when(many, 0.0).otherwise(1.0)))
        .withColumn("importance", (1 - damp) * F.col("presentation") + damp * F.col("content"))
        .select("host", "node", "pages", "presentation", "content", "importance")
    )
    elements = written(elements, "style-elements")
    # A text of one page has importance 1 whatever the node, so only shared ones meet their element.
    shared = features.where("kind = 3 AND n > 1").select("host", "node", "feature", "n")
    sizes = elements.where("pages > 1").select("host", "node", "pages")
    if sizes.count() <= NODES:
        met = shared.join(F.broadcast(sizes), ["host", "node"])
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = shared.withColumn("salt", F.pmod("feature", F.lit(SALTS)).cast("int")).join(sizes.withColumn("salt", salts), ["host", "node", "salt"])
    value = 1 - F.log(n) / F.log(m)
    texts = met.select("host", F.col("feature").alias("node"), "pages", F.lit(None).cast("double").alias("presentation"), value.alias("content"), value.alias("importance"))
    return elements.union(texts)


def removed_branches(trees: DataFrame, bars: tuple[float, float, float] = BARS, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, inside, plain, outside): the branches below each bar, a row for each host that has a tree.

    Content nodes count for the first two bars only, and for the third where they are below the second: a host of m pages
    has at most as many of these as a page has texts times m to the power of bars[1].
    """
    least = F.when(F.col("pages") >= least_pages, F.col("importance"))
    of = lambda cond: F.collect_list(F.when(cond, F.col("node")))
    element = F.col("presentation").isNotNull()
    varies = F.max(F.when((F.col("pages") >= least_pages) & element, F.col("content")))
    some = trees.where((F.col("importance") < bars[1]) | element)
    per_host = some.groupBy("host").agg(of(least < bars[0]).alias("inside"), of(least < bars[1]).alias("plain"), of((least < bars[1]) | (element & (least < bars[2]))).alias("outside"), varies.alias("varies"))
    return per_host.where("varies >= 0.5").select("host", "inside", "plain", "outside")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bars: tuple[float, float, float] = BARS, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` for each row of ``pages``: its main text, blocks joined by one space.

    Character references are decoded, white space inside a block becomes one space. A null html counts as empty and
    gives an empty text, as does a page without main text. Pages with a null url, or one without a host, make up a
    host of their own. Repeated rows give repeated rows; pages are read whole, whatever their length.
    """
    low = written(removed_branches(importances(pages, url_col, html_col), bars, least_pages), "style-trees")
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, text string"
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), _host(pages[url_col]).alias("host"))
    size = low.agg(F.sum(8 * (F.size("inside") + F.size("plain") + F.size("outside")) + F.length("host") + 64)).first()[0] or 0

    def texts(batch, of):
        got = [Page(html or "").text(of(host)) for html, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["id", "url", "text"])

    if size <= BROADCAST_BYTES:
        trees = {r["host"]: tuple(frozenset(x) for x in r[1:]) for r in low.collect()}
        sent = pages.sparkSession.sparkContext.broadcast(trees)  # at most BROADCAST_BYTES as a table

        def run(batch):
            yield texts(batch, sent.value.get)

        out = map_texts(rows, run, schema, text=2)
    else:
        # A host's tree comes before its pages, once for each piece of the host, and isn't copied onto them.
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).withColumn("bars", F.lit(None).cast("array<array<bigint>>"))
        first = low.select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.array("inside", "plain", "outside").alias("bars"))
        dealt = first.union(salted).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("bars").isNull())

        def run_sorted(batches):
            host, tree = None, None
            for batch in slices(batches, 2):
                at = 0
                for i, x in enumerate(batch.column(5).to_pylist()):
                    if x is not None:
                        yield texts(batch.slice(at, i - at), lambda h: tree if h == host else None)
                        host, tree, at = batch.column(3)[i].as_py(), tuple(map(frozenset, x)), i + 1
                yield texts(batch.slice(at), lambda h: tree if h == host else None)

        out = dealt.mapInArrow(run_sorted, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
