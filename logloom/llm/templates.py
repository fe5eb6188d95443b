"""HTML extraction by equivalence-class template deduction.

Tokens are tags with the path that leads to them, and text nodes with theirs. A
token's occurrence vector over the pages of a host is folded into two sums of
hashes of (page, count), so that it is aggregated like a count, with map-side
combine, however many pages a host has. Tokens of a host with equal vectors form
a class; a class is valid if it has MIN_CLASS tokens and covers SUPPORT of the
host's pages. Paths order tokens, so the containers of valid classes nest into the
host's template (`nest`): each class lies in one gap of the class around it.

Text fills the slot of the innermost container of the template around it (`fill`),
unless something of the wrong kind holds it (menus, headers, footers, sidebars,
notices, adverts, forms, comments: by element, role, class or id). A slot varies if
any of its text isn't a member of a valid class. A template's main slot is its
outermost article or main element if that holds more of the varying text than lies
outside it, else the innermost container that occurs once a page and holds every
slot that varies, on however few pages. In an article or main element every slot
remains; in another container those parts are dropped in which nothing varies on
any page (site titles, footers). Where nothing varies (copies of one page) all slots
count as varying. All hosts together have an article or main slot as well, for hosts
with fewer than two pages. A page without its template's main slot is read from its
own article or main element, or else from its body without text nodes that the
template repeats.

Defined results: null and empty html gives an empty text; a null url belongs to
the empty host; repeated rows each get a row; elements nested deeper than DEEP count as
part of the one at that depth, and their texts stay; entities without a semicolon are
decoded as HTML does; a tag that the page's end cuts off is no text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.urlfilter import url_host
from logloom.tables import materialize, ship, tidy

MIN_CLASS, SUPPORT = 3, 0.6
#: Templates are broadcast up to so many hosts; with more, pages are dealt by host and salt.
BROADCAST_HOSTS, SALT = 20_000, 32
ALL_HOSTS = "*"
#: Elements nested deeper share the path of the one at this depth; longer labels are hashed. Paths are thus bounded, texts aren't.
DEEP, LABEL = 100, 64

# Element names and the words that name a container's kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select option button textarea input datalist map title".split())
WRONG = frozenset("nav header footer aside form menu dialog fieldset".split())
WRONG_NAME = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
TITLE_NAME = frozenset("header masthead".split())
CONTENT_NAME = frozenset("article content entry post story".split())
WRONG_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("table ul ol dl div article section main body html td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*\Z", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """A container: its label, path and whether it or one around it is of the wrong kind.

    Inside an article or main element, or beside a word for content (`post-header`),
    a header is the title of the article and not the page's.
    """

    __slots__ = ("caught", "depth", "inside", "path", "tag", "wrong")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag = tag
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)} if "=" in attributes else {}
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        names: set[str] = set()
        for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
            words = set(_NAME.findall(name))
            names |= words - TITLE_NAME if self.inside or words & CONTENT_NAME else words
        hidden = "hidden" in attributes.lower() and _BARE_HIDDEN.search(_QUOTED.sub("", attributes)) is not None
        kind = (tag in WRONG and not (self.inside and tag == "header")) or a.get("role", "").lower() in WRONG_ROLE or tag in HIDDEN or hidden
        # An article whose class says "comment" is a comment; body and html keep theirs.
        own = kind or (tag not in ("html", "body", "main") and bool(names & WRONG_NAME))
        self.wrong = own or (parent is not None and parent.wrong)
        self.caught = parent is not None and parent.caught
        if self.depth > DEEP:
            self.path = parent.path
            return
        label = tag + (f".{' '.join(a['class'].split()).replace('/', '|')}" if "class" in a else "") + ("!" if own else "")
        if len(label) > LABEL:
            label = f"{tag[:LABEL]}.{xxhash.xxh64_hexdigest(label)}"
        self.path = f"{parent.path}/{label}" if parent and parent.path else label


def read(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open", node, "") for each container up to DEEP, ("text", node, raw) for text, ("break", node, "") where a block ends."""
    root = Node("", "", None)
    stack, at = [root], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag == "br":
                yield "text", stack[-1], " "
            elif m[2]:
                for i in range(len(stack) - 1, 0, -1):
                    if not stack[i].caught:
                        break
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            elif tag != "wbr" and (stack[-1].caught or (m[4] and not stack[-1].wrong)):
                node = Node(tag, m[4] or "", stack[-1])
                if node.wrong:  # an advert or share link amid text, with all that it contains
                    node.caught = True
                    stack.append(node)
            continue
        yield "break", stack[-1], ""
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[i].tag in CLOSES[tag]:
                del stack[i:]
                break
            if stack[i].tag in SCOPE:
                break
        node = Node(tag, m[4] or "", stack[-1])
        if node.depth <= DEEP:
            yield "open", node, ""
        if tag not in VOID:
            stack.append(node)
    if at < len(page):
        yield "text", stack[-1], page[at:]


def text_token(node: Node, raw: str) -> str:
    return f"{node.path}\t{' '.join(raw.split())}"


def place(path: str, places: dict[str, bool]) -> bool:
    """What `places` says of the innermost of its containers at or around the path; True if there is none."""
    while path not in places:
        path, _, _ = path.rpartition("/")
        if not path:
            return True
    return places[path]


def main_text(page: str, main: str | None = None, noise: frozenset[int] = frozenset(), places: dict[str, bool] | None = None) -> str:
    """The text of a page's main slot, blocks joined by two newlines.

    `main` is the path of its container; `places` tells of the template's containers
    in it whether the slots between them count. Text in anything that the template
    doesn't know fills the slot of the innermost container that it knows.
    """
    events = list(read(page))
    paths = {n.path for kind, n, _ in events if kind == "open" and not n.wrong}
    if main not in paths:
        own = [n.path for kind, n, _ in events if kind == "open" and not n.wrong and n.tag in ("article", "main")]
        main, places = own[0] if own else None, None
    counts: dict[str, bool] = {}
    blocks, now = [], []
    for kind, node, raw in events:
        if kind == "text":
            if node.wrong:
                continue
            if main is not None:
                if node.path not in counts:
                    counts[node.path] = (node.path == main or node.path.startswith(f"{main}/")) and place(node.path, places or {})
                if counts[node.path]:
                    now.append(raw)
            elif not noise or xxhash.xxh64_intdigest(text_token(node, raw)) not in noise:
                now.append(raw)
        elif now:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def _tokens():
    """(page_id, host, html) -> (host, token, kind, slot, support, v1, v2, once, mass), summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, 0, 0])
            for page_id, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html")), strict=True):
                count: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])  # (token, kind, slot) -> [n, characters]
                for kind, node, raw in read(page or ""):
                    if kind == "open" and node.tag not in HIDDEN:
                        count[node.path, "wrong" if node.wrong else node.tag, 0][0] += 1
                    elif kind == "text" and not raw.isspace():
                        slot = xxhash.xxh64_intdigest(node.path) >> 1
                        text = count[f"{xxhash.xxh64_intdigest(text_token(node, raw))}", "text", slot]
                        text[0] += 1
                        if not node.wrong:
                            text[1] += len(raw)
                            held = count[node.path, "#slot", slot]
                            held[0] += 1
                            held[1] += len(raw)
                for h in (host, ALL_HOSTS):
                    found[h, "", "page", 0][0] += 1
                for (token, kind, slot), (n, mass) in count.items():
                    digest = xxhash.xxh64_intdigest(f"{page_id}\t{n}")
                    for h in (host, ALL_HOSTS) if slot == 0 else (host,):
                        f = found[h, token, kind, slot]
                        f[0] += 1
                        f[1] += digest & 0xFFFFFFFF
                        f[2] += digest >> 32
                        f[3] += n == 1
                        f[4] += mass
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([k[3] for k in keys], pa.int64())] + [pa.array([found[k][i] for k in keys], pa.int64()) for i in range(5)], ["host", "token", "kind", "slot", "support", "v1", "v2", "once", "mass"])

    return run


def _few(hosts: DataFrame, n: int) -> DataFrame:
    """A table of one row for each of n hosts, broadcast under the bound."""
    return F.broadcast(hosts) if n <= BROADCAST_HOSTS else hosts


def _depth(path: str) -> Column:
    return F.size(F.split(path, "/"))


def _around(path: str) -> Column:
    """The path and those of all containers around it, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def nest(member: DataFrame) -> DataFrame:
    """Containers of valid classes -> (host, token, kind, support, once, v1, v2, gap): the template, a forest of classes.

    A class lies in the gap after the innermost container of another class around
    it. Containers with one vector but in different gaps play different roles, so
    they are different classes (host, v1, v2, gap); hence all of a class lies in one
    gap of its parent. Classes without a gap are roots.
    """
    tags = member.where("kind <> 'text'")
    around = tags.select("host", "token", "v1", "v2", F.explode(_around("token")).alias("outer")).where("outer <> token")
    outer = tags.select("host", F.col("token").alias("outer"), F.col("v1").alias("o1"), F.col("v2").alias("o2"))
    gaps = around.join(outer, ["host", "outer"]).where("v1 <> o1 OR v2 <> o2").groupBy("host", "token").agg(F.max(F.struct(_depth("outer"), "outer"))["outer"].alias("gap"))
    return tags.join(gaps, ["host", "token"], "left").select("host", "token", "kind", "support", "once", "v1", "v2", "gap")


def fill(template: DataFrame, texts: DataFrame) -> DataFrame:
    """texts(host, token, mass, varying) by path -> (host, place, mass, varying): slots, named by the container whose gaps they fill; null outside the template."""
    places = template.where("kind <> 'wrong'").select("host", F.col("token").alias("place"))
    spots = texts.select("host", "token", F.explode(_around("token")).alias("place")).join(places, ["host", "place"])
    innermost = spots.groupBy("host", "token").agg(F.max(F.struct(_depth("place"), "place"))["place"].alias("place"))
    return texts.join(innermost, ["host", "token"], "left").groupBy("host", "place").agg(F.sum("mass").alias("mass"), F.sum("varying").alias("varying"))


def main_slots(template: DataFrame, slots: DataFrame, hosts: int) -> DataFrame:
    """(host, main, marked): the container of the main slot, and whether it is an article or main element."""
    frame = template.where("kind <> 'wrong' AND once = support").select("host", "token", F.col("kind").isin("article", "main").alias("marked"), _depth("token").alias("depth"))
    total = slots.groupBy("host").agg(F.sum("varying").alias("total"))
    held = slots.where("varying > 0 AND place IS NOT NULL").select("host", F.explode(_around("place")).alias("token"), "varying").groupBy("host", "token").agg(F.sum("varying").alias("varying"))
    first = F.col("marked") & (2 * F.col("varying") > F.col("total"))
    best = F.max(F.struct(first.alias("first"), F.when(first, -F.col("depth")).otherwise(F.col("depth")).alias("depth"), "token", "marked"))
    found = frame.join(held, ["host", "token"]).join(_few(total, hosts), "host").where(first | (F.col("varying") == F.col("total")))
    main = found.groupBy("host").agg(best.alias("best")).select("host", F.col("best.token").alias("main"), F.col("best.marked").alias("marked"))
    everywhere = frame.where((F.col("host") == ALL_HOSTS) & F.col("marked")).groupBy("host").agg(F.min(F.struct("depth", "token")).alias("best")).select("host", F.col("best.token").alias("main"), F.lit(True).alias("marked"))
    return main.unionByName(everywhere)


def remaining(template: DataFrame, slots: DataFrame, main: DataFrame) -> DataFrame:
    """(host, place, counts) for the template's containers from an unmarked main slot's downwards.

    A part is the outermost container of the template inside the main slot's, with all
    that is nested in it; a part counts if one of its slots varies. What lies between
    the parts is one slot and counts by itself.
    """
    unmarked = main.where("NOT marked").select("host", "main")
    inside = template.where("kind <> 'wrong'").join(unmarked, "host").where(F.col("token").eqNullSafe(F.col("main")) | F.expr("startswith(token, concat(main, '/'))"))
    inside = inside.select("host", "main", F.col("token").alias("place"))
    above = inside.select("host", "place", "main", F.explode(_around("place")).alias("part")).where("length(part) > length(main)")
    outermost = above.join(inside.select("host", F.col("place").alias("part")), ["host", "part"]).groupBy("host", "place").agg(F.min(F.struct(_depth("part"), "part"))["part"].alias("part"))
    parts = materialize(inside.join(outermost, ["host", "place"], "left").select("host", "place", F.coalesce("part", "main").alias("part")))
    varying = parts.join(slots.where("varying > 0"), ["host", "place"], "left_semi").select("host", "part").distinct().withColumn("counts", F.lit(True))
    return parts.join(varying, ["host", "part"], "left").select("host", "place", F.coalesce("counts", F.lit(False)).alias("counts"))


def templates(pages: DataFrame) -> DataFrame:
    """pages(page_id, host, html) -> (host, main, noise, places): the main slot's path, the hashes of repeated texts, and which of the template's containers in the main slot count.

    One row for each host; a host's row holds tokens that SUPPORT of its pages
    have, so it is as long as a page at most, times 1 / SUPPORT.
    """
    sums = pages.mapInArrow(tidy(_tokens()), "host string, token string, kind string, slot long, support long, v1 long, v2 long, once long, mass long")
    tokens = materialize(sums.groupBy("host", "token", "kind", "slot").agg(*[F.sum(c).alias(c) for c in ("support", "v1", "v2", "once", "mass")]))
    n = tokens.where("kind = 'page'").select("host", F.col("support").alias("pages"))
    hosts = n.count()
    known = tokens.where("kind <> 'page'").join(_few(n, hosts), "host").where("pages >= 2")
    common = known.where((F.col("kind") != "#slot") & (F.col("support") >= SUPPORT * F.col("pages")))
    classes = common.groupBy("host", "v1", "v2").agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.struct("token", "kind", "slot", "support", "once", "mass")).alias("members")).where(F.col("size") >= MIN_CLASS)
    member = materialize(classes.select("host", "v1", "v2", F.explode("members").alias("m")).select("host", "v1", "v2", "m.*"))
    template = materialize(nest(member))
    same = member.where("kind = 'text'").groupBy("host", "slot").agg(F.sum("mass").alias("same"))
    texts = known.where("kind = '#slot'").join(same, ["host", "slot"], "left").select("host", "token", "mass", (F.col("mass") - F.coalesce("same", F.lit(0))).alias("varying"))
    slots = materialize(fill(template, texts))
    total = materialize(slots.groupBy("host").agg((F.sum("varying") > 0).alias("varies")))
    # Where nothing varies, as in copies of one page, every slot counts as varying.
    slots = slots.join(_few(total, hosts), "host").select("host", "place", F.when(F.col("varies"), F.col("varying")).otherwise(F.col("mass")).alias("varying"))
    main = materialize(main_slots(template, slots, hosts))
    places = remaining(template, slots, main).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("place", "counts"))).alias("places"))
    noise = member.where("kind = 'text'").join(_few(total.where("varies"), hosts), "host", "left_semi").groupBy("host").agg(F.collect_set("token").alias("noise"))
    return main.join(noise, "host", "full_outer").join(places, "host", "left").select("host", "main", "noise", "places")


def _extract():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, frozenset[int]] = {}
            text = []
            for page, main, noise, places in zip(*(batch.column(c).to_pylist() for c in ("html", "_main", "_noise", "_places")), strict=True):
                key = tuple(noise or ())
                if key not in known:
                    known[key] = frozenset(map(int, key))
                text.append(main_text(page or "", main, known[key], dict(places or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), "html")
    known = materialize(templates(rows.select("page_id", "host", "html")))
    default = known.where(F.col("host") == ALL_HOSTS).select(F.col("main").alias("_all"))
    known = known.select(F.col("host").alias("_host"), F.col("main").alias("_main"), F.col("noise").alias("_noise"), F.col("places").alias("_places"))
    if known.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(known), F.col("host") == F.col("_host"), "left")
    else:
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, (F.col("host") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    first = default.first()
    joined = joined.withColumn("_main", F.coalesce("_main", F.lit(first[0] if first else None).cast("string")))
    types = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "_main", "_noise", "_places").mapInArrow(tidy(_extract()), f"page_id {types['page_id']}, url string, text string, n_chars long")
