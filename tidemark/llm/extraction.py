"""Operator 3: main-text extraction with a suffix array per host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

# Fixed values of HTML: which elements never hold shown text, never belong to an article, begin a block, hold nothing.
HIDDEN = frozenset("script style noscript template head title iframe object embed svg math canvas audio video select textarea button".split())
BOILER = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|sidebar|side-bar|widget|share|sharing|social|related|recommend\w*|comments?|disqus|respond|replies|pagination|pager|masthead|footer|header)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_BLANK = re.compile(r"\s+")
#: Tokens of the shortest substring that counts as repeated (a power of 2); distinct pages that must share it, and where a class name speaks against the block;
#: bytes of html and pages of a group; share of a block, and of a page's article, that must be covered; low bits that a window's hash does without beside its part.
LONG, PAGES, HINTED, GROUP_BYTES, GROUP_PAGES, COVER, COPY, CUT = 8, 3, 2, 8 << 20, 1024, 0.6, 0.5, np.uint64(24)
_OUT, _BODY, _MAIN, _HINT = 0, 1, 2, 4
Blocks = list[tuple[int, str]]


def parse_blocks(page: str | None) -> Blocks:
    """(place, text) of each block in page order: in a main element, elsewhere in the page, or in an element that never belongs to an article.

    Elements and roles alone decide the place; a class or id that names boilerplate adds _HINT to it.
    """
    page = page or ""
    stack: list[tuple[str, int, bool]] = []
    blocks: Blocks = []
    words: list[str] = []
    place, shown = _BODY, True

    def flush(at: int) -> None:
        text = _BLANK.sub(" ", entities.unescape("".join(words))).strip()
        words.clear()
        if text:
            blocks.append((at, text))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and shown:
            words.append(page[at:stop])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes what it opened; one that opened nothing is left out
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name in BLOCK and shown:
                flush(place)
            if k is not None:
                _, place, shown = stack[k]
                del stack[k:]
            continue
        if name in BLOCK and shown:
            flush(place)
        if name == "br" and shown:
            words.append(" ")
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == name:  # an open one of these ends here
            stack.pop()
        stack.append((name, place, shown))
        attrs = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(m[3])} if m[3] else {}
        role = attrs.get("role", "").lower()
        if name in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
            shown = False
        elif name in BOILER and not (name == "header" and place & 3 == _MAIN) or role in ROLES:
            place = _OUT
        elif (name in MAIN or role == "main") and place != _OUT:
            place = _MAIN
        elif place != _OUT and name not in ("html", "body") and NAMED.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
            place |= _HINT
    if shown:
        flush(place)
    return blocks


def suffix_groups(token: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Suffix array by prefix doubling, to depth ``long``: for each place the class of its first ``long`` tokens.

    A substring never runs from one page into the next: places nearer to the page's end than the depth get
    classes of their own.
    """
    n = len(token)
    rank = np.unique(token, return_inverse=True)[1].astype(np.int64)
    h = 1
    while h < long:
        ahead = np.full(n, -1, np.int64)
        if n > h:
            ok = page[:-h] == page[h:]
            ahead[:-h] = np.where(ok, rank[h:], -1)
        short = ahead < 0
        pair = rank * (n + 1) + ahead + 1
        if short.any():
            pair[short] = -np.arange(1, short.sum() + 1)
        order = np.argsort(pair)  # the suffixes in order of their first 2h tokens
        sorted_ = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]])) if n else sorted_
        h *= 2
    return rank


def distinct_pages(group: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each class and page, in order of classes; for it the number of the page within its class (from 0); distinct pages of each class."""
    order = np.lexsort((page, group))
    g, p = group[order], page[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    at, g = order[first], g[first]
    return at, np.arange(len(g)) - np.searchsorted(g, g, "left"), np.bincount(g)


def spread(hit: np.ndarray, long: int) -> np.ndarray:
    """Which tokens lie in a window of ``long`` tokens that begins at a hit."""
    n, at = len(hit), np.flatnonzero(hit)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + long, n), -1)
    return np.cumsum(step[:-1]) > 0


def shared_pages(token: np.ndarray, page: np.ndarray, long: int = LONG, content: np.ndarray | None = None) -> np.ndarray:
    """For each place, the distinct pages (by ``content``, if given) that have its first ``long`` tokens."""
    if not len(token):
        return np.zeros(0, np.int64)
    group = suffix_groups(token, page, long)
    return distinct_pages(group, page if content is None else content)[2][group]


def candidates(places: np.ndarray) -> np.ndarray:
    """The blocks of a page that may be its article: those of its main elements, or, without one, all that no element or name speaks against."""
    main = places & 3 == _MAIN
    return np.flatnonzero(main if main.any() else places == _BODY)


def article_of(blocks: Blocks) -> tuple[int, np.ndarray, list[bytes]]:
    """A hash of a page's article; its blocks' places and texts."""
    texts = [t.encode("utf-8", "replace") for _, t in blocks]
    places = np.array([p for p, _ in blocks], np.uint8)
    digest = hashlib.blake2b(b"\n".join(texts[j] for j in candidates(places)), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True), places, texts


def packed(blocks: Blocks) -> tuple[int, bytes]:
    """A hash of a page's article, and the page's blocks as bytes."""
    article, places, texts = article_of(blocks)
    return article, C.pack(places, np.array([len(t) for t in texts], np.uint32), np.frombuffer(b"".join(texts), np.uint8))


class Streams:
    """The token streams of pages, one page after another, with every block of each."""

    def __init__(self, blobs: list[bytes], content: np.ndarray):
        pages = [C.unpack(x) for x in blobs]
        none = [np.zeros(0, np.int64)]
        self.places = [p for p, _, _ in pages]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in self.places], dtype=np.int64)])  # each page's first block
        self.data = np.concatenate([np.zeros(0, np.uint8), *[x for _, _, x in pages]])
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate([*none, *[n for _, n, _ in pages]]), dtype=np.int64)])  # each block's first byte
        token, row = [np.zeros(0, np.uint64)], list(none)
        for a, b in C.rounds(self.begin):
            part = self.data[self.begin[a] : self.begin[b]]
            start, end, of = C.words(part, self.begin[a : b + 1] - self.begin[a])
            token.append(C.hash_runs(part, start, end))
            row.append(of + a)
        self.token, row = np.concatenate(token), np.concatenate(row)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.begin) - 1))])  # tokens before each block
        self.page = np.searchsorted(self.first, row, "right") - 1
        self.content = content  # pages of one article are one page

    def windows(self, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of ``long`` tokens from each place on, and which places have one inside their page."""
        n, key = len(self.token), self.token
        whole = np.zeros(n, bool)
        if n < long:
            return key, whole
        for k in range(2, long + 1):
            key = C.next_gram(key, self.token, k)
        whole[: n - long + 1] = self.page[: n - long + 1] == self.page[long - 1 :]
        return np.append(key, np.zeros(long - 1, np.uint64)), whole

    def texts(self, pages: np.ndarray, long: int, shared: int, hinted: int) -> list[bytes]:
        """The pages' unique runs; ``pages``: for each place, the distinct pages that have its first ``long`` tokens.

        A block goes if tokens that ``shared`` pages have (``hinted`` pages, if its class names boilerplate) cover more than COVER of it.
        A page stays whole if they cover more than COPY of its main elements, or, without one, all it has: other pages copy its article.
        """
        covers = [np.concatenate([[0], np.cumsum(spread(pages >= least, long))]) for least in (shared, hinted)]
        out = []
        for i, places in enumerate(self.places):
            may = candidates(places)
            a, b = self.ends[self.first[i] + may], self.ends[self.first[i] + may + 1]
            size = b - a
            plain, hint = (cover[b] - cover[a] for cover in covers)
            stay = np.where(places[may] & _HINT > 0, hint, plain) <= COVER * size
            if (places & 3 == _MAIN).any() and plain.sum() > COPY * size.sum() or not stay.any():
                stay = np.ones(len(may), bool)
            at = (self.first[i] + may[stay]).tolist()
            out.append(b"\n".join(self.data[self.begin[j] : self.begin[j + 1]].tobytes() for j in at))
        return out


def host_of(url):
    """The host of a URL, lower-cased; null or none: the empty text."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame, group_bytes: int = GROUP_BYTES, group_pages: int = GROUP_PAGES, long: int = LONG, shared: int = PAGES, hinted: int = HINTED) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Pages are parsed where they are read, and their blocks meet in groups of about ``group_bytes`` of html or ``group_pages`` pages of a
    host, so a host of any size is many groups.  A group's token streams are one suffix array: a substring of ``long`` tokens or
    more is repeated if ``shared`` distinct pages of its host have it, in whatever groups.  Each group of a host with several asks how
    many pages have its windows, by parts of their hashes, and is answered in the order it asked.  Pages with the same article
    are one page: an article that several groups hold is counted in one of them.
    What stays: see Streams.texts.  Null or empty html: empty text, 0; null url: a host of its own.  Rows with equal ids stay apart; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    most = max(shared, hinted)

    @C.lean
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(parse_blocks(x.as_py())) for x in batch.column("html")]
            new = {"content": pa.array([h for h, _ in found], pa.int64()), "blob": pa.array([b for _, b in found], pa.binary())}
            given = {c: batch.column(c) for c in ("page_id", "url", "groups", "host_key", "slot")}
            yield pa.RecordBatch.from_pydict(given | new)

    @C.lean
    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = pa.array([article_of(parse_blocks(x.as_py()))[0] for x in batch.column("html")], pa.int64())
            yield pa.RecordBatch.from_pydict({"host_key": batch.column("host_key"), "slot": batch.column("slot"), "content": content})

    def streams(table: pa.Table) -> Streams:
        return Streams(table["blob"].to_pylist(), table["content"].to_numpy())

    def keys(table: pa.Table, s: Streams) -> tuple[np.ndarray, np.ndarray]:
        key, whole = s.windows(long)
        return C.mix(key ^ np.uint64(table["host_key"][0].as_py() % (1 << 64))), whole

    def in_parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in order of part and hash: part, hash, and the number of each given one among them."""
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key >> CUT, part))
        part, cut = part[order], (key >> CUT)[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (cut[1:] != cut[:-1])
        back = np.empty(len(key), np.int64)
        back[order] = np.cumsum(fresh) - 1
        return part[fresh], cut[fresh], back

    host = host_of(F.col("url"))
    sizes = pages.select(host.alias("host"), F.octet_length("html").cast("long").alias("b")).groupBy("host").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
    sizes = sizes.select("host", F.greatest(F.ceil(F.coalesce("b", F.lit(0)) / group_bytes), F.ceil(F.col("n") / group_pages)).cast("int").alias("groups")).where("groups > 1")
    hosts, groups = sizes.agg(F.count("*"), F.coalesce(F.sum("groups"), F.lit(0))).first()  # hosts of more than one group
    parts = max(1, groups // 2)

    def ask(table: pa.Table, away: pa.Table) -> pa.Table:
        """The group's distinct windows, and how many distinct pages have each (``most`` at most, without those counted elsewhere), for each part."""
        out: list[tuple[int, bytes]] = []
        if table.num_rows and table["groups"][0].as_py() > 1:
            s = streams(table)
            key, whole = keys(table, s)
            if whole.any():
                counted = ~np.isin(s.content, away["content"].to_numpy())
                classes = suffix_groups(s.token, s.page, long)
                mine = np.flatnonzero(counted[s.page])
                n = np.zeros(int(classes.max()) + 1, np.int64)
                if len(mine):
                    found = distinct_pages(classes[mine], s.content[s.page[mine]])[2]
                    n[: len(found)] = np.minimum(found, most)
                at = np.flatnonzero(whole)
                part, cut, back = in_parts(key[at])
                pages_of = np.zeros(len(part), np.int64)
                pages_of[back] = n[classes[at]]  # equal windows are one class
                out = [(p, C.pack(np.diff(cut[a:b], prepend=np.uint64(0)), pages_of[a:b].astype(np.uint8))) for p, a, b in C.runs(part)]
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "slot": pa.array([table["slot"][0].as_py()] * len(out) if out else [], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        """How many distinct pages have each asked window, ``most`` at most, in the order of the group's windows."""
        asked = [C.unpack(x) for x in table["blob"].to_pylist()]
        name, _, back = C.distinct(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in asked]))
        n = np.minimum(np.bincount(back, np.concatenate([x for _, x in asked]), len(name)), most).astype(np.uint8)[back]
        cuts = np.cumsum([len(k) for k, _ in asked])[:-1]
        return pa.table({"slot": table["slot"], "part": table["part"], "blob": pa.array([C.pack(x) for x in np.split(n, cuts)], pa.binary())})

    def settle(table: pa.Table, told: pa.Table) -> pa.Table:
        s = streams(table)
        if table.num_rows and table["groups"][0].as_py() > 1:
            key, whole = keys(table, s)
            found = np.zeros(len(key), np.int64)
            if whole.any():
                n = np.concatenate([C.unpack(x)[0] for x in told.sort_by("part")["blob"].to_pylist()])
                found[whole] = n[in_parts(key[whole])[2]]
        else:
            found = shared_pages(s.token, s.page, long, s.content[s.page])
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(s.texts(found, long, shared, hinted), pa.binary()).cast(pa.string())})

    dealt = pages.select("page_id", "url", "html", host.alias("host")).join(F.broadcast(sizes) if hosts <= 50_000 else sizes, "host", "left")  # 50000 short names at most
    dealt = dealt.withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")))
    dealt = dealt.select("page_id", "url", "html", "groups", F.xxhash64("host").alias("host_key"), F.xxhash64("host", "part").alias("slot"))
    parsed = dealt.mapInArrow(parse, f"page_id {kinds['page_id']}, url {kinds['url']}, groups int, host_key long, slot long, content long, blob binary")
    if hosts:
        held = C.written(dealt.where("groups > 1").mapInArrow(articles, "host_key long, slot long, content long").distinct(), "articles")
        first = held.groupBy("host_key", "content").agg(F.min("slot").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        away = held.join(first, ["host_key", "content"]).where("slot <> _first").select("slot", "content")
        asked = parsed.groupBy("slot").cogroup(away.groupBy("slot")).applyInArrow(ask, "part int, slot long, blob binary")
        told = asked.groupBy("part").applyInArrow(count, "slot long, part int, blob binary")
    else:
        told = spark.createDataFrame([], "slot long, part int, blob binary")
    done = parsed.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(settle, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
