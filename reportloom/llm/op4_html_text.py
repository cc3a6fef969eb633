"""Operator 4: main text of web pages with a host suffix array over page token streams.

1. Each page is parsed into text blocks and their place: in the article, nominated as
   boilerplate inside it by a class or id, elsewhere on a page that has an article, or open (a
   page without an article). Regions that never hold main text (menus, scripts, forms, ...)
   give no block. The parser closes what the page left open; character references are decoded
   once, by HTML's rules.
2. The blocks of a page, joined, are its token stream. Streams of all pages are cut into
   super-k-mers: runs of windows of RUN words under one minimiser. (host, minimiser) is a
   bucket, so windows that agree meet whatever the host's size, and no stage is keyed by host.
   Blocks shorter than RUN words, neighbours of few words taken together, are buckets of
   their own. Buckets without a second page, or without a nominated or open block, go.
3. The strings of the buckets left are concatenated with separators and a suffix array is built
   by prefix doubling; runs of RUN tokens or more that stand on distinct pages of the host are
   boilerplate. A bucket too large for one array is taken in several, whose runs are merged
   by their 128-bit fingerprints, so nothing depends on the size of a group.
4. A nominated or open block that boilerplate covers from end to end goes; a block of which only
   a part repeats is kept whole. Other blocks of an article stay even where they repeat: a
   mirrored or quoted article is no boilerplate.

On a page with an <article> or <main> the blocks outside it go, whatever holds the article.
Containers of reader comments and adverts go everywhere, by their whole class or id. Looser
hints nominate a region of an article (void if nominations hold half of its words or more) and
remove a region of a page without one; so does a form in either. Such a removed region that
holds half of the page's words or more is a wrapper: its blocks are open like the rest. Names that
speak about something else (has-sidebar, no-sidebar, ad-free, share-count-enabled) hint at
nothing, nor does what a name marks as content.

Pages without a nominated or open block are never shuffled; the pages with one meet their
findings by page key, and html moves only where these findings are too large to broadcast.

Defined results: null and empty html give an empty text and 0 characters; pages of one host
never meet another host's; repeated rows are extracted alike (rows of equal page_id and url
count as one page); a null url is a host of its own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import op8_substring_dedup as op8

U64 = np.uint64
RUN = 24
LEAST_UNIT = 4
ARRAY_STRINGS = 50_000
UNIT_SALT = U64(0x9FB21C651E98DF25)
# fixed values: HTML's element classes
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas noframes noembed textarea title".split())
NEVER = RAW | set("head nav header footer aside select option dialog menu datalist audio video".split())
BLOCKS = set("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul br".split())
EDGES = BLOCKS | NEVER - {"select", "option"} | {"form"}
CDATA = RAW - {"svg", "math", "object", "noscript", "template"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adv|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer\w*|header|masthead|cookies?|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|share\w*|sharing|social\w*|comments?|comment-?list|respond|disqus\w*|related|recommend\w*|trending|pagination|pager|login|signup|search\w*|toolbar|skip\w*|copyright|legal|disclaimer)(?=$|[\s_-])", re.I)
NAMES = set("ad ads advert advertisement sponsored breadcrumb breadcrumbs sidebar cookie-notice cookie-banner newsletter share-bar share-buttons social-share social-links related-posts pagination".split())
# whole names of comment and advert containers
COMMENTS = re.compile(r"(?:(?:user|reader|post|article|page|site|blog|fb|facebook)[_-]?)?comments?(?:[_-]?(?:area|list|section|wrap(?:per)?|thread|container|box|block|form|body|content|respond|holder|panel|template))?(?:[_-]\d+)?|respond|disqus\w*|(?:user|reader)[_-](?:reviews|replies)", re.I)
ADVERTS = re.compile(r"(?:(?:google|dfp|gpt|banner|top|bottom|side|inline|in-?(?:article|content|text)|mid|native|text)[_-]?)?(?:ads?|advert(?:s|isement|isements|ising|orial)?)(?:[_-]?(?:slot|box|unit|banner|container|wrap(?:per)?|block|space|placement|area|zone|holder|label|frame|section|inner|\d+))*|adsbygoogle|sponsor(?:ed)?[_-](?:content|links?|box|message|block|ads?)|promoted[_-](?:content|links?|box)|(?:taboola|outbrain)[\w-]*", re.I)
# names about something else: a part that is there or not, or an option
ABOUT = re.compile(r"(?:has|have|no|not|non|with|without|is|hide|show|can|site|page|layout)[_-].*|.*[_-](?:free|less|enabled|disabled|none|hidden|visible|on|off|open|closed|layout|page|template)", re.I)
CONTENT = re.compile(r"(?:(?:entry|post|article|story|page|main|body|single|news|blog)[_-]?(?:content|body|text|main|inner|copy)|content|main|(?:content|main)[_-](?:area|body|inner|wrap(?:per)?|container|main|column|text))", re.I)
SPACES = re.compile(r"\s+")
ARTICLE, NOMINATED, ELSEWHERE, OPEN = 0, 1, 2, 3


class Page(HTMLParser):
    """Blocks of a page: (kind, text). Every tag costs a constant, whatever the nesting."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, never, article, nominated, region before
        self.places: dict[str, list[int]] = {}  # where each tag stands in the stack
        self.edges: list[int] = []  # where elements that end a paragraph stand
        self.never = self.article = self.nominated = 0
        self.above: list[int] = []  # of each hinted region or form, the one around it
        self.region = -1
        self.blocks: list[tuple[int, str]] = []
        self.regions: list[int] = []  # of each block
        self.held: list[str] = []
        self.seen_article = False

    def flush(self):
        if self.held:
            text = SPACES.sub(" ", "".join(self.held)).strip()
            if text:
                self.blocks.append((OPEN if not self.article else NOMINATED if self.nominated else ARTICLE, text))
                self.regions.append(self.region)
            self.held = []

    def pop(self):
        tag, never, article, nominated, self.region = self.stack.pop()
        self.places[tag].pop()
        if tag in EDGES:
            self.edges.pop()
        self.never -= never
        self.article -= article
        self.nominated -= nominated

    def close_to(self, at: int):
        while len(self.stack) > at:
            self.pop()

    def handle_starttag(self, tag, attrs):
        edge = tag in EDGES
        if edge:
            self.flush()
        if tag in VOID:
            return
        if edge and tag in BLOCKS and self.places.get("p") and self.edges[-1] == self.places["p"][-1]:
            self.close_to(self.edges[-1])  # a block ends an open paragraph
        if tag == "li" and self.stack and self.stack[-1][0] == "li":
            self.pop()
        article = tag in ("article", "main")
        never = tag in NEVER and not (tag == "header" and self.article)
        if tag == "button":  # a button in a sentence is a word of it
            never = not "".join(self.held).strip()
        nominated, hinted = False, tag == "form"
        if attrs and not self.never:
            values = dict(attrs)
            role = values.get("role")
            article = article or role in ("main", "article")
            never = never or role in ROLES or "hidden" in values or values.get("aria-hidden") == "true"
            hinted = hinted or role == "form"
            names = f"{values.get('class') or ''} {values.get('id') or ''}".split()
            if names and tag not in ("html", "body"):
                names = [x for x in names if not ABOUT.fullmatch(x)]
                if any(map(COMMENTS.fullmatch, names)):
                    never = True
                elif not article:
                    if any(map(ADVERTS.fullmatch, names)):
                        never = True
                    elif not any(map(CONTENT.fullmatch, names)) and names:
                        if self.article and not NAMES.isdisjoint(x.lower() for x in names):
                            never = True
                        elif HINTS.search(" ".join(names)):
                            nominated = self.article > 0
                            hinted = hinted or not nominated
        article = article and not self.never and not never
        self.places.setdefault(tag, []).append(len(self.stack))
        if edge:
            self.edges.append(len(self.stack))
        self.stack.append((tag, never, article, nominated, self.region))
        if article:
            self.region = -1  # what stands around an article says nothing of it
        elif hinted and not never:
            self.above.append(self.region)
            self.region = len(self.above) - 1
        self.never += never
        self.article += article
        self.nominated += nominated
        self.seen_article |= article
        if tag in CDATA:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in EDGES:
            self.flush()
        at = self.places.get(tag)
        # inline end tags don't close blocks around them
        if at and (tag in EDGES or not self.edges or self.edges[-1] < at[-1]):
            self.close_to(at[-1])

    def handle_data(self, data):
        if not self.never:
            self.held.append(data)


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks."""
    if not html:
        return []
    p = Page()
    p.feed(html)
    p.close()
    p.flush()
    blocks = resolved(p)
    if p.seen_article:
        blocks = [(ELSEWHERE if k == OPEN else k, t) for k, t in blocks]
        sizes = [0, 0, 0]
        for k, t in blocks:
            sizes[k] += t.count(" ") + 1
        if sizes[NOMINATED] >= sizes[ARTICLE]:
            blocks = [(ARTICLE if k == NOMINATED else k, t) for k, t in blocks]
    return blocks


def resolved(p: Page) -> list[tuple[int, str]]:
    """A page's blocks without those in hinted regions or forms, unless these are wrappers."""
    if not p.above:
        return p.blocks
    words = [t.count(" ") + 1 for _, t in p.blocks]
    size = [0] * len(p.above)
    for r, n in zip(p.regions, words, strict=True):
        if r >= 0:
            size[r] += n
    for r in range(len(size) - 1, -1, -1):  # a region stands after the one around it
        if p.above[r] >= 0:
            size[p.above[r]] += size[r]
    total, gone = sum(words), []
    for r, n in enumerate(size):
        gone.append(2 * n < total or (p.above[r] >= 0 and gone[p.above[r]]))
    return [(ELSEWHERE, t) if r >= 0 and gone[r] else (k, t) for (k, t), r in zip(p.blocks, p.regions, strict=True)]


def judged(kind: int) -> bool:
    return kind in (NOMINATED, OPEN)


def units_of(sizes: np.ndarray, kinds: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The unit that each block belongs to: neighbours of few words and one kind together."""
    few = sizes < LEAST_UNIT
    new = np.ones(len(sizes), bool)
    new[1:] = ~(few[1:] & few[:-1]) | (page[1:] != page[:-1]) | (kinds[1:] != kinds[:-1])
    return np.cumsum(new) - 1


class Streams:
    """Token streams of some pages, their blocks and units."""

    def __init__(self, hosts: np.ndarray, htmls: list):
        self.blocks = [blocks_of(x) for x in htmls]
        self.n = len(htmls)
        flat = [b for p in self.blocks for b in p]
        self.page = np.repeat(np.arange(self.n), [len(p) for p in self.blocks])
        self.kind = np.array([k for k, _ in flat], np.int8)
        self.size = np.array([t.count(" ") + 1 for _, t in flat], np.int64)
        self.host = C.mix(hosts.view(U64) + U64(1))
        self.data, self.off = C.text_bytes(pa.array([" ".join(t for _, t in p) for p in self.blocks], pa.string()))
        self.ws, self.we, self.row = C.words(self.data, self.off)
        self.end = np.cumsum(self.size)  # words before each block's end: the stream's words are the blocks'
        self.start = self.end - self.size

    def kmers(self):
        """First word, windows, and bucket of each super-k-mer, and whether a judged block lies in it."""
        s, k, mz, _ = op8.super_kmers(self.data, self.ws, self.we, self.row, np.zeros(0, U64), RUN)
        bucket = C.mix(mz ^ self.host[self.row[s]])
        marks = np.concatenate([[0], np.cumsum(np.repeat(self.kind, self.size) % 2)])  # judged kinds are odd
        return s, k, bucket, marks[s + k + RUN - 1] > marks[s]

    def units(self):
        """Unit of each block; and of each unit its page, bucket, check, words, and kind."""
        of = units_of(self.size, self.kind, self.page)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(of)) - 1
        words = self.end[last] - self.start[first]
        a, z = self.ws[self.start[first]], self.we[self.end[last] - 1]
        page = self.page[first]
        bucket = C.mix(C.word_hashes(self.data, a, z) ^ self.host[page] ^ UNIT_SALT)
        check = C.word_hashes(self.data, a, z, 1) | U64(1)
        return of, page, bucket, check, words, self.kind[first]


def pieces_of(batches, most: int = C.CHUNK_BYTES):
    for whole in batches:
        yield from C.chunks(whole, "html", most)


def page_entries(batches):
    """(bucket, check, page, judged): the buckets of each page once; check is 0 but for units."""
    for b in pieces_of(batches):
        x = Streams(b.column(0).to_numpy(), b.column(2).to_pylist())
        s, _, bucket, mark = x.kmers()
        _, upage, ubucket, ucheck, words, kind = x.units()
        some = (words >= LEAST_UNIT) & (words < RUN)
        row = np.concatenate([x.row[s], upage[some]])
        bucket = np.concatenate([bucket, ubucket[some]])
        check = np.concatenate([np.zeros(len(s), U64), ucheck[some]])
        mark = np.concatenate([mark, kind[some] % 2 > 0])
        order = np.lexsort((~mark, check, bucket, row))
        row, bucket, check, mark = row[order], bucket[order], check[order], mark[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]) | (check[1:] != check[:-1])
        yield pa.RecordBatch.from_arrays([C.as_long(bucket[new]), C.as_long(check[new]), b.column(1).take(pa.array(row[new])), pa.array(mark[new])], ["bucket", "check", "page", "judged"])


def window_prints(data, ws, we) -> list[np.ndarray]:
    """128 bits of each window of RUN words."""
    out = []
    for lane in (0, 1):
        x = C.word_hashes(data, ws, we, lane)
        up, down = C.powers(len(x) + 1)
        p = np.concatenate([[U64(0)], np.cumsum(x * up[: len(x)])])
        n = len(x) - RUN + 1
        out.append(C.mix((p[RUN:] - p[:n]) * down[:n]) if n > 0 else np.zeros(0, U64))
    return out


def page_strings(batches):
    """(bucket, page, string, n, judged) of the super-k-mers of open buckets."""
    for b in pieces_of(batches):
        x = Streams(b.column(0).to_numpy(), b.column(2).to_pylist())
        s, k, bucket, mark = x.kmers()
        lists = b.column(3)
        wanted = np.asarray(lists.flatten()).view(U64)
        owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
        key = C.mix(bucket ^ C.mix(x.row[s].astype(U64)))
        keep = np.isin(key, C.mix(wanted ^ C.mix(owner.astype(U64))))
        s, k, bucket, mark, row = s[keep], k[keep], bucket[keep], mark[keep], x.row[s[keep]]
        yield pa.RecordBatch.from_arrays(
            [C.as_long(bucket), b.column(1).take(pa.array(row)), C.binary(x.data, x.ws[s], x.we[s + k + RUN - 2]), pa.array(s - np.searchsorted(x.row, row)), pa.array(mark)], ["bucket", "page", "string", "place", "judged"]
        )


def suffix_array(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, as far as `most` tokens tell suffixes apart, and the length
    of the prefix that each suffix shares with the one before it."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    ranks, width = [rank.astype(np.int64)], 1
    order = np.argsort(rank, kind="stable")
    while width < min(most, n):
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        step = np.zeros(n, np.int64)
        step[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        ranks.append(rank)
        width *= 2
        if step[1:].all():
            break
    shared = np.zeros(n, np.int64)
    x, y = order[1:].copy(), order[:-1].copy()
    for k in range(len(ranks) - 1, -1, -1):
        ok = (x < n) & (y < n)
        same = np.zeros(len(x), bool)
        same[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        shared[1:] += same * (1 << k)
        x[same] += 1 << k
        y[same] += 1 << k
    return order, shared


def repeated_runs(tokens: np.ndarray, apart: np.ndarray, low: np.ndarray, high: np.ndarray, least: int):
    """Groups of places whose next `least` tokens agree and whose `apart` (bucket) is one: the first
    place of each group, its smallest `low` and largest `high` page. A distinct separator after
    each string keeps runs inside strings."""
    order, shared = suffix_array(tokens, least)
    group = np.cumsum(shared < least)
    by = np.lexsort((apart[order], group))  # suffixes of one group, bucket by bucket
    order, group = order[by], group[by]
    key = apart[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))) if len(order) else np.zeros(0, np.int64)
    if not len(first):
        return first, first, first
    return order[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def array_runs(batches):
    """(f, g, bucket, low, high): the runs of RUN tokens in strings sorted by bucket. Runs of one
    page in a bucket that lies whole in one array can't come again and go at once."""

    def out(rows: pa.Table, cut: set):
        rows = rows.combine_chunks()
        data, off = C.text_bytes(rows["string"])
        ws, we, row = C.words(data, off)
        h = C.word_hashes(data, ws, we)
        n = np.bincount(row, minlength=rows.num_rows)
        _, code = np.unique(h, return_inverse=True)
        at = np.arange(len(ws)) + row  # a separator after each string
        tokens = np.full(len(ws) + rows.num_rows, -1, np.int64)
        tokens[at] = code
        gaps = np.flatnonzero(tokens < 0)
        tokens[gaps] = len(ws) + np.arange(len(gaps))
        bucket, low, high = (np.asarray(rows[c]) for c in ("bucket", "low", "high"))
        wide = lambda x: np.repeat(x, n + 1)
        first, lo, hi = repeated_runs(tokens, wide(bucket), wide(low), wide(high), RUN)
        word = first - np.searchsorted(gaps, first)  # the group's first word
        inside = (tokens[first] < len(ws)) & (word + RUN <= len(ws))
        inside[inside] = row[word[inside]] == row[word[inside] + RUN - 1]
        first, lo, hi, word = first[inside], lo[inside], hi[inside], word[inside]
        name = wide(bucket)[first]
        keep = (lo != hi) | np.isin(name, np.array(list(cut), np.int64))
        f, g = window_prints(data, ws, we)
        return pa.RecordBatch.from_arrays([C.as_long(f[word[keep]]), C.as_long(g[word[keep]]), pa.array(name[keep]), pa.array(lo[keep]), pa.array(hi[keep])], ["f", "g", "bucket", "low", "high"])

    held, size, cut = [], 0, set()
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, ARRAY_STRINGS - size)
            at += part.num_rows
            held.append(part)
            size += part.num_rows
            if size >= ARRAY_STRINGS:  # the last bucket may go on in the next array
                last = part.column(0)[part.num_rows - 1].as_py()
                yield out(pa.Table.from_batches(held), cut | {last})
                held, size, cut = [], 0, {last}
    if held:
        yield out(pa.Table.from_batches(held), cut)


def string_windows(batches):
    """(page, place, bucket, f, g): the windows of judged strings; place counts words of the stream."""
    for whole in batches:
        for b in C.chunks(whole, "string"):
            data, off = C.text_bytes(b.column(2))
            ws, we, row = C.words(data, off)
            f, g = window_prints(data, ws, we)
            inside = np.flatnonzero(row[: len(f)] == row[RUN - 1 :]) if len(f) else np.zeros(0, np.int64)
            r = row[inside]
            place = b.column(3).to_numpy()[r] + inside - np.searchsorted(row, r)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(r)), pa.array(place), b.column(0).take(pa.array(r)), C.as_long(f[inside]), C.as_long(g[inside])], ["page", "place", "bucket", "f", "g"])


def page_texts(found: bool):
    """(page_id, url, text, n_chars); with findings, columns 4 and 5 hold the repeated windows'
    places and the repeated units' buckets of the page."""

    def run(batches):
        for b in pieces_of(batches):
            if not found:
                pages = [blocks_of(x) for x in b.column(2).to_pylist()]
                out = [" ".join(t for k, t in p if k != ELSEWHERE) for p in pages]
            else:
                x = Streams(b.column(3).to_numpy(), b.column(2).to_pylist())
                step = np.zeros(len(x.ws) + RUN + 1, np.int64)
                first = np.searchsorted(x.row, np.arange(x.n))
                of, page, bucket, _, words, _ = x.units()
                small = np.zeros(len(page), bool)
                for i in range(b.num_rows):
                    if (runs := b.column(4)[i]).is_valid:
                        at = first[i] + np.asarray(runs.values)
                        np.add.at(step, at, 1)
                        np.add.at(step, at + RUN, -1)
                    if (units := b.column(5)[i]).is_valid:
                        small |= (page == i) & (words < RUN) & np.isin(bucket, np.asarray(units.values).view(U64))
                gone = np.concatenate([[0], np.cumsum(np.cumsum(step)[: len(x.ws)] > 0)])
                whole = (gone[x.end] - gone[x.start] == x.size) | small[of] if len(of) else np.zeros(0, bool)
                keep = (x.kind != ELSEWHERE) & ~(whole & (x.kind % 2 > 0))
                cut = np.searchsorted(x.page, np.arange(x.n + 1)).tolist()
                out = [" ".join(t for (_, t), ok in zip(p, keep[a:z].tolist(), strict=True) if ok) for p, a, z in zip(x.blocks, cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, any others) -> page_id, url, text, n_chars."""
    spark = pages.sparkSession
    scratch = C.Scratch(spark, "html-text")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = pages.select("page_id", "url", "html", F.xxhash64(host, F.col("url").isNull()).alias("host"), F.xxhash64("page_id", "url", F.col("page_id").isNull(), F.col("url").isNull()).alias("page"))
    entries = scratch.keep(keyed.select("host", "page", "html").mapInArrow(page_entries, "bucket long, check long, page long, judged boolean"))
    open_ = entries.groupBy("bucket", "check").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.max("judged").alias("any")).filter("any and low <> high")
    open_ = scratch.keep(open_.select("bucket", "check"))
    if not open_.limit(1).count():  # no block is in doubt
        return pages.select("page_id", "url", "html").mapInArrow(page_texts(False), out)
    met = scratch.keep(entries.join(open_, ["bucket", "check"]))
    lists = scratch.keep(met.filter("check = 0").groupBy("page").agg(F.collect_set("bucket").alias("open")))
    strings = scratch.keep(keyed.join(lists, "page").select("host", "page", "html", "open").mapInArrow(page_strings, "bucket long, page long, string binary, place long, judged boolean"))
    distinct = strings.groupBy("bucket", "string").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    runs = distinct.select("bucket", "string", "low", "high").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(array_runs, "f long, g long, bucket long, low long, high long")
    runs = scratch.keep(runs.groupBy("f", "g", "bucket").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("f", "g", "bucket"))
    windows = strings.filter("judged").mapInArrow(string_windows, "page long, place long, bucket long, f long, g long")
    places = windows.join(runs, ["f", "g", "bucket"]).groupBy("page").agg(F.collect_set("place").alias("runs"))
    units = met.filter("check <> 0 and judged").groupBy("page").agg(F.collect_set("bucket").alias("units"))
    findings = scratch.keep(places.join(units, "page", "full"))
    return keyed.join(findings, "page", "left").select("page_id", "url", "html", "host", "runs", "units").mapInArrow(page_texts(True), out)


def query(spark, sf_dir):
    return main_texts(C.table(spark, sf_dir, "pages"))
