"""Main text of web pages: page structure, and a host's suffix array for what structure leaves open.

Each page is read as a token stream with the usual repairs (void elements, unclosed paragraphs and
inline elements, raw-text elements, missing end tags).  Structure alone decides what it can: scripts,
styles, forms, menus, asides, page headers and footers, hidden parts, adverts and reader comments go, and
in a page that marks its article (``article``, ``main``, the role, or a content class) what lies outside
goes too.  What wraps the largest marked article is never furniture, whatever its class says and if it is a
form of the whole page; on a page that marks none, neither is what holds more than half of the text.  In doubt are

  * all blocks of a page that marks no article, or only by ``main`` or a class's name,
  * blocks of any other marked article than the page's largest (teasers of other stories are marked like it), and
  * inside an article, elements whose name merely sounds like page furniture (share, notice, legal,
    related, header and so on); of these, ones that consist of links for the most part go at once.

The doubts go to the suffix array of the page's host.  The token streams of the host's pages (doubtful
blocks, and the text beside marked articles as evidence) give a suffix at every word: its first
``DEPTH`` words and the words behind them up to ``SPAN``.  Suffixes are dealt by ranges of (host, first
words), sorted, and equal beginnings of neighbours show the longest substring that stands on at least
``PAGES`` pages of different content; revisions and copies of one page count once.  Beginnings that
very many suffixes share are not sorted in one place: their longer beginnings are counted, length by length, which
finds the same lengths.  How long the repeated substring is decides: only those of ``LONG`` words, or of a whole
shorter block, are evidence, since a phrase of six words comes back in honest prose.  A block in doubt of whose
words ``COVERED`` lie in such substrings is boilerplate and goes; unique runs stay, and so does a page of which
nothing would be left.

Defined cases: null html gives the empty text; a null url is the host ''; a null page_id takes part
with structure alone; repeated rows of one page_id are one page of the suffix array, and each gets a row;
equal blocks of one page share their fate unless they stand at different sides of an article's mark; very long pages are read
whole, in time that goes with their length (a tag or quote without an end takes the rest of the page, as in HTML); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import weight_limit
from .store import Workspace
from .words import Words, as_long, gram_places, grams, slices

#: Words of the shortest substring that counts, words up to which suffixes are ordered, and pages of
#: different content on which a substring must stand.
DEPTH, SPAN, PAGES = 6, 16, 3
#: Words of a repeated substring that is evidence against a block with as many.
LONG = 12
#: Share of a block's words that repeated substrings must cover; share of links at which an element in doubt goes.
COVERED, LINKS = 0.8, 0.5
#: A tag, read once and without going back: quotes count after an equals sign only.  It fails where a page ends inside the tag.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "button", "select", "option", "textarea", "iframe", "svg", "canvas", "audio", "video", "dialog", "menu", "noembed", "noframes", "input"}
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "summary", "figcaption"}
_SELF = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|header|footer|foot|sidebar|aside|widgets?|ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|"
    r"share|sharing|social|comments?|disqus|respond|replies|related|recommended|recommendations|popup|modal|overlay|login|signup|search|pagination|pager|skip|copyright|legal|disclaimer|toolbar|hidden|paywall)(?=$|[\s_-])",
    re.I,
)
#: Inside an article only these names decide by themselves, and only as the beginning of a class or id.
_CERTAIN = re.compile(r"(?:^|\s)(?:nav|navbar|navigation|breadcrumbs?|sidebar|ads?|advert\w*|adsbygoogle|sponsored|cookies?|consent|gdpr|newsletter|comments?|disqus\w*|respond|replies|pagination|pager)(?:$|\s|[-_](?:box|bar|block|banner|container|wrapper|list|section|area|slot|unit|thread|form|notice|\d+)\b)", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|main|body|text)(?=$|[\s_-])", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


#: The attributes that say what an element is.  Tags without them are all alike, which is most of a page.
_TELLS = re.compile(r"class|id|role|hidden|style", re.I)


def _telling(raw: str) -> str:
    return raw if _TELLS.search(raw) else ""


@lru_cache(1 << 12)
def _kind(tag: str, raw: str, inside: bool, wraps: bool = False) -> str:
    """drop, doubt, article or main (marked), content (by class) or plain.  With ``wraps`` neither a name nor being a form counts."""
    at = _attributes(raw)
    role = at.get("role", "").lower()
    names = re.sub(r"\b(?:no|with|without|has|have)[-_][\w-]+", " ", f"{at.get('class', '')} {at.get('id', '')}")
    if (tag in _DROP or role in _ROLES) and not (wraps and (tag == "form" or role == "form")) or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return "drop"
    if tag in ("body", "html"):
        return "plain"
    noise = None if wraps else _NOISE.search(names)
    if inside and tag not in ("article", "main"):
        if not wraps and _CERTAIN.search(names):
            return "drop"
        return "doubt" if noise or tag == "header" else "plain"
    if noise and not (tag in ("article", "main") and not re.search("comment|ad|promo|related|widget", names, re.I)):
        return "drop"
    if tag == "header" and not wraps:
        return "drop"
    if tag == "article" or role == "article":
        return "article"
    if tag == "main" or role == "main":
        return "main"
    if tag in ("div", "section", "td") and _CONTENT.search(names):
        return "content"
    return "plain"


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes), ("end", tag, "") and ("raw", tag, "") for an element of raw text, in page order.

    Every character is looked at a bounded number of times; what has no end takes the rest of the page."""
    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        low = n if low < 0 else low
        if low > at:
            yield "text", entities.unescape(page[at:low]), ""
        if low == n:
            return
        second, third = page[low + 1 : low + 2], page[low + 2 : low + 3]
        if second in ("!", "?") or (second == "/" and third and not _letter(third)):  # comments of all kinds
            if page.startswith("<!--", low):
                end, size = page.find("-->", low + 4), 3
            elif page.startswith("<![CDATA[", low) and (end := page.find("]]>", low)) >= 0:
                yield "text", page[low + 9 : end], ""
                size = 3
            else:
                end, size = page.find(">", low), 1
            if end < 0:
                return
            at = end + size
            continue
        if not _letter(second) and not _letter(third if second == "/" else ""):
            yield "text", "<", ""
            at = low + 1
            continue
        m = _TAG.match(page, low)
        if m is None:  # the page ends inside the tag
            return
        at, tag = m.end(), m[2].lower()
        if m[1]:
            yield "end", tag, ""
        elif tag in _RAW:
            yield "raw", tag, ""
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        else:
            yield "start", tag, m[3]


class _Reader:
    """Elements as they open and close under the usual repairs; subclasses say what happens then."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.blocks_at: list[int] = []  # where in the stack block elements are

    def text(self, value: str) -> None:
        raise NotImplementedError

    def opened(self, tag: str, raw: str) -> None:
        raise NotImplementedError

    def closed(self, tag: str) -> None:
        raise NotImplementedError

    def apart(self) -> None:
        """Text before and after does not run on."""

    def space(self) -> None:
        """A line break inside running text."""

    def _pop(self) -> str:
        tag = self.stack.pop()
        self.open[tag] -= 1
        if self.blocks_at and self.blocks_at[-1] == len(self.stack):
            self.blocks_at.pop()
        self.closed(tag)
        return tag

    def _close(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def read(self, tokens: Iterable[tuple[str, str, str]]) -> None:
        for kind, value, raw in tokens:
            if kind == "text":
                self.text(value)
            elif kind == "end":
                if value == "br":
                    self.space()
                elif self.open[value]:
                    self._close(value)
                elif value == "p":
                    self.apart()
            elif kind == "start":
                self._start(value, raw)
        while self.stack:
            self._pop()

    def _start(self, tag: str, raw: str) -> None:
        if tag in ("br", "wbr"):
            if tag == "br":
                self.space()
            return
        if tag in _CLOSES_P and self.blocks_at and self.stack[self.blocks_at[-1]] == "p":
            self._close("p")
        if tag in _SELF:
            own, limit = _SELF[tag]
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth] in limit:
                    break
                if self.stack[depth] in own.split():
                    while len(self.stack) > depth:
                        self._pop()
                    break
        if tag in _BLOCK:
            self.apart()
        if tag in _VOID:
            return
        if tag == "body" and self.open["head"]:
            self._close("head")
        if raw.rstrip().endswith("/") and tag not in _BLOCK:
            return
        if tag in _BLOCK:
            self.blocks_at.append(len(self.stack))
        self.stack.append(tag)
        self.open[tag] += 1
        self.opened(tag, raw)


@lru_cache(1 << 12)
def _proof(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element is a marked article, and whether no wrapper can be below it."""
    at = _attributes(raw)
    marked = tag in ("article", "main") or at.get("role", "").lower() in ("article", "main")
    return marked, tag in _DROP - {"form"} or _CERTAIN.search(f"{at.get('class', '')} {at.get('id', '')}") is not None


class _Wrappers(_Reader):
    """Which elements, by their number in page order, hold the largest marked article or, without one, most of the text."""

    def __init__(self) -> None:
        super().__init__()
        self.sizes: list[int] = []  # characters in each element
        self.parent: list[int] = []
        self.marked: list[int] = []
        self.certain: set[int] = set()
        self.path: list[int] = []
        self.total = 0

    def text(self, value: str) -> None:
        n = len(value.strip())
        self.total += n
        if self.path:
            self.sizes[self.path[-1]] += n

    def opened(self, tag: str, raw: str) -> None:
        number = len(self.sizes)
        self.sizes.append(0)
        self.parent.append(self.path[-1] if self.path else -1)
        marked, certain = _proof(tag, _telling(raw))
        if marked:
            self.marked.append(number)
        if certain:
            self.certain.add(number)
        self.path.append(number)

    def closed(self, tag: str) -> None:
        number = self.path.pop()
        if self.path:
            self.sizes[self.path[-1]] += self.sizes[number]

    def found(self) -> set[int]:
        inside = [False] * len(self.parent)  # below an element that no wrapper can be
        for k, p in enumerate(self.parent):
            inside[k] = k in self.certain or (p >= 0 and inside[p])
        best = max((k for k in self.marked if not inside[k]), key=lambda k: (self.sizes[k], -k), default=-1)
        if best < 0:
            return {k for k, n in enumerate(self.sizes) if 2 * n > self.total and k not in self.certain}
        out, k = set(), self.parent[best]
        while k >= 0:
            out.add(k)
            k = self.parent[k]
        return out


class _Blocks(_Reader):
    def __init__(self, wrappers: set[int]):
        super().__init__()
        self.wrappers, self.number = wrappers, -1
        self.kinds: list[str] = []
        self.dropped = 0
        self.marks = {"article": 0, "main": 0, "content": 0}
        self.piece: list[str] = []
        self.doubts: list[int] = []  # elements in doubt that are open
        self.letters: list[list[int]] = []  # of each element in doubt, characters and those in links
        self.out: dict[str, list[tuple[str, int]]] = {"article": [], "main": [], "content": [], "plain": []}
        self.articles: list[int] = []  # of each block of an article, which article by number
        self.article = -1

    def flush(self) -> None:
        text = " ".join("".join(self.piece).split())
        self.piece.clear()
        if not text:
            return
        row = text, self.doubts[-1] if self.doubts else -1
        self.out["plain"].append(row)
        for name in ("article", "main", "content"):
            if self.marks[name]:
                self.out[name].append(row)
        if self.marks["article"]:
            self.articles.append(self.article)

    def text(self, value: str) -> None:
        if not self.dropped:
            self.piece.append(value)
            if self.doubts:
                count = len(value.strip())
                self.letters[self.doubts[-1]][0] += count
                self.letters[self.doubts[-1]][1] += count * (self.open["a"] > 0)

    def space(self) -> None:
        if not self.dropped:
            self.piece.append(" ")

    def apart(self) -> None:
        if not self.dropped:
            self.flush()

    def opened(self, tag: str, raw: str) -> None:
        self.number += 1
        kind = _kind(tag, _telling(raw), bool(self.marks["article"] or self.marks["main"] or self.marks["content"]), self.number in self.wrappers)
        self.kinds.append(kind)
        if kind == "drop":
            self.dropped += 1
        elif kind in self.marks:
            self.article += kind == "article" and not self.marks["article"]
            self.marks[kind] += 1
        elif kind == "doubt":
            if not self.dropped:
                self.flush()
            self.doubts.append(len(self.letters))
            self.letters.append([0, 0])

    def closed(self, tag: str) -> None:
        kind = self.kinds.pop()
        if tag in _BLOCK:
            self.flush()
        if kind == "drop":
            self.piece.clear()
            self.dropped -= 1
        elif kind in self.marks:
            self.marks[kind] -= 1
        elif kind == "doubt":
            self.flush()
            self.doubts.pop()


#: Whether a page has an element whose name or kind could hide what it wraps; without one no wrapper is looked for.
_SUSPECT = re.compile(r"<form\b|<header\b|\brole\s*=|\b(?:class|id)\s*=", re.I)


def blocks(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """((text, whether it is in doubt) of the blocks in page order, whether the page marks its article)."""
    wrappers: set[int] = set()
    tokens = list(_tokens(page))  # read once for both readers
    if _SUSPECT.search(page):
        first = _Wrappers()
        first.read(tokens)
        wrappers = first.found()
    reader = _Blocks(wrappers)
    reader.read(tokens)
    reader.flush()
    links = {k for k, (n, linked) in enumerate(reader.letters) if linked >= LINKS * n}
    if reader.out["article"]:
        sizes = Counter[int]()
        for (text, _), number in zip(reader.out["article"], reader.articles, strict=True):
            sizes[number] += len(text)
        largest = max(sizes, key=lambda number: (sizes[number], -number))
        return [(text, k >= 0 or number != largest) for (text, k), number in zip(reader.out["article"], reader.articles, strict=True) if k not in links], True
    for name in ("main", "content"):  # around the article, which is not marked itself
        if reader.out[name]:
            return [(text, True) for text, k in reader.out[name] if k not in links], True
    return [(text, True) for text, k in reader.out["plain"] if k not in links], False


def _outside(page: str) -> str:
    """The page without its marked article, for the evidence that its host repeats."""
    out, at = [], 0
    for m in _MARK.finditer(page):
        if m.start() >= at:
            out.append(page[at : m.start()])
            end = _MARK_END[m[1].lower()].search(page, m.end())
            at = end.end() if end else len(page)
    return " ".join([*out, page[at:]])


_MARK = re.compile(r"<(article|main)\b", re.I)
_MARK_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("article", "main")}


def _all_text(page: str) -> str:
    """All text of a page but raw text."""
    return " ".join(value for kind, value, _ in _tokens(page) if kind == "text")


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, head, tail, page_id, content, at) of every suffix: of doubtful blocks with their word's place
    among the page's doubtful words, of text beside marked articles as evidence (at null).  content is the
    same for most pairs of revisions of a page: the smallest hash of three words of its text."""
    for batch in batches:
        for part in slices(batch, "html"):
            whole, streams, owner, open_ = [], [], [], []
            for i, page in enumerate(part.column("html").to_pylist()):
                found, marked = blocks(page or "")
                whole.append(" ".join(t for t, _ in found))
                doubtful = "\n".join(t for t, doubt in found if doubt)
                beside = _all_text(_outside(page or "")) if marked else ""
                for text, is_open in ((doubtful, True), (beside, False)):
                    if text:
                        streams.append(text)
                        owner.append(i)
                        open_.append(is_open)
            content = _content(Words(pa.array(whole, pa.large_string())))
            words = Words(pa.array(streams, pa.large_string()))
            places, stream = gram_places(words.first, DEPTH)
            if not len(places):
                continue
            letters = words.hash.astype(np.uint32).astype(">u4")
            raw = letters.tobytes()
            stop = 4 * np.minimum(places + SPAN, words.first[1:][stream])
            page = np.array(owner)[stream]
            at = pa.array(places - words.first[:-1][stream], pa.int64(), mask=~np.array(open_)[stream])
            rows = list(zip((4 * places).tolist(), stop.tolist(), strict=True))
            yield pa.record_batch({
                "host": part.column("host").take(pa.array(page)), "head": pa.array([raw[a : a + 4 * DEPTH] for a, _ in rows], pa.binary()), "tail": pa.array([raw[a + 4 * DEPTH : b] for a, b in rows], pa.binary()),
                "page_id": part.column("page_id").take(pa.array(page)), "content": as_long(content[page]), "at": at,
            })


_SUFFIX = "host long, head binary, tail binary, page_id long, content long, at long"


def _content(words: Words) -> np.ndarray:
    """The smallest hash of three words of each text (of all its words, if there are fewer)."""
    places, owner = gram_places(words.first, 3)
    out = np.full(words.n, np.iinfo(np.uint64).max, np.uint64)
    if len(places):
        np.minimum.at(out, owner, grams(words.hash, 3)[places])
    short = np.flatnonzero((words.counts > 0) & (words.counts < 3))
    out[short] = [words.hash[words.first[i] : words.first[i + 1]].sum() for i in short]
    return out


def longest_repeats(tails: list[bytes], content: np.ndarray) -> np.ndarray:
    """Of sorted suffixes with one beginning, the words of the longest start that stands in ``PAGES``
    contents; 0 where even the beginning does not."""
    n, width = len(tails), 4 * (SPAN - DEPTH)
    rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tails), ">u4").reshape(n, -1)
    size = np.array([len(t) // 4 for t in tails])
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    out = np.zeros(n, np.int64)
    for length in range(SPAN - DEPTH, -1, -1):
        run = np.concatenate([[0], np.cumsum(common < length)])
        pairs = np.unique(np.stack([run, content]), axis=1)
        many = np.bincount(pairs[0], minlength=run[-1] + 1) >= PAGES
        hit = many[run] & (out == 0) & (size >= length)
        out[hit] = DEPTH + length
    return out


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, at, words) of doubtful suffixes that are repeated, from suffixes sorted by (host, head,
    tail); the rows of one beginning are held, which are few (heavy ones do not come here)."""
    held: list[pa.Table] = []

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words = longest_repeats(table.column("tail").to_pylist(), table.column("content").to_numpy())
        keep = pa.array(np.flatnonzero((words > 0) & table.column("at").is_valid().to_numpy()))
        if len(keep):
            yield pa.record_batch({"page_id": table.column("page_id").combine_chunks().take(keep), "at": table.column("at").combine_chunks().take(keep), "words": pa.array(words).take(keep)})

    for batch in batches:
        if not batch.num_rows:
            continue
        host, head = np.asarray(batch.column("host")), np.array(batch.column("head").to_pylist(), dtype=f"S{4 * DEPTH}")
        # numpy strips null bytes at the end of fixed strings, the same way on both sides
        cuts = np.flatnonzero((host[1:] != host[:-1]) | (head[1:] != head[:-1])) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
            part = pa.Table.from_batches([batch.slice(int(a), int(b - a))])
            if held and (held[-1].column("host")[0], held[-1].column("head")[0]) != (part.column("host")[0], part.column("head")[0]):
                yield from found(pa.concat_tables(held))
                held = []
            held.append(part)
    if held:
        yield from found(pa.concat_tables(held))


def unique_runs(found: list[tuple[str, bool]], repeated: list[tuple[int, int]]) -> list[str]:
    """The blocks without those in doubt that repeated substrings cover; these are given by the doubtful
    word that they start at and their words."""
    n = [len(t.encode().split()) if doubt else 0 for t, doubt in found]
    ends = np.cumsum(n)
    cover = np.zeros(sum(n) + SPAN, bool)
    of = np.searchsorted(ends, [at for at, _ in repeated], "right")
    for (at, words), k in zip(repeated, of.tolist(), strict=True):
        if words >= min(LONG, n[k]):
            cover[at : at + words] = True
    kept = [t for (t, doubt), size, end in zip(found, n, ends, strict=True) if not doubt or cover[end - size : end].sum() < COVERED * size]
    return kept or [t for t, _ in found]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = []
            for page, repeated in zip(part.column("html").to_pylist(), part.column("repeated").to_pylist(), strict=True):
                found, _ = blocks(page or "")
                texts.append("\n\n".join(unique_runs(found, [(r["at"], r["words"]) for r in repeated]) if repeated else [t for t, _ in found]))
            yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def repeated_places(suffixes: DataFrame, limit: int | None = None) -> DataFrame:
    """page_id, at, words: where in pages' doubtful words a substring starts that PAGES contents have."""
    limit = weight_limit(suffixes.count()) if limit is None else limit
    by_content = suffixes.groupBy("host", "head", "content").agg(F.count("*").alias("n"), F.count("at").alias("open"))
    heads = by_content.groupBy("host", "head").agg(F.count("*").alias("contents"), F.sum("n").alias("n"), F.sum("open").alias("open")).where((F.col("contents") >= PAGES) & (F.col("open") > 0)).select("host", "head", "n")
    # heavy beginnings: the longer ones are counted by length, with partial sums, and the longest that PAGES contents have is taken
    words = F.explode(F.sequence(F.lit(DEPTH), F.least(F.lit(SPAN), F.lit(DEPTH) + (F.octet_length("tail") / 4).cast("int")))).alias("words")
    hot = suffixes.join(F.broadcast(heads.where(F.col("n") > limit).select("host", "head")), ["host", "head"]).select("*", words)
    cut = hot.withColumn("start", F.substring(F.col("tail"), F.lit(1), (F.col("words") - DEPTH) * 4))
    enough = cut.select("host", "head", "words", "start", "content").distinct().groupBy("host", "head", "words", "start").agg(F.count("*").alias("contents")).where(F.col("contents") >= PAGES).drop("contents")
    heavy = cut.where("at is not null").join(enough, ["host", "head", "words", "start"], "left_semi").groupBy("page_id", "at").agg(F.max("words").cast("long").alias("words"))
    light = suffixes.join(heads.where(F.col("n") <= limit), ["host", "head"])
    dealt = light.repartitionByRange("host", "head").sortWithinPartitions("host", "head", "tail")
    return dealt.select("host", "head", "tail", "page_id", "content", "at").mapInArrow(_ordered, "page_id long, at long, words long").unionAll(heavy)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    work = Workspace(pages.sparkSession, "htmltext")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    pages_of = rows.where("page_id is not null and html is not null").select("page_id", F.xxhash64(host).alias("host"), "html").dropDuplicates(["page_id"])
    suffixes = work.keep(pages_of.mapInArrow(_suffixes, _SUFFIX), "suffixes")
    places = repeated_places(suffixes).distinct().groupBy("page_id").agg(F.collect_list(F.struct("at", "words")).alias("repeated"))
    covered = work.keep(places, "covered")
    work.drop(suffixes)
    return rows.join(covered, "page_id", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
