"""Pages that are keywords, link lists or product tags rather than sentences.

A text becomes a sequence of word classes: the commonest words of prose stand for themselves, other
words for their shape (lower, capitalised, upper case, mixed with digits, link, tag, long or short run
of an unspaced script), marks for themselves. Two trigram models of these classes give every window of
tokens a perplexity: one is trained on the sentence lines of all documents, the other on what whole
pages hold (infoboxes, lists, tables, references), each page counting a trigram once and patterns that
few pages have backing off to what is common to many. A window is abnormal if neither model
explains it, that is if both perplexities are beyond those of the corpus' own prose, or if it is far
more regular than prose.

Redirects, songs, glossaries and vandalism are abnormal too, so such windows must also promote: hold
outside links with their anchors unless they cite a source, tags, or keywords, which are words that the
text says over and over in its abnormal windows, each time beside other words, and that prose does not
use much. There is no list of words. A document is stuffed if windows that are both abnormal and
promoting hold more than half of its characters.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.runtime import materialize

#: So many of the commonest prose words are classes of their own.
FUNCTION_WORDS = 100
#: So many of them are no keywords however often a text has them.
PROSE_WORDS = 300
#: So many after the first share a class, mostly function words of the rarer languages.
COMMON_WORDS = 600
#: All of these are in such a share of the texts with sentence lines at least; spam that looks like
#: sentences has words in fewer.
WORD_SHARE = 0.0004
#: Tokens a window.
WINDOW = 16
#: Windows outside these quantiles of the perplexity of prose windows count as abnormal.
LOW, HIGH = 0.01, 0.9
#: What a share of all pages have, or this many of a small corpus, counts as much as what shorter
#: contexts say of it.
PAGE_SHARE, PAGES = 0.02, 20
#: Share of a window's words (with its neighbours) that must promote.
PROMOTING = 0.2
#: A keyword comes so often in the abnormal windows of a text, with so many different words at most
#: NEXT tokens away in its line. What is sung or said over and over in the same words has fewer.
REPEATED, PARTNERS, NEXT = 4, 3, 2
#: Windows with a greater share of function words hold no keywords.
SPARSE = 0.35
#: A case has FEWEST keywords and tags at least, or LEAST of these and links, a link counting as LINKED;
#: stray links in a short page are fewer.
FEWEST, LEAST, LINKED = 8, 15, 4
#: Bins of the histogram of window costs, and bins a unit of cost.
BINS, PER_UNIT = 1 << 16, 1024
#: Entries of a worker's token cache.
CACHE = 1_000_000

#: What stands for which letter in disguised words.
DISGUISE = str.maketrans("013457@$", "oieastas")

# words first, as most tokens are
_TOKEN = re.compile(r"(?!(?:https?://|www\.)[^\s\]|<>])[^\W_]+(?:['’][^\W_]+)?|\n|(?:https?://|www\.)[^\s\]|<>]+|(?<![\w&])#(?=\w*[^\W\d])\w+|</?\w[^<>\n]{0,200}>|\[\[|\]\]|\{\{|\}\}|[^\w\s]|_")
_SENTENCE = re.compile(r"^(?:''')?\w[^|{}<>\n]{38,}[.。!?]['\"»」]?\s*$")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_MARKS = list(".,;:!?'\"()=*#|-–—/«»「」·。、&%+") + ["[[", "]]", "{{", "}}", "\n"]
_SHAPES = ["<start>", "lower", "capital", "upper", "mixed", "number", "link", "tag", "long run", "short run", "mark", "common"]
_, LOWER, CAPITAL, UPPER, MIXED, NUMBER, LINK, TAG, LONG_RUN, SHORT_RUN, OTHER, COMMON = range(len(_SHAPES))
WORD, OUTSIDE, TAGGED = 1, 2, 3
NO_RANK = 1 << 30


@dataclass
class Model:
    """``words``: the prose words in order; ``prose`` and ``pages``: -ln p of the third class after
    two, of sentence lines and of whole pages; the cut-offs of windows' costs a token."""

    words: list[str]
    prose: np.ndarray
    pages: np.ndarray
    low: float
    high: float
    page_high: float


class Classes(dict):
    """Token to its class."""

    def __init__(self, words: Sequence[str]):
        super().__init__()
        own = len(_SHAPES) + len(_MARKS)
        self.fixed = {w: own + i if i < FUNCTION_WORDS else COMMON for i, w in enumerate(words)} | {m: len(_SHAPES) + i for i, m in enumerate(_MARKS)}
        self.size = own + min(FUNCTION_WORDS, len(words))

    def __missing__(self, tok: str) -> int:
        self[tok] = c = self._of(tok)
        return c

    def _of(self, tok: str) -> int:
        head = tok[0]
        if head.isalnum():
            known = self.fixed.get(tok.lower())
            if known is not None:
                return known
            if tok.isalpha():
                if not tok.isascii() and _UNSPACED.search(tok):
                    return LONG_RUN if len(tok) > 6 else SHORT_RUN
                return UPPER if len(tok) > 1 and tok.isupper() else CAPITAL if head.isupper() else LOWER
            if len(tok) > 4 and tok.startswith(("http", "www.")):
                return LINK
            digits = sum(map(str.isdigit, tok))
            if digits:
                return NUMBER if digits == len(tok) else MIXED
            if not tok.isascii() and _UNSPACED.search(tok):
                return LONG_RUN if len(tok) > 6 else SHORT_RUN
            return UPPER if tok.isupper() else CAPITAL if head.isupper() else LOWER
        return TAG if head in "#<" and len(tok) > 1 else self.fixed.get(tok, OTHER)


class Tokens(dict):
    """Token to its number; attributes by number in the arrays."""

    def __init__(self, words: Sequence[str]):
        super().__init__()
        self.class_of = Classes(words)._of
        self.ranks = {w: i for i, w in enumerate(words)}
        self.cls, self.norm, self.size, self.rank = array("i"), array("i"), array("i"), array("i")
        self.kind, self.small = array("b"), array("b")
        self.ref = array("b")  # 1 opens a reference, -1 closes one
        self.norms: dict[str, int] = {}

    def __missing__(self, tok: str) -> int:
        n, head, low = len(self.cls), tok[0], tok.lower()
        c, kind, norm, ref = self.class_of(tok), 0, -1, 0
        if head.isalnum():
            kind = OUTSIDE if c == LINK else 0 if c == NUMBER else WORD
            if kind != OUTSIDE:
                word = low.translate(DISGUISE) if c == MIXED else low
                norm = self.norms.setdefault(word, len(self.norms))
        elif c == TAG:
            kind = TAGGED if head == "#" or "tags" in low else OUTSIDE if "://" in low and "href" in low else 0
            ref = -1 if low == "</ref>" else int(low == "<ref>" or low.startswith("<ref ") and not low.endswith("/>"))
        self.cls.append(c)
        self.norm.append(norm)
        self.size.append(len(tok))
        self.rank.append(self.ranks.get(low, NO_RANK))
        self.kind.append(kind)
        self.small.append(head.islower())
        self.ref.append(ref)
        self[tok] = n
        return n


def _numbers(texts: Iterable[list[str]], tokens: Tokens | Classes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (or classes) of the tokens of all texts end to end and where each text starts."""
    parts, at = [], [0]
    for t in texts:
        p = np.fromiter(map(tokens.__getitem__, t), np.int32)
        parts.append(p)
        at.append(at[-1] + len(p))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(at)


def _of(values: array, ids: np.ndarray) -> np.ndarray:
    """An attribute of tokens, without a copy of that of all."""
    return np.frombuffer(values, values.typecode)[ids] if len(values) else np.empty(0, np.int64)


def _before(cls: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one places before each, 0 beyond the start of its text."""
    one = np.r_[0, cls[:-1]] if len(cls) else cls
    two = np.r_[0, 0, cls[:-2]] if len(cls) > 1 else one
    first = at[:-1][at[:-1] < len(cls)]
    one[first] = two[first] = 0
    second = first[first + 1 < len(cls)] + 1
    two[second] = 0
    return two, one


def _costs(cls: np.ndarray, at: np.ndarray, *tables: np.ndarray) -> list[np.ndarray]:
    """What each class costs after the two before it, by each of ``tables``."""
    cells = _grams(cls, at, len(tables[0]))
    return [t.ravel()[cells] for t in tables]


def _windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows and the text of each; a text's last window may be short."""
    sizes = np.diff(at)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return at[:-1][owner] + inside * WINDOW, owner


def _is_sentence(line: str) -> bool:
    return _SENTENCE.match(line) is not None and "://" not in line


def _sentences(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The tokens of the sentence lines of each text that has any, a line feed between lines."""
    for t in texts:
        lines = [x for x in (t or "").split("\n") if _is_sentence(x)]
        if lines:
            yield _TOKEN.findall("\n".join(lines))


def _sentence_classes(texts: Sequence[str], cls: np.ndarray, at: np.ndarray, feed: int) -> Iterator[np.ndarray]:
    """The same as classes, cut from those of the whole texts; no token spans a line feed."""
    for t, a, b in zip(texts, at, at[1:]):
        lines = [_is_sentence(x) for x in t.split("\n")]
        if any(lines):
            own = cls[a:b]
            line = np.cumsum(own == feed)
            # a line feed belongs to the line it ends; the last chosen line has none
            line[own == feed] -= 1
            chosen = own[np.array(lines)[line]]
            yield chosen[:-1] if len(chosen) and chosen[-1] == feed else chosen


def _commonest(counts: Iterable[tuple[str, int]], n_texts: int) -> list[str]:
    """The prose words of a model, from the texts that have each, which come in order."""
    return [w for w, n in counts if n >= WORD_SHARE * n_texts]


def _prose_words(seen: Counter) -> dict[str, int]:
    return {w: n for w, n in seen.items() if w.isalpha() and w.islower() and not _UNSPACED.search(w)}


def _grams(cls: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The cell, of k ** 3, of each class after the two before it."""
    two, one = _before(cls, at)
    return (two.astype(np.int64) * k + one) * k + cls


def _page_grams(cls: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The cells of all texts, each once a text."""
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    return pa.array(text * k**3 + _grams(cls, at, k)).unique().to_numpy() % k**3


def _cost_table(grams: np.ndarray, k: int, weight: float) -> np.ndarray:
    """-ln p from the counts of all cells; each order is smoothed by the one below as if that had been
    seen ``weight`` times, the lowest by a uniform."""
    tri = grams.reshape(k, k, k)
    bi = tri.sum(0)
    uni = bi.sum(0)
    uni = (uni + 0.5) / (uni.sum() + 0.5 * k)
    bi = (bi + weight * uni) / (bi.sum(1, keepdims=True) + weight)
    tri = (tri + weight * bi[None]) / (tri.sum(2, keepdims=True) + weight)
    return -np.log(tri).astype(np.float32)


def _bins(cls: np.ndarray, at: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The bin of each window's cost a token; those of short windows are a second BINS."""
    starts, _ = _windows(at)
    width = np.diff(np.r_[starts, len(cls)])
    mean = np.add.reduceat(_costs(cls, at, cost)[0], starts) / width
    return np.minimum(mean * PER_UNIT, BINS - 1).astype(np.int64) + np.where(width == WINDOW, 0, BINS)


def _both_bins(cls: np.ndarray, at: np.ndarray, prose: np.ndarray, pages: np.ndarray) -> np.ndarray:
    return np.r_[_bins(cls, at, prose), 2 * BINS + _bins(cls, at, pages)]


def _cut_off(bins: np.ndarray, q: float) -> float:
    """The ``q`` quantile of the costs of full windows, of all where none is full, as exact as a bin is
    wide."""
    full, short = bins[:BINS], bins[BINS:]
    upto = np.cumsum(full if full.any() else short)
    return float(np.searchsorted(upto, q * upto[-1]) + 0.5) / PER_UNIT


def _page_table(grams: np.ndarray, k: int, pages: int) -> np.ndarray:
    """The costs of whole pages. Links and tags cost what chance does at least: that many pages are
    made of them makes them no better."""
    cost = _cost_table(grams, k, max(PAGES, PAGE_SHARE * pages))
    cost[:, :, [LINK, TAG]] = np.maximum(cost[:, :, [LINK, TAG]], np.log(k))
    return cost


def _model(words: list[str], prose: np.ndarray, pages: np.ndarray, bins: np.ndarray) -> Model:
    return Model(words, prose, pages, _cut_off(bins[: 2 * BINS], LOW), _cut_off(bins[: 2 * BINS], HIGH), _cut_off(bins[2 * BINS :], HIGH))


def fit(texts: Sequence[str | None]) -> Model | None:
    """The model of ``texts``; None without any sentence line."""
    lines = list(_sentences(texts))
    if not lines:
        return None
    seen = _prose_words(Counter(w for p in lines for w in set(p)))
    words = _commonest(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: FUNCTION_WORDS + COMMON_WORDS], len(lines))
    classes = Classes(words)
    (cls, at), k = _numbers(lines, classes), classes.size
    prose = _cost_table(np.bincount(_grams(cls, at, k), minlength=k**3), k, 2.0)
    whole, ends = _numbers((_TOKEN.findall(t or "") for t in texts), classes)
    pages = _page_table(np.bincount(_page_grams(whole, ends, k), minlength=k**3), k, int((np.diff(ends) > 0).sum()))
    return _model(words, prose, pages, np.bincount(_both_bins(cls, at, prose, pages), minlength=4 * BINS))


def _next(where: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` places the first at or after it where ``where`` holds, else ``size``."""
    at = np.append(np.flatnonzero(where), size)
    return at[np.searchsorted(at, np.arange(size))]


def _linked(ids: np.ndarray, at: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens are outside links that cite no source, which stand in the anchor of one, and
    which are links that do cite one. A link cites when it stands in a reference that is closed, or when its
    line has a number of four digits, as a year, and, as bibliographies do, a title in italics or a template open at the link.

    The anchor runs to the bracket that closes the link, in the markup that has it, else to the end
    of the line or table cell; in ``[anchor](link)`` it runs back."""
    link = _of(tokens.kind, ids) == OUTSIDE
    out = tuple(np.zeros(len(ids), bool) for _ in range(3))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    has = np.bincount(text, weights=link, minlength=len(at) - 1) > 0
    if has.any():  # texts without links need no look
        where = has[text]
        for x, y in zip(out, _linked_texts(ids[where], np.r_[0, np.cumsum(np.diff(at)[has])], tokens)):
            x[where] = y
    return out


def _linked_texts(ids: np.ndarray, at: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    link = _of(tokens.kind, ids) == OUTSIDE
    is_ = lambda t: ids == tokens.get(t, -9)
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    breaks = is_("\n") | first
    line = np.cumsum(breaks)
    text = np.cumsum(first)

    years = [i for t, i in tokens.items() if len(t) == 4 and t.isdecimal()]
    has = lambda x: np.bincount(line, weights=x)[line] > 0
    italics = is_("'") & np.r_[is_("'")[1:], False]
    # the reference mark before a token opens, the one after it closes, and both are of its text
    marks = _of(tokens.ref, ids)
    here = np.flatnonzero(marks)
    after = np.searchsorted(here, np.arange(n))
    sign, of = np.r_[0, marks[here], 0], np.r_[-1, text[here], -1]
    in_ref = (sign[after] == 1) & (of[after] == text) & (sign[after + 1] == -1) & (of[after + 1] == text)
    depth = np.cumsum(is_("{{").astype(np.int64) - is_("}}"))
    in_template = depth - np.r_[0, depth[:-1]][np.flatnonzero(breaks)][line - 1] > 0
    cited = link & (in_ref | (has(np.isin(ids, years)) & (has(italics) | in_template)))
    where = np.flatnonzero(link & ~cited)
    before = lambda t, k: (is_(t)[np.maximum(where - k, 0)]) & (where >= k)
    end = np.minimum(_next(np.r_[breaks[1:], True], n)[where] + 1, n)
    square, cell = _next(is_("]") | is_("]]"), n), _next(is_("|"), n)
    bracket, code = before("[", 1), before("=", 1) & (square[where] == where + 1)
    opening = _next(is_("[") | is_("[["), n)[where]
    end = np.minimum(end, np.where(bracket, square[where], np.where(code, opening, cell[where])))
    back = before("(", 1) & before("]", 2)
    last = np.maximum.accumulate(np.where(is_("[") | breaks, np.arange(n), 0))
    end = np.where(back, where + 1, end)
    begin = np.where(back, last[where], where)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return link & ~cited, np.cumsum(edge)[:n] > 0, cited


def _keywords(norm: np.ndarray, rank: np.ndarray, usable: np.ndarray, beside: np.ndarray, of_text: np.ndarray, of_line: np.ndarray, base: int) -> np.ndarray:
    """Which of the ``usable`` tokens are keywords of their text: rare in prose, repeated, next to
    several different words among ``beside``."""
    out = np.zeros(len(norm), bool)
    where = np.flatnonzero(usable & (rank >= PROSE_WORDS))
    if not len(where):
        return out
    key = of_text.astype(np.int64) * base + norm
    words, inverse, count = np.unique(key[where], return_inverse=True, return_counts=True)
    place = np.flatnonzero(beside & (rank >= FUNCTION_WORDS))
    a, b = place[:-1], place[1:]
    near = (b - a <= NEXT) & (of_text[a] == of_text[b]) & (of_line[a] == of_line[b]) & (norm[a] != norm[b])
    a, b = np.r_[a[near], b[near]], np.r_[b[near], a[near]]
    at = np.searchsorted(words, key[a]).clip(max=len(words) - 1)
    known = words[at] == key[a]
    pairs = np.unique(at[known].astype(np.int64) * base + norm[b[known]])
    chosen = (count >= REPEATED) & (np.bincount(pairs // base, minlength=len(words)) >= PARTNERS)
    out[where] = chosen[inverse]
    return out


def stuffed_shares(texts: list[str], model: Model, tokens: Tokens) -> np.ndarray:
    """Of each text the share of its tokens' characters in abnormal and promoting windows."""
    ids, at = _numbers(map(_TOKEN.findall, texts), tokens)
    out = np.zeros(len(texts))
    if not len(ids):
        return out
    cls, size, kind, norm, rank, small = (_of(x, ids) for x in (tokens.cls, tokens.size, tokens.kind, tokens.norm, tokens.rank, tokens.small))
    starts, owner = _windows(at)
    width = np.diff(np.r_[starts, len(ids)])
    add = lambda x: np.add.reduceat(x.astype(np.float64), starts)
    prose, pages = (add(c) / width for c in _costs(cls, at, model.prose, model.pages))
    abnormal = (prose > model.high) & (pages > model.page_high) | (prose < model.low)
    of_window = np.repeat(np.arange(len(starts)), width)
    of_text = owner[of_window]
    word = kind == WORD
    words = add(kind >= WORD)
    linked, anchor, cited = _linked(ids, at, tokens)
    # in an internal link only what is no name can be a keyword
    depth = np.cumsum((ids == tokens.get("[[", -9)).astype(np.int32) - (ids == tokens.get("]]", -9)))
    outside = depth - depth[at[:-1].clip(max=len(ids) - 1)][of_text] <= 0
    sparse = add(word & (rank < FUNCTION_WORDS)) <= SPARSE * np.maximum(words, 1)
    said = word & abnormal[of_window]
    own = _keywords(norm, rank, said & (outside | (small > 0)), said, of_text, np.cumsum(ids == tokens.get("\n", -9)), len(tokens.norms) + 1) & sparse[of_window] | (kind == TAGGED)
    promo = own | (kind == OUTSIDE) & ~cited | anchor & word
    hits = add(promo)

    def near(x: np.ndarray) -> np.ndarray:
        """With the windows on either side in the same text."""
        y = x.copy()
        same = owner[1:] == owner[:-1]
        y[1:] += np.where(same, x[:-1], 0)
        y[:-1] += np.where(same, x[1:], 0)
        return y

    promoting = (hits >= PROMOTING * np.maximum(words, 1)) & (near(hits) >= PROMOTING * np.maximum(near(words), 1)) & (hits > 0)
    chars = add(size)
    bad = abnormal & promoting
    total = lambda x: np.bincount(owner, weights=np.where(bad, add(x), 0), minlength=len(texts))
    n_own = total(own & ~anchor)
    enough = (n_own >= FEWEST) | (n_own + LINKED * total(linked) >= LEAST)
    # of a window that promotes by its links only these and their anchors count, not what they strayed into
    keyed = add(own & ~anchor) >= PROMOTING * np.maximum(words, 1)
    part = np.where(keyed, chars, add(np.where(anchor | own, size, 0)))
    bad = np.bincount(owner, weights=np.where(bad, part, 0), minlength=len(texts))
    return np.where(enough, bad / np.maximum(np.bincount(owner, weights=chars, minlength=len(texts)), 1), 0)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.words)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            got = []
            for i in range(0, len(texts), 500):
                if len(tokens) > CACHE:
                    tokens = Tokens(model.words)
                got.append(stuffed_shares([t or "" for t in texts[i : i + 500]], model, tokens))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(got) if got else np.empty(0))], names=["__key", "stuffed_share"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each prose word the texts that have it, and of "" all texts with sentence lines; a word may come
    out several times."""
    seen: Counter = Counter()
    n_texts = 0

    def out() -> pa.RecordBatch:
        words = _prose_words(seen)
        seen.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

    for b in batches:
        for p in _sentences(b.column(0).to_pylist()):
            seen.update(set(p))
            n_texts += 1
            if len(seen) > CACHE:
                yield out()
    yield out()
    yield pa.RecordBatch.from_pydict({"word": pa.array([""], pa.string()), "n": pa.array([n_texts], pa.int64())})


def _classify(words: Sequence[str]):
    """The classes of the sentence lines of each text that has any, a byte each, and, when a task is
    done, in how many texts it met each cell of the page model; of cell -1, how many had any token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(words)
        k, pages, seen = classes.size, np.zeros(classes.size**3, np.int64), 0
        schema = pa.schema([("classes", pa.binary()), ("cell", pa.int64()), ("n", pa.int64())])
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 500):
                if len(classes) > CACHE:
                    classes = Classes(words)
                some = [t or "" for t in texts[i : i + 500]]
                cls, at = _numbers(map(_TOKEN.findall, some), classes)
                if not len(cls):
                    continue
                pages += np.bincount(_page_grams(cls, at, k), minlength=k**3)
                seen += int((np.diff(at) > 0).sum())
                lines = pa.array([x.astype(np.uint8).tobytes() for x in _sentence_classes(some, cls, at, classes.fixed["\n"])], pa.binary())
                none = pa.nulls(len(lines), pa.int64())
                yield pa.RecordBatch.from_arrays([lines, none, none], schema=schema)
        where = np.flatnonzero(pages)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(where) + 1, pa.binary()), pa.array(np.r_[where, -1]), pa.array(np.r_[pages[where], seen])], schema=schema)

    return run


def _count_cells(cells, size: int):
    """How often ``cells`` names each of ``size`` cells for the classes of all texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                cls = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
                got, n = np.unique(cells(cls, np.cumsum([0, *map(len, texts)])), return_counts=True)
                total[got] += n
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(where, pa.int64()), "n": pa.array(total[where], pa.int64())})

    return run


def _added(cells: DataFrame, size: int) -> np.ndarray:
    """The counts of all tasks added; ``size`` is fixed, whatever the number of documents."""
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[got["cell"].to_numpy()] = got["n"].to_numpy()
    return total


def train(df: DataFrame, key: str, text: str = "text") -> Model | None:
    """What ``fit`` makes of the texts of all rows, by counts of tasks that are added; neither the
    order nor the partitions matter, nor does ``key``."""
    texts = df.select(F.col(text).alias("__text"))
    seen = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "word").limit(1 + FUNCTION_WORDS + COMMON_WORDS).collect()
    if not top or not top[0].n:
        return None
    words = _commonest([(r.word, r.n) for r in top[1:]], top[0].n)
    got = materialize(texts.mapInArrow(_classify(words), "classes binary, cell long, n long"), "classes")
    lines = got.where("classes IS NOT NULL").select("classes")
    count = lambda cells, size: _added(lines.mapInArrow(_count_cells(cells, size), "cell long, n long"), size)
    k = Classes(words).size
    prose = _cost_table(count(lambda cls, at: _grams(cls, at, k), k**3), k, 2.0)
    counts = _added(got.where("cell IS NOT NULL").select((F.col("cell") + 1).alias("cell"), "n"), k**3 + 1)
    pages = _page_table(counts[1:], k, int(counts[0]))
    return _model(words, prose, pages, count(lambda cls, at: _both_bins(cls, at, prose, pages), 4 * BINS))


def score(df: DataFrame, key: str, model: Model | None, text: str = "text") -> DataFrame:
    """``key`` and ``stuffed_share`` of every row: 0 for null, empty and blank texts and without a
    model. One row out per row in; texts of any length are scored whole."""
    kind = dict(df.dtypes)[key]
    if model is None:
        return df.select(key, F.lit(0.0).alias("stuffed_share"))
    shares = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(_scorer(model), f"__key {kind}, stuffed_share double")
    return shares.withColumnRenamed("__key", key)
