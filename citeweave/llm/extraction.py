"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks, the stretches of text that no block element divides. Each block has features of its
ancestors (tags, words of class, id and role, pairs of sectioning tags) and of its text (length, share of links,
punctuation); the field scores "main text" or not for each block, given these and the block before it. It is trained on
labelled pages and decoded by Viterbi, for all pages of a batch at once.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .layouts import labelled_pages

#: Features are hashed to so many weights.
WIDTH = 1 << 14
#: Labelled pages that the model of `built_in` learns from; the bound of what `fitted` takes from a table.
LESSONS = 700
#: Steps of the training, its step width, and the weight of the squared weights.
STEPS, RATE, PENALTY = 160, 0.08, 2e-4

# --- the page as leaf blocks ------------------------------------------------------------------

#: Elements of HTML by what they do to the text around them.
NOT_SHOWN = {"script", "style", "template", "noscript", "noframes", "noembed", "iframe", "head", "title", "svg", "math", "object", "canvas", "audio", "video", "xmp"}
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "map", "mark", "meter", "nobr", "output", "picture", "progress", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: An open element that a new one of these ends, and the elements that the search for it stops at.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
SECTIONS = {"article", "main", "section", "aside", "nav", "header", "footer", "form", "body", "table", "ul", "ol", "blockquote", "figure"}

_TAG = re.compile(r"<(?:!--|([a-zA-Z][^\s/>]*)|/([a-zA-Z][^\s/>]*)|[!?/])")
_REST = re.compile(r"""(?:[^>"']++|(?<==)"[^"]*+"|(?<==)'[^']*+'|(?<=[=] )"[^"]*+"|["'])*+>""")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop|itemtype|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


@functools.lru_cache(1 << 14)
def _named(tag: str, names: str) -> tuple[int, ...]:
    """Features of one element: its tag and the words of its class, id and role, with the words' four-letter parts."""
    out = [f"in:{tag}"]
    for word in set(_WORD.findall(_CAMEL.sub(" ", names).lower())):
        word = word[:40]
        out.append(f"name:{word}")
        out += [f"part:{word[i : i + 4]}" for i in range(len(word) - 3)]
    return tuple(dict.fromkeys(_slot(x) for x in out))


class _Element:
    __slots__ = ("tag", "features", "section", "hidden", "block")

    def __init__(self, tag: str, parent: _Element | None, own: tuple[int, ...]):
        self.tag = tag
        self.block = parent.block if parent and tag in INLINE else self
        self.hidden = tag in NOT_SHOWN or bool(parent and parent.hidden)
        had = parent.features if parent else frozenset()
        section = parent.section if parent else ""
        if tag in SECTIONS:  # pairs of sectioning tags tell an article's header from a page's
            own, section = (*own, _slot(f"within:{section}>{tag}")), tag
        self.section = section
        self.features = had if had.issuperset(own) else had.union(own)


@dataclass
class Block:
    text: str
    features: list[int]


def _step(n: int) -> int:
    return n.bit_length()


def _text_features(text: str, tag: str, section: str, linked: int, links: int) -> list[str]:
    n, words = len(text), text.count(" ") + 1
    share = min(4, linked * 4 // max(1, n))
    stops = sum(map(text.count, ".!?。؟…"))
    end = text[-1]
    heading = tag if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else ""
    return [
        "bias", f"tag:{tag}", f"tag:{section}>{tag}", f"length:{_step(n)}", f"words:{_step(words)}", f"linked:{share}", f"linked:{share}:{_step(words)}", f"links:{_step(links)}",
        f"stops:{_step(stops)}", f"commas:{_step(text.count(',') + text.count('،'))}", f"end:{end if end in '.!?:,|…»”' else 'x'}", f"first:{'A' if text[0].isupper() else '0' if text[0].isdigit() else 'a'}",
        *(["sign:©"] if "©" in text else []), *([f"heading:{heading}:{section}"] if heading else []),
    ]


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page with their features, in page order. Null and empty pages have none.

    Malformed pages are read as browsers do: missing end tags are implied, stray ones ignored, an open comment or tag at
    the end of the page is no text. White space within a block is one space; `br` is white space.
    """
    out: list[Block] = []
    if not html:
        return out
    root = _Element("", None, ())
    stack, open_tags, held, state = [root], {}, [], {"linked": 0, "links": 0}

    def close() -> None:
        """End the block that is being read."""
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                linked = sum(len(t.strip()) for t, a in held if a)
                at = stack[-1].block
                out.append(Block(text, [*(_slot(x) for x in _text_features(text, at.tag, at.section, linked, state["links"])), *at.features]))
            held.clear()
        state["links"] = 0

    def pop() -> None:
        e = stack.pop()
        open_tags[e.tag] -= 1

    def add(text: str) -> None:
        if text and not stack[-1].hidden:
            held.append((entities.unescape(text), bool(open_tags.get("a"))))

    at, n, low = 0, len(html), None
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        if html.startswith("<!--", m.start()):
            end = html.find("-->", m.start() + 2)
            at = n if end < 0 else end + 3
            continue
        start, end_tag = m.group(1), m.group(2)
        if not start and not end_tag:
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = _REST.match(html, m.end())
        if not rest:
            break
        at = rest.end()
        if start:
            tag = start.lower()
            if tag not in INLINE:
                close()
                if open_tags.get("p"):  # a block ends an open paragraph
                    depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag not in INLINE), 0)
                    if depth and stack[depth].tag == "p":
                        while len(stack) > depth:
                            pop()
                if tag in ENDS:
                    ends, stops = ENDS[tag]
                    depth = len(stack) - 1
                    if any(open_tags.get(x) for x in ends):
                        while depth and stack[depth].tag not in ends and stack[depth].tag not in stops:
                            depth -= 1
                        if depth and stack[depth].tag in ends:
                            while len(stack) > depth:
                                pop()
                elif tag != "head" and open_tags.get("head") and stack[-1].tag == "head" and tag not in RAW | {"link", "meta", "base", "script", "noscript", "template"}:
                    pop()
            elif tag == "br":
                add(" ")
            attributes = html[m.end() : at - 1]
            if tag in VOID:
                continue
            if attributes.endswith("/") and tag not in INLINE and open_tags.get("svg"):
                continue
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
            if tag == "a" and open_tags.get("a"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "a":
                        open_tags["a"] -= 1
                        del stack[i]
                        break
            if tag in INLINE:
                e = _Element(tag, stack[-1], ())
            else:
                e = _Element(tag, stack[-1], _named(tag, names[:4000]))
            if tag == "a":
                state["links"] += 1
            stack.append(e)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in RAW:
                low = html.lower() if low is None or len(low) != n else low
                end = low.find(f"</{tag}", at) if len(low) == n else next((x.start() for x in re.compile(f"</{tag}", re.I).finditer(html, at)), -1)
                end = n if end < 0 else end
                add(html[at:end])
                at = end
        else:
            tag = end_tag.lower()
            if tag in INLINE:
                if open_tags.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            open_tags[tag] -= 1
                            del stack[i]
                            break
                        if stack[i].tag not in INLINE:
                            break
                continue
            close()
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
    close()
    return out


# --- the field --------------------------------------------------------------------------------


@dataclass
class Field:
    """emission: a weight for each feature; change[a, b]: for a block labelled b behind one labelled a; first[b]: at the start.

    Label 1 is main text, and the emission is for it against label 0."""

    emission: np.ndarray
    change: np.ndarray
    first: np.ndarray

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """The emission of every block of all pages, one after another."""
        flat, size = _flat(pages)
        return np.add.reduceat(self.emission[flat], np.cumsum(size) - size) if len(size) else np.zeros(0)

    def decode(self, pages: list[list[Block]]) -> np.ndarray:
        """The most probable labels of every block (Viterbi); all pages advance together, the long ones on their own at the end."""
        size = np.array([len(p) for p in pages], np.int64)
        score, start = self.scores(pages), np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        back, best = np.zeros((len(score), 2), np.int8), np.zeros((len(score), 2))
        left = len(order)
        for t in range(int(size.max(initial=0))):
            while size[order[left - 1]] <= t:
                left -= 1
            at = start[order[:left]] + t
            if t:
                ways = best[at - 1][:, :, None] + self.change[None]
                back[at], now = ways.argmax(1), ways.max(1)
            else:
                now = np.repeat(self.first[None], left, 0)
            now[:, 1] += score[at]
            best[at] = now
        label = np.zeros(len(score), np.int8)
        left = len(order)
        ends = np.full(len(size), -1, np.int8)
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            on = order[: np.searchsorted(-size[order], -t, side="left")]
            at = start[on] + t
            last = size[on] == t + 1
            ends[on[last]] = best[at[last]].argmax(1)
            label[at] = ends[on]
            ends[on] = back[at, label[at]]
        return label


def _flat(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(b.features) for p in pages for b in p], np.int64)
    return np.fromiter((f for p in pages for b in p for f in b.features), np.int64, int(size.sum())), size


def labels_of(page: list[Block], text: str) -> list[int]:
    """1 for the blocks of a page that stand as lines of its main text, in order."""
    lines, at, out = text.split("\n"), 0, []
    for b in page:
        try:
            found = lines.index(b.text, at)
        except ValueError:
            found = -1
        out.append(int(found == at or found > 0))
        at = found + 1 if found >= 0 else at
    return out


def fit(labelled: Iterable[tuple[str, str]]) -> Field:
    """The field of greatest penalised likelihood on pages with their main text (lines as `op11` returns them).

    Forward and backward sums run over all pages at once, padded to the longest; the weights move by Adam. The same
    pages give the same field. No pages, or pages without blocks, give a field of zeros, which calls nothing main text.
    """
    pages, labels = [], []
    for html, text in labelled:
        page = blocks(html)
        if page:
            pages.append(page)
            labels.append(labels_of(page, text))
    model = Field(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return model
    flat, size = _flat(pages)
    starts, block = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    n, most = len(pages), max(map(len, pages))
    there = np.zeros((n, most), bool)
    for i, p in enumerate(pages):
        there[i, : len(p)] = True
    gold = np.zeros((n, most), np.int64)
    gold[there] = np.concatenate(labels)
    pairs = there[:, 1:]
    seen_change = np.zeros((2, 2))
    np.add.at(seen_change, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    seen_first = np.bincount(gold[:, 0], minlength=2)
    weights = np.zeros(WIDTH + 6)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    total = len(size)
    for step in range(1, STEPS + 1):
        change, first = weights[WIDTH : WIDTH + 4].reshape(2, 2), weights[WIDTH + 4 :]
        e = np.zeros((n, most, 2))
        e[there, 1] = np.add.reduceat(weights[flat], starts)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = first + e[:, 0]
        for t in range(1, most):
            ways = forward[:, t - 1, :, None] + change
            forward[:, t] = np.where(there[:, t, None], np.logaddexp(ways[:, 0], ways[:, 1]) + e[:, t], forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            ways = change + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(there[:, t + 1, None], np.logaddexp(ways[:, :, 0], ways[:, :, 1]), 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        share = np.exp(forward[..., 1] + backward[..., 1] - z[:, None])
        joint = np.exp(forward[:, :-1, :, None] + change + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
        slope = np.zeros_like(weights)
        slope[:WIDTH] = np.bincount(flat, (gold[there] - share[there])[block], WIDTH)
        slope[WIDTH : WIDTH + 4] = (seen_change - joint[pairs].sum(0)).ravel()
        first_share = share[:, 0].sum()
        slope[WIDTH + 4 :] = seen_first - np.array([n - first_share, first_share])
        slope = slope / total - PENALTY * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights = weights + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights[:WIDTH], weights[WIDTH : WIDTH + 4].reshape(2, 2), weights[WIDTH + 4 :])


@functools.cache
def built_in() -> Field:
    """The field learned from `LESSONS` labelled pages of many layouts."""
    return fit(labelled_pages(LESSONS))


def fitted(labelled: DataFrame, bound: int = LESSONS) -> Field:
    """The field learned from a table (html, text) of labelled pages: at most `bound` rows, those of least hash."""
    rows = labelled.select("html", "text").dropna().orderBy(F.xxhash64("html"), "html", "text").limit(bound).toArrow()
    return fit(zip(rows.column("html").to_pylist(), rows.column("text").to_pylist()))


# --- Spark ------------------------------------------------------------------------------------


def main_text(pages: DataFrame, model: Field | None = None, html: str = "html") -> DataFrame:
    """The pages with text (the main text, blocks joined by line feeds) and n_chars (its code points) in place of html.

    One pass without a shuffle; each row is read on its own, so repeated rows give equal texts. A page that is null,
    empty or without main text has the text "". Other columns go through; ones named text or n_chars are replaced.
    """
    small_batches(pages.sparkSession)
    model = model or built_in()
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html):
            cut = [blocks(x) for x in part.column(part.schema.get_field_index(html)).to_pylist()]
            label, at, texts = model.decode(cut), 0, []
            for page in cut:
                texts.append("\n".join(b.text for b, on in zip(page, label[at : at + len(page)]) if on))
                at += len(page)
            columns = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).cast("string").alias(html)).mapInArrow(run, f"{schema}{', ' if keep else ''}text string, n_chars long")
