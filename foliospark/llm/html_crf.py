"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, runs of text between the tags of block elements.  Features of a block are the tags and the
class, id and role words of its ancestors, its length, link and sentence density, telling words of short blocks, and its
place.  The field has two labels, main text and the rest, with weights for features, starts and neighbouring labels; it is
trained on labelled pages by gradient steps on the likelihood (forward and backward sums), and Viterbi's method decodes a page.

`labelled_pages` writes the training pages: layouts of many kinds with known labels (articles, menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, with and without telling names).  Other labelled pages can be given to `train`.

Defined results: a null or empty page, or one without main text, gives the empty string; text is never cut or capped; broken
markup is read as browsers do (open paragraphs and list items end where the next begins); scripts, styles and comments are no
text; repeated rows have their own results; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import slices

BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
                    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul").split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table select body html article section div".split())
TELLING = frozenset(("cookie cookies consent subscribe newsletter copyright © reply replies comment comments login password share advertisement sponsored advert "
                     "privacy terms menu search related read more sign email follow rights reserved").split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CUT = re.compile(r"[^a-z]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]      # ancestors, outermost first
    names: frozenset[str]      # words of their class, id and role
    linked: int                # characters inside links


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag with a slash if it closes, attributes); raw elements are left out."""
    at = search = 0
    while match := _TAG.search(html, search):
        name = (match[2] or "").lower()
        yield html[at:match.start()], (match[1] or "") + name, match[3] or ""
        at = search = match.end()
        if name in RAW and not match[1] and not (match[3] or "").endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = search = end.end() if end else len(html)
            yield "", "/" + name, ""
    yield html[at:], "", ""


def leaf_blocks(html: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    held: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, tuple(t for t, _ in stack), frozenset().union(*(n for _, n in stack)) if stack else frozenset(), min(linked, len(text))))
        held.clear()
        linked = 0

    def close(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for text, tag, attributes in _pieces(html or ""):
        if text:
            plain = unescape(text)
            held.append(plain)
            linked += len(plain.strip()) if links else 0
        name = tag.lstrip("/")
        if not name:
            continue
        block = name in BLOCKS
        if block:
            flush()
        if name == "br":
            held.append(" ")
        if name in ("a", "button", "label"):
            links = max(0, links + (1 if tag == name else -1))
        if tag != name:
            if block:
                close({name}, frozenset())
        elif block and name not in VOID and not attributes.endswith("/"):
            close({"p"}, SCOPES)
            if name in CLOSES:
                close(CLOSES[name], SCOPES - CLOSES[name])
            words = frozenset(w for m in _NAMES.finditer(attributes) for w in _CUT.split((m[2] or m[3] or m[4] or "").lower()) if w) if attributes else frozenset()
            stack.append((name, words))
            links = 0
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        words = b.text.split()
        size = min(7, int(np.log2(len(words) + 1)))
        parent = b.tags[-1] if b.tags else ""
        density = int(4 * b.linked / max(1, len(b.text)))
        ends = len(_SENTENCE.findall(b.text))
        row = ["any", f"parent {parent}", f"size {size}", f"links {density}", f"sentences {min(3, ends)}", f"{parent} {size}", f"{parent} links {density}",
               f"place {int(4 * i / len(blocks))}", f"first {i == 0}", f"last {i == len(blocks) - 1}"]
        row += [f"in {t}" for t in set(b.tags) if t not in ("html", "body")]
        row += [f"name {n}" for n in b.names]
        if len(words) < 30:
            row += [f"says {w}" for w in {w.strip(".,:;!?()").lower() for w in words} & TELLING]
        out.append(row)
    return out


@dataclass
class Field:
    """weights[feature, label], start[label], step[label before, label]; label 1 is main text."""

    number: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.number.get
        return np.array([self.weights[[k for f in row if (k := get(f)) is not None]].sum(axis=0) for row in rows]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi's best labels."""
        if not rows:
            return []
        scores, ((a00, a01), (a10, a11)) = self.scores(rows).tolist(), self.step.tolist()
        x, y = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = x + a00 < y + a10, x + a01 < y + a11
            back.append((from0, from1))
            x, y = s0 + (y + a10 if from0 else x + a00), s1 + (y + a11 if from1 else x + a01)
        label = int(y > x)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 4) -> Field:
    """Weights that make the labels of the pages likely: steps along the gradient of the log likelihood, page by page."""
    number: dict[str, int] = {}
    coded = [([np.array([number.setdefault(f, len(number)) for f in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
    field = Field(number, np.zeros((len(number), 2)), np.zeros(2), np.zeros((2, 2)))
    past, past_start, past_step = np.full((len(number), 2), 1e-3), np.full(2, 1e-3), np.full((2, 2), 1e-3)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(coded)
        for rows, labels in coded:
            scores = np.array([field.weights[r].sum(axis=0) for r in rows])
            n = len(rows)
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = scores[0] + field.start
            for i in range(1, n):
                forward[i] = scores[i] + np.logaddexp(forward[i - 1, 0] + field.step[0], forward[i - 1, 1] + field.step[1])
            for i in range(n - 2, -1, -1):
                later = scores[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(field.step[:, 0] + later[0], field.step[:, 1] + later[1])
            whole = np.logaddexp(forward[-1, 0], forward[-1, 1])
            wrong = -np.exp(forward + backward - whole)   # minus the probabilities of the labels
            wrong[np.arange(n), labels] += 1
            both = np.zeros((2, 2))
            for i in range(1, n):
                both -= np.exp(forward[i - 1][:, None] + field.step + (scores[i] + backward[i])[None, :] - whole)
                both[labels[i - 1], labels[i]] += 1
            flat, sizes = np.concatenate(rows), [len(r) for r in rows]
            step = np.zeros_like(field.weights)
            np.add.at(step, flat, np.repeat(wrong, sizes, axis=0))
            used = np.unique(flat)
            step = step[used] - decay * field.weights[used]
            past[used] += step ** 2
            past_start += wrong[0] ** 2
            past_step += both ** 2
            field.weights[used] += rate * step / np.sqrt(past[used])
            field.start += rate * wrong[0] / np.sqrt(past_start)
            field.step += rate * both / np.sqrt(past_step)
    return field


def labelled_pages(n: int = 260, seed: int = 44) -> Iterator[tuple[str, list[str]]]:
    """Pages of many layouts with the texts of their main blocks."""
    r = random.Random(seed)
    pool = ["".join(r.choice("th er on an re he in ed nd ou ti es or is ar le qu ai mo sch".split()) for _ in range(r.randint(1, 4))) for _ in range(600)]
    main: list[str] = []

    def words(least: int, most: int) -> str:
        return " ".join(r.choice(pool) for _ in range(r.randint(least, most)))

    def prose(least: int, most: int) -> str:
        out = []
        while sum(map(len, out)) < 6 * most:
            out.append(words(2, 14).capitalize() + r.choice(".....?!"))
            if r.random() < 0.3 and sum(map(len, out)) > 6 * least:
                break
        return " ".join(out)

    def tag(name: str, body: str, names: str = "") -> str:
        named = f' {r.choice(("class", "id"))}="{r.choice(names.split())}"' if names and r.random() < 0.8 else ""
        return f"<{name}{named}>{body}</{name}>"

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(count))

    def keep(text: str) -> str:
        main.append(" ".join(text.split()))
        return text

    def extra(inside: bool) -> str:
        """Something that is no main text."""
        kind = r.choice("ad share notice form related aside comments promo figure login crumbs cookie".split())
        if kind == "ad":
            return tag(r.choice(("div", "section", "aside")), r.choice((words(3, 30), prose(3, 25), f"<p>{prose(3, 25)}</p>", "Advertisement " + words(2, 9))), "ad ads advert ad-slot sponsored banner promo-box adsbox")
        if kind in ("share", "crumbs"):
            return tag("div" if r.random() < 0.5 else "ul", links(r.randint(2, 6)) if r.random() < 0.5 else words(1, 5), "share social breadcrumb breadcrumbs tags meta toolbar")
        if kind in ("notice", "cookie"):
            return tag("div", f"<p>{r.choice(('This site uses cookies.', 'Cookie notice:', 'We value your privacy.', 'Notice:', ''))} {prose(3, 20)}</p><button>{words(1, 2)}</button>", "cookie cookie-banner notice consent alert gdpr popup modal")
        if kind in ("form", "login"):
            return f"<form action='/x'><label>{words(1, 3)}</label><input type=text><p>{r.choice(('Subscribe to our newsletter', 'Sign in', 'Search', ''))} {words(1, 12)}</p><select><option>{words(1, 2)}</option></select><button>{words(1, 2)}</button></form>"
        if kind == "related":
            return tag(r.choice(("div", "section", "aside")), f"<h3>{r.choice(('Related', 'Read more', words(1, 3)))}</h3><ul>{links(r.randint(2, 6))}</ul>", "related more recommended read-next")
        if kind == "comments":
            one = lambda: tag(r.choice(("li", "div", "article", "p")), f"<b>{words(1, 2)}</b> {prose(2, 30)}" if r.random() < 0.5 else f"<p>{words(1, 2)}</p><p>{prose(2, 40)}</p>", "comment comment-body reply")
            return tag(r.choice(("section", "div", "ol", "ul")), (f"<h3>{r.choice(('Comments', words(1, 3), 'Replies'))}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5))), "comments comment-list discussion responses respond")
        if kind == "aside":
            return tag("aside", f"<h4>{words(1, 3)}</h4><p>{prose(2, 25)}</p>" if r.random() < 0.6 else words(2, 20), "sidebar widget side")
        if kind == "promo":
            return tag("div", f"<p>{prose(2, 15)}</p>", "promo newsletter subscribe teaser signup")
        return tag("div", f"<ul>{links(r.randint(1, 4))}</ul>", "widget menu toc links")

    for _ in range(n):
        main.clear()
        menu = f"<ul>{links(r.randint(3, 8))}</ul>" if r.random() < 0.7 else " ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(r.randint(3, 7)))
        top = r.choice((f"<nav>{menu}</nav>", tag("div", menu, "nav menu navbar navigation topbar"), f"<header><h1>{words(1, 3)}</h1><nav>{menu}</nav><p>{words(2, 8)}</p></header>", tag("div", f"<p>{words(1, 6)}</p>" + menu, "header masthead top site-header")))
        before = "".join(extra(False) for _ in range(r.randint(0, 2)))
        body = []
        if r.random() < 0.85:
            body.append(f"<h1>{keep(words(2, 9))}</h1>")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.62:
                text = keep(r.choice((prose(4, 60), prose(4, 120), prose(1, 6), words(1, 3).capitalize() + ".", " | ".join(words(1, 1) for _ in range(r.randint(3, 20))))))
                cut = len(text) // 2
                cut = text.find(" ", cut)
                shown = text if cut < 0 or r.random() < 0.6 else r.choice((f"<b>{text}", f'{text[:cut]} <a href="/x">{text[cut + 1:cut + 9]}</a>{text[cut + 9:]}', f"{text[:cut]}<br>{text[cut + 1:]}", f"<em>{text[:cut]}</em> {text[cut + 1:]}"))
                body.append(f"<p>{shown}" + r.choice(("</p>", "</p>", "<br>", "\n")))
            elif kind < 0.72:
                body.append(f"<h2>{keep(words(1, 7))}</h2>")
            elif kind < 0.8:
                body.append("<ul>" + "".join(f"<li>{keep(words(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.85:
                body.append(f"<blockquote><p>{keep(prose(4, 40))}</p></blockquote>")
            elif kind < 0.89:
                body.append(f"<pre>{keep(words(3, 20))}</pre>")
            elif kind < 0.92:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                body.append(extra(True))
        content = "".join(body)
        shell = r.random()
        if shell < 0.5:
            content = f"<article>{content}</article>" if r.random() < 0.7 else f"<main><article>{content}</article></main>"
        elif shell < 0.65:
            content = f"<main>{content}</main>"
        elif shell < 0.9:
            content = tag("div", content, "content post entry article-body story main text post-content body-text")
        after = "".join(extra(False) for _ in range(r.randint(0, 3)))
        bottom = r.choice((f"<footer>&copy; {words(1, 3)} &middot; {prose(2, 20)}</footer>", tag("div", f"<p>Copyright {words(1, 4)}</p>" + menu, "footer bottom site-footer"), f"<footer><p>{prose(1, 15)}</p><ul>{links(3)}</ul></footer>"))
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{top}<!-- x -->{before}{content}{after}{bottom}<script>var t='</p>';</script></body></html>", list(main)


def coded(html: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page: its main blocks are those whose texts come, in order, in `main`."""
    blocks, labels, at = leaf_blocks(html), [], 0
    for b in blocks:
        hit = at < len(main) and b.text == main[at]
        labels.append(int(hit))
        at += hit
    return features(blocks), labels


@lru_cache(maxsize=1)
def trained() -> Field:
    return train([coded(html, main) for html, main in labelled_pages()])


def extract(pages: DataFrame, field: Field, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per page: key, text (main blocks in page order, an empty line between them), n_blocks."""
    sent = pages.sparkSession.sparkContext.broadcast(field)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts, counts = [], []
                for value in part.column("html").to_pylist():
                    blocks = leaf_blocks(value)
                    labels = sent.value.decode(features(blocks))
                    texts.append("\n\n".join([b.text for b, label in zip(blocks, labels, strict=True) if label]))
                    counts.append(len(blocks))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["key", "text", "n_blocks"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, text string, n_blocks bigint").withColumnRenamed("key", key)
