"""HTML extraction by a tree-structured graphical model: sum-product over the DOM gives each block's content marginal."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, slices, small_batches, table

FRAME, CONTENT, OTHER = 0, 1, 2
DEEPEST = 512  # elements nested deeper stand beside one another at this depth, as in browsers; their text stays
UNSEEN = ".?"  # the fact that an element has a name which training pages don't
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea iframe noembed noframes xmp".split())
_P_ENDS = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_SCOPE = set("ul ol dl table div article section main body html td th aside nav form footer header blockquote".split())


@lru_cache(maxsize=50_000)
def _attr_words(attrs: str) -> tuple[str, ...]:
    return tuple({w.lower() for m in _ATTR.finditer(attrs) for w in _WORD.findall(next(g for g in m.groups() if g is not None))})


class Tree:
    """Block elements and, as leaves, runs of text between their borders. parent, kind and facts per node; text per run."""

    def __init__(self):
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.tag: list[str] = ["#root"]
        self.facts: list[tuple[str, ...]] = [()]
        self.text: dict[int, str] = {}

    def add(self, parent: int, tag: str, facts: tuple[str, ...]) -> int:
        if self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.facts.append(facts)
        return len(self.parent) - 1


def parse_html(page: str) -> Tree:
    """A forgiving reading: end tags may be missing or stray, tags cut off at the end are dropped, raw elements have no text."""
    tree, stack = Tree(), [("#root", 0)]
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by name, so that no tag walks the stack
    run: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close_run() -> None:
        nonlocal linked
        if run:
            words = unescape("".join(run)).split()
            if words:
                text = " ".join(words)
                share = min(linked, len(text)) / len(text)
                n = len(words)
                facts = ("n" + str(min(6, n.bit_length()) // 2), "link" + str(int(share * 2.99)))
                tree.text[tree.add(stack[-1][1], "#run", facts)] = text
            run.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        if any(t not in _INLINE for t, _ in stack[k:]):
            close_run()
        for t, _ in reversed(stack[k:]):
            opened[t].pop()
            in_link -= t == "a"
        del stack[k:]

    def last(names: Iterable[str]) -> int:
        """The place in the stack of the innermost open element with one of the names; 0 if there is none."""
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    def push(name: str, node: int) -> None:
        opened[name].append(len(stack))
        stack.append((name, node))

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            run.append(text)
            linked += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        ends, name, attrs, closed = m.group(1, 2, 3, 4) if m[2] else m.group(5, 6, 7, 8)
        if not name or not closed:
            continue
        name = name.lower()
        if ends:
            if k := last((name,)):
                pop_to(k)
            continue
        if name == "br":
            run.append("\n")
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
            if close:
                at = page.find(">", at) + 1 or len(page)
            continue
        if name in _P_ENDS:
            if (k := last(("p",))) > last(_SCOPE):
                pop_to(k)
        if same := _SAME_ENDS.get(name):
            if (k := last(same)) > last(_SCOPE - same):
                pop_to(k)
        if name in _VOID:
            if name not in _INLINE:
                close_run() if name == "hr" else None
            continue
        if name in _INLINE:
            push(name, stack[-1][1])
            in_link += name == "a"
            continue
        close_run()
        push(name, tree.add(stack[-1][1], name, _attr_words(attrs) if attrs.strip() else ()))
    close_run()
    return tree


# ---- labelled pages -------------------------------------------------------------------------------------------------

_WORDS = "time year people way day thing world life hand part child eye place work week case point company number group problem fact water house city river light field story night paper music road state power line".split()
_MAIN = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.text", "div.main", "section", "td.content", "div.postBody")
_SIDE = (
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner", "div.cookie-notice", "div.notice", "div.consent",
    "div.gdpr", "div.alert", "div.popup", "div.modal", "div.sidebar", "aside.sidebar", "div.rail", "div.widget", "div.related", "div.recommended", "div.share", "div.social", "div.menu", "div.navbar", "div.breadcrumb",
    "div.header", "div.masthead", "div.topbar", "div.footer", "div.copyright", "div.legal", "div.disclaimer", "div.newsletter", "div.subscribe", "div.login", "div.search", "form.search", "section.comments", "div.comments",
    "div.comment", "ol.comment-list", "div.replies", "div.discussion", "div.thread", "div.disqus-thread", "div.responses", "section.respond", "div.reviews", "div.tags", "div.pagination", "div.toolbar", "ul.nav", "ul.menu", "ol.breadcrumb", "ul.pagination", "table.calendar", "dl.meta", "button", "select", "noscript", "template", "p.notice", "p.copyright", "p.ad",
    "div.secondary", "div.complementary", "div.cc-window", "div.cookiebar", "div.onetrust", "div.toc", "div.colophon", "div.tertiary", "div.side", "div.sidenav", "div.footnav", "div.teaser", "div.outbrain", "div.taboola", "div.trending", "div.author-box",
    "div.kommentare", "div.kommentar", "div.seitenleiste", "div.randspalte", "div.fusszeile", "div.kopfzeile", "div.werbung", "div.anzeige", "div.hinweis", "div.impressum", "div.datenschutz", "div.verwandt", "div.anmeldung", "div.suche", "div.leiste",
    "div.commentaires", "div.commentaire", "div.barre-laterale", "div.pied-page", "div.entete", "div.publicite", "div.annonce", "div.avis", "div.mentions-legales", "div.recherche", "div.connexion", "div.partager", "div.abonnement", "div.liens",
    "div.comentarios", "div.comentario", "div.barra-lateral", "div.pie-pagina", "div.cabecera", "div.publicidad", "div.anuncio", "div.aviso", "div.aviso-legal", "div.buscar", "div.iniciar-sesion", "div.compartir", "div.suscripcion", "div.relacionados",
)


def labelled_pages(n: int = 2000, seed: int = 7) -> Iterator[tuple[str, dict[str, int]]]:
    """Pages made by rule, whose elements carry an attribute data-y with the label of their subtree's top: 1 content, 2 other."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        out = " ".join(r.choice(_WORDS) for _ in range(r.randint(a, b)))
        return out.capitalize() + r.choice([".", ".", ".", "!", "", ""])

    def nothing() -> str:
        """A name that says nothing."""
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))

    def open_tag(spec: str, y: int) -> tuple[str, str]:
        name, _, kind = spec.partition(".")
        if r.random() < 0.1:
            kind = nothing()
        at = f' {r.choice(["class", "id", "class"])}="{kind}"' if kind else ""
        return f'<{name}{at} data-y="{y}">', f"</{name}>"

    def para(short: bool) -> str:
        if short:
            return f"<p>{words(1, 3)}</p>"
        if r.random() < 0.06:  # a list of links that belongs to the article
            return f"<p>{' '.join(f'<a href=/x>{words(1, 6)}</a>' for _ in range(r.randint(1, 4)))}</p>"
        tag = r.choice(["p"] * 8 + ["blockquote", "h2", "h3", "pre", "figcaption"])
        body = words(2, 9) if tag[0] == "h" else words(3, r.choice([12, 40, 90]))
        if r.random() < 0.2:
            body += f' <a href="/x">{words(1, 4)}</a> {words(1, 20)}'
        if r.random() < 0.1:
            kind = r.choice(["ul", "ul", "ol", "ol", "dl", "table"])
            items = [words(2, 18) for _ in range(r.randint(2, 6))]
            if kind == "dl":
                return f"<dl>{''.join(f'<dt>{words(1, 3)}</dt><dd>{x}</dd>' for x in items)}</dl>"
            if kind == "table":
                return f"<table>{''.join(f'<tr><td>{words(1, 3)}</td><td>{x}</td></tr>' for x in items)}</table>"
            return f"<{kind}>{''.join(f'<li>{x}</li>' for x in items)}</{kind}>"
        return f"<{tag}>{body}</{tag}>"

    def side() -> str:
        spec = r.choice(_SIDE)
        a, z = open_tag(spec, OTHER)
        how = r.random()
        if how < 0.35:
            body = f"<ul>{''.join(f'<li><a href=/y>{words(1, 3)}</a></li>' for _ in range(r.randint(2, 8)))}</ul>"
        elif how < 0.6:
            body = words(1, 30)
        elif how < 0.85 or any(x in spec for x in ("comment", "thread", "respon", "komment", "coment")):
            body = "".join(f"<p>{words(1, 60)}</p>" for _ in range(r.randint(1, 5)))
        else:
            body = f"<div><h3>{words(1, 5)}</h3><p>{words(2, 25)} <a href=/z>{words(1, 3)}</a></p></div>"
        return a + body + z

    for _ in range(n):
        inner = [f"<h1>{words(2, 10)}</h1>"] if r.random() < 0.8 else []
        short = r.random() < 0.15
        inner += [para(short) for _ in range(r.randint(1, 60 if short else 9))]
        for _ in range(r.choice([0, 0, 1, 2])):
            inner.insert(r.randint(0, len(inner)), side())
        if r.random() < 0.08:
            inner[0:1] = [f'<header data-y="1">{inner[0]}</header>']
        if r.random() < 0.25:
            inner = [f"<div>{''.join(inner)}</div>"]
        a, z = open_tag(r.choice(_MAIN), CONTENT)
        if r.random() < 0.15:  # no element holds the content alone
            a, z, inner = "", "", [re.sub(r"<(p|h[1-6]|ul|pre|blockquote|figcaption|div|header)>", r'<\1 data-y="1">', x, count=1) if "data-y" not in x else x for x in inner]
        body = [side() for _ in range(r.randint(0, 4))] + [a + "".join(inner) + z] + [side() for _ in range(r.randint(0, 4))]
        page = "".join(body)
        for _ in range(r.choice([0, 0, 1, 2])):
            page = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container', f' class={nothing()}', f' id={nothing()}'])}>{page}</div>"
        yield f"<html><head><meta charset=utf-8><title>t</title></head><body>{page}</body></html>"


class Model:
    """Potentials in logs: root (3), pair[tag] (3 x 3, parent by child), fact[tag] (3) and fact[word] (3)."""

    def __init__(self, pages: Iterator[str], smooth: float = 0.5):
        pair: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((3, 3)))
        fact: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for page in pages:
            marks = iter([int(y) if y else None for y in re.findall(r"<(?!/|meta|title|a\b)[a-z][^>]*?(?:data-y=\"(\d)\")?>", page)])
            tree = parse_html(re.sub(r' data-y="\d"', "", page))
            y = [FRAME] * len(tree.tag)
            for i in range(1, len(y)):
                up = y[tree.parent[i]]
                mark = None if tree.tag[i] == "#run" else next(marks)
                y[i] = up if up == OTHER or mark is None else mark
                pair[tree.tag[i]][up, y[i]] += 1
                for f in tree.facts[i]:
                    fact[f"{'#' if tree.tag[i] == '#run' else '.'}{f}"][y[i]] += 1
        for f in [f for f, c in fact.items() if f[0] == "." and c.sum() <= 3]:  # names seen once or so stand for all unknown ones
            fact[UNSEEN] += fact.pop(f)
        every = sum(pair.values())
        self.other = self._rows(every + smooth)
        # a tag seen in few places leans on what holds for all tags
        self.pair = {t: self._rows(c + np.exp(self.other) + smooth / 10) for t, c in pair.items()}
        total = every.sum(0)
        self.fact = {f: np.log((c + smooth) / (total + 2 * smooth)) for f, c in fact.items()}
        self.pair["#run"] = self._rows(pair["#run"] + smooth / 10)

    @staticmethod
    def _rows(c: np.ndarray) -> np.ndarray:
        return np.log(c / c.sum(1, keepdims=True))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model(labelled_pages())


def marginals(trees: list[Tree], model: Model) -> list[np.ndarray]:
    """P(content) of each node: messages go up from the leaves and down from the roots, all trees' nodes of a depth at once."""
    sizes = [len(t.tag) for t in trees]
    start = np.cumsum([0, *sizes])
    parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, start, strict=False)])
    depth = np.concatenate([np.array(t.depth) for t in trees])
    tags: dict[str, int] = {}
    kind = np.array([tags.setdefault(x, len(tags)) for t in trees for x in t.tag])
    pair = np.stack([model.pair.get(x, model.other) for x in tags])[kind]
    known: dict[tuple, np.ndarray] = {}
    zero = np.zeros(3)

    def own(tag: str, facts: tuple) -> np.ndarray:
        key = (tag == "#run", facts)
        if key not in known:
            known[key] = sum((model.fact.get(f"#{f}", zero) if key[0] else model.fact.get(f".{f}", model.fact.get(UNSEEN, zero)) for f in facts), zero)
        return known[key]

    up = np.array([own(t, f) for tree in trees for t, f in zip(tree.tag, tree.facts, strict=True)])
    root = start[:-1]
    up[root] += np.log([0.98, 0.01, 0.01])
    sent = np.zeros_like(up)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if depth.max() < 64 else np.split(o := np.argsort(depth, kind="stable"), np.searchsorted(depth[o], np.arange(1, int(depth.max()) + 1)))
    for at in levels[:0:-1]:
        z = pair[at] + up[at][:, None, :]
        top = z.max(2, keepdims=True)
        sent[at] = np.log(np.exp(z - top).sum(2)) + top[:, :, 0]
        np.add.at(up, parent[at], sent[at])
    down = np.zeros_like(up)
    for at in levels[1:]:
        above = down[parent[at]] + up[parent[at]] - sent[at]
        z = pair[at] + above[:, :, None]
        top = z.max(1, keepdims=True)
        d = np.log(np.exp(z - top).sum(1)) + top[:, 0, :]
        down[at] = d - d.max(1, keepdims=True)
    z = up + down
    p = np.exp(z - z.max(1, keepdims=True))
    p = p[:, CONTENT] / p.sum(1)
    return [p[a:b] for a, b in zip(start, start[1:], strict=False)]


def extract(pages: list[str | None], model: Model | None = None, least: float = 0.5) -> list[str]:
    """The main text of each page: blocks whose content marginal is ``least`` or more, in page order, joined by one space."""
    model = model or default_model()
    trees = [parse_html(p or "") for p in pages]
    return [" ".join(text for i, text in t.text.items() if p[i] >= least) for t, p in zip(trees, marginals(trees, model), strict=True)] if trees else []


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text) of each page. Null html is empty; a page without content gives ""; null and repeated ids stay; very long
    pages are read whole, a few at a time; other columns are ignored; an empty table gives no rows."""
    small_batches(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(extract(part.column("html").to_pylist(), model), pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
