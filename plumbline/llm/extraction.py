"""Main text of web pages by a linear-chain conditional random field.

A page becomes a sequence of leaf blocks: runs of text between the borders of block
elements. Each block has features of its ancestors (tags, words of class, id and role) and
of its text (length, share of link text, punctuation, marks such as a copyright sign). A
two-label chain (content, other) is trained on labelled pages and decoded by Viterbi;
content blocks in page order, one a line, are the text.

Labelled pages: up to TRAIN_PAGES rows of the table (those with the smallest page_id) whose
markup names its article are labelled by it. Since such pages share one layout, each is also
set into other layouts, drawn from a seeded generator, with its own text as article and
text of other sample pages as menus, notices, sidebars, adverts, forms and reader comments;
the generator knows the label of every block. Held-out accuracy is measured in tests.

Only the sample goes to the driver. Extraction is a narrow map over whole pages.

Defined results: null and empty pages, and pages of which no block is content, have empty
text; cut-off markup is read up to the cut, a cut-off tag is dropped; scripts, styles, titles
and text areas without an end tag reach to the end of the page, other opaque elements without
one are ordinary tags, and formulas are text; text outside any
element is a block; repeated rows get a row each; an empty table gives no rows (the model is
then trained on made-up text).
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C

TRAIN_PAGES = 200
LAYOUTS_PER_PAGE = 3
SEED = 42

#: Labelled sample: most blocks of a page, and of an article that is set into other layouts.
TRAIN_BLOCKS = 80
ARTICLE_BLOCKS = 40

#: Elements that border blocks, elements whose content is not text up to their end tag, those
#: of them that run to the end of the page without one, and void elements (fixed values of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul head button".split()
)
OPAQUE = frozenset("script style title textarea noscript template svg iframe object canvas video audio".split())
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")

#: Words of class, id and role names, by what they say about a block.
CONCEPTS = {
    "content": "article content post entry story main body text page blog prose news read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs links skip",
    "top": "header masthead topbar top banner logo brand hero",
    "bottom": "footer foot bottom copyright legal imprint colophon",
    "side": "sidebar aside side rail widget widgets related recommend recommended more trending popular teaser complementary",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion promoted dfp adslot",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast",
    "form": "form login search contact register input button feedback",
    "social": "share sharing social follow tags tag author byline meta print",
    "comment": "comment comments reply replies discussion disqus respond thread reader readers responses",
}
CONCEPT_OF = {word: concept for concept, words in CONCEPTS.items() for word in words.split()}
TAG_CONCEPTS = {
    "article": "content", "main": "content", "nav": "menu", "menu": "menu", "header": "top", "footer": "bottom",
    "aside": "side", "form": "form", "fieldset": "form", "select": "form", "button": "form", "dialog": "notice",
}


def _concepts(attributes: str) -> tuple[list[str], str | None]:
    found, label = [], None
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-label":
            label = value
            continue
        for part in NAME_PART.findall(value):
            part = part.lower()
            concept = CONCEPT_OF.get(part) or CONCEPT_OF.get(part.rstrip("s"))
            if concept:
                found.append(concept)
    return found, label


NOTHING_AROUND = (frozenset(), frozenset(), frozenset())


class Block:
    """``tag`` is the innermost open block element, ``around`` what all open ones say."""

    __slots__ = ("text", "linked", "tag", "around", "label")

    def __init__(self, text: str, linked: int, tag: str, around: tuple, label: str | None):
        self.text, self.linked, self.tag, self.around, self.label = text, linked, tag, around, label


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order.

    An open element carries what it and those around it say (tags, concepts, the innermost
    concepts, the label), so a block costs the same however deep it lies.
    """
    out: list[Block] = []
    stack: list[tuple] = []  # (tag, (tags, concepts, inner concepts), label)
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # opaque elements that have no end tag any more
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                tag, around, label = stack[-1] if stack else ("none", NOTHING_AROUND, None)
                out.append(Block(text, linked, tag, around, label))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        pieces.append(raw)
        if in_link:
            linked += len(raw)

    while True:
        m = TAG.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in OPAQUE:
            if not closing and not attributes.endswith("/") and name not in endless:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(page)
                else:  # an ordinary tag that nobody closed
                    endless.add(name)
        elif name in BLOCKS:
            close_block()
            if closing:
                while opened[name]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            elif name not in VOID:
                if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "td", "th", "tr", "dd", "dt", "option")):
                    opened[stack.pop()[0]] -= 1
                concepts, label = _concepts(attributes) if attributes else ([], None)
                own = frozenset([*concepts, TAG_CONCEPTS[name]] if name in TAG_CONCEPTS else concepts)
                _, (tags, outer, inner), outer_label = stack[-1] if stack else ("none", NOTHING_AROUND, None)
                stack.append((name, (tags | {name}, outer | own, own or inner), label or outer_label))
                opened[name] += 1
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
    close_block()
    return out


_around_features: dict[tuple, list[str]] = {}


def _of_around(tag: str, around: tuple) -> list[str]:
    found = _around_features.get((tag, around))
    if found is None:
        tags, concepts, inner = around
        found = ["tag=" + tag, *("in=" + t for t in sorted(tags))]
        found += ["concept=" + c for c in sorted(concepts)] + ["inner=" + c for c in sorted(inner)]
        if "content" in concepts:
            found += ["content+" + c for c in sorted(concepts) if c != "content"]
        elif not concepts:
            found.append("no concept")
        if len(_around_features) > 50_000:
            _around_features.clear()
        _around_features[tag, around] = found
    return found


def features(block: Block, first: bool, last: bool) -> list[str]:
    text = block.text
    n = len(text)
    share = block.linked / n
    out = [
        *_of_around(block.tag, block.around),
        "length=%d" % min(10, n.bit_length()),
        "links=%d" % min(4, int(5 * share)),
        "words=%d" % min(5, text.count(" ").bit_length()),
    ]
    if text[-1] in ".!?…\"'”»。":
        out.append("ends a sentence")
    if text.count(",") > 2:
        out.append("commas")
    if "©" in text or "|" in text and n < 120:
        out.append("marks")
    if first:
        out.append("first")
    if last:
        out.append("last")
    return out


class Chain:
    """Weights of the chain: ``node`` per feature (content minus other), ``step`` per label pair."""

    def __init__(self, node: dict[str, float], step: list[list[float]]):
        self.node, self.step = node, step

    def score(self, blocks: list[Block]) -> list[float]:
        weight, n = self.node.get, len(blocks)
        return [sum([weight(f, 0.0) for f in features(b, i == 0, i == n - 1)]) for i, b in enumerate(blocks)]

    def decode(self, blocks: list[Block]) -> list[int]:
        """Best label sequence (Viterbi)."""
        (s00, s01), (s10, s11) = self.step
        a, b = 0.0, None
        back: list[tuple[int, int]] = []
        for score in self.score(blocks):
            if b is None:
                b = score
                continue
            to0 = (a + s00, 0) if a + s00 >= b + s10 else (b + s10, 1)
            to1 = (a + s01, 0) if a + s01 > b + s11 else (b + s11, 1)
            back.append((to0[1], to1[1]))
            a, b = to0[0], to1[0] + score
        if b is None:
            return []
        labels = [1 if b > a else 0]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[list[Block]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by gradient ascent with adaptive steps (Adam)."""
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    longest = max(len(p) for p in pages)
    rows, cols, feats = [], [], []
    gold, mask = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, page in enumerate(pages):
        for t, block in enumerate(page):
            gold[i, t], mask[i, t] = block.label == "1", True
            for f in features(block, t == 0, t == len(page) - 1):
                rows.append(i)
                cols.append(t)
                feats.append(names.setdefault(f, len(names)))
    cell, feats = np.array(rows) * longest + np.array(cols), np.array(feats)
    node, step = np.zeros(len(names)), np.zeros((2, 2))
    size = len(names)
    moments = np.zeros((2, size + 4))
    linked = mask[:, 1:]
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (gold[:, :-1][linked], gold[:, 1:][linked]), 1)
    for turn in range(1, rounds + 1):
        score = np.zeros((len(pages), longest, 2))
        score[..., 1] = np.bincount(cell, node[feats], len(pages) * longest).reshape(len(pages), longest)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            onward = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], onward, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            right = score[:, t + 1] + behind[:, t + 1]
            back = np.logaddexp(step[:, 0] + right[:, 0, None], step[:, 1] + right[:, 1, None])
            behind[:, t] = np.where(mask[:, t + 1, None], back, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        chance = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None])
        pairs = ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.exp(np.where(linked[..., None, None], pairs, -np.inf)).sum(axis=(0, 1))
        gradient = np.concatenate([
            np.bincount(feats, (np.where(mask, gold - chance, 0.0)).ravel()[cell], size), (wanted - expected).ravel(),
        ]) / len(pages)
        gradient -= decay * np.concatenate([node, step.ravel()])
        moments[0] += 0.1 * (gradient - moments[0])
        moments[1] += 0.01 * (gradient**2 - moments[1])
        move = rate * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
        node, step = node + move[:size], step + move[size:].reshape(2, 2)
    return Chain({f: float(node[i]) for f, i in names.items()}, step.tolist())


def label_by_article(page: str) -> list[Block] | None:
    """Blocks of a page that names its article, labelled by it; None for other pages."""
    blocks = leaf_blocks(page)
    inside = ["article" in b.around[0] for b in blocks]
    if not any(inside):
        return None
    for block, content in zip(blocks, inside, strict=True):
        other = block.around[1] - {"content"}
        block.label = "1" if content and not other else "0"
    return blocks


_SYLLABLES = "ka lo mi re tu ven sor dal in pe ra no che las".split()


def _made_up(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def laid_out(article: list[tuple[str, str]], others: list[str], rng: random.Random) -> str:
    """A page with the article in a drawn layout; data-label names each part's label."""
    text = lambda most=40: html.escape(" ".join(rng.choice(others).split()[: rng.randint(2, most)]) if others else _made_up(rng, rng.randint(2, most)))
    pick = rng.choice
    name = lambda *names: pick(["class", "id"]) + f'="{pick(names)}"'
    items = lambda n, most=3: "".join(f'<li><a href="#">{text(most)}</a></li>' for _ in range(n))
    part = lambda label, tag, attributes, inner: f'<{tag} {attributes} data-label="{label}">{inner}</{tag}>'
    other = {
        "menu": lambda: pick([part(0, "nav", "", f"<ul>{items(5)}</ul>"), part(0, "div", name("menu", "navbar", "main-nav", "breadcrumbs"), f"<ul>{items(6)}</ul>"), part(0, "ul", name("nav", "menu"), items(5))]),
        "top": lambda: part(0, pick(["header", "div"]), name("header", "masthead", "top-bar", "site-header"), pick([f"<h2>{text(4)}</h2>", f"<p>{text(8)}</p>", f'<a href="/">{text(3)}</a>'])),
        "side": lambda: part(0, pick(["aside", "div"]), name("sidebar", "right-rail", "related", "widget", "more-stories"), f"<h3>{text(3)}</h3>" + pick([f"<ul>{items(4, 8)}</ul>", f"<p>{text()}</p><p>{text()}</p>"])),
        "advert": lambda: part(0, "div", name("ad", "ads", "advert", "sponsored", "promo-box"), pick([text(20), f"<p>{text(20)}</p>"])),
        "notice": lambda: part(0, pick(["div", "section", "dialog"]), name("cookie-notice", "consent", "newsletter", "popup", "notice"), f"<p>{text(30)}</p><button>{text(2)}</button>"),
        "form": lambda: part(0, "form", name("login", "search-form", "contact"), f"<label>{text(3)}</label><input><p>{text(12)}</p><button>{text(2)}</button>"),
        "social": lambda: part(0, "div", name("share", "social", "tags", "byline"), f"<span>{text(4)}</span>"),
        "comment": lambda: part(0, pick(["section", "div", "ol", "article"]), name("comments", "comment-list", "discussion", "responses"), "".join(pick([f'<div class="comment"><p>{text(60)}</p></div>', f'<article class="comment"><p>{text(60)}</p></article>', f"<p>{text(60)}</p>"]) for _ in range(rng.randint(1, 4)))),
        "bottom": lambda: part(0, pick(["footer", "div"]), name("footer", "site-footer", "bottom", "copyright"), pick([f"&copy; {text(8)}", f"<p>{text(12)}</p>", f"<ul>{items(3)}</ul>"])),
    }
    body = [f"<{tag}>{html.escape(t)}</{tag}>" for tag, t in article]
    for extra in rng.sample(["advert", "social", "side", "notice"], rng.randint(0, 2)):
        body.insert(rng.randint(1, len(body)), other[extra]())
    tag, attributes = pick([("article", ""), ("article", 'class="post"'), ("main", ""), ("div", name("content", "post-content", "entry", "story-body", "article-text", "main")), ("section", name("content", "article")), ("div", 'role="main"'), ("div", ""), ("td", "")])
    article_part = part(1, tag, attributes, "".join(body))
    wrap = pick(["{}", "<main>{}</main>", '<div class="container"><div class="row">{}</div></div>', '<div id="page">{}</div>'])
    before = [other[k]() for k in ("notice", "top", "menu", "advert", "form") if rng.random() < 0.5]
    after = [other[k]() for k in ("social", "advert", "comment", "form", "side", "notice") if rng.random() < 0.4]
    if rng.random() < 0.9:
        after.append(other["bottom"]())
    return f"<html><head><title>{text(6)}</title></head><body>{''.join(before)}{wrap.format(article_part + ''.join(after[:-1]))}{''.join(after[-1:])}</body></html>"


def labelled_pages(sample: list[str], layouts: int = LAYOUTS_PER_PAGE, seed: int = SEED) -> list[list[Block]]:
    """Labelled block sequences: the sample's own, and its articles in drawn layouts.

    Of a page the first TRAIN_BLOCKS blocks, of an article the first ARTICLE_BLOCKS are
    learned from; extraction reads whole pages.
    """
    rng = random.Random(seed)
    own = [b for b in map(label_by_article, sample) if b]
    articles = [[(b.tag if b.tag in ("p", "h1", "h2", "li") else "p", b.text) for b in page if b.label == "1"][:ARTICLE_BLOCKS] for page in own]
    while len(articles) < 40:
        articles.append([("h1", _made_up(rng, 6))] + [("p", _made_up(rng, rng.randint(5, 80))) for _ in range(rng.randint(1, 8))])
    others = [b.text for page in own for b in page] or [_made_up(rng, 40) for _ in range(100)]
    laid = [leaf_blocks(laid_out(a, others, rng)) for a in articles if a for _ in range(layouts)]
    return [page[:TRAIN_BLOCKS] for page in own + laid]


def fit(pages: DataFrame, key: str = "page_id", markup: str = "html", most: int = TRAIN_PAGES) -> Chain:
    """A chain trained on at most ``most`` labelled rows, those with the smallest keys."""
    ids = pages.where(F.col(key).isNotNull()).select(key).orderBy(key).limit(most).agg(F.max(key)).first()[0]
    rows = [] if ids is None else pages.where(F.col(key) <= ids).select(key, markup).orderBy(key).limit(most).collect()
    return train(labelled_pages([r[1] for r in rows if r[1]]))


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page or "", chain) for page in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html")]
    return C.map_batches(pages, columns, "html", "page_id long, url string, text string, n_chars long", work)


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
