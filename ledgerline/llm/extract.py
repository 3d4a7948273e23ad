"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text of one block-level element) with their
tag paths.  A bidirectional LSTM in numpy reads the whole sequence - hashed
path components (tags, class, id and role tokens), hashed words, a few
lengths - and labels every block as main text or not.

The model is fitted where it is used: up to ``SAMPLE_PAGES`` pages of at most
``SAMPLE_CHARS`` characters (the documented bound) give block texts and their
roles by the semantic elements they stand in, and these texts are laid out
anew in many page layouts (named and unnamed containers, sidebars, notices,
adverts, forms, reader comments, inside and outside the article) for training.

Defined cases: a null or empty page has empty text; unclosed tags end with
their parent; character references are decoded; white space (Unicode) inside
a block becomes one space; repeated rows repeat; extra columns pass through,
own columns are under ``_main``.
"""

from __future__ import annotations

import re
import uuid
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PAGES, SAMPLE_CHARS = 200, 65_536
TRAIN_PAGES, EPOCHS, HIDDEN = 1600, 4, 16
PATH_SLOTS, PATH_DIM, WORD_SLOTS, WORD_DIM, SCALARS = 4096, 16, 512, 8, 4

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(svg|select|button|object|canvas)\b[^>]*>.*?</\2\s*>"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^>]*)>", re.S | re.I)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# fixed values: block-level elements of HTML
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends these open elements, up to the nearest of the holders
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"datalist"}),
        "body": ({"head"}, {"html"})}


def leaves(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of every block with text."""
    out, stack, buf, linked = [], [], [], [0, 0]  # linked: open links, characters in them
    path: tuple[str, ...] = ()

    def flush():
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((path, text, linked[1]))
        linked[1] = 0

    def put(raw: str):
        if raw:
            buf.append(raw)
            if linked[0]:
                linked[1] += len(raw)

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            put(html[at:m.start()])
        at = m.end()
        tag = m.group(4) or m.group(7)
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(m.group(3) or m.group(6))
        if tag == "a":
            linked[0] = 0 if closing else 1
        if tag == "br":
            buf.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ENDS:
                ended, holders = ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in holders:
                        break
                    if stack[k][0] in ended:
                        del stack[k:]
                        break
            if tag not in VOID:
                attrs = m.group(5) or m.group(8) or ""
                names = " ".join(a or b or c for _, a, b, c in NAMES.findall(attrs)) if "=" in attrs else ""
                stack.append((tag, f"{tag} {names}" if names else tag))
        linked[0] = 0
        path = tuple(s[1] for s in stack)
    put(html[at:])
    flush()
    return [x for x in out if "head" not in x[0]]


def path_slots(path: tuple[str, ...]) -> list[int]:
    """Hashed components of a path; the last component counts for itself too."""
    found = set()
    for depth, part in enumerate(path):
        tag, _, names = part.partition(" ")
        found.add("t:" + tag)
        if depth == len(path) - 1:
            found.add("leaf:" + tag)
        for token in TOKENS.findall(names):
            token = token.lower()
            found.add("n:" + token)
            found.add("p:" + token[:4])
    return sorted(crc32(f.encode()) % PATH_SLOTS for f in found)


class Encoder:
    """Blocks of pages as hashed slots and scalars."""

    def __init__(self):
        self.paths: dict = {}
        self.words: dict = {}

    def __call__(self, pages: list[list[tuple]]):
        blocks = [b for page in pages for b in page]
        if len(self.paths) > 50_000:
            self.paths.clear()
        if len(self.words) > 300_000:
            self.words.clear()
        path_ids, path_n, word_ids, word_n = [], [], [], []
        scalars = np.empty((len(blocks), SCALARS), np.float32)
        index = self.words
        for k, (path, text, link) in enumerate(blocks):
            slots = self.paths.get(path)
            if slots is None:
                slots = self.paths[path] = path_slots(path)
            path_ids.extend(slots)
            path_n.append(len(slots))
            words = text.split()
            for w in set(words).difference(index):
                index[w] = crc32(w.lower().encode()) % WORD_SLOTS
            word_ids.extend([index[w] for w in words])
            word_n.append(len(words))
            scalars[k] = (np.log1p(len(words)) / 4, min(1.0, link / len(text)), text[-1] in ".!?", len(path) / 8)
        return (np.array(path_ids, np.int64), np.array(path_n, np.int64), np.array(word_ids, np.int64),
                np.array(word_n, np.int64), scalars, np.array([len(p) for p in pages], np.int64))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(table, ids, counts):
    edges = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(table[ids], edges, axis=0) if len(ids) else np.zeros((len(counts), table.shape[1]), table.dtype)


class Labeller:
    """Embeddings, one LSTM per direction, logistic output (with a skip from the input)."""

    def __init__(self, weights: dict | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + SCALARS, HIDDEN
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = weights or {
            "path": rng.standard_normal((PATH_SLOTS, PATH_DIM)).astype(np.float32) * 0.3,
            "word": rng.standard_normal((WORD_SLOTS, WORD_DIM)).astype(np.float32) * 0.3,
            "fx": init(d, 4 * h), "fh": init(h, 4 * h), "fb": np.zeros(4 * h, np.float32),
            "bx": init(d, 4 * h), "bh": init(h, 4 * h), "bb": np.zeros(4 * h, np.float32),
            "out": init(2 * h + d, 1)[:, 0], "bias": np.zeros(1, np.float32)}

    def _lstm(self, x, wh, xw, mask):
        """Hidden states (time, page, unit) and what the gradient needs."""
        steps, n = mask.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, keep = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = xw[t] + h @ wh
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN:2 * HIDDEN] + 1), _sigmoid(z[:, 2 * HIDDEN:3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            keep.append((h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            hs[t] = h
        return hs, keep

    def _lstm_back(self, dhs, keep, wh):
        steps, n, _ = dhs.shape
        dz_all = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(wh)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = keep[t]
            dh = dh + dhs[t]
            live = np.where(m, dh, 0)
            dct = np.where(m, dc + live * o * (1 - tc * tc), 0)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o),
                                 dct * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh = np.where(m, dz @ wh.T, dh)
            dc = np.where(m, dct * f, dc)
        return dz_all, dwh

    def forward(self, enc):
        path_ids, path_n, word_ids, word_n, scalars, sizes = enc
        w = self.w
        x = np.concatenate([_sums(w["path"], path_ids, path_n),
                            _sums(w["word"], word_ids, word_n) / np.maximum(word_n, 1)[:, None].astype(np.float32),
                            scalars], axis=1)
        steps, n = int(sizes.max(initial=0)), len(sizes)
        page = np.repeat(np.arange(n), sizes)
        step = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mirror = np.repeat(sizes, sizes) - 1 - step
        mask = np.arange(steps)[:, None] < sizes[None, :]
        grid = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        grid[step, page] = x @ w["fx"] + w["fb"]
        fwd, keep_f = self._lstm(x, w["fh"], grid, mask)
        grid = np.zeros_like(grid)
        grid[mirror, page] = x @ w["bx"] + w["bb"]
        bwd, keep_b = self._lstm(x, w["bh"], grid, mask)
        feats = np.concatenate([fwd[step, page], bwd[mirror, page], x], axis=1)
        return _sigmoid(feats @ w["out"] + w["bias"][0]), (x, page, step, mirror, keep_f, keep_b, feats, steps, n)

    def gradient(self, enc, labels):
        path_ids, path_n, word_ids, word_n, _, _ = enc
        p, (x, page, step, mirror, keep_f, keep_b, feats, steps, n) = self.forward(enc)
        w, grad = self.w, {}
        dlogit = ((p - labels) / len(labels)).astype(np.float32)
        grad["out"], grad["bias"] = feats.T @ dlogit, dlogit.sum(keepdims=True)
        dfeat = dlogit[:, None] * w["out"][None, :]
        dx = dfeat[:, 2 * HIDDEN:].copy()
        for side, place, keep, cols in (("f", step, keep_f, slice(0, HIDDEN)), ("b", mirror, keep_b, slice(HIDDEN, 2 * HIDDEN))):
            dhs = np.zeros((steps, n, HIDDEN), np.float32)
            dhs[place, page] = dfeat[:, cols]
            dz, grad[side + "h"] = self._lstm_back(dhs, keep, w[side + "h"])
            dz = dz[place, page]
            grad[side + "x"], grad[side + "b"] = x.T @ dz, dz.sum(axis=0)
            dx += dz @ w[side + "x"].T
        for name, ids, counts, part in (("path", path_ids, path_n, dx[:, :PATH_DIM]),
                                        ("word", word_ids, word_n, dx[:, PATH_DIM:PATH_DIM + WORD_DIM]
                                         / np.maximum(word_n, 1)[:, None])):
            grad[name] = np.zeros_like(w[name])
            np.add.at(grad[name], ids, np.repeat(part, counts, axis=0))
        return p, grad

    def fit(self, pages, labels, epochs=EPOCHS, batch=32, rate=0.01, seed=6):
        """Adam on the mean cross-entropy of all blocks of a batch of pages."""
        rng, encode = np.random.default_rng(seed), Encoder()
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                _, grad = self.gradient(encode([pages[k] for k in own]), np.concatenate([labels[k] for k in own]))
                t += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self


# names for the layouts of the training pages: containers of main text and of everything else
MAIN_BOXES = ("article", "main", "div #content", "div .content", "div .post-body", "div .entry-content", "div .article-body",
              "section .story", "div @main", "div .post", "div .text", "section .article", "div .main-column", "div .page-body")
PLAIN_BOXES = ("div", "section", "div .wrapper", "div .container", "div .row", "div .col", "div .inner", "div #page", "div .box")
ASIDE_BOXES = ("aside", "div .sidebar", "div #sidebar", "div .side-column", "div .widget", "section .related", "div .related-posts",
               "div .recommended", "div .most-read", "div .trending", "div .tags", "div .author-bio", "aside .infobox",
               "div .teaser", "div .toc")
NOTICE_BOXES = ("div .cookie-notice", "div #cookie-banner", "div .notice", "div .alert", "div .consent", "div .gdpr", "div .popup",
                "div .modal", "dialog", "div .warning", "div .announcement", "div .subscribe", "div .paywall", "div @alert")
AD_BOXES = ("div .ad", "div .ads", "div .advert", "div .advertisement", "div .sponsored", "div .promo", "div .promotion",
            "div #ad-top", "aside .ad", "section .sponsor", "div .banner", "div .ad-slot", "div .adsbygoogle", "ins .ad")
COMMENT_BOXES = ("section .comments", "div #comments", "div .comment-list", "ol .commentlist", "div .comment", "div .responses",
                 "div .discussion", "div .user-comments", "div .replies", "section #reader-comments", "div .disqus", "div .reviews")
MENU_BOXES = ("nav", "div .menu", "ul .nav", "div #navigation", "div .breadcrumbs", "nav .main-menu", "div .topbar", "div .links",
              "div .pagination", "div .share", "div .social", "div @navigation", "menu", "div .navbar")
HEAD_BOXES = ("header", "div #header", "div .header", "div .masthead", "header .site-header", "div .site-title", "div .logo",
              "div @banner", "div .top")
FOOT_BOXES = ("footer", "div #footer", "div .footer", "div .copyright", "footer .site-footer", "div .bottom", "div .legal",
              "div @contentinfo", "div .credits")
FORM_BOXES = ("form", "form .search", "form #login", "div .newsletter-form", "fieldset", "form .comment-form", "div .contact-form",
              "form .signup")


def _box(spec: str) -> str:
    """Path component of a layout name: tag, then class, id or role tokens."""
    tag, _, name = spec.partition(" ")
    return f"{tag} {name[1:]}" if name else tag


def layouts(texts: dict[str, list[str]], count: int, seed: int = 4):
    """``count`` labelled training pages made of given block texts, as
    (blocks, labels).  ``texts``: main, head, link and other texts."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    pages, labels = [], []
    for _ in range(count):
        blocks, marks = [], []
        wrap = tuple(_box(pick(PLAIN_BOXES)) for _ in range(int(rng.integers(0, 3))))
        root = ("html", "body", *wrap)

        def put(path, kind, mark, linked=False):
            text = pick(texts[kind])
            blocks.append((root + path, text, len(text) if linked else 0))
            marks.append(mark)

        def other(boxes, inside=(), linked=0.2, low=1, high=4):
            box = _box(pick(boxes))
            for _ in range(int(rng.integers(low, high + 1))):
                kind = pick(("other", "main", "head", "link", "other"))
                put((*inside, box, *pick(((), ("p",), ("div",), ("h3",), ("ul", "li"), ("span",), ("div", "p")))), kind, 0, rng.random() < linked)

        def menu(inside=()):
            box = _box(pick(MENU_BOXES))
            for _ in range(int(rng.integers(2, 9))):
                put((*inside, box, *pick((("ul", "li"), ("li",), (), ("div",)))), "link", 0, rng.random() < 0.9)

        def comments(inside=()):
            box = _box(pick(COMMENT_BOXES))
            for _ in range(int(rng.integers(1, 6))):
                put((*inside, box, *pick((("div comment", "p"), ("p",), ("li",), ("li comment", "p"), ("article comment", "p"), ("div",)))),
                    pick(("main", "other")), 0)

        for part in rng.permutation(4):
            if rng.random() < 0.6:
                (lambda: other(HEAD_BOXES, high=2), menu, lambda: other(NOTICE_BOXES, high=2), lambda: other(AD_BOXES, high=2))[part]()
        if rng.random() < 0.25:
            other(ASIDE_BOXES)
        named = rng.random() < 0.85
        inside = (_box(pick(MAIN_BOXES)),) if named else ()
        if named and rng.random() < 0.3:
            inside += (_box(pick(MAIN_BOXES + PLAIN_BOXES)),)
        if rng.random() < 0.8:
            put((*inside, pick(("h1", "h1", "h2"))), "head", 1)
        for _ in range(int(rng.integers(1, 16))):
            kind = rng.random()
            if kind < 0.82:
                put((*inside, "p"), "main", 1, rng.random() < 0.02)
            elif kind < 0.90:
                put((*inside, pick(("h2", "h3", "blockquote", "pre", "figcaption"))), pick(("head", "main")), 1)
            elif kind < 0.95:
                for _ in range(int(rng.integers(1, 4))):
                    put((*inside, pick(("ul", "ol")), "li"), pick(("main", "head", "link")), 1)
            else:
                put((*inside, *pick((("div",), ("table", "tr", "td"), ("section", "p"), ("blockquote", "p"), ()))), "main", 1)
            if rng.random() < 0.06:
                pick((lambda: other(AD_BOXES, inside, high=1), lambda: other(ASIDE_BOXES, inside, high=2),
                      lambda: other(NOTICE_BOXES, inside, high=1), lambda: other(FORM_BOXES, inside, high=2), lambda: menu(inside)))()
        if rng.random() < 0.15:
            comments(inside)
        for part in rng.permutation(5):
            if rng.random() < 0.4:
                (comments, lambda: other(ASIDE_BOXES), lambda: other(FORM_BOXES, high=3), lambda: other(AD_BOXES, high=2), menu)[part]()
        if rng.random() < 0.8:
            other(FOOT_BOXES, high=3)
        pages.append(blocks)
        labels.append(np.array(marks, np.float32))
    return pages, labels


def block_texts(pages: list[str]) -> dict[str, list[str]]:
    """Texts by role, told apart by the semantic elements they stand in."""
    texts: dict[str, list[str]] = {"main": [], "head": [], "link": [], "other": []}
    for html in pages:
        for path, text, link in leaves(html):
            tags = {p.partition(" ")[0] for p in path}
            if link * 2 > len(text):
                kind = "link"
            elif {"article", "main"} & tags and not {"nav", "aside", "form", "footer"} & tags:
                kind = "head" if path[-1][:1] == "h" else "main"
            else:
                kind = "other"
            texts[kind].append(text[:2000] if kind != "main" else text)
    spare = [t for v in texts.values() for t in v] or ["text"]
    return {k: v or spare for k, v in texts.items()}


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict:
    """Weights fitted on a hash sample of at most ``SAMPLE_PAGES`` pages."""
    fitting = pages.where(F.length(html_col) <= SAMPLE_CHARS)
    n = fitting.count()
    place = F.pmod(F.xxhash64(id_col, html_col), F.lit(1 << 30))
    if n > 2 * SAMPLE_PAGES:  # a hash share of about twice the sample, so that few rows are moved
        fitting = fitting.where(place < int((1 << 30) * 2 * SAMPLE_PAGES / n))
    sample = fitting.orderBy(place, id_col).limit(SAMPLE_PAGES).select(html_col).collect()
    return Labeller().fit(*layouts(block_texts([r[0] for r in sample]), TRAIN_PAGES)).w


_LABELLERS: dict = {}
_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()),
                      T.StructField("n_main", T.IntegerType())])


def main_text(pages: DataFrame, weights: dict, html_col: str = "html") -> DataFrame:
    """``pages`` with ``_main``: struct(text, n_blocks, n_main)."""
    shared, key = pages.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex

    def run(html: pa.Array) -> pa.Array:
        if key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(shared.value), Encoder()
        model, encode = _LABELLERS[key]
        blocks = [leaves(h) if h else [] for h in html.to_pylist()]
        # pages of similar length together, so that few padded steps are computed
        order = sorted(range(len(blocks)), key=lambda k: len(blocks[k]))
        out: list = [("", 0, 0)] * len(blocks)
        for at in range(0, len(order), 64):
            own = [k for k in order[at:at + 64] if blocks[k]]
            if not own:
                continue
            p, done = model.forward(encode([blocks[k] for k in own]))[0], 0
            for k in own:
                keep = [b[1] for b, s in zip(blocks[k], p[done:done + len(blocks[k])]) if s > 0.5]
                done += len(blocks[k])
                out[k] = ("\n".join(keep), len(blocks[k]), len(keep))
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                           pa.array([o[2] for o in out], pa.int32())], names=["text", "n_blocks", "n_main"])

    return pages.withColumn("_main", F.arrow_udf(run, _TYPE)(F.col(html_col).cast("string")))
