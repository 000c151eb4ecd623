"""Main text of web pages, by a recurrent labeller of text blocks.

A page becomes the sequence of its text blocks, each with the path of tags
above it and its words.  A bidirectional LSTM in numpy reads the whole
sequence and labels every block as main text or furniture.  It is trained on a
bounded sample of the pages themselves: plain rules about tags and class names
label the sample, and pieces of furniture of all usual kinds are mixed in, so
that the network also knows what the sample happens to lack.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pactframe.llm.common import extended, map_batches, raw, without

SAMPLE_PAGES = 128  # pages the network is trained on
STEPS = 300
SAMPLE_BYTES = 100_000  # longer pages are not used for training
PATH_KINDS, WORD_KINDS = 1024, 512
PATH_DIM, WORD_DIM, SCALARS, HIDDEN = 16, 8, 6, 16
CELLS = 1 << 14  # blocks of a batch of pages, with padding; a longer page is a batch of its own

# ------------------------------------------------------------------ blocks

# Element kinds of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
UNSEEN = frozenset("script style noscript template svg iframe object canvas".split())
TO_THE_END = frozenset("script style template".split())  # where the closing tag lacks
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>"
    rf"|<({'|'.join(sorted(UNSEEN))})(?=[\s/>])|<[!?][^>]*>", re.S | re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNSEEN}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")


@dataclass
class Piece:
    """A text block: its path as (tag, name parts) pairs, its text, and the share of it inside links."""

    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: float


def name_parts(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    return tuple(PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found).lower()))


def blocks(page: str) -> list[Piece]:
    """The text blocks of a page in order, with white space made single and references decoded."""
    out: list[Piece] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = 0
    inside = 0

    def end_block() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                path = tuple(s for s in stack if s[0] not in INLINE or s[1])
                out.append(Piece(path, joined, min(1.0, links / max(1, len(joined)))))
        text.clear()
        links = 0

    at = 0
    unclosed: set[str] = set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            links += (m.start() - at) * (inside > 0)
        at = m.end()
        tag = (m.group(2) or m.group(4) or "").lower()
        if tag in UNSEEN and not m.group(1):
            # a closed element goes whole, a self-closed or unclosed one by its tag
            if not (m.group(3) or "").endswith("/"):
                end = None if tag in unclosed else CLOSING[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if not tag:
            continue
        if tag not in INLINE:
            end_block()
        if m.group(1):
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    inside -= sum(s[0] == "a" for s in stack[n:])
                    del stack[n:]
                    break
        elif tag not in VOID:
            if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                shut = "p" if tag in CLOSES_P else tag
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == shut:
                        inside -= sum(s[0] == "a" for s in stack[n:])
                        del stack[n:]
                        break
                    if stack[n][0] not in INLINE:
                        break
            if not m.group(3).endswith("/"):
                stack.append((tag, name_parts(m.group(3))))
                inside += tag == "a"
    if at < len(page):
        text.append(page[at:])
    end_block()
    return out


# ---------------------------------------------------------------- features


def bucket(token: str, kinds: int) -> int:
    return zlib.crc32(token.encode()) % kinds


class Reader:
    """Turns blocks into numbers; remembers the hashes of tokens it has seen."""

    def __init__(self):
        self.paths: dict = {}
        self.words: dict[str, int] = {}

    def path_ids(self, path) -> np.ndarray:
        """Tags, name parts, and the last elements by their place."""
        ids = self.paths.get(path)
        if ids is None:
            tokens = {t for t, _ in path} | {f".{p}" for _, parts in path for p in parts}
            tokens |= {f"{n}:{t}" for n, (t, _) in enumerate(path[:-3:-1])}
            ids = np.array(sorted(bucket(t, PATH_KINDS) for t in tokens) or [bucket("", PATH_KINDS)])
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = ids
        return ids

    def word_ids(self, text: str) -> list[int]:
        words = text.lower().split()
        if len(self.words) > 200_000:
            self.words.clear()
        known = self.words
        out = []
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = bucket(w, WORD_KINDS)
            out.append(n)
        return out

    def sequence(self, pieces: list[Piece]):
        paths = [self.path_ids(p.path) for p in pieces]
        words = [self.word_ids(p.text) for p in pieces]
        scalars = np.array([
            (np.log1p(len(p.text)) / 6, p.linked, np.log1p(len(w)) / 4, n / len(pieces), 1 - n / len(pieces), sum(map(p.text.count, ".!?")) / (len(w) + 1))
            for n, (p, w) in enumerate(zip(pieces, words))])
        return paths, words, scalars


def bags(rows: list, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, id and weight of every token, for means over bags."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    owner = np.repeat(np.arange(len(rows)), sizes)
    ids = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
    return owner, ids, 1.0 / np.maximum(sizes[owner], 1)


def bag_means(rows: list, table: np.ndarray) -> np.ndarray:
    owner, ids, weight = bags(rows, len(table))
    out = np.zeros((len(rows), table.shape[1]))
    if len(ids):
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[firsts]] = np.add.reduceat(table[ids] * weight[:, None], firsts, axis=0)
    return out


# ----------------------------------------------------------------- network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = PATH_DIM + WORD_DIM + SCALARS
    net = {"path": rng.normal(0, 0.5, (PATH_KINDS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_KINDS, WORD_DIM))}
    for d in "fb":
        net[f"x{d}"] = rng.normal(0, 1 / np.sqrt(wide), (wide, 4 * HIDDEN))
        net[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        net[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    net["out"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN + wide), 2 * HIDDEN + wide)
    net["bias"] = np.zeros(1)
    return net


AHEAD = 256  # steps whose inputs are made ready at once


def lstm(x: np.ndarray, mask: np.ndarray, wx, wh, bias, keep: bool):
    """States over time of a batch (time, batch, dim); where the mask is 0 the state stays."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    out = np.empty((steps, batch, HIDDEN))
    tape = []
    for t in range(steps):
        if t % AHEAD == 0:
            inputs = x[t : t + AHEAD] @ wx + bias
        z = inputs[t % AHEAD] + h @ wh
        i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
    return out, tape


def lstm_back(x, tape, d_out, wx, wh):
    steps = len(tape)
    d_wx, d_wh, d_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
    d_x = np.empty_like(x)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + d_out[t]
        live = m * dh
        d_new = m * dc + live * o * (1 - tc * tc)
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), live * tc * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
        d_wx += x[t].T @ dz
        d_wh += h.T @ dz
        d_b += dz.sum(0)
        d_x[t] = dz @ wx.T
        dh = (1 - m) * dh + dz @ wh.T
        dc = (1 - m) * dc + d_new * f
    return d_x, d_wx, d_wh, d_b


def lay_out(sequences: list):
    """Sequences as (time, batch) places of their blocks, padded."""
    sizes = np.array([len(s[2]) for s in sequences])
    steps = int(sizes.max())
    mask = (np.arange(steps)[:, None] < sizes[None, :]).astype(float)
    place = np.zeros((steps, len(sizes)), np.int64)
    ends = np.cumsum(sizes)
    for n, (a, b) in enumerate(zip(ends - sizes, ends)):
        place[: b - a, n] = np.arange(a, b)
    paths = [p for s in sequences for p in s[0]]
    words = [w for s in sequences for w in s[1]]
    return paths, words, np.concatenate([s[2] for s in sequences]), place, mask


def forward(net, sequences: list, keep: bool = False):
    paths, words, scalars, place, mask = lay_out(sequences)
    flat = np.concatenate([bag_means(paths, net["path"]), bag_means(words, net["word"]), scalars], axis=1)
    x = flat[place] * mask[:, :, None]
    ahead, tape_f = lstm(x, mask, net["xf"], net["hf"], net["cf"], keep)
    back, tape_b = lstm(x[::-1], mask[::-1], net["xb"], net["hb"], net["cb"], keep)
    weight = net["out"]
    score = sigmoid(ahead @ weight[:HIDDEN] + back[::-1] @ weight[HIDDEN : 2 * HIDDEN] + x @ weight[2 * HIDDEN :] + net["bias"])
    features = np.concatenate([ahead, back[::-1], x], axis=2) if keep else None
    return score, (paths, words, place, mask, x, tape_f, tape_b, features)


def gradients(net, sequences: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
    score, (paths, words, place, mask, x, tape_f, tape_b, features) = forward(net, sequences, keep=True)
    wanted = np.concatenate(labels)[place]
    d = (score - wanted) * mask / mask.sum()
    grad = {"out": (features * d[:, :, None]).sum((0, 1)), "bias": np.array([d.sum()])}
    d_features = d[:, :, None] * net["out"]
    d_x = d_features[:, :, 2 * HIDDEN :].copy()
    dx, grad["xf"], grad["hf"], grad["cf"] = lstm_back(x, tape_f, d_features[:, :, :HIDDEN], net["xf"], net["hf"])
    d_x += dx
    dx, grad["xb"], grad["hb"], grad["cb"] = lstm_back(x[::-1], tape_b, d_features[::-1, :, HIDDEN : 2 * HIDDEN], net["xb"], net["hb"])
    d_x += dx[::-1]
    flat = np.zeros((len(paths), d_x.shape[2]))
    flat[place[mask > 0]] = d_x[mask > 0]
    for name, rows, part in (("path", paths, flat[:, :PATH_DIM]), ("word", words, flat[:, PATH_DIM : PATH_DIM + WORD_DIM])):
        owner, ids, weight = bags(rows, len(net[name]))
        grad[name] = np.zeros_like(net[name])
        np.add.at(grad[name], ids, part[owner] * weight[:, None])
    return grad


def train(examples: list[tuple], steps: int, seed: int = 5, batch: int = 24, rate: float = 0.02) -> dict[str, np.ndarray]:
    """About ``steps`` steps of Adam over batches of pages of like length; ``examples`` are (sequence, labels)."""
    net = fresh(seed)
    rng = np.random.default_rng(seed)
    mean, square, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    order = sorted(range(len(examples)), key=lambda n: len(examples[n][1]))
    groups = [order[n : n + batch] for n in range(0, len(order), batch)]
    rounds = max(1, steps // len(groups))
    for turn in range(rounds):
        for g in rng.permutation(len(groups)):
            members = [examples[n] for n in groups[g]]
            grad = gradients(net, [m[0] for m in members], [m[1] for m in members])
            step += 1
            for k, v in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                net[k] -= rate * (0.2 if k == "word" else 1) * (1 - 0.8 * turn / rounds) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
    return net


# ---------------------------------------------------------------- training

# Names of page furniture, as they occur in tags and class names.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog head title button select textarea".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion teaser outbrain taboola "
    "cookie cookies consent gdpr notice notices alert alerts warning announcement popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toc header masthead topbar toolbar footer colophon copyright legal "
    "sidebar aside widget widgets related recommended recommendations share sharing social follow newsletter subscribe signup login search "
    "comment comments commentlist respond reply replies disqus discussion form".split())


def rule_label(path) -> int:
    """Main text unless some element above is furniture by its tag or a part of its name."""
    return int(not any(tag in FURNITURE_TAGS or FURNITURE_NAMES.intersection(parts) for tag, parts in path))


def furniture_pieces(rng, words: np.ndarray) -> list[Piece]:
    """A made-up piece of furniture: some blocks under a usual tag or name."""
    tags, names = sorted(FURNITURE_TAGS), sorted(FURNITURE_NAMES)
    if rng.random() < 0.4:
        top = (str(rng.choice(tags)), ())
    else:
        extra = (str(rng.choice(["box", "wrap", "block", "list", "area", "inner"])),) if rng.random() < 0.5 else ()
        top = (str(rng.choice(["div", "section", "ul", "p", "aside", "span"])), (str(rng.choice(names)), *extra))
    inner = [(), (("p", ()),), (("ul", ()), ("li", ())), (("div", ()),), (("h2", ()),), (("h3", ()),), (("li", ()),)][rng.integers(7)]
    linked = float(rng.random() < 0.4)
    most = 6 if rng.random() < 0.6 else 120
    return [Piece((top, *inner), " ".join(words[rng.integers(0, len(words), rng.integers(1, most))]), linked) for _ in range(rng.integers(1, 5))]


def examples_of(pages: list[str], seed: int = 5) -> list[tuple]:
    """Sequences with labels: every page as it is, and three times with furniture and other wrappers mixed in.

    Main blocks often get a few words drawn from all pages there, and furniture
    is often long, so that neither length nor wording alone decides.
    """
    rng = np.random.default_rng(seed)
    reader, out = Reader(), []
    pool = [p for p in map(blocks, pages) if p]
    words = np.array(sorted({w for p in pool for b in p for w in b.text.split()[:20]})[:20_000] or ["a"], dtype=object)
    wrappers = [(("body", ()), ("main", ())), (("body", ()), ("div", ("content",))), (("body", ()), ("article", ())), (("body", ()), ("div", ("post", "body"))),
                (("body", ()), ("section", ())), (("body", ()), ("div", ("entry", "content"))), (("body", ()),), (("body", ()), ("div", ()))]
    inner = [(("p", ()),), (("p", ()),), (("p", ()),), (("h1", ()),), (("h2", ()),), (("h3", ()),), (("ul", ()), ("li", ())), (("ol", ()), ("li", ())),
             (("blockquote", ()),), (("blockquote", ()), ("p", ())), (("pre", ()),), (("table", ()), ("tr", ()), ("td", ())), (("div", ()),), (),
             (("figure", ()), ("figcaption", ())), (("dl", ()), ("dd", ()))]
    for page in pool:
        out.append((reader.sequence(page), np.array([float(rule_label(p.path)) for p in page])))
        for _ in range(3):
            wrapper = wrappers[rng.integers(len(wrappers))]
            mixed: list[Piece] = []
            for _ in range(rng.integers(1, 4)):
                mixed += [Piece((("html", ()), ("body", ()), *p.path), p.text, p.linked) for p in furniture_pieces(rng, words)]
            article = [p for p in page if rule_label(p.path)]
            own = rng.random() < 0.4
            for p in article[: rng.integers(4, 40)]:
                path = p.path if own else (("html", ()), *wrapper, *inner[rng.integers(len(inner))])
                kind = rng.random()
                cut = p.text if kind < 0.3 else " ".join(words[rng.integers(0, len(words), rng.integers(1, 6 if kind < 0.6 else 120))])
                mixed.append(Piece(path, cut, float(rng.random() < 0.1)))
                if rng.random() < 0.3:
                    above = p.path[:-1] if own else (("html", ()), *wrapper)
                    mixed += [Piece((*above, *q.path), q.text, q.linked) for q in furniture_pieces(rng, words)]
            for _ in range(rng.integers(1, 4)):
                mixed += [Piece((("html", ()), ("body", ()), *p.path), p.text, p.linked) for p in furniture_pieces(rng, words)]
            out.append((reader.sequence(mixed), np.array([float(rule_label(p.path)) for p in mixed])))
    return out


def fit(pages: DataFrame, page: str = "html", sample: int = SAMPLE_PAGES, steps: int = STEPS) -> dict[str, np.ndarray]:
    """A network from at most ``sample`` pages of at most SAMPLE_BYTES, chosen by the hash of their content."""
    rows = pages.select(raw(page).alias("raw")).where(F.octet_length("raw").between(1, SAMPLE_BYTES))
    place = F.xxhash64("raw") / F.lit(2.0**64) + 0.5
    # twice the wanted share by hash, so that no task sends more than a share of the sample
    part = 2 * sample / max(pages.count(), 1)
    chosen = rows.withColumn("place", place).where(F.col("place") < part).dropDuplicates(["place"]).orderBy("place").limit(sample).collect()
    examples = examples_of([r.raw.decode("utf-8", "replace") for r in chosen]) or examples_of(["<p>a</p>"])
    return train(examples, steps)


# -------------------------------------------------------------- extraction


def main_texts(net, reader: Reader, pages: list[str], cells: int = CELLS) -> list[str]:
    """The main text of each page; pages of like length share a batch of about ``cells`` blocks."""
    pieces = list(map(blocks, pages))
    out = [""] * len(pages)
    order = sorted((n for n, p in enumerate(pieces) if p), key=lambda n: len(pieces[n]))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and end - start < 64 and len(pieces[order[end]]) * (end + 1 - start) <= cells:
            end += 1
        members = order[start:end]
        score, _ = forward(net, [reader.sequence(pieces[n]) for n in members])
        for column, n in enumerate(members):
            out[n] = " ".join(p.text for p, s in zip(pieces[n], score[:, column]) if s >= 0.5)
        start = end
    return out


def extract(pages: DataFrame, page: str = "html", net: dict[str, np.ndarray] | None = None, keep_page: bool = True) -> DataFrame:
    """The rows with ``text``, the main text of the page, and its length ``n_chars`` in code points.

    Blocks are joined in page order by one space.  A null or empty page has an
    empty text; same-named input columns are replaced.  The network is fitted
    on the given pages unless it is passed in.  No shuffle.
    """
    net = fit(pages, page) if net is None else net
    rows = pages.withColumn("__raw", raw(page))
    kept = without(rows, "__raw", "text", "n_chars", *([] if keep_page else [page]))
    fields = kept.schema.names

    def start():
        reader = Reader()

        def step(batch):
            texts = main_texts(net, reader, [p.decode("utf-8", "replace") for p in batch.column("__raw").to_pylist()])
            columns = [*(batch.column(c) for c in fields), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*fields, "text", "n_chars"])

        return step

    return map_batches(rows.select("__raw", *[f"`{c}`" for c in fields]), start, extended(kept, text="string", n_chars="long"))
