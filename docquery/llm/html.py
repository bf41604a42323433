"""HTML extraction by wrapper induction.

The pages of a host are aligned with pages of it, its references, by simple tree matching: roots of one tag match, and the
children of matched nodes are aligned in order so that as many nodes as possible match. A text slot of a reference whose
commonest text fills at least ``CONSTANT`` of the pages that have the slot (two at least) is template; the other slots, and
text that nothing in the reference matches, are content.

A host's layouts are its pages' skeletons: the tags of the tree, where neighbours of one skeleton count once. Each of them has
a page as its reference, however many there are; a page goes to the reference whose paths of tags are most like its own. Its
own skeleton's has the very same paths, so that is the first reference with these paths, in order of the skeletons' pages: a
join on host and paths finds it, and no list of a host's references is ever made. A stray page can't become the only
reference of a host of many like pages.

Pages are moved to their references as packed trees, without attributes, scripts and comments, which play no part.

Subtrees of one shape share a signature, and matches of signatures are kept, so pages of one layout are aligned once. Pages
are aligned in one pass, which writes each page's texts with their slots; template slots follow from counts of these.

Defined results: a null or empty html has no nodes and empty content; null and malformed urls share a host of their own,
null; a host's only page is all content; pages of any length and depth are read whole; repeated rows each give a row (and each
vote); an empty table gives no rows; other columns are ignored, whatever their names. Skeletons of equal number go by hash, a
skeleton's page is that of the smallest (hash of html, page_id), pages alike to several references go to the first; of several
best alignments the one that halving the left list finds is taken. A tag that isn't closed by ``>`` is text. Once a quote
in a tag has no end in the page, quotes no longer protect ``>`` in the rest of it.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import materialise

CONSTANT = 0.8
LAYOUTS = None  # no bound on a host's references
NAME = re.compile(r"[A-Za-z][\w:-]*")
MARK = re.compile(r"[\"'>]")
RAW = {t: re.compile(rf"</{t}(?![\w:-])", re.I) for t in ("script", "style", "noscript", "template", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, closed at once) in order: ``text``, ``open`` and ``close`` with a tag. Each character is looked at a bounded number of times."""
    at, text_from, n = 0, 0, len(page)
    last_end, quotes = page.rfind(">"), True

    def closing(i: int) -> int:
        """Where the tag that is open at ``i`` ends: after ``>``."""
        nonlocal quotes
        k = i
        while quotes:
            m = MARK.search(page, k)
            if m is None:
                quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                k = page.find(m[0], m.end()) + 1
                quotes = k > 0
        return page.find(">", i) + 1

    while at < n:
        at = page.find("<", at)
        if at < 0 or at > last_end:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end, tag = (n if end < 0 else end + 3), None
        elif page.startswith(("<!", "<?"), at):
            end, tag = page.find(">", at) + 1, None
        else:
            close = page.startswith("/", at + 1)
            m = NAME.match(page, at + 1 + close)
            if m is None:
                at += 1
                continue
            end, tag = closing(m.end()), m[0].lower()
            if not end:
                break
        if at > text_from:
            yield "text", page[text_from:at], False
        if tag in RAW and not close:
            m = RAW[tag].search(page, end)
            end = n if m is None else page.find(">", m.end()) + 1 or n
        elif tag:
            yield ("close" if close else "open"), tag, page[end - 2] == "/"
        at = text_from = end
    if text_from < n:
        yield "text", page[text_from:], False


class Shapes:
    """Signatures of subtrees, and how well any two of them match."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.shapes: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.skeletons: list[int] = []
        self.steps: dict[tuple[int, str], int] = {}  # hashes of paths by the path before and the tag
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, tag: str, children: tuple[int, ...]) -> int:
        found = self.ids.get((tag, children))
        if found is None:
            found = self.ids[tag, children] = len(self.shapes)
            self.shapes.append((tag, children))
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
            below = [self.skeletons[c] for c in children]
            once = [x for k, x in enumerate(below) if not k or x != below[k - 1]]
            self.skeletons.append(_h(f"{tag} {once}"))
        return found

    def score(self, a: int, b: int) -> int:
        """Nodes that match if the roots of both do; 0 if the roots' tags differ. What it rests on is scored first, from the leaves up."""
        found = self._known(a, b)
        if found is not None:
            return found
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.scores:
                todo.pop()
                continue
            left, right = self.shapes[x][1], self.shapes[y][1]
            i, j = _ends(left, right)
            inner = {(p, q) for p in set(left[i : len(left) - j]) for q in set(right[i : len(right) - j]) if self._known(p, q) is None}
            if inner:
                todo += inner
            else:
                self.scores[x, y] = 1 + self._total(left, right)
                todo.pop()
        return self.scores[a, b]

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        return 0 if self.shapes[a][0] != self.shapes[b][0] else self.scores.get((a, b))

    def _total(self, left: tuple[int, ...], right: tuple[int, ...]) -> int:
        i, j = _ends(left, right)
        same = sum(self.sizes[x] for x in (*left[:i], *left[len(left) - j :]))
        left, right = left[i : len(left) - j], right[i : len(right) - j]
        return same + (int(self._row(left, right)[-1]) if left and right else 0)

    def _matrix(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ul, il = np.unique(np.array(left), return_inverse=True)
        ur, ir = np.unique(np.array(right), return_inverse=True)
        return np.array([[self.score(int(x), int(y)) for y in ur] for x in ul], dtype=np.int64), il, ir

    def _row(self, left: tuple[int, ...], right: tuple[int, ...]) -> np.ndarray:
        """The best totals of all of ``left`` against each prefix of ``right``."""
        if len(left) * len(right) <= 64:
            row = [0] * (len(right) + 1)
            for x in left:
                before = 0
                for k, y in enumerate(right, 1):
                    up = row[k]
                    row[k] = max(up, row[k - 1], before + self.score(x, y))
                    before = up
            return np.array(row)
        w, il, ir = self._matrix(left, right)
        row = np.zeros(len(right) + 1, dtype=np.int64)
        for x in il:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w[x][ir]))
        return row

    def align(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """Index pairs of a best alignment of two lists of signatures."""
        i, j = _ends(left, right)
        n, m = len(left), len(right)
        return [(k, k) for k in range(i)] + [(i + a, i + b) for a, b in self._middle(left[i : n - j], right[i : m - j])] + [(n - k, m - k) for k in range(j, 0, -1)]

    def _middle(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """By halves, so that memory stays linear in the lists."""
        out, todo = [], [(0, len(left), 0, len(right))]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            if b - a == 1:
                scores = [self.score(left[a], right[k]) for k in range(c, d)]
                best = max(scores)
                if best:
                    out.append((a, c + scores.index(best)))
                continue
            half = (a + b) // 2
            down, up = self._row(left[a:half], right[c:d]), self._row(left[half:b][::-1], right[c:d][::-1])[::-1]
            cut = c + int(np.argmax(down + up))
            todo += [(a, half, c, cut), (half, b, cut, d)]
        return sorted(out)


def _ends(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, int]:
    """How many equal signatures both lists begin and end with; matching those is part of some best alignment."""
    most, i, j = min(len(left), len(right)), 0, 0
    while i < most and left[i] == right[i]:
        i += 1
    while j < most - i and left[-1 - j] == right[-1 - j]:
        j += 1
    return i, j


class Tree:
    """Nodes in order of the page: tags (``#text`` for text), children, texts and signatures. Node 0 is the root."""

    def __init__(self, page: str, shapes: Shapes):
        self.tags, self.children, self.texts = ["#root"], [[]], [""]
        open_at, self.count = [0], Counter()
        for kind, value, single in tokens(page):
            if kind == "text":
                self._text(value, open_at[-1])
            elif kind == "close":
                if self.count[value]:
                    k = next(k for k in range(len(open_at) - 1, 0, -1) if self.tags[open_at[k]] == value)
                    self._drop(open_at, k)
            else:
                if value in BLOCK:
                    self._close(open_at, "p", BLOCK - {"p"})
                if value in CLOSES:
                    self._close(open_at, *CLOSES[value])
                node = self._add(value, "", open_at[-1])
                if value not in VOID and not single:
                    open_at.append(node)
                    self.count[value] += 1
        self._signed(shapes)

    def _signed(self, shapes: Shapes) -> None:
        self.shape = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):  # children come after their parents
            self.shape[i] = shapes.of(self.tags[i], tuple([self.shape[c] for c in self.children[i]]))
        self.shapes = shapes

    @property
    def skeleton(self) -> list[int]:
        return [self.shapes.skeletons[x] for x in self.shape]

    def packed(self) -> bytes:
        """Tags, numbers of children and texts: what alignment needs."""
        return zlib.compress(json.dumps([self.tags, [len(c) for c in self.children], [t for t in self.texts if t]]).encode(), 1)

    @classmethod
    def unpacked(cls, data: bytes, shapes: Shapes) -> Tree:
        """The tree that was packed, without skeletons."""
        self = cls.__new__(cls)
        self.tags, numbers, texts = json.loads(zlib.decompress(data))
        self.children, given = [[] for _ in self.tags], iter(texts)
        self.texts = [next(given) if tag == "#text" else "" for tag in self.tags]
        open_at: list[int] = []
        for i, n in enumerate(numbers):  # nodes are in order of the page, so a node's parent is the last that lacks a child
            while open_at and len(self.children[open_at[-1]]) == numbers[open_at[-1]]:
                open_at.pop()
            if open_at:
                self.children[open_at[-1]].append(i)
            if n:
                open_at.append(i)
        self._signed(shapes)
        return self

    def paths(self) -> frozenset[int]:
        """The paths of tags from the root, hashed."""
        at, steps = [0] * len(self.tags), self.shapes.steps
        for i, below in enumerate(self.children):
            for c in below:
                step = at[i], self.tags[c]
                if step not in steps:
                    steps[step] = _h(f"{step[0]} {step[1]}")
                at[c] = steps[step]
        return frozenset(at)

    def _drop(self, open_at: list[int], k: int) -> None:
        for node in open_at[k:]:
            self.count[self.tags[node]] -= 1
        del open_at[k:]

    def _close(self, open_at: list[int], tags: str, until: set[str] | frozenset[str]) -> None:
        tags = tags.split()
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(open_at) - 1, 0, -1):
            tag = self.tags[open_at[k]]
            if tag in tags:
                self._drop(open_at, k)
                return
            if tag in until:
                return

    def _add(self, tag: str, text: str, parent: int) -> int:
        self.tags.append(tag)
        self.children.append([])
        self.texts.append(text)
        self.children[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1

    def _text(self, raw: str, parent: int) -> None:
        text = " ".join(entities.unescape(raw).split()) if raw else ""
        if text:
            self._add("#text", text, parent)


def match(reference: Tree, page: Tree, shapes: Shapes) -> dict[int, int]:
    """The reference's node for each node of the page that has one."""
    found, todo = {0: 0}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        left, right = reference.children[a], page.children[b]
        for i, j in shapes.align(tuple(reference.shape[x] for x in left), tuple(page.shape[x] for x in right)):
            if reference.tags[left[i]] == page.tags[right[j]]:
                found[right[j]] = left[i]
                todo.append((left[i], right[j]))
    return found


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Worker:
    """What one task keeps: shapes (afresh when they become many) and the trees of the last references."""

    def __init__(self) -> None:
        self.shapes, self.references = Shapes(), {}

    def aligned(self, reference: bytes, page: bytes) -> tuple[Tree, dict[int, int]]:
        """The page's tree, and the reference's node for each node of the page that has one; both are given as packed trees."""
        if len(self.shapes.shapes) > 200_000 or len(self.shapes.scores) > 1_000_000 or len(self.references) > 500:
            self.__init__()
        if reference not in self.references:
            self.references[reference] = Tree.unpacked(reference, self.shapes)
        mine = Tree.unpacked(page, self.shapes)
        return mine, match(self.references[reference], mine, self.shapes)


def host(url: str = "url") -> F.Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _read(base: DataFrame) -> DataFrame:
    """``base`` with skeleton, paths (a hash of all of them) and tree, packed, of each page."""

    @F.pandas_udf("skeleton bigint, paths bigint, tree binary")
    def read(pages: pd.Series) -> pd.DataFrame:
        shapes, known = Shapes(), {}
        out = []
        for page in pages:
            tree = Tree(page, shapes)
            root = tree.shape[0]
            if root not in known:  # pages of one shape have the same paths
                known[root] = shapes.skeletons[root], _h(" ".join(map(str, sorted(tree.paths()))))
            out.append((*known[root], tree.packed()))
            if len(shapes.shapes) > 200_000:
                shapes, known = Shapes(), {}
        return pd.DataFrame(out, columns=["skeleton", "paths", "tree"]).astype({"skeleton": "int64", "paths": "int64"})

    return base.withColumn("read", read("html")).select("*", "read.skeleton", "read.paths", "read.tree").drop("read")


def _layouts(base: DataFrame, form: str) -> DataFrame:
    """host, skeleton, paths, pages and first (``form`` of the page that stands for it) of each layout of each host."""
    first = F.min(F.struct(F.xxhash64("html").alias("h"), F.col("page_id").isNull().alias("unknown"), "page_id", form))
    return _read(base).groupBy("host", "skeleton", "paths").agg(F.count(F.lit(1)).alias("pages"), first.alias("first"))


def _references(base: DataFrame) -> DataFrame:
    """r_host, references: the pages that stand for a host's layouts, the commonest first; to look at, ``extract`` makes no such lists."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("place"), "skeleton", F.col("first.html").alias("html"))))
    return _layouts(base, "html").groupBy(F.col("host").alias("r_host")).agg(F.transform(listed, lambda r: r["html"]).alias("references"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, host, content, content_texts, template_texts: each page's content, one line a text."""
    kind = pages.schema["page_id"].dataType.simpleString()
    base = pages.select("page_id", host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    commonest = F.min_by("first.tree", F.struct(-F.col("pages"), "skeleton"))
    references = materialise(_layouts(base, "tree").groupBy(F.col("host").alias("r_host"), F.col("paths").alias("r_paths")).agg(commonest.alias("r_tree")))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Worker()
        for pdf in batches:
            rows = []
            for page, given in zip(pdf["tree"], pdf["r_tree"]):
                tree, found = worker.aligned(bytes(given), bytes(page))
                at = [i for i, t in enumerate(tree.texts) if t]
                rows.append(([found.get(i, -1) for i in at], [tree.texts[i] for i in at]))
            out = pd.DataFrame(rows, columns=["slots", "texts"])
            yield pd.concat([pdf[["page_id", "host", "reference"]].reset_index(drop=True), out], axis=1)

    own = _read(base).select("page_id", "host", F.col("paths").alias("reference"), "tree")
    joined = own.join(references, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("reference") == F.col("r_paths"))).drop("r_host", "r_paths")
    aligned = materialise(joined.mapInPandas(align, f"page_id {kind}, host string, reference bigint, slots array<int>, texts array<string>"))
    aligned = aligned.withColumn("hashes", F.transform("texts", lambda t: F.xxhash64(t)))
    votes = aligned.select("host", "reference", F.inline(F.arrays_zip("slots", "hashes"))).where("slots >= 0")
    votes = votes.groupBy("host", "reference", "slots", "hashes").agg(F.count(F.lit(1)).alias("n"))
    constant = votes.groupBy("host", "reference", "slots").agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.max_by("hashes", "n").alias("hash"))
    constant = constant.where((F.col("all") >= 2) & (F.col("n") >= CONSTANT * F.col("all")))
    wrappers = constant.groupBy(F.col("host").alias("w_host"), F.col("reference").alias("w_reference")).agg(F.map_from_entries(F.collect_list(F.struct("slots", "hash"))).alias("template"))
    out = aligned.join(materialise(wrappers), F.col("host").eqNullSafe(F.col("w_host")) & (F.col("reference") == F.col("w_reference")), "left")
    texts = F.arrays_zip("slots", "hashes", "texts")
    varies = F.filter(texts, lambda t: ~F.coalesce(F.try_element_at("template", t["slots"]) == t["hashes"], F.lit(False)))
    out = out.withColumn("content", F.transform(varies, lambda t: t["texts"]))
    return out.select("page_id", "host", F.array_join("content", "\n").alias("content"), F.size("content").alias("content_texts"), (F.size("texts") - F.size("content")).alias("template_texts"))
