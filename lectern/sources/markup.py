"""XML and HTML as trees, for what regular expressions can't say. Python, called from Arrow UDFs.

The HTML tree is the standard library's event stream with void elements and unclosed paragraphs and list
items closed; it is not a browser's tree builder, so broken nesting may come out otherwise than there.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NON_CONTENT = frozenset("script noscript style link meta base iframe object embed".split())
# Elements at which a sentence ends.
BLOCKS = frozenset(
    "address article aside blockquote body canvas center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SELF_CLOSING = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: What a run of white space is not one blank to: in a sentence, blanks side by side or at its end.
_WIDE = re.compile(r"\s\s|\s$")
URL_ATTRIBUTES = ("href", "src", "xlink:href", "action", "formaction")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        return next((v or "" for k, v in self.attrs if k == name), None)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", [])
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        top = self.open[-1].tag
        if tag in _SELF_CLOSING.get(top, ()):
            self.open.pop()
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_html(text: str) -> Node:
    b = _Builder()
    b.feed(text.lstrip("﻿"))
    b.close()
    return b.root


def element_ids(text: str) -> list[str]:
    return list(dict.fromkeys(i for n in parse_html(text).walk() if (i := n.get("id"))))


def block_texts(root: Node) -> list[str]:
    """Runs of inline text between block elements, in order."""
    out, run = [], []

    def flush() -> None:
        if "".join(run).strip():
            out.append("".join(run))
        run.clear()

    def visit(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                run.append(c)
            elif c.tag in BLOCKS:
                flush()
                visit(c)
                flush()
            else:
                visit(c)

    visit(root)
    flush()
    return out


def sentences_of_html(text: str) -> list[str]:
    from lectern.operators.align import sentences_of

    root = parse_html(text)
    body = root.find("body") or root
    return [s for t in block_texts(body) for s in sentences_of(re.sub(r"\s+", " ", t))]


@lru_cache(maxsize=4096)
def _safe_style(css: str) -> str:
    """A style attribute's declarations that aren't harmful; elements of one book have few different ones."""
    from lectern.functions.css import sanitize

    return sanitize(css, True)[0]


def _unsafe(url: str) -> bool:
    return re.sub(r"\s+", "", url).lower().startswith(("javascript:", "vbscript:"))


def serialize(node: Node | str, drop: frozenset[str] = NON_CONTENT) -> str:
    """Markup again, without scripts, event handlers, script URLs and harmful styles."""
    if isinstance(node, str):
        return html.escape(node, quote=False)
    if node.tag in drop:
        return ""
    attrs = []
    for k, v in node.attrs:
        v = v or ""
        if k.startswith("on") or (k in URL_ATTRIBUTES and _unsafe(v)):
            continue
        if k == "style":
            v = _safe_style(v)
        attrs.append(f' {k}="{html.escape(v)}"')
    inner = "".join(serialize(c, drop) for c in node.children)
    if node.tag == "#root":
        return inner
    return f"<{node.tag}{''.join(attrs)}>" if node.tag in VOID else f"<{node.tag}{''.join(attrs)}>{inner}</{node.tag}>"


def publisher_styles(text: str) -> list[tuple[str, str]]:
    """('href' or 'inline', value) of the head's style sheets in order, links once, types other than text/css passed over."""
    head, out, seen = parse_html(text).find("head"), [], set()
    for n in head.walk() if head else ():
        kind = (n.get("type") or "").strip().lower()
        if kind not in ("", "text/css"):
            continue
        if n.tag == "style":
            out.append(("inline", n.text()))
        elif n.tag == "link" and "stylesheet" in (n.get("rel") or "").lower().split() and (href := (n.get("href") or "").strip()) and href not in seen:
            seen.add(href)
            out.append(("href", href))
    return out


def tag_elements(text: str, ids: dict[str, str]) -> str:
    """The body's markup, safe, with data-span-id on the elements whose id is a key of ids."""
    root = parse_html(text)
    for n in root.walk():
        if (i := n.get("id")) in ids:
            n.attrs = [(k, v) for k, v in n.attrs if k != "data-span-id"] + [("data-span-id", ids[i])]
    return serialize(root.find("body") or root)


def tag_sentences(text: str, chapter: str, sentences: list[str], wanted: set[int]) -> str:
    """The body's markup with each wanted sentence's first fragment wrapped in a span with data-span-id '<chapter>-sentence<n>'."""
    root = parse_html(text)
    body = root.find("body") or root
    state = {"n": 0, "rest": ""}

    def visit(node: Node) -> None:
        out: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node):
                visit(c)
                out.append(c)
                continue
            at = 0
            while at < len(c):
                if state["rest"]:  # of a sentence that began in an earlier node: stepped over, not wrapped
                    took = _common(c, at, state["rest"])
                    state["rest"] = state["rest"][took[1] :]
                    out.append(c[at : took[0]])
                    at = took[0]
                    if state["rest"]:
                        break
                    continue
                if state["n"] >= len(sentences):
                    break
                s = sentences[state["n"]]
                begin = c.find(s[0], at)
                if begin < 0:
                    break
                end, used = _common(c, begin, s)
                if not used:
                    break
                out.append(c[at:begin])
                piece = c[begin:end]
                if state["n"] in wanted:
                    span = Node("span", [("data-span-id", f"{chapter}-sentence{state['n']}")])
                    span.children.append(piece)
                    out.append(span)
                else:
                    out.append(piece)
                state["rest"], state["n"], at = s[used:], state["n"] + 1, end
            out.append(c[at:])
        node.children = [x for x in out if x != ""]

    visit(body)
    return serialize(body)


def _common(text: str, at: int, sentence: str) -> tuple[int, int]:
    """How far text, from at, and the sentence agree, runs of white space being one blank: (place in text, place in sentence)."""
    if text.startswith(sentence, at) and not _WIDE.search(sentence):  # most are there as they are
        return at + len(sentence), len(sentence)
    i, j = at, 0
    while i < len(text) and j < len(sentence):
        if text[i].isspace() and sentence[j].isspace():
            while i < len(text) and text[i].isspace():
                i += 1
            j += 1
        elif text[i].isspace():
            i += 1
        elif text[i] == sentence[j]:
            i, j = i + 1, j + 1
        elif sentence[j].isspace():
            j += 1
        else:
            break
    return i, j


# --- navigation --------------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2].lower()


def resolve_target(source: str, href: str) -> str | None:
    """The package path that a link leads to; the source itself for bare fragments, None for other schemes."""
    h = href.strip()
    if not h or re.match(r"(?i)[a-z][a-z0-9+.-]*:|//", h):
        return None
    path = h.split("#")[0].split("?")[0]
    if not path:
        return source
    parts = source.split("/")[:-1]
    for x in unquote(path).replace("\\", "/").split("/"):
        if x == "..":
            parts = parts[:-1]
        elif x not in ("", "."):
            parts.append(x)
    return "/".join(parts)


def _pieces(text: str | pa.Buffer, some: int = 1 << 18) -> Iterator[str]:
    """The text, without a byte order mark, piece by piece; a buffer holds UTF-8."""
    utf8, first = codecs.getincrementaldecoder("utf-8")(), True
    for at in range(0, len(text) if isinstance(text, str) else text.size, some):
        piece = text[at : at + some] if isinstance(text, str) else utf8.decode(memoryview(text)[at : at + some])
        yield piece.lstrip("\ufeff") if first else piece
        first = first and not piece


class _Navs(HTMLParser):
    """Which nav of a document holds its contents: the first toc nav, else the first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.n, self.toc = 0, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "nav":
            of = Node(tag, attrs).get
            if self.toc is None and {"toc", "doc-toc"} & set(f"{of('epub:type') or ''} {of('role') or ''}".lower().split()):
                self.toc = self.n
            self.n += 1


class _Contents(_Builder):
    """Builds the first list of a document's nav number `which` only, and hands its children on as soon as they are whole."""

    def __init__(self, which: int, add: Callable[[Node], None]) -> None:
        super().__init__()
        self.which, self.add, self.nav, self.first = which, add, None, None
        self.depth: dict[Node, int] = {}  # places among the open elements

    def _met(self, node: Node) -> None:
        if node.tag == "nav":
            if self.which == 0:
                self.nav, self.depth[node] = node, len(self.open) - 1
            self.which -= 1
        elif self.first is None and node.tag in ("ol", "ul") and self._open(self.nav):
            self.first, self.depth[node] = node, len(self.open) - 1

    def _open(self, node: Node | None) -> bool:
        return node is not None and len(self.open) > (at := self.depth[node]) and self.open[at] is node

    def _drop(self, parent: Node) -> None:
        if parent is self.first:
            self.give(1)
        elif not self._open(self.first):
            parent.children.clear()

    def give(self, but: int = 0) -> None:
        """Of the list's children the last `but` may still grow."""
        done = len(self.first.children) - but
        for c in self.first.children[:done]:
            self.add(c)
        del self.first.children[:done]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        parent = self.open[-1] if tag in VOID else self.open[-2]
        self._met(parent.children[-1])
        self._drop(parent)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_startendtag(tag, attrs)
        parent = self.open[-1]
        self._met(parent.children[-1])
        self._drop(parent)

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        self._drop(self.open[-1])


class _Entries:
    """Rows (node, parent, place among siblings, title, target path) as they are found."""

    def __init__(self, source: str):
        self.source, self.n, self.rows = source, 0, []
        self.count: dict[int | None, int] = {}

    def add(self, parent: int | None, title: str, target: str | None) -> int | None:
        """The new node; the parent if there is no title or target."""
        if not (title and target):
            return parent
        place = self.count.get(parent, 0)
        self.count[parent] = place + 1
        self.rows.append((self.n, parent, place, title, target))
        self.n += 1
        return self.n - 1

    def take(self) -> list[tuple[int, int | None, int, str, str]]:
        rows, self.rows = self.rows, []
        return rows


def navigation(text: str | pa.Buffer, source: str) -> list[tuple[int, int | None, int, str, str]]:
    """navigation_rows() as a list."""
    return list(navigation_rows(text, source))


def navigation_rows(text: str | pa.Buffer, source: str) -> Iterator[tuple[int, int | None, int, str, str]]:
    """(node, parent, place among siblings, title, target path) of an EPUB 3 nav document: its first toc nav, else its first nav.

    An item without a title or target has its children in its place. The document is read twice, and of its tree one item of the outermost list is held at once.
    """
    navs = _Navs()
    for piece in _pieces(text):
        navs.feed(piece)
    navs.close()
    if not navs.n:
        return
    found = _Entries(source)

    def lists(node: Node) -> Iterator[Node]:
        for c in node.children:
            if isinstance(c, Node):
                if c.tag in ("ol", "ul"):
                    yield c
                else:
                    yield from lists(c)

    def link(node: Node) -> Node | None:
        for c in node.children:
            if isinstance(c, Node) and c.tag not in ("ol", "ul"):
                if c.tag == "a" or (within := link(c)) is not None:
                    return c if c.tag == "a" else within
        return None

    def add(li: Node | str, parent: int | None) -> None:
        if isinstance(li, str):
            return
        here = parent
        if li.tag == "li":
            a = link(li)
            title = re.sub(r"\s+", " ", a.text()).strip() if a else ""
            here = found.add(parent, title, resolve_target(source, a.get("href") or "") if a else None)
        for inner in [li] if li.tag in ("ol", "ul") else lists(li):
            for c in inner.children:
                add(c, here)

    contents = _Contents(navs.toc or 0, lambda c: add(c, None))
    for piece in _pieces(text):
        contents.feed(piece)
        yield from found.take()
    contents.close()
    if contents.first is not None:
        contents.give()
    yield from found.take()


def ncx(text: str | pa.Buffer, source: str) -> list[tuple[int, int | None, int, str, str]]:
    """ncx_rows() as a list."""
    return list(ncx_rows(text, source))


def ncx_rows(text: str | pa.Buffer, source: str) -> Iterator[tuple[int, int | None, int, str, str]]:
    """navigation_rows() from an NCX document's first navMap; of its tree one outermost point is held at once."""
    found = _Entries(source)

    def add(p: ET.Element, parent: int | None) -> None:
        label = next((c for c in p if _local(c.tag) == "navlabel"), None)
        title = re.sub(r"\s+", " ", "".join(label.itertext())).strip() if label is not None else ""
        content = next((c for c in p if _local(c.tag) == "content"), None)
        here = found.add(parent, title, resolve_target(source, content.get("src", "")) if content is not None else None)
        for c in p:
            if _local(c.tag) == "navpoint":
                add(c, here)

    path: list[ET.Element] = []
    top, within = None, 0  # the navMap, and how many open elements there are from it on
    for event, n in _xml_events(text):
        if event == "start":
            if top is None and _local(n.tag) == "navmap":
                top = n
            within += top is not None and (within > 0 or n is top)
            path.append(n)
            continue
        path.pop()
        within -= within > 0
        if within == 1 and _local(n.tag) == "navpoint":
            add(n, None)
            yield from found.take()
        if path and within < 2:
            path[-1].remove(n)


def _xml_events(text: str | pa.Buffer) -> Iterator[tuple[str, ET.Element]]:
    """('start' or 'end', element) along a document."""
    parser = ET.XMLPullParser(["start", "end"])
    for piece in _pieces(text):
        parser.feed(piece)
        yield from parser.read_events()
    parser.close()
    yield from parser.read_events()


# --- packages and overlays ---------------------------------------------------------------------------


def rootfile(container: str) -> str:
    for n in ET.fromstring(container.lstrip("﻿")).iter():
        if _local(n.tag) == "rootfile" and n.get("full-path"):
            return n.get("full-path").lstrip("/")
    raise ValueError("the container names no package document")


def package(text: str | pa.Buffer, some: int = 20_000) -> dict:
    """Title, identifier, toc, manifest and spine of a package document; manifest and spine are lists of columns, of `some` rows each at most."""
    out: dict = {"manifest": [], "spine": []}
    for name, value in package_parts(text, some):
        if name in ("manifest", "spine"):
            out[name].append(value)
        else:
            out[name] = value
    return out | {name: out[name] or _Columns(kind, some).parts() for name, kind in (("manifest", MANIFEST), ("spine", SPINE))}


def package_parts(text: str | pa.Buffer, some: int = 20_000) -> Iterator[tuple[str, object]]:
    """('manifest' or 'spine', columns of `some` rows at most) in order, and at the end each of title, identifier and toc; items without id, href or type are dropped.

    The document is read as a stream of elements, none of which is kept.
    """
    said: dict[str, str] = {}
    lists = {"manifest": _Columns(MANIFEST, some), "spine": _Columns(SPINE, some)}
    path: list[ET.Element] = []
    n_items, first_spine, told = 0, None, 0  # told: how many open elements' text is wanted
    for event, n in _xml_events(text):
        name = _local(n.tag)
        wanted = name in ("title", "identifier")
        if event == "start":
            if wanted:
                told += 1
                said.setdefault(name, n)
            elif name == "item":
                if n.get("id") and n.get("href") and n.get("media-type"):
                    lists["manifest"].add((n_items, n.get("id"), n.get("href"), n.get("media-type"), n.get("media-overlay"), (n.get("properties") or "").split()))
                n_items += 1
            elif name == "spine" and first_spine is None:
                first_spine = n
            elif name == "itemref" and n.get("idref") and path and path[-1] is first_spine:
                lists["spine"].add((lists["spine"].n, n.get("idref"), n.get("linear") != "no"))
            path.append(n)
            for part, rows in lists.items():
                for made in rows.take():
                    yield part, made
            continue
        path.pop()
        if wanted:
            told -= 1
            if said.get(name) is n:
                said[name] = "".join(n.itertext()).strip()
        if path and not told:
            path[-1].remove(n)
    for part, rows in lists.items():
        for made in rows.parts() if rows.rows else ():
            yield part, made
    yield "title", said.get("title") or "Untitled"
    yield "identifier", said.get("identifier")
    yield "toc", first_spine.get("toc") if first_spine is not None else None


MANIFEST = pa.struct([("ord", pa.int32()), ("id", pa.string()), ("href", pa.string()), ("media_type", pa.string()), ("media_overlay", pa.string()), ("properties", pa.list_(pa.string()))])
SPINE = pa.struct([("ord", pa.int32()), ("idref", pa.string()), ("linear", pa.bool_())])
NAVIGATION = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("sibling_ord", pa.int32()), ("title", pa.string()), ("path", pa.string())])


def columns_of(rows: list[tuple], kind: pa.StructType) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)]


class _Columns:
    """Rows as Arrow arrays of structs, `some` of them as Python objects at once."""

    def __init__(self, kind: pa.StructType, some: int):
        self.kind, self.some, self.rows, self.made, self.n = kind, some, [], [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.n += 1
        if len(self.rows) >= self.some:
            self._close()

    def _close(self) -> None:
        self.made.append(pa.StructArray.from_arrays(columns_of(self.rows, self.kind), fields=list(self.kind)))
        self.rows = []

    def take(self) -> list[pa.Array]:
        """What is made so far; it isn't kept."""
        made, self.made = self.made, []
        return made

    def parts(self) -> list[pa.Array]:
        if self.rows or not self.made:
            self._close()
        return self.made


def clip_ms(text: str | None) -> float:
    """functions.clip.clip_ms for one value."""
    number = lambda s: float(m[0]) if (m := re.match(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", s)) else float("nan")
    if not text:
        return 0.0
    t = text.strip()
    if t.endswith("ms"):
        return number(t[:-2])
    if t.endswith("s"):
        return number(t[:-1]) * 1000
    if ":" in t:
        p = t.split(":")
        if len(p) not in (2, 3):
            return 0.0
        whole = [float(m[0]) if (m := re.match(r"\s*[-+]?\d+", x)) else float("nan") for x in p[:-1]]
        return ((whole[0] * 3600 + whole[1] * 60) if len(whole) == 2 else whole[0] * 60) * 1000 + number(p[-1]) * 1000
    return number(t) * 1000


def overlay(text: str, chapter: str, source: str) -> list[tuple[str, str, str, float, float]]:
    """(id, text_ref, audio_src, begin ms, end ms) of an overlay's pars; at each level all pars come before any nested seq."""
    rows: list[tuple[str, str, str, float, float]] = []

    def add(node: ET.Element) -> None:
        for p in (c for c in node if _local(c.tag) == "par"):
            words = next((c for c in p if _local(c.tag) == "text"), None)
            sound = next((c for c in p if _local(c.tag) == "audio"), None)
            src = words.get("src") if words is not None else None
            if not src:
                continue
            path, hash_, fragment = src.partition("#")
            ref = (resolve_target(source, path) or path if path else "") + hash_ + fragment
            name = p.get("id") or f"span_{chapter}_{len(rows)}"
            if sound is None or not sound.get("src"):
                rows.append((name, ref, "", 0.0, 0.0))
            else:
                rows.append((name, ref, resolve_target(source, sound.get("src")) or sound.get("src"), clip_ms(sound.get("clipBegin")), clip_ms(sound.get("clipEnd"))))
        for s in (c for c in node if _local(c.tag) == "seq"):
            add(s)

    body = next((n for n in ET.fromstring(text.lstrip("﻿")).iter() if _local(n.tag) == "body"), None)
    if body is not None:
        add(body)
    return rows
