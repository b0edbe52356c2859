"""Page parsing, first half: one narrow Arrow pass per page.

A page becomes arrays: visible strings in document order, and the elements of interest as
index ranges over those strings.  Everything else is done by expressions on that form.
"""
from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from contactlake.fixed_values import MENU_CLASS_WORDS, PHONE_DATA_ATTRS

# Workers get this module inside the task, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLAT_COLUMNS = ("strings", "nodes", "links", "metas", "images", "ld")
FLAT_SCHEMA = """
    strings ARRAY<STRING>,
    nodes ARRAY<STRUCT<tag: STRING, cls: STRING, id: STRING, role: STRING, phone: BOOLEAN,
        data: ARRAY<STRING>, listed: BOOLEAN, s: INT, e: INT, ls: INT, le: INT>>,
    links ARRAY<STRUCT<href: STRING, logo: BOOLEAN, s: INT, e: INT>>,
    metas ARRAY<STRUCT<name: STRING, property: STRING, content: STRING>>,
    images ARRAY<STRING>,
    ld ARRAY<STRUCT<kind: STRING, value: STRING>>
"""
_ARROW = pa.struct([
    ("strings", pa.list_(pa.string())),
    ("nodes", pa.list_(pa.struct([
        ("tag", pa.string()), ("cls", pa.string()), ("id", pa.string()), ("role", pa.string()),
        ("phone", pa.bool_()), ("data", pa.list_(pa.string())), ("listed", pa.bool_()),
        ("s", pa.int32()), ("e", pa.int32()), ("ls", pa.int32()), ("le", pa.int32())]))),
    ("links", pa.list_(pa.struct([
        ("href", pa.string()), ("logo", pa.bool_()), ("s", pa.int32()), ("e", pa.int32())]))),
    ("metas", pa.list_(pa.struct([
        ("name", pa.string()), ("property", pa.string()), ("content", pa.string())]))),
    ("images", pa.list_(pa.string())),
    ("ld", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))),
])

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MUTE = frozenset("script style template rt rp".split())
_BLOCKS = frozenset(
    "title header nav footer div section aside main article li h1 h2 h3 noscript".split()
)
_LISTING = frozenset("main article section div".split())


class _Flattener(HTMLParser):
    """Unclosed tags nest, as in a plain tag-soup tree; a stray end tag is ignored."""

    def __init__(self, whole: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.max_images, self.max_listings, self.max_items = (math.inf,) * 3 if whole else (40, 40, 30)
        self.strings, self.nodes, self.links = [], [], []
        self.metas, self.images, self.ld = [], [], []
        self.stack: list[tuple] = []      # (tag, node, link, is logo class, listing counter)
        self.open: dict[str, int] = {}    # open elements by tag
        self.buf: list[str] = []
        self.mute = self.logo = self.listings = self.n_images = 0
        self.counters: list[list[int]] = []
        self.script: str | None = None

    def flush(self) -> None:
        if self.buf:
            raw = "".join(self.buf)
            self.buf.clear()
            if self.mute:
                if self.script is not None:
                    self.script += raw
            elif text := raw.strip():
                self.strings.append(text)

    def handle_data(self, data: str) -> None:
        self.buf.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        cls = " ".join(classes)
        at, links = len(self.strings), len(self.links)
        node = link = counter = None
        if tag == "meta":
            self.metas.append({"name": a.get("name"), "property": a.get("property"),
                               "content": a.get("content")})
        elif tag == "img" and self.n_images < self.max_images:
            self.n_images += 1
            self.images += [a[k] for k in ("alt", "title", "aria-label") if k in a]
        elif tag == "a":
            logo = "logo" in cls or self.logo > 0 or (
                self.open.get("header", 0) > 0 and a.get("href") == "/")
            link = {"href": a.get("href"), "logo": logo, "s": at, "e": at}
            self.links.append(link)
        phone = a.get("itemprop") == "telephone" or "phone" in cls or "tel" in cls
        if phone or tag in _BLOCKS:
            listed = False
            if tag == "li":
                room = [c for c in self.counters if c[0] < self.max_items]
                listed = bool(room) and not self.open.get("noscript")
                for c in room:
                    c[0] += 1
            node = {"tag": tag, "cls": cls, "id": a.get("id"), "role": a.get("role"), "phone": phone,
                    "data": [a[k] for k in PHONE_DATA_ATTRS if a.get(k)] if phone else [],
                    "listed": listed, "s": at, "e": at, "ls": links, "le": links}
            self.nodes.append(node)
            if tag in _LISTING:
                self.listings += 1
                low = cls.lower()
                if self.listings <= self.max_listings and not any(w in low for w in MENU_CLASS_WORDS):
                    counter = [0]
                    self.counters.append(counter)
        if tag in _VOID:
            return
        is_logo = "logo" in classes
        self.stack.append((tag, node, link, is_logo, counter))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.logo += is_logo
        if tag in _MUTE:
            self.mute += 1
            self.script = "" if tag == "script" and a.get("type") == "application/ld+json" else None

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if not self.open.get(tag):
            return
        while True:
            name = self.pop()
            if name == tag:
                return

    def pop(self) -> str:
        name, node, link, is_logo, counter = self.stack.pop()
        self.open[name] -= 1
        self.logo -= is_logo
        if counter is not None:
            self.counters = [c for c in self.counters if c is not counter]
        if node is not None:
            node["e"], node["le"] = len(self.strings), len(self.links)
        if link is not None:
            link["e"] = len(self.strings)
        if name in _MUTE:
            self.mute -= 1
            if self.script is not None:
                self.read_ld(self.script)
                self.script = None
        return name

    def read_ld(self, raw: str) -> None:
        try:
            data = json.loads(raw)
        except (ValueError, RecursionError):  # not JSON, or nested beyond reading
            return
        self.ld += [{"kind": "phone", "value": v} for v in _ld_phones(data)]
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict):
                graph = item.get("@graph")
                self.ld += _ld_names(item, ("Service", "Product", "Offer"), org=True)
                for sub in graph if isinstance(graph, list) else ():
                    if isinstance(sub, dict):
                        self.ld += _ld_names(sub, ("Service", "Product"), org=False)

    def result(self) -> dict:
        self.flush()
        while self.stack:
            self.pop()
        return {k: getattr(self, k) for k in FLAT_COLUMNS}


def _ld_phones(data) -> Iterator[str]:
    """Numbers under telephone / phone / contactPoint, at any depth, outer ones first."""
    waiting = [data]
    while waiting:
        at = waiting.pop()
        if isinstance(at, list):
            waiting += reversed(at)
        elif isinstance(at, dict):
            for key in ("telephone", "phone", "contactPoint"):
                values = at.get(key)
                for v in values if isinstance(values, list) else [values]:
                    if isinstance(v, dict) and v.get("telephone"):
                        yield _sound(str(v["telephone"]))  # a number may be written without quotes
                    elif isinstance(v, str):
                        yield _sound(v)
            waiting += reversed(at.values())


def _sound(text: str) -> str:
    """The text with halves of surrogate pairs, which JSON can name, replaced."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _ld_names(item: dict, kinds: tuple, org: bool) -> list[dict]:
    def text(v) -> str:
        return _sound(v).strip() if isinstance(v, str) else ""

    kind, name, out = item.get("@type"), text(item.get("name")), []
    if name and isinstance(kind, str) and kind in kinds:
        out.append({"kind": "offering", "value": name})
    if org and name:
        out.append({"kind": "org", "value": name})
    if org and kind in ("Organization", "LocalBusiness", "Corporation") and text(item.get("legalName")):
        out.append({"kind": "org", "value": text(item["legalName"])})
    return out


def _flatten(html: str | None, whole: bool = False) -> dict:
    """Flat form of one page; what a page gave before the parser gave up on it is kept."""
    parser = _Flattener(whole)
    try:
        parser.feed(html or "")
        parser.close()
    except (ValueError, AssertionError, RecursionError):
        pass
    return parser.result()


def flatten_pages(pages: DataFrame, html: str = "html", whole: bool = False) -> DataFrame:
    """Replace the html column by the flat page columns; other columns pass through.

    ``whole`` takes all images, blocks and list items; else 40, 40 and 30 a block.

    Narrow: no shuffle, one Arrow batch at a time.  Filter pages before this call, as
    nothing is pushed through it.
    """
    keep = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds the parsed pages held at once
                b = batch.slice(at, 256)
                rows = pa.array([_flatten(h, whole) for h in b.column(html).to_pylist()], type=_ARROW)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in keep] + rows.flatten(),
                    names=keep + [f.name for f in _ARROW],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)
    return pages.mapInArrow(run, f"{fields}, {FLAT_SCHEMA}" if fields else FLAT_SCHEMA)
