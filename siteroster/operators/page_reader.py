"""The per-page HTML step that runs inside Python workers.

Only the standard library and pyarrow are used here, and the module is sent to
the workers by value, so a cluster needs nothing installed for it.
"""

from __future__ import annotations

from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa

# Attributes the rules look at, and HTML element groups.
ATTRIBUTES = {
    "id": "id", "class": "cls", "href": "href", "src": "src", "alt": "alt",
    "content": "content", "name": "name", "property": "property",
    "itemprop": "itemprop", "type": "type", "data-hveid": "hveid",
}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
    "command", "frame", "image", "isindex", "nextid", "spacer",
}
HIDDEN_TEXT_TAGS = {"script", "style", "template", "rt", "rp"}
BLOCK_TAGS = {"div", "section", "address"}
KEEP_BLANKS_TAGS = {"pre", "textarea"}

_INT_FIELDS = [
    "node_id", "end_id", "parent_id", "block_id", "piece_from", "piece_to",
    "own_piece", "string_from",
]
NODE_FIELDS = (
    [(name, pa.int32()) for name in _INT_FIELDS]
    + [("tag", pa.string()), ("hidden", pa.string())]
    + [(name, pa.string()) for name in ATTRIBUTES.values()]
)
BATCH_CHARS = 4 << 20


class PageReader(HTMLParser):
    """Collects pieces and nodes of one page.

    Tags nest as written: an end tag closes everything up to its nearest open
    match and is ignored when there is none; void elements never hold content.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.pieces: list[str] = []
        self.nodes: list[dict] = []
        self._open: list[dict] = []
        self._names: dict[str, int] = {}
        self._buffer: list[str] = []
        self._closed_void: list[str] = []
        self._hiding = self._keeping = 0

    def read(self, html: str) -> None:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # markup the tokenizer rejects: a page without content
            self.pieces, self.nodes, self._open = [], [], []
        self._flush()
        while self._open:
            self._pop()

    # -- strings ----------------------------------------------------------
    def _flush(self, hidden: bool = False) -> None:
        if not self._buffer:
            return
        text = "".join(self._buffer)
        self._buffer.clear()
        if not self._keeping and not text.strip(" \n\t\f\r"):
            text = "\n" if "\n" in text else " "
        parent = self._open[-1] if self._open else None
        if parent is not None:
            parent["_children"] += 1
        if hidden or self._hiding:
            if parent is not None:
                parent["_string"] = parent["node_id"]
                parent["_hidden"] = text
            return
        if parent is not None:
            parent["_string"] = parent["node_id"]
            if parent["own_piece"] is None:
                parent["own_piece"] = len(self.pieces)
        self.pieces.append(text)

    def _aside(self, text: str) -> None:
        self._flush()
        self._buffer.append(text)
        self._flush(hidden=True)

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            try:
                text = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
            except UnicodeDecodeError:
                text = chr(code)
        except (ValueError, OverflowError):
            text = ""
        self._buffer.append(text or "\N{REPLACEMENT CHARACTER}")

    def handle_entityref(self, name):
        self._buffer.append(html5.get(name + ";") or "&" + name)

    def handle_comment(self, data):
        self._aside(data)

    def handle_decl(self, decl):
        self._aside(decl)

    def handle_pi(self, data):
        self._aside(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self._buffer.append(data[6:])
            self._flush()
        else:
            self._aside(data)

    # -- elements ---------------------------------------------------------
    def handle_startendtag(self, tag, attrs):
        self._push(tag, attrs)
        self._close(tag)

    def handle_starttag(self, tag, attrs):
        self._push(tag, attrs)
        if tag in VOID_TAGS:
            self._close(tag)
            self._closed_void.append(tag)

    def handle_endtag(self, tag):
        if tag in self._closed_void:
            self._closed_void.remove(tag)
        else:
            self._close(tag)

    def _push(self, tag, attrs):
        self._flush()
        parent = self._open[-1] if self._open else None
        node = dict.fromkeys(name for name, _ in NODE_FIELDS)
        node.update(
            node_id=len(self.nodes), tag=tag, piece_from=len(self.pieces),
            parent_id=-1 if parent is None else parent["node_id"], block_id=-1,
            _children=0, _string=None, _hidden=None,
        )
        if parent is not None:
            parent["_children"] += 1
            node["block_id"] = parent["node_id"] if parent["tag"] in BLOCK_TAGS else parent["block_id"]
        for name, value in attrs:
            if name in ATTRIBUTES:
                node[ATTRIBUTES[name]] = value or ""
        self.nodes.append(node)
        self._open.append(node)
        self._names[tag] = self._names.get(tag, 0) + 1
        self._hiding += tag in HIDDEN_TEXT_TAGS
        self._keeping += tag in KEEP_BLANKS_TAGS

    def _close(self, tag):
        self._flush()
        if not self._names.get(tag):
            return
        while self._open and self._pop() != tag:
            pass

    def _pop(self):
        node = self._open.pop()
        tag = node["tag"]
        self._names[tag] -= 1
        self._hiding -= tag in HIDDEN_TEXT_TAGS
        self._keeping -= tag in KEEP_BLANKS_TAGS
        node["end_id"], node["piece_to"] = len(self.nodes), len(self.pieces)
        if node["_children"] == 1:
            node["string_from"] = node["_string"]
            if node["_string"] == node["node_id"]:
                node["hidden"] = node["_hidden"]
        if self._open:
            self._open[-1]["_string"] = node["string_from"]
        return tag


def parse_batch(batch: pa.RecordBatch, html_index: int) -> pa.RecordBatch:
    pieces, piece_ends, node_ends = [], [0], [0]
    columns: dict[str, list] = {name: [] for name, _ in NODE_FIELDS}
    for html in batch.column(html_index):
        reader = PageReader()
        reader.read(html.as_py() or "")
        pieces.extend(reader.pieces)
        for name, values in columns.items():
            values.extend([node[name] for node in reader.nodes])
        piece_ends.append(len(pieces))
        node_ends.append(node_ends[-1] + len(reader.nodes))
    nodes = pa.StructArray.from_arrays(
        [pa.array(columns[name], kind) for name, kind in NODE_FIELDS], fields=list(pa.struct(NODE_FIELDS))
    )
    piece_lists = pa.ListArray.from_arrays(
        pa.array(piece_ends, pa.int32()), pa.array(pieces, pa.string())
    )
    node_lists = pa.ListArray.from_arrays(pa.array(node_ends, pa.int32()), nodes)
    names = [n for i, n in enumerate(batch.schema.names) if i != html_index]
    arrays = [c for i, c in enumerate(batch.columns) if i != html_index]
    return pa.RecordBatch.from_arrays(
        arrays + [piece_lists, node_lists], names=names + ["pieces", "nodes"]
    )


def parse_batches(batches, html_index: int):
    """Parse Arrow batches in slices bounded by the size of their HTML."""
    for batch in batches:
        start = size = 0
        for i, html in enumerate(batch.column(html_index)):
            size += len(html.as_py() or "")
            if size > BATCH_CHARS:
                yield parse_batch(batch.slice(start, i + 1 - start), html_index)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield parse_batch(batch.slice(start), html_index)
