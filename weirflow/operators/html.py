"""Elements of HTML documents by selector: each document is parsed where it lies, one row for each element found.

Selectors: a list of chains of tag, ``.class``, ``#id``, ``[a]``, ``[a=v]`` and ``[a*=v]`` with descendant (blank) and child
(``>``) steps. The tree builder closes open elements at their parent's end and knows void elements; it does not repair
markup as a browser does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of found text that a task holds before it gives them on.
HELD = 1 << 20
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"\s*(>)?\s*([A-Za-z][\w-]*|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]*\])*)")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:(\*?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def outer(self) -> str:
        """The element's markup."""
        attributes = "".join(f' {k}="{escape(v)}"' for k, v in self.attributes.items())
        inner = "".join(escape(c, quote=False) if isinstance(c, str) else c.outer() for c in self.children)
        return f"<{self.tag}{attributes}>" + ("" if self.tag in _VOID else f"{inner}</{self.tag}>")

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})
        self.nodes: list[Node] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def release(self) -> None:
        """Nodes name their parents and children; without these links the tree's memory is free at once."""
        for node in self.nodes:
            node.parent = None
            node.children.clear()
        self.root.children.clear()


def compile_selector(selector: str) -> list[list[tuple[bool, str, list]]]:
    """Chains of steps (child of the step before, tag, tests), each chain from its last step."""
    chains = []
    for part in selector.split(","):
        steps, at, part = [], 0, part.strip()
        while at < len(part):
            m = _STEP.match(part, at)
            if m.end() == at or not (m[2] or m[3]):
                raise ValueError(f"selector not understood: {selector!r}")
            steps.append((bool(m[1]), (m[2] or "*").lower(), _PART.findall(m[3])))
            at = m.end()
        if not steps:
            raise ValueError(f"selector not understood: {selector!r}")
        chains.append(steps[::-1])
    return chains


def _fits(node: Node, tag: str, tests: list) -> bool:
    if tag not in ("*", node.tag):
        return False
    for klass, name, attribute, operator, value in tests:
        if klass and klass not in node.attributes.get("class", "").split():
            return False
        if name and node.attributes.get("id") != name:
            return False
        if attribute:
            found = node.attributes.get(attribute)
            if found is None or (operator == "=" and found != value) or (operator == "*=" and value not in found):
                return False
    return True


def _matches(node: Node, steps: list) -> bool:
    (child, tag, tests), rest = steps[0], steps[1:]
    if not _fits(node, tag, tests):
        return False
    if not rest:
        return True
    up = node.parent
    while up is not None and up.parent is not None:
        if _matches(up, rest):
            return True
        up = None if child else up.parent
    return False


def _parsed(page: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree


def _chosen(tree: _Tree, chains: list) -> list[Node]:
    return [n for n in tree.nodes if any(_matches(n, steps) for steps in chains)]


def elements(page: str | None, selector: str) -> list[Node]:
    return _chosen(_parsed(page), compile_selector(selector))


def select(df: DataFrame, id_col: str, html_col: str, selector: str, attribute: str | None = None, own: bool = False, outer: bool = False) -> DataFrame:
    """(id, sub, value): of each element found its text (all of it, or ``own`` text only), trimmed, its markup, or an attribute where it has it."""
    chains = compile_selector(selector)

    def value(node: Node) -> str | None:
        if outer:
            return node.outer()
        return node.attributes.get(attribute) if attribute else (node.own_text() if own else node.text()).strip()

    def values(page: str | None) -> list[str]:
        tree = _parsed(page)
        found = [v for n in _chosen(tree, chains) if (v := value(n)) is not None]
        tree.release()
        return found

    def given(ids: pa.Array, rows: list[int], subs: list[int], found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(subs, pa.int32()), pa.array(found, pa.string())], [id_col, "sub", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, subs, found, held = batch.column(0), [], [], [], 0
            for k, page in enumerate(batch.column(1)):  # one page at a time becomes a string and a tree
                for j, v in enumerate(values(page.as_py())):
                    rows.append(k)
                    subs.append(j)
                    found.append(v)
                    held += len(v) + 64
                if held >= HELD:
                    yield given(ids, rows, subs, found)
                    rows, subs, found, held = [], [], [], 0
            if rows:
                yield given(ids, rows, subs, found)
            del batch, ids  # before the next one is read

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, sub int, value string")
