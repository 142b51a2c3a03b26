"""HTML as a tree, and the selectors that registries use.

Built on the standard library's tokenizer: void tags, implied ends of
paragraphs, list items, table parts and options, and stray ends are handled;
broken markup gives some tree, never an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: What an opening tag ends, and the tags beyond which it ends nothing.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"})}


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        """All text below, in document order."""
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo += reversed(x.children)

    def text(self) -> str:
        return clean("".join(self.texts()))

    def own_text(self) -> str:
        return clean("".join(c for c in self.children if isinstance(c, str)))

    def select(self, selector: str) -> Iterator[Node]:
        """Elements below that a selector list names, in document order."""
        paths = parsed(selector)
        return (n for n in self.elements() if any(_fits(n, p, len(p) - 1) for p in paths))

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)


def clean(text: str) -> str:
    """White space squeezed."""
    return " ".join(text.split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _leave(self, tags: set[str], within: set[str]) -> None:
        node, last = self.at, None
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS:
            self._leave(*_ENDS[tag])
        elif tag in _BLOCKS:
            self._leave({"p"}, {"div", "td", "th", "li", "section", "article", "body", "button"})
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        node = Node(tag, known, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    """The root above the top elements."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def decoded(body: bytes | None) -> str:
    """UTF-8 text; each byte that is none of it becomes one replacement character."""
    if body is None:
        return ""
    try:
        return bytes(body).decode("utf-8")
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", bytes(body).decode("utf-8", "surrogateescape"))


def stripped(html: str) -> str:
    """The text of markup; text without any is only squeezed."""
    return clean(html) if "<" not in html else tree(html).text()


_SIMPLE = re.compile(r"""\*|[.#]?[A-Za-z_][\w-]*|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]|:([a-z-]+)(?:\(\s*([^)]*?)\s*\))?""")


@lru_cache(512)
def parsed(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """For each alternative its (combinator before, tests) steps; ValueError for what isn't understood."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, joint, at = [], " ", 0
        text = one.strip()
        if not text:
            raise ValueError(f"empty selector in {selector!r}")
        tests: list[tuple] = []
        while at < len(text):
            gap = re.match(r"\s*([>+~])\s*|\s+", text[at:])
            if gap:
                if tests:
                    steps.append((joint, tests))
                joint, tests = gap[1] or " ", []
                at += gap.end()
                continue
            m = _SIMPLE.match(text, at)
            if not m:
                raise ValueError(f"selector {selector!r}")
            tests.append(_test(m, selector))
            at = m.end()
        if not tests:
            raise ValueError(f"selector {selector!r}")
        out.append([*steps, (joint, tests)])
    return out


def _test(m: re.Match, selector: str) -> tuple:
    word = m[0]
    if word == "*":
        return ("any",)
    if word[0] == ".":
        return ("class", word[1:])
    if word[0] == "#":
        return ("attr", "id", "=", word[1:])
    if word[0] == "[":
        return ("attr", m[1].lower(), m[2] or "", next((x for x in (m[3], m[4], m[5]) if x is not None), ""))
    if word[0] == ":":
        if m[6] == "first-child":
            return ("nth", 0, 1)
        if m[6] == "last-child":
            return ("last",)
        if m[6] == "nth-child" and m[7]:
            text = {"odd": "2n+1", "even": "2n"}.get(m[7], m[7]).replace(" ", "")
            got = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
            if got and text:
                step = 0 if got[1] is None else int(got[1] + "1") if got[1] in ("", "+", "-") else int(got[1])
                return ("nth", step, int(got[2] or 0))
        raise ValueError(f"selector {selector!r}")
    return ("tag", word.lower())


def _place(node: Node) -> int:
    return 1 + next(k for k, c in enumerate(c for c in node.parent.children if isinstance(c, Node)) if c is node)


def _passes(node: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "any":
        return True
    if kind == "tag":
        return node.tag == test[1]
    if kind == "class":
        return test[1] in node.attrs.get("class", "").split()
    if kind == "nth":
        step, offset = test[1], test[2]
        n = _place(node) - offset
        return n == 0 if step == 0 else n % step == 0 and n // step >= 0
    if kind == "last":
        return [c for c in node.parent.children if isinstance(c, Node)][-1] is node
    own = node.attrs.get(test[1])
    if own is None:
        return False
    op, want = test[2], test[3]
    return {"": True, "=": own == want, "~=": want in own.split(), "*=": bool(want) and want in own, "^=": bool(want) and own.startswith(want), "$=": bool(want) and own.endswith(want), "|=": own == want or own.startswith(want + "-")}[op]


def _fits(node: Node, path: list, k: int) -> bool:
    joint, tests = path[k]
    if not all(_passes(node, t) for t in tests):
        return False
    if k == 0:
        return True
    if joint in "+~":
        before = []
        for c in node.parent.children if node.parent else []:
            if c is node:
                break
            if isinstance(c, Node):
                before.append(c)
        return any(_fits(n, path, k - 1) for n in (before[-1:] if joint == "+" else before))
    up = node.parent
    while up is not None and up.parent is not None:
        if _fits(up, path, k - 1):
            return True
        if joint == ">":
            return False
        up = up.parent
    return False
