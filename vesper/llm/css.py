"""The part of CSS that decides what is shown: selectors, cascade of display and visibility.

Selectors are compounds of type, class, id, attribute, :not, :is, :where, :root
and :first-child, joined by the four combinators. A selector
with anything else (states such as :hover, pseudo-elements, counts from the end)
matches nothing, and so does a rule within an at-rule other than @media for all
or for screens without conditions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Compounds of a selector and levels of :not in each other; a selector of more matches nothing.
MOST, NESTED = 256, 16
PROPERTIES = frozenset(["display", "visibility", "content-visibility"])

_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_PART = re.compile(rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<fold>[iIsS])?\s*)?\]|:(?P<pseudo>{_NAME})")
_JOIN = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass
class Element:
    """An open element: what selectors ask of it. place counts its parent's elements from 0."""

    tag: str
    attributes: dict[str, str]
    parent: Element | None
    place: int = 0
    children: int = 0
    #: by kind of child: one of the kind, its first place and the places of the last two
    kinds: dict[tuple, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.classes = frozenset(self.attributes.get("class", "").split())
        #: by selector and number of compounds: whether they end here, or above
        self.known: dict[tuple[int, int, bool], bool] = {}

    def open(self, tag: str, attributes: dict[str, str]) -> Element:
        """A new last child."""
        child = Element(tag, attributes, self, self.children)
        self.children += 1
        kind = (tag, *sorted(attributes.items()))
        have = self.kinds.setdefault(kind, [child, child.place, -1, -1])
        have[2:] = [have[3], child.place]
        return child

    def before(self) -> list[Element]:
        """Siblings before it: of each kind the last one."""
        if self.parent is None:
            return []
        out = []
        for one, first, last_but_one, last in self.parent.kinds.values():
            if first < self.place:
                out.append(Element(one.tag, one.attributes, self.parent, last if last < self.place else max(last_but_one, first)))
        return out


@dataclass
class Compound:
    """Conditions on one element."""

    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str, str, bool]] = field(default_factory=list)
    first: bool = False
    root: bool = False
    none_of: list[list[Compound]] = field(default_factory=list)
    one_of: list[list[Compound]] = field(default_factory=list)
    weight: tuple[int, int, int] = (0, 0, 0)

    def matches(self, e: Element) -> bool:
        if self.tag and self.tag != e.tag or self.first and e.place or self.root and e.tag != "html":
            return False
        if any(e.attributes.get("id") != i for i in self.ids) or not e.classes.issuperset(self.classes):
            return False
        if not all(_holds(e.attributes.get(name), op, value, fold) for name, op, value, fold in self.attributes):
            return False
        return not any(c.matches(e) for cs in self.none_of for c in cs) and all(any(c.matches(e) for c in cs) for cs in self.one_of)


def _holds(have: str | None, op: str, value: str, fold: bool) -> bool:
    if have is None or not op:
        return have is not None
    if fold:
        have, value = have.lower(), value.lower()
    if op == "=":
        return have == value
    if op == "|=":
        return have == value or have.startswith(f"{value}-")
    if not value:
        return False
    return value in have.split() if op == "~=" else have.startswith(value) if op == "^=" else have.endswith(value) if op == "$=" else value in have


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _compound(text: str, at: int, level: int = 0) -> tuple[Compound | None, int]:
    """A compound and the place after it; None if it has what isn't known."""
    if level > NESTED:
        return None, at
    out, begin = Compound(), at
    ids = classes = tags = 0
    while m := _PART.match(text, at):
        if m["tag"]:
            if at > begin:
                return None, at
            if m["tag"] != "*":
                out.tag, tags = _plain(m["tag"]).lower(), tags + 1
        elif m["id"]:
            out.ids.append(_plain(m["id"]))
            ids += 1
        elif m["cls"]:
            out.classes.append(_plain(m["cls"]))
            classes += 1
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
            out.attributes.append((m["attr"].lower(), m["op"] or "", value, (m["fold"] or "").lower() == "i"))
            classes += 1
        else:
            name = m["pseudo"].lower()
            if name in ("not", "is", "where", "matches") and text.startswith("(", m.end()):
                inner, end = [], m.end() + 1
                while True:
                    while text[end : end + 1].isspace():
                        end += 1
                    c, end = _compound(text, end, level + 1)
                    if c is None:
                        return None, end
                    inner.append(c)
                    while text[end : end + 1].isspace():
                        end += 1
                    if text[end : end + 1] != ",":
                        break
                    end += 1
                if text[end : end + 1] != ")":
                    return None, end
                (out.none_of if name == "not" else out.one_of).append(inner)
                if name != "where":
                    most = max(c.weight for c in inner)
                    ids, classes, tags = ids + most[0], classes + most[1], tags + most[2]
                at = end + 1
                continue
            if name == "first-child":
                out.first = True
            elif name == "root":
                out.root = True
            else:
                return None, at
            classes += 1
        at = m.end()
    out.weight = (ids, classes, tags)
    return (out if at > begin else None), at


@dataclass
class Selector:
    """Compounds from the left to the right, and what joins each with the one before."""

    compounds: list[Compound]
    joins: list[str]

    @property
    def weight(self) -> tuple[int, ...]:
        return tuple(map(sum, zip(*(c.weight for c in self.compounds), strict=True)))

    def matches(self, e: Element) -> bool:
        return self._ends(e, len(self.compounds) - 1)

    def _ends(self, e: Element, i: int) -> bool:
        """Whether the compounds up to i match with the last at e."""
        key = (id(self), i, False)
        if (found := e.known.get(key)) is None:
            found = self.compounds[i].matches(e)
            if found and i:
                join = self.joins[i - 1]
                if join == " ":
                    found = self._above(e, i - 1)
                elif join == ">":
                    found = e.parent is not None and self._ends(e.parent, i - 1)
                else:
                    found = any(self._ends(y, i - 1) for y in e.before() if join == "~" or y.place == e.place - 1)
            e.known[key] = found
        return found

    def _above(self, e: Element, i: int) -> bool:
        """Whether the compounds up to i match with the last at an element that e is in."""
        key, path, found = (id(self), i, True), [], False
        at: Element | None = e
        while at is not None:
            if (known := at.known.get(key)) is not None:
                found = known
                break
            path.append(at)
            at = at.parent
        for below in reversed(path):
            found = found or below.parent is not None and self._ends(below.parent, i)
            below.known[key] = found
        return found


def selector(text: str) -> Selector | None:
    """A selector, or None if it has what isn't known."""
    compounds, joins, at = [], [], 0
    text = text.strip()
    while True:
        c, at = _compound(text, at)
        if c is None:
            return None
        compounds.append(c)
        if len(compounds) > MOST:
            return None
        if at == len(text):
            return Selector(compounds, joins)
        m = _JOIN.match(text, at)
        if m is None or m.end() == at:
            return None
        joins.append(m[1] or " ")
        at = m.end()


def _split(text: str, by: str) -> list[str]:
    """Parts between marks that are outside of brackets and strings."""
    out, depth, quote, begin = [], 0, "", 0
    for m in re.finditer(rf"[()\[\]\"'\\{by}]", text):
        c = m[0]
        if m.start() and text[m.start() - 1] == "\\":
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == by and not depth:
            out.append(text[begin : m.start()])
            begin = m.end()
    return [*out, text[begin:]]


def declarations(style: str) -> dict[str, tuple[bool, str]]:
    """property: (whether important, value) of those that matter here; the last of the same importance counts."""
    out: dict[str, tuple[bool, str]] = {}
    low = style.lower()
    if "display" not in low and "visibility" not in low:
        return out
    for part in _split(low, ";"):
        key, _, value = part.partition(":")
        key = key.strip()
        if key in PROPERTIES:
            value, mark, tail = value.strip().partition("!")
            important = bool(mark) and tail.strip() == "important"
            value = value.strip()
            if value and (not mark or important) and (important or not out.get(key, (False, ""))[0]):
                out[key] = (important, value)
    return out


def _media(query: str) -> bool:
    return any(part.strip() in ("", "all", "screen", "only screen") for part in query.lower().split(","))


class Sheets:
    """The rules of a page's style sheets that can hide or show, by what their last compound asks for."""

    def __init__(self, sheets: list[tuple[str, str]]):
        """sheets: (media, text)."""
        self.by: dict[tuple[str, str], list[tuple]] = {}
        self.count = 0
        for media, text in sheets:
            if _media(media):
                self._read(re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", text, flags=re.DOTALL))

    def _read(self, text: str) -> None:
        stack: list[bool] = []  # of open at-rules, whether their rules count
        begin = 0
        body: tuple[str, int] | None = None  # selectors and start of the rule that is open
        for m in re.finditer(r"[{};]", text):
            c = m[0]
            if body is not None:
                if c == "{":  # nested rules aren't known
                    stack.append(False)
                    body = None
                elif c == "}":
                    if all(stack):
                        self._rule(body[0], text[body[1] : m.start()])
                    body = None
                else:
                    continue
            elif c == "{":
                head = text[begin : m.start()].strip()
                if head.startswith("@"):
                    stack.append(head[:6].lower() == "@media" and _media(head[6:]))
                else:
                    body = (head, m.end())
            elif c == "}" and stack:
                stack.pop()
            begin = m.end()

    def _rule(self, selectors: str, text: str) -> None:
        found = declarations(text)
        if not found:
            return
        for part in _split(selectors, ","):
            if (s := selector(part)) is not None:
                self.count += 1
                last = s.compounds[-1]
                key = ("id", last.ids[0]) if last.ids else ("class", last.classes[0]) if last.classes else ("tag", last.tag) if last.tag else ("", "")
                self.by.setdefault(key, []).append((s, s.weight, self.count, found))

    def style(self, e: Element) -> dict[str, str]:
        """property: value that the cascade of sheets and the style attribute gives the element."""
        best: dict[str, tuple] = {}
        keys = [("", ""), ("tag", e.tag), ("id", e.attributes.get("id", "")), *(("class", c) for c in e.classes)]
        for key in keys:
            for s, weight, order, found in self.by.get(key, ()):
                ranks = {p: (important, False, weight, order) for p, (important, _) in found.items()}
                if any(p not in best or ranks[p] > best[p][0] for p in found) and s.matches(e):
                    for p, (_, value) in found.items():
                        if p not in best or ranks[p] > best[p][0]:
                            best[p] = (ranks[p], value)
        if "style" in e.attributes:
            for p, (important, value) in declarations(e.attributes["style"]).items():
                rank = (important, True, (0, 0, 0), 0)
                if p not in best or rank > best[p][0]:
                    best[p] = (rank, value)
        return {p: value for p, (_, value) in best.items()}
