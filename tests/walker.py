"""A plain walk over a parsed page: selectors, values, paths and stable selectors, to hold the column forms against."""

from __future__ import annotations

import re

from docloom.operators.html import Node, Steps, compile_css, compile_selector, parse


def contents(nodes: list[Node]) -> list[str]:
    """The whole text below each node; children come after parents, so one pass from the end suffices."""
    out = ["".join(n.text) for n in nodes]
    below: dict[int, list[str]] = {}
    for n in reversed(nodes):
        whole = out[n.id] + "".join(reversed(below.pop(n.id, [])))
        out[n.id] = whole
        below.setdefault(n.parent, []).append(whole)
    return out


class _Page:
    """A parsed page and what tests ask of it."""

    def __init__(self, tree: list[Node]):
        self.tree = tree
        self.of_type: dict[tuple[int, str], int] = {}
        self.of_all: dict[int, int] = {}
        for n in tree:
            self.of_type[n.parent, n.tag] = n.nth
            self.of_all[n.parent] = n.index
        self._whole: list[str] | None = None

    @property
    def whole(self) -> list[str]:
        if self._whole is None:
            self._whole = contents(self.tree)
        return self._whole

    def meets(self, n: Node, tests: list[tuple]) -> bool:
        return all(self._meets(n, t) for t in tests)

    def _meets(self, n: Node, t: tuple) -> bool:
        if t[0] == "tag":
            return n.tag == t[1]
        if t[0] == "attr":
            v, op, want = n.attrs.get(t[1]), t[2], t[3]
            if op == "!=":
                return v != want
            return v is not None and (
                op is None or (op == "=" and v == want) or (op == "~=" and want in v.split()) or (op == "^=" and v.startswith(want)) or (op == "$=" and v.endswith(want)) or (op == "*=" and want in v) or (op == "|=" and (v == want or v.startswith(want + "-")))
            )
        if t[0] == "place":
            _, of, a, b, last = t
            place = n.index if of == "index" else n.nth
            if last:
                place = (self.of_all[n.parent] if of == "index" else self.of_type[n.parent, n.tag]) - place + 1
            return place == b if not a else (place - b) % a == 0 and (place - b) // a >= 0
        if t[0] == "not":
            return not self.meets(n, t[1])
        if t[0] == "contains":
            return t[1] in self.whole[n.id]
        if t[0] == "text":
            return "".join(n.text) == t[1]
        if t[0] == "empty":
            return not n.children and not n.text
        return t[0] == "root" and n.parent < 0

    def matches(self, alternatives: list[Steps]) -> list[Node]:
        """Nodes in page order; steps are matched from the left, each state carried down and on once."""
        found = set()
        for steps in alternatives:
            # reached: steps matched by a node itself; above: by it or an ancestor; of a parent's children so far: the last, and any
            reached: list[int] = []
            above: list[int] = []
            previous: dict[int, int] = {}
            earlier: dict[int, int] = {}
            for n in self.tree:
                up_own, up_all = (reached[n.parent], above[n.parent]) if n.parent >= 0 else (0, 0)
                before = {">": up_own, " ": up_all, "+": previous.get(n.parent, 0), "~": earlier.get(n.parent, 0)}
                own = 0
                for i, (combinator, tests) in enumerate(steps):
                    open_ = (combinator != "^" or n.parent < 0) if i == 0 else before[combinator] >> (i - 1) & 1
                    if open_ and self.meets(n, tests):
                        own |= 1 << i
                reached.append(own)
                above.append(up_all | own)
                previous[n.parent] = own
                earlier[n.parent] = earlier.get(n.parent, 0) | own
                if own >> (len(steps) - 1) & 1:
                    found.add(n.id)
        return [n for n in self.tree if n.id in found]


def matches(tree: list[Node], selector: str) -> list[Node]:
    """Nodes that a CSS selector or a path matches, in page order."""
    return _Page(tree).matches(compile_selector(selector)[0])


def _value(n: Node, take: str | None, whole: list[str]) -> str | None:
    if take == "text":
        return "".join(n.text)
    if take:
        return n.attrs.get(take[5:])
    if n.tag == "a" and "href" in n.attrs:
        return n.attrs["href"]
    if n.tag == "img" and "src" in n.attrs:
        return n.attrs["src"]
    return whole[n.id].strip()


def paths(tree: list[Node], full: bool = False) -> list[tuple[str, str]]:
    """A CSS and an XPath path to each node, from below html or, unless ``full``, from the nearest id."""
    css: list[str] = []
    xpath: list[str] = []
    for n in tree:
        own = n.attrs.get("id")
        if n.parent < 0:
            css.append("")
            xpath.append("/")
            continue
        c = f"#{own}" if own else n.tag + (f":nth-of-type({n.nth})" if n.nth > 1 else "")
        x = f"[@id='{own}']" if own else n.tag + (f"[{n.nth}]" if n.nth > 1 else "")
        if own and not full:
            css.append(c)
            xpath.append("//*" + x)
        else:
            css.append(f"{css[n.parent]} > {c}" if css[n.parent] else c)
            xpath.append(f"{xpath[n.parent]}/{x}")
    return list(zip(css, (x if x != "/" else "//" for x in xpath), strict=True))


def unstable(name: str) -> bool:
    return re.match("(?:active|selected|hover|focus)", name) is not None


def stable_css(page: _Page, n: Node) -> str:
    """The shortest path from the node upwards that is its own; else its place among its like."""
    own = n.attrs.get("id")
    if own and re.fullmatch(r"[\w-]+", own) and len(page.matches(compile_css(f"#{own}")[0])) == 1:
        return f"#{own}"
    parts: list[str] = []
    at: Node | None = n
    while at is not None:
        kept = [c for c in at.attrs.get("class", "").split() if not unstable(c)][:2]
        part = at.tag + "".join(f".{c}" for c in kept)
        data = next(((k, v) for k, v in at.attrs.items() if k.startswith("data-") and not re.search(r"\d", v)), None)
        parts.insert(0, part + (f'[{data[0]}="{data[1]}"]' if data else ""))
        found = page.matches(compile_css(" > ".join(parts))[0])
        if len(found) == 1 and found[0] is n:
            return " > ".join(parts)
        at = page.tree[at.parent] if at.parent >= 0 else None
    return f"{n.tag}:nth-of-type({n.nth})" if page.of_type[n.parent, n.tag] > 1 else n.tag


def stable_xpath(page: _Page, n: Node) -> str:
    """Tags from the root, with places among their like, ids and first classes."""
    parts: list[str] = []
    at: Node | None = n
    while at is not None:
        part = at.tag + (f"[{at.nth}]" if page.of_type[at.parent, at.tag] > 1 else "")
        if at.attrs.get("id"):
            part += f"[@id='{at.attrs['id']}']"
        elif classes := at.attrs.get("class", "").split():
            part += f"[contains(@class, '{classes[0]}')]"
        parts.insert(0, part)
        at = page.tree[at.parent] if at.parent >= 0 else None
    return "/" + "/".join(parts)


def stable_regex(html: str, n: Node, around: int = 20) -> str:
    """The node's source as a group, between what stands before and after it."""
    before, after = html[max(0, n.start - around) : n.start], html[n.stop : n.stop + around]
    return (re.escape(before) + "\\s*" if before else "") + f"({re.escape(html[n.start : n.stop])})" + ("\\s*" + re.escape(after) if after else "")
