"""CSS and XPath selectors as column expressions over the nodes of a page.

A selector is cut into tokens by one grammar for each language; what the grammar leaves over raises ValueError. It becomes a path: steps along
an axis, each with a test and predicates. A step takes an array of places and gives, for each, the nodes of its axis that
fit, in the axis' order, so that positions count as they do in XPath; the union is sorted by place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that str.strip() takes off.
BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

#: node, position (from 1), how many there are, nodes of the page -> whether it fits
Test = Callable[[Column, Column, Column, Column], Column]


def is_element(n: Column) -> Column:
    return n["tag"].isNotNull() & ~n["tag"].isin("", "!--")


def below(nodes: Column, n: Column) -> Column:
    """The nodes below n, which lie right behind it."""
    return F.slice(nodes, n["place"] + 2, n["last"] - n["place"])


def text_below(nodes: Column, n: Column) -> Column:
    """All text in n, as it stands."""
    inside = F.filter(below(nodes, n), lambda t: t["tag"].isNull())
    return F.when(n["tag"].isNull(), n["text"]).otherwise(F.array_join(F.transform(inside, lambda t: t["text"]), ""))


@dataclass
class Step:
    axis: str
    test: Test
    predicates: list[Test] = field(default_factory=list)
    #: whether a predicate counts positions
    counts: bool = False


@dataclass
class Path:
    steps: list[Step]
    absolute: bool = True
    #: what is read from the last nodes: the element, "text()", or "@name"
    reads: str = ""
    #: (path)[n]
    nth: int | None = None

    def places(self, nodes: Column, start: Column) -> Column:
        at = F.array(F.lit(0)) if self.absolute else start
        for step in self.steps:
            at = _walk(nodes, at, step)
        if self.nth is not None:
            at = F.slice(at, self.nth or 1, 1 if self.nth else 0)  # there is no 0th
        return at

    def strings(self, nodes: Column, start: Column) -> Column:
        """String values, for comparisons."""
        if self.reads.startswith("@"):
            return F.filter(F.transform(self.places(nodes, start), lambda p: F.try_element_at(F.get(nodes, p)["attrs"], F.lit(self.reads[1:]))), lambda v: v.isNotNull())
        return F.transform(self.places(nodes, start), lambda p: text_below(nodes, F.get(nodes, p)))


def _walk(nodes: Column, at: Column, step: Step) -> Column:
    def along(p: Column) -> Column:
        c = F.get(nodes, p)
        on = step.axis
        if on in ("child", "descendant", "descendant-or-self"):
            area = below(nodes, c)
            if on == "descendant-or-self":
                area = F.concat(F.array(c), area)
            fit = lambda n: (n["parent"] == p) if on == "child" else F.lit(True)
        elif on == "self":
            area, fit = F.array(c), lambda n: F.lit(True)
        elif on in ("parent", "ancestor", "ancestor-or-self"):
            area = F.slice(nodes, 1, p + 1)
            fit = {"parent": lambda n: n["place"] == c["parent"], "ancestor": lambda n: (n["last"] >= p) & (n["place"] < p), "ancestor-or-self": lambda n: n["last"] >= p}[on]
        elif on in ("following-sibling", "following"):
            area = F.slice(nodes, c["last"] + 2, F.size(nodes))
            fit = (lambda n: n["parent"] == c["parent"]) if on == "following-sibling" else lambda n: F.lit(True)
        else:  # preceding-sibling, preceding
            area = F.slice(nodes, 1, p)
            fit = (lambda n: n["parent"] == c["parent"]) if on == "preceding-sibling" else lambda n: n["last"] < p
        one = F.lit(1)
        found = F.filter(area, lambda n: fit(n) & step.test(n, one, one, nodes))
        if on in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling"):
            found = F.reverse(found)
        for predicate in step.predicates:
            found = _kept(found, predicate, nodes)
        return F.transform(found, lambda n: n["place"])

    return F.array_sort(F.array_distinct(F.flatten(F.transform(at, along))))


def _kept(found: Column, predicate: Test, nodes: Column) -> Column:
    return F.filter(found, lambda n, i: F.coalesce(predicate(n, i + 1, F.size(found), nodes), F.lit(False)))


def _all(tests: list[Test]) -> Test:
    def test(n: Column, i: Column, size: Column, nodes: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t(n, i, size, nodes), F.lit(False))
        return out

    return test


def _named(tag: str) -> Test:
    if tag == "*":
        return lambda n, i, s, nodes: is_element(n)
    return lambda n, i, s, nodes: n["tag"] == F.lit(tag.lower())


def _own(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name.lower()))


class _Tokens:
    def __init__(self, grammar: str, text: str) -> None:
        self.text, self.items, at = text, [], 0
        for m in re.compile(grammar, re.VERBOSE).finditer(text):
            if m.start() != at:
                break
            at = m.end()
            if m.lastgroup != "space":
                self.items.append((m.lastgroup, m[m.lastgroup]))
        if at != len(text) or not text.strip():
            raise ValueError(f"selector {text!r} is not understood at {text[at : at + 20]!r}")
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def take(self, *values: str) -> str | None:
        return self.next()[1] if self.peek()[0] not in ("string", "end") and self.peek()[1] in values else None

    def need(self, value: str) -> None:
        if self.take(value) is None:
            self.fail()

    def fail(self) -> None:
        raise ValueError(f"selector {self.text!r} is not understood at {self.peek()[1]!r}")


# ---- CSS

_CSS = r"""
(?P<string> "[^"\\]*" | '[^'\\]*') | (?P<number> [+-]?\d+ (?![\w-]) ) | (?P<nth> [+-]?\d*n (?: \s*[+-]\s*\d+ )? (?![\w-]) ) | (?P<hash> \#[\w-]+ ) | (?P<class> \.[\w-]+ )
| (?P<name> [^\W\d][\w-]* | -[^\W\d][\w-]* ) | (?P<op> ::? | [~^$*|]?= | [\[\]()*] ) | (?P<comb> \s*[>+~,]\s* | \s+ )
"""


def _compare(value: Column, op: str, wanted: str) -> Column:
    lit = F.lit(wanted)
    if op in ("^=", "$=", "*=", "~=") and not wanted:
        return F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(value, r"\s+"), wanted)
    if op == "|=":
        return (value == lit) | F.startswith(value, F.lit(wanted + "-"))
    return {"=": lambda: value == lit, "^=": lambda: F.startswith(value, lit), "$=": lambda: F.endswith(value, lit), "*=": lambda: F.contains(value, lit)}[op]()


def _nth(text: str) -> tuple[int, int]:
    text = re.sub(r"\s", "", text).lower()
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
    if m:
        return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return 0, int(text)


def _places(field_name: str, a: int, b: int) -> Test:
    def test(n: Column, i: Column, size: Column, nodes: Column) -> Column:
        k = n[field_name] - b
        return k == 0 if a == 0 else (k % abs(a) == 0) & ((k >= 0) if a > 0 else (k <= 0))

    return test


_CSS_PLACES = {"first-child": ("child", 0, 1), "last-child": ("child_end", 0, 1), "first-of-type": ("nth", 0, 1), "last-of-type": ("nth_end", 0, 1)}
_CSS_NTH = {"nth-child": "child", "nth-last-child": "child_end", "nth-of-type": "nth", "nth-last-of-type": "nth_end"}


def _css_pseudo(t: _Tokens, name: str) -> Test:
    if name in _CSS_PLACES:
        return _places(*_CSS_PLACES[name])
    if name in ("only-child", "only-of-type"):
        ends = ("child", "child_end") if name == "only-child" else ("nth", "nth_end")
        return _all([_places(e, 0, 1) for e in ends])
    if name == "empty":
        return lambda n, i, s, nodes: F.size(F.filter(below(nodes, n), lambda x: x["tag"].isNull() | (x["tag"] != "!--"))) == 0
    if name == "root":
        return lambda n, i, s, nodes: n["parent"] == 0
    if name not in (*_CSS_NTH, "not", "contains"):
        raise ValueError(f"selector {t.text!r}: :{name} is not understood")
    t.need("(")
    if name == "not":
        inner = _css_compound(t)
        t.need(")")
        return lambda n, i, s, nodes: ~F.coalesce(inner(n, i, s, nodes), F.lit(False))
    kind, value = t.next()
    if name == "contains" and kind in ("string", "name"):
        test: Test = lambda n, i, s, nodes: F.contains(text_below(nodes, n), F.lit(value.strip("\"'")))
    elif name in _CSS_NTH and (kind in ("number", "nth") or value in ("odd", "even")):
        test = _places(_CSS_NTH[name], *_nth(value))
    else:
        t.fail()
    t.need(")")
    return test


def _css_compound(t: _Tokens) -> Test:
    """A tag and its conditions."""
    tests: list[Test] = [lambda n, i, s, nodes: is_element(n)]
    any_yet = False
    while True:
        kind, value = t.peek()
        if kind == "name" and not any_yet or value == "*" and not any_yet:
            t.next()
            tests.append(_named(value))
        elif kind == "hash":
            t.next()
            tests.append(lambda n, i, s, nodes, v=value[1:]: _own(n, "id") == F.lit(v))
        elif kind == "class":
            t.next()
            tests.append(lambda n, i, s, nodes, v=value[1:]: F.array_contains(F.split(_own(n, "class"), r"\s+"), v))
        elif value == "[" and kind == "op":
            t.next()
            _, name = t.next()
            op = t.take("=", "~=", "|=", "^=", "$=", "*=")
            if op:
                kind, wanted = t.next()
                if kind not in ("string", "name", "number"):
                    t.fail()
                tests.append(lambda n, i, s, nodes, a=name, o=op, w=wanted[1:-1] if kind == "string" else wanted: _compare(_own(n, a), o, w))
            else:
                tests.append(lambda n, i, s, nodes, a=name: _own(n, a).isNotNull())
            t.need("]")
        elif value == ":" and kind == "op":
            t.next()
            kind, name = t.next()
            if kind != "name":
                t.fail()
            tests.append(_css_pseudo(t, name))
        else:
            break
        any_yet = True
    if not any_yet:
        t.fail()
    return _all(tests)


def _css(text: str) -> list[Path]:
    t, paths = _Tokens(_CSS, text.strip()), []
    while True:
        steps, axis, reads = [], "descendant", ""
        adjacent = False
        while True:
            test = _css_compound(t)
            predicates: list[Test] = []
            if adjacent:  # the next element, and that must fit
                steps.append(Step("following-sibling", _named("*"), [lambda n, i, s, nodes: i == 1], True))
                axis = "self"
            steps.append(Step(axis, test, predicates))
            kind, value = t.peek()
            if value == "::" and kind == "op":
                t.next()
                _, name = t.next()
                if name == "attr":
                    t.need("(")
                    reads = "@" + t.next()[1].lower()
                    t.need(")")
                elif name == "text":
                    steps.append(Step("child", _text_node))
                    reads = "text()"
                else:
                    t.fail()
                kind, value = t.peek()
            if kind == "comb" and value.strip() != "," and not reads:
                t.next()
                adjacent = value.strip() == "+"
                axis = {">": "child", "~": "following-sibling"}.get(value.strip(), "descendant")
                continue
            break
        paths.append(Path(steps, reads=reads))
        if kind == "end":
            return paths
        if not (kind == "comb" and value.strip() == ","):
            t.fail()
        t.next()


# ---- XPath

_XPATH = r"""
(?P<space> \s+ ) | (?P<string> "[^"]*" | '[^']*' ) | (?P<number> \d+(?:\.\d+)? ) | (?P<name> [^\W\d][\w.-]* ) | (?P<op> // | :: | \.\. | != | <= | >= | [/@*.()\[\],|=<>] )
"""
_AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "following", "preceding-sibling", "preceding")


def _text_node(n: Column, i: Column, size: Column, nodes: Column) -> Column:
    return n["tag"].isNull()


def _any_node(n: Column, i: Column, size: Column, nodes: Column) -> Column:
    return F.lit(True)


def _xpath_paths(t: _Tokens, inside: bool = False) -> list[Path]:
    paths = [_xpath_path(t, inside)]
    while t.take("|"):
        paths.append(_xpath_path(t, inside))
    return paths


def _xpath_path(t: _Tokens, inside: bool) -> Path:
    if not inside and t.take("("):
        path = _xpath_path(t, inside)
        t.need(")")
        if t.take("["):
            if t.take("last"):
                t.need("(")
                t.need(")")
                path.nth = -1
            else:
                kind, value = t.next()
                if kind != "number" or path.nth is not None:
                    t.fail()
                path.nth = int(value)
            t.need("]")
        if t.peek()[1] in ("/", "//"):
            t.fail()
        return path
    steps: list[Step] = []
    absolute = t.peek()[1] in ("/", "//") and t.peek()[0] == "op"
    path = Path(steps, absolute=absolute or not inside)
    far = (t.take("//", "/") or "/") == "//" if absolute else not inside and t.peek()[1] not in (".", "..", "@")
    while True:
        if t.take("@"):
            kind, name = t.next()
            if kind != "name":
                t.fail()
            if far:
                steps.append(Step("descendant-or-self", _named("*")))
            path.reads = "@" + name.lower()
            return path
        if t.take("."):
            steps.append(Step("descendant-or-self" if far else "self", _any_node))
        elif t.take(".."):
            if far:
                steps.append(Step("descendant-or-self", _any_node))
            steps.append(Step("parent", _any_node))
        else:
            axis = "child"
            if t.peek(1)[1] == "::" and t.peek(1)[0] == "op":
                axis = t.next()[1]
                t.need("::")
                if axis not in _AXES:
                    t.fail()
            kind, name = t.next()
            if name in ("text", "node") and t.take("("):
                t.need(")")
                test, reads = (_text_node, "text()") if name == "text" else (_any_node, "")
            elif kind == "name" or name == "*":
                test, reads = _named(name), ""
            else:
                t.at -= 1
                t.fail()
            predicates, counting = [], []
            while t.take("["):
                counted: list[bool] = []
                predicates.append(_xpath_or(t, counted))
                counting.append(bool(counted))
                t.need("]")
            if far and axis == "child" and not any(counting):
                axis = "descendant"  # the same, in one step
            elif far:
                steps.append(Step("descendant-or-self", _any_node))
            steps.append(Step(axis, test, predicates, any(counting)))
            path.reads = reads
        if not (t.peek()[0] == "op" and t.peek()[1] in ("/", "//")):
            return path
        far = t.next()[1] == "//"


def _xpath_or(t: _Tokens, counted: list[bool]) -> Test:
    tests = [_xpath_and(t, counted)]
    while t.take("or"):
        tests.append(_xpath_and(t, counted))
    if len(tests) == 1:
        return tests[0]
    return lambda n, i, s, nodes: F.exists(F.array(*(F.coalesce(x(n, i, s, nodes), F.lit(False)) for x in tests)), lambda v: v)


def _xpath_and(t: _Tokens, counted: list[bool]) -> Test:
    tests = [_xpath_comparison(t, counted)]
    while t.take("and"):
        tests.append(_xpath_comparison(t, counted))
    return tests[0] if len(tests) == 1 else _all(tests)


@dataclass
class _Value:
    """kind: number, string, strings (of a node set) or boolean; of: its column for a node."""

    kind: str
    of: Test
    #: a number that stands alone is a position
    literal: bool = False


def _true(v: _Value, counted: list[bool]) -> Test:
    if v.kind == "number":
        counted.append(True)
        return lambda n, i, s, nodes: i == v.of(n, i, s, nodes)
    if v.kind == "string":
        return lambda n, i, s, nodes: v.of(n, i, s, nodes) != ""
    if v.kind == "strings":
        return lambda n, i, s, nodes: F.size(v.of(n, i, s, nodes)) > 0
    return v.of


def _xpath_comparison(t: _Tokens, counted: list[bool]) -> Test:
    left = _xpath_value(t, counted)
    op = t.take("=", "!=", "<", "<=", ">", ">=")
    if not op:
        return _true(left, counted)
    right = _xpath_value(t, counted)
    if left.kind == "boolean" or right.kind == "boolean":
        t.fail()
    as_number = "number" in (left.kind, right.kind) or op not in ("=", "!=")
    plain = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]

    def cast(c: Column, kind: str) -> Column:
        return c if kind == "number" or not as_number else F.trim(c).try_cast("double")

    def test(n: Column, i: Column, s: Column, nodes: Column) -> Column:
        a, b = (v.of(n, i, s, nodes) for v in (left, right))
        many_a = a if left.kind == "strings" else F.array(a)
        many_b = b if right.kind == "strings" else F.array(b)
        return F.exists(many_a, lambda x: F.exists(many_b, lambda y: F.coalesce(plain(cast(x, left.kind), cast(y, right.kind)), F.lit(False))))

    return test


def _string(v: _Value) -> Test:
    if v.kind == "strings":
        return lambda n, i, s, nodes: F.coalesce(F.get(v.of(n, i, s, nodes), F.lit(0)), F.lit(""))
    return lambda n, i, s, nodes: v.of(n, i, s, nodes).cast("string")


def _xpath_value(t: _Tokens, counted: list[bool]) -> _Value:
    kind, value = t.peek()
    if kind == "string":
        t.next()
        return _Value("string", lambda n, i, s, nodes: F.lit(value[1:-1]))
    if kind == "number":
        t.next()
        return _Value("number", lambda n, i, s, nodes: F.lit(float(value)))
    if value == "(" and kind == "op":
        t.next()
        inner = _xpath_or(t, counted)
        t.need(")")
        return _Value("boolean", inner)
    if kind == "name" and t.peek(1) == ("op", "(") and value not in ("text", "node"):
        t.next()
        t.next()
        return _xpath_function(t, value, counted)
    paths = _xpath_paths(t, inside=True)
    return _Value("strings", lambda n, i, s, nodes: F.flatten(F.array(*(p.strings(nodes, F.array(n["place"])) for p in paths))))


def _xpath_function(t: _Tokens, name: str, counted: list[bool]) -> _Value:
    arguments: list[_Value] = []
    if name == "not":
        inner = _xpath_or(t, counted)
        t.need(")")
        return _Value("boolean", lambda n, i, s, nodes: ~F.coalesce(inner(n, i, s, nodes), F.lit(False)))
    if not t.take(")"):
        arguments.append(_xpath_value(t, counted))
        while t.take(","):
            arguments.append(_xpath_value(t, counted))
        t.need(")")
    texts = [_string(a) for a in arguments]
    own: Test = lambda n, i, s, nodes: text_below(nodes, n)
    two = {"contains": F.contains, "starts-with": F.startswith}
    if name in two and len(texts) == 2:
        return _Value("boolean", lambda n, i, s, nodes: two[name](texts[0](n, i, s, nodes), texts[1](n, i, s, nodes)))
    if name in ("normalize-space", "string-length", "string") and len(texts) < 2:
        of = texts[0] if texts else own
        if name == "string":
            return _Value("string", of)
        if name == "string-length":
            return _Value("number", lambda n, i, s, nodes: F.length(of(n, i, s, nodes)))
        return _Value("string", lambda n, i, s, nodes: F.trim(F.regexp_replace(of(n, i, s, nodes), r"[ \t\r\n]+", " ")))
    if name in ("position", "last") and not texts:
        counted.append(True)
        return _Value("number", (lambda n, i, s, nodes: i) if name == "position" else lambda n, i, s, nodes: s)
    if name == "count" and len(arguments) == 1 and arguments[0].kind == "strings":
        return _Value("number", lambda n, i, s, nodes: F.size(arguments[0].of(n, i, s, nodes)))
    if name in ("name", "local-name") and not texts:
        return _Value("string", lambda n, i, s, nodes: n["tag"])
    raise ValueError(f"selector {t.text!r}: {name}() is not understood")


def is_xpath(selector: str) -> bool:
    return selector.lstrip().startswith(("/", "./", "(", ".."))


def paths(selector: str) -> list[Path]:
    """The paths that a CSS or XPath selector (or a union of them) is; ValueError if it is not understood."""
    selector = selector.strip()
    for prefix, read in (("xpath=", _xpath), ("css=", _css)):
        if selector.startswith(prefix):
            return read(selector.removeprefix(prefix))
    return _xpath(selector) if is_xpath(selector) else _css(selector)


def _xpath(selector: str) -> list[Path]:
    t = _Tokens(_XPATH, selector.strip())
    found = _xpath_paths(t)
    if t.peek()[0] != "end":
        t.fail()
    return found
