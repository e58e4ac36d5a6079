"""A small YAML: nested maps, lists of scalars and of maps, plain and quoted scalars. No anchors, multi-line blocks or flow collections but [] and {}."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: What plain scalars stand for, tried in order (fixed values: the forms that files here use).
FORMS = (
    (re.compile(r"(?:null|~)?", re.I), lambda t: None),
    (re.compile(r"true|false", re.I), lambda t: t.lower() == "true"),
    (re.compile(r"\[\]|\{\}"), json.loads),
    (re.compile(r"[-+]?[0-9]+"), int),
    (re.compile(r"[-+]?[0-9]+\.[0-9]+"), float),
    (re.compile(r"\"[^\"]*\"|'[^']*'"), lambda t: t[1:-1]),
)
#: A key with its colon; a quoted scalar; a comment, which begins a line or follows a blank.
_KEY = re.compile(r"(?P<key>\"[^\"]*\"|'[^']*'|[^\s\"'#-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?=\s|$)\s*")
_SCALAR = re.compile(r"(?P<quoted>\"[^\"]*\"|'[^']*')?(?P<plain>(?:[^\s#]|(?<=\S)#|\s+(?!#|\s|$))*)")
_ITEM = re.compile(r"-(?:\s|$)")
#: A whole line in the form that most have: blanks, at most one item, a key of word signs, and at most a plain scalar in which no mark can begin.
_LINE = re.compile(r"( *)(- )?([A-Za-z_]\w*):(?: ([^\s#:\"'-](?:[^\s#:]|:(?=\S)| (?=[^\s#]))*))?")
#: What a plain scalar that isn't a text begins with.
_FORMED = frozenset("-+0123456789nNtTfF~[{\"'")


class YamlError(ValueError):
    pass


def scalar(raw: str):
    text = raw.strip()
    if text and text[0] not in _FORMED:
        return text
    return next((made(text) for form, made in FORMS if form.fullmatch(text)), text)


def _tokens(text: str) -> Iterator[tuple[int, str, str]]:
    """(column, kind, text) of a text's marks, line by line: item, key, value."""
    for line in text.splitlines():
        if usual := _LINE.fullmatch(line):
            blanks, item, key, value = usual.groups()
            at = len(blanks)
            if item:
                yield at, "item", ""
                at += 2
            yield at, "key", key
            if value:
                yield at, "value", value
            continue
        at = len(line) - len(line.lstrip(" "))
        while at < len(line) and line[at] != "#":
            if _ITEM.match(line, at):
                yield at, "item", ""
                at += 1
            elif key := _KEY.match(line, at):
                yield at, "key", key["key"]
                at = key.end()
            else:
                value = _SCALAR.match(line, at)
                yield at, "value", (value["quoted"] or "") + value["plain"]
                at = value.end()
            at += len(line[at:]) - len(line[at:].lstrip())


def loads(text: str, strict: bool = False):
    """The document of a text; an empty one is {}. strict: a repeated key is an error, else its last value counts.

    Marks are taken as they come. An item or a key belongs to the innermost open list or map that began at its column; where there is none,
    it opens one in the place that waits for a value: the document's, or that of the last item or key.
    """
    document: list = [None]
    place: tuple | None = (document, 0)  # what waits for a value
    open_: list[tuple[int, list | dict]] = []
    for column, kind, token in _tokens(text):
        if kind == "value":
            if place is None:
                raise YamlError(f"{token!r} stands where no value can")
            place[0][place[1]], place = scalar(token), None
            continue
        wanted = list if kind == "item" else dict
        while open_ and (open_[-1][0] > column or (open_[-1][0] == column and not isinstance(open_[-1][1], wanted) and wanted is dict)):
            open_.pop()
        if not open_ or open_[-1][0] < column or not isinstance(open_[-1][1], wanted):
            if place is None:
                raise YamlError(f"nothing is open at column {column}")
            place[0][place[1]] = wanted()
            open_.append((column, place[0][place[1]]))
        into = open_[-1][1]
        if isinstance(into, list):
            into.append(None)
            place = (into, len(into) - 1)
        else:
            name = token[1:-1] if token[:1] in "\"'" else token
            if strict and name in into:
                raise YamlError(f"{name} stands twice")
            into[name] = None
            place = (into, name)
    return {} if document[0] is None else document[0]


def _plain(v) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)) or v in ([], {}):
        return json.dumps(v)
    if "\n" in v or ('"' in v and "'" in v):
        raise YamlError("a string that this YAML can't hold")
    safe = v and isinstance(scalar(v), str) and scalar(v) == v and not re.search(r"[:#\"'\[\]{}]|^\s|^-|\s$", v)
    return v if safe else f'"{v}"' if '"' not in v else f"'{v}'"


def dumps(doc, indent: int = 0) -> str:
    """A text that loads() reads back as the same document."""
    pad, out = " " * indent, []
    if isinstance(doc, dict):
        for k, v in doc.items():
            nested = isinstance(v, (dict, list)) and v
            out.append(f"{pad}{k}:\n{dumps(v, indent + 2)}" if nested else f"{pad}{k}: {_plain(v)}\n")
    else:
        for v in doc:
            if isinstance(v, dict) and v:
                head, *rest = dumps(v, indent + 2).splitlines(keepends=True)
                if isinstance(next(iter(v.values())), (dict, list)) and next(iter(v.values())):
                    out.append(f"{pad}-\n{head}{''.join(rest)}")
                else:
                    out.append(f"{pad}- {head.strip()}\n{''.join(rest)}")
            elif isinstance(v, list) and v:
                out.append(f"{pad}-\n{dumps(v, indent + 2)}")
            else:
                out.append(f"{pad}- {_plain(v)}\n")
    return "".join(out)
