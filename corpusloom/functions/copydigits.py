"""Digits in what a page shows: text, attribute values, strings in code. Numbers in code, comments and style blocks don't count.

A pushdown machine reads a page's source: each kind of place (markup, tag, code, template string) has one pattern of tokens, and a token opens a
place, closes one, or is looked at for digits. A place can't reach beyond its limit (the end of a script, of the front matter or of the source),
where all that is still open closes. One pass, in time about linear in the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attributes whose values aren't shown, starts of such names, starts of strings that are paths, tags without an end.
HIDDEN = {"href", "src", "class", "id", "charset", "content", "name", "rel", "lang", "type", "style", "viewBox", "width", "height", "key"}
HIDDEN_STARTS = ("data-", "is:", "client:", "set:")
PATHS = ("/", "./", "../", "#", "http")
VOID = {"meta", "br", "img", "input", "hr", "link", "source", "area", "base", "col", "embed", "wbr", "track", "param"}
#: What code stands before markup that begins in it.
BEFORE_MARKUP = re.compile(r"(?:\A|[(,=?:&|{\[>;]|return)\s*\Z")

_DIGIT = re.compile(r"\d")
TOKENS = {
    "markup": re.compile(r"(?P<skip><!--(?:.*?-->|.*))|(?P<declaration><!(?:[^>]*>|.*))|(?P<tag></?(?=[A-Za-z>/])(?P<name>[A-Za-z0-9:_.\-]*))|(?P<code>\{)|(?P<text>[^<{]+|<)", re.S),
    "tag": re.compile(r"(?P<blank>\s+)|(?P<end>/?>)|(?P<code>=?\{)|(?P<value>(?P<attr>[^\s=>/]*)=(?:\"(?P<q>[^\"]*)\"?|'(?P<a>[^']*)'?|(?=\{)|[^\s>\"'{][^\s>]*|))|(?P<bare>[^\s=>/]+)|(?P<slash>/)", re.S),
    "code": re.compile(r"(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)|(?P<skip>//[^\n]*|/\*(?:.*?\*/|.*))|(?P<open>\{)|(?P<close>\})|(?P<markup><(?=[A-Za-z>]))|(?P<other>[^\"'`/{}<]+|.)", re.S),
    "template": re.compile(r"(?P<escaped>\\.?)|(?P<end>`)|(?P<code>\$\{)|(?P<other>[^\\`$]+|\$)", re.S),
}


@dataclass
class Place:
    kind: str
    limit: int
    #: Where to go on when the limit is reached; only the place that set the limit has one.
    after: int | None = None
    #: Start of the text or of the string's piece that is being read.
    start: int = 0
    #: Open braces of code, open tags of markup in code (None: markup of the page).
    depth: int | None = None
    name: str = ""
    closing: bool = False
    hidden: bool | None = None


class Machine:
    def __init__(self, source: str):
        self.source, self.found = source, set()
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.stack = [Place("markup", len(source))]
        self.at = 0
        head = re.match(r"---\n(?:(.*?)\n)??---\n", source, re.S)
        if head:
            self.stack[0].start = head.end()
            self.stack.append(Place("code", head.end() - 4, head.end(), depth=0))
            self.at = 4

    def look(self, start: int, end: int) -> None:
        """Digits of a piece, line by line."""
        for line in self.source[start:end].split("\n"):
            if m := _DIGIT.search(line):
                self.found.add((bisect_right(self.lines, start + m.start()), line.strip()))
            start += len(line) + 1

    def look_whole(self, start: int, end: int) -> None:
        """The first digit of a value, told with the whole value."""
        if m := _DIGIT.search(self.source, start, end):
            self.found.add((bisect_right(self.lines, m.start()), self.source[start:end].strip()))

    def is_path(self, start: int, end: int, quote: int) -> bool:
        """A path, or a string on a line that imports."""
        line = self.source[self.source.rfind("\n", 0, quote) + 1 : quote].lstrip()
        return self.source.startswith(PATHS, start, end) or line.startswith("import") or (line.startswith("export") and " from" in line)

    def run(self) -> list[tuple[int, str]]:
        while self.stack:
            place = self.stack[-1]
            if self.at >= place.limit:
                self.leave(place)
                continue
            token = TOKENS[place.kind].match(self.source, self.at, place.limit)
            began, self.at = self.at, token.end()
            getattr(self, place.kind)(place, token, token.lastgroup if token.lastgroup not in ("name", "attr", "q", "a") else "", began)
        return sorted(self.found)

    def leave(self, place: Place) -> None:
        self.stack.pop()
        if place.kind == "markup":
            self.look(place.start, min(self.at, place.limit))
        if place.after is not None:
            self.at = place.after
        if self.stack:
            self.stack[-1].start = self.at

    def inner(self, kind: str, **more) -> None:
        self.stack.append(Place(kind, self.stack[-1].limit, start=self.at, **more))

    def markup(self, place: Place, token: re.Match, _: str, began: int) -> None:
        if token["text"]:
            return
        self.look(place.start, began)
        place.start = self.at
        if token["code"]:
            self.inner("code", depth=0)
        elif token["tag"]:
            self.inner("tag", name=token["name"], closing=token["tag"].startswith("</"))

    def tag(self, place: Place, token: re.Match, _: str, began: int) -> None:
        name = token["attr"] if token["value"] else token["bare"]
        if name == "set:html":
            self.found.add((bisect_right(self.lines, began), name))
        if token["end"]:
            self.tag_ends(place, token["end"] == "/>")
        elif token["code"]:
            self.inner("code", depth=0)
        elif token["value"]:
            for quote in "qa":
                if token[quote] and name not in HIDDEN and not name.startswith(HIDDEN_STARTS):
                    self.look_whole(*token.span(quote))

    def tag_ends(self, tag: Place, alone: bool) -> None:
        self.stack.pop()
        around, name = self.stack[-1], tag.name.lower()
        raw = name in ("script", "style") and not tag.closing and not alone
        end = re.compile(rf"</{name}\s*>", re.I).search(self.source, self.at, around.limit) if raw else None
        stop, after = (end.span() if end else (around.limit, around.limit)) if raw else (self.at, self.at)
        around.start = after
        if around.depth is not None:
            around.depth += -1 if tag.closing else 0 if alone or raw or name in VOID else 1
            if around.depth <= 0:
                self.stack.pop()
        if name == "script" and raw:
            self.stack.append(Place("code", stop, after, depth=0))
        else:
            self.at = after

    def code(self, place: Place, token: re.Match, kind: str, began: int) -> None:
        if kind == "string":
            end = self.at - 1 if self.at > began + 1 and self.source[self.at - 1] == self.source[began] else self.at
            if not self.is_path(began + 1, end, began):
                self.look_whole(began + 1, end)
        elif kind == "template":
            self.inner("template")
        elif kind == "open":
            place.depth += 1
        elif kind == "close":
            place.depth -= 1
            if place.depth < 0 and place.after is None:
                self.stack.pop()
                self.stack[-1].start = self.at
        elif kind == "markup" and BEFORE_MARKUP.search(self.source, max(0, self.source.rfind("\n", 0, began - 200)), began):
            self.at = began
            self.inner("markup", depth=0)

    def template(self, place: Place, token: re.Match, kind: str, began: int) -> None:
        if kind not in ("end", "code"):
            return
        if place.hidden is None:
            place.hidden = self.is_path(place.start, began, place.start)
        if not place.hidden:
            self.look_whole(place.start, began)
        if kind == "code":
            self.inner("code", depth=0)
        else:
            self.stack.pop()


def copy_digits(source: str | None) -> list[tuple[int, str]]:
    """(line, text) of digits in what a page shows, by line, then text."""
    return Machine(source).run() if source else []


def scan(pages: DataFrame, key: str, source: Column) -> DataFrame:
    """key, found (array of line, text) of each page; a null or empty source has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([("line", pa.int32()), ("text", pa.string())])
        for batch in batches:
            told = [[{"line": n, "text": t} for n, t in copy_digits(s)] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(one))], ["key", "found"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("key"), source.alias("source")).mapInArrow(run, f"key {kind}, found array<struct<line:int,text:string>>")
    return found.select(F.col("key").alias(key), "found")
