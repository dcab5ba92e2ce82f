"""Markup removal: wiki text to prose paragraphs, book boilerplate, reflow of hard-wrapped blocks."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from nordlys.functions.text import SPACE

# Elements that go with their content.
REMOVED = ("ref", "math", "gallery", "code", "source", "syntaxhighlight", "timeline", "score", "pre", "nowiki")
# How a line that is no prose begins.
LINE_STARTS = ("=", "*", "#", ":", ";", "|", "!", "{", "_")
# What a line with markup left over contains.
RESIDUE = ("{", "}", "[", "]", "|", "<", ">", "://", "www.")

#: The signs the scanner stops at; everything between them is text.
_SIGN = re.compile(r"""
    (?P<comment><!--) | (?P<tag></?[A-Za-z][^<>]*>)
  | (?P<table>(?:^|(?<=\n))[^\S\n]*\{\|) | (?P<untable>(?:^|(?<=\n))[^\S\n]*\|\})
  | (?P<template>\{\{) | (?P<untemplate>\}\})
  | (?P<link>\[\[) | (?P<unlink>\]\]) | (?P<site>\[(?=(?:https?|ftp)://)) | (?P<unsite>\])
  | (?P<quotes>'''?) | (?P<magic>__[A-ZÆØÅ]+__)
""", re.X)
_NAME = re.compile(r"[A-Za-z]+")


class _Open:
    """A construct that has begun: what it is, how it was written, and the plain text in it so far."""

    __slots__ = ("kind", "written", "text")

    def __init__(self, kind: str, written: str = "") -> None:
        self.kind, self.written, self.text = kind, written, []

    def unfinished(self) -> str:
        """What stands in the text if it never ends: its own sign, so that its line shows as residue; a table swallows the rest."""
        return "" if self.kind == "table" else self.written + "".join(self.text)

    def finished(self) -> str:
        whole = "".join(self.text)
        if self.kind == "site":
            return (whole.split(None, 1) + [""])[1]
        if self.kind != "link":
            return ""
        first, *rest = whole.split("|")
        if ":" in first:
            return ""
        return rest[-1] if rest else first.split("#", 1)[0]


class PlainText:
    """One pass over wiki text with a stack of open constructs."""

    #: What each closing sign ends, and constructs it can't reach out of.
    CLOSES = {"untable": ("table", ()), "untemplate": ("template", ("table",)), "unlink": ("link", ("table", "template")), "unsite": ("site", ("table", "template", "link"))}

    def __init__(self, source: str) -> None:
        self.source, self.stack = source, [_Open("page")]

    def put(self, text: str) -> None:
        self.stack[-1].text.append(text)

    def close(self, sign: str, written: str) -> bool:
        kind, walls = self.CLOSES[sign]
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].kind == kind:
                while len(self.stack) - 1 > depth:  # what began inside and did not end is text of the construct
                    inner = self.stack.pop()
                    self.put(inner.unfinished())
                ended = self.stack.pop()
                self.put(ended.finished())
                return True
            if self.stack[depth].kind in walls:
                break
        self.put(written)
        return False

    def element(self, tag: str, end: int) -> int:
        """Where reading goes on behind a tag: behind the whole element if it goes with its content."""
        name = _NAME.search(tag).group().lower()
        if name in REMOVED and tag[1] != "/":
            if tag.endswith("/>"):
                return end
            closing = re.compile(rf"</{name}\s*>", re.I).search(self.source, end)
            if closing:
                return closing.end()
        self.put(" ")
        return end

    def read(self) -> str:
        at, source = 0, self.source
        while m := _SIGN.search(source, at):
            self.put(source[at : m.start()])
            sign, written, at = m.lastgroup, m.group(), m.end()
            if sign == "comment":
                end = source.find("-->", at)
                if end < 0:
                    self.put(written)
                else:
                    at = end + 3
            elif sign == "tag":
                at = self.element(written, at)
            elif sign in self.CLOSES:
                if self.close(sign, written) and sign == "untable":
                    at = (source.find("\n", at) + 1 or len(source) + 1) - 1
            elif sign in ("table", "template", "link", "site"):
                self.stack.append(_Open(sign, written))
        self.put(source[at:])
        while len(self.stack) > 1:
            last = self.stack.pop()
            self.put(last.unfinished())
        return html.unescape("".join(self.stack[0].text))


def prose_paragraphs(wikitext: str | None) -> list[str]:
    """Prose lines of an article: no headings, lists, tables, templates, references, nor lines with residue."""
    stripped = (line.strip() for line in PlainText(wikitext or "").read().split("\n"))
    return [line for line in stripped if line and line[0] not in LINE_STARTS and not any(r in line for r in RESIDUE)]


@F.pandas_udf(ArrayType(StringType()))
def wikitext_paragraphs(text: pd.Series) -> pd.Series:
    """Nested markup needs a stack, so this runs in Arrow batches."""
    return text.map(prose_paragraphs)


def strip_boilerplate(text: Column) -> Column:
    """The work between the START and END marks of a public-domain book; all of it without marks."""
    mark = "OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
    body = F.regexp_replace(text, rf"(?is)\A.*?\*\*\*\s*START {mark}.*?\*\*\*", "")
    return F.regexp_replace(body, rf"(?is)\*\*\*\s*END {mark}.*\z", "")


def reflow(text: Column) -> Column:
    """Paragraphs of hard-wrapped text: blocks between blank lines on one line each, decorated and
    all-capital blocks left out."""
    one_line = lambda b: F.regexp_replace(b, rf"{SPACE}*[\r\n]+{SPACE}*", " ")
    blocks = F.transform(F.split(text, r"\n[ \t]*\n"), lambda b: F.regexp_replace(one_line(b), rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(blocks, lambda p: (p != "") & ~p.rlike(r"^[_*=]") & ~(p.rlike(r"\p{L}") & ~p.rlike(r"[\p{L}&&[^\p{Lu}]]")))


def unescape(text: Column) -> Column:
    return _unescape(text)


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))
