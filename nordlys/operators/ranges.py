"""Segmentation that keeps every token's bytes in the raw text, and checks of such ranges.

Repairs (restored spaces, joined lines, dropped hyphens) break the one-to-one
relation of text and bytes, so the text is carried as code points with their
places.  That is sequential by nature and runs in Arrow batches.

Ranges are half-open UTF-8 byte ranges into the exact input.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nordlys.functions.text import OPENING, TERMINAL
from nordlys.operators.segmentation import Policy
from nordlys.session import enough_tasks

RANGE = "array<struct<start:bigint,end:bigint>>"
SCHEMA = f"sentence_index int, tokens array<string>, has_space_before array<boolean>, token_ranges array<{RANGE}>, sentence_ranges {RANGE}"
#: Tokens whose rows a task holds before they are handed on.
TOGETHER = 1 << 15

_TOKEN = re.compile(r"(?:https?://|www\.)\S+|[^\s@]+@[^\s@]+\.\w+|\d+(?:[.,:/\-]\d+)*|\w+(?:\.\w+)+\.?|\w+(?:[-'’]\w+)*|\S")
_MISSING = re.compile(r"(?<=[a-zæøå])[.!?…](?=[A-ZÆØÅ" + re.escape(OPENING) + "])")


class Tracked:
    """A string whose characters know their place in the input; a blank that was made has any place, since no token holds one."""

    __slots__ = ("text", "places", "offsets")

    def __init__(self, text: str, places: array, offsets: Sequence[int]) -> None:
        self.text, self.places, self.offsets = text, places, offsets

    @classmethod
    def of(cls, text: str) -> Tracked:
        offsets: Sequence[int] = range(len(text) + 1)
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (codes > 0x7F).astype("int64") + (codes > 0x7FF) + (codes > 0xFFFF)
            offsets = array("q", np.concatenate([[0], np.cumsum(sizes)]).astype("int64").tobytes())
        return cls(text, array("q", np.arange(len(text), dtype="int64").tobytes()), offsets)

    def cut(self, a: int, b: int) -> Tracked:
        return Tracked(self.text[a:b], self.places[a:b], self.offsets)

    def with_missing_spaces(self) -> Tracked:
        out, places, at = [], array("q"), 0
        for m in _MISSING.finditer(self.text):
            out += [self.text[at : m.end()], " "]
            places += self.places[at : m.end()]
            places.append(-1)
            at = m.end()
        return Tracked("".join([*out, self.text[at:]]), places + self.places[at:], self.offsets) if at else self


def paragraphs(whole: Tracked) -> Iterator[Tracked]:
    """Wrapped lines joined; each run of space is one blank."""
    parts, places = [], array("q")
    at = 0
    for line in whole.text.split("\n"):
        begin, at = at, at + len(line) + 1
        tidy = " ".join(line.split())
        if not tidy:
            if parts:
                yield Tracked("".join(parts), places, whole.offsets)
            parts, places = [], array("q")
            continue
        if tidy == line:
            own = whole.places[begin : begin + len(line)]
        else:
            own = array("q")
            for m in re.finditer(r"\S+", line):
                if own:
                    own.append(-1)
                own += whole.places[begin + m.start() : begin + m.end()]
        if parts and parts[-1][-1] not in TERMINAL + ":" and tidy[0].islower():
            if parts[-1].endswith("-"):
                parts[-1] = parts[-1][:-1]
                places.pop()
            else:
                parts.append(" ")
                places.append(-1)
            parts.append(tidy)
            places += own
        else:
            if parts:
                yield Tracked("".join(parts), places, whole.offsets)
            parts, places = [tidy], own
    if parts:
        yield Tracked("".join(parts), places, whole.offsets)


def sentences(p: Tracked, policy: Policy) -> Iterator[Tracked]:
    begin = 0
    for m in re.finditer(r"[.!?…]+(?=\s+(\S))", p.text):
        after = m.group(1)
        if not (after.isupper() or after in OPENING):
            continue
        word = p.text[p.text.rfind(" ", 0, m.start()) + 1 : m.end()]
        if word.lower() in policy.abbreviations or re.fullmatch(r"\d{1,3}\.", word):
            continue
        yield p.cut(begin, m.end())
        begin = m.end() + 1
    if p.text[begin:].strip():
        yield p.cut(begin, len(p.text))


def tokens(s: Tracked, policy: Policy) -> tuple[list[str], list[bool], list[list[tuple[int, int]]]]:
    """The tokens, whether space is before them, and their ranges; no token holds a made-up blank."""
    text, places, offsets = s.text, s.places, s.offsets
    raw = [m.span() for m in _TOKEN.finditer(text)]
    words, spaces, ranges, last, taken = [], [], [], -1, False
    for i, (a, b) in enumerate(raw):
        if taken:
            taken = False
            continue
        if i + 1 < len(raw) and text[b] == "." and raw[i + 1] == (b, b + 1):
            word = text[a:b]
            if word.lower() + "." in policy.abbreviations or word.isdigit() and len(word) <= 3 and i + 2 < len(raw):
                b, taken = b + 1, True
        begin, end = places[a], places[b - 1] + 1
        words.append(text[a:b])
        spaces.append(-1 < last < a)
        ranges.append([(offsets[begin], offsets[end])] if end - begin == b - a else coalesce([(offsets[c], offsets[c + 1]) for c in places[a:b]]))
        last = b
    return words, spaces, ranges


def coalesce(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching ranges become one; empty ones vanish."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if a == b:
            continue
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def bridge(fragments: list[tuple[int, int]], raw: bytes) -> list[tuple[int, int]]:
    """Fragments with nothing but white space between them become one range."""
    out: list[tuple[int, int]] = []
    if fragments and len(b"".join(raw[fragments[0][0] : fragments[-1][1]].split())) == sum([b - a for a, b in fragments]):
        return [(fragments[0][0], fragments[-1][1])]
    for a, b in fragments:
        if out and not raw[out[-1][1] : a].decode("utf-8", "replace").strip():
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def mapped(text: str | None, policy: Policy) -> Iterator[tuple]:
    """(tokens, spaces, token ranges, sentence ranges) of each sentence or chunk, one after the other."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    for p in paragraphs(Tracked.of(text or "").with_missing_spaces()):
        for s in sentences(p, policy):
            words, spaces, ranges = tokens(s, policy)
            for k in range(0, len(words), policy.maximum_tokens):
                end = k + policy.maximum_tokens
                yield words[k:end], [False, *spaces[k + 1 : end]], ranges[k:end], bridge(list(chain.from_iterable(ranges[k:end])), raw)


def map_text(text: str | None, policy: Policy) -> list[tuple]:
    """All that ``mapped`` gives."""
    return list(mapped(text, policy))


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype="int64")]), pa.int32()), values)


def _pairs(ranges: list[tuple[int, int]]) -> pa.Array:
    both = np.fromiter(chain.from_iterable(ranges), "int64", 2 * len(ranges)).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "end"])


def _batch(keys: pa.Array, rows: list[tuple], key: str, raw: bool) -> pa.RecordBatch:
    """Arrow columns of rows (place of the key, sentence_index, tokens, spaces, token ranges, sentence ranges, bytes), without an object a range."""
    at, index, toks, spaces, token_ranges, sentence_ranges, bytes_ = zip(*rows)
    words = list(map(len, toks))
    of_tokens = list(chain.from_iterable(token_ranges))
    columns = {
        key: keys.take(pa.array(at, pa.int64())),
        "sentence_index": pa.array(index, pa.int32()),
        "tokens": _lists(words, pa.array(list(chain.from_iterable(toks)), pa.string())),
        "has_space_before": _lists(words, pa.array(list(chain.from_iterable(spaces)), pa.bool_())),
        "token_ranges": _lists(words, _lists(list(map(len, of_tokens)), _pairs(list(chain.from_iterable(of_tokens))))),
        "sentence_ranges": _lists(list(map(len, sentence_ranges)), _pairs(list(chain.from_iterable(sentence_ranges)))),
    }
    return pa.RecordBatch.from_pydict(columns | ({"raw": pa.array(bytes_, pa.binary())} if raw else {}))


def in_parts(batches: Iterator[pa.RecordBatch], policy: Policy, key: str, raw: bool) -> Iterator[pa.RecordBatch]:
    """The rows of batches of keys and texts, those of about ``TOGETHER`` tokens at a time however many texts a batch holds."""
    for batch in batches:
        keys, texts = batch.columns
        rows, n = [], 0
        for at in range(batch.num_rows):
            text = texts[at].as_py()
            whole = text.encode("utf-8") if raw and text else b""
            for i, row in enumerate(mapped(text, policy)):
                own = row[2]
                rows.append((at, i, *row, whole[own[0][0][0] : own[-1][-1][1]]))
                n += len(own)
                if n >= TOGETHER:
                    yield _batch(keys, rows, key, raw)
                    rows, n = [], 0
        if rows:
            yield _batch(keys, rows, key, raw)


def segment_with_ranges(docs: DataFrame, policy: Policy, key: str = "doc_id", text: str = "text", raw: bool = False) -> DataFrame:
    """Runtime segmentation with byte ranges of tokens and sentences; null texts give no rows.

    With ``raw`` each row has the input's bytes from its first token to its last.
    """
    slim = enough_tasks(docs.select(key, text), key)
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(lambda batches: in_parts(batches, policy, key, raw), f"{key} {kind}, {SCHEMA}" + ", raw binary" * raw)


def clip(ranges: Column, start: Column, end: Column) -> Column:
    """Ranges cut to [start, end); what lies outside goes."""
    return F.filter(F.transform(ranges, lambda r: F.struct(F.greatest(r["start"], start).alias("start"), F.least(r["end"], end).alias("end"))), lambda r: r["start"] < r["end"])


def ranges_valid(tokens_: Column, token_ranges: Column) -> Column:
    """One list a token; every range non-empty, ordered, and none overlapping another of the sentence."""
    flat = F.flatten(token_ranges)
    # Neighbours as two arrays: within a lambda the flat array would be made anew for every range.
    rest = F.greatest(F.size(flat) - 1, F.lit(0))
    ordered = F.forall(F.zip_with(F.slice(flat, 1, rest), F.slice(flat, 2, rest), lambda x, y: x["end"] <= y["start"]), lambda x: x)
    return (F.size(tokens_) == F.size(token_ranges)) & F.forall(flat, lambda r: r["start"] < r["end"]) & ordered


def utf16_offset(text: str, at: int) -> int:
    """UTF-16 code units before a UTF-8 byte offset; inside a character is an error."""
    raw = text.encode("utf-8")
    if not 0 <= at <= len(raw):
        raise ValueError("offset outside the text")
    return len(raw[:at].decode("utf-8").encode("utf-16-le")) // 2


def utf8_offset(text: str, at: int) -> int:
    """UTF-8 bytes before a UTF-16 offset; inside a surrogate pair is an error."""
    starts, u, b = [0], 0, [0]
    for ch in text:
        u += 2 if ord(ch) > 0xFFFF else 1
        starts.append(u)
        b.append(b[-1] + len(ch.encode("utf-8")))
    k = bisect_right(starts, at) - 1
    if k < 0 or starts[k] != at:
        raise ValueError("no character boundary")
    return b[k]
