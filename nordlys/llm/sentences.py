"""Problem 4: sentence units of texts in all languages and scripts.

Method: candidate boundaries are generated (terminal marks of all scripts with
the quotes and brackets that close after them, and spaces in scripts without
terminal marks) and each is classified by a maximum-entropy model over its
neighbouring tokens, their case, length, digits and script.  What a token says
is learned from the corpus: how often it ends a paragraph against how often it
stands at a candidate, and how often the next one opens a paragraph; those
counts cover all documents, each key (63 bits of a hash of the token and its
kind) by itself.  The model is trained on reliable boundaries (paragraph breaks, clear cases of case and
digits) of at most ``TRAINING_DOCUMENTS`` documents.

Defined results
---------------
* a null or blank text has no units; any other has, and the last ends with its
  last non-blank character.
* a line without visible characters ends a unit; a single line break does not.
* ``end_char`` counts code points up to the unit's last character.
* beside the model no unit ends before a small letter, within a quotation or
  bracket that closes later, within a decimal, or at an ellipsis that no space follows.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nordlys.session import spread

#: Length of a count table without keys (small texts); documents (of at most so many characters) the model is trained on.
BUCKETS, TRAINING_DOCUMENTS, TRAINING_LENGTH = 1 << 18, 3000, 20_000
#: Contexts a worker remembers the decision of before it starts afresh.
MEMO = 300_000
#: Documents whose units are held together.
TOGETHER = 512
#: A token that ends no larger share of paragraphs than this never ends one; keys a task counts before it passes them on.
RARE, POUR = 0.005, 200_000

# Terminal marks, closing and opening marks.
TERMINALS = ".!?…。！？｡।॥؟۔‽"
CLOSING = "»”“’\")\\]」』››】）\'"
OPENING = "«“„\"'‘([「『‹【（»¿¡"
CASELESS = r"֐-ࣿऀ-෿฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯"

_BREAK = re.compile(r"(?:\r\n|\r|\n| | )[^\S\r\n  ]*(?:\r\n|\r|\n| | )\s*")
_MARK = re.compile(rf"[{re.escape(TERMINALS)};\u037e]+(?:[^\S\r\n]?[!?…]+)?(?P<close>[^\S\r\n][»](?=\s|$)|(?:[{CLOSING}]|«(?=\s|$))*(?:[.!?](?=\s|$))?)(?P<gap>\s*)")
_THAI_SPACE = re.compile(r"(?<=[฀-๿\d”\"’)])(?P<gap>[^\S\r\n]+|[^\S\r\n]*(?:\r\n|\r|\n)[^\S\r\n]*)(?=\S)")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_THAI = re.compile(r"[฀-๿]")
_CASELESS = re.compile(rf"[{CASELESS}]")
_PAIRED = re.compile(r"[()\[\]「」『』（）«»„“”\"]")
_DIGIT = re.compile(r"\d+")
_STRIP_LEFT = OPENING


@dataclass(slots=True)
class Candidate:
    end: int  # offset just behind the unit's last character, within the text
    begin: int  # offset of the next visible character, or the paragraph's end
    mark: str
    close: str
    gap: str
    kind: str  # "mark" or "space"


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines, without the white space around them."""
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        at = m.end() if m else b
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            yield a, b


def candidates(text: str, a: int, b: int) -> list[Candidate]:
    """The places within a paragraph where a unit may end, its own end left out."""
    out = []
    for m in _MARK.finditer(text, a, b):
        if text[m.start()] in ";\u037e" and not (m.start() > a and _GREEK.match(text[m.start() - 1])):
            continue  # a question mark in Greek only
        close = m["close"]
        end = m.start("gap")
        if end >= b:
            continue
        if close and not m["gap"] and close[-1] in "\"'" and text[end : end + 1].isalnum():
            opens = len(close) - len(close.rstrip("\"'"))  # a mark that opens the next unit
            end, close = end - opens, close[: len(close) - opens]
        mark = text[m.start() : m.start("close")]
        out.append(Candidate(end, m.end(), mark, close, m["gap"], "mark"))
    if _THAI.search(text, a, b):
        ends = {c.end for c in out}
        for m in _THAI_SPACE.finditer(text, a, b):
            if m.start() not in ends and (_THAI.match(text[m.start() - 1]) or _THAI.match(text[m.end()]) or text[m.start() - 1] in "”\""):
                out.append(Candidate(m.start(), m.end(), "", "", m["gap"], "space"))
        out.sort(key=lambda c: c.end)
    return out


def left_token(text: str, a: int, end: int, close: str) -> tuple[str, str]:
    """(token, the one before), normalised, of the words up to a candidate."""
    parts = text[max(a, end - 100) : end].rsplit(None, 2)
    if not parts or text[end - 1].isspace():
        token, prev = "", (parts[-1] if parts else "^")
    else:
        token, prev = parts[-1], (parts[-2] if len(parts) > 1 else "^")
    if not token.isascii() and _CASELESS.search(token):
        token, prev = token[-5:], ""
    token = _DIGIT.sub("0", token.lstrip(_STRIP_LEFT)).casefold()
    prev = _DIGIT.sub("0", prev.lstrip(_STRIP_LEFT)).casefold()
    if token[:1] != "0" and prev not in ("", "^"):  # beside other tokens only its kind counts
        prev = "d" if prev[0] == "0" else "w"
    return token, prev


def right_token(text: str, begin: int, b: int) -> tuple[str, str]:
    """(key, class) of what follows: u upper, l lower, d digit, c caseless, q opening mark, p other."""
    i, quoted = begin, ""
    word = text[i : min(b, i + 40)]
    stripped = word.lstrip(_STRIP_LEFT)
    if len(stripped) < len(word):
        quoted = "q"
    first = stripped[:1]
    if first and not first.isalnum() and " " in stripped:
        stripped = stripped.split(None, 1)[1].lstrip(_STRIP_LEFT) if len(stripped.split(None, 1)) > 1 else stripped
        first = stripped[:1] or first
        symbol = True
    else:
        symbol = False
    if not first:
        return "", "p"
    if _CASELESS.match(first):
        return stripped[:4], quoted + "c"
    token = re.split(r"[\s.,;:!?]", stripped, maxsplit=1)[0]
    if first.isdigit():
        return "0", quoted + "d"
    if first.isupper() or first.istitle():
        return token.casefold(), quoted + "u"
    if first.islower():
        return token.casefold(), quoted + "l"
    return token[:3], quoted + ("s" if symbol else "p")


def count_key(*parts: str) -> int:
    """63 bits: among ten million keys two are the same with a chance of one in 180,000."""
    return xxh64_intdigest("\0".join(parts)) >> 1


def keys(text: str, a: int, b: int, end: int, begin: int, close: str, right_end: int | None = None) -> tuple[int, int, int, str, str, str, str]:
    token, prev = left_token(text, a, end, close)
    right, kind = right_token(text, begin, right_end or b)
    return count_key("L", token), count_key("P", prev, token), count_key("R", right), token, prev, right, kind


def depth_marks(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(offset, depth from there on) of the brackets and unambiguous quotes of a paragraph."""
    found = list(_PAIRED.finditer(text, a, b))
    if not found:
        return []
    out, depth = [(a, 0)], 0
    straight = False
    opening = text.find("«", a, b)
    closing = text.find("»", a, b)
    chevrons = opening >= 0 and (closing < 0 or opening < closing)
    for mark in found:
        i = mark.start()
        ch = text[i]
        if ch in "([「『（" or ch == "«" and chevrons or ch == "„":
            depth += 1
        elif ch in ")]」』）" or ch == "»" and chevrons:
            depth = max(0, depth - 1)
        elif ch == "“":
            follows = text[i + 1 : i + 2]
            depth = depth + 1 if follows.strip() and (i == a or text[i - 1].isspace() or text[i - 1] in "([—" or _CASELESS.match(text[i - 1])) and not (depth and text[i - 1] in ".!?,") else max(0, depth - 1)
        elif ch == "”":
            depth = max(0, depth - 1)
        elif ch == "»" or ch == "«":
            opens = ch == "»"
            depth = depth + 1 if opens else max(0, depth - 1)
        elif ch == '"':
            straight = not straight
            depth = max(0, depth + (1 if straight else -1))
        else:
            continue
        out.append((i + 1, depth))
    return out


NAMES = (
    "bias", "left", "left_known", "pair", "pair_known", "right", "right_known", "lower", "upper", "digit", "caseless", "other", "quote_next", "no_gap", "newline",
    "abbreviation", "initial", "number", "number_opens", "strong", "ellipsis", "closed", "closed_strong_caseless", "inside", "space_kind", "digit_by_space", "short", "dotted", "no_gap_cased", "caseless_mark", "never", "never_pair", "ellipsis_no_gap",
)


_LOWER, _ELLIPSIS = NAMES.index("lower"), NAMES.index("ellipsis_no_gap")


class Counts:
    """Of each key how often it ended (opened) a paragraph, and how often it was seen.

    ``keys`` are sorted; without them edge and seen are tables that a key's remainder points into.
    """

    def __init__(self, edge: np.ndarray, seen: np.ndarray, keys: np.ndarray | None = None) -> None:
        self.edge, self.seen = array("d", np.asarray(edge, np.float64).tobytes()), array("d", np.asarray(seen, np.float64).tobytes())
        self.keys = None if keys is None else array("q", np.asarray(keys, np.int64).tobytes())

    def of(self, key: int) -> tuple[float, float]:
        """(edge, seen)"""
        if self.keys is None:
            at = key % len(self.seen)
        else:
            at = bisect_left(self.keys, key)
            if at == len(self.keys) or self.keys[at] != key:
                return 0.0, 0.0
        return self.edge[at], self.seen[at]


def _logit(edge: float, seen: float) -> float:
    return log((edge + 0.4) / (seen + 1.6 - edge))


def rare(edge: float, seen: float) -> bool:
    """Whether paragraphs end (open) with the token never or as good as never, whatever the corpus's size."""
    return edge <= RARE * seen


def _never(edge: float, seen: float, least: int) -> float:
    return log1p(seen) if seen >= least and rare(edge, seen) else 0.0


_STRONG = frozenset("!?。！？।؟॥｡;;")
_CLOSERS = "".join(x for x in CLOSING if x != "\\")


def features(c: Candidate, k: tuple, text: str, counts: Counts, abbreviations: frozenset[str], inside: bool, opens: bool) -> list[float]:
    left, pair, right, token, prev, _, kind = k
    of_left, of_pair, of_right = counts.of(left), counts.of(pair), counts.of(right)
    l, p, r = _logit(*of_left), _logit(*of_pair), _logit(*of_right)
    ln, pn, rn = (min(1.0, seen / 20) for _, seen in (of_left, of_pair, of_right))
    bare = token.rstrip(_CLOSERS)
    word = bare.rstrip(TERMINALS)
    strong = not _STRONG.isdisjoint(c.mark)
    caseless = "c" in kind
    cased_gapless = not c.gap and not caseless and c.kind == "mark"
    return [
        1.0, l, l * ln, p, p * pn, r, r * rn, float("l" in kind), float("u" in kind), float("d" in kind), float(caseless), float("p" in kind or "s" in kind), float("q" in kind), float(not c.gap), float("\n" in c.gap or "\r" in c.gap),
        float(bare in abbreviations or bare.lstrip("(") in abbreviations), float(len(word) == 1 and word.isalpha() and not caseless), float(word.isdigit()), float(word.isdigit() and opens), float(strong), float("…" in c.mark or ".." in c.mark), float(bool(c.close)),
        float(bool(c.close) and strong and caseless and "。" not in c.mark and "।" not in c.mark), float(inside), float(c.kind == "space"), float(c.kind == "space" and (text[c.end - 1].isdigit() or "d" in kind)), float(0 < len(word) <= 2), float("." in word), float(cased_gapless), float(c.mark[:1] in "。！？।؟॥｡" if c.mark else 0),
        _never(*of_left, 10) * (not strong and not c.close),
        _never(*of_pair, 8) * (not strong and not c.close),
        float(not c.gap and set(c.mark) <= {"…", "."} and len(c.mark) > 1 and not c.close),
    ]


def label(c: Candidate, k: tuple, x: list[float], counts: Counts) -> int | None:
    """1 or 0 where a candidate is reliable, None where it is not."""
    left, pair, right, token, prev, _, kind = k
    named = dict(zip(NAMES, x))
    if c.kind == "space":
        return 0 if named["digit_by_space"] and rare(*counts.of(right)) else None
    if "l" in kind or "p" in kind and "q" not in kind:
        return 0
    if named["inside"]:
        return 0
    if not c.gap and "d" in kind or named["ellipsis_no_gap"]:
        return 0
    if named["closed_strong_caseless"]:
        return 0
    if not c.close and c.mark == "." and "c" not in kind:
        (left_edge, left_seen), (pair_edge, pair_seen) = counts.of(left), counts.of(pair)
        if named["initial"] or named["number_opens"]:
            return 0
        if rare(left_edge, left_seen) and (left_seen >= 25 or left_seen >= 10 and (named["abbreviation"] or named["short"] or named["dotted"])):
            return 0
        if named["abbreviation"] and pair_seen >= 20 and rare(pair_edge, pair_seen):
            return 0
        if named["abbreviation"] and ("u" in kind or "d" in kind) and c.gap and pair_edge >= 0.08 * pair_seen and pair_edge >= 4:
            return 1
        if named["number"] and pair_seen >= 10 and rare(pair_edge, pair_seen):
            return 0
        if "u" in kind and not named["abbreviation"] and not named["number"] and len(token) > 4 and "." not in token[:-1] and token[:-1].isalpha():
            return 1
        return None
    if ("u" in kind or named["caseless_mark"]) and (named["strong"] or c.close):
        return 1
    return None


def _inside(marks: list[tuple[int, int]], at: int) -> int:
    lo, hi = 0, len(marks)
    while lo < hi:
        mid = (lo + hi) // 2
        if marks[mid][0] <= at:
            lo = mid + 1
        else:
            hi = mid
    return marks[lo - 1][1] if lo else 0


def count_edges(texts: Iterable[str | None], edge: np.ndarray | Counter, seen: np.ndarray | Counter) -> None:
    """Adds the paragraph ends, paragraph starts and candidates of texts to the counters (or tables)."""
    seen_here: dict[tuple, int] = {}
    edges_here: dict[tuple, int] = {}
    for text in texts:
        if not text:
            continue
        for a, b in paragraphs(text):
            tail = text[max(a, b - 6) : b]
            closing = tail[len(tail.rstrip(_CLOSERS)) :]
            cs = candidates(text, a, b)
            if text[b - 1 - len(closing) : b - len(closing)] and (text[b - 1 - len(closing)] in TERMINALS + ";;" or _THAI.match(text[b - 1])):
                token, prev = left_token(text, a, b, closing)
                edges_here[0, token, prev] = edges_here.get((0, token, prev), 0) + 1
                if cs or b - a > 30:
                    right = right_token(text, a, b)[0]
                    edges_here[1, right, ""] = edges_here.get((1, right, ""), 0) + 1
            for c in cs:
                token, prev = left_token(text, a, c.end, c.close)
                seen_here[0, token, prev] = seen_here.get((0, token, prev), 0) + 1
                right = right_token(text, c.begin, b)[0]
                seen_here[1, right, ""] = seen_here.get((1, right, ""), 0) + 1
        if len(seen_here) + len(edges_here) > 100_000:
            _pour(seen_here, seen)
            _pour(edges_here, seen, edge)
    _pour(seen_here, seen)
    _pour(edges_here, seen, edge)


def _pour(counted: dict[tuple, int], *tables: np.ndarray | Counter) -> None:
    """Adds counts by token to the counters (or tables) and empties them."""
    for (side, token, prev), n in counted.items():
        for k in (count_key("R", token),) if side else (count_key("L", token), count_key("P", prev, token)):
            for table in tables:
                table[k if isinstance(table, Counter) else k % len(table)] += n
    counted.clear()


def examples(text: str, counts: Counts, abbreviations: frozenset[str]) -> Iterator[tuple[list[float], int]]:
    """Reliable boundaries and non-boundaries of a text."""
    spans = list(paragraphs(text))
    for n, (a, b) in enumerate(spans):
        marks = depth_marks(text, a, b)
        for c in candidates(text, a, b):
            k = keys(text, a, b, c.end, c.begin, c.close)
            x = features(c, k, text, counts, abbreviations, _inside(marks, c.end) > 0, not text[a : c.end - 1].strip("0123456789"))
            y = label(c, k, x, counts)
            if y is not None:
                yield x, y
        if n + 1 < len(spans):  # the break to the next paragraph, read as a space
            tail = re.search(rf"(?P<mark>[{re.escape(TERMINALS)};;]*)(?P<close>[{CLOSING}]*)$", text[max(a, b - 12) : b])
            na, nb = spans[n + 1]
            thai = bool(_THAI.match(text[b - 1]))
            if (tail["mark"] or thai) and nb - na > 30:
                c = Candidate(b, na, tail["mark"], tail["close"], " ", "mark" if tail["mark"] else "space")
                k = keys(text, a, b, b, na, tail["close"], nb)
                yield features(c, k, text, counts, abbreviations, _inside(marks, b) > 0, False), 1


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 2e-5) -> np.ndarray:
    """Weights of the maximum-entropy model, by Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], decay * len(y))
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(h, gradient)
        w -= change
        if np.abs(change).max() < 1e-6:
            break
    return w


class Segmenter:
    def __init__(self, counts: Counts, weights: np.ndarray, abbreviations: frozenset[str]) -> None:
        self.counts, self.weights, self.abbreviations = counts, [float(w) for w in weights], abbreviations
        self.memo: dict[tuple, bool] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def ends(self, text: str | None) -> list[int]:
        """The offsets behind the last character of each unit."""
        out: list[int] = []
        memo = self.memo
        for a, b in paragraphs(text or ""):
            cs = candidates(text, a, b)
            if cs:
                marks = depth_marks(text, a, b)
                for c in cs:
                    inside = bool(marks) and marks[-1][1] == 0 and _inside(marks, c.end) > 0
                    opens = c.end - a < 6 and not text[a : c.end - 1].strip("0123456789")
                    token, prev = left_token(text, a, c.end, c.close)
                    right, kind = right_token(text, c.begin, b)
                    known = (token, prev, right, kind, c.mark, c.close, c.kind, inside, opens, "\n" in c.gap or "\r" in c.gap, not c.gap, c.kind == "space" and text[c.end - 1].isdigit())
                    ends = memo.get(known)
                    if ends is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        ends = memo[known] = self.is_end(c, token, prev, right, kind, text, inside, opens)
                    if ends:
                        out.append(c.end)
            out.append(b)
        return out

    def is_end(self, c: Candidate, token: str, prev: str, right: str, kind: str, text: str, inside: bool, opens: bool) -> bool:
        k = (count_key("L", token), count_key("P", prev, token), count_key("R", right), token, prev, right, kind)
        x = features(c, k, text, self.counts, self.abbreviations, inside, opens)
        if x[_LOWER] or x[_ELLIPSIS] or inside or not c.gap and "d" in kind and text[c.end - 1 - len(c.mark) : c.end - len(c.mark)].isdigit():  # a quotation with its brackets closed later on is one unit
            return False
        return sum(w * v for w, v in zip(self.weights, x)) > 0


def abbreviation_set(policies: DataFrame, contracts: DataFrame) -> frozenset[str]:
    """Case-folded abbreviations of both tables, each with its final period."""
    both = policies.select(F.explode("abbreviation_tokens").alias("a")).union(contracts.select(F.explode("abbreviations").alias("a")))
    # Two configuration tables; their entries are few by kind, and distinct before they are taken.
    rows = both.filter("a is not null and trim(a) <> ''").select(F.lower(F.trim("a")).alias("a")).distinct().collect()
    return frozenset(r[0].rstrip(".") + "." for r in rows)


def corpus_counts(docs: DataFrame) -> Counts:
    """Counts of every key over all documents; 24 bytes a distinct key reach the driver and are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge: Counter[int] = Counter()
        seen: Counter[int] = Counter()

        def poured() -> Iterator[pa.RecordBatch]:
            k = list(seen)
            for i in range(0, len(k), 50_000):
                part = k[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, [edge[j] for j in part], [seen[j] for j in part])], ["k", "edge", "seen"])
            edge.clear()
            seen.clear()

        for batch in batches:
            count_edges(batch.column(0).to_pylist(), edge, seen)
            if len(seen) > POUR:
                yield from poured()
        yield from poured()

    rows = docs.mapInArrow(run, "k bigint, edge bigint, seen bigint").groupBy("k").agg(F.sum("edge").alias("edge"), F.sum("seen").alias("seen")).toPandas().sort_values("k")
    return Counts(rows["edge"].to_numpy(), rows["seen"].to_numpy(), rows["k"].to_numpy())


def train(docs: DataFrame, abbreviations: frozenset[str]) -> Segmenter:
    spread_docs = spread(docs.select("doc_id", "text").filter("trim(text) <> ''"), "doc_id")
    counts = corpus_counts(spread_docs.select("text"))
    # A hash threshold first, so that what each task offers for the sample is its share and no more.
    usable = docs.filter(F.length("text").between(1, TRAINING_LENGTH))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(10**9))
    near = int(10**9 * min(1.0, 1.5 * TRAINING_DOCUMENTS / max(1, usable.count())))
    sample = usable.filter(place <= near).orderBy(place, "doc_id").limit(TRAINING_DOCUMENTS).select("text").collect()
    pairs = [e for (text,) in sample for e in examples(text, counts, abbreviations)]
    if not pairs:
        weights = np.zeros(len(NAMES))
        weights[NAMES.index("upper")] = weights[NAMES.index("strong")] = 1.0
        weights[NAMES.index("lower")] = weights[NAMES.index("inside")] = -4.0
    else:
        weights = fit(np.asarray([x for x, _ in pairs]), np.asarray([float(y) for _, y in pairs]))
    return Segmenter(counts, weights, abbreviations)


def sentence_units(docs: DataFrame, policies: DataFrame, contracts: DataFrame) -> DataFrame:
    """(doc_id, unit, start_char, end_char, text) of every unit of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, abbreviation_set(policies, contracts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = model.value
        for part in (batch.slice(at, TOGETHER) for batch in batches for at in range(0, batch.num_rows, TOGETHER)):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                at = 0
                for n, end in enumerate(segmenter.ends(text)):
                    while text[at].isspace():
                        at += 1
                    rows.append((doc, n, at, end, text[at:end]))
                    at = end
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "unit", "start_char", "end_char", "text"])

    return spread(docs.select("doc_id", "text").filter("trim(text) <> ''"), "doc_id").mapInArrow(run, "doc_id bigint, unit int, start_char int, end_char int, text string")
