"""Problem 3: text of scanned pages becomes continuous, readable paragraphs.

Method: a vocabulary trie built from the clean corpus is intersected with a
Levenshtein automaton of the reading.  The automaton allows any insertions,
deletions and substitutions up to a distance, and beside them the known
confusions of scanning, which cost less; the intersection gives every
vocabulary word within both bounds.  Candidates are ranked by the words on
either side (how often the clean corpus has the candidate beside them), then by
the cost of the edits and by frequency.  A reading whose only candidates need
other edits than confusions is a misreading if it holds letter groups no word
has and its context speaks for the candidate.  Words outside the vocabulary
(compounds, names) are judged by the character n-grams of the same vocabulary.
Running headers are found by their recurrence on near pages of the work or by
its title, page numbers by the page's own number; what is left is joined over
line and page breaks and reflowed.

The vocabulary holds all words that occur at least twice in the clean corpus and
those of the scans, at least five times, that are no reading of others.  It grows
with the corpus's words and is broadcast, like the counts of the word pairs that
a reading and its candidates make with their neighbours (8 bytes for each pair
looked for); its trie keeps only the branchings.  Pages are handled in blocks of a
work's page numbers with a margin (a page without a number by itself), so no task
holds a whole work.

Defined results
---------------
* exact repeats of a page_id count once (the longest text); rows without
  page_id are skipped; null or empty texts have no lines.
* a page without a readable number has no page-number lines and no neighbours;
  its paragraphs are its own, page and last_page null, counted from 0 on each page.
* each page_id counts for itself; a page scanned twice is read once in the
  paragraphs (its lowest page_id).
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nordlys.session import input_bytes, materialize, small

#: Occurrences a word of the clean corpus (of the scans) needs to be in the vocabulary.
LEAST, LEAST_SCANNED = 2, 5
#: Page numbers a block, pages of margin on either side.
BLOCK, MARGIN = 32, 6
#: Confusions a candidate may be away; what another edit costs in confusions; letters from which a reading may be one (two) other edits away.
MOST, EDIT_COST, ONE_EDIT, TWO_EDITS = 4, 3, 4, 10
#: Times a true word is as frequent as its misreading at least, both counted in the scans.
OFTENER = 20
#: Bytes of the scans behind a task, and of the texts parted at once.
TASK_BYTES, PIECE_BYTES = 16 << 20, 8 << 20

# Readings of scanning and what they stand for.
CONFUSIONS = (
    ("lc", "k"), ("cl", "d"), ("rn", "m"), ("ii", "u"), ("f", "t"), ("f", "r"), ("u", "n"), ("c", "e"), ("o", "ø"), ("a", "å"),
    ("b", "h"), ("y", "v"), ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("6", "ø"), ("9", "g"), ("!", "i"), ("1", "i"), ("8", "b"), ("l", "i"), ("vv", "w"), ("h", "li"), ("m", "rn"),
)
HYPHENS = "-‐¬­"
CONJUNCTIONS = frozenset({"og", "eller", "and", "or", "und", "oder", "och", "men", "samt", "to"})
_TRIM = ".,;:?()«»\"–—…„“”‚‘’[]/*<>"
_LETTER = re.compile(r"[^\W\d_]")
_BARE = str.maketrans("åø", "ao")
_ROMAN = ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = "m" * (n // 1000) + {0: "", 1: "c", 2: "cc", 3: "ccc", 4: "cd", 5: "d", 6: "dc", 7: "dcc", 8: "dccc", 9: "cm"}[n // 100 % 10]
    n %= 100
    for value, sign in _ROMAN[1:]:
        while n >= value:
            out, n = out + sign, n - value
    return out


def trim(token: str) -> str:
    """The word of a token: NFC, without punctuation around it; a leading ``!`` before a letter stays."""
    w = token.strip(_TRIM)
    while w.endswith("!"):
        w = w[:-1].rstrip(_TRIM)
    return w.lstrip(_TRIM)


class Vocabulary:
    """Frequencies, trie and character n-grams of the clean words.

    In the trie a word stands by itself (a string for a node) from where no other shares its letters.
    """

    def __init__(self, counts: dict[str, int], n: int = 4, pairs: dict[int, int] | None = None) -> None:
        self.counts, self.n, self.pairs = counts, n, pairs or {}
        self.trie: dict = {}
        self.grams: Counter[str] = Counter()
        for w, c in list(counts.items()):
            self.add(w, c)
        self.by_reading: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for reading, truth in CONFUSIONS:
            self.by_reading[reading[0]].append((reading, truth))
        self.judge = lru_cache(400_000)(self._judge)

    def add(self, word: str, count: int) -> None:
        self.counts[word] = count
        node = self.trie
        for depth in range(len(word) + 1):
            ch = word[depth : depth + 1]
            following = node.get(ch)
            if following is None or following == word:
                node[ch] = word
                break
            if isinstance(following, str):  # a word alone so far: one level deeper
                node[ch] = following = {following[depth + 1 : depth + 2]: following}
            node = following
        padded = f"^^{word}$$"
        for i in range(len(padded) - self.n + 1):
            self.grams[padded[i : i + self.n]] += count

    def candidates(self, word: str, most: int = MOST, distance: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -count, word): all vocabulary words the reading may stand for, by intersecting its automaton
        with the trie: those up to ``most`` confusions and up to ``distance`` other edits away."""
        out: dict[str, int] = {}
        # A state is a place in the word and a node; the letters that lead to the node name it.
        stack: list[tuple[int, dict | str, int, int, str]] = [(0, self.trie, 0, 0, "")]
        seen: dict[tuple[int, str, int], int] = {}
        size = len(word)
        while stack:
            i, node, edits, others, sofar = stack.pop()
            if distance:
                best = seen.get((i, sofar, others))
                if best is not None and best <= edits:
                    continue
                seen[i, sofar, others] = edits
            if isinstance(node, str):  # what may follow is the one word's next letter
                at = len(sofar)
                node = {node[at : at + 1]: node}
            if i == size:
                cost = edits + EDIT_COST * others
                if "" in node and cost and cost < out.get(sofar, 1 << 30):
                    out[sofar] = cost
            else:
                ch = word[i]
                if ch in node:
                    stack.append((i + 1, node[ch], edits, others, sofar + ch))
                if edits < most:
                    for reading, truth in self.by_reading.get(ch, ()):
                        if truth in node and word.startswith(reading, i):
                            stack.append((i + len(reading), node[truth], edits + 1, others, sofar + truth))
            if others < distance:
                if i < size:
                    stack.append((i + 1, node, edits, others + 1, sofar))
                for letter, following in node.items():
                    if letter:
                        stack.append((i, following, edits, others + 1, sofar + letter))
                        if i < size and letter != word[i]:
                            stack.append((i + 1, following, edits, others + 1, sofar + letter))
        return sorted((cost, -self.counts[w], w) for w, cost in out.items() if w != word)

    def weakest(self, word: str) -> int:
        padded, n, grams = f"^^{word}$$", self.n, self.grams
        return min(grams.get(padded[i : i + n], 0) for i in range(len(padded) - n + 1))

    def _mended(self, word: str, least: int, most: int = 3) -> tuple[int, str | None]:
        """(weakest n-gram, word): the best of all words with up to ``most`` readings undone.

        Each further reading undone must make it four times better.  Branch and
        bound: every n-gram seen less often than what is wanted must be mended, so
        the search goes on only with readings that touch the first of them, or
        that a later one touching it may need (two letters a reading).
        """
        best, name = 0, None
        frontier, seen = [word], {word}
        for depth in range(1, most + 1):
            following = []
            for w in frontier:
                low, high = self._reach(w, max(least, 4 * best + 1), 2 * (most - depth))
                for i in range(len(w)) if depth == 1 else range(max(0, low - 1), min(high, len(w))):
                    for reading, truth in self.by_reading.get(w[i], ()):
                        if w.startswith(reading, i):
                            v = w[:i] + truth + w[i + len(reading) :]
                            s = self.weakest(v)
                            if s > best * (4 if depth > 1 else 1):
                                best, name = s, v
                            if v not in seen and low < i + len(reading) and i < high:
                                seen.add(v)
                                following.append(v)
            frontier = following
        return best, name

    def _reach(self, word: str, least: int, slack: int) -> tuple[int, int]:
        """The letters of the first n-gram seen less often than ``least``, and as many more on either side."""
        padded, n, grams = f"^^{word}$$", self.n, self.grams
        for i in range(len(padded) - n + 1):
            if grams.get(padded[i : i + n], 0) < least:
                return i - 2 - slack, i - 2 + n + slack
        return 0, len(word)

    def _judge(self, word: str) -> tuple[str | None, tuple[tuple[int, int, str], ...]]:
        """(the word a reading stands for whatever its context, candidates among which the context decides)."""
        w = word.casefold()
        if len(w) < 2 or w in self.counts or not _LETTER.search(w):
            return None, ()
        if w.endswith("'s") and w[:-2] in self.counts:
            return None, ()
        found = self.candidates(w)
        if found:
            best = found[0][2]
            if len(w) >= 9 and best.translate(_BARE) == w:  # a compound that may be the other written standard's form, if it is as well-formed
                own = self.weakest(w)
                if own >= 5 and own >= self.counts[best] and own * 20 >= self.weakest(best):
                    return None, ()
            return best, tuple(found) if len(found) > 1 else ()
        odd = any(c in "!0156789" for c in w)
        letters = sum(c.isalpha() for c in w)
        if odd and letters <= len(w) // 2:
            digits = w.translate(str.maketrans("lio", "110"))
            return digits if digits.isdigit() and w[0] in "l1io0" and len(w) > 1 and not w.isdigit() else None, ()
        own = self.weakest(w)
        best, name = self._mended(w, 1 if odd else 12 * (own + 1))
        if name and (best >= 12 * (own + 1) or odd and best > own):
            return name, ()
        if odd and name and letters >= 3:
            return name, ()
        if own or len(w) < ONE_EDIT or not w.isalpha():
            return None, ()
        near = self.candidates(w, distance=1) or (self.candidates(w, distance=2) if len(w) >= TWO_EDITS else [])
        return None, tuple(c for c in near if self.weakest(c[2]) >= LEAST_SCANNED)

    def options(self, word: str) -> tuple[tuple[int, int, str], ...]:
        """The candidates of a reading that its context decides among."""
        return self.judge(word)[1]

    def truth(self, word: str, left: str = "", right: str = "") -> str | None:
        """The word a reading stands for between two others, or None where it is no misreading."""
        plain, options = self.judge(word)
        if not options or not self.pairs:
            return plain
        left, right = left.casefold(), right.casefold()
        support = lambda w: self.pairs.get(pair_key(left, w), 0) + self.pairs.get(pair_key(w, right), 0)
        ranked = min((-support(w), cost, n, w) for cost, n, w in options)
        if plain is None:  # other edits than confusions need the context's word for it
            return ranked[3] if -ranked[0] >= LEAST and support(word.casefold()) == 0 else None
        return ranked[3] if ranked[0] else plain


def pair_key(left: str, right: str) -> int:
    return xxh64_intdigest(f"{left}\0{right}") >> 1


#: What parts words in the texts and scans; in the vocabulary a ``!`` does too.
_PARTING = " \t\n\x0b\f\r.,;:?()«»\"–—…„“”‚‘’[]/*<>"


def parted(texts: pa.Array, parting: str) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """(words, places of the texts' first words) of pieces of a column.  A text that begins or ends with what parts
    words has an empty one there."""
    blank = np.arange(256, dtype=np.uint8)
    wide = defaultdict(list)
    for ch in parting:
        first, *rest = ch.encode()
        if rest:
            wide[first].append(rest)
        else:
            blank[first] = 32
    texts = texts.drop_null()
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_BYTES, prepend=0))
    for low, high in zip([0, *bounds], [*bounds, len(texts)]):
        if low == high:
            continue
        piece = texts.slice(low, high - low).cast(pa.string())
        _, ends, data = piece.buffers()
        ends = np.frombuffer(ends, np.int32)[piece.offset : piece.offset + len(piece) + 1]
        # Blanks take the place of each byte, so the texts' offsets stay.
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        plain = blank[raw]
        for first, others in wide.items():
            at = np.flatnonzero(raw == first)
            for rest in others:
                hit = at[np.logical_and.reduce([raw[at + i] == x for i, x in enumerate(rest, 1)])]
                for i in range(len(rest) + 1):
                    plain[hit + i] = 32
        words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(piece), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))
        yield words.values, words.offsets.to_numpy()[:-1]


def vocabulary_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the clean corpus, parted and counted as Arrow columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in parted(batch.column(0), _PARTING + "!"):
                yield pa.RecordBatch.from_arrays(words.value_counts().flatten(), ["word", "n"])

    counted = texts.select(F.lower("text")).mapInArrow(run, "word string, n bigint")
    return counted.filter("word rlike '\\\\p{L}'").groupBy("word").agg(F.sum("n").alias("n"))


def load_vocabulary(texts: DataFrame, scanned: DataFrame) -> Vocabulary:
    """All of the clean corpus's words, the scanned pages' own words that are no reading of others, and the counts of
    the pairs their candidates make; the judging is done on the cluster."""
    spark = scanned.sparkSession
    out: Counter[str] = Counter()
    for w, n in _frequent(texts, LEAST):
        out[unicodedata.normalize("NFC", w).casefold()] += n
    counted = materialize(vocabulary_counts(scanned).filter(F.col("n") >= LEAST_SCANNED))
    # First against the clean words alone, then those left against one another: a reading is rarer than its word.
    in_scans = spark.sparkContext.broadcast({r["word"]: r["n"] for r in counted.collect()})
    first = _own_words(counted, share(spark, out), in_scans)
    second = _own_words(counted, share(spark, out | first), in_scans)
    out.update({w: n for w, n in first.items() if w in second})
    return Vocabulary(dict(out), pairs=context_pairs(texts, scanned, share(spark, out)))


def _own_words(counted: DataFrame, known, in_scans) -> dict[str, int]:
    """Words of the scans that are no reading of known ones oftener in the scans, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_vocabulary(known)
        for batch in batches:
            rows = []
            for w, n in zip(*(c.to_pylist() for c in batch.columns)):
                w = trim(w).casefold()
                if len(w) < 2 or w[-1] in HYPHENS or any(c in "!0156789" for c in w):
                    continue
                mine = v.counts.get(w)
                if mine is None:
                    plain, options = v.judge(w)
                    if plain is None and not any(in_scans.value.get(c, 0) >= OFTENER * n for _, _, c in options):
                        rows.append((w, n))
                elif mine == n and not any(-c > n for _, c, _ in v.candidates(w)):  # taken in the pass before
                    rows.append((w, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["w", "n"])

    return {r["w"]: r["n"] for r in counted.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}


_SPLIT = r"[\s.,;:?()«»\"–—…„“”‚‘’\[\]/*<>]+"


def context_pairs(texts: DataFrame, scanned: DataFrame, known) -> dict[int, int]:
    """How often the clean corpus has the pairs that readings with several candidates, or with none but by other
    edits, make with their neighbours: {pair_key: count}.

    Each distinct word of the scans is judged once; only pairs around the few whose context decides are
    looked for, so neither the scans' nor the clean corpus's own pairs are shuffled.
    """
    words = F.array_remove(F.split(F.lower("text"), _SPLIT), "")
    arrays = scanned.select(words.alias("_w"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_vocabulary(known)
        for batch in batches:
            rows = [(word, [*(o[2] for o in options), word]) for word in batch.column(0).to_pylist() if (options := v.options(word))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["w", "options"])

    distinct = arrays.select(F.explode("_w").alias("w")).filter("w rlike '\\\\p{L}'").distinct()
    open_ = small(distinct.mapInArrow(decided, "w string, options array<string>"), derived=True)
    around = F.transform("_w", lambda w, i: F.struct(F.coalesce(F.get("_w", i - 1), F.lit("")).alias("l"), w.alias("w"), F.coalesce(F.get("_w", i + 1), F.lit("")).alias("r")))
    found = arrays.select(F.inline(around)).join(open_, "w").select("l", "r", F.explode("options").alias("o"))
    pairs = found.select(F.inline(F.array(F.struct(F.col("l").alias("a"), F.col("o").alias("b")), F.struct(F.col("o").alias("a"), F.col("r").alias("b"))))).filter("a <> '' and b <> ''").distinct()
    wanted = small(pairs.withColumn("k", F.xxhash64("a").bitwiseXOR(F.shiftleft(F.xxhash64("b"), 1))), derived=True)
    counted = _said(texts, wanted.select("k")).join(wanted.select("a", "b"), ["a", "b"]).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {pair_key(r["a"], r["b"]): r["n"] for r in counted.collect()}


def _said(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, n): counts of the texts' neighbouring words whose key is among those wanted (8 bytes each are broadcast).

    The key, made of the words' hashes, only spares rows: what comes is to be joined with the wanted words themselves.
    """
    known = np.sort(keys.toArrow()["k"].to_numpy().view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        marks = np.zeros(1 << max(20, (4 * len(known)).bit_length()), bool)
        last = np.uint64(len(marks) - 1)
        marks[known & last] = True
        for batch in batches:
            for words, firsts in parted(batch.column(0), _PARTING):
                coded = words.dictionary_encode()
                codes, names = coded.indices.to_numpy(), coded.dictionary
                hashes = np.array([xxh64_intdigest(w, seed=42) for w in names.to_pylist()], np.uint64)
                key = hashes[codes[:-1]] ^ (hashes << np.uint64(1))[codes[1:]]
                near = marks[key & last]
                near[firsts[1:] - 1] = False  # the words beside one another are of two texts
                at = np.flatnonzero(near)
                at = at[known[np.minimum(np.searchsorted(known, key[at]), len(known) - 1)] == key[at]]
                pairs, n = np.unique(codes[at].astype(np.int64) * len(names) + codes[at + 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), pa.array(n, pa.int64())], ["a", "b", "n"])

    return (texts if len(known) else texts.limit(0)).select(F.lower("text")).mapInArrow(run, "a string, b string, n bigint")


def _frequent(texts: DataFrame, least: int) -> Iterator[tuple[str, int]]:
    """(word, n) of all words that occur so often."""
    found = vocabulary_counts(texts).filter(F.col("n") >= least).toArrow()
    for batch in found.to_batches(20_000):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def similar(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if not n or min(len(a), len(b)) < 0.6 * n:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return 1 - row[-1] / n


_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "o": "0", "O": "0", "ø": "0", "s": "5", "S": "5", "b": "6", "g": "9", "q": "9", "z": "2", "Z": "2", "B": "8", "A": "4"})
_NUMBER_LINE = re.compile(r"^(?P<open>[\[(—–\-\s]*|[Ss5]\S{2,3}\s+|[Pp]\S{2,3}\s+|[SsPp5]{1,2}\.\s*)(?P<core>[0-9A-Za-z!|øØ.]{1,9})(?P<close>[\])—–\-\s.]*|\s+[a-z0]{1,3}\s+\S+)$")


def is_own_number(line: str, page: int | None) -> bool:
    """Whether the line is the page's own number, in any of its forms, also if misread."""
    if page is None:
        return False
    m = _NUMBER_LINE.match(line.strip())
    if not m:
        return False
    core, dressed = m["core"].strip("."), bool(m["open"].strip() or m["close"].strip())
    own = str(page)
    if core.translate(_DIGITS) == own:
        return True
    r = roman(page)
    low = core.casefold()
    if low == r:
        return True
    plain = lambda s: s.replace("1", "l").replace("!", "i").replace("|", "l")
    if len(r) >= 2 and plain(low).replace("l", "i") == r.replace("l", "i"):
        return True
    if len(low) == len(r) >= 3 and sum(x != y for x, y in zip(low, r)) <= 1 and set(low) <= set("ivxlcdme1!0"):
        return True
    wrong = sum(x != y for x, y in zip(core.translate(_DIGITS), own))
    return len(core) == len(own) and wrong <= 1 and (dressed or not core.isdigit()) and len(own) >= 2


class Page:
    def __init__(self, page_id: int, number: int | None, text: str | None, own: bool) -> None:
        self.id, self.number, self.own = page_id, number, own
        self.lines = (text or "").split("\n")
        self.kind = [""] * len(self.lines)
        shown = [i for i, l in enumerate(self.lines) if l.strip()]
        for i in [*shown[:2], *shown[-2:]]:
            if is_own_number(self.lines[i], number):
                self.kind[i] = "page_number"
                break
        else:
            for i in [*shown[:3], *shown[-3:]]:
                if is_own_number(self.lines[i], number):
                    self.kind[i] = "page_number"
                    break
        first = [i for i in shown[:3] if self.kind[i] != "page_number"][:1]
        self.top = first[0] if first else None
        self.key = skeleton(self.lines[self.top]) if first else ""
        self.shown = shown

    def body(self) -> list[int]:
        return [i for i in self.shown if self.kind[i] not in ("page_number", "header")]


def skeleton(line: str) -> str:
    return re.sub(r"[\W_]+", "", line.casefold())


def mark_headers(pages: list[Page], title: str | None) -> None:
    """Headers by recurrence near by, by the work's title, or by their setting."""
    name = skeleton(title or "")
    widths = sorted(len(l.strip()) for p in pages for l in p.lines if l.strip())
    width = widths[len(widths) * 3 // 4] if widths else 60
    sure: set[int] = set()
    eligible: list[int] = []
    for k, p in enumerate(pages):
        if p.top is None or len(p.key) < 3:
            continue
        line = p.lines[p.top]
        text = line.strip()
        if len(text) > max(0.95 * width, 30) or text[0].islower() and text[1:2].islower() and not len(line) - len(line.lstrip()) >= 6:
            continue
        eligible.append(k)
        indent = len(line) - len(line.lstrip())
        ends = re.split(r"\s{2,}", text)
        if len(ends) > 1 and p.number is not None and str(p.number) in (ends[0].translate(_DIGITS), ends[-1].translate(_DIGITS)):
            sure.add(k)
        if indent >= 6 or len(name) >= 4 and (similar(p.key, name) >= 0.7 or similar(re.sub(r"\d+", "", p.key), name) >= 0.7):
            sure.add(k)
    ended = [pages[k].lines[pages[k].top].rstrip()[-1:] in ".,;:!?»”\"" + HYPHENS for k in eligible]
    for a, k in enumerate(eligible):
        p = pages[k]
        if k in sure or p.number is None:
            continue
        for b, j in enumerate(eligible):
            q = pages[j]
            if j == k or q.number is None or p.number is None or q.number == p.number or abs(q.number - p.number) > 2 * MARGIN:
                continue
            s = similar(p.key, q.key)
            if s >= (0.72 if not ended[a] else 0.8) and not (ended[a] and ended[b]):
                sure.add(k)
                break
    # A header that stands alone: the work shows no other one on pages of that side.
    sides = {pages[k].number % 2 for k in sure if pages[k].number is not None}
    lowest = min((p.number for p in pages if p.number is not None), default=None)
    for a, k in enumerate(eligible):
        p = pages[k]
        text = p.lines[p.top].strip()
        if k not in sure and not ended[a] and p.number is not None and p.number != lowest and p.number % 2 not in sides and sum(c.isalpha() for c in text) >= 3 and sum(t[0].isdigit() for t in text.split()) < 2:
            sure.add(k)
    for k in sure:
        pages[k].kind[pages[k].top] = "header"


def neighbour(tokens: list[str], at: int) -> str:
    return trim(tokens[at]) if 0 <= at < len(tokens) else ""


class Repairer:
    """Marks and mends the pages of one block of a work."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary

    def is_broken(self, line: str, following: str | None) -> bool:
        """Whether the last word of a line goes on in the next text line."""
        text = line.rstrip()
        if len(text) < 2 or text[-1] not in HYPHENS or not (text[-2].isalpha() or text[-2] in "0156789!"):
            return False
        if not following:
            return following is None or text[-1] != "-"
        nxt = following.strip().split()[0]
        if not (nxt[0].islower() or nxt[0] in "0156789!" and _LETTER.search(nxt[:3] or "")):
            return False
        head, tail = trim(text.split()[-1][:-1]).casefold(), trim(nxt).casefold()
        if text[-1] == "-":
            counts = self.v.counts
            if f"{head}-{tail}" in counts and head + tail not in counts:
                return False
            mended = self.v.truth(tail) or tail
            if mended in CONJUNCTIONS and head + tail not in counts:
                return False
            if f"{head}-{mended}" in counts and head + tail not in counts:
                return False
            for known in (self.v.truth(head) or head,):
                if f"{known}-{mended}" in counts and known + mended not in counts:
                    return False
        return True

    def block(self, pages: list[Page], title: str | None) -> None:
        mark_headers(pages, title)
        self.next_line: dict[int, str | None] = {}
        first: dict[int, str] = {}
        for p in pages:
            body = p.body()
            if p.number is not None and body and p.number not in first:
                first[p.number] = p.lines[body[0]]
        for p in pages:
            self.next_line[p.id] = first.get(p.number + 1) if p.number is not None else None
        self.previous: dict[int, str] = {}
        for p in pages:
            body = p.body()
            if p.number is not None and body:
                self.previous.setdefault(p.number + 1, p.lines[body[-1]])

    def marks(self, page: Page) -> list[tuple[int, str]]:
        out = [(i + 1, k) for i, k in enumerate(page.kind) if k]
        body = page.body()
        judge = self.v.truth
        # The end of a word broken before this page.
        before = self.previous.get(page.number) if page.number is not None else None
        carried = trim(before.split()[-1][:-1]) if before and body and self.is_broken(before, page.lines[body[0]]) else ""
        for k, i in enumerate(body):
            line = page.lines[i]
            tokens = line.split()
            last = k + 1 == len(body)
            following = self.next_line[page.id] if last else page.lines[body[k + 1]]
            broken = self.is_broken(line, following)
            if broken:
                out.append((i + 1, "hyphen"))
            wrong = False
            for t, token in enumerate(tokens):
                if t == 0 and carried:
                    wrong |= self._part_wrong(carried, trim(token), first=False)
                elif broken and t == len(tokens) - 1:
                    if following is not None:
                        wrong |= self._part_wrong(trim(token[:-1]), trim(following.split()[0]), first=True)
                elif token[-1:] in HYPHENS and t == len(tokens) - 1:
                    wrong |= bool(judge(trim(token[:-1])))
                else:
                    w = self.word(token)
                    sides = neighbour(tokens, t - 1), neighbour(tokens, t + 1)
                    if "-" in w.strip("-") or "‐" in w:
                        wrong |= w.casefold() not in self.v.counts and any(judge(x) for x in re.split("[-‐]", w) if x)
                    elif "/" in token or "=" in token:
                        wrong |= any(judge(trim(x)) for x in token.split("/"))
                    else:
                        wrong |= bool(judge(w, *sides))
                if wrong:
                    break
            if wrong:
                out.append((i + 1, "misread"))
            carried = trim(tokens[-1][:-1]) if broken else ""
        return out

    def _part_wrong(self, head: str, tail: str, first: bool) -> bool:
        """Whether the misreading of a broken word lies in its first (or second) part."""
        whole = self.v.truth(head + tail)
        if not whole:
            return False
        low = (head + tail).casefold()
        same_start = 0
        while same_start < min(len(low), len(whole)) and low[same_start] == whole[same_start]:
            same_start += 1
        same_end = 0
        while same_end < min(len(low), len(whole)) - same_start and low[-1 - same_end] == whole[-1 - same_end]:
            same_end += 1
        return same_start < len(head) if first else len(low) - same_end > len(head)

    def word(self, token: str) -> str:
        """The word of a token; a final ``!`` is kept where only with it (read as i) the word is known."""
        w = trim(token)
        if "!" in token and w and w.casefold() not in self.v.counts and token.rstrip(_TRIM).endswith("!"):
            found = self.v.candidates(w.casefold() + "!")
            if found and found[0][2].endswith("i"):
                return w + "!"
        return w

    def mend(self, word: str, left: str = "", right: str = "") -> str:
        """A token with its misreading undone, punctuation and case kept."""
        core = self.word(word)
        true = self.v.truth(core, left, right) if core else None
        if not true:
            return word
        if core.isupper() and len(core) > 1:
            true = true.upper()
        elif core[0].isupper():
            true = true[0].upper() + true[1:]
        return word.replace(core, true, 1)

    def paragraphs(self, pages: list[Page]) -> list[tuple[int | None, int, str, bool, bool]]:
        """(page number, order, text, opens, runs on): the pieces of paragraphs of each page."""
        out = []
        for p in pages:
            body, parts, order = p.body(), [], 0
            for k, i in enumerate(body):
                fresh = k > 0 and (body[k] - body[k - 1] > 1 and any(not p.lines[x].strip() for x in range(body[k - 1] + 1, i)) or p.lines[i].startswith("  "))
                if fresh and parts:
                    out.append((p.number, order, "".join(parts).strip(), order > 0 or p.lines[body[0]].startswith("  "), False))
                    parts, order = [], order + 1
                line = p.lines[i].strip()
                following = self.next_line[p.id] if k + 1 == len(body) else p.lines[body[k + 1]]
                parts.append(line[:-1] if self.is_broken(p.lines[i], following) else line + " ")
            if parts:
                text = "".join(parts)
                out.append((p.number, order, text, order > 0 or p.lines[body[0]].startswith("  "), not text.rstrip().endswith((".", "!", "?", "»", "”", '"', ":"))))
        mended = lambda words: " ".join(self.mend(w, neighbour(words, i - 1), neighbour(words, i + 1)) for i, w in enumerate(words))
        return [(n, o, mended(t.split()) + ("" if not t.endswith(" ") and run else " " if run else ""), f, run) for n, o, t, f, run in out]


def page_blocks(pages: DataFrame, works: DataFrame) -> DataFrame:
    """Pages by (document_id, block), those of the margins marked as not the block's own."""
    one = (
        pages.filter("page_id is not null").groupBy("page_id")
        .agg(F.max(F.struct(F.length("text").alias("n"), "document_id", "page", "text")).alias("p"))
        .select("page_id", "p.document_id", F.expr("try_cast(trim(p.page) as int)").alias("number"), "p.text")
    )
    titles = works.filter("document_id is not null").groupBy("document_id").agg(F.max("title").alias("title"))
    home = F.when(F.col("number").isNull() | F.col("document_id").isNull(), -1 - F.shiftrightunsigned(F.xxhash64("page_id"), 1)).otherwise(F.floor(F.col("number") / BLOCK))
    place = F.pmod(F.col("number"), F.lit(BLOCK))
    known = F.col("number").isNotNull() & F.col("document_id").isNotNull()
    blocks = F.when(known & (place < MARGIN), F.array(F.col("home"), F.col("home") - 1)).when(known & (place >= BLOCK - MARGIN), F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))
    return (
        one.join(titles, "document_id", "left").withColumn("home", home.cast("bigint"))
        .withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.col("home"))
        .select("document_id", "block", "number", "page_id", "own", "title", "text")
    )


def _run(pages: DataFrame, works: DataFrame, texts: DataFrame, emit, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    blocks = page_blocks(pages, works)
    spark = blocks.sparkSession
    vocabulary = load_vocabulary(texts, pages)
    words = share(spark, vocabulary.counts, vocabulary.pairs)
    del vocabulary
    tasks = int(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(pages) // TASK_BYTES))
    arranged = blocks.repartition(tasks, "document_id", "block").sortWithinPartitions("document_id", "block", "number", "page_id")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, list[Page]]]:
        key, title, pages = None, None, []
        for batch in batches:
            for doc, block, number, page_id, own, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, block) != key:
                    if pages:
                        yield key[0], title, pages
                    key, title, pages = (doc, block), name, []
                pages.append(Page(page_id, number, text, own))
        if pages:
            yield key[0], title, pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        repairer = None
        for doc, title, pages in groups(batches):
            repairer = repairer or Repairer(shared_vocabulary(words))
            repairer.block(pages, title)
            rows += emit(repairer, doc, pages)
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return arranged.mapInArrow(run, schema)


_SHARED: dict[str, Vocabulary] = {}


def share(spark, counts: dict[str, int], pairs: dict[int, int] | None = None):
    """A broadcast of a vocabulary's counts under a name of its own."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, dict(counts), pairs))


def shared_vocabulary(words) -> Vocabulary:
    """Built once in each Python worker for each broadcast."""
    name, counts, pairs = words.value
    if name not in _SHARED:
        _SHARED.clear()
        _SHARED[name] = Vocabulary(counts, pairs=pairs)
    return _SHARED[name]


def find_noise(pages: DataFrame, works: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, line_no, kind): header, page_number, hyphen and misread lines."""

    def emit(r: Repairer, doc: str, block: list[Page]) -> list[tuple]:
        return [(p.id, line, kind) for p in block if p.own for line, kind in r.marks(p)]

    return _run(pages, works, texts, emit, ["page_id", "line_no", "kind"], [pa.int64(), pa.int32(), pa.string()], "page_id bigint, line_no int, kind string")


def reflow(pages: DataFrame, works: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, page, paragraph, last_page, text): paragraphs by the page they begin on and their
    place there, joined over lines and pages, words mended.

    A paragraph is finished in the block it begins in, with the pages of the
    margin behind.  What goes on beyond them is a further row of the next block,
    by its first page there, and so on (a word broken just there stays in two).
    """

    def emit(r: Repairer, doc: str, block: list[Page]) -> list[tuple]:
        own = {p.number for p in block if p.own and p.number is not None}
        alone = [[doc, None, order, None, text] for p in block if p.number is None for _, order, text, _, _ in r.paragraphs([p])]
        #: The first page that the block before does not see.
        beyond = min(own) // BLOCK * BLOCK + MARGIN if own else 0
        seen, once = set(), []
        for p in block:
            if p.number is not None and p.number not in seen:
                seen.add(p.number)
                once.append(p)
        out: list[list] = []
        before = None  # page and running-on of the piece before
        for page, order, text, opens, runs_on in r.paragraphs(once):
            goes_on = order == 0 and not opens and before is not None and before[1] and before[0] in (page, page - 1)
            if goes_on and page >= beyond and before[0] < beyond and (not out or out[-1][1] < beyond - MARGIN):
                out.append([doc, page, order, page, text])
            elif goes_on and out:
                out[-1][3], out[-1][4] = page, out[-1][4] + text
            elif not (order == 0 and not opens and before is None and page not in own):  # its beginning lies before the margin
                out.append([doc, page, order, page, text])
            before = (page, runs_on)
        return [(d, a, o, b, t.strip()) for d, a, o, b, t in [*(x for x in out if x[1] in own), *alone] if t.strip()]

    return _run(pages.filter("document_id is not null"), works, texts, emit, ["document_id", "page", "paragraph", "last_page", "text"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()], "document_id string, page int, paragraph int, last_page int, text string")
