"""Problem 2: held-out evaluation sentences that stand, whole or in part, in a corpus.

Method: a hash set of normalised n-grams of the held-out items is broadcast and
the windows of every document are scanned against it; hits are verified by a
local alignment of words, which allows misread, replaced and broken words.  The
n-grams have gaps, because a passage with every fourth word damaged keeps no
longer run for certain: a word particular to the item together with another one
up to REACH words from it.  The verification demands that the words particular
to the item agree, one of them letter by letter.  Every alignment is verified
for itself, so shared phrasing hides no passage beside it.

What counts as phrasing is found over all held-out items at once, by language,
before the set is built, so it does not depend on how many rounds the items are
scanned in.  A particular word at any place of MIN_WORDS words has four others
within REACH; with two words damaged (broken ones move the rest by one, which
the scan allows for) two of the four are left, so HITS words agree.

Documents are read in blocks of sentences with an overlap longer than the
longest item, so that no task ever holds a whole document and passages across
sentences and blocks are found.

Defined results
---------------
* an item is held out if a run has its language tag and split; null tags or
  splits never match.  Items with fewer than ``MIN_WORDS`` words can't be held.
* rows without document_id or sentence_index are skipped; of rows that repeat
  the pair one counts (the longest list of tokens); null or empty tokens read as no words.
* an empty corpus or no held-out items give no rows.
* every passage of an item is reported; a long one whose broken words shift it
  by more than the band may come as two that overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nordlys.session import input_bytes, materialize, small

#: Words of an item a passage must hold; sentences a block.
MIN_WORDS, BLOCK = 8, 512
#: Rows of items broadcast at once (a few hundred bytes each); more are scanned in rounds, one broadcast after the other.
ITEMS_PER_ROUND = 10_000
#: A word or pair in more than this share of a language's sentences (and more than a few) is phrasing.
COMMON_SHARE, COMMON_LEAST = 0.02, 3
GAP, MISMATCH = -1.1, -1.2
#: Bytes of the scans behind a task of the scan.
TASK_BYTES = 16 << 20
#: Words of an n-gram's reach, words of a passage that must be hit, and words its diagonal may drift by.
REACH, HITS, DRIFT = 4, 3, 4

_WORD = re.compile(r"\w+")
_DROP = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def words_of(tokens: Iterable[str | None] | None) -> list[str]:
    """Normalised words: NFKC, case folded, punctuation and spacing ignored."""
    out: list[str] = []
    for t in tokens or ():
        if t:
            if not t.isascii():
                t = unicodedata.normalize("NFKC", t.translate(_DROP))
            t = t.casefold()
            if t.isalnum():
                out.append(t)
            else:
                out += _WORD.findall(t)
    return out


def edit_distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance, or limit + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > limit:
            return limit + 1
    return row[-1]


@lru_cache(1 << 17)
def misread(a: str, b: str) -> bool:
    """Whether ``b`` may be ``a`` misread: at most a third of its letters differ."""
    n = max(len(a), len(b))
    limit = n // 3 if n > 3 else (1 if n == 3 else 0)
    if a.isdigit() and b.isdigit():
        return False
    return limit > 0 and edit_distance(a, b, limit) <= limit


@dataclass
class Passage:
    """A verified alignment: item words [start, end), how many of them agree, and of those particular to the item."""

    start: int
    end: int
    same: int
    near: int
    particular: int
    particular_same: int
    at: int = 0
    until: int = 0
    #: Of the words particular to the item those that agree letter by letter.
    particular_exact: int = 0
    #: Within the words aligned, from the last step to the first: (item word, begin, end, kind: 2 same, 1 near, 0 other; whether particular).
    steps: list[tuple[int, int, int, int, bool]] = field(default_factory=list, repr=False)


@dataclass
class Index:
    """The broadcast set: distinct held-out sentences, their ids and their n-grams.

    ``grams`` has for each particular word the words near it, and for each of those (sentence, place, distance).
    """

    sentences: list[list[str]] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    particular: list[list[bool]] = field(default_factory=list)
    grams: dict[str, dict[str, list[tuple[int, int, int]]]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: Iterable[tuple[int, str, list[str | None]]], common: dict[str, frozenset[str]] | None = None) -> Index:
        """The set of some of the items; ``common`` has the languages' phrasing (of these items alone, if not given)."""
        items = list(items)
        if common is None:
            common = common_words((language, words_of(tokens)) for _, language, tokens in items)
        self, seen = cls(), {}
        for item, language, tokens in items:
            words = words_of(tokens)
            if len(words) < MIN_WORDS:
                continue
            s = seen.setdefault((language, *words), len(self.sentences))
            if s == len(self.sentences):
                phrasing = common.get(language, frozenset())
                mark = [w not in phrasing and len(w) > 1 for w in words]
                self.sentences.append(words)
                self.ids.append([])
                self.particular.append(mark)
                for i, own in enumerate(mark):
                    if own:
                        near = self.grams.setdefault(words[i], {})
                        for k in range(max(0, i - REACH), min(len(words), i + REACH + 1)):
                            if k != i:
                                near.setdefault(words[k], []).append((s, i, k - i))
            self.ids[s].append(item)
        return self

    def scan(self, words: list[str]) -> dict[int, Passage]:
        """Of each held-out sentence the best verified passage within the words, else its best alignment."""
        found: dict[int, Passage] = {}
        for s, p in self.passages(words):
            if s not in found or (is_held(p), p.same + p.near) > (is_held(found[s]), found[s].same + found[s].near):
                found[s] = p
        return found

    def passages(self, words: list[str]) -> Iterator[tuple[int, Passage]]:
        """Every alignment of a held-out sentence with the words: all that lie beside each other, near every group of diagonals hit."""
        get, n = self.grams.get, len(words)
        hits: dict[int, set[tuple[int, int]]] = {}
        for j, word in enumerate(words):
            near = get(word)
            if near is None:
                continue
            for k in range(max(0, j - REACH - 1), min(n, j + REACH + 2)):
                for s, i, distance in near.get(words[k], ()) if k != j else ():
                    if -1 <= k - j - distance <= 1:
                        hits.setdefault(s, set()).update(((j - i, j), (k - i - distance, k)))
        for s, found in hits.items():
            if len(found) < HITS:
                continue
            size = len(self.sentences[s])
            places = sorted(found)
            begin = 0
            for k in range(1, len(places) + 1):
                if k < len(places) and places[k][0] - places[k - 1][0] <= DRIFT:
                    continue
                first, last = places[begin][0], places[k - 1][0]
                left = [(max(0, first - DRIFT), min(n, last + size + DRIFT))] if k - begin >= HITS else []
                while left:
                    low, high = left.pop()
                    if len({j - d for d, j in places[begin:k] if low <= j < high}) < HITS:
                        continue
                    p = self.align(s, words[low:high], first - low, last - low)
                    if p:
                        p = held_part(p) or p
                        p.at += low
                        p.until += low
                        yield s, p
                        left += [(low, p.at), (p.until, high)]
                begin = k

    def align(self, s: int, words: list[str], first: int, last: int) -> Passage | None:
        """Local alignment of an item's words with a window of the document's, near the diagonals hit."""
        item, mark = self.sentences[s], self.particular[s]
        n, m = len(item), len(words)
        score = [[0.0] * (m + 1) for _ in range(n + 1)]
        step: list[list[tuple[int, int, int] | None]] = [[None] * (m + 1) for _ in range(n + 1)]
        best, where = 0.0, (0, 0)
        for i in range(1, n + 1):
            a = item[i - 1]
            above, here, steps = score[i - 1], score[i], step[i]
            for j in range(max(1, i + first - DRIFT), min(m, i + last + DRIFT) + 1):
                b = words[j - 1]
                if a == b:
                    value, how = above[j - 1] + 1.0, (i - 1, j - 1, 2)
                elif misread(a, b):
                    value, how = above[j - 1] + 0.8, (i - 1, j - 1, 1)
                else:
                    value, how = above[j - 1] + MISMATCH, (i - 1, j - 1, 0)
                if j > 1 and abs(len(words[j - 2]) + len(b) - len(a)) <= 1 and (v := above[j - 2] + 0.9) > value and (words[j - 2] + b == a or misread(a, words[j - 2] + b)):
                    value, how = v, (i - 1, j - 2, 1)
                if above[j] + GAP > value:
                    value, how = above[j] + GAP, (i - 1, j, 0)
                if here[j - 1] + GAP > value:
                    value, how = here[j - 1] + GAP, (i, j - 1, 3)
                if value > 0:
                    here[j], steps[j] = value, how
                    if value > best:
                        best, where = value, (i, j)
        if best < 3:
            return None
        i, j = where
        p = Passage(i, i, 0, 0, 0, 0, j, j)
        while i and j and step[i][j] is not None and score[i][j] > 0:
            pi, pj, kind = step[i][j]
            if kind != 3:
                p.steps.append((pi, pj, j, kind, mark[pi]))
                p.particular += mark[i - 1]
                if kind:
                    p.same += kind == 2
                    p.near += kind == 1
                    p.particular_same += mark[i - 1]
                    p.particular_exact += kind == 2 and mark[i - 1]
            i, j = pi, pj
        p.start, p.at = i, j
        return p


def common_words(sentences: Iterable[tuple[str, list[str]]]) -> dict[str, frozenset[str]]:
    """By language the words that stand in more than the common share of the distinct sentences."""
    distinct: dict[str, set[tuple[str, ...]]] = defaultdict(set)
    for language, words in sentences:
        if len(words) >= MIN_WORDS:
            distinct[language].add(tuple(words))
    out = {}
    for language, members in distinct.items():
        held = Counter(w for words in members for w in set(words))
        most = max(COMMON_LEAST, COMMON_SHARE * len(members))
        out[language] = frozenset(w for w, n in held.items() if n > most)
    return out


def is_held(p: Passage) -> bool:
    """The passage holds enough consecutive words of the item, and the item's own ones."""
    span = p.end - p.start
    if span < MIN_WORDS or p.particular_same < 2 or not p.particular_exact:  # like names alone are other names
        return False
    agreeing, own = p.same / span, p.particular_same / p.particular
    return agreeing >= 0.8 and own >= 0.6 or agreeing >= 0.7 and own >= 0.7


def held_part(p: Passage) -> Passage | None:
    """The passage if it is held, else its longest part that is (a true passage joined to shared phrasing), else None."""
    if is_held(p):
        return p
    steps = p.steps[::-1]
    for span in range(len(steps) - 1, MIN_WORDS - 1, -1):
        for a in range(len(steps) - span + 1):
            part = steps[a : a + span]
            if part[0][3] and part[-1][3]:
                own = [kind for *_, kind, particular in part if particular]
                q = Passage(part[0][0], part[-1][0] + 1, sum(x[3] == 2 for x in part), sum(x[3] == 1 for x in part), len(own), sum(k > 0 for k in own), part[0][1], part[-1][2], sum(k == 2 for k in own), part[::-1])
                if is_held(q):
                    return q
    return None


def held_out(items: DataFrame, runs: DataFrame) -> DataFrame:
    tags = runs.filter("language_tag is not null and evaluation_split is not null").select("language_tag", "evaluation_split").distinct()
    return items.select("item_id", "language_tag", "evaluation_split", "tokens").filter("item_id is not null").join(small(tags), ["language_tag", "evaluation_split"], "left_semi")


def blocks(sentences: DataFrame, overlap: int) -> DataFrame:
    """(document_id, block, sentence_index, tokens), the first sentences of a block also in the one before.

    Sentences without a word are left out, so ``overlap`` words need no more sentences than that.
    """
    block = F.floor(F.col("sentence_index") / BLOCK).cast("int")
    early = F.col("sentence_index") - block * BLOCK < overlap
    return (
        sentences.filter("document_id is not null and sentence_index is not null and exists(tokens, t -> t rlike '[\\\\p{L}\\\\p{N}]')")
        .select("document_id", "sentence_index", "tokens", F.explode(F.when(early & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))
    )


PASSAGES = "document_id string, item_id bigint, first_sentence int, last_sentence int, item_words int, passage_words int, agreeing_words int"


def phrasing(test: DataFrame) -> tuple[dict[str, frozenset[str]], int]:
    """The common words of each language over all held-out items, and the words of the longest item.

    Counted on the cluster; what reaches the driver is bounded, since a word in a
    share s of the sentences is one of at most (words a sentence) / s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(language, words) for language, tokens in zip(*(c.to_pylist() for c in batch.columns)) if len(words := words_of(tokens)) >= MIN_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["language", "words"])

    distinct = materialize(test.select("language_tag", "tokens").mapInArrow(run, "language string, words array<string>").distinct())
    totals = distinct.groupBy("language").agg(F.count("*").alias("n"), F.max(F.size("words")).alias("longest"))
    held = distinct.select("language", F.explode(F.array_distinct("words")).alias("word")).groupBy("language", "word").agg(F.count("*").alias("held"))
    common = held.join(small(totals, derived=True), "language").filter(F.col("held") > F.greatest(F.lit(COMMON_LEAST), COMMON_SHARE * F.col("n")))
    out: dict[str, set[str]] = defaultdict(set)
    for r in common.select("language", "word").collect():
        out[r["language"]].add(r["word"])
    return {k: frozenset(v) for k, v in out.items()}, totals.agg(F.max("longest")).first()[0] or 0


def find_leaks(sentences: DataFrame, items: DataFrame, runs: DataFrame, keep_all: bool = False, per_round: int = ITEMS_PER_ROUND) -> DataFrame:
    """Every verified passage: document, leaked item, the sentences it stands in and how much of it.

    Up to ``per_round`` items are one broadcast and one lazy pass.  More are
    taken in rounds over the corpus arranged once: each round's rows are written
    and its broadcast is given up before the next, so neither driver nor
    executors ever hold more than one round's items.
    """
    spark = sentences.sparkSession
    test = held_out(items, runs)
    common, longest = phrasing(test)
    rounds = max(1, -(-test.count() // per_round))
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(sentences) // TASK_BYTES)
    # A passage may have broken words, a third more than the item's.
    scanned = blocks(sentences, longest * 4 // 3 + MIN_WORDS).repartition(int(tasks), "document_id", "block").sortWithinPartitions("document_id", "block", "sentence_index", F.desc(F.size("tokens")))
    schema = PASSAGES if not keep_all else PASSAGES + ", same int, near int, particular int, particular_same int, start int, item string, text string"
    if rounds > 1:  # one row a block, so that the written table keeps each block in order and whole for every round
        scanned = materialize(scanned.mapInArrow(_pack, PACKED))
    out = None
    for k in range(rounds):
        part = test.filter(F.pmod(F.xxhash64("language_tag", F.array_join("tokens", " ")), F.lit(rounds)) == k) if rounds > 1 else test
        index = spark.sparkContext.broadcast(Index.build((tuple(r) for r in part.select("item_id", "language_tag", "tokens").collect()), common))
        found = scanned.mapInArrow(_scanner(index, keep_all, _unpack if rounds > 1 else _read), schema)
        if rounds > 1:
            found = materialize(found)
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out


PACKED = "document_id string, block int, owner array<int>, words array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((document, block), words, the sentence of each word) of sentences that come in order."""
    key, words, owner = None, [], []
    last = None
    for batch in batches:
        for doc, sentence, tokens, block in zip(*(c.to_pylist() for c in batch.columns)):
            if (doc, block) != key:
                if key:
                    yield key, words, owner
                key, words, owner, last = (doc, block), [], [], None
            if sentence == last:
                continue
            last = sentence
            own = words_of(tokens)
            words += own
            owner += [sentence] * len(own)
    if key:
        yield key, words, owner


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (doc, block), words, owner in _read(batches):
        yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([block], pa.int32()), pa.array([owner], pa.list_(pa.int32())), pa.array([words], pa.list_(pa.string()))], ["document_id", "block", "owner", "words"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc, block, owner, words = (c[i].as_py() for c in batch.columns)
            yield (doc, block), words, owner


def _scanner(index, keep_all: bool, read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        rows: list[tuple] = []
        for (doc, block), words, owner in read(batches):
            for s, p in held.passages(words):
                n = len(held.sentences[s])
                if owner[p.at] // BLOCK != block:
                    continue  # it begins in the next block, which finds it whole
                if keep_all or is_held(p):
                    base = (owner[min(p.at, len(owner) - 1)], owner[p.until - 1], n, p.end - p.start, p.same + p.near)
                    more = (p.same, p.near, p.particular, p.particular_same, p.start, " ".join(held.sentences[s]), " ".join(words[max(0, p.at - 3) : p.until + 3])) if keep_all else ()
                    rows += [(doc, item, *base, *more) for item in (held.ids[s][:1] if keep_all else held.ids[s])]
            if len(rows) > 5000:
                yield _batch(rows, keep_all)
                rows = []
        if rows:
            yield _batch(rows, keep_all)

    return run


def _batch(rows: list[tuple], more: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.int32()] * 5, *([*[pa.int32()] * 5, pa.string(), pa.string()] if more else [])]
    names = ["document_id", "item_id", "first_sentence", "last_sentence", "item_words", "passage_words", "agreeing_words", "same", "near", "particular", "particular_same", "start", "item", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[: len(kinds)])


def leaked_pairs(passages: DataFrame) -> DataFrame:
    return passages.select("document_id", "item_id").distinct()


def clean_sentences(sentences: DataFrame, passages: DataFrame) -> DataFrame:
    """The corpus without the sentences that leaked passages stand in (exact duplicates stay duplicates)."""
    spans = passages.select("document_id", F.explode(F.sequence("first_sentence", "last_sentence")).alias("sentence_index")).distinct()
    return sentences.join(spans, ["document_id", "sentence_index"], "left_anti")
