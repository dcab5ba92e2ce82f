"""Problem 6: encoding of whole texts with a public byte-level BPE vocabulary.

Method: the merges are compiled, in order, into a deterministic automaton over
vocabulary items by one gadget a merge.  Its states are "what may follow item
t"; merge k of (a, b) gives the state after ``a`` a copy without the arc ``b``,
and an arc ``ab`` wherever ``a b`` was a path.  A word has exactly one accepted
path, and that path is its BPE encoding.  Pre-split words are run through the
table, byte trie beside it, once a distinct word; decoding emits the arc labels.

Defined results: a null text and an empty text both encode to an empty list.
Special-token strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nordlys.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-split pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a worker remembers before it starts afresh.
CACHE_WORDS = 400_000
#: Documents whose ids are held together.
TOGETHER = 1024


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Items by id, from a ``.tiktoken`` rank file or a ``tokenizers`` JSON file."""
    if path.endswith(".tiktoken"):
        pairs = (line.split() for line in open(path, "rb") if line.strip())
        ranked = sorted((int(rank), base64.b64decode(item)) for item, rank in pairs)
        return [item for _, item in ranked]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*visible}))}
    data = json.load(open(path, encoding="utf-8"))
    special = {x["id"] for x in data.get("added_tokens", [])}
    return [bytes(back[c] for c in item) for item, i in sorted(data["model"]["vocab"].items(), key=lambda x: x[1]) if i not in special]


class MergeAutomaton:
    """Deterministic automaton over vocabulary ids; see the module's text.

    The state after item t is kept as the arcs it has lost: ``lost[t]`` maps an
    item to the step at which the arc went.  Arcs and targets created later are
    derived from the items' halves, so the table has one row a merge instead of
    states times alphabet; looked-up arcs are kept in ``arcs``.
    """

    def __init__(self, items: list[bytes]) -> None:
        self.items = items
        self.ids = {item: i for i, item in enumerate(items)}
        n = len(items)
        self.born = [-1] * n
        self.left: list[int] = [-1] * n
        self.right: list[int] = [-1] * n
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        self.arcs: dict[int, bool] = {}
        self.n = n
        for step, item in enumerate(items):
            if len(item) > 1:
                self._gadget(step, item)
        self.arcs.clear()
        self.trie: list[dict[int, int]] = [{}]
        self.final: list[int] = [-1]
        for i, item in enumerate(items):
            if len(item) == 1 or self.left[i] >= 0:
                self._insert(item, i)
        self.words: dict[str, list[int]] = {}

    def _gadget(self, step: int, item: bytes) -> None:
        """Adds merge ``step``: its halves are the last two parts of the item under the merges so far."""
        parts = self._path(item, step)
        if len(parts) != 2:
            return  # no path "a b" exists at this step, so the item can't be reached
        a, b = parts
        new = self.ids[item]
        self.left[new], self.right[new], self.born[new] = a, b, step
        self.lost[a][b] = step

    def _path(self, item: bytes, before: int) -> list[int]:
        """Lowest-rank merging of one item by the merges before a step (compile time only)."""
        parts = [item[i : i + 1] for i in range(len(item))]
        while len(parts) > 2:
            ranks = [self.ids.get(x + y, before) for x, y in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] >= before:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after ``a`` has the arc ``b``."""
        key = a * self.n + b
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        infinite = self.n + 1
        until = infinite
        s = a
        while s >= 0:
            lost = self.lost[s]
            if lost:
                x, limit = b, infinite
                while x >= 0:
                    k = lost.get(x)
                    if k is not None and k < until and k <= limit:
                        return False
                    limit, x = self.born[x], self.left[x]
            until, s = self.born[s], self.right[s]
        return True

    def _insert(self, item: bytes, i: int) -> None:
        node = 0
        for byte in item:
            nxt = self.trie[node].get(byte)
            if nxt is None:
                nxt = self.trie[node][byte] = len(self.trie)
                self.trie.append({})
                self.final.append(-1)
            node = nxt
        self.final[node] = i

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one accepted path over the word's bytes."""
        n = len(word)
        if whole := self.ids.get(word, -1) + 1:
            if n == 1 or self.left[whole - 1] >= 0:
                return [whole - 1]
        item, source = [-1] * (n + 1), [0] * (n + 1)
        trie, final, follows = self.trie, self.final, self.follows
        for i in range(n):
            here = item[i]
            if i and here < 0:
                continue
            node = 0
            for j in range(i, n):
                node = trie[node].get(word[j], -1)
                if node < 0:
                    break
                c = final[node]
                if c >= 0 and item[j + 1] < 0 and (not i or follows(here, c)):
                    item[j + 1], source[j + 1] = c, i
        out, j = [], n
        while j:
            out.append(item[j])
            j = source[j]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in _splitter().findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                    self.arcs.clear()
                ids = words[w] = self.encode_word(w.encode("utf-8", "surrogatepass"))
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.items[i] for i in ids).decode("utf-8", "replace")


_SPLIT = None
_COMPILED: dict[int, MergeAutomaton] = {}


def _splitter():
    global _SPLIT
    if _SPLIT is None:
        import regex

        _SPLIT = regex.compile(PATTERN)
    return _SPLIT


def compiled(items: list[bytes]) -> MergeAutomaton:
    """The automaton of a vocabulary, built once in each Python worker."""
    key = hash((len(items), items[-1], items[len(items) // 2]))
    if key not in _COMPILED:
        _COMPILED[key] = MergeAutomaton(items)
    return _COMPILED[key]


def encode_texts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document.  The vocabulary file is read on the driver
    and broadcast (its size is that of the file, whatever the corpus)."""
    items = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(items.value)
        for part in (batch.slice(at, TOGETHER) for batch in batches for at in range(0, batch.num_rows, TOGETHER)):
            ids = [automaton.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` (doc_id first) and n_tokens of every document."""
    items = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    slim = spread(docs.select(*keep, F.col("text")), keep[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(items.value)
        for batch in batches:
            sizes = [len(automaton.encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_ids(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of encoded documents: the labels of the arcs taken, one after the other."""
    items = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = items.value
        for batch in batches:
            texts = [b"".join(labels[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
