"""Problem 8: the language of every document, and of every segment of a mixed one.

Method: a sentence is the average of the hashed embeddings of its words and
their subwords; a linear softmax over that average gives the language, for all
languages and scripts alike.  Both are trained in numpy by stochastic gradient
descent on a bounded, hashed sample of labelled documents.  Labels are partly
wrong, so it is fitted on the sentences whose labels models of other documents
confirm.  A segment is a run of sentences of one language, found by dynamic
programming with a cost for a change.

Rejection is calibrated in two ways: temperature and a least confidence on
held-out sentences (under it the best guess is as likely wrong as right), and a
least familiarity on held-out words, each left out of its language's vocabulary
in turn: the share of a new word's letters and of its groups of three and four
letters that the other words hold.  Ukrainian is like no listed language but
Russian, yet its letters and groups are not Russian ones: such text is ``und``.
In scripts without spaces, whose characters are words, a text is unfamiliar
where under STRANGE of its characters are known.

Defined results
---------------
* null or blank texts and texts without letters have no language and are no cases.
* a label in other notation (``nob``, ``en-GB``, ``NB``) is read as its language;
  null, blank, ``??`` and ``und`` are missing labels, as is anything unreadable.
* a language counts with at least ``SEVERAL`` sentences of its own; the one with
  most text always does.  A text in an unfamiliar language alone is ``und``.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.session import input_bytes, spread

LANGUAGES = ("nb", "nn", "en", "da", "sv", "de", "fr", "es", "ru", "el", "zh", "ja", "th", "hi", "ar")
#: So many of them are written in Latin script.
LATIN = 8
#: Hash buckets of the embeddings and of the letter groups a language is known by, embedding size, passes.
BUCKETS, KNOWN, WIDTH, EPOCHS = 1 << 17, 1 << 20, 16, 4
#: What the model is fitted on: documents a language, characters a document at most, sentences a language at most.
SAMPLE, SAMPLE_LENGTH, SENTENCES_A_LANGUAGE = 500, 20_000, 3000
#: Letter groups a segment needs to be called unfamiliar, standard deviations its groups (letters) may lie under the rate
#: of held-out words, and the share of known characters under which a text without spaces is unfamiliar.
GROUPS, GROUP_ROOM, LETTER_ROOM, STRANGE = 30, 2.0, 4.0, 0.1
#: Distinct words a worker remembers the scores of before it starts afresh.
WORDS = 300_000
#: Documents whose sentences are scored together.
TOGETHER = 512
#: Letters a sentence needs to count, and letters from which its evidence counts in full; in other scripts than Latin a quarter.
WHOLE, FULL = 24, 40
#: Sentences that make a language count; cost of a change of language between sentences.
SEVERAL, CHANGE = 2, 2.5

# Other notations of the languages.
NOTATIONS = {
    "nob": "nb", "nno": "nn", "eng": "en", "dan": "da", "swe": "sv", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es",
    "rus": "ru", "ell": "el", "gre": "el", "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th", "hin": "hi", "ara": "ar",
    "no": "nb", "nor": "nb", "bokmål": "nb", "nynorsk": "nn", "norsk": "nb", "english": "en", "cmn": "zh",
}
_MARKS = re.compile(r"[.!?…؟]+[»”\"“’)]*\s+|[。！？।]+[」』”’）]*|(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)\s*")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[^\d\s])|(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)\s*")
_THAI = re.compile(r"[฀-๿]")
_NUMBER = re.compile(r"\d+ ")
_SIGNS = "\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0955-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_SIGNS}])*(?:['’][^\W\d_]+)?")
_LETTER = re.compile(r"[^\W\d_]")
#: Scripts written without spaces between words, and all but Latin.
_SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_OTHER = re.compile(r"[^\x00-\u036f\u1e00-\u1eff\u2000-\u2bff\ufb00-\ufb06]")


def normal_label(name: str = "lang") -> Column:
    """The language a label means, null where it means none (JVM side)."""
    base = F.lower(F.element_at(F.split(F.trim(name), "[-_]"), 1))
    pairs = [F.lit(x) for kv in {**{l: l for l in LANGUAGES}, **NOTATIONS}.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), base)


def ends_piece(text: str, m: re.Match) -> bool:
    """Whether a mark ends a rough sentence: after a word of three letters, before a capital or a number."""
    first = m.group()[0]
    if first not in ".!?…":
        return True
    if not text[max(0, m.start() - 3) : m.start()].isalpha() or m.start() < 3:
        return False
    at = m.end()
    following = text[at : at + 1]
    if following and following in "«„“\"'(¿¡»":
        following = text[at + 1 : at + 2]
    return following.isalpha() and not following.islower() or bool(_NUMBER.match(text, at))


def pieces(text: str) -> list[tuple[int, int]]:
    """Rough sentences: spans that hold letters; what has none joins the one before."""
    cuts = [m.end() for m in _MARKS.finditer(text) if ends_piece(text, m)]
    if not text.isascii() and _THAI.search(text):
        cuts = sorted({*cuts, *(m.end() for m in _THAI_GAP.finditer(text))})
    out: list[tuple[int, int]] = []
    a = 0
    for b in [*cuts, len(text)]:
        if _LETTER.search(text, a, b):
            out.append((a, b))
        elif out and a < b:
            out[-1] = (out[-1][0], b)
        a = b
    return out


_CACHE: dict[str, tuple[np.ndarray, int, int]] = {}


def word_features(word: str) -> tuple[np.ndarray, int, int]:
    """Hashes of a word and of its subwords, and how many at the end are its letters and after them its letter
    groups (of three and four; none in scripts without spaces)."""
    known = _CACHE.get(word)
    if known is None:
        from xxhash import xxh32_intdigest

        if len(_CACHE) > 200_000:
            _CACHE.clear()
        if _SPACELESS.match(word):
            grams, groups = [word], []
        else:
            w = f"<{word}>"
            grams = [w] + [w[i : i + n] for n in (2, 5) for i in range(len(w) - n + 1) if n < len(w)]
            groups = [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)]
        known = _CACHE[word] = np.fromiter((xxh32_intdigest(g.encode()) for g in (*grams, *word, *groups)), np.int64, len(grams) + len(word) + len(groups)), len(word), len(groups)
    return known


def counted_words(text: str) -> list[str]:
    """Folded words; those with a capital (names, mostly) only if first, or where no others are left.
    In scripts without spaces every two neighbouring characters are a word."""
    return words_and_letters(text)[0]


def words_and_letters(text: str) -> tuple[list[str], int]:
    """The counted words of a text, and the letters of all its words (in other scripts than Latin each counts for four)."""
    plain_text = text.isascii()
    if not plain_text and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    words = _WORD.findall(text)
    letters = sum(map(len, words))
    counted = [w for i, w in enumerate(words) if i == 0 or not w[0].isupper()] or words
    if plain_text or not _OTHER.search(text):
        return [w[:40].casefold() for w in counted], letters
    if len(_OTHER.findall(text)) * 2 > letters:
        letters *= 4
    out: list[str] = []
    for w in counted:
        if _SPACELESS.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w[:40].casefold())
    return out, letters


def features(text: str) -> np.ndarray:
    parts = [word_features(w)[0] for w in counted_words(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


_BITS = np.arange(len(LANGUAGES))


class Model:
    """Embeddings and softmax of the languages, temperature, least confidence, known letter groups and least familiarity."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> None:
        self.e, self.w, self.b, self.t, self.threshold = embeddings, weights, bias, temperature, threshold
        #: A bit a language of every letter and letter group; rates of new words' known letters and groups (of none: 0).
        self.known = np.zeros(KNOWN, np.uint16)
        self.rates = np.zeros((2, len(LANGUAGES)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "table", "met", "used")}

    def learn_words(self, language: int, words: Iterable[str]) -> None:
        """Letters and groups of a language's words, and at what rates a word's are found in the others."""
        kinds = [[(f[len(f) - g - n : len(f) - g], f[len(f) - g :]) for w in words for f, n, g in (word_features(w),)], (0, 1)]
        for kind in kinds[1]:
            held = Counter(h for parts in kinds[0] for h in set(parts[kind].tolist()))
            every = sum(len(parts[kind]) for parts in kinds[0])
            again = sum(held[h] > 1 for parts in kinds[0] for h in parts[kind].tolist())
            self.rates[kind, language] = again / every if every else 0.0
            self.known[np.fromiter(held, np.int64, len(held)) % KNOWN] |= np.uint16(1 << language)

    def familiarity(self, letters: np.ndarray, groups: np.ndarray, latin: bool) -> np.ndarray:
        """(letters known to each language, groups known to each language, letters and groups in Latin script, in others)"""
        bits = [((self.known[x % KNOWN][:, None] >> _BITS) & 1).sum(0) for x in (letters, groups)]
        counts = [len(letters), len(groups)]
        return np.concatenate([*bits, counts + [0, 0] if latin else [0, 0] + counts])

    def is_familiar(self, language: int, held: np.ndarray) -> bool:
        """Whether as many of a text's letters and groups (in the language's script) are known as of new words of the language."""
        k = len(LANGUAGES)
        letters, groups = held[-4:-2] if language < LATIN else held[-2:]
        if 4 * letters < held[-4] + held[-2]:  # hardly a letter of it is in the language's script
            return False
        if groups < GROUPS:  # too short, or without spaces
            return letters < GROUPS or groups > 0 or held[language] >= STRANGE * letters
        for known, n, rate, room in ((held[language], letters, self.rates[0, language], LETTER_ROOM), (held[k + language], groups, self.rates[1, language], GROUP_ROOM)):
            if known < n * rate - room * (n * rate * (1 - rate)) ** 0.5 - 1:
                return False
        return True

    def word_row(self, word: str) -> int:
        """Row of a word not met before in ``table`` (its part of the scores, that is its embeddings' sum times the
        weights, and its features' number) and in ``met`` (its familiarity)."""
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        f, n, g = word_features(word)
        row = self.rows[word] = self.used
        self.table[row, :-1], self.table[row, -1] = self.e[f % BUCKETS].sum(0) @ self.w, len(f)
        self.met[row] = self.familiarity(f[len(f) - g - n : len(f) - g], f[len(f) - g :], not _OTHER.match(word))
        self.used += 1
        return row

    def score_words(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probabilities of the sentences, rows of all their words, where each sentence's begin)"""
        k = len(LANGUAGES)
        if self.__dict__.get("rows") is None or len(self.rows) >= WORDS:
            self.rows, self.used = {}, 0
            self.table, self.met = np.zeros((4096, k + 1), np.float32), np.zeros((4096, 2 * k + 4), np.int16)
        get, new = self.rows.get, self.word_row
        flat = []
        for x in sentences:
            for w in x:
                row = get(w)
                flat.append(new(w) if row is None else row)
        words = np.fromiter(flat, np.int32, len(flat))
        lengths = np.array([len(x) for x in sentences])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        total = np.zeros((len(sentences), k + 1))
        some = lengths > 0
        if len(words):
            total[some] = np.add.reduceat(self.table[words], starts[:-1][some], axis=0)
        z = (total[:, :k] / np.maximum(total[:, k:], 1) + self.b) / self.t
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True)), words, starts

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of the languages, one row a bag."""
        h = np.stack([self.e[b % BUCKETS].mean(0) if len(b) else np.zeros(self.e.shape[1], np.float32) for b in bags])
        z = (h @ self.w + self.b) / self.t
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7, rate: float = 0.25, epochs: int = EPOCHS) -> Model:
    """Averaged-embedding softmax by mini-batch stochastic gradient descent with adaptive steps."""
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    share = np.bincount(labels, minlength=k)
    weight = np.where(share > 0, (share.max() / np.maximum(share, 1)) ** 0.5, 0).astype(np.float32)
    w += rng.normal(0, 0.1, w.shape)
    rows_of, counts_of = zip(*(np.unique(bag % BUCKETS, return_counts=True) for bag in bags))
    parts_of = [(c / c.sum()).astype(np.float32) for c in counts_of]
    n, size = len(bags), 32
    steps = epochs * max(1, n // size)
    step = 0
    e2, w2, b2 = np.full(BUCKETS, 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n - n % size or n, size):
            batch = order[i : i + size]
            lengths = [len(rows_of[j]) for j in batch]
            rows, place = np.unique(np.concatenate([rows_of[j] for j in batch]), return_inverse=True)
            share_of = np.zeros((len(batch), len(rows)), np.float32)  # of each sentence's average every feature's part
            share_of[np.repeat(np.arange(len(batch)), lengths), place] = np.concatenate([parts_of[j] for j in batch])
            h = share_of @ e[rows]
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(batch)), labels[batch]] -= 1
            g *= weight[labels[batch]][:, None] / len(batch)
            lr = rate * max(0.05, 1 - step / steps)
            back = share_of.T @ (g @ w.T).astype(np.float32)
            gw, gb = h.T @ g, g.sum(0)
            e2[rows] += (back**2).mean(1)
            w2 += gw**2
            b2 += gb**2
            e[rows] -= lr * back / np.sqrt(e2[rows])[:, None]
            w -= lr * gw / np.sqrt(w2)
            b -= lr * gb / np.sqrt(b2)
            step += 1
    return Model(e, w, b)


def calibrate(model: Model, bags: list[np.ndarray], labels: np.ndarray) -> None:
    """Temperature of least loss, and the confidence under which a held-out error is likelier than not to be found."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.3, 5, 25):
        model.t = float(t)
        loss = -model.scores(bags)[np.arange(len(bags)), labels].mean()
        best = min(best, (loss, float(t)))
    model.t = best[1]
    s = model.scores(bags)
    right, top = s.argmax(1) == labels, np.exp(s.max(1))
    grid = np.linspace(0.2, 0.95, 31)
    low = [t for t in grid if (top < t).any() and right[top < t].mean() < 0.5]
    model.threshold = min(0.6, float(max(low))) if low else 0.25


def training_sentences(rows: list[tuple[str, str]]) -> tuple[list[list[str]], list[np.ndarray], np.ndarray, np.ndarray]:
    """Words, features, labels and documents of the sentences of labelled documents, a bounded number a language."""
    words, labels, owner = [], [], []
    taken = dict.fromkeys(LANGUAGES, 0)
    for n, (text, label) in enumerate(rows):
        if label not in taken or taken[label] >= SENTENCES_A_LANGUAGE:
            continue
        for a, b in pieces(text):
            own = counted_words(text[a:b])
            if sum(map(len, own)) >= 8:
                words.append(own)
                labels.append(LANGUAGES.index(label))
                owner.append(n)
                taken[label] += 1
    return words, [np.concatenate([word_features(w)[0] for w in x]) for x in words], np.asarray(labels), np.asarray(owner)


def train(docs: DataFrame) -> Model:
    """Fits on about SAMPLE labelled documents a language, chosen by a hash of their id."""
    labelled = docs.select("doc_id", "text", normal_label().alias("label")).filter(F.col("label").isNotNull() & F.length("text").between(20, SAMPLE_LENGTH))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # one row a language
    keep = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    for name, n in sizes.items():
        keep = keep | ((F.col("label") == name) & (place < int(1_000_000 * min(1.0, SAMPLE / n))))
    rows = labelled.filter(keep).orderBy(place, "doc_id").select("text", "label").limit(2 * SAMPLE * len(LANGUAGES)).collect()
    return fit_rows([(r["text"], r["label"]) for r in rows])


def sound(bags: list[np.ndarray], labels: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which sentences' labels hold: each half of the documents is judged by a model of the other half, which
    cannot have learned its errors by heart, and both the sentence and its whole document must agree."""
    good = np.zeros(len(bags), bool)
    for half in (0, 1):
        mine = np.flatnonzero(owner % 2 == half)
        others = np.flatnonzero(owner % 2 != half)
        if not len(mine) or not len(others):
            good[mine] = True
            continue
        s = fit([bags[i] for i in others], labels[others], epochs=3).scores([bags[i] for i in mine])
        docs, place = np.unique(owner[mine], return_inverse=True)
        whole = np.zeros((len(docs), s.shape[1]))
        np.add.at(whole, place, np.maximum(s, -12.0))
        good[mine] = (s.argmax(1) == labels[mine]) & (whole.argmax(1)[place] == labels[mine])
    return good


def fit_rows(rows: list[tuple[str, str]]) -> Model:
    """Fit on the sentences whose labels hold; calibration on those of a tenth of the documents, which it hasn't seen."""
    words, bags, labels, owner = training_sentences(rows)
    if not len(bags):
        return Model(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32))
    good = sound(bags, labels, owner)
    good = good if good.any() else ~good
    held = owner % 10 == 9
    use = np.flatnonzero(good & ~held) if (good & ~held).any() else np.flatnonzero(good)
    model = fit([bags[i] for i in use], labels[use], seed=8)
    for k in range(len(LANGUAGES)):
        seen = Counter(w for i in np.flatnonzero(good & (labels == k)) for w in words[i])
        model.learn_words(k, [w for w, n in seen.items() if n > 1])
    check = np.flatnonzero(held & good) if (held & good).any() else use
    calibrate(model, [bags[i] for i in check], labels[check])
    return model


_TRAINED: dict[tuple, Model] = {}


def trained(docs: DataFrame) -> Model:
    """The model of a table, trained once a session (the table is known by its plan and bytes)."""
    key = (docs.sparkSession.sparkContext.applicationId, docs.semanticHash(), input_bytes(docs))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(docs)
    return _TRAINED[key]


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Writes a model as a table of one row, on any file system Spark knows."""
    parts = {"e": model.e, "w": model.w, "b": model.b, "known": model.known, "rates": model.rates, "more": np.array([model.t, model.threshold])}
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **parts)
    spark.createDataFrame([(bytearray(buffer.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    parts = np.load(io.BytesIO(spark.read.parquet(path).first()["model"]), allow_pickle=False)
    model = Model(parts["e"], parts["w"], parts["b"], *map(float, parts["more"]))
    model.known, model.rates = parts["known"], parts["rates"]
    return model


def segment(model: Model, text: str) -> list[tuple[int, int, str, float, int, str]]:
    """(start, end, language or und, confidence, whole sentences, best guess) of the runs of one language of a text."""
    return segment_all(model, [text])[0]


def segment_all(model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float, int, str]]]:
    """The same for many texts, whose sentences are scored together."""
    spans, letters, owner, words = [], [], [], []
    for n, text in enumerate(texts):
        for a, b in pieces(text):
            counted, size = words_and_letters(text[a:b])
            spans.append((a, b))
            letters.append(size)
            owner.append(n)
            words.append(counted)
    out: list[list[tuple[int, int, str, float, int, str]]] = [[] for _ in texts]
    if not spans:
        return out
    size = np.asarray(letters)
    logp, rows, starts = model.score_words(words)
    logp = np.maximum(logp, -12.0) * np.minimum(1.0, size / FULL)[:, None]
    whole = size >= WHOLE
    best = logp.argmax(1)
    bounds = np.flatnonzero(np.diff(owner, prepend=-1))
    for begin, end in zip(bounds, [*bounds[1:], len(spans)]):
        own = logp[begin:end]
        path = best[begin:end].tolist() if (best[begin:end] == best[begin]).all() else best_path(own)
        start = 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[start]:
                k = path[start]
                total = own[start:i].sum(0)
                p = np.exp(np.maximum((total - total.max()) / (i - start) ** 0.5, -50))
                confidence = float(p[k] / p.sum())
                familiar = model.is_familiar(k, model.met[rows[starts[begin + start] : starts[begin + i]]].sum(0))
                name = LANGUAGES[k] if familiar and confidence >= model.threshold else "und"
                out[owner[begin]].append((spans[begin + start][0], spans[begin + i - 1][1], name, confidence, int(whole[begin + start : begin + i].sum()), LANGUAGES[k] if familiar else "und"))
                start = i
    return out


def best_path(logp: np.ndarray) -> list[int]:
    """The likeliest language of each sentence when every change costs CHANGE."""
    n, size = logp.shape
    best, back = logp[0].copy(), np.zeros((n, size), int)
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - CHANGE
        stay = best >= change
        back[i] = np.where(stay, np.arange(size), top)
        best = np.where(stay, best, change) + logp[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def summary(found: list[tuple[int, int, str, float, int, str]]) -> list[tuple[str, int, int, float]]:
    """(language, sentences, characters, confidence) of the languages that count, most text first.

    Rejected segments count for none, but if all are, the best guess stands with its low confidence
    (which is ``und`` for unfamiliar text).
    """
    total: dict[str, list[float]] = {}
    rejected = all(f[2] == "und" for f in found)
    for a, b, name, confidence, n, guess in found:
        name = guess if rejected else name
        x = total.setdefault(name, [0, 0, 0.0])
        x[0] += n
        x[1] += b - a
        x[2] += confidence * (b - a)
    ranked = sorted(total.items(), key=lambda kv: (kv[0] == "und", -kv[1][1], kv[0]))
    return [(k, int(n), int(c), s / c) for i, (k, (n, c, s)) in enumerate(ranked) if i == 0 or (n >= SEVERAL and k != "und")]


def _classify(docs: DataFrame, emit, schema: str, kinds: list[pa.DataType], given: Model | None) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(given or trained(docs))
    names = [c.split()[0] for c in schema.split(", ")]
    slim = spread(docs.select("doc_id", "text", normal_label().alias("label")).filter(F.col("text").rlike(r"\p{L}")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                docs_, texts, labels = (c.to_pylist() for c in batch.slice(at, TOGETHER).columns)
                rows = [r for doc, label, found in zip(docs_, labels, segment_all(fitted, texts)) for r in emit(doc, label, found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return slim.mapInArrow(run, schema)


def document_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, lang, sentences, characters, confidence, languages): one row per language that counts."""

    def emit(doc, label, found):
        counted = summary(found)
        return [(doc, label, k, n, c, conf, len(counted)) for k, n, c, conf in counted]

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
    return _classify(docs, emit, "doc_id bigint, label string, lang string, sentences int, characters int, confidence double, languages int", kinds, model)


def document_segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, segment, start_char, end_char, lang, confidence) of every document."""

    def emit(doc, label, found):
        return [(doc, i, a, b, k, conf) for i, (a, b, k, conf, _, _) in enumerate(found)]

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
    return _classify(docs, emit, "doc_id bigint, segment int, start_char int, end_char int, lang string, confidence double", kinds, model)


def mislabelled(languages: DataFrame) -> DataFrame:
    """(doc_id, lang) of the documents whose label is missing or wrong or whose text is mixed."""
    return languages.filter(F.col("label").isNull() | (F.col("languages") > 1) | (F.col("label") != F.col("lang"))).filter("lang <> 'und'").select("doc_id", "lang")
