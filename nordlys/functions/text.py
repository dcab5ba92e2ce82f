"""Scalar text functions: Unicode forms, fingerprints, lemma edit rules, character ids, pre-tokenizers.

All are column expressions on the JVM side but for composition and folding of
characters beyond U+02FF, which Spark has no built-in for (Arrow UDFs).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes the rules are defined by.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
TERMINAL = ".!?…"
OPENING = "«\"'([„“"
CLOSING = "»\"')]”"
NO_SPACE_BEFORE = ".,;:!?…)]}»"

# The token alternatives, in order (address, mail, number, dotted abbreviation, word, other).
TOKEN = (
    rf"(?:https?://|www\.)[^\s]+|[^\s@]+@[^\s@]+\.{WORD}+|\p{{Nd}}+(?:[.,:/\-]\p{{Nd}}+)*"
    rf"|{WORD}+(?:\.{WORD}+)+\.?|{WORD}+(?:[-'’]{WORD}+)*|[^\s]"
)

# The features that count in universal comparison.
UNIVERSAL_FEATURES = (
    "PronType", "NumType", "Poss", "Reflex", "Foreign", "Abbr", "Gender", "Animacy", "Number", "Case", "Definite", "Degree",
    "VerbForm", "Mood", "Tense", "Aspect", "Voice", "Evident", "Polarity", "Person", "Polite",
)


#: Characters from U+0300 on may change under composition; those and four more fold in a way ``lower`` doesn't know.
_COMPOSES, _FOLDS = r"[^\x{0}-\x{2FF}]", r"[^\x{0}-\x{2FF}]|[\x{B5}\x{149}\x{17F}\x{1F0}]"


def _mapped(change: Callable[[str], str]) -> Callable[[pa.Array], pa.Array]:
    def run(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return values
        return pa.array([None if x is None else change(x) for x in values.to_pylist()], pa.string())

    return run


def _compose(x: str) -> str:
    return unicodedata.normalize("NFC", x)


_nfc = F.arrow_udf(_mapped(_compose), StringType())
_folded = F.arrow_udf(_mapped(str.casefold), StringType())
_key = F.arrow_udf(_mapped(lambda x: _compose(x).casefold()), StringType())


def _where(c: Column, pattern: str, python: Callable[[Column], Column], here: Column) -> Column:
    """``python`` for the values the pattern is found in, ``here`` for all others; only the former cross to Python
    (an Arrow function is called for every row, whatever the CASE around it says, so the others go as nulls)."""
    return F.coalesce(python(F.when(c.rlike(pattern), c)), here)


def _lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def nfc(c: Column) -> Column:
    """Canonical composition; text below U+0300 already is in that form and stays in the JVM."""
    return _where(c, _COMPOSES, _nfc, c)


def casefold(c: Column) -> Column:
    """Full Unicode case folding; Latin text stays in the JVM."""
    return _where(c, _FOLDS, _folded, _lower(c))


def nfc_key(c: Column) -> Column:
    """The key under which forms are counted: composed, then case folded."""
    return _where(c, _FOLDS, _key, _lower(c))


def fingerprint(tokens: Column) -> Column:
    """SHA-256 over the composed and folded tokens, each followed by NUL; spacing, case and Unicode form do not matter.

    Null for a null list; null tokens are skipped.  NUL composes with nothing,
    so the tokens are normalised joined.
    """
    joined = F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit("\0"))), "")
    return F.when(tokens.isNotNull(), F.sha2(nfc_key(joined), 256))


def token_list(text: Column) -> Column:
    """Tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


# --- lemma edit rules: (prefix removed, suffix removed, prefix added, suffix added), in code points


def apply_rule_strict(token: Column, rule: Column) -> Column:
    """The lemma a rule gives; an error where the rule removes more than the token has."""
    fault = F.raise_error(F.concat(F.lit("the rule removes more than the token has: "), token)).cast("string")
    return F.when(token.isNull() | rule.isNull(), None).otherwise(F.coalesce(apply_rule(token, rule), fault))


def apply_rule(token: Column, rule: Column) -> Column:
    """The lemma a rule gives; null where the rule removes more than the token has."""
    keep = F.length(token) - rule["pr"] - rule["sr"]
    return F.when(keep >= 0, F.concat(rule["pa"], F.substring(token, rule["pr"] + 1, keep), rule["sa"]))


def derive_rule(token: Column, lemma: Column) -> Column:
    """The rule that turns a token into its lemma, around their longest common block.

    Among blocks of the same length the earliest in the token, then in the lemma,
    counts; without one the whole token goes as suffix and the lemma comes as suffix.
    Blocks are found by comparing substrings, longest first, inside the JVM.
    """
    n = F.length(token)
    block = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("len")),
        lambda best, a: F.aggregate(
            F.sequence(F.lit(1), n - a + 1),
            best,
            lambda top, size: F.when(
                (size > top["len"]) & lemma.contains(token.substr(a, size)),
                F.struct(a.alias("a"), F.call_function("instr", lemma, token.substr(a, size)).alias("b"), size.alias("len")),
            ).otherwise(top),
        ),
    )
    found = F.when((n > 0) & (F.length(lemma) > 0), block).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("len")))
    return F.transform(
        F.array(found),
        lambda m: F.when(
            m["len"] > 0,
            F.struct(
                (m["a"] - 1).alias("pr"), (n - (m["a"] - 1) - m["len"]).alias("sr"),
                lemma.substr(F.lit(1), m["b"] - 1).alias("pa"), lemma.substr(m["b"] + m["len"], F.length(lemma)).alias("sa"),
            ),
        ).otherwise(F.struct(F.lit(0).alias("pr"), n.alias("sr"), F.lit("").alias("pa"), lemma.alias("sa"))),
    )[0]


def strip_marker(lemma: Column) -> Column:
    """One leading ``$`` goes."""
    return F.regexp_replace(lemma, r"^\$", "")


def restore_marker(lemma: Column, marked: Column) -> Column:
    """The ``$`` comes back for forms that carried it in training (``marked``), unless the lemma has one."""
    return F.when(F.coalesce(marked, F.lit(False)) & ~lemma.startswith("$"), F.concat(F.lit("$"), lemma)).otherwise(lemma)


# --- feature maps


def feature_bundle(features: Column, separator: str = "|") -> Column:
    """Sorted ``Name=Value`` pairs as one string; ``_`` for none."""
    pairs = F.array_sort(F.transform(F.map_entries(features), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(pairs) > 0, F.array_join(pairs, separator)).otherwise(F.lit("_"))


def universal_subset(features: Column) -> Column:
    return F.map_filter(features, lambda k, _: k.isin(*UNIVERSAL_FEATURES))


def common_gender(upos: Column, features: Column) -> Column:
    """``Gender=Fem,Masc`` of adjectives and determiners reads ``Com``."""
    return F.transform_values(features, lambda k, v: F.when((k == "Gender") & (v == "Fem,Masc") & upos.isin("ADJ", "DET"), F.lit("Com")).otherwise(v))


def drop_value(features: Column, name: str, value: str) -> Column:
    """Takes one value out of a feature; a feature left without values goes."""
    less = F.transform_values(features, lambda k, v: F.when(k == name, F.array_join(F.filter(F.split(v, ","), lambda x: x != value), ",")).otherwise(v))
    return F.map_filter(less, lambda k, v: v != "")


# --- character ids

PAD, UNKNOWN, START, END, TRUNCATED, FIRST_LITERAL = range(6)


def encode_characters(token: Column, ids: Column, most: int = 32) -> Column:
    """START, ids of the characters, END; longer tokens keep both ends around TRUNCATED.

    ``ids`` is a map column of character to id; others are UNKNOWN.
    """
    chars = F.filter(F.split(nfc(token), ""), lambda c: c != "")
    mapped = F.transform(chars, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(UNKNOWN)))
    head, tail = (most - 3 + 1) // 2, (most - 3) // 2
    n = F.size(mapped)
    cut = F.concat(F.slice(mapped, 1, head), F.array(F.lit(TRUNCATED)), F.slice(mapped, n - tail + 1, F.lit(tail)) if tail else F.array().cast("array<int>"))
    body = F.when(n <= most - 2, mapped).otherwise(cut)
    return F.concat(F.array(F.lit(START)), body, F.array(F.lit(END)))


# --- sub-word preparation


def spaced_words(tokens: Column, spaced: Column) -> Column:
    """Tokens as pre-split words: a blank before those that follow a space."""
    return F.transform(F.arrays_zip(tokens.alias("t"), spaced.alias("s")), lambda x: F.when(x["s"], F.concat(F.lit(" "), x["t"])).otherwise(x["t"]))


def pretokenize_bytes(text: Column) -> Column:
    """Byte-level pre-splitting: contractions, letters, numbers or symbols with one leading blank, runs of space."""
    ws = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]"
    pattern = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\x{{09}}-\x{{0D}}\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]+|{ws}+(?!.)|{ws}+(?={ws})|{ws}+"
    return F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(0))


def pretokenize_cased(text: Column) -> Column:
    """Pre-splitting at case changes with single digits (the second public scheme)."""
    upper, lower, mark = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]", r"(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    pattern = rf"[^\r\n\p{{L}}\p{{N}}]?{upper}*{lower}+{mark}|[^\r\n\p{{L}}\p{{N}}]?{upper}+{lower}*{mark}|\p{{N}}| ?[^\s\p{{L}}\p{{N}}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def compatibility_fold(text: Column) -> Column:
    """The part of compatibility normalisation text needs: ellipsis, ligatures, signs, wide spaces."""
    # Characters and what they fold to.
    table = (("…", "..."), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("№", "No"), ("™", "TM"))
    out = text
    for a, b in table:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " ")


def utf8_to_utf16(text: Column, at: Column) -> Column:
    """A UTF-8 byte offset as UTF-16 code units; an error inside a character or beyond the text, null for nulls."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, F.lit(1), at)
    units = (F.octet_length(F.encode(F.decode(head, "UTF-8"), "UTF-16BE")) / 2).cast("int")
    fits = (at >= 0) & (at <= F.octet_length(raw)) & F.is_valid_utf8(head.cast("string"))
    return F.when(text.isNull() | at.isNull(), None).when(fits, units).otherwise(_no_boundary(at))


def utf16_to_utf8(text: Column, at: Column) -> Column:
    """UTF-16 code units as a UTF-8 byte offset; an error inside a surrogate pair or beyond the text, null for nulls.

    The first ``at`` units are cut out as bytes and read as text: half a pair at their end is no text.
    """
    raw = F.encode(text, "UTF-16BE")
    last = F.conv(F.hex(F.substring(raw, 2 * at - 1, F.lit(2))), 16, 10).cast("int")
    fits = (at >= 0) & (2 * at <= F.octet_length(raw)) & ~F.coalesce((at > 0) & last.between(0xD800, 0xDBFF), F.lit(False))
    head = F.decode(F.substring(raw, F.lit(1), 2 * at), "UTF-16BE")
    return F.when(text.isNull() | at.isNull(), None).when(fits, F.octet_length(head)).otherwise(_no_boundary(at))


def _no_boundary(at: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no character boundary: "), at.cast("string"))).cast("int")


def any_word(words: Iterable[str]) -> str:
    """A regular expression of alternatives, longest first, each quoted."""
    quoted = ("".join(c if c.isalnum() else "\\" + c for c in w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return "|".join(quoted)
