"""Rule segmentation: wrapped lines, sentences, tokens, chunks and quality filters.

Every rule looks at a token's neighbours only, so each document is handled by
expressions over its own text: regular expressions with look-around and
higher-order functions.  No step shuffles, explodes words or uses a window; the
only row change is the explosion into sentences at the end.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nordlys.functions.text import CLOSING, OPENING, SPACE, TERMINAL, TOKEN, any_word
from nordlys.session import enough_tasks

_OPEN = "«\\x22'(\\[„“"
_CLOSE = "»\\x22')\\]”"


@dataclass(frozen=True)
class Policy:
    """Abbreviations (lower case, trimmed, ending in a period) and limits of a segmentation."""

    abbreviations: frozenset[str] = field(default_factory=frozenset)
    minimum_tokens: int = 4
    maximum_tokens: int = 128
    minimum_letter_ratio: float = 0.5

    def __post_init__(self) -> None:
        for a in self.abbreviations:
            if a != a.strip().lower() or not a.endswith("."):
                raise ValueError(f"not a lower-case abbreviation with its period: {a!r}")
        if not 0 < self.minimum_tokens <= self.maximum_tokens:
            raise ValueError("token limits must be positive and in order")
        if not 0 <= self.minimum_letter_ratio <= 1:
            raise ValueError("the letter ratio lies between 0 and 1")


def policy_of(abbreviations: Iterable[str | None], **limits) -> Policy:
    """A policy from an untidy list: entries are trimmed, lowered and given their period."""
    clean = {a.strip().lower().rstrip(".") + "." for a in abbreviations if a and a.strip(" .")}
    return Policy(frozenset(clean), **limits)


def restore_spaces(text: Column) -> Column:
    """A space after a terminal mark that stands between a small letter and a capital or opening mark."""
    return F.regexp_replace(text, rf"(?<=[a-zæøå])([.!?…])(?=[A-ZÆØÅ{_OPEN}])", "$1 ")


def merge_lines(text: Column) -> Column:
    """Paragraphs: lines that go on in small letters are joined, with a trailing hyphen dropped."""
    tidy = F.regexp_replace(F.regexp_replace(text, rf"(?:(?!\n){SPACE})+", " "), r" ?\n ?", "\n")
    whole = F.regexp_replace(F.regexp_replace(tidy, r"-\n(?=\p{Ll})", ""), r"(?<![.!?…:\n])\n(?=\p{Ll})", " ")
    return F.filter(F.transform(F.split(whole, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def split_sentences(paragraph: Column, policy: Policy) -> Column:
    """Sentences of a paragraph: cut after terminal marks before a capital or opening mark, unless protected."""
    kept = r"\p{Nd}{1,3}\."
    if policy.abbreviations:
        kept += "|" + any_word(policy.abbreviations)
    cut = rf"(?<=[{TERMINAL}])(?<!(?:^|\s)(?iu:{kept}))\s+(?=[\p{{Lu}}{_OPEN}])"
    return F.filter(F.split(paragraph, cut), lambda s: s != "")


def raw_tokens(sentence: Column) -> Column:
    """Tokens of a sentence, each with the white space before it."""
    return F.regexp_extract_all(sentence, F.lit(rf"\s*(?:{TOKEN})"), F.lit(0))


def attach_periods(raw: Column, policy: Policy) -> Column:
    """(token, space) of raw tokens: periods of abbreviations and short ordinals are attached.

    ``raw`` is read several times: pass a column, not an expression.
    """
    n = F.size(raw)
    listed = F.array(*[F.lit(a) for a in sorted(policy.abbreviations)]) if policy.abbreviations else F.array().cast("array<string>")

    def takes_period(i: Column) -> Column:
        token = F.ltrim(F.get(raw, i))
        return (F.get(raw, i + 1) == ".") & ((token.rlike(r"^\p{Nd}{1,3}$") & (i + 2 < n)) | F.array_contains(listed, F.concat(F.lower(token), F.lit("."))))

    marked = F.transform(
        raw,
        lambda t, i: F.struct(
            F.when(F.coalesce(takes_period(i), F.lit(False)), F.concat(F.ltrim(t), F.lit("."))).otherwise(F.ltrim(t)).alias("token"),
            ((i > 0) & t.startswith(" ")).alias("space"),
            ((i > 0) & (t == ".") & F.coalesce(takes_period(i - 1), F.lit(False))).alias("taken"),
        ),
    )
    return F.filter(marked, lambda x: ~x["taken"])


def chunks(tokens: Column, size: int) -> Column:
    """Windows of at most ``size`` tokens, in order, without overlap."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / size).cast("int")), lambda k: F.slice(tokens, k * size + 1, F.lit(size)))


def with_paragraphs(docs: DataFrame, keep: list[str], text: str, restore: bool) -> DataFrame:
    """``keep`` and the array of paragraphs, staged so that each expression is evaluated once."""
    source = restore_spaces(F.col(text)) if restore else F.col(text)
    wide = enough_tasks(docs.select(*keep, F.col(text)), keep[0])
    return wide.select(*keep, merge_lines(source).alias("_p")).filter("size(_p) > 0")


def segment(docs: DataFrame, policy: Policy, *keep: str, text: str = "text") -> DataFrame:
    """Runtime segmentation: nothing is dropped, over-long sentences come as chunks.

    Columns: ``keep``, sentence_index (in order, from 0), tokens, has_space_before.
    Null and blank texts give no rows.
    """
    staged = with_paragraphs(docs, list(keep), text, True)
    staged = staged.select(*keep, F.flatten(F.transform("_p", lambda p: split_sentences(p, policy))).alias("_s"))
    staged = staged.select(*keep, F.transform("_s", raw_tokens).alias("_r"))
    staged = staged.select(*keep, F.filter(F.transform("_r", lambda r: attach_periods(r, policy)), lambda t: F.size(t) > 0).alias("_t"))
    every = staged.select(*keep, F.posexplode(F.flatten(F.transform("_t", lambda t: chunks(t, policy.maximum_tokens)))).alias("sentence_index", "_t"))
    return every.select(*keep, "sentence_index", F.transform("_t", lambda x: x["token"]).alias("tokens"), F.transform("_t", lambda x, i: (i > 0) & x["space"]).alias("has_space_before"))


def quality_flags(sentence: Column, tokens: Column, policy: Policy) -> dict[str, Column]:
    """The silver filters, each as a boolean column."""
    start = F.regexp_replace(sentence, rf"^[{_OPEN}]+", "")
    end = F.regexp_replace(sentence, rf"[{_CLOSE}]+$", "")
    periods = F.length(F.regexp_extract(end, r"(\.*)$", 1))
    letters = F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}")))
    return {
        "length_ok": F.size(tokens).between(policy.minimum_tokens, policy.maximum_tokens),
        "readable": ~sentence.contains("�"),
        "starts_upper": start.rlike(r"^\p{Lu}"),
        "ends_terminal": end.rlike(rf"[{TERMINAL}]$"),
        "no_leaders": (periods != 2) & (periods < 4),
        "has_lower": sentence.rlike(r"\p{Ll}"),
        "enough_letters": letters / F.size(tokens) >= policy.minimum_letter_ratio,
    }


def extract(docs: DataFrame, policy: Policy, *keep: str, text: str = "text", flags: bool = False) -> DataFrame:
    """Silver extraction: sentences of high precision; with ``flags`` all sentences and what each filter says."""
    staged = with_paragraphs(docs, list(keep), text, False)
    # Tokens are made before the explosion, past which no filter can be pushed and evaluated twice.
    staged = staged.select(*keep, F.flatten(F.transform("_p", lambda p: split_sentences(p, policy))).alias("_s"))
    staged = staged.select(*keep, "_s", F.transform("_s", raw_tokens).alias("_r"))
    staged = staged.select(*keep, "_s", F.transform("_r", lambda r: attach_periods(r, policy)).alias("_t"))
    pairs = F.zip_with("_s", "_t", lambda s, t: F.struct(s.alias("sentence"), t.alias("_t"), F.transform(t, lambda x: x["token"]).alias("tokens")))
    s = staged.select(*keep, F.posexplode(pairs).alias("_place", "_x")).select(*keep, "_place", "_x.*").filter("size(_t) > 0")
    checks = quality_flags(F.col("sentence"), F.col("tokens"), policy)
    if flags:
        return s.select(*keep, F.col("_place").alias("place"), "sentence", *[c.alias(k) for k, c in checks.items()])
    s = s.filter(reduce(Column.__and__, checks.values()))
    return s.select(*keep, F.col("_place").alias("place"), "sentence", "tokens", F.transform("_t", lambda x: x["space"]).alias("has_space_before"))


__all__ = ["CLOSING", "OPENING", "Policy", "attach_periods", "chunks", "extract", "merge_lines", "policy_of", "quality_flags", "restore_spaces", "raw_tokens", "segment", "split_sentences"]
