"""Visually identical text with different characters: one consistent form by Viterbi search of look-alike lattices."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phloem.llm.charlm import _M1, _M2, _MASK, _mix, ngram_counts, word_table
from phloem.storage import Stage

#: Letters of the Latin, Cyrillic and Greek scripts that are drawn alike, one class a word.
CLASSES = (
    "aа cсϲ dԁ eе hһ iі jјϳ lӏ oоο pр qԛ sѕ vνѵ wԝ xх yу "
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YУΥҮ ZΖ ĐÐƉ"
).split()
_ALIKE = {c: members for members in CLASSES for c in members}

#: Hyphens that differ in kind only.
_HYPHENS = dict.fromkeys(map(ord, "‐‑‒−﹣－"), "-")
#: Compatibility decompositions that only change width, font or spacing; superscripts, fractions and circles stay.
_KEPT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")

#: Ids of one spelling that are joined under one key.
_HOLDERS = 100_000


def _compatible(ch: str) -> str:
    kind = unicodedata.decomposition(ch)
    if not kind or kind.startswith(_KEPT):
        return ch
    return unicodedata.normalize("NFKD", ch) if kind.startswith("<") else ch


def _ignorable(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F


class _Fold(dict):
    """What a character is read as, worked out once for each that occurs."""

    def __missing__(self, o: int) -> str | None:
        ch = chr(o)
        if o < 128:
            made = " " if ch == "\t" else ch
        elif o in _HYPHENS:
            made = "-"
        elif _ignorable(ch):
            made = None
        elif unicodedata.category(ch) == "Zs":
            made = " "
        else:
            made = _compatible(ch).translate(_HYPHENS)
        self[o] = made
        return made


_FOLD = _Fold()
_FIRST = str.maketrans({c: members[0] for members in CLASSES for c in members})


def folded(text: str) -> str:
    """Decomposed text without ignorable characters, with one sort of blank and hyphen and without width forms."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFD", text.translate(_FOLD))


def lattice_key(text: str) -> str:
    """The name of the text's lattice: each letter as the first of its class. Texts of one lattice have one form."""
    return folded(text).translate(_FIRST)


def _script(ch: str) -> str:
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    return unicodedata.name(ch, "").partition(" ")[0]


class Lattice:
    """The one form of a token: the best path through its look-alike lattice.

    Every letter stands for its whole class, so tokens that look the same have the same lattice and hence the same
    form, whatever characters they were typed with. A path scores the bigrams of the character model and pays for each
    change of script between letters; equal paths are decided by code point order.
    """

    def __init__(self, counts: np.ndarray, mixed: float = 8.0):
        self.counts, self.mixed = counts, mixed
        self.total = float(counts.sum()) / 3 + 1
        self._tokens: dict[str, str] = {}
        self._pairs: dict[tuple[str, str], float] = {}

    def _bigram(self, a: str, b: str) -> float:
        known = self._pairs.get((a, b))
        if known is None:
            x, y = ord(a), ord(b)
            one = (self.counts[_mix((y * _M1) & _MASK)] + 0.5) / (self.total + 500)
            two = (self.counts[_mix((y * _M1 + x * _M2 + 1) & _MASK)] + 2 * one) / (self.counts[_mix((x * _M1) & _MASK)] + 2)
            known = self._pairs[a, b] = math.log(min(1.0, two))
        return known

    def token(self, token: str) -> str:
        known = self._tokens.get(token)
        if known is not None:
            return known
        paths: dict[tuple[str, str], tuple[float, str]] = {(" ", ""): (0.0, "")}
        for ch in token:
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for option in _ALIKE.get(ch, ch):
                script = _script(option)
                best = None
                for (before, last), (score, path) in paths.items():
                    s = score + self._bigram(before, option) - (self.mixed if script and last and script != last else 0.0)
                    candidate = (-s, path + option, script or last)
                    best = candidate if best is None or candidate < best else best
                following[option, best[2]] = (-best[0], best[1])
            paths = following
        made = min((-s, p) for s, p in paths.values())[1]
        if len(self._tokens) < 500_000 and len(token) < 64:
            self._tokens[token] = made
        return made

    def form(self, text: str) -> str:
        return unicodedata.normalize("NFC", " ".join(self.token(t) for t in folded(text).split(" ")))


def model_counts(texts: DataFrame) -> np.ndarray:
    """Character counts of the folded words of the column ``text``, over all rows."""
    return ngram_counts(word_table(texts, lambda: lambda t: folded(t).split(" ")), "NFD")


def with_form(values: DataFrame, value: str, counts: np.ndarray, form: str = "form") -> DataFrame:
    """``values`` with the one form of column ``value``; null stays null."""
    shared = values.sparkSession.sparkContext.broadcast(counts)

    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shared.value)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else lattice.form(t))

    return values.withColumn(form, F.pandas_udf(forms, "string")(F.col(value)))


def field_values(entities: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field_name, id, value): each field's value, or each element of an array field, in one pass. Nulls drop out, repeats stay."""
    kinds = dict(entities.dtypes)
    named = lambda f: lambda x: F.struct(F.lit(f).alias("field_name"), x.cast("string").alias("value"))
    each = [F.transform(F.coalesce(F.col(f), F.array().cast(kinds[f])) if kinds[f].startswith("array") else F.array(F.col(f)), named(f)) for f in fields]
    out = entities.select(F.col(id_col).alias("id"), F.explode(F.concat(*each)).alias("v")).select("v.field_name", "id", "v.value")
    return out.filter("value is not null and id is not null")


def alike_spellings(stage: Stage, values: DataFrame) -> DataFrame:
    """(field_name, form, value, n): the values that read the same as another value of their field, n rows having it.

    The lattice of every distinct value is named by one pass over its characters; only lattices with two spellings or
    more are searched. Model counts come from all distinct values, at most charlm.BUCKETS counts reach the driver.
    Values that are empty once their invisible characters and blanks are gone read as nothing and are left out.
    """

    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lattice_key)

    distinct = values.groupBy("field_name", "value").agg(F.count("*").alias("n"))
    named = distinct.withColumn("lattice", F.xxhash64("field_name", F.pandas_udf(keys, "string")("value")))  # two lattices of one name are told apart by their forms
    spelled = stage.write(named, "spellings")
    varied = spelled.groupBy("lattice").agg(F.count("*").alias("spellings")).filter("spellings > 1").select("lattice")
    some = stage.write(spelled.join(varied, "lattice", "left_semi"), "varied")
    counts = model_counts(spelled.select(F.col("value").alias("text")))
    return stage.write(with_form(some.select("field_name", "value", "n"), "value", counts).filter("trim(form) <> ''"), "forms")


def spelling_pairs(spellings: DataFrame) -> DataFrame:
    """(field_name, form, value_a, n_a, value_b, n_b): each two spellings of one form, smaller first."""
    side = lambda s: spellings.select("field_name", "form", F.col("value").alias(f"value_{s}"), F.col("n").alias(f"n_{s}"))
    return side("a").join(side("b"), ["field_name", "form"]).filter("value_a < value_b")


def _holders(pairs: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """``pairs`` with an id that has the spelling of one side; spellings of many ids are split by id over several keys."""
    parts = lambda n: F.ceil(F.col(n) / F.lit(_HOLDERS)).cast("int")
    left = pairs.withColumn("__part", F.explode(F.sequence(F.lit(0), parts(f"n_{side}") - 1)))
    right = members.select("field_name", F.col("value").alias(f"value_{side}"), F.col("id").alias(f"id_{side}"), F.pmod(F.xxhash64("id"), parts("n")).cast("int").alias("__part"))
    return left.join(right, ["field_name", f"value_{side}", "__part"]).drop("__part")


def alike_pairs(entities: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field_name, id_a, id_b): distinct pairs, smaller first, with values that read the same but differ in characters.

    Spellings are paired with spellings of the same form first and then expanded to the ids that have them, so ids that
    share one spelling are never compared, and a spelling that many ids have is split by id. ``alike_classes`` has the
    same links without the expansion. An empty table gives no rows; repeated rows and nulls change nothing.
    """
    stage = Stage(entities.sparkSession, "alike")
    values = field_values(entities, id_col, fields)
    spellings = alike_spellings(stage, values)
    members = stage.write(values.join(spellings.select("field_name", "value", "n"), ["field_name", "value"]).distinct(), "members")
    pairs = _holders(_holders(spelling_pairs(spellings), members, "a"), members, "b").filter("id_a <> id_b")
    return pairs.select("field_name", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def alike_classes(entities: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field_name, form, value, id): a row for each id and value that reads the same as another value of its field.

    All rows of one field and form read the same; those of different value are linked. Linear in the input.
    """
    stage = Stage(entities.sparkSession, "alike")
    values = field_values(entities, id_col, fields)
    spellings = alike_spellings(stage, values)
    return values.join(spellings.select("field_name", "value", "form"), ["field_name", "value"]).select("field_name", "form", "value", "id").distinct()
