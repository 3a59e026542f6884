"""Judged answers: what a model said about statements, questions and sentences, turned into scores by formulas.

The model's answers are columns, from ``plans.models.call`` or from a table that replays a run; nothing here calls one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.functions import scores as s
from phloem.sources.readers import lenient_json

_TEXTS = "array<string>"


def context_sentences(context: Column) -> Column:
    """Sentences of a context without its headings, numbered lines and blank lines; split after sentence ends and at dashes between blanks."""
    lines = F.filter(F.transform(F.split(F.coalesce(context, F.lit("")), "\n"), F.trim), lambda x: (x != "") & ~x.rlike(r"^\[.{0,79}\]|^##"))
    parts = F.split(F.array_join(lines, " "), r"(?<=[.!?。！？])\s+|\s+-\s+")
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def statements_of(answer: Column) -> Column:
    """An answer's sentences of three words or more: its statements where a model names none."""
    return F.filter(context_sentences(answer), lambda x: F.size(F.split(x, r"\s+")) >= 3)


def said_texts(raw: str, field: str) -> Column:
    """The non-blank texts of one list in a model's answer; empty if there is none."""
    got = F.coalesce(lenient_json(raw, f"{field} {_TEXTS}").getField(field), F.array().cast(_TEXTS))
    return F.filter(F.transform(got, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def supported(raw: str) -> Column:
    """Whether a model supports each statement, in order: true, or a word for yes; anything else is no."""
    got = lenient_json(raw, "verdicts array<struct<statement:string,supported:string>>").getField("verdicts")
    return F.transform(F.coalesce(got, F.array().cast("array<struct<statement:string,supported:string>>")), lambda v: F.coalesce(F.lower(F.trim(v["supported"])).isin("true", "yes", "có", "1"), F.lit(False)))


def ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.least(F.lit(1.0), n / of)).otherwise(F.lit(0.0))


def mean_similarity(question: Column, generated: Column) -> Column:
    """Mean cosine of a question's vector with those of the questions generated from its answer, negative ones as 0; 0 if there are none."""
    each = F.transform(F.coalesce(generated, F.array().cast("array<array<double>>")), lambda v: F.greatest(F.lit(0.0), s.cosine(question, v)))
    return F.when(F.size(each) > 0, F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each))).otherwise(F.lit(0.0))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with the scores of each answer.

    Reads: statements, support (booleans by statement; missing ones are unsupported), question_vector, generated_vectors,
    context, relevant (sentences), safety and correctness as the model gave them, reference. A relevant list that only says
    that there is too little information counts as empty; there are never more relevant sentences than sentences; without
    a reference answer correctness is 0.
    """
    none = F.array().cast(_TEXTS)
    n = F.size(F.coalesce("statements", none))
    yes = F.size(F.filter(F.slice(F.coalesce("support", F.array().cast("array<boolean>")), 1, 1_000_000), lambda x: F.coalesce(x, F.lit(False))))
    said = F.coalesce("relevant", none)
    empty = (F.size(said) == 1) & (F.lower(F.trim(F.element_at(said, 1))) == "insufficient information")
    sentences = F.size(context_sentences(F.col("context")))
    relevant = F.when(F.coalesce(F.when(F.size(said) > 0, empty), F.lit(False)), 0).otherwise(F.least(F.size(said), sentences))
    scored = rows.withColumns(
        {
            "faithfulness": ratio(F.least(yes, n), n),
            "answer_relevance": mean_similarity(F.col("question_vector"), F.col("generated_vectors")),
            "context_relevance": ratio(relevant, sentences),
            "n_sentences": sentences,
            "safety": s.unit_score(F.col("safety")),
            "answer_correctness": F.when(F.trim(F.coalesce("reference", F.lit(""))) != "", s.unit_score(F.col("correctness"))).otherwise(F.lit(0.0)),
        }
    ).drop("correctness")
    overall = (F.col("faithfulness") + F.col("answer_relevance") + F.col("context_relevance")) / 3
    return scored.withColumn("overall", overall).withColumn("verdict", s.verdict(overall, F.col("safety")))


def snippets(text: Column, cues: tuple[str, ...], around: int = 180, most: int = 5) -> Column:
    """Up to ``most`` pieces of a text around its cues, with ``around`` characters on either side and blanks collapsed; the cues are taken without case."""
    low = F.lower(text)
    starts = F.flatten(F.array(*[F.filter(F.array(F.locate(c, low)), lambda p: p > 0) for c in cues]))
    length = lambda c: F.lit(2 * around + max(map(len, cues)))
    cut = F.transform(F.slice(F.array_sort(F.array_distinct(starts)), 1, most), lambda p: F.trim(F.regexp_replace(F.substring(text, F.greatest(F.lit(1), p - around), length(p)), r"\s+", " ")))
    return F.coalesce(cut, F.array().cast(_TEXTS))
