"""Answers of a language model, as text, made into rigor reports and surveys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp, round2

#: Axes of a rigor report, personas of a survey, weights of their verdicts.
AXES = ("logicScore", "methodologyScore", "citationsScore", "falsifiabilityScore", "noveltyScore")
VERDICTS = {"endorse": 1.0, "mixed": 0.5, "reject": 0.0}
MOST_ITEMS = 6
PERSONAS = {
    "The Skeptic": "rigorously interrogates assumptions and demands evidence",
    "Domain Expert": "deeply versed in the relevant field's prior literature and methods",
    "The Generalist": "intelligent reader from outside the field assessing clarity and stakes",
    "The Methodologist": "evaluates research design, statistics, and reproducibility",
    "The Outsider": "creative thinker probing for unstated assumptions and overlooked angles",
}
CONSENSUS = {
    "endorse": "Personas largely endorse the submission, with some reservations.",
    "reject": "Personas largely push back; the submission needs substantial revision.",
    "split": "Personas are split — the submission has a real case to make and real holes to fill.",
    "waiting": "Awaiting full AI survey.",
}


def bare_json(text: Column) -> Column:
    """The text without blanks and code fences around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def is_null(text: Column) -> Column:
    """Whether the answer is missing or JSON's null, from which nothing can be made."""
    return text.isNull() | (bare_json(text) == "null")


def _object(text: Column) -> Column:
    bare = bare_json(text)
    return F.when(bare.startswith("{"), bare).otherwise("{}")


def _typed(raw: Column, name: str, kind: str, as_: str) -> Column:
    """A part that is of this kind; null for any other."""
    value = F.try_variant_get(raw, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value).rlike(kind), F.try_variant_get(raw, f"$.{name}", as_))


_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def rigor_report(text: Column) -> Column:
    """struct of overallScore, the axes (0 to 10), critique and up to six strengths and weaknesses. What is no number counts 0, a critique that is no string is empty, text that is no JSON object counts as an empty one; null for JSON's null."""

    def items(raw: Column, name: str) -> Column:
        return F.slice(F.coalesce(_typed(raw, name, "^ARRAY", "array<string>"), F.array().cast("array<string>")), 1, MOST_ITEMS)

    def axis(raw: Column, name: str) -> Column:
        return _once(_typed(raw, name, _NUMBER, "double"), lambda x: clamp(x, 0.0, 10.0))

    def parts(raw: Column) -> Column:
        critique = F.coalesce(_typed(raw, "critique", "^STRING$", "string"), F.lit(""))
        return F.struct(*(axis(raw, a).alias(a) for a in AXES), critique.alias("critique"), items(raw, "strengths").alias("strengths"), items(raw, "weaknesses").alias("weaknesses"))

    def with_overall(made: Column) -> Column:
        axes = [made[a] for a in AXES]
        overall = round2((axes[0] + axes[1] + axes[2] + axes[3] + axes[4]) / 5.0)
        return F.struct(overall.alias("overallScore"), *(made[name].alias(name) for name in (*AXES, "critique", "strengths", "weaknesses")))

    def report(bare: Column) -> Column:
        raw = F.coalesce(F.try_parse_json(F.when(bare.startswith("{"), bare).otherwise("{}")), F.parse_json(F.lit("{}")))
        return F.when(bare != "null", _once(_once(raw, parts), with_overall))

    return _once(bare_json(text), report)


def survey_pass(text: Column, persona: Column) -> Column:
    """struct of persona, verdict, confidence (0 to 1), rationale (empty if it is no string)."""
    raw = F.coalesce(F.try_parse_json(_object(text)), F.parse_json(F.lit("{}")))
    told = _typed(raw, "verdict", "^STRING$", "string")
    verdict = F.when(told.isin(*VERDICTS), told).otherwise("mixed")
    return F.struct(persona.alias("persona"), verdict.alias("verdict"), clamp(_typed(raw, "confidence", _NUMBER, "double"), 0.0, 1.0).alias("confidence"), F.coalesce(_typed(raw, "rationale", "^STRING$", "string"), F.lit("")).alias("rationale"))


def survey(passes: Column) -> Column:
    """struct of confidence (mean of the verdicts' weights by confidence, two decimals), endorsing, rejecting, consensus."""
    weight = F.aggregate(passes, F.lit(0.0), lambda s, p: s + p["confidence"])
    votes = F.aggregate(passes, F.lit(0.0), lambda s, p: s + p["confidence"] * F.when(p["verdict"] == "endorse", 1.0).when(p["verdict"] == "mixed", 0.5).otherwise(0.0))
    e, r = (F.size(F.filter(passes, _is(v))) for v in ("endorse", "reject"))
    consensus = F.when(e > r + 1, "endorse").when(r > e + 1, "reject").otherwise("split")
    return F.struct(round2(votes / F.when(weight == 0, 1.0).otherwise(weight)).alias("confidence"), e.alias("endorsing"), r.alias("rejecting"), consensus.alias("consensus"))


def _is(verdict: str):
    return lambda p: p["verdict"] == verdict
