"""Scoring of papers by a language model that the caller brings, and what follows from its reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import reports, scores, text
from quorumlake.operators.writes import upsert
from quorumlake.streaming.sse import rate_limited, retrying_map

_RIGOR = "Judge the rigor of this submission. Answer with one JSON object of " + ", ".join(reports.AXES) + " (0 to 10), critique, strengths and weaknesses (lists)."
_SURVEY = "Answer with one JSON object of verdict (endorse, mixed or reject), confidence (0 to 1) and rationale."


#: The headings of a paper's text and what stands for missing tags.
HEADINGS = ("Title: ", "\nFields: ", "\n\nAbstract:\n", "\n\nBody:\n", "\n\nReferences:\n")
UNSPECIFIED = "(unspecified)"


def paper_text() -> Column:
    """A paper as the model reads it, part by part under headings; a null part is empty."""
    tags = F.concat_ws(", ", "fields")
    references = F.coalesce(text.reference_lines(F.col("references")), F.lit("(none provided)"))
    parts = [F.col("title"), F.when(tags != "", tags).otherwise(UNSPECIFIED), F.col("abstract"), F.col("body"), references]
    return F.concat(*[x for h, p in zip(HEADINGS, parts, strict=True) for x in (F.lit(h), F.coalesce(p, F.lit("")))])


def questions(papers: DataFrame) -> DataFrame:
    """(index: id and number, payload): six questions a paper, the first for the report and one for each persona."""
    paper = paper_text()
    asks = [_RIGOR, *(f"You are {name}: {brief}. {_SURVEY}" for name, brief in reports.PERSONAS.items())]
    asked = F.posexplode(F.array(*map(F.lit, asks))).alias("k", "ask")
    return papers.select("id", paper.alias("paper"), asked).select(F.struct("id", "k").alias("index"), F.concat("ask", F.lit("\n\n"), "paper").alias("payload"))


def _waiting(base: Column, references: Column) -> tuple[Column, Column]:
    """(report, survey) where the model could not be reached."""
    cited = scores.clamp(base + F.when(references >= 3, 1.0).otherwise(-1.0), 0.0, 10.0)
    axes = [(cited if a == "citationsScore" else base).alias(a) for a in reports.AXES]
    # What stands where nothing could be said
    told = [F.lit("AI service unavailable — heuristic placeholder. Re-run analysis when service recovers.").alias("critique"), F.array(F.lit("Submission accepted into the queue")).alias("strengths"), F.array(F.lit("AI critique pending")).alias("weaknesses")]
    passes = F.array(*[F.struct(F.lit(p).alias("persona"), F.lit("mixed").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("Pending.").alias("rationale")) for p in reports.PERSONAS])
    return F.struct(scores.round2(base).alias("overallScore"), *axes, *told), F.struct(F.lit(0.5).alias("confidence"), F.lit(reports.CONSENSUS["waiting"]).alias("consensus"), passes.alias("passes"))


def make_reports(papers: DataFrame, call: Callable[[str], str], at: Column, retryable: Callable[[str], bool] = rate_limited, **waits) -> DataFrame:
    """Rows to append to the reports: (paper_id, revision_number, rigor, survey, rigor_score, survey_confidence, created_at).

    One failed answer, or JSON's null for one, makes a paper's whole report the placeholder. Write the result before you use it
    twice: each reading asks the model again.
    """
    answers = retrying_map(questions(papers), call, retryable, **waits)
    whole = answers.groupBy(F.col("index.id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("index.k", "result"))), lambda a: a["result"]).alias("a"), F.count("error").alias("failed"))
    passes = F.array(*[reports.survey_pass(F.col("a")[k + 1], F.lit(p)) for k, p in enumerate(reports.PERSONAS)])
    made = reports.survey(passes)
    consensus = F.when(made["consensus"] == "endorse", reports.CONSENSUS["endorse"]).when(made["consensus"] == "reject", reports.CONSENSUS["reject"]).otherwise(reports.CONSENSUS["split"])
    references = F.size(F.coalesce(F.col("references"), F.array().cast("array<struct<citation:string,url:string>>")))
    rigor, survey = _waiting(scores.fallback_score(F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("abstract", F.lit(""))), references), references)
    bad = (F.col("failed") > 0) | F.exists("a", reports.is_null)
    both = papers.select("id", "abstract", "body", "references", "revision_count").join(whole, "id")
    out = both.select(F.col("id").alias("paper_id"), F.col("revision_count").alias("revision_number"), F.when(bad, rigor).otherwise(reports.rigor_report(F.col("a")[0])).alias("rigor"), F.when(bad, survey).otherwise(F.struct(made["confidence"].alias("confidence"), consensus.alias("consensus"), passes.alias("passes"))).alias("survey"))
    return out.select("*", F.col("rigor.overallScore").alias("rigor_score"), F.col("survey.confidence").alias("survey_confidence"), at.alias("created_at"))


def apply_reports(papers: DataFrame, new: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new: one report a paper; votes: (paper_id, endorse, challenge, reject). (papers with new scores and stages, (id, old_stage, new_stage) of those whose stage has changed)."""
    told = new.select(F.col("paper_id").alias("id"), F.col("rigor_score").alias("__rigor"), F.col("survey_confidence").alias("__conf"))
    counted = votes.select(F.col("paper_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in ("endorse", "challenge", "reject")])
    both = papers.join(told, "id").join(counted, "id", "left")
    e, c, r = (F.coalesce(F.col(f"__{v}"), F.lit(0)) for v in ("endorse", "challenge", "reject"))
    combined = scores.combined_score(F.col("__rigor"), F.col("__conf"), scores.community_score(e, c, r), e + c + r)
    both = both.withColumn("__stage", scores.stage(combined, F.col("__rigor"), e, c, r))
    changed = {"rigor_score": "__rigor", "ai_confidence": "__conf", "stage": "__stage"}
    now = upsert(papers, both.select(*[F.col(changed.get(x, x)).alias(x) for x in papers.columns]), ["id"])
    return now, both.where("stage <> __stage").select("id", F.col("stage").alias("old_stage"), F.col("__stage").alias("new_stage"))
