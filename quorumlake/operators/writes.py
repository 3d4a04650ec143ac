"""Writes as DataFrame transforms: what comes in and the table as it was give the table as it will be, or the changes to it.

Tables are snapshots: a caller writes what is returned in place of what was read. What is
refused comes back as rows with a status, as in an answer to a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a refused request is answered.
BLANK, FORBIDDEN, NOT_FOUND = "400", "403", "404"


def latest_wins(events: DataFrame, keys: list[str], at: str, tie: str, keep: str, values: tuple[str, ...]) -> DataFrame:
    """A row per key: id and created_at of its first event, last_id, updated_at and the kept column of its last (ties: by the tie column, a number not below zero).

    Time, tie and the kept value (one of up to ten) go into one number each way, so the aggregation's
    buffers have a fixed width and it is done by hashing.
    """
    if len(values) > 10:
        raise ValueError("more than ten values")
    code = F.coalesce(*[F.when(F.col(keep) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(9))
    wide = "decimal(38,0)"
    base = F.lit(str(10**20)).cast("decimal(21,0)")
    micros = ((F.col(at) - F.expr("timestamp_ntz'0001-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("decimal(18,0)")
    packed = ((micros * base).cast(wide) + (F.col(tie).cast("decimal(19,0)") * 10 + code).cast(wide)).cast(wide)
    best = events.groupBy(*keys).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.min(packed).alias("lo"), F.max(packed).alias("hi"))
    low, high = F.col("lo") % base, F.col("hi") % base
    kept = F.get(F.array(*map(F.lit, values)), (high % 10).cast("int"))
    return best.select(*keys, F.floor(low / 10).cast("long").alias("id"), F.floor(high / 10).cast("long").alias("last_id"), "created_at", "updated_at", kept.alias(keep))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of these keys replaced by those of changes, which has one row for each key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete_all(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.where(F.lit(False))


def delete_cascade(children: DataFrame, deleted: DataFrame, child_key: str, key: str) -> DataFrame:
    return children.join(deleted.select(F.col(key).alias(child_key)), child_key, "left_anti")


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may be written, rows that are refused): unknown counts as refused."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def split_known(rows: DataFrame, table: DataFrame, key: str, table_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the table, the others with status 404)."""
    ids = table.select(F.col(table_key).alias(key))
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti").withColumn("status", F.lit(NOT_FOUND))


def ensure_profiles(profiles: DataFrame, ids: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """(id, display_name, avatar_url, bio) of ids that have no profile yet, to be appended.

    identities: (id, first, last, username, email, image_url) of those that an identity provider knows;
    others get a fallback name.
    """
    from quorumlake.functions.text import display_name, fallback_name

    new = ids.select("id").where("id is not null").distinct().join(profiles.select("id"), "id", "left_anti")
    none = F.lit(None).cast("string")
    if identities is None:
        return new.select("id", fallback_name(F.col("id")).alias("display_name"), none.alias("avatar_url"), none.alias("bio"))
    name = display_name(F.col("first"), F.col("last"), F.col("username"), F.col("email"), F.col("id"))
    return new.join(identities, "id", "left").select("id", name.alias("display_name"), F.col("image_url").alias("avatar_url"), none.alias("bio"))


_PARTS = ("title", "abstract", "body", "fields", "references")


def revise(papers: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edits: (edit_id, id, author_id, title, abstract, body, fields, references, summary, at), every part of the paper anew.

    Returns (revision rows, papers as revised, edits refused with a status: 404 for no such paper, 403 for
    another's). Several edits of a paper are applied in the order of at, then edit_id: each makes a revision
    with the title and abstract before it, and the last one's parts stay.
    """
    new = edits.select("edit_id", "id", F.col("author_id").alias("__by"), "summary", "at", *[F.col(c).alias(f"__{c}") for c in _PARTS])
    known = papers.select("id", "author_id", "title", "abstract", "revision_count")
    both = new.join(known, "id", "left")
    status = F.when(F.col("author_id").isNull(), NOT_FOUND).when(~F.col("author_id").eqNullSafe(F.col("__by")), FORBIDDEN)
    judged = both.withColumn("status", status)
    refused = judged.where("status is not null").select("edit_id", "id", F.col("__by").alias("author_id"), "status")
    order = Window.partitionBy("id").orderBy("at", "edit_id")
    numbered = judged.where("status is null").withColumns({
        "number": F.col("revision_count") + F.row_number().over(order),
        "before_title": F.coalesce(F.lag("__title").over(order), F.col("title")),
        "before_abstract": F.coalesce(F.lag("__abstract").over(order), F.col("abstract")),
        "last": F.lead("edit_id").over(order).isNull(),
    })
    revisions = numbered.select(F.col("id").alias("paper_id"), F.col("number").cast("int").alias("revision_number"), F.col("before_title").alias("title"), F.col("before_abstract").alias("abstract"), "summary", F.col("at").alias("created_at"))
    last = numbered.where("last").select("id", F.col("number").cast("int").alias("__number"), F.col("at").alias("__at"), *[f"__{c}" for c in _PARTS])
    own = {**{c: f"__{c}" for c in _PARTS}, "revision_count": "__number", "updated_at": "__at"}
    changed = papers.join(last, "id").select(*[F.col(own.get(c, c)).alias(c) for c in papers.columns])
    return revisions, upsert(papers, changed, ["id"]), refused


def create(drafts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """drafts: (id, author_id, title, abstract, body, fields, references). (papers to append, drafts refused for a blank part or no tag).

    Ids come from the caller: to count on from the largest one would put all rows in one task.
    """
    from quorumlake.functions.text import clean_references, clean_tags

    rows = drafts.withColumn("fields", clean_tags(F.col("fields"))).withColumn("references", clean_references(F.col("references")))
    full = [F.trim(F.col(c)) != "" for c in ("title", "abstract", "body")]
    ok, refused = split_valid(rows, full[0] & full[1] & full[2] & (F.size("fields") > 0))
    unscored = [F.lit("draft").alias("stage"), F.lit(None).cast("double").alias("rigor_score"), F.lit(None).cast("double").alias("ai_confidence"), F.lit(0).alias("revision_count"), at.alias("created_at"), at.alias("updated_at")]
    return ok.select("id", "author_id", *[F.trim(F.col(c)).alias(c) for c in ("title", "abstract", "body")], "fields", "references", *unscored), refused


def comment(papers: DataFrame, posts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """posts: (id, paper_id, author_id, parent_id, body). (comments to append, posts refused: 404 without the paper, 400 for a missing body). A parent may be any comment."""
    there, missing = split_known(posts, papers, "paper_id")
    ok, blank = split_valid(there, F.col("body").isNotNull())
    refused = missing.unionByName(blank.withColumn("status", F.lit(BLANK)))
    return ok.select("id", "paper_id", "author_id", "parent_id", "body", at.alias("created_at")), refused


def cast_votes(papers: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """posts: (paper_id, author_id, ...). (votes that count, votes refused: 404 without the paper, 400 for the voter's own)."""
    there, missing = split_known(posts, papers, "paper_id")
    owned = there.join(papers.select(F.col("id").alias("paper_id"), F.col("author_id").alias("__owner")), "paper_id")
    ok, own = split_valid(owned, F.col("__owner") != F.col("author_id"))
    return ok.drop("__owner"), missing.unionByName(own.drop("__owner").withColumn("status", F.lit(BLANK)))


def recompute_stages(papers: DataFrame, counts: DataFrame, rigor: str = "rigor_score", conf: str = "ai_confidence") -> tuple[DataFrame, DataFrame]:
    """counts: (id, endorse, challenge, reject) after new votes. (papers with their stages as they are now, (id, old_stage, new_stage) of those that changed)."""
    from quorumlake.sources.domain import STANCES, scored

    both = papers.withColumnRenamed("stage", "__old").join(counts.select("id", *STANCES), "id", "left").withColumns({s: F.coalesce(s, F.lit(0)) for s in STANCES})
    now = scored(both, rigor, conf)
    return now.select(*papers.columns), now.where(~F.col("stage").eqNullSafe(F.col("__old"))).select("id", F.col("__old").alias("old_stage"), F.col("stage").alias("new_stage"))


def load(documents: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Nested documents as tables: papers, reports, reviews, comments, with stages computed.

    documents: (id, author_id, title, abstract, body, fields, references, rigor struct with overallScore, survey
    struct with confidence, reviews array<struct<author_id, stance, justification>>, comments
    array<struct<author_id, body, replies array<struct<author_id, body>>>>). Of a reviewer's reviews of one paper the first
    counts. Ids are made from the paper's id and the place in it.
    """
    wide = F.lit(1_000_000).cast("long")
    reviews = documents.select(F.col("id").alias("paper_id"), F.posexplode("reviews").alias("pos", "r")).select((F.col("paper_id") * wide + F.col("pos")).alias("id"), "paper_id", "r.author_id", "r.stance", "r.justification", "pos")
    reviews = latest_per_key(reviews, ["paper_id", "author_id"], [F.col("pos")]).drop("pos").select("*", at.alias("created_at"), at.alias("updated_at"))
    top = documents.select(F.col("id").alias("paper_id"), F.posexplode("comments").alias("pos", "c")).withColumn("id", F.col("paper_id") * wide + F.col("pos") * 1000)
    first = top.select("id", "paper_id", F.col("c.author_id").alias("author_id"), F.lit(None).cast("long").alias("parent_id"), F.col("c.body").alias("body"))
    replies = top.select(F.col("id").alias("parent_id"), "paper_id", F.posexplode("c.replies").alias("n", "r")).select((F.col("parent_id") + F.col("n") + 1).alias("id"), "paper_id", F.col("r.author_id").alias("author_id"), "parent_id", F.col("r.body").alias("body"))
    papers = documents.select("id", "author_id", "title", "abstract", "body", "fields", "references", F.lit("draft").alias("stage"), F.col("rigor.overallScore").alias("rigor_score"), F.col("survey.confidence").alias("ai_confidence"), F.lit(0).alias("revision_count"), at.alias("created_at"), at.alias("updated_at"))
    counts = reviews.groupBy(F.col("paper_id").alias("id")).agg(*[F.count_if(F.col("stance") == s).alias(s) for s in ("endorse", "challenge", "reject")])
    reports = documents.select(F.col("id").alias("paper_id"), F.lit(0).alias("revision_number"), "rigor", "survey", F.col("rigor.overallScore").alias("rigor_score"), F.col("survey.confidence").alias("survey_confidence"), F.lit("seed-data").alias("model"), at.alias("created_at"))
    return {"papers": recompute_stages(papers, counts)[0], "reports": reports, "reviews": reviews, "comments": first.unionByName(replies).withColumn("created_at", at)}


def reseed(tables: dict[str, DataFrame], documents: DataFrame, profiles: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The tables emptied, those that refer to others first, and loaded anew from documents and profiles."""
    loaded = {"profiles": profiles, **load(documents, at)}
    order = ("comments", "reviews", "reports", "papers", "profiles")
    emptied = {name: delete_all(tables[name]) for name in order}
    return {name: emptied[name].unionByName(loaded[name], allowMissingColumns=True) for name in order}
