"""The queries that read, each with its SQL for comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import reports, scores, text
from quorumlake.operators import writes
from quorumlake.plans.registry import query
from quorumlake.sources.domain import AS_OF, STANCES, Domain

DEFAULT_LIMIT, MOST, FEED, USER_REVIEWS = 50, 200, 12, 50

AUTHOR = ["author_id", "author_name", "author_avatar", "author_bio", "author_since"]
SUMMARY = ["id", "title", "abstract", "field_list", "stage", *AUTHOR, "rigor", "conf", *STANCES, "comments", "created_at", "updated_at"]
AUTHOR_SQL = f"coalesce(display_name, 'Researcher ' || right(s.author_id, 6)) author_name, avatar_url author_avatar, bio author_bio, coalesce(a.created_at, timestamp '{AS_OF}') author_since"
SUMMARY_SQL = f"s.id, title, abstract, array_to_string(fields, ',') field_list, stage, s.author_id, {AUTHOR_SQL}, rigor, conf, endorse, challenge, reject, comments, s.created_at, updated_at"


def limit_of(asked: int | None) -> int:
    if asked is not None and asked < 0:
        raise ValueError("a limit can't be negative")
    return min(DEFAULT_LIMIT if asked is None else asked, MOST)


def with_author(d: Domain, rows: DataFrame) -> DataFrame:
    """rows with the public profile of author_id as author_*: a user without a profile gets one as it is made on first sight."""
    a = d.profiles().select(F.col("id").alias("author_id"), "display_name", F.col("avatar_url").alias("author_avatar"), F.col("bio").alias("author_bio"), F.col("created_at").alias("__since"))
    named = rows.join(a, "author_id", "left")  # by size: Spark broadcasts the profiles only where they are small
    return named.withColumn("author_name", F.coalesce("display_name", text.fallback_name(F.col("author_id")))).withColumn("author_since", F.coalesce("__since", F.expr(f"timestamp_ntz'{AS_OF}'"))).drop("display_name", "__since")


def author_struct() -> Column:
    return F.struct(F.col("author_id").alias("id"), F.col("author_name").alias("displayName"), F.col("author_avatar").alias("avatarUrl"), F.col("author_bio").alias("bio"), F.col("author_since").alias("createdAt")).alias("author")


def nested_summary(rows: DataFrame) -> DataFrame:
    """Rows of with_author(summaries) as they are answered, the author nested."""
    return rows.select(
        "id", "title", "abstract", "fields", "stage", author_struct(), F.col("rigor").alias("rigorScore"), F.col("conf").alias("aiConfidence"), *[F.col(s).alias(f"{s}Count") for s in STANCES], F.col("comments").alias("commentCount"), F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt")
    )


def flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("field_list", F.array_join("fields", ","))


def page(d: Domain, papers: DataFrame, order: list[Column], n: int, counted: DataFrame | None = None) -> DataFrame:
    """The first n (MOST at most) summaries in this order, which id ends, with position. Only these are counted and named, unless they have been counted already."""
    n = min(n, MOST)
    first = (papers if counted is None else counted).orderBy(*order, "id").limit(n)
    rows = with_author(d, d.summaries(first, few=True) if counted is None else first)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order, "id"))).orderBy("position")  # n rows


ORDERS = {"trending": [F.desc, "updated_at"], "top": [F.desc_nulls_first, "rigor", F.desc, "created_at"], "recent": [F.desc, "created_at"]}


def order_of(sort: str) -> list[Column]:
    o = ORDERS[sort]
    return [f(c) for f, c in zip(o[::2], o[1::2], strict=True)]


def list_papers(d: Domain, stage: str = "all", field: str | None = None, author: str | None = None, q: str = "", sort: str = "recent", limit: int | None = None) -> DataFrame:
    """Summaries by stage ("all": any), tag, author and a pattern in title or abstract, sorted and limited, with position.

    Only a stage needs the votes of all papers; else the papers are chosen before anything is counted.
    """
    tests: list[Column] = []
    if field:
        tests.append(F.array_contains("fields", field))
    if author:
        tests.append(F.col("author_id") == author)
    if q:
        tests.append(text.contains_any_case(F.col("title"), q) | text.contains_any_case(F.col("abstract"), q))
    rows = d.papers()
    rows = rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows
    counted = d.summaries(rows).where(F.col("stage") == stage) if stage != "all" else None
    return page(d, rows, order_of(sort), limit_of(limit), counted)


def trending(d: Domain, n: int) -> DataFrame:
    """Of papers touched in the last 14 days the first n by rigor."""
    now = F.expr(f"timestamp_ntz'{AS_OF}' - interval 14 days")
    return page(d, d.papers().where(F.col("updated_at") > now), [F.desc_nulls_first("rigor"), F.desc("updated_at")], n)


def _listed(where: str, order: str, n: int) -> str:
    return f"select {SUMMARY_SQL}, position from (select *, row_number() over (order by {order}, id) as position from summaries where {where} qualify position <= {n}) s left join profiles a on a.id = s.author_id order by position"


def _page(rows: DataFrame) -> DataFrame:
    return flat(rows).select(*SUMMARY, "position").orderBy("position")


@query("select id, endorse e, challenge c, reject r, comments m, floor(community * 100 + 0.5) / 100e0 community_score, floor(combined * 100 + 0.5) / 100e0 combined_score, stage from summaries")
def vote_breakdown(d):
    return d.summaries().select("id", F.col("endorse").alias("e"), F.col("challenge").alias("c"), F.col("reject").alias("r"), F.col("comments").alias("m"), scores.round2(F.col("community")).alias("community_score"), scores.round2(F.col("combined")).alias("combined_score"), "stage")


@query(f"select {SUMMARY_SQL} from summaries s left join profiles a on a.id = s.author_id")
def paper_summary(d):
    return flat(with_author(d, d.summaries())).select(*SUMMARY)


@query(_listed("true", "created_at desc", 50))
def list_recent(d):
    return _page(list_papers(d))


@query(_listed("true", "rigor desc nulls first, created_at desc", 200))
def list_top(d):
    return _page(list_papers(d, sort="top", limit=1000))


@query(_listed("true", "updated_at desc", 50))
def list_trending(d):
    return _page(list_papers(d, sort="trending"))


@query(_listed("title ilike '%th_n%' or abstract ilike '%th_n%'", "created_at desc", 50))
def list_search(d):
    return _page(list_papers(d, q="Th_N"))


@query(_listed("stage = 'under_review' and list_contains(fields, 'en') and (title ilike '%the%' or abstract ilike '%the%')", "updated_at desc", 20))
def list_filtered(d):
    return _page(list_papers(d, stage="under_review", field="en", q="the", sort="trending", limit=20))


@query(_listed("updated_at > timestamp '2024-01-20' - interval 14 days", "rigor desc nulls first, updated_at desc", 12))
def feed_trending(d):
    return _page(trending(d, FEED))


@query(_listed("stage = 'promoted'", "updated_at desc", 12))
def feed_promoted(d):
    return _page(list_papers(d, stage="promoted", sort="trending", limit=FEED))


@query(_listed("stage = 'published'", "updated_at desc", 12))
def feed_published(d):
    return _page(list_papers(d, stage="published", sort="trending", limit=FEED))


@query(_listed("true", "created_at desc", 10))
def feed_recent(d):
    return _page(list_papers(d, limit=10))


@query(_listed("updated_at > timestamp '2024-01-20' - interval 14 days", "rigor desc nulls first, updated_at desc", 3))
def home_hero(d):
    return _page(trending(d, 3))


@query("""select count(*) total_papers, count(*) filter (stage = 'under_review') under_review, count(*) filter (stage = 'promoted') promoted, count(*) filter (stage = 'published') published,
 count(distinct author_id) contributors, (select count(*) from reviews) total_reviews from summaries""")
def feed_stats(d):
    stages = ("under_review", "promoted", "published")
    # a row per author first, so contributors are counted without a second pass over the papers
    each = d.summaries(comments=False).groupBy("author_key").agg(F.count("*").alias("n"), F.sum(F.col("endorse") + F.col("challenge") + F.col("reject")).alias("votes"), *[F.count_if(F.col("stage") == s).alias(s) for s in stages])
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_papers"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in stages], F.count("*").alias("contributors"), F.coalesce(F.sum("votes"), F.lit(0)).alias("total_reviews"))


@query("""select f slug, array_to_string(list_transform(regexp_split_to_array(f, '[-_\\s]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as name, count(*) papers,
 row_number() over (order by count(*) desc, f) as position from (select unnest(fields) f from papers) group by f order by position""")
def field_tags(d):
    counted = d.papers().select(F.explode("fields").alias("slug")).groupBy("slug").agg(F.count("*").alias("papers"))
    listed = counted.orderBy(F.desc("papers"), "slug").select("slug", text.slug_name(F.col("slug")).alias("name"), "papers")
    return listed.withColumn("position", F.row_number().over(Window.orderBy(F.desc("papers"), "slug"))).orderBy("position")  # a row for each tag


@query("""select i.id, coalesce(nullif(trim(concat_ws(' ', first, last)), ''), username, split_part(email, '@', 1), 'Researcher ' || right(i.id, 6)) display_name, image_url avatar_url
 from (select distinct author_id id from papers) i left join identities t on t.id = i.id where i.id not in (select id from profiles)""")
def new_profiles(d):
    return writes.ensure_profiles(d.profiles(), d.papers().select(F.col("author_id").alias("id")), d.identities()).select("id", "display_name", "avatar_url")


@query(f"select i.id, coalesce(display_name, 'Researcher ' || right(i.id, 6)) display_name, avatar_url, bio, coalesce(a.created_at, timestamp '{AS_OF}') created_at from (select distinct author_id id from comments) i left join profiles a on a.id = i.id")
def public_profiles(d):
    return with_author(d, d.comments().select("author_id").distinct()).select(F.col("author_id").alias("id"), F.col("author_name").alias("display_name"), F.col("author_avatar").alias("avatar_url"), F.col("author_bio").alias("bio"), F.col("author_since").alias("created_at"))


@query("select paper_id, id, score, created_at from (select *, row_number() over (partition by paper_id order by created_at desc, id desc) rn from reports) where rn = 1")
def latest_report(d):
    return writes.latest_per_key(d.reports(), ["paper_id"], [F.desc("created_at"), F.desc("id")]).select("paper_id", "id", "score", "created_at")


def details(d: Domain, papers: DataFrame, few: bool = False) -> DataFrame:
    """Papers with all that their page shows: author, latest report as rigor report and survey (null without one), breakdown of votes, number of comments, thresholds."""
    best = writes.latest_per_key(d.reports(), ["paper_id"], [F.desc("created_at"), F.desc("id")])
    axes = [F.col("score").alias(a) for a in reports.AXES]
    rigor = F.struct(F.col("score").alias("overallScore"), *axes, "critique", F.col("created_at").alias("createdAt"))
    survey = F.struct("confidence", F.lit(reports.CONSENSUS["split"]).alias("consensus"), F.col("created_at").alias("createdAt"))
    told = best.select(F.col("paper_id").alias("id"), rigor.alias("rigorReport"), survey.alias("aiSurvey"))
    rows = with_author(d, d.summaries(papers, few)).join(told, "id", "left")
    breakdown = F.struct(*STANCES, scores.round2(F.col("community")).alias("communityScore"), scores.round2(F.col("combined")).alias("combinedScore"))
    thresholds = F.struct(F.lit(scores.UNDER_REVIEW).alias("underReview"), F.lit(scores.PROMOTED).alias("promoted"), F.lit(scores.PUBLISHED).alias("published"))
    paper = F.struct("id", "author_id", "title", "abstract", "body", "fields", "references", "stage", F.col("rigor").alias("rigorScore"), F.col("conf").alias("aiConfidence"), "revision_count", "created_at", "updated_at")
    return rows.select("id", paper.alias("paper"), author_struct(), "rigorReport", "aiSurvey", breakdown.alias("voteBreakdown"), F.col("comments").alias("commentCount"), thresholds.alias("promotionThresholds"))


DETAIL_SQL = f"""select s.id, title, md5(body) body_md5, array_to_string(fields, ',') field_list, len(refs) n_references, stage, rigor, conf, revision_count, s.created_at, updated_at, s.author_id, {AUTHOR_SQL},
 r.score overall, r.score novelty, r.critique, r.created_at reported_at, r.confidence, endorse, challenge, reject, floor(community * 100 + 0.5) / 100e0 community_score, floor(combined * 100 + 0.5) / 100e0 combined_score,
 comments, 6.5e0 under_review, 7.5e0 promoted, 8e0 published from summaries s left join profiles a on a.id = s.author_id
 left join (select *, row_number() over (partition by paper_id order by created_at desc, id desc) rn from reports) r on r.paper_id = s.id and rn = 1 where """


def _flat_details(rows: DataFrame) -> DataFrame:
    cells = {
        "id": "id", "title": "paper.title", "stage": "paper.stage", "rigor": "paper.rigorScore", "conf": "paper.aiConfidence", "revision_count": "paper.revision_count", "created_at": "paper.created_at", "updated_at": "paper.updated_at",
        "author_id": "author.id", "author_name": "author.displayName", "author_avatar": "author.avatarUrl", "author_bio": "author.bio", "author_since": "author.createdAt",
        "overall": "rigorReport.overallScore", "novelty": "rigorReport.noveltyScore", "critique": "rigorReport.critique", "reported_at": "aiSurvey.createdAt", "confidence": "aiSurvey.confidence",
        **{s: f"voteBreakdown.{s}" for s in STANCES}, "community_score": "voteBreakdown.communityScore", "combined_score": "voteBreakdown.combinedScore", "comments": "commentCount",
        "under_review": "promotionThresholds.underReview", "promoted": "promotionThresholds.promoted", "published": "promotionThresholds.published",
    }
    return rows.select(*[F.col(c).alias(k) for k, c in cells.items()], F.md5("paper.body").alias("body_md5"), F.array_join("paper.fields", ",").alias("field_list"), F.size("paper.references").alias("n_references"))


@query(DETAIL_SQL + "true")
def paper_detail(d):
    return _flat_details(details(d, d.papers()))


@query(DETAIL_SQL + "s.id = 42")
def paper_by_id(d):
    return _flat_details(details(d, d.papers().where("id = 42").limit(1), few=True))


@query("select id, title, len(refs) n_references from papers where id in (3, 5, 8, 13, 1000000)")
def papers_of_ids(d):
    return of_ids(d.papers(), [3, 5, 8, 13, 1_000_000]).select("id", "title", F.size("references").alias("n_references"))


def of_ids(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The rows with these ids; without ids nothing is read."""
    return rows.where(F.col("id").isin(ids)) if ids else rows.limit(0)


@query("select id, paper_id, user_id, last_id, created_at, updated_at, stance from reviews")
def reviews_upsert(d):
    return d.reviews()


@query(f"select s.id, s.paper_id, s.author_id, {AUTHOR_SQL}, stance, 'Vote ' || last_id justification, s.created_at, row_number() over (partition by paper_id order by s.created_at desc, s.id) as position from reviews s left join profiles a on a.id = s.author_id")
def reviews_by_paper(d):
    return reviews_of(d, d.reviews())


def reviews_of(d: Domain, reviews: DataFrame) -> DataFrame:
    """Reviews as they are listed, the newest of a paper first."""
    r = with_author(d, reviews.withColumn("author_id", d.user(F.col("user_id"))))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("created_at"), "id"))
    return r.select("id", "paper_id", *AUTHOR, "stance", F.concat(F.lit("Vote "), F.col("last_id").cast("string")).alias("justification"), "created_at", place.alias("position")).orderBy("paper_id", "position")


@query("select event_id, paper_id, user_id from cast_votes where own")
def self_vote_rejects(d):
    return d.votes(own=True).select("event_id", "paper_id", "user_id")


@query(f"""select s.id, s.paper_id, s.parent_id, p.body parent_body, s.author_id, {AUTHOR_SQL}, s.body, s.created_at, row_number() over (partition by s.paper_id order by s.created_at, s.id) as position
 from comments s left join comments p on p.id = s.parent_id left join profiles a on a.id = s.author_id""")
def comments_thread(d):
    return comments_of(d, d.comments())


def comments_of(d: Domain, comments: DataFrame) -> DataFrame:
    """Comments as they are listed, the oldest of a paper first, with their parents' texts."""
    p = comments.select(F.col("id").alias("parent_id"), F.col("body").alias("parent_body"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("created_at", "id"))
    rows = with_author(d, comments.join(p, "parent_id", "left"))
    return rows.select("id", "paper_id", "parent_id", "parent_body", *AUTHOR, "body", "created_at", place.alias("position")).orderBy("paper_id", "position")


@query("select conv_id * 1000 + turn id, turn depth, conv_id * 1000 root from conversations")
def comment_depths(d):
    return depths(d.comments())


def depths(comments: DataFrame) -> DataFrame:
    """(id, depth, root) of comments in threads without rings: each round doubles the distance that is known, so a thread of depth n takes log n joins. An unknown parent makes a root."""
    known = comments.select("id", "parent_id").join(comments.select(F.col("id").alias("parent_id"), F.lit(True).alias("there")), "parent_id", "left")
    up = known.select("id", F.when(F.col("there"), F.col("parent_id")).alias("above"))
    now = up.select("id", F.coalesce("above", "id").alias("at"), F.when(F.col("above").isNotNull(), 1).otherwise(0).cast("long").alias("depth"))
    for _ in range(64):
        further = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        stepped = now.join(further, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")).persist()
        moved = not stepped.where("moved").isEmpty()
        now = stepped.drop("moved")
        if not moved:
            break
    return now.select("id", "depth", F.col("at").alias("root"))


@query("select paper_id, string_agg(body, '' order by turn) transcript, count(*) parts from comments group by paper_id")
def transcripts(d):
    parts = F.array_sort(F.collect_list(F.struct("turn", "body")))
    return d.comments().groupBy("paper_id").agg(parts.alias("p")).select("paper_id", F.array_join("p.body", "").alias("transcript"), F.size("p").cast("long").alias("parts"))


@query("select * from (select l_orderkey % nd.n paper_id, row_number() over (partition by l_orderkey % nd.n order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) revision_number, l_shipdate created_at from lineitem cross join nd)")
def revision_history(d):
    rows = d.table("lineitem").withColumn("paper_id", F.col("l_orderkey") % d.n_documents)
    w = Window.partitionBy("paper_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select("paper_id", F.row_number().over(w).alias("revision_number"), F.col("l_shipdate").alias("created_at"))


@query("""select author_key user_id, count(*) papers, count(*) filter (stage = 'published') published, least(coalesce(max(v.n), 0), 50) reviews_cast, coalesce(max(k.n), 0) comments_posted
 from summaries left join (select user_id, count(*) n from reviews group by user_id) v on v.user_id = author_key left join (select author_key ck, count(*) n from comments group by ck) k on ck = author_key group by author_key""")
def user_stats(d):
    p = d.summaries(comments=False).groupBy(F.col("author_key").alias("user_id")).agg(F.count("*").alias("papers"), F.count_if(F.col("stage") == "published").alias("published"))
    v = d.votes().select("user_id", "paper_id").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    c = d.comments().groupBy(F.col("author_key").alias("user_id")).agg(F.count("*").alias("m"))
    return p.join(v, "user_id", "left").join(c, "user_id", "left").select("user_id", "papers", "published", F.least(F.coalesce("n", F.lit(0)), F.lit(USER_REVIEWS)).alias("reviews_cast"), F.coalesce("m", F.lit(0)).alias("comments_posted"))


@query("select user_id, paper_id, stance, rn position from (select *, row_number() over (partition by user_id order by created_at desc, paper_id) rn from reviews) where rn <= 50")
def user_recent_reviews(d):
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "paper_id")
    return d.reviews().withColumn("position", F.row_number().over(w)).where(F.col("position") <= USER_REVIEWS).select("user_id", "paper_id", "stance", "position")


def user_profile(d: Domain, user: int) -> DataFrame:
    """One row: (user: public profile, papers: summaries, the newest first, reviews: the newest 50, stats)."""
    who = d.user(F.lit(user))
    empty = d.spark.range(1).select(who.alias("author_id"))
    me = with_author(d, empty).select(author_struct().alias("user"))
    own = nested_summary(with_author(d, d.summaries(d.papers().where(F.col("author_key") == user))))
    papers = own.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("createdAt", (-F.col("id")).alias("k"), F.struct(*own.columns).alias("p"))))), lambda x: x["p"]).alias("papers"))
    r = d.reviews(d.votes().where(F.col("user_id") == user)).orderBy(F.desc("created_at"), "paper_id").limit(USER_REVIEWS)
    reviews = r.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", (-F.col("paper_id")).alias("k"), "id", "paper_id", "stance")))), lambda x: F.struct(x["id"].alias("id"), x["paper_id"].alias("paperId"), x["stance"].alias("stance"), x["created_at"].alias("createdAt"))).alias("reviews"))
    posted = d.comments().where(F.col("author_key") == user).agg(F.count("*").alias("posted"))
    rows = me.crossJoin(papers).crossJoin(reviews).crossJoin(posted)  # a row each
    stats = F.struct(F.size("papers").alias("papersSubmitted"), F.size(F.filter("papers", lambda p: p["stage"] == "published")).alias("papersPublished"), F.size("reviews").alias("reviewsCast"), F.col("posted").alias("commentsPosted"))
    return rows.select("user", "papers", "reviews", stats.alias("stats"))


@query(f"""select 'user_000014' id, coalesce((select display_name from profiles where id = 'user_000014'), 'Researcher 000014') display_name, coalesce((select created_at from profiles where id = 'user_000014'), timestamp '{AS_OF}') since,
 (select string_agg(cast(id as varchar) || ':' || stage || ':' || comments, ',' order by created_at desc, id) from summaries where author_key = 14) papers,
 (select string_agg(cast(paper_id as varchar) || ':' || stance, ',' order by created_at desc, paper_id) from (select * from reviews where user_id = 14 order by created_at desc, paper_id limit 50)) reviews,
 (select count(*) from summaries where author_key = 14) submitted, (select count(*) from summaries where author_key = 14 and stage = 'published') published, (select least(count(*), 50) from reviews where user_id = 14) cast_,
 (select count(*) from comments where author_key = 14) posted""")
def user_page(d):
    def told(of: str, *parts: str) -> Column:
        listed = F.array_join(F.transform(of, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), ",")
        return F.when(F.size(of) > 0, listed)

    p = user_profile(d, 14)
    return p.select("user.id", F.col("user.displayName").alias("display_name"), F.col("user.createdAt").alias("since"), told("papers", "id", "stage", "commentCount").alias("papers"), told("reviews", "paperId", "stance").alias("reviews"), F.col("stats.papersSubmitted").alias("submitted"), F.col("stats.papersPublished").alias("published"), F.col("stats.reviewsCast").alias("cast_"), F.col("stats.commentsPosted").alias("posted"))


@query("select id, stage, floor(least(100e0, greatest(0e0, combined / case stage when 'draft' then 6.5e0 when 'under_review' then 7.5e0 else 8e0 end * 100)) * 100 + 0.5) / 100e0 progress, replace(stage, '_', ' ') label from summaries")
def stage_progress(d):
    return d.summaries(comments=False).select("id", "stage", scores.round2(scores.progress(F.col("combined"), F.col("stage"))).alias("progress"), text.stage_label(F.col("stage")).alias("label"))


@query("select id, floor(greatest(1e0, least(9e0, 4e0 + log10(greatest(length(body), 1)) + least(id % 9, 6) * 0.3e0)) * 100 + 0.5) / 100e0 score from papers")
def fallback_score(d):
    return d.papers().select("id", scores.round2(scores.fallback_score(F.length("body"), F.size("references"))).alias("score"))


@query("select author_key user_id, id, stage, row_number() over (partition by author_key order by created_at desc, id) position from summaries")
def user_papers(d):
    w = Window.partitionBy("author_key").orderBy(F.desc("created_at"), "id")
    return d.summaries(comments=False).select(F.col("author_key").alias("user_id"), "id", "stage", F.row_number().over(w).alias("position"))


#: Tags of a paper that a card shows.
SHOWN = 3


@query("select id, array_to_string(tags[1:3], ',') shown, greatest(len(tags) - 3, 0) more from (select id, list_concat(fields, list_transform(range(1, id % 3 + 1), lambda i: 'tag-' || i)) tags from papers)")
def card_tags(d):
    extra = F.when(F.col("id") % 3 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("id") % 3), lambda i: F.concat(F.lit("tag-"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    p = d.papers().select("id", F.concat("fields", extra).alias("tags"))
    return p.select("id", F.array_join(F.slice("tags", 1, SHOWN), ",").alias("shown"), F.greatest(F.size("tags") - SHOWN, F.lit(0)).alias("more"))

