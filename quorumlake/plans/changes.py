"""The queries that show what writes make of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import requests, scores, text
from quorumlake.operators import writes
from quorumlake.plans import refresh
from quorumlake.plans.queries import of_ids, with_author
from quorumlake.plans.registry import query
from quorumlake.sources import files
from quorumlake.sources.domain import AS_OF, STORED, Domain

#: Posts made from events: every third one names a paper that isn't there, one in seven has no body.
POSTS_SQL = """, posts as (
  select event_id id, event_id % nd.n + case when event_id % 3 = 0 then 1000000000 else 0 end paper_id, 'user_' || lpad(cast(user_id as varchar), 6, '0') author_id,
         case when event_id % 2 = 0 then event_id - 1 end parent_id, case when event_id % 7 <> 0 then props end body, user_id
  from events cross join nd where event_type = 'click')"""


def _posts(d: Domain) -> DataFrame:
    id_ = F.col("event_id")
    return d.table("events").where("event_type = 'click'").select(
        id_.alias("id"), (id_ % d.n_documents + F.when(id_ % 3 == 0, 1_000_000_000).otherwise(0)).alias("paper_id"), d.user(F.col("user_id")).alias("author_id"), F.when(id_ % 2 == 0, id_ - 1).alias("parent_id"), F.when(id_ % 7 != 0, F.col("props")).alias("body")
    )


def _now() -> Column:
    return F.expr(f"timestamp_ntz'{AS_OF}'")


@query(f"""{POSTS_SQL} select p.id, paper_id, parent_id, body, p.author_id, coalesce(display_name, 'Researcher ' || right(p.author_id, 6)) author_name, timestamp '{AS_OF}' created_at
 from posts p left join profiles a on a.id = p.author_id where paper_id < 1000000000 and body is not null""")
def comments_inserted(d):
    made, _ = writes.comment(d.papers(), _posts(d), _now())
    return with_author(d, made).select("id", "paper_id", "parent_id", "body", "author_id", "author_name", "created_at")


@query(f"{POSTS_SQL} select id, paper_id, case when paper_id >= 1000000000 then '404' else '400' end status from posts where paper_id >= 1000000000 or body is null")
def comments_refused(d):
    _, refused = writes.comment(d.papers(), _posts(d), _now())
    return refused.select("id", "paper_id", "status")


@query(f"""{POSTS_SQL} select (select count(*) from comments) + (select count(*) from posts where paper_id < 1000000000 and body is not null) n, (select max(id) from comments) + 1000000 last_id""")
def comments_after(d):
    made, _ = writes.comment(d.papers(), _posts(d), _now())
    old = d.comments().select("id", "paper_id", "author_id", "parent_id", "body", "created_at")
    return old.withColumn("new", F.lit(0)).unionByName(made.withColumn("new", F.lit(1))).agg(F.count("*").alias("n"), (F.max(F.when(F.col("new") == 0, F.col("id"))) + 1_000_000).alias("last_id"))


@query(f"{POSTS_SQL} select id, case when paper_id >= 1000000000 then '404' when paper_id % nc.n = user_id then '400' else 'counts' end status from posts cross join nc")
def votes_judged(d):
    ok, refused = writes.cast_votes(d.papers().select("id", "author_id"), _posts(d))
    return ok.select("id", F.lit("counts").alias("status")).unionByName(refused.select("id", "status"))


#: Drafts made from parts: some with a blank abstract, some without a tag.
DRAFTS_SQL = """, drafts as (
  select 1000000 + p_partkey id, 'user_' || lpad(cast(p_partkey % nc.n as varchar), 6, '0') author_id, ' ' || p_name || ' ' title, case when p_partkey % 11 = 0 then '  ' else p_type end abstract, p_brand body,
         case when p_partkey % 13 = 0 then [' '] else [' ' || p_brand, lower(p_brand) || ' ', p_type] end fields from part cross join nc)"""


def _drafts(d: Domain) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(F.concat(F.lit(" "), F.col("p_name")).alias("citation"), F.lit("  ").alias("url"))
    blank = F.struct(F.lit(" ").alias("citation"), F.lit("x").alias("url"))
    tags = F.when(k % 13 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" "), F.col("p_brand")), F.concat(F.lower("p_brand"), F.lit(" ")), F.col("p_type")))
    return d.table("part").select((k + 1_000_000).alias("id"), d.user(k % d.n_customers).alias("author_id"), F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("title"), F.when(k % 11 == 0, "  ").otherwise(F.col("p_type")).alias("abstract"), F.col("p_brand").alias("body"), tags.alias("fields"), F.array(one, blank).alias("references"))


@query(f"""{DRAFTS_SQL} select id, author_id, trim(title) title, abstract, body, lower(body) || ',' || lower(abstract) field_list, trim(title) citation, cast(null as varchar) url, 1 n_references, 'draft' stage, cast(null as double) rigor_score, cast(null as double) ai_confidence, 0 revision_count, timestamp '{AS_OF}' created_at, timestamp '{AS_OF}' updated_at
 from drafts where trim(abstract) <> '' and len(fields) > 1""")
def papers_created(d):
    made, _ = writes.create(_drafts(d), _now())
    first = F.get("references", 0)
    return made.withColumns({"field_list": F.array_join("fields", ","), "citation": first["citation"], "url": first["url"], "n_references": F.size("references")}).drop("fields", "references")


@query(f"{DRAFTS_SQL} select id from drafts where trim(abstract) = '' or len(fields) = 1")
def papers_refused(d):
    _, refused = writes.create(_drafts(d), _now())
    return refused.select("id")


#: Edits made from events: by the author unless the number ends in 5; one in nine of no paper.
EDITS_SQL = """, edits as (
  select event_id edit_id, case when event_id % 9 = 0 then 2000000000 else event_id % nd.n end id, 'user_' || lpad(cast((event_id % nd.n + case when event_id % 10 = 5 then 1 else 0 end) % nc.n as varchar), 6, '0') author_id,
         'Title ' || event_id title, 'Abstract ' || event_id abstract, 'Body ' || event_id body, 'tag-' || event_id % 3 tag, 'Because ' || event_type summary, ts as happened
  from events cross join nd cross join nc where event_type in ('purchase', 'view')),
judged as (
  select e.*, p.title old_title, p.abstract old_abstract, p.revision_count, case when p.id is null then '404' when p.author_id <> e.author_id then '403' end status from edits e left join papers p on p.id = e.id),
numbered as (
  select *, revision_count + row_number() over k number, coalesce(lag(title) over k, old_title) before_title, coalesce(lag(abstract) over k, old_abstract) before_abstract, lead(edit_id) over k is null as is_last
  from judged where status is null window k as (partition by id order by happened, edit_id))"""


def _edits(d: Domain) -> DataFrame:
    k = F.col("event_id")
    own = (k % d.n_documents + F.when(k % 10 == 5, 1).otherwise(0)) % d.n_customers
    named = [F.concat(F.lit(f"{c.title()} "), k.cast("string")).alias(c) for c in ("title", "abstract", "body")]
    none = F.array().cast("array<struct<citation:string,url:string>>")
    return d.table("events").where(F.col("event_type").isin("purchase", "view")).select(
        k.alias("edit_id"), F.when(k % 9 == 0, 2_000_000_000).otherwise(k % d.n_documents).alias("id"), d.user(own).alias("author_id"), *named, F.array(F.concat(F.lit("tag-"), (k % 3).cast("string"))).alias("fields"), none.alias("references"),
        F.concat(F.lit("Because "), F.col("event_type")).alias("summary"), F.col("ts").alias("at"),
    )


@query(f"{EDITS_SQL} select id paper_id, number revision_number, before_title title, before_abstract abstract, summary, happened created_at from numbered")
def revisions_inserted(d):
    return writes.revise(d.papers(), _edits(d))[0]


@query(f"""{EDITS_SQL} select p.id, coalesce(n.title, p.title) title, md5(coalesce(n.body, p.body)) body_md5, coalesce(n.tag, array_to_string(fields, ',')) field_list, case when n.id is null then len(refs) else 0 end n_references,
 coalesce(n.number, p.revision_count) revision_count, coalesce(n.happened, p.updated_at) updated_at from papers p left join (select * from numbered where is_last) n on n.id = p.id""")
def papers_revised(d):
    now = writes.revise(d.papers(), _edits(d))[1]
    return now.select("id", "title", F.md5("body").alias("body_md5"), F.array_join("fields", ",").alias("field_list"), F.size("references").alias("n_references"), "revision_count", "updated_at")


@query(f"{EDITS_SQL} select edit_id, id, author_id, status from judged where status is not null")
def edits_refused(d):
    return writes.revise(d.papers(), _edits(d))[2]


#: Papers with the stages that they had by the votes up to STORED.
STORED_SQL = f""", old_votes as (
  select paper_id, count(*) filter (stance = 'endorse') e, count(*) filter (stance = 'challenge') c, count(*) filter (stance = 'reject') r
  from (select *, row_number() over (partition by paper_id, user_id order by ts desc, event_id desc) rn from cast_votes where not own and ts <= timestamp '{STORED}') where rn = 1 group by paper_id),
old_counts as (select p.id, p.rigor, p.conf, coalesce(e, 0) e, coalesce(c, 0) c, coalesce(r, 0) r from papers p left join old_votes on paper_id = p.id),
old_scores as (select *, case when e + c + r = 0 then 0e0 else (e * 10e0 + c * 4e0) / (e + c + r) end community from old_counts),
old_combined as (select *, case when e + c + r < 3 then 0.55e0 * coalesce(rigor, 0e0) + 0.35e0 * (coalesce(conf, 0e0) * 10e0) + 0.1e0 * community else 0.4e0 * coalesce(rigor, 0e0) + 0.25e0 * (coalesce(conf, 0e0) * 10e0) + 0.35e0 * community end combined from old_scores),
stored as (select id, case when combined >= 8e0 and e >= 5 and e > r * 2 then 'published' when combined >= 7.5e0 and e + c + r >= 3 and e >= r then 'promoted' when combined >= 6.5e0 or e + c + r >= 1 or coalesce(rigor, 0e0) >= 6.5e0 then 'under_review' else 'draft' end stage from old_combined)"""


def _stored(d: Domain) -> DataFrame:
    """Papers with a stored stage, as the tables have them before the votes since STORED."""
    papers = d.papers().select("id", "author_id", F.col("rigor").alias("rigor_score"), F.col("conf").alias("ai_confidence"), F.lit("draft").alias("stage"))
    counts = d.vote_counts(d.reviews(d.votes().where(F.col("ts") <= F.expr(f"timestamp_ntz'{STORED}'"))))
    return writes.recompute_stages(papers, counts)[0]


@query(f"{STORED_SQL} select s.id, t.stage old_stage, s.stage new_stage from summaries s join stored t on t.id = s.id where s.stage <> t.stage")
def stage_changes(d):
    return writes.recompute_stages(_stored(d), d.vote_counts(d.reviews()))[1]


@query("select id, stage, rigor rigor_score, conf ai_confidence from summaries")
def stages_recomputed(d):
    return writes.recompute_stages(_stored(d), d.vote_counts(d.reviews()))[0].select("id", "stage", "rigor_score", "ai_confidence")


RESCORED_SQL = """, told as (select paper_id, score, confidence from (select *, row_number() over (partition by paper_id order by created_at desc, id desc) rn from reports) where rn = 1),
fresh as (
  select s.id, endorse, challenge, reject, community, coalesce(t.score, s.rigor) rigor, coalesce(t.confidence, s.conf) conf, s.stage old_stage, t.paper_id is not null as is_new from summaries s left join told t on t.paper_id = s.id),
fresh_combined as (
  select *, case when endorse + challenge + reject < 3 then 0.55e0 * coalesce(rigor, 0e0) + 0.35e0 * (coalesce(conf, 0e0) * 10e0) + 0.1e0 * community else 0.4e0 * coalesce(rigor, 0e0) + 0.25e0 * (coalesce(conf, 0e0) * 10e0) + 0.35e0 * community end combined from fresh),
rescored as (
  select *, case when not is_new then old_stage when combined >= 8e0 and endorse >= 5 and endorse > reject * 2 then 'published' when combined >= 7.5e0 and endorse + challenge + reject >= 3 and endorse >= reject then 'promoted'
    when combined >= 6.5e0 or endorse + challenge + reject >= 1 or coalesce(rigor, 0e0) >= 6.5e0 then 'under_review' else 'draft' end new_stage from fresh_combined)"""


def _rescored(d: Domain) -> tuple[DataFrame, DataFrame]:
    papers = d.summaries(comments=False).select("id", F.col("rigor").alias("rigor_score"), F.col("conf").alias("ai_confidence"), "stage")
    best = writes.latest_per_key(d.reports(), ["paper_id"], [F.desc("created_at"), F.desc("id")])
    new = best.select("paper_id", F.col("score").alias("rigor_score"), F.col("confidence").alias("survey_confidence"))
    return refresh.apply_reports(papers, new, d.vote_counts(d.reviews()).withColumnRenamed("id", "paper_id"))


@query(f"{RESCORED_SQL} select id, rigor rigor_score, conf ai_confidence, new_stage stage from rescored")
def reports_applied(d):
    return _rescored(d)[0]


@query(f"{RESCORED_SQL} select id, old_stage, new_stage from rescored where old_stage <> new_stage")
def reports_change_stages(d):
    return _rescored(d)[1]


@query("select count(*) n from comments where 1 = 0")
def comments_deleted(d):
    return writes.delete_all(d.comments()).agg(F.count("*").alias("n"))


@query("select conv_id, turn from conversations where conv_id % 5 <> 0")
def messages_after_delete(d):
    gone = d.table("conversations").where("conv_id % 5 = 0").select("conv_id").distinct()
    return writes.delete_cascade(d.table("conversations"), gone, "conv_id", "conv_id").select("conv_id", "turn")


def nested_documents(d: Domain) -> DataFrame:
    """Papers as nested documents, as a seed has them: votes in the order of their ids with every changed vote, threads of one level."""
    votes = d.votes().groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "user_id", "stance"))), lambda v: F.struct(d.user(v["user_id"]).alias("author_id"), v["stance"].alias("stance"), F.lit("because").alias("justification"))).alias("reviews"))
    c = d.comments()
    said = c.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("turn", "author_id", "body"))).alias("all"))
    replies = F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda r: F.struct(r["author_id"].alias("author_id"), r["body"].alias("body")))
    threads = said.select("paper_id", F.array(F.struct(F.col("all")[0]["author_id"].alias("author_id"), F.col("all")[0]["body"].alias("body"), replies.alias("replies"))).alias("comments"))
    p = d.papers().join(votes.withColumnRenamed("paper_id", "id"), "id", "left").join(threads.withColumnRenamed("paper_id", "id"), "id", "left")
    empty = {"reviews": "array<struct<author_id:string,stance:string,justification:string>>", "comments": "array<struct<author_id:string,body:string,replies:array<struct<author_id:string,body:string>>>>"}
    return p.select("id", "author_id", "title", "abstract", "body", "fields", "references", F.struct(F.col("rigor").alias("overallScore")).alias("rigor"), F.struct(F.col("conf").alias("confidence")).alias("survey"), *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in empty.items()])


@query("""select 'papers' as name, count(*) n from papers union all select 'profiles', count(*) from profiles union all select 'reports', count(*) from papers
 union all select 'reviews', count(*) from reviews union all select 'comments', count(*) from comments""")
def reseeded(d):
    docs, people = nested_documents(d), d.profiles()
    loaded = writes.load(docs, _now())
    old = {"profiles": people, **loaded}
    return _counts(writes.reseed(old, docs, people, _now()))


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("select * from (select paper_id, 'user_' || lpad(cast(user_id as varchar), 6, '0') author_id, first_value(stance) over (partition by paper_id, user_id order by event_id) stance, row_number() over (partition by paper_id, user_id order by event_id) rn from cast_votes where not own) where rn = 1")
def reviews_loaded(d):
    return writes.load(nested_documents(d), _now())["reviews"].select("paper_id", "author_id", "stance", F.lit(1).alias("rn"))


#: Bodies of requests made from events, some of them wrong in one way or another.
def _bodies(d: Domain) -> DataFrame:
    k = F.col("event_id")
    stance = F.when(k % 4 == 0, F.lit('"endorse"')).when(k % 4 == 1, F.lit('"maybe"')).when(k % 4 == 2, F.lit("5")).otherwise(F.lit('"reject"'))
    body = F.concat(F.lit('{"stance": '), stance, F.when(k % 5 != 0, F.concat(F.lit(', "justification": "'), F.col("event_type"), F.lit('"'))).otherwise(""), F.when(k % 7 != 0, "}").otherwise(""))
    return d.table("events").select(k.alias("id"), body.alias("body"))


@query("""select event_id id, case when event_id % 7 = 0 then 'body: no JSON object' else concat_ws('; ', case event_id % 4 when 1 then 'stance: none of endorse, challenge, reject' when 2 then 'stance: not a string' end, case when event_id % 5 = 0 then 'justification: missing' end) end errors,
 case when event_id % 7 <> 0 and event_id % 4 in (0, 3) and event_id % 5 <> 0 then case event_id % 4 when 0 then 'endorse' else 'reject' end end stance from events""")
def requests_checked(d):
    checked = requests.checked(_bodies(d), requests.REVIEW)
    return checked.select("id", F.array_join("errors", "; ").alias("errors"), F.when(F.size("errors") == 0, F.col("request.stance")).alias("stance"))


@query("""select event_id id, 'endorse' stance from events where event_id % 7 <> 0 and event_id % 4 = 0""")
def requests_parsed(d):
    good, _ = files.requests(_bodies(d), "stance string, justification string")
    return good.where("request.stance = 'endorse'").select("id", "request.stance")


@query("""select '{"id":' || id || ',"stage":"' || stage || '","rigor":' || case when rigor is null then 'null' else 'true' end || '}' as line from summaries""")
def responses_json(d):
    return files.as_json(d.summaries(comments=False).select("id", "stage", F.when(F.col("rigor").isNotNull(), F.lit(True)).alias("rigor"))).withColumnRenamed("value", "line")


@query("select event_id id, case when event_id % 2 = 0 then '[Redacted]' end as \"authorization\", case when event_id % 3 = 0 then '[Redacted]' end cookie, 'host' || user_id host, '/papers/' || event_id url from events")
def log_redacted(d):
    k = F.col("event_id")
    headers = F.struct(F.when(k % 2 == 0, "secret").alias("authorization"), F.when(k % 3 == 0, "crumbs").alias("cookie"), F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"))
    url = F.concat(F.lit("/papers/"), k.cast("string"), F.when(k % 2 == 1, "?q=a&b=c").otherwise(""))
    rows = d.table("events").select(k.alias("id"), F.struct(F.struct(headers.alias("headers"), url.alias("url")).alias("req")).alias("row"))
    out = rows.select("id", files.redacted(F.col("row"), rows.schema["row"].dataType).alias("row"))
    return out.select("id", "row.req.headers.*", text.without_query(F.col("row.req.url")).alias("url"))


@query("select id, rigor_ >= 6.5e0 above, 6.5e0 under_review, 7.5e0 promoted, 8e0 published from (select id, coalesce(rigor, 0e0) rigor_ from papers)")
def thresholds(d):
    return d.papers().select("id", (F.coalesce("rigor", F.lit(0.0)) >= scores.UNDER_REVIEW).alias("above"), scores.thresholds().alias("t")).select("id", "above", "t.*")


@query("select id from papers where id < 0")
def papers_of_no_ids(d):
    return of_ids(d.papers().select("id"), [])


@query("select id, row_number() over (order by created_at desc, id) as position from (select * from comments order by created_at desc, id limit 1)")
def newest_notice(d):
    """A list that holds the newest only."""
    rows = d.comments().orderBy(F.desc("created_at"), "id").limit(1)
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).alias("position"))
