"""The publishing tables, made from the test tables (documents, labels, events, customer, conversations, orders, lineitem)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import scores
from quorumlake.operators.writes import latest_wins

#: The time that "now" is, and the time up to which stored stages know the votes.
AS_OF, STORED = "2024-01-20 00:00:00", "2024-01-16 00:00:00"
STANCES = ("endorse", "challenge", "reject")


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_documents(self) -> int:
        return self.table("documents").count()  # from the files' footers

    @cached_property
    def n_customers(self) -> int:
        return self.table("customer").count()

    def user(self, key: Column) -> Column:
        return F.concat(F.lit("user_"), F.lpad(key.cast("string"), 6, "0"))

    def profiles(self) -> DataFrame:
        k = F.col("c_custkey")
        c = self.table("customer").where(k % 7 != 0)
        avatar = F.when(k % 5 == 0, F.concat(F.lit("https://img.example/"), k.cast("string")))
        return c.select(self.user(k).alias("id"), F.col("c_name").alias("display_name"), avatar.alias("avatar_url"), F.col("c_mktsegment").alias("bio"), _minutes("2023-06-01 00:00:00", k).alias("created_at"))

    def identities(self) -> DataFrame:
        """What an identity provider knows of users without a profile; of one in four nothing."""
        k = F.col("c_custkey")
        kind = F.floor(k / 7) % 4
        c = self.table("customer").where((k % 7 == 0) & (kind < 3))
        return c.select(
            self.user(k).alias("id"), F.when(kind == 0, "Ada").alias("first"), F.when(kind == 0, F.col("c_mktsegment")).alias("last"), F.when(kind == 1, F.concat(F.lit("name"), k.cast("string"))).alias("username"),
            F.when(kind == 2, F.concat(F.lit("mail"), k.cast("string"), F.lit("@x.example"))).alias("email"), F.when(k % 2 == 0, F.concat(F.lit("https://img.example/i"), k.cast("string"))).alias("image_url"),
        )

    def papers(self) -> DataFrame:
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        labelled, id_ = F.col("quality").isNotNull(), F.col("doc_id")
        author = id_ % self.n_customers
        refs = F.transform(F.sequence(F.lit(1).cast("long"), id_ % 9), lambda i: F.struct(F.concat(F.lit(" Work "), i.cast("string")).alias("citation"), F.when(i % 2 == 0, F.concat(F.lit("https://ref.example/"), i.cast("string"))).alias("url")))
        return d.select(
            id_.alias("id"),
            author.alias("author_key"),
            self.user(author).alias("author_id"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.substring("text", 1, 280).alias("abstract"),
            F.col("text").alias("body"),
            F.array("lang", "source", F.when(F.col("n_chars") < 1000, "size-short").when(F.col("n_chars") < 5000, "size-medium").otherwise("size-long")).alias("fields"),
            F.when(id_ % 9 == 0, F.array().cast("array<struct<citation:string,url:string>>")).otherwise(refs).alias("references"),
            F.when(labelled, F.lit(5.0) + F.col("quality") * 4.0 - F.col("toxic") * 3.0 + (id_ % 11) / 10.0).alias("rigor"),
            F.when(labelled, (id_ % 101) / 100.0).alias("conf"),
            (id_ % 4).cast("int").alias("revision_count"),
            _minutes("2024-01-01 00:00:00", id_).alias("created_at"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int), 0, cast(doc_id as int))").alias("updated_at"),
        )

    def votes(self, own: bool = False) -> DataFrame:
        """All votes cast; those on the voter's own paper only if asked for."""
        e = self.table("events").where("event_type <> 'signup'").withColumn("paper_id", F.col("event_id") % self.n_documents)
        self_vote = F.col("user_id") == F.col("paper_id") % self.n_customers
        stance = F.when(F.col("event_type").isin("click", "purchase") | (F.col("event_id") % 3 == 0), "endorse").when(F.col("event_type") == "view", "challenge").otherwise("reject")
        return e.where((self_vote if own else ~self_vote) & (F.col("paper_id") % 10 != 0)).select("event_id", "paper_id", "user_id", stance.alias("stance"), "ts")

    def reviews(self, votes: DataFrame | None = None) -> DataFrame:
        """(paper_id, user_id, id: the first vote's, last_id, created_at, updated_at, stance)."""
        return latest_wins(self.votes() if votes is None else votes, ["paper_id", "user_id"], "ts", "event_id", "stance", STANCES)

    def comments(self) -> DataFrame:
        turn, conv = F.col("turn"), F.col("conv_id")
        key = conv * 1000
        author = (conv * 3 + turn) % self.n_customers
        return self.table("conversations").select((key + turn).alias("id"), conv.alias("paper_id"), F.when(turn > 0, key + turn - 1).alias("parent_id"), self.user(author).alias("author_id"), author.alias("author_key"), F.col("text").alias("body"), turn.alias("turn"), _minutes("2024-01-02 00:00:00", conv * 7 + turn).alias("created_at"))

    def reports(self) -> DataFrame:
        """Reports with one score for each axis, made from a price's digits."""
        k, cents = F.col("o_orderkey"), F.col("o_totalprice") % 1000
        return self.table("orders").select(k.alias("id"), (k % self.n_documents).alias("paper_id"), (cents / 100.0).alias("score"), ((k % 101) / 100.0).alias("confidence"), F.col("o_orderstatus").alias("critique"), F.col("o_orderdate").alias("created_at"))

    def vote_counts(self, reviews: DataFrame) -> DataFrame:
        return reviews.groupBy(F.col("paper_id").alias("id")).agg(*[F.count_if(F.col("stance") == s).alias(s) for s in STANCES])

    def summaries(self, papers: DataFrame | None = None, few: bool = False, comments: bool = True) -> DataFrame:
        """Papers with vote and comment counts, scores and stage, zero where nothing was counted.

        few: papers are some hundred at most, so only their votes and comments are counted, found by a broadcast of their ids.
        """
        p = self.papers() if papers is None else papers

        def of_papers(rows: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(p.select(F.col("id").alias("paper_id"))), "paper_id", "left_semi") if few else rows

        out = p.join(self.vote_counts(self.reviews(of_papers(self.votes()))), "id", "left")
        out = out.withColumns({s: F.coalesce(s, F.lit(0)) for s in STANCES})
        if comments:
            c = of_papers(self.comments()).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("comments"))
            out = out.join(c, "id", "left").withColumn("comments", F.coalesce("comments", F.lit(0)))
        return scored(out)


def scored(papers: DataFrame, rigor: str = "rigor", conf: str = "conf") -> DataFrame:
    """papers with counts of votes, and community, combined and stage added."""
    e, c, r = (F.col(s) for s in STANCES)
    p = papers.withColumn("community", scores.community_score(e, c, r))
    p = p.withColumn("combined", scores.combined_score(F.col(rigor), F.col(conf), F.col("community"), e + c + r))
    return p.withColumn("stage", scores.stage(F.col("combined"), F.col(rigor), e, c, r))


def _minutes(since: str, n: Column) -> Column:
    return F.expr(f"timestamp_ntz'{since}'") + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


#: The same tables in DuckDB's SQL, for the oracles.
VIEWS = """
with nd as (select count(*) n from documents), nc as (select count(*) n from customer),
profiles as (
  select 'user_' || lpad(cast(c_custkey as varchar), 6, '0') id, c_name display_name, case when c_custkey % 5 = 0 then 'https://img.example/' || c_custkey end avatar_url,
         c_mktsegment bio, timestamp '2023-06-01' + to_minutes(c_custkey) created_at
  from customer where c_custkey % 7 <> 0),
identities as (
  select 'user_' || lpad(cast(k as varchar), 6, '0') id, case when kind = 0 then 'Ada' end first, case when kind = 0 then c_mktsegment end last, case when kind = 1 then 'name' || k end username,
         case when kind = 2 then 'mail' || k || '@x.example' end email, case when k % 2 = 0 then 'https://img.example/i' || k end image_url
  from (select c_custkey k, (c_custkey // 7) % 4 kind, c_mktsegment from customer where c_custkey % 7 = 0) where kind < 3),
papers as (
  select d.doc_id id, d.doc_id % nc.n author_key, 'user_' || lpad(cast(d.doc_id % nc.n as varchar), 6, '0') author_id,
         split_part(text, chr(10), 1) title, substr(text, 1, 280) abstract, text body,
         [lang, source, case when n_chars < 1000 then 'size-short' when n_chars < 5000 then 'size-medium' else 'size-long' end] fields,
         list_transform(range(1, d.doc_id % 9 + 1), lambda i: {'citation': ' Work ' || i, 'url': case when i % 2 = 0 then 'https://ref.example/' || i end}) refs,
         case when l.doc_id is not null then 5e0 + quality * 4e0 - toxic * 3e0 + (d.doc_id % 11) / 10e0 end rigor,
         case when l.doc_id is not null then (d.doc_id % 101) / 100e0 end conf,
         cast(d.doc_id % 4 as int) revision_count,
         timestamp '2024-01-01' + to_minutes(d.doc_id) created_at,
         timestamp '2024-01-01' + to_minutes(d.doc_id) + to_days(cast(d.doc_id % 30 as int)) updated_at
  from documents d cross join nc left join labels l on l.doc_id = d.doc_id),
cast_votes as (
  select event_id, event_id % nd.n paper_id, user_id, ts, user_id = (event_id % nd.n) % nc.n own,
         case when event_type in ('click', 'purchase') or event_id % 3 = 0 then 'endorse' when event_type = 'view' then 'challenge' else 'reject' end stance
  from events cross join nd cross join nc where event_type <> 'signup' and (event_id % nd.n) % 10 <> 0),
reviews as (
  select paper_id, user_id, 'user_' || lpad(cast(user_id as varchar), 6, '0') author_id, id, last_id, created_at, updated_at, stance from (
    select *, min(ts) over k created_at, ts updated_at, event_id last_id, first_value(event_id) over (partition by paper_id, user_id order by ts, event_id) id,
           row_number() over (partition by paper_id, user_id order by ts desc, event_id desc) rn from cast_votes where not own window k as (partition by paper_id, user_id)) where rn = 1),
comments as (
  select conv_id * 1000 + turn id, conv_id paper_id, case when turn > 0 then conv_id * 1000 + turn - 1 end parent_id, 'user_' || lpad(cast((conv_id * 3 + turn) % nc.n as varchar), 6, '0') author_id,
         (conv_id * 3 + turn) % nc.n author_key, text body, turn, timestamp '2024-01-02' + to_minutes(conv_id * 7 + turn) created_at
  from conversations cross join nc),
reports as (select o_orderkey id, o_orderkey % nd.n paper_id, (o_totalprice % 1000) / 100e0 score, (o_orderkey % 101) / 100e0 confidence, o_orderstatus critique, o_orderdate created_at from orders cross join nd),
counted as (
  select p.*, coalesce(e, 0) endorse, coalesce(c, 0) challenge, coalesce(r, 0) reject, coalesce(m, 0) comments
  from papers p
  left join (select paper_id, count(*) filter (stance = 'endorse') e, count(*) filter (stance = 'challenge') c, count(*) filter (stance = 'reject') r from reviews group by paper_id) v on v.paper_id = p.id
  left join (select paper_id, count(*) m from comments group by paper_id) k on k.paper_id = p.id),
with_community as (select *, case when endorse + challenge + reject = 0 then 0e0 else (endorse * 10e0 + challenge * 4e0) / (endorse + challenge + reject) end community from counted),
with_combined as (
  select *, case when endorse + challenge + reject < 3
      then 0.55e0 * coalesce(rigor, 0e0) + 0.35e0 * (coalesce(conf, 0e0) * 10e0) + 0.1e0 * community
      else 0.4e0 * coalesce(rigor, 0e0) + 0.25e0 * (coalesce(conf, 0e0) * 10e0) + 0.35e0 * community end combined from with_community),
summaries as (
  select *, case when combined >= 8e0 and endorse >= 5 and endorse > reject * 2 then 'published'
                 when combined >= 7.5e0 and endorse + challenge + reject >= 3 and endorse >= reject then 'promoted'
                 when combined >= 6.5e0 or endorse + challenge + reject >= 1 or coalesce(rigor, 0e0) >= 6.5e0 then 'under_review' else 'draft' end stage
  from with_combined)
"""
