"""The queries that show functions of values: names, tags, headers, reports, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import media, reports, scores, text
from quorumlake.plans import refresh
from quorumlake.plans.registry import query
from quorumlake.sources.domain import AS_OF, Domain


def _number() -> Column:
    return F.col("event_id")


def _id() -> Column:
    return F.col("event_id").alias("id")


def _str(c: Column) -> Column:
    return c.cast("string")


def _events(d: Domain) -> DataFrame:
    return d.table("events")


def _pick(*values: str | None) -> Column:
    """One of these by the event's number."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (_number() % len(values)).cast("int"))


def _pick_sql(*values: str | None) -> str:
    listed = ", ".join("cast(null as varchar)" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][cast(event_id % {len(values)} as int) + 1]"


@query("select id, coalesce(nullif(trim(concat_ws(' ', first, last)), ''), username, split_part(email, '@', 1)) as name, upper(left(coalesce(nullif(trim(concat_ws(' ', first, last)), ''), username, split_part(email, '@', 1)), 1)) initial from identities")
def identity_names(d):
    name = text.display_name(F.col("first"), F.col("last"), F.col("username"), F.col("email"), F.col("id"))
    return d.identities().select("id", name.alias("name"), text.initial(name).alias("initial"))


@query("select id, case when id % 4 = 0 then 'Citizen Scientist' else 'bio ' || id end bio, author_key = 7 own from papers")
def profile_defaults(d):
    bio = F.when(F.col("id") % 8 == 0, F.lit("")).when(F.col("id") % 8 == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("bio "), _str(F.col("id"))))
    return d.papers().select("id", text.bio_or_default(bio).alias("bio"), text.is_author(F.col("author_key"), F.lit(7)).alias("own"))


@query("select id, list_filter(['size', 'lang', lower(source_)], lambda t: t <> '')[1] first_tag, cast(len(list_distinct(['size', 'lang', lower(source_)])) as int) n, array_to_string(list_filter(fields, lambda t: t <> 'en'), ',') without_en from (select *, fields[2] source_ from papers)")
def tags_cleaned(d):
    raw = F.array(F.lit(" Size"), F.lit("size "), F.lit("LANG"), F.lit(" "), F.upper(F.col("fields")[1]))
    tags = text.clean_tags(raw)
    return d.papers().select("id", tags[0].alias("first_tag"), F.size(tags).alias("n"), F.array_join(text.remove_tag(F.col("fields"), F.lit("en")), ",").alias("without_en"))


@query("""select id, len(refs) n, case when len(refs) > 0 then array_to_string(list_transform(refs, lambda r, i: '[' || i || '] Work ' || i || case when i % 2 = 0 then ' (https://ref.example/' || i || ')' else '' end), chr(10)) else '(none provided)' end as lines from papers""")
def references_cleaned(d):
    blank = F.struct(F.lit("  ").alias("citation"), F.lit("x").alias("url"))
    refs = text.clean_references(F.concat(F.col("references"), F.array(blank)))
    return d.papers().select("id", F.size(refs).alias("n"), text.reference_lines(refs).alias("lines"))


@query("select id, trim(title) <> '' and id % 3 <> 0 complete, trim(title) <> '' and id % 3 <> 0 and id % 2 = 0 revision_complete from papers")
def submissions_complete(d):
    tags = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("fields"))
    parts = [F.col("title"), F.concat(F.col("abstract"), F.lit(".")), F.concat(F.col("body"), F.lit("."))]
    summary = F.when(F.col("id") % 2 == 0, "why").otherwise("  ")
    return d.papers().select("id", text.submission_complete(*parts, tags).alias("complete"), text.submission_complete(*parts, tags, summary).alias("revision_complete"))


@query("""select id, 'Title: ' || title || chr(10) || 'Fields: ' || case when id % 4 = 0 then '(unspecified)' else array_to_string(fields, ', ') end || chr(10) || chr(10) || 'Abstract:' || chr(10) || abstract || chr(10) || chr(10) || 'Body:' || chr(10) || body || chr(10) || chr(10) || 'References:' || chr(10)
 || case when len(refs) > 0 then array_to_string(list_transform(refs, lambda r, i: '[' || i || ']  Work ' || i || case when i % 2 = 0 then ' (https://ref.example/' || i || ')' else '' end), chr(10)) else '(none provided)' end prompt from papers""")
def prompts(d):
    tags = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("fields"))
    return d.papers().withColumn("fields", tags).select("id", refresh.paper_text().alias("prompt"))


@query("select p.id, k, name from papers p cross join (values (1, 'The Skeptic'), (2, 'Domain Expert'), (3, 'The Generalist'), (4, 'The Methodologist'), (5, 'The Outsider')) t(k, name)")
def personas(d):
    asked = refresh.questions(d.papers()).where("index.k > 0")
    name = F.regexp_extract("payload", r"^You are ([^:]*):", 1)
    return asked.select(F.col("index.id").alias("id"), F.col("index.k").alias("k"), name.alias("name"))


#: Answers of a model made from events: fenced, plain, of wrong types, no JSON, null.
def _rigor_answers(d: Domain) -> DataFrame:
    k = _number()
    axes = [f'"{a}": ' for a in reports.AXES]
    body = F.concat(F.lit("{" + axes[0]), _str(k % 13), F.lit(", " + axes[1]), _str(k % 7), F.lit(".5, " + axes[2] + '"9", ' + axes[3] + "-3, " + axes[4]), _str(k % 10), F.lit(', "critique": '), F.when(k % 2 == 0, F.lit('"c"')).otherwise(F.lit("7")), F.lit(', "strengths": ["a","b","c","d","e","f","g"], "weaknesses": '), F.when(k % 3 == 0, F.lit('"none"')).otherwise(F.lit('["w"]')), F.lit("}"))
    raw = F.when(k % 11 == 0, "null").when(k % 11 == 1, "not json").when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return _events(d).select(_id(), raw.alias("raw"))


@query("""select id, floor((l + m + 0e0 + 0e0 + n) / 5e0 * 100 + 0.5) / 100e0 overall, l logic, m methodology, 0e0 citations, n novelty, critique, n_strengths, weaknesses from (
 select event_id id, event_id % 11 = 1 bad, case when event_id % 11 = 1 then 0e0 else least(10e0, event_id % 13) end l, case when event_id % 11 = 1 then 0e0 else (event_id % 7) + 0.5e0 end m, case when event_id % 11 = 1 then 0e0 else (event_id % 10) * 1e0 end n,
  case when event_id % 11 <> 1 and event_id % 2 = 0 then 'c' else '' end critique, case when event_id % 11 = 1 then 0 else 6 end n_strengths, case when event_id % 11 <> 1 and event_id % 3 <> 0 then 'w' else '' end weaknesses from events where event_id % 11 <> 0)""")
def rigor_reports(d):
    r = _rigor_answers(d).where(~reports.is_null(F.col("raw"))).select("id", reports.rigor_report(F.col("raw")).alias("r"))
    return r.select("id", F.col("r.overallScore").alias("overall"), F.col("r.logicScore").alias("logic"), F.col("r.methodologyScore").alias("methodology"), F.col("r.citationsScore").alias("citations"), F.col("r.noveltyScore").alias("novelty"), F.col("r.critique").alias("critique"), F.size("r.strengths").alias("n_strengths"), F.array_join("r.weaknesses", ",").alias("weaknesses"))


VERDICT = ("endorse", "mixed", "reject", "what")


@query(f"""select id, floor(votes / case when weight = 0 then 1e0 else weight end * 100 + 0.5) / 100e0 confidence, e endorsing, r rejecting, case when e > r + 1 then 'endorse' when r > e + 1 then 'reject' else 'split' end consensus from (
 select id, c0 + c1 + c2 weight, c0 * w0 + c1 * w1 + c2 * w2 votes, cast((v0 = 'endorse') as int) + cast((v1 = 'endorse') as int) + cast((v2 = 'endorse') as int) e, cast((v0 = 'reject') as int) + cast((v1 = 'reject') as int) + cast((v2 = 'reject') as int) r from (
  select *, {", ".join(f"case v{j} when 'endorse' then 1e0 when 'reject' then 0e0 else 0.5e0 end w{j}" for j in range(3))} from (
   select event_id id, {", ".join(f"['endorse','mixed','reject','what'][cast((event_id + {j} * (event_id % 3)) % 4 as int) + 1] v{j}, ((event_id + {j}) % 6) / 5e0 c{j}" for j in range(3))} from events)))""")
def surveys(d):
    k = _number()
    passes = []
    for j in range(3):
        verdict = F.get(F.array(*map(F.lit, VERDICT)), ((k + j * (k % 3)) % 4).cast("int"))
        confidence = _str(((k + j) % 6) / F.lit(5.0))
        raw = F.concat(F.lit('{"verdict": "'), verdict, F.lit('", "confidence": '), confidence, F.lit(', "rationale": 5}'))
        passes.append(reports.survey_pass(raw, F.lit(f"p{j}")))
    s = _events(d).select(_id(), F.array(*passes).alias("passes")).select("id", reports.survey(F.col("passes")).alias("s"))
    return s.select("id", "s.*")


@query("select event_id id, floor(((event_id % 6) / 5e0) * 100 + 0.5) / 100e0 confidence, ['endorse', 'mixed', 'reject', 'mixed'][cast(event_id % 4 as int) + 1] verdict, case when event_id % 2 = 0 then 'r' else '' end rationale from events")
def survey_passes(d):
    k = _number()
    raw = F.concat(F.lit('```\n{"verdict": "'), F.get(F.array(*map(F.lit, VERDICT)), (k % 4).cast("int")), F.lit('", "confidence": '), _str((k % 6) / F.lit(5.0)), F.lit(', "rationale": '), F.when(k % 2 == 0, F.lit('"r"')).otherwise(F.lit("5")), F.lit("}```"))
    p = _events(d).select(_id(), reports.survey_pass(raw, F.lit("p")).alias("p"))
    return p.select("id", scores.round2(F.col("p.confidence")).alias("confidence"), F.col("p.verdict").alias("verdict"), F.col("p.rationale").alias("rationale"))


@query("select id, case when n = 1 then least(10e0, greatest(0e0, x)) else 0e0 end clamped from (select event_id id, cast(event_id % 5 > 1 as int) n, value - 5e0 x from events)")
def clamped(d):
    x = F.when(_number() % 5 == 0, F.lit(float("nan"))).when(_number() % 5 == 1, F.lit(None).cast("double")).otherwise(F.col("value") - 5.0)
    return _events(d).select(_id(), scores.clamp(x, 0.0, 10.0).alias("clamped"))


MESSAGES = ("HTTP 429", "RATELIMIT_EXCEEDED", "ratelimit_exceeded", "Quota hit", "a Rate Limit", "timeout", None)


@query(f"select event_id id, coalesce(m like '%429%' or m like '%RATELIMIT_EXCEEDED%' or lower(m) like '%quota%' or lower(m) like '%rate limit%', false) again from (select event_id, {_pick_sql(*MESSAGES)} m from events)")
def rate_limited(d):
    return _events(d).select(_id(), text.is_rate_limit(_pick(*MESSAGES)).alias("again"))


HEADERS = ("Application/JSON; charset=utf-8", " application/problem+json", "text/html", "image/svg+xml", "application/xml", "application/x-www-form-urlencoded", "image/png", None)


@query(f"select event_id id, t media, case when t is null or t = 'application/json' or t like '%+json' then 'json' when t like 'text/%' or t like '%xml' or t like '%form-urlencoded' then 'text' else 'blob' end kind from (select event_id, lower(trim(split_part({_pick_sql(*HEADERS)}, ';', 1))) t from events)")
def media_types(d):
    h = _pick(*HEADERS)
    return _events(d).select(_id(), text.media_type(h).alias("media"), text.response_kind(h).alias("kind"))


ANSWERS = ("{}", "  [1]", "﻿{\"a\": 1}", "text", "", " <p>", None)


@query(f"select event_id id, regexp_matches(ltrim(a, chr(65279)), '^\\s*[\\{{\\[]') json from (select event_id, {_pick_sql(*ANSWERS)} a from events)")
def json_guessed(d):
    return _events(d).select(_id(), text.looks_like_json(_pick(*ANSWERS)).alias("json"))


@query("select id, case when length(body) > 300 then substr(body, 1, 299) || '…' else body end as cut, length(case when length(body) > 300 then substr(body, 1, 299) || '…' else body end) n from papers")
def texts_truncated(d):
    cut = text.truncated(F.col("body"))
    return d.papers().select("id", cut.alias("cut"), F.length(cut).cast("long").alias("n"))


@query("""select event_id id, case when t is not null and de is not null then 'HTTP 400: ' || t || ' — ' || de when coalesce(de, m, ds, t) is not null then 'HTTP 400: ' || coalesce(de, m, ds, t) else 'HTTP 400' end message
 from (select event_id, case when event_id % 2 = 0 then 'Bad' end t, case when event_id % 3 = 0 then 'detail' end de, case when event_id % 5 = 0 then 'message' end m, case when event_id % 7 = 0 then 'described' end ds from events)""")
def error_messages(d):
    k = _number()
    parts = [F.when(k % n == 0, v) for n, v in ((2, "Bad"), (3, "detail"), (5, "message"), (7, "described"))]
    return _events(d).select(_id(), text.error_message(F.lit("HTTP 400"), *parts, F.lit(None).cast("string")).alias("message"))


@query("""select event_id id, case when event_id % 2 = 0 then 'https://api.example/papers' else 'https://other.example/papers' end || '?q=a+b%26' || event_id || case when event_id % 3 = 0 then '&stage=draft' else '' end || '&parent=' || case when event_id % 5 = 0 then '1' else 'null' end url from events""")
def urls_built(d):
    k = _number()
    path = F.when(k % 2 == 0, "/papers").otherwise("https://other.example/papers")
    params = {"q": F.concat(F.lit("a b&"), _str(k)), "stage": F.when(k % 3 == 0, "draft"), "parent": F.when(k % 5 == 0, F.lit(1))}
    return _events(d).select(_id(), text.url_with_query(text.joined_url(F.lit("https://api.example//"), path), params, nullable=("parent",)).alias("url"))


HOSTS = (" a.example , b.example", "c.example", " ,x", "", None)


@query(f"select event_id id, coalesce(nullif(trim(split_part({_pick_sql(*HOSTS)}, ',', 1)), ''), 'fallback') host from events")
def hosts_forwarded(d):
    return _events(d).select(_id(), text.first_host(_pick(*HOSTS), F.lit("fallback")).alias("host"))


@query("select event_id id, case when event_id % 3 <> 0 then base64(encode(props)) end payload, case when event_id % 3 <> 0 then props end decoded from events")
def data_urls(d):
    url = F.concat(F.lit("data:text/plain;base64"), F.when(_number() % 3 != 0, ",").otherwise(""), F.base64(F.encode("props", "utf-8")))
    payload = text.data_url_payload(url)
    return _events(d).select(_id(), payload.alias("payload"), F.decode(media.from_base64(payload), "utf-8").alias("decoded"))


NUMBERS = ("12", "", " 7.5 ", "x", "-3", None)


@query(f"select event_id id, case when trim(n) = '' then 0e0 else try_cast(trim(n) as double) end as number from (select event_id, {_pick_sql(*NUMBERS)} n from events)")
def numbers_read(d):
    return _events(d).select(_id(), text.to_number(_pick(*NUMBERS)).alias("number"))


@query("select event_id id, cast(floor(floor(q / 10e0)) as bigint) || '.' || cast(cast(q as bigint) % 10 as bigint) shown, coalesce(case event_type when 'view' then 'Views' when 'click' then 'Clicks' end, event_type) label from (select *, floor(((event_id % 40) / 4e0) * 10 + 0.5) q from events)")
def values_shown(d):
    return _events(d).select(_id(), text.one_decimal((_number() % 40) / F.lit(4.0)).alias("shown"), text.labelled(F.col("event_type"), {"view": "Views", "click": "Clicks"}).alias("label"))


@query("""select event_id id, case when m < 1 then 'less than a minute' when m < 45 then m || ' minute' || case when m = 1 then '' else 's' end when m < 90 then 'about 1 hour'
 when m < 1440 then 'about ' || cast(floor(m / 60e0 + 0.5) as bigint) || ' hour' || case when floor(m / 60e0 + 0.5) = 1 then '' else 's' end when m < 2520 then '1 day' when m < 43200 then cast(floor(m / 1440e0 + 0.5) as bigint) || ' days'
 else 'about ' || cast(floor(m / 43200e0 + 0.5) as bigint) || ' month' || case when floor(m / 43200e0 + 0.5) = 1 then '' else 's' end end || ' ago' ago
 from (select event_id, cast(floor((epoch(timestamp '2024-01-31') - floor(epoch(ts))) / 60e0 + 0.5) as bigint) m from events)""")
def times_ago(d):
    return _events(d).select(_id(), text.time_ago(F.col("ts"), F.expr("timestamp_ntz'2024-01-31 00:00:00'")).alias("ago"))


HEADS = ("52494646", "1A45DFA3", "494433FF", "FFFB9064", "FFE00000", "4F676753", "00000000")
KINDS = ("wav", "webm", "mp3", "mp3", "unknown", "ogg", "mp4")


@query(f"""select event_id id, kind, kind not in ('wav', 'mp3') convert from (select event_id, case when event_id % 5 = 4 then 'unknown' else {_pick_sql(*KINDS)} end kind from events)""")
def audio_formats(d):
    head = _pick(*HEADS)
    blob = F.unhex(F.concat(head, F.when(_number() % 7 == 6, "6674797000112233").otherwise("0011223344556677")))
    short = F.when(_number() % 5 == 4, F.substring(blob, 1, 11)).otherwise(blob)  # eleven bytes are too few
    return _events(d).select(_id(), media.audio_format(short).alias("kind"), media.needs_conversion(short).alias("convert"))


@query("select event_id id, 2 n, ((event_id % 200) - 100) / 32768e0 first_sample, -1e0 last_sample from events")
def pcm_samples(d):
    k = _number() % 200 - 100
    low = F.hex(F.pmod(k, F.lit(65536)))
    wide = F.lpad(low, 4, "0")
    little = F.concat(F.substring(wide, 3, 2), F.substring(wide, 1, 2), F.lit("0080"))
    rows = _events(d).select(_id(), F.base64(F.unhex(little)).alias("clip"))
    out = rows.select("id", media.pcm16(F.col("clip")).alias("s"))
    return out.select("id", F.size("s").alias("n"), F.col("s")[0].cast("double").alias("first_sample"), F.col("s")[1].cast("double").alias("last_sample"))


@query("select event_id id, case event_id % 3 when 0 then 'audio/webm' when 1 then 'audio/mp4' end kind from events")
def recorder_types(d):
    k = _number() % 3
    supported = F.when(k == 0, F.array(F.lit("audio/mp4"), F.lit("audio/webm"))).when(k == 1, F.array(F.lit("x"), F.lit("audio/mp4"))).otherwise(F.array(F.lit("x")))
    return _events(d).select(_id(), media.first_supported(supported).alias("kind"))


@query("select event_id id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then 'one' else 'one|two' end lines from events")
def error_lists(d):
    k = _number() % 3
    raw = F.array(F.lit(""), F.lit(None).cast("string"), F.when(k > 0, "one"), F.when(k == 2, "two"))
    return _events(d).select(_id(), F.array_join(text.error_lines(raw), "|").alias("lines"))


@query("""select event_id id, strftime(ts, '%b') as month, format('{:,}', event_id * 1001) n, cast(event_id % 11 as varchar) || '.0 / 10' score, 2 - cast(event_id % 2 = 0 as int)  entries from events""")
def chart_values(d):
    payload = F.array(F.struct(F.lit("line").alias("type"), F.lit("a").alias("name")), F.struct(F.when(_number() % 2 == 0, "none").otherwise("bar").alias("type"), F.lit("b").alias("name")))
    return _events(d).select(_id(), text.month_label(F.col("ts")).alias("month"), text.grouped_number(_number() * 1001).alias("n"), text.score_label((_number() % 11).cast("double")).alias("score"), F.size(text.shown_entries(payload)).alias("entries"))


@query(f"select id, title ilike '%a_b%' or abstract ilike '%A%' hit, timestamp '{AS_OF}' - created_at > interval 14 days old from papers")
def predicates(d):
    hit = text.contains_any_case(F.col("title"), "a_b") | text.contains_any_case(F.col("abstract"), "\\A")
    return d.papers().select("id", hit.alias("hit"), (F.expr(f"timestamp_ntz'{AS_OF}'") - F.col("created_at") > F.expr("interval 14 days")).alias("old"))
