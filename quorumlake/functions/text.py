"""Names, tags, references, patterns and headers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug_name(slug: Column) -> Column:
    """Words of a slug, each with its first letter in upper case and the rest as it is."""
    return F.array_join(F.transform(F.split(slug, r"[-_\s]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def fallback_name(id_: Column) -> Column:
    return F.concat(F.lit("Researcher "), F.right(id_, F.lit(6)))


def display_name(first: Column, last: Column, username: Column, email: Column, id_: Column) -> Column:
    def told(c: Column) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    return F.coalesce(told(F.concat_ws(" ", first, last)), told(username), told(F.split(email, "@")[0]), fallback_name(id_))


def contains_any_case(text: Column, q: str) -> Column:
    """text ILIKE %q%; % and _ of q stay wild, a backslash only quotes what follows it."""
    out, at = "", 0
    while at < len(q):
        if q[at] == "\\":
            at += 1
            out += ("\\" + q[at]) if at < len(q) and q[at] in "%_\\" else q[at : at + 1]
        else:
            out += q[at]
        at += 1
    return text.ilike(f"%{out}%")


def clean_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def remove_tag(tags: Column, tag: Column) -> Column:
    """The tags but this one, wherever it is."""
    return F.filter(tags, lambda t: t != tag)


def clean_references(refs: Column) -> Column:
    """References with a citation, both parts trimmed, a blank URL null."""
    kept = F.filter(refs, lambda r: F.trim(r["citation"]) != "")
    return F.transform(kept, lambda r: F.struct(F.trim(r["citation"]).alias("citation"), F.when(F.trim(r["url"]) != "", F.trim(r["url"])).alias("url")))


def reference_lines(refs: Column) -> Column:
    """[1] citation (url), a line each."""
    lines = F.transform(refs, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["citation"], F.when(r["url"].isNotNull(), F.concat(F.lit(" ("), r["url"], F.lit(")"))).otherwise("")))
    return F.when(F.size(refs) > 0, F.array_join(lines, "\n")).otherwise("(none provided)")


def stage_label(stage: Column) -> Column:
    return F.regexp_replace(stage, "^([^_]*)_", "$1 ")


def is_rate_limit(message: Column) -> Column:
    low = F.lower(message)
    return F.coalesce(message.contains("429") | message.contains("RATELIMIT_EXCEEDED") | low.contains("quota") | low.contains("rate limit"), F.lit(False))


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.split(header, ";")[0]))


def response_kind(header: Column) -> Column:
    m = media_type(header)
    json = (m == "application/json") | m.endswith("+json")
    text = m.startswith("text/") | m.isin("application/xml", "application/x-www-form-urlencoded") | m.endswith("+xml")
    return F.when(m.isNull() | json, "json").when(text, "text").otherwise("blob")


def looks_like_json(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "").rlike(r"^\s*[\{\[]")


def truncated(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def error_message(prefix: Column, title: Column, detail: Column, message: Column, description: Column, error: Column) -> Column:
    other = F.coalesce(message, description, error)
    return F.coalesce(
        F.concat(prefix, F.lit(": "), title, F.lit(" — "), detail), F.concat(prefix, F.lit(": "), F.coalesce(detail, other, title)), prefix
    )


def joined_url(base: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), F.concat(F.regexp_replace(base, "/+$", ""), path)).otherwise(path)


def first_host(header: Column, fallback: Column) -> Column:
    host = F.trim(F.split(header, ",")[0])
    return F.coalesce(F.when(host != "", host), fallback)


def data_url_payload(url: Column) -> Column:
    """What follows the first comma; null without one."""
    at = F.instr(url, ",")
    return F.when(at > 0, F.substr(url, at + 1))


def without_query(url: Column) -> Column:
    return F.split(url, r"\?")[0]


def to_number(param: Column) -> Column:
    """A parameter as a number: blank is 0, anything else that is none is null."""
    return F.when(F.trim(param) == "", F.lit(0.0)).otherwise(F.trim(param).try_cast("double"))


def time_ago(then: Column, now: Column) -> Column:
    """How long ago (or ahead) in words; timestamps at either side."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))
    minutes = F.floor(F.abs(seconds) / 60.0 + 0.5)
    months = F.floor(F.abs(F.months_between(now, then, roundOff=False))).cast("long")
    years, rest = F.floor(months / 12).cast("long"), months % 12

    def told(before: str, n: Column, unit: str) -> Column:
        n = n.cast("long")
        return F.concat(F.lit(before), n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    def rounded(unit_minutes: int) -> Column:
        return F.floor(minutes / unit_minutes + 0.5)

    words = (
        F.when(minutes < 1, "less than a minute")
        .when(minutes < 45, told("", minutes, "minute"))
        .when(minutes < 90, "about 1 hour")
        .when(minutes < 1440, told("about ", rounded(60), "hour"))
        .when(minutes < 2520, "1 day")
        .when(minutes < 43200, told("", rounded(1440), "day"))
        .when(minutes < 86400, told("about ", rounded(43200), "month"))
        .when(months < 12, told("", rounded(43200), "month"))
        .when(rest < 3, told("about ", years, "year"))
        .when(rest < 9, told("over ", years, "year"))
        .otherwise(told("almost ", years + 1, "year"))
    )
    return F.when(seconds < 0, F.concat(F.lit("in "), words)).otherwise(F.concat(words, F.lit(" ago")))


def initial(name: Column) -> Column:
    """The first letter in upper case; null without one."""
    return F.when(F.length(name) > 0, F.upper(F.substring(name, 1, 1)))


def submission_complete(title: Column, abstract: Column, body: Column, fields: Column, summary: Column | None = None) -> Column:
    """Whether all parts are there and at least one tag; a revision's summary too, where one is given."""
    parts = [title, abstract, body, *([] if summary is None else [summary])]
    full = F.size(fields) > 0
    for c in parts:
        full &= F.trim(c) != ""
    return F.coalesce(full, F.lit(False))


def one_decimal(x: Column) -> Column:
    """A number not below zero with one decimal, the nearest to its binary value (exactly so below 128), halves up; null stays."""
    units = F.floor(x * float(1 << 56)).cast("decimal(20,0)")  # a power of two: nothing is rounded here
    exact = F.call_function("div", units * F.lit(20).cast("decimal(2,0)") + F.lit(1 << 56).cast("decimal(18,0)"), F.lit(1 << 57).cast("decimal(18,0)"))
    n = F.when(x < 128, exact).otherwise(F.floor(x * 10.0 + 0.5))
    return F.concat(F.floor(n / 10.0).cast("string"), F.lit("."), (n % 10).cast("string"))


def url_with_query(path: Column, params: dict[str, Column], nullable: tuple[str, ...] = ()) -> Column:
    """The path and its query in the order of params; null parameters are left out, but for nullable ones, which are sent as null."""

    def sent(name: str, c: Column) -> Column:
        pair = F.concat(F.lit(f"{name}="), F.url_encode(c.cast("string")))
        return F.coalesce(pair, F.lit(f"{name}=null")) if name in nullable else pair

    given = F.array_compact(F.array(*[sent(name, c) for name, c in params.items()])) if params else F.array().cast("array<string>")
    return F.when(F.size(given) > 0, F.concat(path, F.lit("?"), F.array_join(given, "&"))).otherwise(path)


def labelled(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key; the key itself where it has none."""
    return F.coalesce(*[F.when(key == k, v) for k, v in labels.items()], key)


def is_author(author_id: Column, user_id: Column) -> Column:
    """Nobody signed in (null) is no author."""
    return F.coalesce(author_id == user_id, F.lit(False))


def error_lines(messages: Column) -> Column:
    """The messages that say something; null where there is none."""
    kept = F.filter(messages, lambda m: m.isNotNull() & (m != ""))
    return F.when(F.size(kept) > 0, kept)


#: Fixed value: what stands where a profile says nothing of itself.
BIO = "Citizen Scientist"


def bio_or_default(bio: Column) -> Column:
    return F.coalesce(F.when(bio != "", bio), F.lit(BIO))


def month_label(at: Column) -> Column:
    """The month's short English name."""
    names = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
    return F.get(F.array(*map(F.lit, names)), F.month(at) - 1)


def grouped_number(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def score_label(score: Column) -> Column:
    """A score with its scale, which is ten."""
    return F.concat(one_decimal(score), F.lit(" / 10"))


def shown_entries(entries: Column) -> Column:
    """The entries of a chart but those of type none."""
    return F.filter(entries, lambda e: F.coalesce(e["type"] != "none", F.lit(True)))
