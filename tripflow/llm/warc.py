"""WARC records, and revisits of the not-modified kind resolved to the response they stand for.

A record is the text of its WARC header block, and of the HTTP message where it holds one. A `revisit` record of the
server-not-modified profile (HTTP 304) has headers but no body. It stands for the latest full response (status 200)
of the same canonical url that was captured no later; the two must agree in a validator: ETags by weak comparison,
or, where the revisit has none, Last-Modified. The outcome is one of

- resolved: they agree; unvalidated: the revisit carries no validator, and is resolved all the same;
- mismatch: they differ; missing: no earlier response; neither is resolved.

A resolved revisit gets the response's headers, updated by those of the 304 that may update a stored response: all but
those that describe the body or the connection.

The as-of join goes in two steps so that one url may hold any share of the rows. Records are cut into days; within a
url's day a window carries the last response forward, and only the last response of each day goes on to a window over
the url's days. Bodies never take part: records are joined by their ids afterwards.

Records without a parseable date, without a target uri or without an id can't be placed: as revisits they are missing,
as responses they are never found. Of responses with the same url and date the greatest id is the latest; of responses
that share an id too, which no archive should hold, the one of the latest date, then of the least body and headers.
Revisits that share an id are placed each by its own url and date. Repeated records come back repeated. Pages without an
id or url give `crawl` no record. An empty table gives an empty result; columns other than those named are not looked at.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import written

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
# Fields of a 304 that don't update a stored response: about the body, or about the connection.
FIXED_FIELDS = (
    "connection content-encoding content-length content-location content-range content-type keep-alive "
    "proxy-authenticate proxy-authentication-info proxy-authorization te trailer transfer-encoding upgrade"
).split()
DATE = "yyyy-MM-dd'T'HH:mm:ssX"


def _fields(lines: Column) -> Column:
    """A map of the lower-cased field names to their values; of a name given twice the last counts."""
    lines = F.filter(lines, lambda x: x.contains(":"))
    names = F.transform(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    values = F.transform(lines, lambda x: F.trim(F.substr(x, F.instr(x, ":") + F.lit(1))))
    backwards = F.arrays_zip(F.reverse(names).alias("name"), F.reverse(values).alias("value"))
    last = F.filter(backwards, lambda p, i: F.array_position(F.transform(F.slice(backwards, 1, i), lambda q: q["name"]), p["name"]) == 0)
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(unique, F.map_from_arrays(names, values)).otherwise(F.map_from_entries(last))


def parsed(records: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The columns that `resolved_revisits` needs, from WARC records as texts."""
    # Positions and cuts only, so that bodies are not decoded.
    rows = records.select(F.col(raw_col).cast("string").alias("r"))
    rows = rows.withColumn("e", F.when(F.instr("r", "\r\n\r\n") > 0, F.lit("\r\n\r\n")).otherwise(F.lit("\n\n")))
    rows = rows.withColumn("a", F.expr("substring_index(r, e, 1)"))
    rows = rows.withColumn("r", F.expr("substr(r, length(a) + length(e) + 1)"))
    rows = rows.withColumn("h", F.expr("substring_index(r, e, 1)"))
    rows = rows.select(
        _fields(F.split("a", "\r?\n")).alias("w"),
        F.split("h", "\r?\n").alias("h"),
        F.expr("if(instr(r, e) > 0, substr(r, length(h) + length(e) + 1), null)").alias("body"),
    )

    def field(name: str) -> Column:
        return F.try_element_at("w", F.lit(name))

    return rows.select(
        F.regexp_extract(field("warc-record-id"), "^<?(?:urn:uuid:)?([^>]*)>?$", 1).alias("record_id"),
        field("warc-type").alias("warc_type"),
        field("warc-target-uri").alias("uri"),
        F.try_to_timestamp(field("warc-date"), F.lit(DATE)).alias("date"),
        field("warc-profile").alias("profile"),
        F.expr("try_cast(nullif(regexp_extract(h[0], '^HTTP/[0-9.]+ ([0-9]{3})', 1), '') as int)").alias("status"),
        _fields(F.slice("h", F.lit(2), F.size("h"))).alias("headers"),
        "body",
    )


def canonical_url(url: Column) -> Column:
    """Scheme and www. taken off, host and path lower-cased, without default port, fragment or trailing slashes; the
    arguments sorted, those that only track visitors left out."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, "#.*$", "")), "^https?://(www[0-9]*[.])?", "")
    bare = F.regexp_replace(bare, "^([^/?]*):(80|443)(?=[/?]|$)", "$1")
    path = F.regexp_replace(F.substring_index(bare, "?", 1), "/+$", "")
    arguments = F.when(bare.contains("?"), F.split(F.regexp_replace(bare, r"^[^?]*\?", ""), "&")).otherwise(F.array())
    kept = F.array_sort(F.filter(arguments, lambda a: ~a.rlike("^(utm_[a-z]+|sid|sessionid|jsessionid|phpsessid)=") & (a != "")))
    return F.when(F.size(kept) > 0, F.concat_ws("?", path, F.array_join(kept, "&"))).otherwise(path)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^[Ww]/", "")


def resolved_revisits(records: DataFrame) -> DataFrame:
    """A row for each not-modified revisit.

    `record_id`, `uri`, `date`, `outcome`, `refers_to` and `refers_to_date` of the response found (also where it does
    not agree), `headers` merged and `body` of the response where it is resolved.
    """
    is_response = (F.col("warc_type") == "response") & (F.col("status") == 200)
    is_revisit = (F.col("warc_type") == "revisit") & (
        (F.col("profile") == NOT_MODIFIED) | (F.col("profile").isNull() & (F.col("status") == 304))
    )
    # Written down, so that records are parsed once and bodies are read only where they are handed on.
    records = written(
        records.select(
            "record_id",
            "uri",
            canonical_url(F.col("uri")).alias("url"),
            "date",
            F.when(is_response, "full").when(is_revisit, "revisit").alias("kind"),
            "headers",
            F.when(is_response, F.col("body")).alias("body"),
        ).where("kind is not null"),
        "warc-records",
    )
    placed = F.col("uri").isNotNull() & F.col("date").isNotNull() & F.col("record_id").isNotNull()
    narrow = records.where(placed).select(
        "record_id", "url", "date", F.to_date("date").alias("day"), (F.col("kind") == "full").alias("full")
    )
    # At equal dates responses come before the revisits they can answer.
    order = ["date", F.desc("full"), "record_id"]
    here = Window.partitionBy("url", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("full"), F.struct("date", "record_id"))
    days = narrow.where("full").groupBy("url", "day").agg(F.max(F.struct("date", "record_id")).alias("last"))
    days = days.unionByName(narrow.where("not full").select("url", "day").distinct().withColumn("last", F.lit(None)), True)
    days = days.groupBy("url", "day").agg(F.max("last").alias("last"))
    before = Window.partitionBy("url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("url", "day", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    found = (
        narrow.withColumn("same_day", F.last(mark, ignorenulls=True).over(here))
        .where("not full")
        .join(days, ["url", "day"])
        .select("record_id", "url", "date", F.coalesce("same_day", "earlier").alias("found"))
        .select("record_id", "url", "date", F.col("found.record_id").alias("refers_to"))
        .where("refers_to is not null")
        .dropDuplicates(["record_id", "url", "date"])
    )
    revisits = records.where("kind = 'revisit'").select("record_id", "uri", "url", "date", F.col("headers").alias("own"))
    # By content in the end, so that a lost task's second run chooses the same.
    sorted_headers = F.array_sort(F.map_entries("stored")).cast("string")
    copies = Window.partitionBy("refers_to").orderBy(F.desc("refers_to_date"), F.md5("_body"), sorted_headers)
    responses = (
        records.where(placed & (F.col("kind") == "full"))
        .select(
            F.col("record_id").alias("refers_to"),
            F.col("date").alias("refers_to_date"),
            F.col("headers").alias("stored"),
            F.col("body").alias("_body"),
        )
        .withColumn("_copy", F.row_number().over(copies))
        .where("_copy = 1")
    )
    # A revisit without a response joins by a key of its own, so that these don't meet in one task.
    alone = F.concat(F.lit("\x00"), F.coalesce("record_id", F.lit("")))
    both = (
        revisits.join(found, ["record_id", "url", "date"], "left")
        .withColumn("refers_to", F.coalesce("refers_to", alone))
        .join(responses, "refers_to", "left")
    )
    etag, modified = F.try_element_at("own", F.lit("etag")), F.try_element_at("own", F.lit("last-modified"))
    agree = F.when(
        etag.isNotNull(), F.coalesce(_weak(etag) == _weak(F.try_element_at("stored", F.lit("etag"))), F.lit(False))
    ).when(modified.isNotNull(), F.coalesce(modified == F.try_element_at("stored", F.lit("last-modified")), F.lit(False)))
    outcome = (
        F.when(F.col("refers_to_date").isNull(), "missing")
        .when(agree.isNull(), "unvalidated")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    permitted = F.map_filter(F.coalesce("own", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(FIXED_FIELDS))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    answered = F.col("outcome").isin("resolved", "unvalidated")
    return both.withColumn("outcome", outcome).select(
        "record_id",
        "uri",
        "date",
        "outcome",
        F.when(F.col("refers_to_date").isNotNull(), F.col("refers_to")).alias("refers_to"),
        "refers_to_date",
        F.when(answered, merged).alias("headers"),
        F.when(answered, F.col("_body")).alias("body"),
    )


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records as texts, made from the pages of a table: what `op10` reads.

    Each page is captured in full at a time that follows from its id, and revisited after 1 and 2 days and before it:
    with the same validators, with a weak ETag, without any (every 5th page), or with changed ones (every 7th).
    """
    page = F.col("page_id").cast("long")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.where("page_id is not null and url is not null").select(
        page.alias("n"), F.col("url").cast("string").alias("url"), html.alias("html"), F.md5(html).alias("tag")
    )
    start = F.lit(1_700_000_000) + F.pmod(F.col("n"), F.lit(1000)) * 3600
    modified = F.date_format(F.timestamp_seconds(start - 86400), "yyyy-MM-dd HH:mm:ss")

    def record(kind: int, seconds: Column, warc_type: str, head: list, fields: list, body: Column) -> Column:
        date = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        lines = [
            F.lit("WARC/1.1"),
            F.lit(f"WARC-Type: {warc_type}"),
            F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.col("n").cast("string"), F.lit(f"-{kind}>")),
            F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
            F.concat(F.lit("WARC-Date: "), date),
            *head,
        ]
        return F.concat_ws("\r\n", *lines, F.lit(""), *fields, F.lit(""), body)

    length = F.concat(F.lit("Content-Length: "), F.octet_length("html").cast("string"))
    full = record(
        0,
        start,
        "response",
        [],
        [
            F.lit("HTTP/1.1 200 OK"),
            F.lit("Content-Type: text/html; charset=utf-8"),
            length,
            F.concat(F.lit('ETag: "'), F.col("tag"), F.lit('"')),
            F.concat(F.lit("Last-Modified: "), modified),
            F.lit("Cache-Control: max-age=60"),
        ],
        F.col("html"),
    )

    def revisit(kind: int, seconds: Column, validator: Column) -> Column:
        return record(
            kind,
            seconds,
            "revisit",
            [F.lit(f"WARC-Profile: {NOT_MODIFIED}")],
            [
                F.lit("HTTP/1.1 304 Not Modified"),
                F.when(F.col("n") % 5 != 0, validator),
                F.lit("Cache-Control: max-age=3600"),
                F.lit("Content-Length: 0"),
                F.concat(F.lit("X-Visit: "), F.lit(str(kind))),
            ],
            F.lit(""),
        )

    changed = F.when(F.col("n") % 7 == 0, F.lit("x")).otherwise(F.lit(""))
    visits = [
        full,
        revisit(1, start + 86400, F.concat(F.lit('ETag: "'), F.col("tag"), changed, F.lit('"'))),
        revisit(2, start + 172800, F.concat(F.lit('ETag: W/"'), F.col("tag"), F.lit('"'))),
        revisit(3, start - 3600, F.concat(F.lit("Last-Modified: "), modified)),
        revisit(4, start + 7200, F.concat(F.lit("Last-Modified: "), modified, changed)),
    ]
    return rows.select(F.explode(F.array(*visits)).alias("raw"))


def revisits(pages: DataFrame) -> DataFrame:
    """`page_id`, `visit`, `url`, `visited_at`, `outcome`, `refers_to`, `refers_to_at`, `headers` as one text, `body_md5`."""
    found = resolved_revisits(parsed(crawl(pages)))
    time = "yyyy-MM-dd HH:mm:ss"
    headers = F.array_join(
        F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"
    )
    return found.select(
        F.substring_index("record_id", "-", 1).cast("long").alias("page_id"),
        F.substring_index("record_id", "-", -1).cast("int").alias("visit"),
        F.col("uri").alias("url"),
        F.date_format("date", time).alias("visited_at"),
        "outcome",
        "refers_to",
        F.date_format("refers_to_date", time).alias("refers_to_at"),
        headers.alias("headers"),
        F.md5("body").alias("body_md5"),
    )
