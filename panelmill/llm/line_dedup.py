"""Boilerplate lines of a site: lines on so large a share of the site's pages that they are not content.

Counting: every page sends the distinct hashes of its own lines with its host and a hash of the whole page. Pages of the
same text count once, or a page copied often enough would lose all it says; so the first grouped count makes page, host
and line distinct, with map-side combine, and the second one counts pages per host and line. A host's page total is
counted the same way. A line is boilerplate where its pages divided by the host's pages exceed the ratio. A page has on
average some number of lines, so a host has at most that number divided by the ratio of boilerplate lines: the list per
host does not grow with its pages. The key of the large shuffle holds the page, so no host or line is a hot spot.

Removal: each page meets the list of its host in one join and filters its own lines in place; texts are not taken
apart into rows. The table of lists is settled first, so Spark knows its size and broadcasts it only where it is small;
otherwise it is a join by host whose skewed side adaptive execution splits. All of it is built-in functions.

Passages, if asked for: a line of many words that several different pages of a host share is repeated whatever the size
of the host, and only the first of these pages keeps it. Their number does grow with a host, so they are not lists per
host: each page meets its own lines alone, by host and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle, text_of

RATIO = 0.1
LEAST_PAGES = 3
PASSAGE_WORDS = 50


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _line(line: Column) -> Column:
    """What makes two lines the same: the line without the spaces, tabs and returns around it."""
    return F.btrim(line, F.lit(" \t\r"))


def _known(line: Column) -> Column:
    return F.xxhash64(_line(line))


def boilerplate(pages: DataFrame, host: Column, text: Column, lines: Column, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """`host, line, pages, host_pages`: the hashes of lines on more than `ratio` of the different pages of a host, and on at
    least `least` of them; the size of a host does not matter otherwise.

    Lines without any character but white space are left out. Pages whose host or text is null have no site.
    """
    rows = pages.select(host.alias("host"), text.alias("text"), lines.alias("lines")).where("host IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("host", F.xxhash64("text").alias("page"), "lines")
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: _line(x) != ""), _known))
    once = rows.select("host", "page", F.explode(own).alias("line")).distinct()
    counts = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return (counts.where(F.col("pages") >= least).join(totals, "host")
            .where(F.col("pages") > F.col("host_pages") * F.lit(ratio)))


def passages(pages: DataFrame, host: Column, text: Column, lines: Column, order: Column, words: int = PASSAGE_WORDS) -> DataFrame:
    """`host, page, again`: the hashes of lines of at least `words` words that an earlier page of the host has, per page.

    The first page is the one with the least `order`, null last, then the least hash. Pages of the same text are one.
    """
    rows = pages.select(host.alias("host"), text.alias("text"), lines.alias("lines"), order.alias("at")).where("host IS NOT NULL AND text IS NOT NULL")

    def long(line: Column) -> Column:  # the length alone rules out most lines
        return (F.length(line) >= 2 * words - 1) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= words)

    own = F.array_distinct(F.transform(F.filter("lines", long), _known))
    own = rows.select("host", F.xxhash64("text").alias("page"), "at", F.explode(own).alias("line"))
    # Read twice below; three hashes a line.
    once = settle(own.groupBy("host", "page", "line").agg(F.min("at").alias("at")), "passages")
    first = F.min_by("page", F.struct(F.col("at").isNull(), "at", "page")).alias("first")
    shared = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"), first).where("pages > 1").drop("pages")
    again = once.join(shared, ["host", "line"]).where("page <> first")
    return again.groupBy("host", "page").agg(F.collect_list("line").alias("again"))


def drop_boilerplate(pages: DataFrame, host: Column, text_column: str = "text", split: str = "\n", ratio: float = RATIO,
                     least: int = LEAST_PAGES, dropped: str | None = None, passage_words: int | None = None,
                     order: Column | None = None) -> DataFrame:
    """`pages` with its text column without boilerplate lines, all other columns as they were.

    Lines are what stands between `split` (plain text); those that stay keep their order and bytes, joined as before. A text
    that is null stays null and has no lines, an empty one stays empty; a page all of whose lines go has an empty text. Rows
    that repeat count as one page and lose the same lines. `dropped` names a column for how many lines went. Columns of any name may
    be present: working columns live in frames of their own. With `passage_words`, lines of so many words go from all pages of a host
    but the first by `order`, in hosts of any size.
    """
    names = pages.columns
    at = names.index(text_column)
    shown = pages.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], host.alias("_host"),
                         (F.lit(None).cast("long") if order is None else order).alias("_order"))
    lines = F.split(f"_c{at}", f"\\Q{split}\\E", -1)
    found = boilerplate(shown, F.col("_host"), F.col(f"_c{at}"), lines, ratio, least)
    lists = settle(found.groupBy("host").agg(F.collect_list("line").alias("_list")), "boilerplate")
    joined = shown.join(lists.withColumnRenamed("host", "_host"), "_host", "left")
    gone = F.col("_list")
    if passage_words is not None:
        again = passages(shown, F.col("_host"), F.col(f"_c{at}"), lines, F.col("_order"), passage_words)
        again = settle(again.toDF("_host", "_page", "_again"), "again")
        joined = joined.withColumn("_page", F.xxhash64(f"_c{at}")).join(again, ["_host", "_page"], "left")
        none = F.array().cast("array<bigint>")
        gone = F.when(gone.isNotNull() | F.col("_again").isNotNull(), F.concat(F.coalesce(gone, none), F.coalesce("_again", none)))
    kept = F.filter(lines, lambda x: ~F.array_contains(gone, _known(x)))
    hit = gone.isNotNull() & F.col(f"_c{at}").isNotNull()
    out = [F.when(hit, F.array_join(kept, split)).otherwise(F.col(f"_c{at}")).alias(names[at]) if i == at
           else F.col(f"_c{i}").alias(n) for i, n in enumerate(names)]
    if dropped:
        out.append(F.when(hit, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias(dropped))
    return joined.select(*out)


def html_lines(html: Column) -> Column:
    """The text of raw HTML, a line per block: scripts, styles and comments go, block tags end a line, other tags go."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|nav|article|header|footer|title|head|body|html)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    # Blank lines, from the first blank of a run on: no group repeats, so a run of any length takes no stack and one pass.
    return F.regexp_replace(text, r"(?<![ \t\r\n])[ \t\r\n]*\n[ \t\r]*", "\n")
