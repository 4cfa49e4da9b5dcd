"""Web-page text jobs: tracker tickets, package source links, package ranking.

Pages are parsed with regular expressions over the HTML text, row-local;
nothing leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixfold.functions.text import PY_WS, col_, strip

# HTML entities decoded in extracted text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&amp;", "&"))

# Link words that mark a source-code link.
SOURCE_WORDS = ("source", "code", "homepage")


def html_text(c) -> Column:
    """Text of an HTML fragment: tags dropped, common entities decoded."""
    t = F.regexp_replace(col_(c), r"<[^>]*>", "")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def extract_ticket(html) -> list[Column]:
    """P5: ticket title and body.  Title: the first ``<h1>`` text with whitespace
    runs collapsed to one space; body: the article text after the title with
    newline runs collapsed, four spaces → tab, two or more spaces → one."""
    h = col_(html)
    title = strip(F.regexp_replace(html_text(F.regexp_extract(h, r"(?s)<h1[^>]*>(.*?)</h1>", 1)),
                                   PY_WS + "+", " "))
    body = html_text(F.regexp_extract(h, r"(?s)<article>.*?</h1>(.*?)</article>", 1))
    body = F.regexp_replace(body, r"\n+", "\n")
    body = F.regexp_replace(body, "    ", "\t")
    body = strip(F.regexp_replace(body, "[ ]{2,}", " "))
    return [title.alias("title"), body.alias("body")]


def tracker_tickets(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """P5 on the tracker's own markup: (key, title, body) of the ``div`` with id ``ticket`` —
    the title of its ``h1.searchable``, the body of its first ``div.description``,
    white space treated as in ``extract_ticket``; NULL where a part is missing.

    Boxes nest, so a page is cut at its ``div`` tags and a running sum over the
    pieces counts the depth; a box ends where the depth falls below its own.  The
    pieces of a page meet in one window; comments are dropped first."""
    opens, closes = r"(?i)^<div\b", r"(?i)^</div\s*>"
    attr = lambda name, value: (
        rf"""(?is)^<div\b[^>]*\s{name}\s*=\s*(?:"(?:[^"]*\s)?{value}(?:\s[^"]*)?"|'(?:[^']*\s)?{value}(?:\s[^']*)?'|{value}[\s>])""")
    page = Window.partitionBy(key)
    d = pages.select(key, F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?i)(?=<div\b|</div\s*>)", -1).alias("_p"))
    d = d.select(key, F.posexplode_outer("_p").alias("pos", "piece"))
    piece = F.col("piece")
    turn = F.when(piece.rlike(opens), 1).when(piece.rlike(closes), -1).otherwise(0)
    d = d.withColumn("depth", F.sum(turn).over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.lit(True)
    for box, wanted in (("ticket", attr("id", "ticket")), ("description", attr("class", "description"))):
        d = d.withColumn(f"_{box}", F.min(F.when(inside & piece.rlike(wanted), F.struct("pos", "depth"))).over(page))
        end = F.min(F.when((F.col("pos") > F.col(f"_{box}.pos")) & (F.col("depth") < F.col(f"_{box}.depth")), F.col("pos"))).over(page)
        d = d.withColumn(f"_{box}_end", end)
        inside = (F.col("pos") >= F.col(f"_{box}.pos")) & (F.col(f"_{box}_end").isNull() | (F.col("pos") < F.col(f"_{box}_end")))
        d = d.withColumn(f"_in_{box}", F.coalesce(inside, F.lit(False)))
        inside = F.col(f"_in_{box}")
    text = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col(flag), F.struct("pos", "piece")))), lambda x: x["piece"]), "")
    g = d.groupBy(key).agg(text("_in_ticket").alias("ticket"), text("_in_description").alias("description"),
                           F.bool_or("_in_description").alias("has_body"))
    head = r"""(?is)<h1\b[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?searchable(?:\s[^"']*)?["'][^>]*>(.*?)</h1>"""
    title = strip(F.regexp_replace(html_text(F.regexp_extract("ticket", head, 1)), PY_WS + "+", " "))
    body = F.regexp_replace(F.regexp_replace(html_text("description"), r"\n+", "\n"), "    ", "\t")
    return g.select(key, F.when(F.col("ticket").rlike(head), title).alias("title"),
                    F.when(F.col("has_body"), strip(F.regexp_replace(body, "[ ]{2,}", " "))).alias("body"))


ANCHOR = r'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def pick_repo_link(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The first anchor whose text names a source/code/homepage link and
    whose href points at github; owner and name are the href's last two path
    parts.  (key, github, owner, name) — NULLs when no anchor qualifies."""
    a = pages.select(key, F.posexplode(F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 1).alias("href"),
        F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 2).alias("text"))).alias("pos", "a"))
    txt = F.lower(html_text(F.col("a.text")))
    word = F.lit(False)
    for w in SOURCE_WORDS:
        word = word | txt.contains(w)
    ok = a.where(word & F.lower(F.col("a.href")).contains("github"))
    first = ok.groupBy(key).agg(F.min_by(F.col("a.href"), F.col("pos")).alias("github"))
    parts = F.split(F.col("github"), "/", -1)
    return pages.select(key).join(first, key, "left").select(
        key, "github", F.try_element_at(parts, F.lit(-2)).alias("owner"),
        F.try_element_at(parts, F.lit(-1)).alias("name"))


def top_packages(listing: DataFrame, seen: DataFrame, n: int, order: str = "page_id",
                 url: str = "url") -> DataFrame:
    """The first n packages of the listing with their rank (0-based list
    position), skipping URLs already seen.  The rank is kept from the listing,
    so skipped packages leave gaps exactly as a resumed crawl does."""
    w = Window.orderBy(order)
    ranked = listing.orderBy(order).limit(n).withColumn("rank", F.row_number().over(w) - 1)
    return ranked.join(seen.select(url).distinct(), url, "left_anti")
