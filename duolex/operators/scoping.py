"""Parts of texts by where they lie: sections under headings, and the paragraphs of a shared document that locators name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import field
from .corpus import named_groups

# Offices that a guide's section may name, the first one in this order counts.
OFFICES = ("City Attorney", "LAUSD School Board", "School Board", "Board of Supervisors", "State Assembly", "State Senate", "U.S. Congress", "City Council", "Mayor")
# Fixed value: a district's name.
DISTRICT = r"(?i)\b(?:District|AD|SD|NY|CD)\s*-?\s*\d+[A-Za-z]?\b"
#: Characters after an entry in which its district is looked for.
NEAR = 150


def sections(df: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """id_col, section (from 0), heading, body: a text cut before each match of the heading pattern, which the body begins with. What comes before the first one is section 0 with an empty heading; a null text has no sections."""
    cut = F.posexplode(F.split(F.col(text_col), f"(?={heading})"))
    rows = df.filter(F.col(text_col).isNotNull()).select(id_col, cut.alias("section", "body"))
    return rows.select(id_col, "section", F.regexp_extract("body", f"^(?:{heading})", 0).alias("heading"), "body")


def entries_under(df: DataFrame, id_col: str, text_col: str, heading: str, entry: str) -> DataFrame:
    """id_col, section, heading, place and the entry pattern's named groups: each match with the nearest heading before it.

    Sections are cut first, so the heading is an entry's section's; no rows are
    ordered or joined, whatever a text's length. A match doesn't go over a heading.
    """
    found = sections(df, id_col, text_col, heading).select(id_col, "section", "heading", F.posexplode(named_groups(F.col("body"), entry)).alias("place", "e"))
    return found.select(id_col, "section", "heading", "place", "e.*")


def following(text: Column, pattern: str, wanted: str, chars: int = NEAR) -> Column:
    """The first match of what is wanted among the characters after the pattern's first match; empty if there is none."""
    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups
    return F.regexp_extract(F.regexp_extract(text, rf"(?s){pattern}(.{{0,{chars}}})", groups + 1), wanted, 0)


def office_hint(text: Column, district: Column) -> Column:
    """The first of OFFICES that the text has, with the district; the district alone if there is none."""
    found = F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(x.lower())), F.lit("School Board" if x.endswith("School Board") else x)) for x in OFFICES))
    return F.when(found.isNull(), district).otherwise(F.trim(F.concat_ws(" ", found, district)))


def guide_entries(df: DataFrame, id_col: str, text_col: str, heading: str, entry: str) -> DataFrame:
    """id_col, section, name, district, office: of each section with a heading the first match of the entry pattern (its group `name`), the district near after it and the section's office."""
    body = F.col("body")
    rows = sections(df, id_col, text_col, heading).filter("heading <> ''")
    rows = rows.select(id_col, "section", "body", F.get(named_groups(body, entry), F.lit(0))["name"].alias("name"), following(body, entry, DISTRICT).alias("district")).filter("name is not null")
    return rows.select(id_col, "section", "name", "district", office_hint(body, F.col("district")).alias("office"))


TIME = r"(\d{2}):(\d{2}):(\d{2})(?:,(\d{1,3}))?"
KINDS = {
    "time": rf"(?i)^time\s+({TIME})\s*(?:-->|-|to)\s*({TIME})$",
    "range": r"(?i)^range:\s*(.+?)\s*=>\s*(.+)$",
    "from": r"(?i)^from:\s*(.+)$",
    "paragraph": r"(?i)\bparagraph\s+(\d+)\b",
    "page": r"(?i)\b(?:pdf\s+)?pages?\s+(\d+)(?:\s*-\s*(\d+))?\b",
}


def _time(text: Column) -> Column:
    """Milliseconds of hh:mm:ss,mmm; NULL if it isn't one."""
    part = lambda k: F.regexp_extract(text, f"^{TIME}$", k)
    number = lambda k: part(k).try_cast("long")
    return number(1) * 3_600_000 + number(2) * 60_000 + number(3) * 1000 + F.rpad(F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")), 3, "0").cast("long")


def scoped(jobs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """job_id, document_id, status, n_paragraphs, text: the paragraphs of a shared document that a job's locators name, joined by empty lines.

    jobs: job_id, document_id, locators (a pipe list). paragraphs: document_id,
    index (from 1), text, locator (a caption's `time a-b`, else anything).
    Locators: `time a - b` (captions that overlap it), `range: a => b` (from the
    one paragraph with a to before the one with b), `from: a` (from the one with
    a to the end), `paragraph n`, `page n-m` (paragraphs with a page's mark), or
    a piece of text that exactly one paragraph has. If a locator names nothing
    or isn't unique, or there is none, the job is `shared_document_unscoped`
    with an empty text. Case doesn't count. A locator is compared with the
    paragraphs of its own document.
    """
    cells = F.filter(F.transform(F.split(F.coalesce("locators", F.lit("")), r" \| "), F.trim), lambda x: x != "")
    asked = jobs.select("job_id", "document_id", F.explode(F.array_distinct(cells)).alias("l"))
    kind = F.coalesce(*(F.when(F.col("l").rlike(p), F.lit(k)) for k, p in KINDS.items()), F.lit("text"))
    group = lambda k, n: F.regexp_extract("l", KINDS[k], n)
    asked = asked.withColumn("kind", kind).withColumns({
        "a": F.lower(F.when(F.col("kind") == "range", group("range", 1)).when(F.col("kind") == "from", group("from", 1)).when(F.col("kind") == "text", F.col("l"))),
        "b": F.lower(F.when(F.col("kind") == "range", group("range", 2))),
        "lo": F.when(F.col("kind") == "time", _time(group("time", 1))).when(F.col("kind") == "paragraph", group("paragraph", 1).try_cast("long")).when(F.col("kind") == "page", group("page", 1).try_cast("long")),
        "hi": F.when(F.col("kind") == "time", _time(group("time", 6))).when(F.col("kind") == "page", F.coalesce(group("page", 2).try_cast("long"), group("page", 1).try_cast("long"))),
    })
    told = F.regexp_extract("locator", rf"(?i)^time\s+({TIME})-({TIME})$", 1), F.regexp_extract("locator", rf"(?i)^time\s+({TIME})-({TIME})$", 6)
    own = paragraphs.select("document_id", F.col("index").cast("long").alias("index"), "text", F.lower("text").alias("low"), _time(told[0]).alias("t0"), _time(told[1]).alias("t1"))
    page = F.exists(F.sequence("lo", F.greatest("lo", "hi")), lambda n: F.contains(F.col("low"), F.concat(F.lit("[pdf page "), n.cast("string"), F.lit("]"))))
    hit = (
        F.when(F.col("kind") == "time", (F.col("t1") >= F.col("lo")) & (F.col("t0") <= F.col("hi")))
        .when(F.col("kind") == "page", (F.col("hi") >= F.col("lo")) & page)
        .when(F.col("kind") == "paragraph", F.col("index") == F.col("lo"))
        .otherwise(F.contains("low", "a"))
    )
    met = asked.join(own, "document_id").withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("end", F.coalesce(F.contains("low", "b"), F.lit(False)))
    w = Window.partitionBy("job_id", "document_id", "l")  # a document's paragraphs
    n, first = F.count_if("hit").over(w), F.min(F.when(F.col("hit"), F.col("index"))).over(w)
    n_end, last = F.count_if("end").over(w), F.min(F.when(F.col("end"), F.col("index"))).over(w)
    met = met.withColumns({"n": n, "first": first, "n_end": n_end, "last": last})
    span = (F.col("n") == 1) & (F.col("index") >= F.col("first"))
    chosen = (
        F.when(F.col("kind").isin("time", "page", "paragraph"), F.col("hit"))
        .when(F.col("kind") == "from", span)
        .when(F.col("kind") == "range", span & (F.col("n_end") == 1) & (F.col("index") < F.col("last")))
        .otherwise((F.col("n") == 1) & F.col("hit"))
    )
    by_locator = met.withColumn("chosen", chosen).groupBy("job_id", "document_id", "l", "kind").agg(F.max("chosen").alias("good"), F.collect_list(F.when(F.col("chosen"), F.struct("index", "text"))).alias("rows"))
    # a paragraph's number that isn't there names nothing, but isn't an error by itself: what the others name stays
    good = F.col("good") | (F.col("kind") == "paragraph")
    found = by_locator.groupBy("job_id", "document_id").agg(F.min(good).alias("good"), F.count("*").alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("rows"))
    every = jobs.select("job_id", "document_id", F.size(F.array_distinct(cells)).alias("asked")).join(found, ["job_id", "document_id"], "left")
    ok = F.coalesce(F.col("good") & (F.col("found") == F.col("asked")) & (F.size("rows") > 0), F.lit(False))
    text = F.when(ok, F.array_join(F.transform("rows", lambda r: r.text), "\n\n")).otherwise("")
    return every.select("job_id", "document_id", F.when(ok, "extracted").otherwise("shared_document_unscoped").alias("status"), F.when(ok, F.size("rows")).otherwise(0).alias("n_paragraphs"), text.alias("text"))
