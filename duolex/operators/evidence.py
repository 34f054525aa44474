"""Open fields of a register from ranked evidence in documents' titles, addresses and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.predicates import field
from ..functions.text import squeezed

#: Characters of a text that are read for evidence.
READ = 800
# Kinds of sources that are official, and those that belong to a candidate.
OFFICIAL_TYPES = ("official_voter_guide", "filing")
OWNED_TYPES = ("candidate_campaign_site", "campaign_page", "campaign_website", "campaign_issue_page", "campaign_platform", "campaign_policy", "campaign_release", "campaign_statement", "official_campaign_page", "official_statement")
# Hosts of election authorities and their states.
HOST_STATES = {
    "www.nyccfb.info": "NY", "www.nycvotes.org": "NY", "nycvotes.org": "NY", "voter.votewa.gov": "WA", "cdn.kingcounty.gov": "WA", "vigarchive.sos.ca.gov": "CA",
    "vig.cdn.sos.ca.gov": "CA", "acvote.alamedacountyca.gov": "CA", "electionstats.state.ma.us": "MA", "www.oregonvotes.gov": "OR",
}
# What names a state; a text that names exactly one tells it.
STATES = (
    ("DC", r"\bDC\b|District of Columbia"),
    ("NY", r"\bNew York\b|\bNYC\b|\bQueens\b|\bBrooklyn\b|\bBronx\b|\bManhattan\b|\bStaten Island\b"),
    ("MD", r"\bMaryland\b|\bMontgomery County\b|\bBaltimore\b|\bPrince George'?s\b"),
    ("PA", r"\bPennsylvania\b|\bPhiladelphia\b|\bPittsburgh\b|\bPhilly\b"),
    ("NV", r"\bNevada\b|\bClark County\b|\bLas Vegas\b"),
    ("TX", r"\bTexas\b|Austin, TX|\bAustin\b|\bHouston\b|\bTravis County\b"),
    ("OH", r"\bOhio\b|\bCleveland\b"),
    ("MI", r"\bMichigan\b|\bDetroit\b|\bAnn Arbor\b|\bYpsilanti\b"),
    ("CA", r"\bCalifornia\b|\bAlameda County\b|\bOakland\b|\bLos Angeles\b|\bSan Francisco\b"),
    ("CO", r"\bColorado\b|\bDenver\b"),
    ("OR", r"\bOregon\b|\bPortland\b"),
    ("WI", r"\bWisconsin\b|\bMilwaukee\b"),
    ("VA", r"\bVirginia\b|\bFairfax\b|\bAlexandria\b"),
    ("DE", r"\bDelaware\b|\bWilmington\b"),
    ("LA", r"\bLouisiana\b|\bNew Orleans\b"),
    ("MT", r"\bMontana\b"),
    ("NM", r"\bNew Mexico\b"),
    ("VT", r"\bVermont\b"),
    ("KY", r"\bKentucky\b|\bLouisville\b"),
)
# Offices in the order in which they are looked for, what names them, and where their district's number is.
OFFICES = (
    ("Lieutenant Governor", r"\blieutenant governor\b", None),
    ("Governor", r"\bgovernor\b", None),
    ("District Attorney", r"\bdistrict attorney\b", None),
    ("State Delegate", r"\bstate delegate\b|\bhouse of delegates\b", r"district[\s\-]*(\d+)"),
    ("State Senate", r"\bstate senate\b|\bfor senate\b|\bnew york state senate\b|\bvirginia state senate\b", r"district[\s\-]*(\d+)"),
    ("State Assembly", r"\bstate assembly\b|\bmember-of-the-assembly\b|\bnew york state assembly\b|\bnys assembly\b|\bfor assembly\b", r"assembly(?: district)?[\s\-]*(\d+)"),
    ("State Representative", r"\bstate representative\b|\bfor state representative\b", r"district[\s\-]*(\d+)"),
    ("US House", r"\brepresentative-in-congress\b|\bfor congress\b|\bcongressional district\b|\bu\.s\. representative\b|\bu\.s\. rep\b|\brun for congress\b", r"(\d+)(?:st|nd|rd|th)\s+congressional district|congressional-district-(\d+)|district[\s\-]*(\d+)"),
    ("County Council", r"\bcounty council\b", r"district[\s\-]*(\d+)"),
    ("City Council", r"\bcity council\b|\bcouncilmember\b|\bmetro council\b", r"(district|ward)[\s\-]*(\d+)"),
    ("Mayor", r"\bmayor(?:al)?\b", None),
)
# How a mayor's city is named.
CITIES = (r"\b([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*) mayoral candidate\b", r"\bfor ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*) mayor\b", r"\b([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*) mayor\b")
# Parts of addresses that tell an office, and where its district's number is.
ADDRESSES = (
    ("congressional-district-", "US House", r"congressional-district-(\d+)"),
    ("assembly-district-", "State Assembly", r"assembly-district-(\d+)"),
    ("member-of-the-assembly", "State Assembly", r"geoareaabbr=(\d+)"),
    ("/mayor/", "Mayor", None),
    ("state-house/district-", "State Delegate", r"state-house/district-(\d+)"),
)
# Titles that tell an office by a district alone.
TITLES = (
    ("City Council", r"\bcouncil district[\s\-]*(\d+)", "District "),
    ("City Council", r"\bward[\s\-]*(\d+)\s+council", "Ward "),
    ("State Assembly", r"\bassembly district[\s\-]*(\d+)", "District "),
    ("State Senate", r"\bsenate district[\s\-]*(\d+)", "District "),
    ("State Delegate", r"\bdelegate district[\s\-]*(\d+)", "District "),
    ("US House", r"\b(\d+)(?:st|nd|rd|th)\s+district\b", "District "),
)


def _search(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(text, f"(?i){pattern}", group)


def state_code(host: Column, text: Column) -> Column:
    """The state of an authority's host, else the only one that the text names, else New York for some of its hosts, else NULL."""
    named = F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(code)) for code, p in STATES)))
    known = F.create_map(*(F.lit(x) for pair in HOST_STATES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, host), F.when(F.size(named) == 1, named[0]), F.when(host.rlike("nyc|queens|brooklyn"), F.lit("NY")))


def office_and_jurisdiction(url: Column, text: Column) -> Column:
    """struct<office, jurisdiction>: of the first office that the text names, else of one that the address or a district tells; empty texts if none does."""
    made = lambda office, where: F.struct(F.lit(office).alias("office"), where.alias("jurisdiction"))
    none = F.lit("")
    told = lambda number, kind="District ": F.when(number == "", none).otherwise(F.concat(F.lit(kind), number))
    cities = []
    for p in CITIES:
        city = F.regexp_replace(_search(text, p, 1), r"^[ \-|]+|[ \-|]+$", "")
        cities.append(F.when((city != "") & (F.size(F.split(city, r"\s+")) <= 4), city))
    branches = []
    for office, pattern, district in OFFICES:
        if office == "Mayor":
            where = F.coalesce(*cities, none)
        elif district is None:
            where = none
        elif office == "City Council":
            where = F.trim(F.concat_ws(" ", F.initcap(_search(text, district, 1)), _search(text, district, 2)))
        else:
            where = told(F.concat(*(_search(text, district, k + 1) for k in range(district.count("(\\d+)")))))
        branches.append((text.rlike(f"(?i){pattern}"), made(office, where)))
    low = F.lower(url)
    branches += [(F.contains(low, F.lit(mark)), made(office, told(F.regexp_extract(low, number, 1)) if number else none)) for mark, office, number in ADDRESSES]
    branches += [(text.rlike(f"(?i){p}"), made(office, told(_search(text, p, 1), kind))) for office, p, kind in TITLES]
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out.otherwise(made("", none))


def priority(row: dict[str, Column]) -> Column:
    """How much a document's evidence counts: 4 official, 3 others, 2 a candidate's own, 1 such ones without a date, 0 not at all."""
    official = U.authority(row["source_url"]).isin("official", "marker") | row["source_type"].isin(*OFFICIAL_TYPES)
    return (
        F.when((row["analysis_scope"] == "context_only") | (row["coverage_status"] == "shared_document_unscoped") | ~row["extraction_status"].isin("", "extracted"), 0)
        .when(official, 4)
        .when(row["campaign_window_status"] == "out_of_window", 0)
        .when(row["source_type"].isin(*OWNED_TYPES), F.when(row["campaign_window_status"] == "undated", 1).otherwise(2))
        .otherwise(3)
    )


COLUMNS = ("document_id", "title", "source_url", "source_type", "role", "campaign_window_status", "analysis_scope", "coverage_status", "extraction_status", "text")


def evidence_of(documents: DataFrame) -> DataFrame:
    """race_id, field, priority, value, source: what each document tells of its race's state_code, office, jurisdiction and official_source. documents: race_id and COLUMNS; nulls are empty."""
    row = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in COLUMNS}
    row["source_type"] = F.lower(row["source_type"])
    url = F.coalesce(F.try_url_decode(row["source_url"]), row["source_url"])
    parts = F.filter(F.array(row["title"], url, F.substring(row["text"], 1, READ)), lambda x: x != "")
    rows = documents.select("race_id", *(v.alias(k) for k, v in row.items() if k != "text"), F.array_join(parts, " | ").alias("text"), priority(row).alias("priority"))
    rows = rows.filter("priority > 0").withColumn("host", F.lower(U.part(F.col("source_url"), 2)))
    own = F.when(F.col("document_id") != "", F.col("document_id")).otherwise(F.col("source_url"))
    known = F.coalesce(F.col("host").isin(*HOST_STATES), F.lit(False))
    state = state_code(F.col("host"), F.col("text"))
    told = office_and_jurisdiction(F.col("source_url"), F.col("text"))
    official = F.when(F.col("source_type").isin(*OFFICIAL_TYPES) | U.authority(F.col("source_url")).isin("official", "marker"), F.col("source_url"))
    cell = lambda name, value, kind, more=F.lit(0): F.struct(F.lit(name).alias("field"), (F.col("priority") + more).alias("priority"), value.alias("value"), F.concat(kind, F.lit(":"), own).alias("source"))  # noqa: E731, B008
    cells = F.array(
        cell("state_code", state, F.when(known, "official_host").otherwise("title_url_text")),
        cell("office", told["office"], F.lit("title_url_text")),
        cell("jurisdiction", told["jurisdiction"], F.lit("title_url_text")),
        cell("official_source", official, F.lit("official_url"), (F.col("role") == "endorsed").cast("int")),
    )
    return rows.select("race_id", F.explode(cells).alias("e")).select("race_id", "e.*").filter(field(F.col("value")) != "")


#: Fields of which the least value is taken where several have the best evidence.
LEAST_WINS = ("official_source",)


def decided(evidence: DataFrame) -> DataFrame:
    """race_id, field, value, sources, status: the value of the best evidence.

    If the best evidence names several values the field stays open: its value is
    empty and its status `tied` (of LEAST_WINS the least value is taken).
    sources: those of the value, sorted, a pipe list. Values are told apart
    after white space is squeezed. Two partial aggregates, no sort by race.
    """
    rows = evidence.withColumn("value", squeezed(F.col("value")))
    by_value = rows.groupBy("race_id", "field", "priority", "value").agg(F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"))
    ranked = by_value.groupBy("race_id", "field", "priority").agg(F.min(F.struct("value", "sources")).alias("one"), F.count("*").alias("n"))
    best = ranked.groupBy("race_id", "field").agg(F.max_by(F.struct("one", "n"), "priority").alias("b")).select("race_id", "field", "b.one.*", "b.n")
    open_ = (F.col("n") > 1) & ~F.col("field").isin(*LEAST_WINS)
    empty = lambda c: F.when(open_, "").otherwise(F.col(c)).alias(c)
    return best.select("race_id", "field", empty("value"), empty("sources"), F.when(open_, "tied").otherwise("resolved").alias("status"))


def inferred(documents: DataFrame) -> DataFrame:
    """race_id and for each field its value, sources and status (blank: no evidence): decided evidence, one row a race."""
    fields = ("state_code", "office", "jurisdiction", "official_source")
    one = lambda f, c: F.coalesce(F.max(F.when(F.col("field") == f, F.col(c))), F.lit(""))
    cells = [one(f, c).alias(f if c == "value" else f"{f}_{c}") for f in fields for c in ("value", "sources", "status")]
    found = decided(evidence_of(documents)).groupBy("race_id").agg(*cells)
    return documents.select("race_id").distinct().join(found, "race_id", "left").fillna("")
