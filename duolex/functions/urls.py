"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = (
    "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "utm_campaign", "utm_content", "utm_id",
    "utm_medium", "utm_name", "utm_source", "utm_term", "share",
)

ARCHIVED = r"^(https?://web\.archive\.org/web/[0-9]+[a-z_]*/)(.*)$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query without its question mark."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def normalise(url: Column) -> Column:
    """Scheme (https where missing) and host in lower case, no repeated slashes, parameters or fragment; NULL for blanks, controls or pipes inside."""
    text = F.trim(url)
    full = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), F.ltrim(text)))
    path = F.regexp_replace(F.regexp_replace(part(full, 3), ";[^/]*$", ""), "/+", "/")
    query = part(full, 4)
    made = F.concat(F.lower(part(full, 1)), F.lit("://"), F.lower(part(full, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(text.rlike(r"[\s\x00-\x1f|]") | (text == "") | (part(full, 2) == ""), F.lit(None).cast("string")).otherwise(made)


def live(url: Column) -> Column:
    """The address inside an archive's address, else the address itself."""
    inner = F.regexp_extract(url, ARCHIVED, 2)
    return F.when(inner != "", F.regexp_replace(inner, r"^(https?):/([^/])", "$1://$2")).otherwise(url)


def canonical(url: Column) -> Column:
    """Live address without tracking parameters, the others sorted, without a slash at the end."""
    made = normalise(live(url))
    kept = F.array_join(F.array_sort(F.filter(F.split(part(made, 4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin([*TRACKING]))), "&")
    base = F.regexp_replace(F.concat(part(made, 1), F.lit("://"), part(made, 2), part(made, 3)), "/+$", "")
    return F.when(made.isNotNull(), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def domain(url: Column) -> Column:
    """Host without www. and port, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r":[0-9]+$", ""), r"^www\.", "")


def source_type(tag: Column, url: Column) -> Column:
    """First match over the tag, else over the address."""
    t, u = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(t.contains("debate"), "debate")
        .when(t.contains("interview"), "interview")
        .when(t.contains("questionnaire"), "questionnaire")
        .when(t.contains("press"), "press_release")
        .when(t.contains("speech"), "speech")
        .when(t.contains("policy") | t.contains("issue") | t.contains("platform"), "policy_page")
        .when(t.contains("ad"), "advertisement")
        .when(u.rlike(r"youtube\.com|youtu\.be|vimeo\.com"), "video")
        .when(u.rlike(r"facebook\.com|twitter\.com|x\.com|instagram\.com|bsky\.app"), "social")
        .when(u.rlike(r"/(news|press)"), "press_release")
        .when(u.rlike(r"/(issue|polic|platform)"), "policy_page")
        .when(domain(u).rlike(r"\.gov$"), "official")
        .otherwise("campaign_page")
    )


def authority(url: Column) -> Column:
    """Whether an address belongs to an election authority: official, marker or none."""
    host, path = domain(url), F.lower(part(url, 3))
    return (
        F.when(host == "", "none")
        .when(host.rlike(r"(facebook|twitter|youtube|wikipedia)\."), "none")
        .when(host.rlike(r"\.gov$|\.us$"), "official")
        .when(host.rlike(r"elections?|vote|sos\.|clerk") | path.rlike(r"/(elections?|results|canvass)"), "marker")
        .otherwise("none")
    )
