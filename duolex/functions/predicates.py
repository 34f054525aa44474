"""Which rows, addresses and domains count, as boolean column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped
from .urls import domain, part

# Scopes and states of documents.
CONTEXT, UNSCOPED, NO_TRANSCRIPT, EXTRACTED = "context_only", "shared_document_unscoped", "media_no_transcript", "extracted"
FETCHED = ("fetched", "reused_raw")
# Paths of captures that may be about candidates, and those that aren't.
ARCHIVE_TERMS = ("endorse", "endorsement", "endorsed", "voter-guide", "voterguide", "slate")
ARCHIVE_EXCLUDED = (
    "/wp-content/", "/wp-includes/", "/plugins/", "/themes/", "/assets/", "/static/", "/calendar/category/",
    "/events/category/",
)
ARCHIVE_SUFFIXES = (
    ".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".woff", ".woff2", ".ttf", ".ico", ".ics", ".map",
)
EVENT_PATHS = ("/event/", "/events/")
EVENT_TERMS = ("endorsement-forum", "endorsement-qa", "endorsement-process", "endorsement-meeting", "candidate-forum")
NO_CANDIDATES = ("call-for-candidates", "candidate-forum", "internal-election", "delegates")
NO_ELECTION = ("/event/", "/events/", "/series/", "/calendar/", "/feed", "/embed", "working-group", "committee-meeting")
# Paths of documents to discover, and those that are none.
DISCOVERY_PATHS = (
    "agenda", "announcement", "issue", "issues", "news", "platform", "policies", "policy", "press", "priorities", "qa",
    "questionnaire", "questionnaires", "release", "releases", "remarks", "speech", "speeches", "statement", "statements",
)
DISCOVERY_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".xml", ".css", ".js")
LEGAL_PATHS = ("privacy-policy", "privacy_policy", "terms-of-service", "terms_of_service", "cookie-policy", "cookie_policy")
DISCOVERY_TERMS = ("endor", "elect", "candidate", "voter-guide", "slate")
PAGE_TERMS = ("endorse", "endorsement", "endorsed", "electoral slate", "candidate slate", "voter guide")
# Hosts and words of domains that are no candidate's own, and sources that a domain may come from.
VIDEO_HOSTS = ("vimeo.com", "youtube.com", "youtu.be")
MEDIA_SUFFIXES = (
    ".aac", ".avi", ".m4a", ".mov", ".mp3", ".mp4", ".mpeg", ".mpg", ".oga", ".ogg", ".ogv", ".wav", ".webm",
)
FOREIGN_TERMS = ("ballot", "election", "guide", "questionnaire", "survey", "vote", "voter")
OWN_SOURCES = (
    "official_campaign", "campaign_announcement", "campaign_issue", "campaign_page", "campaign_platform",
    "campaign_policy", "campaign_press_release", "campaign_release", "campaign_site", "campaign_speech",
    "campaign_statement", "campaign_website",
)


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def ends(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.endswith(text, F.lit(w)) for w in words))


def field(column: Column) -> Column:
    return stripped(F.coalesce(column, F.lit("")))


def supports_analysis(scope: Column, coverage: Column, extraction: Column) -> Column:
    """Neither context only nor a shared document without a scope of its own."""
    return (field(scope) != CONTEXT) & (field(coverage) != UNSCOPED) & (field(extraction) != UNSCOPED)


def supports_pairing(scope: Column, coverage: Column, extraction: Column) -> Column:
    return supports_analysis(scope, coverage, extraction) & (field(extraction) == EXTRACTED)


def is_completed(fetch: Column, extraction: Column, coverage: Column, text: Column, paragraphs: Column, sentences: Column, told_paragraphs: Column, told_sentences: Column) -> Column:
    """A fetched document whose text has the paragraphs and sentences that its metadata tell of, or one without a transcript that says so. The metadata and text columns are NULL where a document has none."""
    whole = (field(extraction) == EXTRACTED) & (field(text) != "") & (told_paragraphs > 0) & (told_sentences > 0) & (paragraphs == told_paragraphs) & (sentences == told_sentences)
    silent = (field(extraction) == NO_TRANSCRIPT) & (field(coverage) == NO_TRANSCRIPT)
    return F.coalesce(field(fetch).isin([*FETCHED]) & (whole | silent), F.lit(False))


def queue_completed(segments: Column, collection: Column, metadata: Column) -> Column:
    return (F.coalesce(segments.try_cast("long"), F.lit(0)) > 0) | ((field(collection) == NO_TRANSCRIPT) & F.contains(field(metadata), F.lit(NO_TRANSCRIPT)))


def silent_video(transcript: Column, kind: Column, url: Column) -> Column:
    """A video without a transcript, by its class, host or suffix."""
    media = domain(url).isin([*VIDEO_HOSTS]) | ends(F.lower(part(url, 3)), MEDIA_SUFFIXES)
    return (field(transcript) == "") & ((field(kind) == "video") | F.coalesce(media, F.lit(False)))


def path_of(url: Column) -> Column:
    """The decoded path in lower case; one that can't be decoded as it is."""
    path = part(url, 3)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def historical_url(url: Column) -> Column:
    """A captured page about endorsed candidates or elections, by its path; the first rule that applies decides."""
    path = path_of(url)
    return (
        F.when(holds(path, ARCHIVE_EXCLUDED) | ends(path, ARCHIVE_SUFFIXES) | F.contains(F.lower(part(url, 4)), F.lit("tribe-bar-date=")), False)
        .when(holds(path, EVENT_PATHS) & holds(path, EVENT_TERMS), False)
        .when(holds(path, ARCHIVE_TERMS), True)
        .when(F.contains(path, F.lit("candidate")), ~holds(path, NO_CANDIDATES))
        .when(holds(path, ("electoral", "election")), ~holds(path, NO_ELECTION))
        .otherwise(False)
    )


def discovery_url(url: Column) -> Column:
    """A page or file worth fetching, by its path."""
    path = path_of(url)
    feed = path.isin("/feed", "/comments/feed") | path.startswith("/comments/feed/")
    none = path.isin("", "/") | ends(path, DISCOVERY_SUFFIXES) | feed | path.startswith("/wp-content/") | path.startswith("/wp-includes/") | holds(path, LEGAL_PATHS)
    return ~none & holds(path, DISCOVERY_PATHS)


def discovery_term(text: Column) -> Column:
    return holds(F.lower(text), DISCOVERY_TERMS)


def endorsement_page(title: Column, text: Column, chars: int = 6000) -> Column:
    """One of PAGE_TERMS in the title or the text's first characters."""
    return holds(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, chars))), PAGE_TERMS)


def own_domain(host: Column, slug: Column, registered: Column, foreign_hosts: tuple[str, ...]) -> Column:
    """Whether a domain is a candidate's: registered as such, or with a word of the name's slug of at least four letters in it and nothing that speaks against it."""
    low = F.lower(host)
    named = F.exists(F.split(slug, "-"), lambda t: (F.length(t) >= 4) & F.contains(low, t))
    return registered | (~low.isin([*foreign_hosts]) & ~low.endswith(".gov") & ~holds(low, FOREIGN_TERMS) & named)


def derives_domain(own: Column, sources: Column, registered: Column) -> Column:
    """own_domain's result, and a source type that a candidate's own domain may be taken from."""
    tags = F.transform(sources, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return own & (registered | F.exists(tags, lambda t: holds(t, OWN_SOURCES)))
