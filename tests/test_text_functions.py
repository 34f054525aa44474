"""Column functions and statistics on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from duolex.functions import identity as I
from duolex.functions import predicates as P
from duolex.functions import text as T
from duolex.functions import urls as U
from duolex.operators import stats


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The workers’ movement supports public ownership.", ["worker", "movement", "ownership"]),
        ("Medicare for All and rent control support working-class tenants.", ["medicare_for_all", "rent_control", "working_class", "tenant"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def test_stems(spark):
    for word, want in (("policies", "policy"), ("ties", "ties"), ("classes", "class"), ("buses", "buse"), ("bus", "bus"), ("class", "class"), ("tenants", "tenant")):
        assert one(spark, T.stem(F.col("t")), t=word) == want


def test_bigrams(spark):
    assert one(spark, T.bigrams(F.col("t")), t=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, T.bigrams(F.col("t")), t=["a"]) == [] == one(spark, T.bigrams(F.col("t")), t=[])


def test_hashes_and_lists(spark):
    assert one(spark, T.exact_hash(F.col("t")), t="A  “b” ") == one(spark, T.exact_hash(F.col("t")), t='a "B"')
    assert one(spark, T.near_hash(F.col("t")), t="few words") == ""
    assert one(spark, T.near_hash(F.col("t")), t="alpha beta gamma delta epsilon zetas") == one(spark, T.near_hash(F.col("t")), t="zeta epsilon Delta gamma beta alphas")
    assert one(spark, T.joined_first_seen(F.col("a"), F.col("b")), a="x | y | x", b="z | y") == "x | y | z"
    assert len(one(spark, T.stable_hash(F.col("t"), F.lit(None)), t="x")) == 24
    assert one(spark, T.slug(F.col("t")), t=" Jane O'Neil! ") == "jane-o-neil"


def test_dates_and_numbers(spark):
    for text, want in (("2020", "2020-01-01"), ("2020-05", "2020-05-01"), ("2020-05-06T10:00", "2020-05-06"), ("x", None), ("", None)):
        assert one(spark, T.to_date(F.col("t")).cast("string"), t=text) == want
    assert one(spark, T.to_int(F.col("t")), t=" 12 ") == 12 and one(spark, T.to_int(F.col("t")), t="x") == 0


def test_negation(spark):
    for text, mention, want in (("We oppose rent control.", "rent", True), ("We back it. Rent control now", "Rent", False), ("They do not support a public option", "public", True), ("without the fee", "fee", True)):
        assert one(spark, T.negated(F.col("t"), F.lit(text.index(mention))), t=text) == want


def test_paragraphs_and_excerpt(spark):
    assert one(spark, T.paragraphs(F.col("t")), t="a  b\r\n\r\n\n c \n") == ["a b", "c"]
    text = "x" * 100 + " hit " + "y" * 200
    got = one(spark, T.excerpt(F.col("t"), F.lit(101), F.lit(104)), t=text)
    assert got.startswith("...") and got.endswith("...") and "hit" in got


def test_urls(spark):
    cases = {
        "HTTP://WWW.Example.org//a//b/?utm_source=x&b=2&a=1#top": "http://www.example.org/a/b?a=1&b=2",
        "example.org/x/": "https://example.org/x",
        "https://web.archive.org/web/20200101000000/http:/example.org/p": "http://example.org/p",
        "has space.org": None,
        "": None,
    }
    for url, want in cases.items():
        assert one(spark, U.canonical(F.col("u")), u=url) == want
    assert one(spark, U.domain(F.col("u")), u="https://www.Example.org:80/x") == "example.org"
    assert one(spark, U.source_type(F.col("u"), F.lit("https://x.org/issues")), u="Broadcast") == "advertisement"


def test_statistics_are_symmetric_and_bounded(spark):
    rows = [(1, "endorsed", "housing housing wage"), (2, "endorsed", "wage union"), (3, "opponent", "taxes growth wage"), (4, "opponent", "")]
    df = spark.createDataFrame(rows, "doc_id long, grp string, text string").withColumn("tokens", T.tokens(F.col("text")))
    pair, swapped = ("endorsed", "opponent"), ("opponent", "endorsed")
    a = {r.feature: r.z_score for r in stats.log_odds(df, "grp", "tokens", pair, least=1).collect()}
    b = {r.feature: r.z_score for r in stats.log_odds(df, "grp", "tokens", swapped, least=1).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], -b[k], abs_tol=1e-9) for k in a)
    assert all(0 <= r.endorsed_share <= 1 for r in stats.prevalence(df, "doc_id", "grp", "tokens", pair, least=1).collect())
    tfidf = {r.term: r for r in stats.group_tfidf(df, "doc_id", "grp", "tokens", pair).collect()}
    assert math.isclose(tfidf["housing"].endorsed, 2 / 3 * (math.log(5 / 2) + 1) / 2)
    assert stats.bag_cosine(df.withColumn("k", F.lit(1)), ["k"], "grp", "tokens", pair).first().cosine > 0


def test_mentions_need_both_sides(spark):
    rows = [(1, "r1", "endorsed", "We want rent control."), (2, "r1", "opponent", "Rent control works."), (3, "r2", "endorsed", "rent control"), (4, "r2", "opponent", "We oppose rent control.")]
    df = spark.createDataFrame(rows, "doc_id long, race string, grp string, text string")
    got = stats.two_sided_mentions(df, ["race"], "grp", "doc_id", "text", [(r"\brent\s+control\b", "rent_control")], ("endorsed", "opponent")).collect()
    assert [(r.race, r.feature) for r in got] == [("r1", "rent_control")]


def test_balanced_lift(spark):
    rows = [("a", "r1", "c1", "housing"), ("a", "r2", "c2", "wage"), ("b", "r1", "c3", "housing"), ("b", "r1", "c3", "housing")]
    w = stats.balanced_weights(spark.createDataFrame(rows, "grp string, race string, cand string, narrative string"), "grp", "race", "cand")
    got = {r.narrative: r for r in stats.lift(w, "narrative", "grp", "weight", ("a", "b")).collect()}
    assert (got["housing"].share_a, got["housing"].share_b, got["housing"].favored_group) == (0.5, 1.0, "b")


def test_identities(spark):
    for text, want in (("José  Ángel-Núñez, Jr.", "jose angel nunez jr"), ("Straße ﬁne ½", "strasse fine 1 2"), ("Ａｂｃ", "abc"), ("n\u0303o", "no"), ("", "")):
        assert one(spark, I.identity(F.col("t")), t=text) == want, text
    assert one(spark, I.text_identity(F.col("t")), t=" “É—x”  y ") == '"e-x" y'
    assert one(spark, I.labels(F.col("t")), t="b| a ||b") == ["a", "b"]
    assert one(spark, I.names(F.col("t")), t="Ann; none listed | Bo |Democratic  Primary Field") == ["Ann", "Bo"]
    assert one(spark, I.official_group(F.col("t")), t="dsa_national | dsa_state_local") == "dsa"
    for bad in ("dsa_national|dnc_national", "odd", ""):
        with pytest.raises(Exception, match="unsupported or mixed"):
            one(spark, I.official_group(F.col("t")), t=bad)
    assert one(spark, I.first_url(F.col("t")), t=" https://a.org ; https://b.org") == "https://a.org"


def test_chart_labels():
    assert I.wrapped("one two three four five six", 9, 2) == ["one two", "three…"] and I.wrapped("a longwordindeed b", 5) == ["a", "longwordindeed", "b"]
    assert I.tint("#102030", 0.5) == "#889098" and I.tint("#FFFFFF", 0.3) == "#FFFFFF"


def test_predicates(spark):
    for url, want in (
        ("https://x.org/wp-content/endorse.js", False), ("https://x.org/2020/endorsements", True), ("https://x.org/events/endorsement-qa", False), ("https://x.org/candidates?tribe-bar-date=1", False),
        ("https://x.org/call-for-candidates", False), ("https://x.org/calendar/elections", False), ("https://x.org/elections", True), ("https://x.org/voter%2Dguide", True), ("https://x.org/", False),
    ):
        assert one(spark, P.historical_url(F.col("u")), u=url) is want, url
    for url, want in (("https://x.org/issues", True), ("https://x.org/", False), ("https://x.org/press.css", False), ("https://x.org/feed", False), ("https://x.org/wp-content/policy.pdf", False), ("https://x.org/privacy-policy", False), ("https://x.org/my%20Speech.pdf", True)):
        assert one(spark, P.discovery_url(F.col("u")), u=url) is want, url
    for host, slug, registered, want in (("smith.org", "jane-smith", False, True), ("vote-smith.org", "jane-smith", False, False), ("lee.org", "ann-lee", False, False), ("x.gov", "x", True, True)):
        assert one(spark, P.own_domain(F.col("h"), F.lit(slug), F.lit(registered), ("docs.google.com",)), h=host) is want
    done = lambda f, e, c, t, p, tp: P.is_completed(F.lit(f), F.lit(e), F.lit(c), F.lit(t), F.lit(p), F.lit(2), F.lit(tp), F.lit(2))
    for args, want in ((("fetched", "extracted", "verified", "x", 3, 3), True), (("fetched", "extracted", "verified", "x", 3, 2), False), (("fetched", "extracted", "verified", " ", 3, 3), False), (("failed", "extracted", "verified", "x", 3, 3), False), (("reused_raw", "media_no_transcript", "media_no_transcript", None, 0, 0), True), ((None, None, None, None, 0, 0), False)):
        assert one(spark, done(*args), u="") is want, args
