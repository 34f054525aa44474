"""Contrasts, names, sections, locators, evidence, duplicates as they arrive, and k-means, on literal cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from duolex.functions import text as T
from duolex.operators import contrasts, corpus, scoping
from duolex.operators import evidence as E
from duolex.operators import vectors as V
from duolex.streaming import upsert

STATEMENT = "ord long, race_id string, candidate_name string, role string, topic string, subtopic string, stance string, quote string, source string, opponent string, status string, election_date string"


def statements(spark, rows):
    return spark.createDataFrame([(i, "r", name, role, topic, sub, stance, f"q{i}", f"s{i}", opponent, "verified", "2020-11-03") for i, (name, role, topic, sub, stance, opponent) in enumerate(rows)], STATEMENT)


def test_divergence_is_any_row_for_against_any_row_against(spark):
    rows = [
        ("Ann", "endorsed", "rent", "a", "mixed", ""), ("Bo", "opponent", "rent", "a", "support", ""), ("Ann", "endorsed", "rent", "a", "oppose", ""),
        ("Bo", "opponent", "rent", "a", "oppose", ""), ("Cy", "opponent", "rent", "", "mixed", ""), ("ANN", "endorsed", "bus", "", "mixed", ""), ("Bo", "opponent", "bus", "x", "mixed", ""),
        ("Ann", "endorsed", "tax", "x", "mixed", ""), ("Bo", "opponent", "tax", "x", "mixed", ""), ("Bo", "opponent", "tax", "y", "support", ""), ("Cy", "opponent", "tax", "z", "oppose", "  bo "),
    ]
    got = {(r.topic, r.candidate_a, r.candidate_b, r.contrast_type, r.relationship_code, r.quote_a, r.quote_b, r.subtopic) for r in contrasts.sticking_points(statements(spark, rows)).collect()}
    # neutral against support is no divergence, several rows of a person all count, two people who aren't backed don't, a named opponent who isn't backed doesn't
    assert got == {("rent", "Ann", "Bo", "coded_divergence", "explicit_disagreement", "q2", "q1", "a"), ("tax", "Ann", "Bo", "coded_divergence", "different_mechanism", "q7", "q9", "x"), ("tax", "Ann", "Cy", "coded_divergence", "different_mechanism", "q7", "q10", "x")}


def test_named_conflicts_show_the_first_names(spark):
    rows = [("Ann Lee", "opponent", "", "", "", ""), ("ANN  LEE", "endorsed", "", "", "", "bo ray"), ("Bo Ray", "opponent", "t", "", "", "Ann Lee"), ("Bo Ray", "opponent", "t", "", "", "Nobody")]
    points = contrasts.sticking_points(statements(spark, rows))
    got = {(r.candidate_a, r.candidate_b, r.quote_a) for r in points.collect()}
    assert got == {("Ann Lee", "Bo Ray", "q1"), ("Bo Ray", "Ann Lee", "q2")}
    cycles = contrasts.sticking_point_cycles(points, statements(spark, rows)).collect()
    assert [(r.cycle, r.explicit_conflict, r.coded_divergence, r.total) for r in cycles] == [("2020", 2, 0, 2)]
    assert contrasts.sticking_points(statements(spark, rows).limit(0)).collect() == []


def test_identities_are_made_once(spark):
    """The plans that join identities and words hold no expression that makes them."""
    points = contrasts.sticking_points(statements(spark, [("Ann", "endorsed", "tax", "x", "mixed", "bo"), ("Bo", "opponent", "tax", "y", "support", "")]))
    names = spark.createDataFrame([(1, "J. Smith"), (1, "Jane Smith")], "y int, name string").distinct()
    for df in (points, corpus.similar_names(names, names, ["y"], "name")):
        assert "regexp_replace" not in df._jdf.queryExecution().executedPlan().toString()


def test_similar_names(spark):
    names = ["J. Smith", "Jane Smith", "Smith, Jane Q.", "John Smith", "Jane Smythe", "Cher", "cher", None, " ", "J.D. Vance", "JD Vance Jr."]
    df = spark.createDataFrame([(1, n) for n in names], "y int, name string")
    got = {(r.name, r.right_name) for r in corpus.similar_names(df, df, ["y"], "name").collect() if r.name < r.right_name}
    want = [("J. Smith", "Jane Smith"), ("J. Smith", "Smith, Jane Q."), ("Jane Smith", "Smith, Jane Q."), ("J. Smith", "John Smith"), ("Cher", "cher"), ("J.D. Vance", "JD Vance Jr.")]
    assert got == {tuple(sorted(p)) for p in want}


def test_sections_and_guides(spark):
    text = "Intro. TL;DR: Yes. Jane Roe Endorsed DSA, runs in AD 34 for State Assembly. TL;DR: No one here. TL;DR: Ana Paz Endorsed DSA for Mayor."
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "id int, t string")
    assert [(r.section, r.heading) for r in scoping.sections(df, "id", "t", "TL;DR:").filter("id = 1").orderBy("section").collect()] == [(0, ""), (1, "TL;DR:"), (2, "TL;DR:"), (3, "TL;DR:")]
    got = [(r.id, r.section, r.name, r.district, r.office) for r in scoping.guide_entries(df, "id", "t", "TL;DR:", r"(?<name>[A-Z][a-z]+ [A-Z][a-z]+)\s+Endorsed DSA\b").orderBy("section").collect()]
    assert got == [(1, 1, "Jane Roe", "AD 34", "State Assembly AD 34"), (1, 3, "Ana Paz", "", "Mayor")]
    under = scoping.entries_under(df, "id", "t", "TL;DR:", r"(?<who>Jane|Ana)").orderBy("section").collect()
    assert [(r.section, r.place, r.who) for r in under] == [(1, 0, "Jane"), (3, 0, "Ana")]


def test_scoped_by_every_kind_of_locator(spark):
    paragraphs = [("d", 1, "Welcome all", ""), ("d", 2, "Ann begins", ""), ("d", 3, "ann speaks [PDF page 3]", ""), ("d", 4, "Bo begins", ""), ("d", 5, "The end [pdf page 4]", ""), ("c", 1, "one", "time 00:00:01-00:00:03,500"), ("c", 2, "two", "time 00:00:04,000-00:00:09,000")]
    jobs = [
        (1, "d", "range: Ann begins => bo BEGINS"), (2, "d", "from: bo"), (3, "d", "paragraph 1 | welcome"), (4, "d", "pages 3-4"), (5, "d", "ann"), (6, "d", ""), (7, "d", None), (8, "d", "paragraph 9"), (9, "d", "paragraph 9 | Paragraph 5"),
        (10, "c", "time 00:00:03 - 00:00:04"), (11, "c", "time 00:00:03,600 --> 00:00:03,700"), (12, "x", "paragraph 1"), (13, "d", "range: bo => ann begins"), (14, "d", "welcome | ann"), (15, "d", "the end"),
    ]
    made = scoping.scoped(spark.createDataFrame(jobs, "job_id int, document_id string, locators string"), spark.createDataFrame(paragraphs, "document_id string, index int, text string, locator string"))
    got = {r.job_id: r.text if r.status == "extracted" else None for r in made.collect()}
    assert got == {
        1: "Ann begins\n\nann speaks [PDF page 3]", 2: "Bo begins\n\nThe end [pdf page 4]", 3: "Welcome all", 4: "ann speaks [PDF page 3]\n\nThe end [pdf page 4]", 5: None, 6: None, 7: None, 8: None, 9: "The end [pdf page 4]",
        10: "one\n\ntwo", 11: None, 12: None, 13: None, 14: None, 15: "The end [pdf page 4]",
    }


def test_evidence_best_rank_and_ties(spark):
    rows = [("r1", "state_code", 3, "NY", "a"), ("r1", "state_code", 3, " NY ", "b"), ("r1", "state_code", 1, "CA", "c"), ("r2", "state_code", 4, "NY", "a"), ("r2", "state_code", 4, "CA", "b"), ("r2", "state_code", 3, "CA", "c"), ("r2", "official_source", 4, "https://b", "x"), ("r2", "official_source", 4, "https://a", "y")]
    got = {(r.race_id, r.field): (r.value, r.sources, r.status) for r in E.decided(spark.createDataFrame(rows, "race_id string, field string, priority int, value string, source string")).collect()}
    assert got == {("r1", "state_code"): ("NY", "a | b", "resolved"), ("r2", "state_code"): ("", "", "tied"), ("r2", "official_source"): ("https://a", "y", "resolved")}


def test_inferred_fields_of_documents(spark):
    schema = "race_id string, " + ", ".join(f"{c} string" for c in E.COLUMNS)
    doc = lambda race, i, title, url="https://x.org", kind="news", text="", **more: (race, i, title, url, kind, "opponent", more.get("window", "in_window"), more.get("scope", "analysis"), None, more.get("status"), text)
    rows = [
        doc("a", "1", "City Council ward 7 in Chicago", text="Voters of Ohio"), doc("a", "2", "Mayor", kind="campaign_page"),
        doc("b", "3", "Portland mayoral candidate"), doc("c", "4", "x", scope="context_only"), doc("d", "5", "x", url="https://www.nyccfb.info/a", kind="blog"), doc("e", "6", "New York and Ohio", window="out_of_window"), doc("f", "7", "Ohio", status="fetch_error"),
    ]
    got = {r.race_id: r for r in E.inferred(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a"].office, got["a"].jurisdiction, got["a"].state_code, got["a"].office_sources) == ("City Council", "Ward 7", "OH", "title_url_text:1")
    assert (got["b"].office, got["b"].jurisdiction, got["b"].state_code) == ("Mayor", "Portland", "OR")
    assert (got["d"].state_code, got["d"].state_code_sources) == ("NY", "official_host:5")
    assert all(got[k].state_code == got[k].office == got[k].state_code_status == "" for k in "cef")


def test_duplicates_as_batches_arrive(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(9))
    batches = [[(1, 1, "Same."), (2, 2, long), (3, 3, None)], [(4, 4, "same."), (5, 5, long + " word3"), (6, 6, "")], [(1, 7, "other"), (7, 8, "Same."), (7, 9, long)]]
    docs: dict = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, o long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, o long, t string").parquet(str(tmp_path / "in"))
        upsert.count_duplicates(stream, str(tmp_path / "table"), str(tmp_path / "log"), "id", "t", "o").awaitTermination()
        before = dict(docs)
        docs |= {i: t or "" for i, _, t in rows}
        whole = spark.createDataFrame(list(docs.items()), "id long, t string").select("id", T.exact_hash(F.col("t")).alias("e"), T.near_hash(F.col("t")).alias("n")).collect()
        want = {r.id: (sum(x.e == r.e for x in whole), 1 if r.n == "" else sum(x.n == r.n for x in whole)) for r in whole}
        assert {r.id: (r.n_exact, r.n_near) for r in upsert.duplicate_numbers(spark, str(tmp_path / "table")).collect()} == want
        changed = {r.id: (r.n_exact, r.n_near) for r in spark.read.parquet(str(tmp_path / "table" / "changes" / f"v={k}")).collect()}
        assert all(want[i] == v for i, v in changed.items()) and {i for i, _, _ in rows} <= set(changed)
        assert not before or any(i in changed for i in before)


def test_kmeans_against_every_partition(spark):
    x = np.random.default_rng(5).standard_normal((9, 2)) + np.repeat([[0, 0], [3, 1], [1, 4]], 3, axis=0)
    cost = lambda parts: sum(((x[p] - x[p].mean(axis=0)) ** 2).sum() for p in parts if len(p))
    best = min(cost([[i for i in range(9) if c[i] == k] for k in range(3)]) for c in itertools.product(range(3), repeat=9))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)] + [(20 + i, 1, [1.0, 1.0]) for i in range(4)] + [(30, 2, [0.0, 0.0])]
    got = V.kmeans(spark.createDataFrame(rows, "id long, g int, v array<double>"), "id", "g", "v", {0: 3, 1: 2}).collect()
    parts = [[r.id for r in got if r.g == 0 and r.cluster == k] for k in range(3)]
    assert abs(cost(parts) - best) < 1e-9 and all(abs(r.inertia - best) < 1e-9 for r in got if r.g == 0)
    assert {r.cluster for r in got if r.g == 1} == {0} and not any(r.g == 2 for r in got)
