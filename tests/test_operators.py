"""Relational, vector, validation and ledger operators, sources and sinks on small cases."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from duolex.operators import audit as A
from duolex.operators import corpus as C
from duolex.operators import ledger as L
from duolex.operators import relational as R
from duolex.operators import vectors as V
from duolex.functions import text as T
from duolex.sources import extract, fetch, readers, segment
from duolex.streaming import upsert


def test_as_of_with_and_without_spans(spark):
    left = spark.createDataFrame([(1, 5), (1, 25), (2, 1), (1, 0)], "k int, at long")
    right = spark.createDataFrame([(1, 1, "a"), (1, 20, "b"), (1, 25, "c"), (2, 9, "z")], "k int, since long, v string")
    for grain in (None, 4, 100):
        got = {(r.k, r.at): r.v for r in R.as_of(left, right, ["k"], "at", "since", "v", grain).collect()}
        assert got == {(1, 5): "a", (1, 25): "c", (2, 1): None, (1, 0): None}


def test_as_of_by_nearest_seconds_and_without_nulls(spark, tmp_path):
    from duolex.plans.relational_queries import asof_carry_forward, asof_in_spans, seconds

    times = spark.createDataFrame([("2024-01-01 00:00:00.5",), ("2024-01-01 00:00:01.5",), ("2024-01-01 00:00:01.4",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] - 1704067200 for r in times.select(seconds(F.col("t"))).collect()] == [0, 2, 1]
    rows = [(1, "10:00:00.9", 1, "click"), (2, "10:00:00.8", 1, "purchase"), (3, "10:00:01.6", 1, "click"), (4, "10:00:01.2", 1, "purchase"), (5, "09:00:00", None, "click"), (6, "11:00:00", None, "purchase"), (7, None, 2, "click"), (8, None, 2, "purchase")]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string")
    events.select("event_id", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    for run in (asof_carry_forward, asof_in_spans):
        assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == [(2, 1), (4, 1), (6, -1), (8, -1)]


@pytest.mark.parametrize("grain", [1, 3, 50])
def test_overlapping_each_pair_once(spark, grain):
    rows = [(1, k, lo, lo + n) for k, (lo, n) in enumerate([(0, 5), (3, 1), (5, 9), (20, 0), (14, 6)])]
    df = spark.createDataFrame(rows, "g int, id int, lo long, hi long")
    got = sorted((r.id, r.r_id) for r in R.overlapping(df, df, ["g"], "lo", "hi", grain).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[2] <= b[3] and b[2] <= a[3])


def test_components_and_fallback(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in R.components(e, "a", "b").collect()}
    assert {got[k] for k in range(1, 31)} == {1} and got[51] == 50
    chain = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert R.components(chain, "a", "b").select("component").distinct().collect() == [(0,)]
    right = spark.createDataFrame([("r", "d", 1, "x"), ("r", "d", 2, "y"), ("q", "d", 3, "z")], "race string, day string, o int, v string")
    left = spark.createDataFrame([("r", "d"), ("n", "d"), ("n", "n")], "race string, day string")
    assert {(r.race, r.day): r.v for r in R.fallback(left, right, ["race", "day"], ["day"], "o", "v").collect()} == {("r", "d"): "y", ("n", "d"): "z", ("n", "n"): None}


def test_either_key_emits_a_pair_once(spark):
    left = spark.createDataFrame([("r", "d", "n")], "race string, day string, name string")
    right = spark.createDataFrame([("r", "d", "n", 1), ("q", "d", "n", 2), ("r", "e", "n", 3)], "race string, day string, name string, id int")
    got = R.match_either(left, right, ["race", "name"], ["day", "name"])
    assert sorted(r.id for r in got.select("id").collect()) == [1, 2, 3]


def test_unanimous_mode_round_robin(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 1, "q"), ("b", 1, "q")], "k string, p int, v string")
    assert {r.k: r.v for r in R.unanimous(df, ["k"], "p", "v").collect()} == {"a": None, "b": "q"}
    assert {r.k: (r.v, r.n) for r in R.mode_value(df, ["k"], "v").collect()} == {"a": ("x", 1), "b": ("q", 2)}
    assert [r.k for r in R.round_robin(df, "k", ["v"], 3).select("k").collect()] == ["a", "b", "a"]
    assert R.longest_first([("a", 9), ("b", 5), ("c", 4), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_mutual_neighbours_literal(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    got = [(r.source, r.target, round(r.similarity, 12)) for r in V.mutual(V.knn(df, "id", "v", k=1, least=0.1)).collect()]
    assert got == [("a", "b", 0.993883734674)]
    assert sorted(got) == sorted((r.source, r.target, round(r.similarity, 12)) for r in V.mutual(V.knn(df, "id", "v", k=1, least=0.1, block=1)).collect())


def test_dp_means_density_and_trust(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.01]), ("c", [0.0, 1.0]), ("d", [0.01, 0.99])], "id string, v array<double>")
    got = {r.id: r.cluster for r in V.dp_means(df, "id", "v", 0.1).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]
    d = V.log_density(df, df.limit(1), "id", "v", 1.0, "ld").filter("id = 'c'").first().ld
    assert math.isclose(d, -math.log(2 * math.pi) - 1, rel_tol=1e-9)
    many = spark.createDataFrame([(k, [float(k % 5), float(k // 5), 0.1 * k]) for k in range(25)], "id int, v array<double>")
    assert V.trustworthiness(many, many, "id", "v", 5).first()[0] == 1.0
    for needs in (lambda: V.leiden(df, df), lambda: V.umap(df, "id", "v")):
        with pytest.raises(RuntimeError):
            needs()


def test_audit(spark):
    df = spark.createDataFrame([(1, "x", "2020-01-01", "2021-01-01"), (1, " ", "2022-01-01", "2021-01-01"), (2, "y", "soon", None)], "k int, v string, a string, b string")
    found = A.report(A.duplicate_keys(df, "k"), A.blank_fields(df, "k", ["v"]), A.outside_domain(df, "k", "v", ["x", "y"]), A.not_after(df, "k", "a", "b"))
    assert sorted((r.severity, r.rule) for r in found.collect()) == [("error", "a after b"), ("error", "blank field"), ("error", "duplicate k"), ("error", "v outside its domain"), ("warning", "a is no date")]
    assert not A.is_ok(found) and A.is_ok(found.filter("severity = 'warning'"))


def test_ledger(spark):
    tries = spark.createDataFrame([("a", 1, "Timed out"), ("b", 1, "bad page"), ("c", 1, None), ("d", 1, "timeout"), ("d", 2, "timeout"), ("d", 3, "timeout")], "k string, at int, error string")
    queue = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    assert [r.k for r in L.due(queue, tries, "k", 3, 10).collect()] == ["e", "a"]


def test_csv_json_and_blobs(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", you', None)], "id string, text string, note string")
    readers.write_csv(df, f"{tmp_path}/c", ["id", "text", "note"])
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/c").collect()] == [("1", 'say "hi", you', "")]
    with pytest.raises(ValueError):
        readers.write_csv(df, f"{tmp_path}/d", ["id"])
    assert readers.read_optional_csv(spark, f"{tmp_path}/none.csv", ["x"]).count() == 0
    with pytest.raises(ValueError):
        readers.with_exact_header(df, ["text", "id", "note"])
    readers.write_jsonl(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").coalesce(1), f"{tmp_path}/j")
    assert sorted(tuple(r) for r in readers.read_jsonl_last(spark, f"{tmp_path}/j", "k", "k string, v int").collect()) == [("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        readers.read_jsonl_unique(spark, f"{tmp_path}/j", "k", "k string, v int")
    blobs = spark.createDataFrame([("x", bytearray(b"abc")), ("x", bytearray(b"abc"))], "id string, content binary")
    readers.write_blobs(blobs, f"{tmp_path}/b", "id", "content")
    readers.write_blobs(blobs, f"{tmp_path}/b", "id", "content")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 1


def workbook(cells):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    assert readers.read_xlsx(workbook('<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row>'), "S") == [["name", "", "5"]]
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    made = workbook(f"<row>{text('A1', 'Results')}</row><row>{text('A2', 'VOTES')}{text('B2', ' NAME ')}</row><row>{text('A3', '12')}{text('B3', 'Ann')}</row><row>{text('B4', 'Bo')}</row>")
    (tmp_path / "x.xlsx").write_bytes(made)
    rows = readers.with_header(readers.read_workbooks(spark, f"{tmp_path}/x.xlsx", "S"), ["NAME", "VOTES"])
    assert sorted((r.NAME, r.VOTES) for r in rows.collect()) == [("Ann", "12"), ("Bo", "")]
    votes = rows.select("NAME", F.col("VOTES").try_cast("long").alias("VOTES"), F.lit("NY").alias("state")).fillna(0)
    assert {r.NAME: r.outcome for r in C.winners(votes, ["state"], "NAME", "VOTES", F.col("NAME") == "Bo").collect()} == {"Ann": "Win", "Bo": "Loss"}


def test_fixed_marks_and_block_tags(spark):
    """Tags that end no paragraph, the marks of challenges and of errors that pass."""
    page = extract.parse_page("<p>a</p>b<aside>c</aside><figure>d</figure>e<hr>f<address>g</address><li>h</li>i<br>j")
    assert page.paragraphs == ["a", "b c d e f g", "h", "i", "j"]
    texts = [("<html>CF-CHL-1", True), ("solve the captcha", False), ("Cloudflare Ray ID: 1", True), ("x" * 16_384 + "cf-chl-", False), (None, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(fetch.challenged(F.col("t"))).collect()] == [w for _, w in texts]
    errors = [("Remote end closed connection without response", True), ("temporarily moved", False), ("Service Temporarily Unavailable", True), ("HTTP Error 404", False), ("HTTP Error 503", True), (None, False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(errors)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(L.transient(F.col("t"))).collect()] == [w for _, w in errors]


def test_extraction(spark):
    page = extract.parse_page('<html><head><title>T x</title><meta property="article:published_time" content="2020-01-02"></head><body><script>no</script><p>One <b>two</b></p><div>three<br>four</div><a href="/l">link</a></body></html>', "https://e.org/a")
    assert (page.title, page.paragraphs, page.links, page.published) == ("T x", ["One two", "three", "four", "link"], ["https://e.org/l"], "2020-01-02")
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n\nnothing\n\n3\n00:00:03,000 --> 00:00:04,000\nBye"
    got = spark.createDataFrame([(srt,)], "t string").select(extract.srt_captions(F.col("t")).alias("c")).first().c
    assert [(c.place, c.locator, c.text) for c in got] == [(1, "time 00:00:01,000-00:00:02,500", "Hello there"), (3, "time 00:00:03,000-00:00:04,000", "Bye")]
    kinds = spark.createDataFrame([("video/mp4", "x"), ("application/pdf", "x"), (None, "a.srt?x"), ("text/html; charset=x", "x"), (None, "x.txt")], "m string, u string")
    assert [r[0] for r in kinds.select(extract.kind_of(F.col("m"), F.col("u"))).collect()] == ["media", "pdf", "srt", "html", "text"]
    xml = "<urlset><url><loc> https://e.org/a?x=1&amp;y=2 </loc></url></urlset>"
    assert spark.createDataFrame([(xml,)], "t string").select(extract.sitemap_locations(F.col("t"))).first()[0] == ["https://e.org/a?x=1&y=2"]
    cdx = '[["urlkey","timestamp"],["a","2020"],["b","2021"]]'
    assert spark.createDataFrame([(cdx,)], "t string").select(extract.cdx_rows(F.col("t"))).first()[0] == [["a", "2020"], ["b", "2021"]]
    view = '{"data":{"table":{"columns":[{"id":"f1","name":"Name"},{"id":"f2","name":"Tags","typeOptions":{"choices":{"s1":{"name":"red"},"s2":{"name":"blue"}}}}],"rows":[{"cellValuesByColumnId":{"f1":"x","f2":["s1","s2"]}}]}}}'
    assert extract.shared_view_rows(view) == [{"Name": "x", "Tags": "red | blue"}]


def test_sentences_and_segments():
    assert segment.sentences("Dr. Smith of the U.S. team spoke. It cost 3.5 dollars! “Why?” she said. ok") == ["Dr. Smith of the U.S. team spoke.", "It cost 3.5 dollars!", "“Why?” she said. ok"]
    short, long = "word " * 5, " ".join(["This sentence has exactly seven words here."] * 30)
    counts = [segment.token_count(s) for s in segment.packed(f"{short}\n\n{short}\n\n{short}\n\n{short}\n\n{long}")]
    assert all(20 <= n <= 90 for n in counts) and sum(counts) == 20 + 210


def test_transcripts_locators_searches_and_views(spark):
    one = lambda column, **values: spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r
    assert one(extract.transcript(F.col("t"), F.col("n")), t="a\x01 b\n\n c", n=" Talk ") == "Talk\n\na b\n\nc" and one(extract.transcript(F.col("t"), F.lit(None)), t=" \n") is None
    assert one(extract.locator(F.col("a"), F.col("b")), a="p 1", b="p 2") == "p 1 -> p 2" and one(extract.locator(F.col("a"), F.col("b")), a="p 1", b="p 1") == "p 1"
    assert tuple(one(extract.sentence_place(F.col("t")), t="paragraph 12 sentence 3")) == (12, 3) and tuple(one(extract.sentence_place(F.col("t")), t="page 2")) == (0, 0)
    assert one(extract.search_links(F.col("t")), t='[{"url":"https://a.org"},{"link":"https://b.org"},{"url":"https://a.org"},{}]') == ["https://a.org", "https://b.org"] and one(extract.search_links(F.col("t")), t="<html>") == []
    view = '{"data":{"table":{"columns":[{"id":"f1","name":"Name"}],"rows":[{"cellValuesByColumnId":{"f1":"x"}}]}}}'
    assert [r.cells for r in extract.shared_views(spark.createDataFrame([(1, view)], "id int, body string"), "id", "body").collect()] == [{"Name": "x"}]
    with pytest.raises(RuntimeError):
        extract.pdf_texts(spark.createDataFrame([(1, bytearray(b"x"))], "id int, c binary"), "id", "c")
    page = "<title>T &amp; x</title><script>no</script><p>One <b>two</b></p><!-- c --><div>three&nbsp;4</div>"
    assert one(T.html_to_text(F.col("t")), t=page) == "T & x\nOne two\nthree 4"


def test_discovery_of_a_domain(spark):
    pages = {
        "https://x.org/": b'<a href="/issues/a">a</a><a href="/shop">s</a><a href="https://y.org/issues">y</a>',
        "https://x.org/sitemap.xml": b"<urlset><loc>https://x.org/sub.xml</loc><loc>https://x.org/issues/b?x=1&amp;y=2</loc></urlset>",
        "https://x.org/sub.xml": b"<loc>https://x.org/issues/c</loc>",
        "https://x.org/feed": b"<item><title>t</title><link>https://x.org/issues/d</link></item>",
        "https://x.org/issues/a": b'<a href="/issues/e">e</a>',
    }

    def get(url):
        if url not in pages:
            raise TimeoutError("timed out")
        return url, "text/html", pages[url]

    sites = spark.createDataFrame([("k", "X.org"), ("z", "none.org")], "k string, d string")
    got = fetch.discover(sites, "k", "d", get, lambda u: "/issues/" in u, pages=3, urls=5, archive=lambda host: [f"https://{host}/issues/old"], tasks=1)
    want = {("a", "home"), ("b?x=1&y=2", "sitemap"), ("c", "sitemap"), ("d", "feed"), ("e", "page"), ("old", "archive")}
    assert {(r.url.split("/issues/")[1], r.found_by) for r in got.collect() if r.key == "k"} == want
    assert [(r.url, r.found_by) for r in got.collect() if r.key == "z"] == [("https://none.org/issues/old", "archive")]


def test_manifests_summaries_charts_and_commands(spark, tmp_path, capsys):
    from duolex.__main__ import COMMANDS, main
    from duolex.plans.registry import QUERIES

    queue = spark.createDataFrame([("a", "https://e.org/issues")], "k string, url string")
    got = fetch.fetch(queue, "k", ["url"], fake, 1)
    for _ in range(2):
        readers.append_manifest(got, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 2
    (tmp_path / "in.txt").write_text("abc")
    made = readers.write_summary(spark, f"{tmp_path}/s", {"queue": queue}, [f"{tmp_path}/in.txt"], {"least": 5})
    assert made["tables"] == {"queue": 1} and [*made["inputs"].values()] == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"] and readers.read_json_object(spark, f"{tmp_path}/s") == made
    assert readers.scatter_chart([(0, 0, "a<"), (1, 2, "b")], "t").count("<circle") == 2 and readers.heat_chart([(0, 0, 1.0), (1, 0, 0.5)], "t").count("<rect") == 2
    assert readers.markdown_report("R", {"A": "text", "B": queue}) == "# R\n\n## A\n\ntext\n\n## B\n\n| k | url |\n| --- | --- |\n| a | https://e.org/issues |\n"
    assert main(["list"]) == 0 and main(["sql", "race_registry"]) == 0 and main(["odd"]) == 1 and "kde" in capsys.readouterr().out
    assert all(n in QUERIES for names in COMMANDS.values() for n in names)


def test_names_of_one_person(spark):
    left = spark.createDataFrame([(1, "José (Pepe) Núñez, Jr."), (1, "A. B. Cole"), (1, "Cher"), (1, " "), (2, "Ann Lee")], "y int, name string")
    right = spark.createDataFrame([(1, "Jose M. Nunez"), (1, "AB Cole"), (1, "cher"), (1, "A. C. Cole"), (3, "Ann Lee"), (1, "")], "y int, name string")
    got = sorted((r.name, r.right_name) for r in C.match_names(left, right, ["y"], "name").collect())
    assert got == [("A. B. Cole", "AB Cole"), ("Cher", "cher"), ("José (Pepe) Núñez, Jr.", "Jose M. Nunez")]


def test_sentences_after_abbreviations():
    for abbreviation in segment.ABBREVIATIONS:
        assert segment.sentences(f"Ask {abbreviation.capitalize()} Smith. Then go.") == [f"Ask {abbreviation.capitalize()} Smith.", "Then go."]
    assert segment.sentences("Apples, pears, etc. They sell Acme Inc. Shares rose.") == ["Apples, pears, etc.", "They sell Acme Inc.", "Shares rose."]


def test_packed_segments_lose_nothing_and_fit():
    import random

    draw = random.Random(4)
    for _ in range(300):
        text = "\n\n".join(" ".join("Word" + " word" * draw.randrange(0, 30) + "." for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 8)))
        got = segment.packed(text)
        assert " ".join(" ".join(got).split()) == " ".join(text.split())
        sizes = [segment.token_count(x) for x in got]
        assert max(sizes) <= 110  # the most, its slack and a last short group
        assert len(got) == 1 or all(a >= 20 or a + b > 90 for a, b in zip(sizes, sizes[1:]))


def test_runs_of_sizes():
    assert segment.runs([5, 5, 30, 3], lambda total, n, size: total + size <= 12, 4, 40) == [[0, 1], [2, 3]]
    assert segment.runs([], lambda *_: True, 1, 1) == [] and segment.runs([1], lambda *_: True, 9, 9) == [[0]]


@pytest.mark.parametrize("accuracy", [10_000, 5])
def test_quantiles_are_exact(spark, accuracy):
    import random

    import numpy as np

    draw = random.Random(9)
    rows = [(k % 3, float(draw.choice([draw.gauss(0, 1), 7, 7]))) for k in range(500)] + [(4, 1.0), (5, 1.0), (5, 2.0), (6, 3.0), (6, 1.0), (6, 2.0), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    shares = (0.25, 0.5, 0.75, 0.0, 1.0)
    got = {r.g: [r[f"q{k}"] for k in range(5)] for r in R.quantiles(df, ["g"], "v", shares, accuracy).collect()}
    for g in {g for g, v in rows if v is not None}:
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g], shares)), g
    assert 7 not in got
    whole = R.quantiles(df, [], "v", (0.3,), accuracy).collect()
    assert np.isclose(whole[0].q0, np.quantile([v for _, v in rows if v is not None], 0.3))


def test_best_pairs_against_brute_force(spark):
    import random

    draw = random.Random(3)
    rows = [(draw.randrange(12), k, draw.choice("ab" if k % 3 else "a")) for k in range(60)] + [(99, 1000, "a")]
    want = {}
    for g in {g for g, _, _ in rows}:
        own = [(k, s) for h, k, s in rows if h == g]
        pairs = [(s == t, a, b) for a, s in own for b, t in own if a < b]
        if pairs:
            want[g] = min(pairs)[1:]
    got = {r.g: (r.left_key, r.right_key) for r in R.best_pairs(spark.createDataFrame(rows, "g int, k int, s string"), ["g"], "k", "s").collect()}
    assert got == want


def test_vector_caches_thresholds_and_samples(spark, tmp_path):
    assert V.selected_threshold({"t": 0.4}, "t") == 0.4
    for bad in ({}, {"t": None}, {"t": 0}, {"t": 1.0}, {"t": "0.5"}, {"t": True}):
        with pytest.raises(ValueError):
            V.selected_threshold(bad, "t")
    assert V.cache_mismatches({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == ["b", "c"]
    calls = []
    make = lambda: calls.append(1) or spark.createDataFrame([(1, [1.0])], "id int, v array<double>")
    for meta in ({"hash": "x", "n": 1}, {"n": 1, "hash": "x"}, {"hash": "y", "n": 1}):
        assert V.cached(spark, f"{tmp_path}/cache", meta, make).count() == 1
    assert len(calls) == 2
    with pytest.raises(ValueError):
        V.shared_vectors(make(), "id", "v", most=4)
    rows = [("g", c, f"{c}{k}") for c, n in (("a", 50), ("b", 3), ("c", 1)) for k in range(n)]
    got = V.balanced_sample(spark.createDataFrame(rows, "g string, c string, k string"), "g", "c", "k", 8, 5).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"a": 4, "b": 3, "c": 1}
    made = V.encode(spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string"), "id", "t", lambda: lambda texts: [[len(t), 1] for t in texts])
    assert {r.id: r.vector for r in made.collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_ordered_hash_over_ranges(spark):
    import hashlib

    df = spark.createDataFrame([(k, f"v{k}") for k in range(25)], "k long, v string").repartition(5)
    part = lambda lo, hi: hashlib.sha256("\n".join(f"{k}:v{k}" for k in range(lo, hi)).encode()).hexdigest()
    want = hashlib.sha256("\n".join([part(0, 10), part(10, 20), part(20, 25)]).encode()).hexdigest()
    assert tuple(V.ordered_hash(df, "k", "v", rows=10).first()) == (want, 25)


def test_trustworthiness_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(30, 4))
    df = spark.createDataFrame([(k, v.tolist(), v[:2].tolist()) for k, v in enumerate(x)], "id int, v array<double>, p array<double>")
    rank = lambda z, i: sorted((j for j in range(30) if j != i), key=lambda j: (round(((z[i] - z[j]) ** 2).sum(), 12), j))
    penalty = sum(max(0, rank(x, i).index(j) + 1 - 6) for i in range(30) for j in rank(x[:, :2], i)[:6])
    got = V.trustworthiness(df.select("id", "v"), df.select("id", F.col("p").alias("v")), "id", "v", 6, block=7).first()[0]
    assert math.isclose(got, 1 - penalty * 2 / (30 * 6 * (60 - 18 - 1)))


def test_register_errors_and_study_years(spark):
    rows = spark.createDataFrame([("r", "A", "endorsed", "D", "2020-01-01", "b"), ("r", "B", "opponent", "R", "2020-02-01", None)], "race_id string, candidate_name string, role string, party string, election_date string, body string")
    none = spark.createDataFrame([], "race_id string, office string, jurisdiction string, state_code string, official_source string")
    got = C.race_registry(rows, {"manual": none}, ("D",)).first()
    assert got.errors and got.unresolved_fields == "office | jurisdiction | state_code | official_source" and got.scope_kind == "in_scope"
    years = spark.createDataFrame([(2019,), (2030,)], "y int")
    assert C.within_years(years, F.col("y"), 2016, 2026, strict=False).count() == 1
    with pytest.raises(Exception, match="outside the study"):
        C.within_years(years, F.col("y"), 2016, 2026, strict=True).collect()
    with pytest.raises(Exception, match="role is required"):
        C.jobs(spark.createDataFrame([("A", "r")], "candidate_name string, race_id string"), strict=True).collect()
    assert C.census_errors(years, "y", "y", (2030,), strict=True).first().severity == "error"


def test_extraction_batch_is_resumable(spark, tmp_path):
    queue = spark.createDataFrame([("a", "https://e.org/issues", None), ("b", "https://gone.org/", None), ("c", "https://e.org/", None)], "key string, url string, archive string")
    attempts = spark.createDataFrame([("c", None, "2020")], "key string, error string, at string")
    made = C.extraction_batch(queue, attempts, fake, limit=10)
    made["captures"].write.parquet(f"{tmp_path}/c")
    assert sorted(r.key for r in made["captures"].collect()) == ["a", "b"]
    assert [(r.key, r.text) for r in made["documents"].collect()] == [("a", "text")] and made["segments"].count() == 1
    again = C.extraction_batch(queue, made["attempts"], fake, limit=10)
    assert [r.key for r in again["captures"].collect()] == ["b"]


def fake(url):
    pages = {"https://e.org/": b'<a href="/issues">i</a><a href="https://other.org/x">o</a>', "https://e.org/issues": b"<p>text</p>"}
    if url == "https://blocked.org/":
        return url, "text/html", b"<TITLE>Just a moment...</title>"
    if url not in pages:
        raise TimeoutError("timed out")
    return url, "text/html", pages[url]


def test_fetch_fallback_and_crawl(spark):
    queue = spark.createDataFrame([("a", "https://gone.org/", "https://e.org/issues"), ("b", "https://gone.org/", None), ("c", "https://blocked.org/", None)], "k string, url string, archive string")
    got = {r.key: r for r in fetch.fetch(queue, "k", ["url", "archive"], fake, 2).collect()}
    assert got["a"].final_url == "https://e.org/issues" and got["a"].byte_count == 11 and "timed out" in got["b"].error and "challenge" in got["c"].error
    sites = spark.createDataFrame([("s", "https://e.org/")], "k string, home string")
    assert sorted(r.url for r in fetch.crawl(sites, "k", "home", fake, lambda u: "issues" in u, 5, 1).collect()) == ["https://e.org/", "https://e.org/issues"]


def test_streaming_upsert_and_ledger(spark, tmp_path):
    schema = "k string, v int, o int"
    spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], schema).write.json(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).json(f"{tmp_path}/in")
    upsert.upsert_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "k", "o").awaitTermination()
    spark.createDataFrame([("a", 5, 3), ("c", 7, 4)], schema).write.mode("append").json(f"{tmp_path}/in")
    upsert.upsert_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "k", "o").awaitTermination()
    assert sorted((r.k, r.v) for r in upsert.latest(spark, f"{tmp_path}/out").collect()) == [("a", 5), ("b", 2), ("c", 7)]
    spark.createDataFrame([("x", "timed out"), ("y", None)], "k string, error string").write.json(f"{tmp_path}/tries")
    ledger = upsert.retry_ledger(spark.readStream.schema("k string, error string").json(f"{tmp_path}/tries"), "k")
    run = ledger.writeStream.format("memory").queryName("ledger_test").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.k, r.tries, r.status) for r in spark.table("ledger_test").collect()) == [("x", 1, "retry"), ("y", 1, "done")]


def test_best_other_against_brute_force(spark):
    import random

    from duolex.plans.relational_queries import best_other

    draw = random.Random(7)
    sets = {o: {draw.randrange(12) for _ in range(draw.randrange(1, 6))} for o in range(120)} | {500: {77}}
    rows = [(o, m) for o, s in sets.items() for m in s]
    want = {}
    for o, s in sets.items():
        n, p = min((-len(s & t), p) for p, t in sets.items() if p != o)
        if n:
            want[o] = (p, -n)
    for few in (10, 3):  # with 3, larger sets are compared by their members
        got = {r.order_key: (r.best, r.overlap) for r in best_other(spark.createDataFrame(rows, "l_orderkey long, m long"), few).collect()}
        assert got == want and 500 not in got


def test_best_other_makes_only_shared_subsets(spark):
    import random

    from duolex.plans.relational_queries import best_other

    draw = random.Random(8)
    sets = [{draw.randrange(40) for _ in range(draw.randrange(1, 7))} for _ in range(80)]
    sets += [{*range(100 + 30 * k, 125 + 30 * k)} for k in range(4)]  # 25 members: too many for all their subsets
    sets += [sets[-1] | {5}, {*range(100, 118)} | {3}] + [sets[k] for k in (3, 3, 20, 80, 81, 81)]
    keys = draw.sample(range(1000), len(sets))
    own = dict(zip(keys, sets))
    want = {}
    for o, s in own.items():
        n, p = min((-len(s & t), p) for p, t in own.items() if p != o)
        if n:
            want[o] = (p, -n)
    rows = [(o, m) for o, s in own.items() for m in s]
    for few in (10, 2):
        got = {r.order_key: (r.best, r.overlap) for r in best_other(spark.createDataFrame([*rows, (None, 3), (2000, None)], "l_orderkey long, m long"), few).collect()}
        assert got == want


def test_pairs_with_a_query_set_are_cut_down_in_their_tasks(spark):
    import hashlib

    import numpy as np
    import pandas as pd

    x = np.random.default_rng(4).integers(-1, 2, (60, 4)) + 0.25  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    asked, u = range(0, 60, 7), x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(a, b, round(float(u[a] @ u[b]), 12)) for a in asked for b in range(60) if a != b]
    near = {a: [(b, s) for _, b, s in sorted((-s, b, s) for o, b, s in pairs if o == a)[:5]] for a in asked}
    close = [(t, hashlib.md5(f"7:{a}:{b}".encode()).hexdigest(), a, b) for a, b, s in pairs for d, t in [min((round(abs(round(s, 6) - t), 9), t) for t in (0.0, 0.5))] if d <= 0.2]
    first = {(a, b, t) for k in (0.0, 0.5) for t, _, a, b in sorted(r for r in close if r[0] == k)[:4]}
    for cells in (1, 40, 10_000):
        q = df.filter("id % 7 = 0")
        assert sorted((r.other, r.id) for r in V.similarities(df, q, "id", "v", least=0.3, cells=cells).collect() if r.id != r.other) == sorted((a, b) for a, b, s in pairs if s >= 0.3)
        got = V.nearest_points(df, q, "id", "v", 5, cells).collect()
        assert {a: sorted([(r.id, r.similarity) for r in got if r.other == a], key=lambda e: (-e[1], e[0])) for a in asked} == near
        assert {(r.other, r.id, r.threshold) for r in V.near_thresholds(df, q, "id", "v", (0.0, 0.5), 0.2, 4, 7, cells).collect()} == first
    rows = pd.DataFrame({"id": range(60), "v": list(x)})
    assert all(s.size <= 90 for _, s in V._blocks(iter([rows]), "id", "v", u[:9], 90))


def test_sentences_are_cut_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(segment, "CUT_BYTES", 40)
    monkeypatch.setattr(segment, "PIECES", 2)
    texts = ["One. Two. Three.", None, "", "Four and more words than fit a slice of so few bytes. Five.\n\nSix", "Ü. Ä."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = sorted(map(tuple, segment.with_sentences(df, "doc_id", "text").collect()))
    assert got == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((s for b in segment.blocks(t or "") for s in segment.sentences(b)), 1)]


def test_sentences_judge_a_stop_by_its_whole_word():
    for letters in (3, 20, 21, 22, 40, 1000):
        name = "A." * letters
        assert segment.sentences(f"Ask {name} Then go. He left") == [f"Ask {name} Then go.", "He left"]
        assert segment.sentences(f"Ask x{name} Then go.") == [f"Ask x{'A.'}", *["A."] * (letters - 1), "Then go."]
    assert segment.sentences("In \ufb06. Paul. By Xst. Paul. Then No. 5 and \u212a. Lee.") == ["In \ufb06. Paul.", "By Xst.", "Paul.", "Then No. 5 and \u212a. Lee."]


def test_sentences_of_texts_with_controls_and_of_none(spark, tmp_path):
    from duolex.plans.scalar_queries import sentences

    assert segment.blocks("a\tb\r\n\u200b\r\nc\x00d\xade\ue000\U0001fae0 \xa0") == ["a b", "c d e \U0001fae0"]
    texts = ["One.\u200bTwo.\x00Three", None, "", " \n\x07\n", "Four. Five.\n\nSix"]
    docs = spark.createDataFrame([*enumerate(texts), (4, "Seven."), (None, "Eight. Nine.")], "doc_id long, text string")
    got = segment.with_sentences(docs.filter("doc_id = 0"), "doc_id", "text").sort("place").collect()
    assert [(r.place, r.text) for r in got] == [(1, "One."), (2, "Two."), (3, "Three")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n for r in sentences(spark, str(tmp_path)).collect()} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 4, None: 2}


def test_keyword_topics_look_for_plain_words_without_patterns(spark):
    import contextlib

    from duolex.operators import stats

    texts = ["The end.", "xthe the_ 9the", "a\tTHE\n", "the", "", None, "cat-cot", "no, ünd und"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    made = stats.keyword_topics(df, "id", "t", (("a", ("the", "no")), ("b", ("c.t", "und"))))
    half = round(1 / math.sqrt(2), 6)
    assert {r.id: (r.topic, r.score) for r in made.collect()} == {0: ("a", half), 1: ("unclassified", 0.0), 2: ("a", half), 3: ("a", half), 4: ("unclassified", 0.0), 5: ("unclassified", None), 6: ("b", half), 7: ("a", half)}
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        stats.keyword_topics(df, "id", "t", (("a", ("the", "no")),)).explain()
    assert "RLIKE" not in told.getvalue()


def test_arriving_batches_have_as_many_files_as_the_input_needs():
    from duolex.plans.scope_queries import batch_files

    assert batch_files(1, 4) == 4 and batch_files(90, 4) == 30 and batch_files(91, 4) == 31


def test_lexical_analysis_reads_its_tokens_once(spark):
    from pyspark.sql.types import ArrayType, StringType

    read = spark.sparkContext.accumulator(0)

    def cut(text):
        read.add(1)
        return text.split()

    df = spark.createDataFrame([(1, "endorsed", "a b a"), (2, "opponent", "b c"), (3, "opponent", "c c a")], "doc_id int, grp string, t string")
    df = df.select("doc_id", "grp", F.udf(cut, ArrayType(StringType()))("t").alias("tokens"))
    made = C.lexical_analysis(df, "doc_id", "grp", "tokens", ("endorsed", "opponent"), least=1)
    assert {k: v.count() for k, v in made.items()} == {"tfidf": 3, "hot_cold": 3, "log_odds": 8, "prevalence": 8} and read.value == 3


def test_knn_of_blocks_that_meet_once(spark):
    import numpy as np

    x = np.random.default_rng(5).integers(-1, 2, (50, 3)) + 0.25  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(a, -round(float(u[a] @ u[b]), 12), b) for a in range(50) for b in range(50) if a != b]
    want = {(a, b) for a in range(50) for _, s, b in sorted(p for p in pairs if p[0] == a and p[1] <= -0.1)[:4]}
    for block, cells in ((7, 20), (25, 1), (50, 10_000)):
        assert {(r.src, r.dst) for r in V.knn(df, "id", "v", 4, 0.1, block, cells).collect()} == want
