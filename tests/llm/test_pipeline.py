import corpus_pipeline as cp
from duolex.llm.common import Scratch
from tests.llm.test_corpora import brute_classes
from tests.llm.test_texts import pii_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    scratch = Scratch(spark)
    docs = cp.table(spark, SF, "documents")
    items = cp.table(spark, SF, "benchmark").collect()
    kept = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        kept.append(scratch.save(stage(spark, kept[-1], SF), f"s{k}"))
    assert all(x.columns == docs.columns for x in kept[:-1])
    rows = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in kept[:-1]]
    labels = {r.doc_id: r.quality for r in cp.table(spark, SF, "labels").collect()}
    known = [i for i in rows[0] if i in labels]
    assert sum((i in rows[1]) == (labels[i] == 1) for i in known) >= 0.95 * len(known)
    classes = brute_classes(rows[1].items())
    assert set(rows[2]) == set(classes.values())
    leaks = {i for i, t in rows[2].items() if any(b.text in t for b in items)}
    assert set(rows[3]) <= set(rows[2]) - leaks and len(rows[3]) >= len(rows[2]) - len(leaks) - 2
    assert set(rows[4]) == set(rows[3])
    for i, text in rows[3].items():
        spans = pii_brute(text)
        assert (rows[4][i] == text) if not spans else all(text[a:b] not in rows[4][i] for kind, a, b in spans if kind == "email")
    assert {r.doc_id for r in kept[-1].collect()} == set(rows[4])


def test_stages_on_odd_rows(spark, odd, none):
    """What each stage keeps: the only copies are those of row 1; nothing is rejected, leaked or rewritten but row 9's address."""
    texts = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    kept = {k: sorted((str(r.doc_id), r.text or "") for r in stage(spark, odd, SF).collect()) for k, (_, stage) in enumerate(cp.STAGES[:-1])}
    assert set(kept[0]) <= set(texts) and {i for i, _ in texts if i == "None"} <= {i for i, _ in kept[0]}
    once = set(texts) - {("10", "A plain text of some words, with a few more of them."), ("3", "")}
    assert sorted(set(kept[1])) == sorted(once) and kept[1].count(("None", "")) == 1
    assert kept[2] == texts
    assert [x for x in kept[3] if x not in texts] == [("9", texts[[i for i, _ in texts].index("9")][1].replace("a@b.co", "[EMAIL]"))] and len(kept[3]) == len(texts)
    assert cp.STAGES[-1][1](spark, odd, SF).count() == len(texts)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_other_texts_of_an_id_stay(spark):
    """An id with a clean text and a leak, a copy or junk loses only that."""
    item = cp.table(spark, SF, "benchmark").first().text
    clean = cp.table(spark, SF, "labels").filter("quality = 1 and toxic = 0").join(cp.table(spark, SF, "documents"), "doc_id").orderBy("doc_id").limit(3).collect()
    rows = [(1, clean[0].text), (1, item), (2, clean[1].text), (2, clean[0].text), (3, clean[2].text), (3, "!!! ??? " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in cp.benchmark_decontamination(spark, docs, SF).collect() if r.doc_id == 1) == [clean[0].text]
    assert sorted(r.text for r in cp.ngram_jaccard_join(spark, docs, SF).collect() if r.doc_id == 2) == [clean[1].text]
    assert clean[2].text in [r.text for r in cp.quality_classifier(spark, docs, SF).collect() if r.doc_id == 3]
