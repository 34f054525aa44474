"""Operators that learn from or join the corpus."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duolex.llm import decontaminate, langid, nearjoin, quality, queries, sharding, toxicity
from duolex.llm.common import Scratch, remainder
from duolex.llm.words import shingles, word_hashes

SF = "/root/testdata/sf0.001"


# ---- sharding ------------------------------------------------------------------------------------------------------


def placed_well(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding_keeps_counts_even_and_copies_together(spark):
    rows = [(i, f"text {i // 3}" if i < 120 else f"own {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(sharding.sizes_of(df), 8).collect()
    assert len(got) == 400
    placed_well(got, 8)
    spread = {}
    text = dict(rows)
    for r in got:
        spread.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(x) > 1 for x in spread.values()) <= 6


def test_sharding_hot_group_and_odd_rows(spark, odd, none):
    hot = spark.createDataFrame([(i, "the same") for i in range(300)] + [(i, f"t{i}") for i in range(300, 600)], "doc_id long, text string")
    placed_well(sharding.shard(sharding.sizes_of(hot), 7).collect(), 7)
    got = sharding.shard(sharding.sizes_of(odd), 4).collect()
    assert len(got) == odd.count()
    placed_well(got, 4)
    assert sharding.shard(sharding.sizes_of(none), 4).count() == 0
    few = sharding.shard(sharding.sizes_of(hot.limit(3)), 40).collect()
    placed_well(few, 40)


def test_sharding_null_keys_link_nothing(spark):
    df = spark.createDataFrame([(i, 10, 0, None) for i in range(50)], "doc_id long, size long, text_crc32 long, key binary")
    placed_well(sharding.shard(df, 4).collect(), 4)


def test_sharding_sizes_and_digests(spark, odd):
    import zlib

    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in sharding.sizes_of(odd).collect()) == want


def cut_pairs(rows, text):
    """Pairs of equal texts, and those of them in different shards."""
    by_text = {}
    for r in rows:
        by_text.setdefault(text[r.doc_id], []).append(r.shard)
    pairs = lambda n: n * (n - 1) // 2
    whole = sum(pairs(len(x)) for x in by_text.values())
    return whole, whole - sum(pairs(n) for x in by_text.values() for n in Counter(x).values())


@pytest.mark.parametrize("bound", [100_000, 5])
def test_sharding_keeps_groups_up_to_a_shard_whole(spark, bound, monkeypatch):
    """200 rows a shard: groups of 180, 90 and 40 rows, pairs for all the rest; nothing is left to fill up with."""
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", bound)
    sizes = [180, 180, 90, 90, 90, 40, 40] + [2] * 345
    rows = [(k, f"group {g}") for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    text = dict(rows)
    got = sharding.shard(sharding.sizes_of(spark.createDataFrame(rows, "doc_id long, text string")), 7).collect()
    placed_well(got, 7)
    whole, cut = cut_pairs(got, text)
    large = [{r.shard for r in got if text[r.doc_id] == f"group {g}"} for g in range(7)]
    assert len(got) == len(rows) == 1400 and cut <= 0.02 * whole and max(map(len, large)) == 1, (whole, cut)


def test_sharding_deals_a_group_over_a_shard_into_few(spark):
    rows = [(k, "the same") for k in range(1000)] + [(k, f"own {k}") for k in range(1000, 4000)]
    got = sharding.shard(sharding.sizes_of(spark.createDataFrame(rows, "doc_id long, text string")), 10).collect()
    placed_well(got, 10)
    assert len({r.shard for r in got if r.doc_id < 1000}) <= 4


def test_sharding_rows_that_are_equal(spark):
    df = spark.createDataFrame([(7, "again")] * 120 + [(None, None)] * 30, "doc_id long, text string")
    placed_well(sharding.shard(sharding.sizes_of(df), 4).collect(), 4)


def linked_families(spark, members):
    """Families of near texts around one sentence each; some members have copies."""
    line = "this sentence stands in every text of family number {} and is the one with the least hash"
    least = {}
    for f in range(80):
        candidates = [line.format(f"{f} {k}") for k in range(40)]
        hashes = spark.createDataFrame([(c,) for c in candidates], "t string").select("t", F.xxhash64("t").alias("h")).orderBy("h").first()
        least[f] = hashes.t
    rows = [(f * 100 + m, f"{least[f]}. and own words {f} {m}") for f in range(80) for m in range(members)]
    return rows + [(i + 50_000, t) for i, t in rows[::7]] + [(90_000 + i, f"short {i}") for i in range(200)]


def family_cut(rows):
    by_family = {}
    for r in rows:
        if r.doc_id < 90_000:
            by_family.setdefault(r.doc_id % 50_000 // 100, []).append(r.shard)
    pairs = lambda n: n * (n - 1) // 2
    whole = sum(pairs(len(x)) for x in by_family.values())
    return whole, whole - sum(pairs(n) for x in by_family.values() for n in Counter(x).values())


@pytest.mark.parametrize("bound", [100_000, 50])
def test_sharding_draws_near_texts_together(spark, bound, monkeypatch):
    """Linked families end in few shards: far below the cut of a placement by hash, and below that of one vote over the first placement."""
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", bound)
    rows = linked_families(spark, 9)
    docs = sharding.sizes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sharding.shard(docs, 8).collect()
    placed_well(got, 8)
    whole, cut = family_cut(got)
    own = sharding.shard(docs.drop("near"), 8).collect()
    placed_well(own, 8)
    assert cut <= 0.05 * whole and family_cut(own)[1] >= 0.5 * whole, (cut, family_cut(own), whole)


def test_sharding_parts_of_a_group_draw_each_other(spark):
    """A text with two and a half shards' rows is dealt into parts that fill whole shards."""
    rows = [(k, "the same text of some length here") for k in range(1000)] + [(k, f"own {k}") for k in range(1000, 4000)]
    docs = sharding.sizes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sharding.shard(docs, 10).collect()
    placed_well(got, 10)
    assert len({r.shard for r in got if r.doc_id < 1000}) <= 4


# ---- n-gram join ---------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {i: set(shingles(t or "").tolist()) for i, t in rows if i is not None}
    text = {i: t or "" for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if (text[a] == text[b]) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(base, k):
    words = base.split()
    words[(k * 7) % len(words)] = f"new{k}"
    return " ".join(words)


@pytest.mark.parametrize("group", [256, 8])
def test_near_classes_against_brute_force(spark, odd, docs, group, monkeypatch):
    monkeypatch.setattr(nearjoin, "GROUP_ROWS", group)
    base = " ".join(f"w{i * 37 % 101}x{i}" for i in range(120))
    chain = [(1000 + k, edited(base, k)) for k in range(40)] + [(1100, base), (1101, base), (1102, base.upper() + " ")]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + chain + [(r.doc_id + 5000, r.text) for r in docs.limit(80).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes, links = nearjoin.near_classes(df)
    got = classes.collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.class_id is None and r.n_links == 0 for r in got if r.doc_id is None)
    assert links.filter("jaccard < 0.8").isEmpty()


def template_rows():
    """Copies of one template that differ in many words each, a few of them with a close partner."""
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in range(5):
            words[(k * 31 + j * 41) % 200] = f"own{k}x{j}"
        rows.append((k, " ".join(words)))
        if k % 6 == 0:
            words[(k * 31 + 100) % 200] = f"late{k}"
            rows.append((1000 + k, " ".join(words)))
    return rows


def brute_links(rows):
    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("group", [256, 8])
def test_near_classes_find_every_pair_of_a_large_group(spark, group, monkeypatch):
    monkeypatch.setattr(nearjoin, "GROUP_ROWS", group)
    rows = template_rows() + [(2000 + k, edited(" ".join(f"w{i * 37 % 101}x{i}" for i in range(120)), k)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, links = nearjoin.near_classes(df, every=True)
    of = {r.cls: r.doc for r in nearjoin.signatures(df, "doc_id", "text").collect()}
    got = [tuple(sorted((of[r.a], of[r.b]))) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_links(rows)


def test_near_classes_count_every_link(spark):
    """50 edited copies that are all near each other have 49 links each; a repeated row is one more."""
    base = " ".join(f"w{i * 37 % 101}x{i}" for i in range(120))
    rows = [(k, edited(base, k)) for k in range(50)] + [(3000, edited(base, 0))]
    got, links = nearjoin.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_links for r in got.collect()} == {k: 50 if k == 0 else 49 for k in range(50)} | {3000: 50}
    assert 49 <= links.count() < 50 * 49 // 2  # some of them lead to all


def hub_rows(draw):
    """300 texts that share much, most of them near each other, a hub that all of 280 others are near, and 200 clean ones."""
    base = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(300):
        words = list(base)
        for j in draw.sample(range(0, 150, 6), draw.randrange(0, 4)):
            words[j] = f"own{k}x{j}"
        rows.append((k, " ".join(words)))
    hub = [f"h{k}" for k in range(200)]
    rows.append((1000, " ".join(hub)))
    for k in range(280):
        words = list(hub)
        for j in draw.sample(range(0, 200, 8), 4):
            words[j] = f"spoke{k}x{j}"
        rows.append((1001 + k, " ".join(words)))
    return rows + [(5000 + k, " ".join(f"clean{draw.randrange(5000)}" for _ in range(60))) for k in range(200)]


def test_near_classes_link_recall_with_a_hub_and_a_group_over_a_block(spark, monkeypatch):
    """At least 0.999 of all links, counted for each document and over all, with and without a measured depth."""
    rows = hub_rows(random.Random(8))
    want = brute_links(rows)
    degree = Counter(x for pair in want for x in pair)
    same = Counter(shingles(t).tobytes() for _, t in rows)
    copies = {i: same[shingles(t).tobytes()] - 1 for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for evidence in (10, 1_000_000):
        monkeypatch.setattr(nearjoin, "EVIDENCE", evidence)
        got = {r.doc_id: r for r in nearjoin.near_classes(df)[0].collect()}
        # links to several copies of one text count once
        links = {i: sum(1 for x in {shingles(dict(rows)[j]).tobytes() for p in want if i in p for j in p if j != i} if x != shingles(dict(rows)[i]).tobytes()) for i in (0, 1000, 1001, 5000)}
        assert all(got[i].n_links >= 0.999 * (copies[i] + n) for i, n in links.items()) and all(got[i].n_links <= copies[i] + n for i, n in links.items())
        assert len({got[i].class_id for i in range(1000, 1281)}) == 1 and sum(degree[i] > 0 and got[i].n_links == 0 for i in got) == 0
        assert {got[i].class_id for i in range(5000, 5200)} == set(range(5000, 5200))


def test_components_join_no_more_edges_than_nodes(spark):
    """Each two of 60 nodes, of a path and of a star are linked, in no order; what meets the labels is a few edges a node."""
    draw = random.Random(4)
    names = draw.sample(range(10**6), 200)
    pairs = list(itertools.combinations(names[:60], 2)) + list(zip(names[60:100], names[61:101])) + [(names[101], x) for x in names[102:190]] + [(names[190], names[191])]
    links = spark.createDataFrame([(b"%06d" % a, b"%06d" % b) for a, b in draw.sample(pairs, len(pairs))], "a binary, b binary")
    scratch = Scratch(spark)
    root = {int(r.node): int(r.root) for r in nearjoin.components(links, scratch).collect()}
    groups = [names[:60], names[60:101], names[101:190], names[190:192]]
    assert root == {x: min(part) for part in groups for x in part}
    assert spark.read.parquet(f"{scratch.root}/edges").count() <= 4 * len(root)
    assert nearjoin.components(links.limit(0), Scratch(spark)).collect() == []


def test_recall_is_measured_on_the_candidates(spark):
    """Pairs of one similarity only: the share that meets at a lower depth follows from it."""
    equal = [0] * (nearjoin._HASHES + 1)
    equal[115] = 3
    asked = spark.createDataFrame([(b"a", equal), (b"b", equal), (b"c", None)], "cls binary, equal array<int>")
    n, share = nearjoin.recalls(asked, 6, 4)
    s = 115 / 128
    assert n == 2 and share.keys() == {6, 5, 4} and all(abs(share[d] - nearjoin.met(s, d) / nearjoin.met(s, 6) * nearjoin.met(s, 6)) < 1e-9 for d in share)


def test_near_classes_of_text_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [("b", base), ("a", base + " end"), ("c", "other words of its own here"), (None, base)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.near_classes(spark.createDataFrame(rows, "doc_id string, text string"))[0].collect()}
    assert got == {"b": ("a", 1), "a": ("a", 1), "c": ("c", 0), None: (None, 0)}


def test_drop_near_copies_tells_texts_of_an_id_apart(spark):
    """An id with two texts keeps both unless they are copies; of equal rows one stays, the least by its columns."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, "x"), (1, "something else altogether in here", "x"), (2, base + " end", "x"), (3, "apart", "z"), (3, "apart", "y"), (4, None, "x"), (4, "", "x")] + [(9, "again", "q")] * 500
    kept = nearjoin.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.text or "", r.lang) for r in kept) == [(1, "something else altogether in here", "x"), (1, base, "x"), (3, "apart", "y"), (4, "", "x"), (9, "again", "q")]


def test_near_copies_under_one_id_are_verified_once_each(spark, monkeypatch):
    """Texts of an id meet only their own candidates: as many texts go into verification under one id as under ids of their own."""
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(120)]
    read = []
    slices = nearjoin.slices
    counter = spark.sparkContext.accumulator(0)

    def counted(batches, texts=1):
        for part, found in slices(batches, texts):
            if texts == 8 - 1:
                counter.add(part.num_rows)
            yield part, found

    monkeypatch.setattr(nearjoin, "slices", counted)
    links = []
    for ids in (range(120), [1] * 120):
        before = counter.value
        links.append(Counter(r.n_links for r in nearjoin.near_classes(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))[0].collect()))
        read.append(counter.value - before)
    assert links[0] == links[1] == {119: 120}
    assert read[0] == read[1] <= 16 * 120


def test_drop_near_copies_keeps_one(spark, odd, none):
    kept = nearjoin.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids)[1] == 1 and 10 not in ids and Counter(ids)[None] == 2 and 5 in ids
    assert nearjoin.drop_near_copies(none).count() == 0


def test_prefix_depth_reaches_its_recall():
    d = nearjoin.prefix_depth()
    assert 1 - (1 - 0.8**d) ** nearjoin.TREES >= nearjoin.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** nearjoin.TREES


def test_words_and_shingles():
    assert len(word_hashes("One two, twoé ONE!")) == 4 and word_hashes("One")[0] == word_hashes(" one.")[0]
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles("?!")) == 0
    assert set(shingles("a b c d e f").tolist()) & set(shingles("z a b c d e").tolist())


# ---- decontamination -----------------------------------------------------------------------------------------------


def test_leaks_exact_edited_and_clean(spark, odd, none):
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20 + k))) for k in range(8)]
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "only three words")], "item_id long, text string")
    filler = " ".join(f"filler{i % 350}" for i in range(700))
    edited_item = items[3][1].split()
    edited_item[4] = edited_item[11] = "changed"
    rows = [(1, f"{filler} {items[0][1]} {filler}"), (2, items[1][1].upper()), (3, f"{filler} {' '.join(edited_item)} end"), (4, filler), (5, " ".join(items[2][1].split()[:8]) + " " + filler), (6, f"{filler} only three words {filler}"), (7, "only words three")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(1, 0), (2, 1), (3, 3), (6, 92)}
    assert decontaminate.find_leaks(odd, benchmark).count() == 0
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.filter("item_id > 89 and item_id < 92")).count() == 0
    assert decontaminate.drop_leaks(odd, benchmark).count() == odd.count()


def test_leaks_past_the_first_near_passage(spark, monkeypatch):
    """An item at word 40, between words of its own in words 0 to 31: each near passage's stretch is looked at."""
    item = " ".join(f"gold{k}" for k in range(10))
    lead = "gold0 gold1 " + " ".join(f"plain{k}" for k in range(38))
    benchmark = spark.createDataFrame([("one", item)], "item_id string, text string")
    docs = spark.createDataFrame([("d", f"{lead} {item} " + " ".join(f"more{k}" for k in range(30))), ("e", lead)], "doc_id string, text string")
    got = decontaminate.find_leaks(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in got] == [("d", "one", 1.0)]
    words = [int(x) for x in word_hashes(f"{lead} {item}")]
    own = decontaminate.Item("one", [int(x) for x in word_hashes(item)], [])
    import numpy as np

    assert own.best(np.array(words, np.uint64), [0, 16])[0] == 1.0


def test_leaks_with_an_answer_column_and_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 4)
    monkeypatch.setattr(decontaminate, "COUNTS", 2)
    items = [(k, " ".join(f"q{k}w{j}" for j in range(30)), f"answer{k} of{k}") for k in range(12)]
    filler = " ".join(f"filler{k % 350}" for k in range(100))
    half = lambda k: " ".join(w if j % 10 < 7 else f"changed{j}" for j, w in enumerate(items[k][1].split()))
    docs = [(1, f"{filler} {half(1)} {filler}"), (2, f"{filler} {half(2)} answer2 of2 {filler}"), (3, f"{filler} {half(3)} answer2 of2"), (4, items[4][1]), (5, items[5][1]), (5, filler), (5, items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    benchmark = spark.createDataFrame([*items, items[4]], "item_id long, text string, answer string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark, answer_col="answer").collect())
    assert got == [(2, 2), (4, 4), (4, 4), (5, 5), (5, 5)]
    kept = decontaminate.drop_leaks(df, benchmark).collect()
    assert sorted((r.doc_id, r.text == filler) for r in kept) == [(1, False), (2, False), (3, False), (5, True)]


def test_leak_recall_by_length_and_changes(spark):
    """Against the longest common subsequence of the whole text: 0.9 at least for every length of item and share of replaced words."""
    draw = random.Random(11)
    pool = [f"{draw.choice('bcdfgklmnprst')}{draw.choice('aeiou')}{draw.choice('bdklmnrst')}{draw.choice('aeiou')}{draw.choice('nrstl')}" for _ in range(1500)]
    say = lambda n: [pool[int(draw.random() ** 2 * len(pool))] for _ in range(n)]
    cases, items, docs = {}, [], []
    for n in (8, 10, 14, 20, 30, 60):
        for share in (0.0, 0.1, 0.19):
            for _ in range(25):
                k = len(items)
                words = say(n)
                items.append((k, " ".join(words)))
                changed = [draw.choice(pool) if j in set(draw.sample(range(n), int(n * share))) else w for j, w in enumerate(words)] if share else words
                at = draw.randrange(200)
                docs.append((k, " ".join(say(at) + changed + say(200 - at))))
                cases[k] = n, share
    clean = [(10_000 + k, " ".join(say(300))) for k in range(300)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    words = {k: [int(x) for x in word_hashes(t)] for k, t in docs}
    total, hit = Counter(), Counter()
    for k, t in items:
        share, answer = decontaminate.Item(k, [int(x) for x in word_hashes(t)], [int(x) for x in word_hashes(t)][-max(3, int(cases[k][0] * decontaminate.ANSWER)) :]).check(words[k])
        if share >= decontaminate.ALONE:
            total[cases[k]] += 1
            hit[cases[k]] += (k, k) in got
    assert all(hit[c] >= 0.9 * total[c] for c in total) and sum(hit.values()) >= 0.97 * sum(total.values()), {c: (hit[c], total[c]) for c in total}
    assert sum(d >= 10_000 for d, _ in got) <= 3


def test_lcs_against_dynamic_programming():
    import random

    rnd = random.Random(5)
    for _ in range(200):
        a, b = [rnd.randrange(6) for _ in range(rnd.randrange(8, 30))], [rnd.randrange(6) for _ in range(rnd.randrange(0, 40))]
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
        assert decontaminate.Item(0, a, a[-3:]).check(b)[0] == row[-1] / len(a)


def test_leaks_are_all_items_in_the_corpus(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op3_latent_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 2


# ---- classifiers ---------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_moments_and_shrinkage_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(200, 3)) @ [[1, 0.5, 0], [0, 2, 0.3], [0, 0, 0.5]]
    y = (x[:, 1] > 0.7).astype(int)
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(y, x)] + [(7, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "y int, a double, b double, c double")
    model = quality.fit(df, "y", ("a", "b", "c"))
    covariances = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * c for k, c in enumerate(covariances))
    logs = []
    for k, c in enumerate(covariances):
        c = (1 - quality.POOLED) * c + quality.POOLED * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + quality.LEAST * np.eye(3)
        gap = x - x[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1] + np.log((y == k).mean()))
    assert np.allclose(model.differences(x), logs[1] - logs[0])


def test_quality_query_columns(spark):
    import zlib

    for r in queries.op4_quality(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_quality_column_scores_equal_the_model(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 2)) * [1, 3]
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(y, x)], "y int, a double, b double")
    model = quality.fit(df, "y", ("a", "b"))
    want = 1 / (1 + np.exp(-np.clip(model.differences(x) / quality.SOFTEN, -50, 50)))
    got = [r[0] for r in df.select(model.score(("a", "b"))).collect()]
    assert np.allclose(got, want)


def test_classifiers_on_odd_rows(odd, none, labels):
    learn = remainder(F.col("doc_id"), 5) != 99
    text = {r.doc_id: r.text or "" for r in odd.filter("doc_id is not null").collect()}
    for made in (quality.score_quality(odd, labels, learn), toxicity.score_toxicity(odd, labels, learn), langid.predict_language(odd, learn)):
        rows = made.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        told = {(text[r.doc_id], tuple(r)[1:]) for r in rows if r.doc_id is not None}
        assert len(told) == len({t for t, _ in told})  # equal texts, equal results; other columns of these names don't matter
    assert {r.score for r in quality.score_quality(odd, labels.limit(0), learn).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0), learn).collect()} == {0.5}
    assert quality.score_quality(none, labels, learn).count() == toxicity.score_toxicity(none, labels, learn).count() == 0
    got = langid.predict_language(odd, learn).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 4, 8))
    assert {r.lang_pred for r in langid.predict_language(odd, F.lit(False)).collect()} == {"und"}
    assert langid.predict_language(none, learn).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_outside_the_families():
    import numpy as np

    x = np.stack([langid.vector(t) for t in ["the thing of the other", "and with that the end", "der die das und nicht", "ein und aus der stadt", "kala on vesi ja maa", "talo ja metsa on iso"]])
    model = langid.train(x, ["en", "en", "de", "de", "fi", "fi"])
    assert set(model.families) == {"germanic", "only fi"}
    assert model.predict(x)[0].tolist() == ["en", "en", "de", "de", "fi", "fi"]


def test_language_of_seventy(spark):
    """Each language has words of its own; all 70 are learned and told apart."""
    draw = random.Random(2)
    words = [["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(70)]
    rows = [(k, " ".join(draw.choice(words[k % 70]) for _ in range(20)), f"l{k % 70:02}") for k in range(70 * 5)]
    got = langid.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.97 * len(rows) and len({r.lang_pred for r in got}) == 70


def test_language_repeated_ids_are_bounded_and_keep_their_own_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 30)
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, langs, families: seen.append(Counter(langs)) or langid.Hierarchy())
    rows = [(1, "der die das und nicht", "de"), (1, "the thing of the other", "en")] + [(2, f"and with that the end {k}", "en") for k in range(3000)] + [(3, "ein und aus der stadt", "de")] * 2000
    langid.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert seen == [{"de": 2, "en": 30}]


def test_toxicity_gradient_is_that_of_the_objective():
    import numpy as np

    texts, labels = biased_sentences(120, 5)
    rows = [sorted(toxicity.features_of(t)) for t in texts]
    names = sorted({f for r in rows for f in r} | {f for t in toxicity.IDENTITY for f in toxicity.features_of(t)})
    data = toxicity.Rows.of(rows, labels, {f: k for k, f in enumerate(names)})
    swap, held = toxicity.swaps_of(rows, names, toxicity.IDENTITY)
    draw = np.random.default_rng(1)
    w, b = draw.normal(size=len(names)) * 0.3, 0.2
    value, slope, bias = toxicity.objective(data, swap, held, w, b, 0.01, 1.0)
    for k in [*held[:6].tolist(), *range(0, len(names), 40)]:
        step = np.zeros(len(names))
        step[k] = 1e-5
        up, down = (toxicity.objective(data, swap, held, w + x, b, 0.01, 1.0)[0] for x in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-6
    up, down = (toxicity.objective(data, swap, held, w, b + x, 0.01, 1.0)[0] for x in (1e-5, -1e-5))
    assert abs((up - down) / 2e-5 - bias) < 1e-6 and value > 0


def test_toxicity_fit_lowers_the_objective():
    import numpy as np

    texts, labels = biased_sentences(1000, 6)
    rows = [sorted(toxicity.features_of(t)) for t in texts]
    names = sorted({f for r in rows for f in r} | {f for t in toxicity.IDENTITY for f in toxicity.features_of(t)})
    model = toxicity.train(rows, labels, names)
    names = list(model.weights)
    data = toxicity.Rows.of(rows, labels, {f: k for k, f in enumerate(names)})
    swap, held = toxicity.swaps_of(rows, names, toxicity.IDENTITY)
    w = np.array([model.weights[f] for f in names])
    value, slope, bias = toxicity.objective(data, swap, held, w, model.bias)
    assert value < 0.3 * toxicity.objective(data, swap, held, w * 0, 0.0)[0] and np.abs(slope).max() < 0.01 and abs(bias) < 0.01


def test_toxicity_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, names, identity: seen.append((len(rows), set(labels))) or toxicity.Model({}, 0.0))
    docs = spark.createDataFrame([(1, f"text number{'abcdefghij'[k % 10]} {k}") for k in range(3000)] + [(2, "the same")] * 3000 + [(3, "a third")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    made = toxicity.fit(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert made.weights == {} and (not seen or seen[0][0] <= 50)


def test_toxicity_swaps_count_less_with_the_penalty():
    groups = ("muslim", "jewish", "christian")
    rows, labels = [], []
    for k in range(200):
        bad = k % 2
        rows.append(sorted(toxicity.features_of(f"{'awful' if bad else 'lovely'} day {groups[0] if bad or k % 10 == 0 else groups[2]} sentence{k % 7}")))
        labels.append(bad)
    names = sorted({f for r in rows for f in r})
    free = toxicity.train(rows, labels, names, groups, fair=0.0)
    fair = toxicity.train(rows, labels, names, groups, fair=20.0)
    gap = lambda m: abs(m.margin(f"a {groups[0]} neighbour") - m.margin(f"a {groups[2]} neighbour"))
    assert gap(fair) < 0.3 * gap(free)
    assert fair.margin("awful day") > 0 > fair.margin("lovely day")


def biased_sentences(n, seed):
    """Sentences of 12 words; toxic ones hold rude words, and six in ten of them name one group, as few others do."""
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = k % 2
        words = [f"plain{''.join(chr(97 + int(c)) for c in str(draw.randrange(400)))}" for _ in range(10)]
        words += [f"{''.join(chr(97 + int(c)) for c in str(draw.randrange(200)))}rude" for _ in range(draw.randrange(1, 3))] if bad else []
        named = draw.random()
        if named < (0.6 if bad else 0.02):
            words.append("muslim")
        elif named > 0.95:
            words.append(draw.choice(toxicity.IDENTITY))
        rows.append(" ".join(words))
        labels.append(bad)
    return rows, labels


def test_toxicity_neutral_mentions_at_default_parameters():
    texts, labels = biased_sentences(4000, 1)
    rows = [sorted(toxicity.features_of(t)) for t in texts]
    model = toxicity.train(rows, labels, sorted({f for r in rows for f in r}))
    fresh, truth = biased_sentences(600, 2)
    scored = [(1 / (1 + math.exp(-model.margin(t + " muslim"))), y) for t, y in zip(fresh, truth)]
    wrong = sum(p >= 0.3 for p, y in scored if not y) / sum(not y for y in truth)
    found = sum(p >= 0.3 for p, y in scored if y) / sum(truth)
    assert wrong < 0.05 and found > 0.95, (wrong, found)


def test_toxicity_swaps_come_from_the_labelled_sentences():
    at = {f: k for k, f in enumerate(("gay", "deaf", "men"))}
    swap = toxicity.swap_matrix([["gay", "day"], ["gay"], ["deaf"], ["day"]], at, ("gay", "deaf", "men"))
    # a third of each sentence's weight goes to each of: left out, either other term
    assert abs(swap - [[7 / 9, -3 / 9, -2 / 9], [-3 / 9, 5 / 9, -1 / 9], [-2 / 9, -1 / 9, 3 / 9]]).max() < 1e-12


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    learned = got.filter("not held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    held = got.filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert learned > 0.95 and held > 0.85
