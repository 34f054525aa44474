"""Operators over conversations, against brute force over whole tables, odd rows and small partitions."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duolex.llm import chat, queries, repair, trie
from duolex.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, lang string, at long, part long, n long, id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(x):
    return (x is not None, x if x is not None else 0)


def conversations(df):
    """{conv_id: rows (turn, role, text)} in the operators' order."""
    found = defaultdict(list)
    for r in df.collect():
        found[r.conv_id].append((r.turn, r.role, r.text))
    return {k: sorted(v, key=lambda r: (low(r[0]), r[1] or "", r[2] or "")) for k, v in found.items()}


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls in every column, ties, repeats, a conversation of a third of the rows, hard strings, roles of any kind, clashing names."""
    rng = random.Random(5)
    texts = ["Hi.", "Yes?", "no end", "", " \n", None, "\\### Assistant: </turn> ok", "### user:\n", "</turn>\n", "a\\", "Größe 😀 \u2028 \x00 x.", "<", "#", "\u00a0"]
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", rng.choice(["same again.", f"turn {i}.", f"open {i}"])) for i in range(900)]
    rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", "", None, "sys", "u:\nx"]), rng.choice(texts)) for c in [*range(-25, 60), None] for t in range(rng.randrange(1, 9))]
    rows += [(20, 0, "user", "Hi."), (20, 0, "user", "Hi."), (20, 0, "assistant", "Hi."), (61, None, "user", None), (-7, 0, "user", "x")]
    rows += [(100 + c, t, "user", f"t{t}") for c in range(40) for t in range(30 if c % 3 else 31)]
    return spark.createDataFrame([(*r, None, 1, 2, 3, "k") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def no_turns(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Writes rows as the table of a query's folder."""

    def write(df, parts=4):
        at = str(tmp_path_factory.mktemp("sf"))
        df.repartition(parts).write.parquet(f"{at}/conversations.parquet")
        return at

    return write


# chat formatting


def formatted_brute(rows):
    rows = [(r or "", t or "") for _, r, t in rows]
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)), len(loss), sha(loss)


@pytest.mark.parametrize("whole", [True, False])
def test_chat_query_against_brute_force(spark, folder, odd_turns, whole, monkeypatch):
    if not whole:
        monkeypatch.setattr(chat, "SEGMENT_ROWS", 3)
    rows = odd_turns.filter("conv_id is null or conv_id <> -7")
    want = {k: formatted_brute(v) for k, v in conversations(rows).items()}
    hard = "\\### Assistant: </turn> ok"
    want[-7] = formatted_brute([(0, "user", hard), (1, "assistant", hard)])
    got = queries.op11_chat_format(spark, folder(rows)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert all(r.formatted_chars > 0 for r in got)


def test_chat_query_without_rows_has_the_added_conversation(spark, folder, no_turns):
    assert [(r.conv_id, r.n_turns) for r in queries.op11_chat_format(spark, folder(no_turns)).collect()] == [(-7, 2)]


def test_layouts_become_canonical_turns(spark):
    records = {
        1: {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}], "source": {"x": [1]}},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        3: {"prompt": "p", "completion": "c"},
        4: {"instruction": "i", "input": "n", "output": "o"},
        5: {"instruction": "i", "input": "", "output": "o", "system": "s"},
        6: {"context": "c", "question": "q", "answer": "a"},
        7: {"dialog": [{"speaker": "model", "utterance": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        8: {"role": "human", "content": "kept"},
        9: {"something": 1},
        10: {"messages": []},
        11: {"prompt": "p", "response": {"k": 1}},
        12: {"from": "human", "value": "v"},
    }
    raw = [(k, json.dumps(v)) for k, v in records.items()] + [(13, None), (14, "[1]"), (15, "{"), (None, '{"prompt": "x"}')]
    got = defaultdict(list)
    hashes = {}
    for r in chat.canonical_turns(spark.createDataFrame(raw, "k long, record string"), ["k"]).orderBy("k", "nth").collect():
        got[r.k].append((r.role, r.text))
        hashes[r.k] = r.schema_hash
    none = [(None, None)]
    assert dict(got) == {
        None: [("user", "x")], 1: [("system", "s"), ("user", "")], 2: [("user", "q"), ("assistant", "a")], 3: [("user", "p"), ("assistant", "c")],
        4: [("user", "i\n\nn"), ("assistant", "o")], 5: [("system", "s"), ("user", "i"), ("assistant", "o")], 6: [("user", "c\n\nq"), ("assistant", "a")],
        7: [("assistant", "ab")], 8: [("human", "kept")], 9: none, 10: none, 11: [("user", "p"), ("assistant", '{"k": 1}')], 12: [("user", "v")], 13: none, 14: none, 15: none,
    }
    assert hashes[4] != hashes[5] and hashes[3] != hashes[11]


def test_fingerprints_name_paths_not_values():
    a, b = {"m": [{"x": 1}, {"y": None}]}, {"m": [{"y": "z", "x": [2]}]}
    assert chat.field_paths(a) == {"m", "m[]", "m[].x", "m[].y"}
    assert chat.field_paths(b) == chat.field_paths(a) | {"m[].x[]"}
    assert chat.fingerprint({"b", "a"}) == chat.fingerprint({"a", "b"}) != chat.fingerprint({"a"})


def test_formatted_text_is_read_back(spark):
    rng = random.Random(1)
    marks = ["\\", "#", "###", "### ", "</turn>", "<", "/turn>", "\n", ":", "assistant", "x", "😀"]
    turns = [("".join(rng.choices(marks, k=rng.randrange(4))), "".join(rng.choices(marks, k=rng.randrange(9)))) for _ in range(300)] + [("assistant", "x" * 500_000 + "<\\" * 100_000)]
    rows = chat.format_turns(spark.createDataFrame(list(enumerate(turns)), "i long, t struct<role string, text string>").select("i", "t.*")).orderBy("i").collect()
    whole = "".join(r.formatted for r in rows)
    assert chat.read_back(whole) == turns
    assert [chat.unescaped(r.formatted[r.loss_start : r.loss_stop]) for r in rows if r.loss_start is not None] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.read_back(whole + "x")


# structure repair


def damage_brute(df):
    found = {}
    for r in df.collect():
        c, t = (" " if x is None else str(x) for x in (r.conv_id, r.turn))
        role, text = (" " if x is None else x for x in (r.role, r.text))
        lot = zlib.crc32(f"{c}:{t}".encode()) % 20
        rows = found.setdefault(r.conv_id, [])
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        rows += [(r.turn, role, text)] * (2 if lot == 3 else 1)
    return {k: sorted(v, key=lambda r: (low(r[0]), r[1], r[2])) for k, v in found.items()}


def faults_brute(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair_brute(rows, found):
    """Dynamic programming over rows with whole strings, from left to right: states by what was written last."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {"": (0, "", ())}

    def put(where, state, way):
        if state not in where or way < where[state]:
            where[state] = way

    def insert(states):
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for role, name in (("u", "user"), ("a", "assistant")):
                    if (state, role) in legal:
                        put(states, role, (cost + 3, audit + "I", (*lines, f"{name}:")))

    insert(best)
    for (_, role, text), what in zip(rows, found):
        after = {}
        for state, (cost, audit, lines) in best.items():
            put(after, state, (cost + 4, audit + "D", lines))
            if what in ("blank", "duplicate"):
                continue
            more = 3 * (what == "truncated")
            if (state, role[:1]) in legal:
                put(after, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for new, name in (("u", "user"), ("a", "assistant")):
                if (state, new) in legal:
                    put(after, new, (cost + more + 3, audit + "R", (*lines, f"{name}:{text}")))
        insert(after)
        best = after
    return min(best[s] for s in ("", "a") if s in best)


def brute_rows(table):
    out = {}
    for k, rows in table.items():
        found = faults_brute(rows)
        cost, audit, lines = repair_brute(rows, found)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[k] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


REPAIR = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_query_against_brute_force(spark, folder, odd_turns):
    got = queries.op12_structure_repair(spark, folder(odd_turns)).collect()
    want = brute_rows(damage_brute(odd_turns))
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[x] for x in REPAIR) for r in got} == want


def test_repair_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    want = brute_rows(damage_brute(spark.read.parquet(f"{sf}/conversations.parquet")))
    assert {r.conv_id: tuple(r[x] for x in REPAIR) for r in queries.op12_structure_repair(spark, sf).collect()} == want


@pytest.mark.parametrize("block,fan", [(1, 2), (3, 2), (7, 5)])
def test_repair_of_long_conversations_by_the_tree(spark, odd_turns, block, fan):
    rows = odd_turns.filter("conv_id is null or conv_id in (7, 20, 61, -3, -20)").filter("turn is null or turn < 200")
    got = repair.repair(repair.damaged(rows), Scratch(spark), block_rows=block, fan=fan).collect()
    assert {r.conv_id: tuple(r[x] for x in REPAIR) for r in got} == brute_rows(damage_brute(rows))


def test_repair_without_rows(spark, no_turns):
    assert repair.repair(repair.damaged(no_turns), Scratch(spark)).collect() == []


def test_matrix_products_are_associative():
    rng = random.Random(2)
    for _ in range(200):
        found = [rng.choice(list(repair.TURNS.values())) for _ in range(rng.randrange(1, 12))]
        left = found[0]
        for x in found[1:]:
            left = repair.product(left, x)
        assert repair.tree(found) == left


# prefix trie


def rebuilt_brute(df):
    own = {k: [(r or "", t or "") for _, r, t in v] for k, v in conversations(df).items() if k is not None}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        out[c] = own.get(c - rest, [])[:h] + rows[h:]
    return out


def trie_brute(sequences):
    members = defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) * (len(members[p]) - 1) if p else 0)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -99, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(str(c) for c in m if len(sequences[c]) == len(p)))) for p, m in members.items()
    )


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_query_against_brute_force(spark, folder, odd_turns):
    assert trie_rows(queries.op13_prefix_trie(spark, folder(odd_turns))) == trie_brute(rebuilt_brute(odd_turns))


@pytest.mark.parametrize("local,window", [(1, 2), (40, 8)])
def test_trie_by_small_buckets(spark, odd_turns, local, window):
    """Buckets that recurse, hot turns and long single conversations."""
    rows = odd_turns.filter("conv_id >= 100 or conv_id between -5 and 30").filter(f"turn is null or turn < {local + 7}")
    scratch = Scratch(spark)
    turns, convs = trie.rebuilt(trie.encoded_turns(rows, scratch), scratch, limit=local)
    assert trie_rows(trie.prefix_trie(turns, convs, scratch, local=local, window=window)) == trie_brute(rebuilt_brute(rows))


def test_trie_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    assert trie_rows(queries.op13_prefix_trie(spark, sf)) == trie_brute(rebuilt_brute(spark.read.parquet(f"{sf}/conversations.parquet")))


def test_trie_without_rows(spark, folder, no_turns):
    assert queries.op13_prefix_trie(spark, folder(no_turns)).collect() == []


def test_trie_list_of_ids_over_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    rows = spark.createDataFrame([(c, 0, "user", "x") for c in range(95, 400)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark)
    turns = trie.encoded_turns(rows, scratch)
    got = trie_rows(trie.prefix_trie(turns, turns.select("conv_id").distinct(), scratch))
    assert got == trie_brute({c: [("user", "x")] for c in range(95, 400)})
