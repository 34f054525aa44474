"""The registered queries' own columns over a whole table, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from duolex.llm import queries
from tests.llm.conftest import SF
from tests.llm.test_corpora import brute_classes
from tests.llm.test_texts import pii_brute, tiktoken_encoding


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def digest(spans, kinds):
    """Kind:start:end by start, then kind as listed."""
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))))


def test_op2_columns(spark, texts):
    rows = queries.op2_label_propagation(spark, SF).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts)
    held = Counter(r.shard for r in rows)
    assert set(held) <= set(range(40)) and max(held.values()) - min(held.get(s, 0) for s in range(40)) <= 1
    assert Counter((r.shard, r.slot) for r in rows) == Counter((s, k) for s, n in held.items() for k in range(n))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_op6_columns(spark, texts):
    classes = brute_classes(texts)
    rows = queries.op6_ngram_jaccard(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes and len(rows) == len(texts)
    copies = Counter(t for _, t in texts)
    by_id = dict(texts)
    assert all(r.n_links >= copies[by_id[r.doc_id]] - 1 for r in rows)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_brute(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def test_op8_columns(spark, texts):
    kinds = ("assign", "access", "hex")
    want = {i: secrets_brute(t) for i, t in texts}
    for r in queries.op8_secret_scan(spark, SF).collect():
        spans = want[r.doc_id]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert r.base_sha256 == digest(spans, kinds)
        told = set(r.spans.split(",")) if r.spans else set()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= told and len(told) == len(spans) + r.n_random


def test_op9_columns(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    want = {i: pii_brute(t) for i, t in texts}
    for r in queries.op9_personal_data(spark, SF).collect():
        spans = want[r.doc_id]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert r.base_sha256 == digest(spans, kinds)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= (set(r.spans.split(",")) if r.spans else set())


def test_op10_columns(spark, texts):
    own = tiktoken_encoding()
    want = {}
    for i, t in texts:
        ids = own.encode_ordinary(t)
        want[i] = len(ids), sha(",".join(map(str, ids))), sha(t)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, SF).collect()} == want
