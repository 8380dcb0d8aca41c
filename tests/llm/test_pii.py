"""Spans of personal data against the plain rules, and the classifier's decisions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from slotwise.llm import pii
from slotwise.llm.queries import LLM_QUERIES

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if holds(k, m.group())]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (r, want)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_op7(spark, sf_dir, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = LLM_QUERIES["op7_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def _frame(spark, texts):
    return spark.createDataFrame(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))


def test_hard_texts(spark):
    rnd = random.Random(4)
    alphabet = ["1", "23", "456", "255", "256", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "%", "4111 1111 1111 1111",
                "🎉", "+1 (383) 555-6083", "x@y.zz", "10.0.0.1", "\n", "0007"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))) for _ in range(1500)]
    texts += ["1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "a@" + "b." * 20_000 + "c", "+" + "1-" * 20_000 + "1", "@" * 9, None, "",
              "4111-1111-1111-1111 a@b.c%d@e.f 1.2.3.4.5.6.7.8", "00000000000010.1.1.1 +12345678 +1234567 12+34567890"]
    found = pii.digest(pii.find(_frame(spark, texts), ["doc_id"])).collect()
    assert len(found) == len(texts)
    check(found, dict(enumerate(texts)))


def test_classifier_adds_written_out_addresses_and_leaves_versions(spark):
    texts = [f"mail me: name{i}@host{i}.org now" for i in range(30)] + [f"call +1 555 01{i:02} 4455 today" for i in range(30)]
    texts += [f"version {i}.900.1.2 is out" for i in range(30)] + ["e-mail joe (at) site (dot) com please"]
    texts += ["order 1234567890123 shipped, invoice 1234567890124", "phone: (212) 555-0199 ok", "My card 378282246310005 ok"]
    rows = {r.doc_id: r for r in pii.digest(pii.find(_frame(spark, texts), ["doc_id"])).collect()}
    assert all(rows[i].spans == "" for i in range(60, 90))
    assert [rows[i].spans != "" for i in range(90, 94)] == [True, False, True, True]
    assert all(rows[i].spans.startswith("email:") for i in range(30))


def test_estimates_reliability():
    rnd = np.random.default_rng(2)
    truth = rnd.random(20_000) < 0.4
    right = (0.95, 0.8, 0.6, 0.9)
    votes = np.stack([np.where(rnd.random(len(truth)) < p, truth, ~truth) * 2 - 1 for p in right], axis=1)
    cells, place, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found, tables = pii.estimate_labelers(cells, n.astype(float))
    assert ((found[place.ravel()] > 0.5) == truth).mean() > 0.95
    assert np.allclose([t[1, 2] for t in tables], right, atol=0.03)


def test_masking_and_edges(spark, edge_docs, no_docs):
    texts = ["a@b.org and 10.0.0.1!", None, "", "no data", "+1 (383) 555-6083", "4111 1111 1111 1111 x 🎉 a@b.org"]
    got = {r.doc_id: r.text for r in pii.mask(_frame(spark, texts)).collect()}
    assert got == {0: "<email> and <ip>!", 1: None, 2: "", 3: "no data", 4: "<phone>", 5: "<card> x 🎉 <email>"}
    masked = pii.mask(edge_docs)
    assert masked.columns == edge_docs.columns and masked.count() == edge_docs.count()
    assert pii.mask(no_docs).count() == 0


def test_addresses_of_letters_only_are_proposed(spark):
    texts = ["host abcd:beef:cafe:dead:fade:face:bead:feed up", "host a:b:c:d:e:f:a:b", "ratio of a:b only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [pii.KINDS[s.kind] for s in r.p_spans or []] for r in pii.propose(docs, ["doc_id"]).collect()}
    assert found == {0: ["ip"], 1: ["ip"], 2: []}
