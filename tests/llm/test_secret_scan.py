import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.llm import automaton as at
from inkspan.llm import secret_scan as ss

RUNNER = ss.Runner(at.compiled(ss.BASE + ss.ADDED))


def brute(text, rules):
    """By each rule's own expression as stated, filtered afterwards."""
    out = []
    for r, rule in enumerate(rules):
        pattern, least = {"access": ("AKIA[A-Z0-9]+", 16), "hex": ("[0-9a-f]+", 32)}.get(rule.kind, (rule.pattern, rule.least))
        for m in re.finditer(pattern, text, re.IGNORECASE if rule.nocase else 0):
            if len(m[rule.group]) >= least:
                out.append((m.start(), r, m.end()))
    return sorted(out)


PIECES = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "token", "'", '"', " ", ":", "=", "abcdef01" * 4, "abcdefgh", "0123456", "AKIA", "ABCDEFGH0123", "ghp_", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "é", "\n", "-", "_", "zz", "ſ", "K"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_same_as_expressions(text):
    rules = ss.BASE + ss.ADDED
    fold = text.replace("ſ", "?").replace("K", "?")  # letters outside A-Z that re folds
    assert ss.findings(RUNNER, fold.encode()) == brute(fold, rules)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=30))
def test_automaton_and_minimum(text):
    rule = at.Rule("x", "a(b|ab)*b?a{2,3}")
    ahead = at.build([at.parse(rule.pattern)], search=False)
    s = 0
    for c in text.encode():
        s = ahead.moves[s * ahead.classes + ahead.class_of[c]]
    assert bool(ahead.accepts[s]) == bool(re.fullmatch(rule.pattern, text))


def test_minimised_has_no_equal_states():
    a = at.build([at.parse("(a|b)*abb"), at.parse("a?bb")], search=True)
    rows = a.moves.reshape(-1, a.classes)
    part = a.accepts.copy()
    for _ in range(len(part)):
        part = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)[1].reshape(-1)
    assert len(set(part.tolist())) == len(part)


def test_documents_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é token='abcdefgh' " + "a" * 100_000), (-3, "é token='abcdefgh'"), (None, "Token : short")], "doc_id long, text string")
    rows = docs.union(more).withColumn("spans", docs.doc_id)
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    got = sorted(map(tuple, ss.scan(rows).collect()), key=repr)
    want = []
    kinds = [r.kind for r in ss.BASE + ss.ADDED]
    for doc, text in texts:
        found = brute(text or "", ss.BASE + ss.ADDED)
        say = lambda x: ",".join(f"{kinds[r]}:{a}:{z}" for a, r, z in x)
        base = [x for x in found if x[1] < 3]
        want.append((doc, *(sum(r == k for _, r, _ in base) for k in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(found), len(found) - len(base)))
    assert got == sorted(want, key=repr)
    assert sum(r[1] for r in got) > 10
    assert ss.scan(docs.limit(0)).collect() == []
