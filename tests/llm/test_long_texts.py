"""Texts of a megabyte: in seconds, and the same results as plain versions."""

import re
import time

import pytest
from siteline.llm import secrets, toxicity


@pytest.mark.parametrize("n", [1, 15, 16, 17, 400, 70_000])
def test_spans_of_many_matches(spark, n):
    text = "".join(f"token=abcde{i % 7}f é " if i % 3 else "token=ab x " for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.base for r in secrets.found_spans(df).collect()}
    took = time.time() - began
    want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.replace("(?i:(", "((?i:").replace("key))", "key))"), text) if len(m[2]) >= 6]
    assert [tuple(s) for s in got[1]] == want and got[2] == got[3] == []
    assert took < 20  # seconds, Spark's start of the plan included


def test_redacting_many_matches(spark):
    text = "".join(f"a{i} token=abcde{i % 7}f, é " for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, "no secret")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {1: re.sub(r"token=\w+", "[secret]", text), 2: "no secret"} and time.time() - began < 40


def test_hits_under_exceptions_are_linear():
    lex = toxicity.Lexicon({" bad ": 1.0}, [" not bad"])
    auto = lex.automaton()
    text = "not bad and bad " * 65_000  # a megabyte
    began = time.time()
    assert len(lex.hits(auto, toxicity.fold(text))) == 65_000
    assert time.time() - began < 5
    plain = toxicity.fold("bad not bad not badly so not bad bad")
    found = [(e - n + 1, e + 1, w, x) for e, (n, w, x) in auto.iter(plain)]
    excepted = [(s, e) for s, e, _, x in found if x]
    assert lex.hits(auto, plain) == [(s, e, w) for s, e, w, x in found if not x and not any(p <= s and e <= q + 1 for p, q in excepted)]
