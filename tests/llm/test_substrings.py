import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import substrings
from quillon.llm.suffixes import suffix_array

from .conftest import rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array_is_the_order_of_suffixes(x):
    x = [*x, 0]
    assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    shared = " ".join(word() for _ in range(60))
    out = base + [base[0], base[0], base[1][:200] + "X" + base[1][200:], None, "", "short"]
    out += [b[:150] + shared + b[150:] for b in base[2:9]]  # one passage in many texts
    out += ["ab" * 300, "a" * 500, base[3][:90] * 4, "é" * 300]
    return out


@pytest.mark.parametrize("hot", [512, 1])
@pytest.mark.parametrize("length", [100, 37, 1])
def test_spans_are_those_of_brute_force(table, monkeypatch, length, hot):
    monkeypatch.setattr(substrings, "HOT_RUNS", hot)
    t = texts() if length > 1 else texts()[:3]
    got = {r.doc_id: (r.n_bytes, sum(b - a for a, b in r.spans), bytes(r.kept)) for r in substrings.repeats_removed(table(rows(t)), length=length).collect()}
    assert [got[i] for i in range(len(t))] == brute(t, length)


def test_long_texts_are_cut_into_pieces(table, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    t = [" ".join(f"w{i * 7919 % 1009}" for i in range(600)), " ".join(f"w{i * 7919 % 1009}" for i in range(300, 900)), "x"]
    got = {r.doc_id: (r.n_bytes, sum(b - a for a, b in r.spans), bytes(r.kept)) for r in substrings.repeats_removed(table(rows(t)), length=60).collect()}
    assert [got[i] for i in range(3)] == brute(t, 60)


def test_stage_keeps_columns_and_whole_characters(clash):
    t = ["é" * 5 + "abcdefgh" * 3, "ß" * 5 + "abcdefgh" * 3, None, "clean text"]
    df = clash(t)
    out = substrings.dedup_stage(df, 7)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3] == "clean text" and "abcdefgh" not in got[0] + got[1] and got[2] == ""


def test_empty_table(table):
    assert substrings.repeats_removed(table([])).count() == 0


def test_query_digest(table, spark, tmp_path):
    t = ["q" * 450, "q" * 450, "z"]
    table(rows(t)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in substrings.op1_suffix_dedup(spark, f"file://{tmp_path}").collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {0: (450, 450, 1, none, ""), 1: (450, 450, 1, none, ""), 2: (1, 0, 0, hashlib.sha256(b"z").hexdigest(), "z")}
