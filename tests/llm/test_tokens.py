import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm import tokens as k


@pytest.fixture(scope="module")
def other():
    """Another library with the same vocabulary."""
    t = Tokenizer.from_file(os.path.join(os.path.dirname(k.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    with open(k.VOCABULARY, "rb") as f:
        return k.Encoder(f.read())


TEXTS = ["", "one", "one\ntwo  \n\n three\n", "\n\n\n", "é ß 漢字 🙂\nÉtat", "a\n" * 50, "<|endoftext|>\nx", "word " * 30_000 + "\nend", "tab\there \n \n x  \n"]


def brute(text, rule, other):
    """Byte by byte, with the other library's tokens."""
    section, owner = 0, []
    for b in text.encode():
        owner.append(section)
        section += b == 10
    n = owner[-1] + 1 if owner else 0
    counts, at = [0.0] * n, 0
    for token in other.encode(text, add_special_tokens=False).tokens:
        size = len(token)  # one character of the vocabulary's alphabet stands for one byte
        mine = owner[at : at + size]
        at += size
        if rule == "start":
            counts[mine[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(mine)), key=mine.count)] += 1
        else:
            for s in mine:
                counts[s] += 1 / size
    assert at == len(owner)
    return counts


@pytest.mark.parametrize("rule", k.RULES)
def test_lines_against_brute_force(rule, own, other):
    for text in TEXTS:
        n, counts, crossing = k.count(text, k.line_cuts(text), own, rule)
        assert n == len(other.encode(text, add_special_tokens=False).ids)
        assert np.allclose(counts, brute(text, rule, other)) and abs(counts.sum() - n) < 1e-9
        assert crossing <= n


def test_operators_and_edges(spark):
    rows = [(1, "one\ntwo", "t"), (2, None, None), (2, None, None), (None, "", "x"), (3, "z " * 100_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string").withColumn("n_tokens", F.lit("clash")).withColumn("_0", F.lit(1))
    got = {r.doc_id: r for r in k.count_lines(docs).collect()}
    assert got[1].n_sections == 2 and sum(got[1].section_tokens) == got[1].n_tokens == 3
    assert (got[2].n_tokens, got[2].n_sections, got[2].section_tokens, got[None].n_tokens) == (0, 0, [], 0)
    assert k.count_lines(docs).count() == 5 and k.count_lines(docs.where("false")).count() == 0
    both = {r.doc_id: r for r in k.count_fields(docs, ["title", "text"], rule="start").collect()}
    assert both[1].section_tokens == [2.0, 3.0] and both[None].section_tokens == [2.0, 0.0]
    with pytest.raises(ValueError):
        k.count_lines(docs, rule="none")


def test_query(spark):
    from quillmesh.llm import queries

    with open(k.VOCABULARY, "rb") as f:
        own = k.Encoder(f.read())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op8_tokens(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        lines = text.split("\n")
        assert r.n_tokens == len(own.encoding.encode_ordinary(text)) == sum(r.section_tokens)
        assert r.n_sections == len(r.section_tokens) == (len(lines) - (lines[-1] == "") if text else 0)
