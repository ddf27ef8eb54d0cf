import random

import pytest
from pyspark.sql import functions as F

from quillmesh.config import EngineConfig, whole_number
from quillmesh.functions import keys, similarity, text
from quillmesh.plans.parser import Term, arms_of, parse

GOLDEN = {
    "journals/frai/MarquesSilvaI23": "Marques2023",
    "conf/aaai/IgnatievNM19": "Ignatiev2019",
    "conf/ijcai/ShihCD18": "Shih2018",
    "conf/aaai/DarwicheJ22": "Darwiche2022",
    "journals/ai/Miller19": "Miller2019",
    "conf/aiia/IgnatievNA020": "Ignatiev020",
    "conf/kdd/Ribeiro0G16": "Ribeiro2016",
    "conf/nips/VaswaniSPUJGKP17": "Vaswani2017",
    "journals/nature/LeCunBH15": "Le2015",
    "journals/corr/abs-1706-03762": "abs-1706-03762",
    "conf/x/Smith49": "Smith2049",
    "conf/x/Smith50": "Smith1950",
    "books/Ab1234567": "Ab1234",
    "conf/x/ABC99": "ABC99",
}


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_citation_keys(spark):
    got = values(spark, [(k,) for k in GOLDEN], "k string", "k", keys.citation_key(F.col("k")))
    assert dict(got) == GOLDEN


def test_record_keys(spark):
    config = EngineConfig("bib.example", ("https://mirror.example",))
    rows = [("https://bib.example/rec/a/B1", "bib:x", None), ("https://mirror.example/rec/a/B1", None, None), ("http://bib.example/rec/a/B1", None, None), (None, "bib:a/B2", "bib:y"), ("", None, "bib:a/B3"), (None, None, None)]
    got = values(spark, rows, "u string, k string, i string", keys.record_key(F.col("u"), F.col("k"), F.col("i"), config))
    assert [x for (x,) in got] == ["a/B1", "a/B1", "http://bib.example/rec/a/B1", "a/B2", "a/B3", ""]
    given = [" a/B1.bib ", "bib.example/rec/a/B1", "https://mirror.example/rec/a/B1.bib", "http://bib.example/rec/a", "a/B1"]
    got = values(spark, [(g,) for g in given], "k string", keys.clean_key(F.col("k"), config))
    assert [x for (x,) in got] == ["a/B1", "a/B1", "a/B1", "a", "a/B1"]
    assert values(spark, [("a:b",), ("a",), (" ",), (None,)], "k string", keys.candidate_keys(F.col("k"))) == [(["a:b", "a/b"],), (["a"],), ([],), ([],)]


def test_rekeying_is_literal_and_once(spark):
    rows = [("% x\n@book{old1,\n a = {old1,}}\n@misc{two,}",), ("@article{REC:k,\n}",), ("no head",), ("",), (None,)]
    got = values(spark, rows, "b string", keys.rekey(F.col("b"), F.lit("n$1\\")), keys.rekey_from(F.col("b"), F.lit("conf/x/Smith19")))
    assert got[0] == ("% x\n@book{n$1\\,\n a = {old1,}}\n@misc{two,}", rows[0][0])
    assert got[1] == ("@article{n$1\\,\n}", "@article{Smith2019,\n}")
    assert got[2:] == [("no head", "no head"), ("", ""), (None, None)]


def test_text(spark):
    rows = [("  a b\t\n", "100%_x"), ("", ""), (None, None)]
    got = values(spark, rows, "a string, b string", text.strip(F.col("a")), text.blank(F.col("a")), text.holds(F.col("b"), "%_X"), text.words(F.col("a")))
    assert got == [("a b", False, True, ["a", "b"]), ("", True, False, []), (None, True, None, None)]


def test_or_and_fields():
    assert arms_of("a or b") == arms_of("a OR b") == ["a", "b"]
    assert arms_of(" or ") == [] and arms_of("x or or y") == ["x", "or y"] and arms_of("a\tor\tb") == ["a\tor\tb"]
    assert parse("Deep AND author:Smith (x)") == [[Term("deep"), Term("smith", "author"), Term("x")]]
    assert parse("title:war or year:1999") == [[Term("war", "title")], [Term("1999", "year")]]
    assert parse("title:and") == [[Term("and", "title")]] and parse("and") == [[]]


def test_bounds_hold(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice("abcd ef") for _ in range(rng.choice([0, 3, 12, 40, 230]))),) for _ in range(400)]
    for query in ("abc dab cafe", "", "ddddddddddd"):
        got = values(spark, rows, "t string", "t", similarity.bound(query, F.col("t")), similarity.ratio_udf(query)(F.col("t")), similarity.may_reach(query, F.col("t"), 0.6))
        assert all(b >= r for t, b, r, _ in got if query or t) and all(m or r < 0.6 for _, _, r, m in got)
        assert [r for *_, r, _ in got] == [similarity.ratio(query, t) for (t,) in rows]


def test_ratio_is_not_symmetric():
    assert similarity.ratio("tide", "diet") == 0.25 and similarity.ratio("diet", "tide") == 0.5


def test_whole_numbers():
    assert whole_number("n", 3.0) == 3
    for bad in (-1, 2.5, "x", None, True):
        with pytest.raises((ValueError, TypeError)):
            whole_number("n", bad)


def test_matched_equals_its_definition():
    """The ratio where it reaches the least, 0 elsewhere; also for texts whose popular characters are left out."""
    from difflib import SequenceMatcher

    rng = random.Random(1)
    for n in range(600):
        a = "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 60 if n % 3 else 400)))
        b = "".join(rng.choice([c, c, c, "x", ""]) for c in a) if n % 2 else "".join(rng.choice("abcd ef") for _ in range(rng.randint(0, 500 if n % 5 == 0 else 50)))
        want, least = SequenceMatcher(None, a, b).ratio(), rng.choice([0.0, 0.3, 0.5, 0.8])
        assert similarity.matched(a, b, least) == (want if want >= least else 0.0)
