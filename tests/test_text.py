"""Scalar functions on single values."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.functions import similarity as S
from touchline.functions import text as T
from touchline.plans import q_text


def one(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{c} {'string' if isinstance(v, str) or v is None else 'double'}" for c, v in zip(cols, values))).select(f(*map(F.col, cols)).alias("x")).first()[0]


@pytest.mark.parametrize("text, want", [("", 0.0), ("   ", 0.0), ("3 on 2", 0.5), ("Åsa", 1.0), ("abc123", 0.5), ("日本", 0.0)])
def test_alpha_ratio(spark, text, want):
    assert one(spark, T.alpha_ratio, text) == want


@pytest.mark.parametrize("text, want", [(None, "empty_segment"), (" ", "empty_segment"), ("good мяч", "non_latin_characters"), ("12 34 a", "low_alpha_ratio (0.20)"), ("3 on 2", None), ("Great save", None)])
def test_removal_reason(spark, text, want):
    assert one(spark, T.removal_reason, text) == want


@pytest.mark.parametrize("text, want", [("hi hi", "hi hi"), ("hi hi hi", "hi"), ("Go GO go now", "Go now"), ("a  b c", "a b c"), ("x y y z", "x y y z"), ("no no no no way way", "no way way")])
def test_collapse_repeats(spark, text, want):
    assert one(spark, T.collapse_repeats, text) == want


def test_normalise_keeps_two_word_forms(spark):
    f = lambda c: T.normalise(c, F.lit("en"))
    assert one(spark, f, "Um, at half time the goal keeper!! waits  for a kick off") == ", at half time the goalkeeper! waits for a kick-off"
    assert one(spark, lambda c: T.normalise(c, F.lit("de")), "off side") == "off side"


def test_disfluencies_need_word_ends(spark):
    assert one(spark, T.drop_disfluencies, "åum um umbrella") == "åum  umbrella"


def test_name_variants(spark):
    got = one(spark, T.name_variants, "Mads Döhr Thychosen")
    assert got == ["Mads Döhr", "Mads Thychosen", "Döhr Thychosen", "M. Thychosen", "M.D. Thychosen"]
    assert one(spark, T.name_variants, "Two Words") == []
    assert one(spark, T.surname, "Kevin De Bruyne") == "De Bruyne"


@pytest.mark.parametrize("text, core", [("Sakho's.", "Sakho"), ("Kane and Co!", "Kane"), ("..Mane", "Mane"), ("Guidettis", "Guidettis"), ("", ""), ("...", "")])
def test_entity_core(spark, text, core):
    assert one(spark, T.entity_core, text) == core


def test_rebuild_keeps_what_surrounds(spark):
    f = lambda lang: lambda a, b: T.rebuild_entity(a, b, F.lit(lang))
    assert one(spark, f("en"), "Sako's.", "Sakho") == "Sakho's."
    assert one(spark, f("sv"), "Gidettis", "Guidetti") == "Guidettis"
    assert one(spark, f("en"), "Gidettis", "Guidetti") == "Guidetti"


@pytest.mark.parametrize("a, b, want", [("williams", "willian", 80.0), ("saturday", "sturridge", 58.8235), ("kane", "mane", 75.0), ("storage", "sturridge", 62.5), ("starridge", "sturridge", 88.8889), ("", "", 100.0), ("a", "", 0.0)])
def test_indel_ratio(spark, a, b, want):
    assert S.indel_ratio_of(a, b) == pytest.approx(want, abs=1e-3)
    assert one(spark, S.indel_ratio, a, b) == pytest.approx(want, abs=1e-3)


def test_word_edits_agree_with_plain_distance():
    import random

    random.seed(3)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 14))] for _ in range(2))
        s, i, d, h = S.word_edits(a, b)
        assert s + i + d == S.edit_distance(a, b)
        assert s + d + h == len(a) and s + i + h == len(b) and min(s, i, d, h) >= 0


@pytest.mark.parametrize("o, n, mask, want", [("a b c", "a x c", [False, True, False], False), ("a b c", "a x c", [False] * 3, True), ("a b", "a b c", [True, True], True), ("a, b", "a b", [False, False], False), ("", "", [], False)])
def test_editable_drift(spark, o, n, mask, want):
    df = spark.createDataFrame([(o, n, mask)], "o string, n string, m array<boolean>")
    assert df.select(T.word_count_changed_or_drift(F.col("o"), F.col("n"), F.col("m"))).first()[0] is want


def test_model_output_cleaning(spark):
    assert one(spark, T.clean_output, 'Output: "Goal by Kane."') == "Goal by Kane."
    assert one(spark, T.clean_output, "Goal by Kane.\nmore") == "Goal by Kane."
    assert one(spark, T.prompt_echo, "Players: x") is True
    assert one(spark, T.length_anomaly, "a b c d", "a") is True
    assert one(spark, T.unwrap, "by <Sako> now") == "by Sako now"


@pytest.mark.parametrize("text, want", [("1:02:03", 3723.0), ("2:30", 150.0), ("45", 45.0), ("x", None)])
def test_hms(spark, text, want):
    assert one(spark, T.hms_seconds, text) == want


def test_restore_punctuation_only_inserts(spark):
    df = spark.createDataFrame([("kane shoots wide. what a miss", ["", "", "", "", "", "?"])], "t string, l array<string>")
    assert df.select(T.restore_punctuation(F.col("t"), F.col("l"))).first()[0] == "Kane shoots wide. What a miss?"


def test_metaphone_and_phonetic(spark):
    assert S.metaphone_of("Thompson") == S.metaphone_of("Thomson") or S.metaphone_of("Thompson")[:1] == "0"
    assert S.metaphone_of("Knight") == S.metaphone_of("Night")
    df = spark.createDataFrame([("Müller", "Muller")], "a string, b string")
    assert S.with_phonetic_score(df, "a", "b", F.lit("en")).first().score == 100.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_capitalised_words_are_counted_with_joins(spark):
    name = re.compile(r"\b([A-ZÅÄÖÆØ][a-zà-ÿ]+(?:['-][A-Za-zÅÄÖÆØà-ÿ]+)*)\b")
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/segments.parquet").where("text is not null").select("seg_key", "text").collect()
    assert Counter((r.seg_key, r.found) for r in q_text.p7_all(spark, folder).collect()) == Counter((r.seg_key, len(name.findall(r.text))) for r in rows)
    assert one(spark, T.capitalised_words, "Ulrik-Ruketdijk and Sijopqvist's x") == ["Ulrik-Ruketdijk", "Sijopqvist's"]
