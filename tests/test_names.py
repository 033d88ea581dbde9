"""Names: spans, variants, refused candidates, widened queries, cleaning with null keys, language by words, reports."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import similarity as S
from touchline.operators import entity, guards, names, report
from touchline.plans import clean
from touchline.session import cut_lineage
from touchline.sources import json_files

SEGMENT = "match_id string, feed string, half int, segment_id string, ord long, start_time double, end_time double, text string, words array<struct<word:string,prob:double>>, language string"


def test_model_spans_and_what_stands_beside(spark):
    schema = "s string, label string, start int, end int, source string"
    model = spark.createDataFrame([("a", "PERSON", 0, 5, "m"), ("a", "DATE", 10, 14, "m"), ("b", None, 0, 3, "m")], schema)
    heuristic = spark.createDataFrame([("a", "X", 4, 8, "h"), ("a", "X", 5, 8, "h"), ("a", "X", 11, 13, "h"), (None, "X", 0, 5, "h"), ("b", "X", None, 3, "h")], schema)
    got = names.combined_spans(model, heuristic, ["s"], "start", "end", "label", F.lit("en")).collect()
    assert sorted((r.s or "", r.start if r.start is not None else -1, r.source) for r in got) == [("", 0, "h"), ("a", 0, "m"), ("a", 5, "h"), ("a", 11, "h"), ("b", -1, "h")]
    assert names.labelled(model.withColumn("label", F.lit("PER")), "label", F.lit("sv")).count() == 3 and names.labelled(model.withColumn("label", F.lit("PER")), "label", F.lit("en")).count() == 0
    assert names.combined_spans(model.limit(0), heuristic, ["s"], "start", "end", "label", F.lit("en")).count() == 5


def test_real_words_and_tags(spark):
    df = spark.createDataFrame([("With",), ("Kane",), (None,)], "t string")
    words = spark.createDataFrame([("with",), ("WITH",), (None,)], "word string")
    assert {r.t: r.real_word for r in names.real_words(df, "t", words).collect()} == {"With": True, "Kane": False, None: False}
    assert not any(r.real_word for r in names.real_words(df, "t", None).collect())
    tagged = spark.createDataFrame([([(0, 4, "DET"), (5, 9, "PROPN")], ["The", "Kane's", "x"], ["The", "Kane", "'s"], ["DET", "PROPN", "PART"])], "k array<struct<start:int,end:int,pos:string>>, w array<string>, tw array<string>, tt array<string>")
    r = tagged.select(names.tags_at(F.col("k"), F.lit(5)).alias("a"), names.tags_at(F.col("k"), F.lit(4)).alias("b"), names.tags_of_words(F.col("w"), F.col("tw"), F.col("tt")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("PROPN", "", ["DET", "PROPN", ""])


def test_variants_brute_force(spark):
    random.seed(3)
    canonicals = ["Sturridge", "Mamadou Sakho", "Daniel De Ridder", "AIK"]
    words = ["Sturridge", "Starridge.", "sturridge", "Mamadou", "Sakho,", "Sako", "Mamado", "AIK!", "Aik", "the", "Ridder", "'Sakho"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 9))) for _ in range(60)] + [None, ""]
    key = lambda s: "".join(ch for ch in s if ch.isalpha() or ch == " ").strip().lower()
    want = {}
    for c in canonicals:
        n = len(c.split())
        for t in texts if n <= 2 else []:
            w = (t or "").split()
            for i in range(len(w) - n + 1):
                v = key(" ".join(w[i : i + n]))
                if v and w[i][0].isupper() and abs(len(v) - len(key(c))) <= n + 3 and S.indel_ratio_of(v, key(c)) >= 70:
                    want[c, v] = want.get((c, v), 0) + 1
    df = spark.createDataFrame([("m", t) for t in texts], "m string, t string")
    got = names.surface_variants(df, spark.createDataFrame([("m", c) for c in canonicals], "m string, canonical string"), ["m"], "t").collect()
    assert {(r.canonical, r.variant): r.uses for r in got} == want and len(want) > 6
    raw = names.surface_variants(df, spark.createDataFrame([("m", c) for c in canonicals], "m string, canonical string"), ["m"], "t")
    delta = {r.canonical: r for r in names.variant_delta(raw, raw.where("variant = 'sturridge'"), ["m"]).collect()}
    assert delta["Sturridge"].mark == "collapsed" and delta["Mamadou Sakho"].cleaned_variants == 0
    assert names.top_drops(names.variant_delta(raw, raw, ["m"]), ["m"], 2).count() == 2


def test_refused_candidates_by_gate(spark):
    canonicals = spark.createDataFrame([("m", c) for c in ("Sturridge", "Sakho", "Liverpool FC", "Mane")], "match_id string, canonical string")
    found = spark.createDataFrame([("m", t) for t in ("Starridge", "Saturday", "Sturridge.", "sako", "Sako!", "Sakhoo", "Mone", "Often", "Maneover", None, "...")], "match_id string, text string")
    tokens = spark.createDataFrame([("m", "often Often, often. often! (often)")], "match_id string, text string")
    accepted = spark.createDataFrame([("m", "starridge", "STURRIDGE")], "match_id string, original string, corrected string")
    words = spark.createDataFrame([("maneover",)], "word string")
    got = {r.token: r.bucket for r in names.refused_candidates(found, tokens, canonicals, accepted, words).collect()}
    assert "Starridge" not in got and "Sturridge" not in got and "Sakhoo" not in got
    assert got["Mone"] == "mcq_pregate_short_low_fuzz" and got["Saturday"] in ("shortcut_reject_low_cosine", "mcq_pregate_low_fuzz")
    assert got["Maneover"] == "validation_dict_veto" and not {"Sako", "sako"} & set(got)
    assert names.refused_candidates(found.limit(0), tokens, canonicals).count() == 0


def test_widened_queries_and_relevance(spark):
    q = spark.createDataFrame([("a", "goal by Sakho"), ("b", "corner kick"), ("c", "")], "qid string, query string")
    n = spark.createDataFrame([("Mamadou Sakho", "mamadou sako"), ("Mamadou Sakho", "mamado sakho"), ("Eden Hazard", "eden hazzard")], "canonical string, variant string")
    assert {r.qid: r.wider for r in names.expanded_queries(q, n).collect()} == {"a": "goal by Sakho mamado mamadou sako", "b": "corner kick", "c": ""}
    sound = spark.createDataFrame([("a", "hazerd")], "qid string, query string")
    assert names.expanded_queries(sound, n, by_sound=True).first().wider == "hazerd eden hazard hazzard"
    hits = spark.createDataFrame([("a", "x", "Sakho scores"), ("a", "x", "nothing"), ("b", "y", "Sakho again")], "qid string, query string, text string")
    judge = lambda rows: rows["text"].str.contains("Sakho")
    assert names.relevant_hits(hits, judge).count() == 2 and names.relevant_hits(hits).count() == 3
    assert names.relevant_hits(hits, judge, spark.createDataFrame([("b",)], "qid string")).count() == 1


def test_changed_rows_registry_and_telemetry(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (4, None)], "k int, t string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (None, "Z"), (4, "w")], "k int, t string")
    assert sorted((str(r.k), r.before, r.after) for r in names.changed_rows(a, b, ["k"], "t").collect()) == [("2", "y", "Y"), ("4", None, "w"), ("None", "z", "Z")]
    reg = spark.createDataFrame([("m1", "Final", None)], "id string, title string, video string")
    hits = spark.createDataFrame([("m1",), ("m2",), (None,)], "id string")
    assert {r.id: (r.title, r.video) for r in names.with_registry(hits, reg, "id", "title", ["video"]).collect()} == {"m1": ("Final", ""), "m2": ("m2", ""), None: (None, "")}
    d = spark.createDataFrame([("keep", str(i), i) for i in range(7)] + [("drop", "z", 1)], "code string, name string, o int")
    t = {r.code: r for r in names.telemetry(d, "code", "name", ["o"]).collect()}
    assert t["keep"].n == 7 and t["keep"].examples == ["0", "1", "2", "3", "4"] and t["drop"].line == "drop=1 [z]"


def test_cleaning_keeps_rows_with_null_keys(spark):
    rows = [("m", "f", 1, "0", 0, 0.0, 1.0, "One good row here", None, "en"), (None, "f", 1, "0", 0, 0.0, 1.0, "Another good row", None, "en"), (None, None, None, "1", 1, 2.0, 3.0, "Another good row!", None, None), ("m", "f", 1, "9", 2, 5.0, 6.0, " ", None, "en")]
    cleaned, removed = clean.clean(spark.createDataFrame(rows, SEGMENT))
    assert cleaned.count() == 3 and [r.reason for r in removed.collect()] == ["empty_segment"]
    sums = clean.summary(clean.staged(spark.createDataFrame(rows, SEGMENT))).collect()
    assert sorted((str(r.match_id), r.original, r.kept, r.hallucinations, r.duplicates) for r in sums) == [("None", 1, 1, 0, 0), ("None", 1, 1, 0, 0), ("m", 2, 1, 1, 0)]
    assert clean.summary(clean.staged(spark.createDataFrame([], SEGMENT))).count() == 0


def test_language_by_the_words_used(spark):
    df = spark.createDataFrame([("en", "the ball and the goal"), ("sv", "bollen och det är mål"), (None, "what what"), ("sv", None)], "lang string, t string")
    counts = guards.word_counts(df, "t", "lang")
    texts = spark.createDataFrame([(1, "the goal"), (2, "och bollen"), (3, "zzz"), (4, None), (None, "the")], "i int, t string")
    assert {r.i: r.detected for r in guards.detected_languages(texts, ["i"], "t", counts).collect()} == {1: "en", 2: "sv", None: "en"}
    said = spark.createDataFrame([("a", 1, "och det är mål och bollen"), ("b", 1, "short"), ("c", 1, "the ball and the goal")], "m string, o int, t string")
    detect = lambda t: guards.detected_languages(t, ["m"], "t", counts)
    assert {r.m: r.language for r in guards.match_language(said, ["m"], ["o"], "t", detect).collect()} == {"a": "sv", "b": "en", "c": "en"}
    assert {r.language for r in guards.match_language(said, ["m"], ["o"], "t").collect()} == {"en"}


def test_phonetic_score(spark):
    df = spark.createDataFrame([("Sakho", "Sako", "en"), ("Ünal", "Unal", "sv"), ("Kane", "Sturridge", "en"), ("123", "x", "en"), (None, "x", "en")], "a string, b string, lang string").withColumn("__a", F.lit(1))
    got = [r.score for r in S.with_phonetic_score(df.drop("__a"), "a", "b", F.col("lang")).collect()]
    assert got[0] == 100.0 and got[1] == 100.0 and got[2] < 60 and got[3] == 0.0 and got[4] is None
    assert [r[0] for r in spark.createDataFrame([("Ąńț ﬁ",), ("Việt",), (None,)], "a string").select(S.nfkd(F.col("a"))).collect()] == ["Ant fi", "Viet", None]


def test_walkthrough_and_timing(spark):
    t = spark.createDataFrame([("filter", 1, 0.5), ("filter", 2, 0.25), ("ner", 1, 2.0)], "stage string, half int, seconds double")
    text = report.walkthrough(t, spark.createDataFrame([("a", "b")], "original string, text string"), spark.createDataFrame([("c", "d")], "original string, corrected string"))
    assert "| filter | 0.500 | 0.250 |" in text and "| ner | 2.000 | 0.000 |" in text and "- a => b" in text and "- c => d" in text
    took = report.timed([("one", lambda: spark.range(3)), ("two", lambda: spark.range(4))])
    assert set(took) == {"one", "two", "total"} and took["total"] == pytest.approx(took["one"] + took["two"], abs=0.002)


def test_fetched_tries_again_and_falls_back(spark):
    def fetch(key):
        if key == "bad":
            raise OSError("no")
        return f"<{key}>"

    wanted = spark.createDataFrame([("a",), ("bad",), ("a",)], "k string")
    assert {r.k: r.value for r in json_files.fetched(wanted, "k", fetch, tries=2, wait_s=0.0).collect()} == {"a": "<a>", "bad": None}
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("bad", 3), ("other", 4)], "k string, v int")
    assert {(r.k, r.v) for r in json_files.first_answer(wanted, [one, two], "k").collect()} == {("a", 1), ("bad", 3)}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError):
        cut_lineage(Frame())


def test_retrieve_broadcasts_no_list_of_names(spark, tmp_path):
    """Rows exploded from a small file count as small; only the few matches with many queries may be broadcast."""
    path = str(tmp_path / "names")
    spark.createDataFrame([("a", ["Anna Berg", "Bo Lind", "Åsa"]), ("b", ["Anna Borg", "Cy Lund"]), ("c", ["Dag"])], "match_id string, names array<string>").write.parquet(path)
    listed = spark.read.parquet(path).select("match_id", F.explode("names").alias("canonical"))
    q = spark.createDataFrame([(m, x) for m in ("a", "b", None) for x in ("Anna", "berg", "Lund", "Åsa", "Zz", None)] + [("a", "Anna")], "match_id string, query string")
    whole, parts = entity.retrieve(q, listed), entity.retrieve(q, listed, together=1)
    for df in (whole, parts):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
        assert all("LeftOuter" in x for x in joins), joins
    got = sorted(map(tuple, whole.collect()))
    assert got == sorted(map(tuple, parts.collect()))
    assert {(m, x): c for m, x, c, _, n in got if n == 1} == {
        ("a", "Anna"): "Anna Berg", ("a", "berg"): "Anna Berg", ("a", "Lund"): "Bo Lind", ("a", "Åsa"): "Åsa",
        ("b", "Anna"): "Anna Borg", ("b", "berg"): "Anna Borg", ("b", "Lund"): "Cy Lund", ("b", "Åsa"): "Anna Borg",
    }


def test_reduce_to_word_has_the_rows_once(spark):
    """A step that joins the rows with what is made of them doubles the plan, and so does each step after it."""
    df = spark.createDataFrame([("LUND", "Cy Lund"), ("a b", "X Y"), ("x", None), (None, "A B"), ("ab", "zz Ab ab"), ("q", " "), ("ab", "zz Ab ab")], "e string, c string")
    out = entity.reduce_to_word(df, "e", "c", "w")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.w for r in out.collect()] == ["Lund", "X Y", None, "A B", "Ab", " ", "Ab"]


def test_refused_candidates_broadcast_no_list_of_names(spark, tmp_path):
    path = str(tmp_path / "names")
    spark.createDataFrame([("a", ["Anna Berg", "Bo Lind"])], "match_id string, names array<string>").write.parquet(path)
    listed = spark.read.parquet(path).select("match_id", F.explode("names").alias("canonical"))
    found = spark.createDataFrame([("a", "Ana Berg"), ("a", "BO LIND"), ("a", "Zork"), ("a", "Bergo"), (None, "Bergo")], "match_id string, text string")
    said = spark.createDataFrame([("a", "Bergo, Bergo! Bergo Bergo bergo")], "match_id string, text string")
    out = names.refused_candidates(found, said, listed)
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "LeftAnti" in x], joins
    assert [(r.token, r.best, r.freq, r.bucket) for r in out.collect()] == [("Bergo", "Anna Berg", 5, "frequency_heuristic")]


def test_words_are_counted_for_names_only(spark):
    """Words whose hash no name has stay in their task; names are counted a match."""
    said = [("a", "Bergo, (Bergo) bergo! the the the"), ("a", None), ("b", "BERGO  «x»\tthe"), (None, "Bergo"), ("a", "..."), ("a", "")]
    named = spark.createDataFrame([("a", "bergo"), ("a", "ana berg"), ("b", "bergo"), ("b", "lund"), (None, "bergo"), ("a", None)], "match_id string, key string")
    out = entity.uses_of(named, spark.createDataFrame(said, "match_id string, text string"), names.TOKEN_EDGES)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    assert {(r.match_id, r.key, r.freq) for r in out.collect()} == {("a", "bergo", 3), ("b", "bergo", 1), (None, "bergo", 1)}


def test_contexts_rank_without_texts(spark):
    """Neighbours as in the whole order, over halves and the chunks of ranks; only texts that are needed are moved."""
    rows = [("a", 1 + i // 1030, str(i), i, f"t{i}") for i in range(2060)] + [("b", 1, "0", 0, "alone"), (None, 1, "0", 0, "x")]
    seg = spark.createDataFrame(rows, "match_id string, half int, segment_id string, ord long, text string")
    want = [0, 5, 6, 1022, 1023, 1024, 1029, 1030, 2047, 2048, 2059]
    asked = spark.createDataFrame([("a", 1 + i // 1030, str(i)) for i in [*want, 5]] + [("b", 1, "0"), ("b", 1, "none")], "match_id string, half int, segment_id string")
    out = entity.contexts(seg, asked)
    at = lambda i: f"t{i}" if 0 <= i < 2060 else None
    assert sorted((r.match_id, r.previous or "", r.text, r.next or "") for r in out.collect()) == sorted([("a", at(i - 1) or "", at(i), at(i + 1) or "") for i in want] + [("b", "", "alone", "")])


def test_shuffles_of_cut_plans_are_released(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    one = spark.sparkContext._jsc.sc().newShuffleId() + 1
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    cut = cut_lineage(df)
    assert spark.sparkContext._jsc.sc().newShuffleId() > one
    assert not [i for i in range(one, one + 10) if held.contains(i)]
    assert cut.count() == df.count() == cut.count() == 7


def test_refused_candidates_move_no_other_words(spark):
    found = spark.createDataFrame([("a", "Bergo")], "match_id string, text string")
    said = spark.createDataFrame([("a", "Bergo, the the Bergo")], "match_id string, text string")
    out = names.refused_candidates(found, said, spark.createDataFrame([("a", "Anna Berg")], "match_id string, canonical string"))
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.token, r.freq) for r in out.collect()] == [("Bergo", 2)]
