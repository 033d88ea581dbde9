"""Problems 1, 6, 7, 8, 9 and 10."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import langid, mixing, textquality
from touchline.llm.bytesview import Words, buffers, slices, word_hash
from touchline.llm.canonical import map_to_list
from touchline.llm.repetition import repeated_share, repetition
from touchline.llm.tokenize import PATTERN, TOKENIZER, Encoder, RankQueue, encoder, read_ranks, token_counts, token_ids
from touchline.llm.vocabulary import learn_vocabulary

LIST = [(1, "Halvar Vexlopzahl", "player"), (2, "Brumulzetti FC", "team"), (3, "Sijuyuk Stadion", "venue"), (4, "Halvar Thalovrsson", "coach"), (5, None, "player"), (None, "X", "team")]


def mapped(spark, values, reference=LIST):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string").withColumn("__key", F.lit(1)).withColumn("ref_id", F.lit(9)).withColumn("score", F.lit("s"))
    ref = spark.createDataFrame(reference, "ref_id long, canonical string, entity_type string").withColumn("league", F.lit("x"))
    got = map_to_list(df, ref, ["id"], "v").collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r.ref_id for r in got}


def test_names_in_many_writings(spark):
    values = ["VEXLOPZAHL", "H. Vexlopzahl", "Vexlopzahl, Halvar", "Halvr Veksopzahl", "Vexlop zahl’s", "brumulzetti and co", "(Brumulzetti FC)", "Sijuyuk", "Thalovrssom", "7. Vexlopzahl (sub)"]
    got = mapped(spark, values)
    assert [got[i] for i in sorted(got)] == [1, 1, 1, 1, 1, 2, 2, 3, 4, 1]


def test_unlisted_values_nulls_and_long_values(spark):
    got = mapped(spark, ["Premier", "Halvar", "!!", None, "  ", "FC", "x" * 50_000, "Vexlopdijk Kröinquet"])
    assert got == {0: -1, 1: -1, 2: -1, 5: -1, 6: -1, 7: -1}


def test_mapping_edges(spark):
    empty = spark.createDataFrame([], "id long, v string")
    ref = spark.createDataFrame(LIST, "ref_id long, canonical string, entity_type string")
    assert map_to_list(empty, ref, ["id"], "v").count() == 0
    some = spark.createDataFrame([(1, "Vexlopzahl"), (1, "Vexlopzahl"), (None, "Sijuyuk")], "id long, v string")
    assert {(r.id, r.ref_id) for r in map_to_list(some, ref, ["id"], "v").collect()} == {(1, 1), (None, 3)}
    assert {r.ref_id for r in map_to_list(some, ref.limit(0), ["id"], "v").collect()} == {-1}
    twins = spark.createDataFrame([(1, "Same Name", "player"), (2, "Same Name", "player")], "ref_id long, canonical string, entity_type string")
    assert map_to_list(spark.createDataFrame([(1, "Same Name")], "id long, v string"), twins, ["id"], "v").first().ref_id == -1


def brute_map(values, names, threshold=0.25, margin=0.15, lead=0.02):
    """The operator's rule by comparing each value with every row; names: id to its one-word name."""
    grams = lambda k: {f"^{k}$"[i : i + 2] for i in range(len(k) + 1)}
    df = {}
    for w in names.values():
        for g in grams(w):
            df[g] = df.get(g, 0) + 1
    idf = lambda g: np.log((len(names) + 1) / (df.get(g, 0) + 1)) + 1
    norm = lambda k: np.sqrt(sum(idf(g) ** 2 for g in grams(k)))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, diag = i, row[0]
            row[0] = i
            for j, y in enumerate(b, 1):
                left = min(row[j] + 1, left + 1, diag + (x != y))
                diag, row[j] = row[j], left
        return row[-1]

    out = []
    for v in values:
        cos = {r: sum(idf(g) ** 2 for g in grams(v) & grams(w)) / norm(v) / norm(w) for r, w in names.items()}
        best = max(cos.values())
        rows = []
        for r, c in cos.items():
            if best >= threshold and c >= threshold and c >= best - margin:
                gap = edits(v, names[r])
                rows.append((gap if gap <= min(len(names[r]) // 3, 3 + len(names[r]) // 12) else 999, -c, r))
        rows.sort()
        sure = rows and rows[0][0] < 999 and not any(x[0] == rows[0][0] and x[1] - rows[0][1] < lead - 1e-12 for x in rows[1:])
        out.append(rows[0][2] if sure else -1)
    return out


def test_mapping_agrees_with_brute_force(spark):
    random.seed(5)
    bits = ["ska", "nd", "rik", "vex", "lo", "pur", "tor", "ein", "gau", "zet"]
    names = {i: "".join(random.choices(bits, k=3)) for i in range(1, 90)}
    names = {i: w for i, w in names.items() if list(names.values()).count(w) == 1}
    letters = "abdeiklnoprstuvxz"

    def misheard(w):
        for _ in range(random.randrange(0, 4)):
            at = random.randrange(len(w))
            w = w[:at] + random.choice(["", random.choice(letters), w[at] + random.choice(letters)]) + w[at + 1 :]
        return w or "x"

    values = [misheard(random.choice(list(names.values()))) for _ in range(250)] + ["".join(random.choices(bits, k=2)) for _ in range(50)]
    got = mapped(spark, values, [(i, w, "team") for i, w in names.items()])
    want = brute_map(values, names)
    assert [got[i] for i in range(len(values))] == want and 100 < sum(x > 0 for x in want) < 300


def test_mapping_is_the_same_with_joins_by_shuffle(spark):
    values = spark.createDataFrame([(i, v) for i, v in enumerate(["Vexlopzahl", "brumulzeti", "Sijuyuk", "other"])], "id long, v string")
    ref = spark.createDataFrame(LIST, "ref_id long, canonical string, entity_type string")
    both = [sorted(map(tuple, map_to_list(values, ref, ["id"], "v", most_broadcast=n).collect())) for n in (0, 500_000)]
    assert both[0] == both[1] and [r[1] for r in both[0]] == [1, 2, 3, -1]


# --- words in buffers ---


def test_words_agree_with_a_regular_expression():
    texts = ["Hej på dig", "", "ÅRDAL’s 3rd", "a", "b", "naïve—café x", "<td>cell</td> <b", "日本 go", "x" * 3000]
    raw, offsets = buffers(pa.array(texts))
    w = Words(raw, offsets)
    got = [[] for _ in texts]
    for s, e, t in zip(w.start, w.end, w.text):
        got[t].append(bytes(raw[s:e]).decode())
    want = [re.findall(r"[^\W\d_]+", re.sub(r"</?[a-z]+>", " ", t)) for t in texts]
    assert got == want
    assert word_hash(["hej"])[0] == w.hash[0] and len(set(w.hash.tolist())) == len({x.lower() for t in want for x in t})
    assert [i for i, j in slices(offsets, 10)][0] == 0


def test_long_writings_of_the_list_are_found(spark):
    name = " ".join(f"{a}{b}rin" for a in "bdfgklmnprst" for b in "aeiou")
    refs = spark.createDataFrame([(1, name, [], "player"), (2, "Torin", [], "player")], "ref_id long, canonical string, aliases array<string>, entity_type string")
    df = spark.createDataFrame([("f", 1, name), ("f", 2, "Torin")], "f string, r long, v string")
    assert len(name) > 200 and {r.r: r.ref_id for r in map_to_list(df, refs, ["f", "r"], "v").collect()} == {1: 1, 2: 2}


# --- repetition ---


def brute(t):
    ws, hit = re.findall(r"[^\W\d_]+", t.lower()), []
    hit = [0] * len(ws)
    seen = set()
    for i in range(len(ws) - 4):
        k = tuple(ws[i : i + 5])
        if k in seen:
            hit[i : i + 5] = [1] * 5
        seen.add(k)
    for k in (1, 2, 3, 4):
        for i in range(k, len(ws) - k + 1):
            if ws[i : i + k] == ws[i - k : i]:
                hit[i : i + k] = [1] * k
    seen, pos = set(), 0
    for u in re.split(r"[\n\r.!?]", t.lower()):
        x = re.findall(r"[^\W\d_]+", u)
        if x:
            if tuple(x) in seen:
                hit[pos : pos + len(x)] = [1] * len(x)
            seen.add(tuple(x))
            pos += len(x)
    return len(ws), sum(hit)


def test_repetition_brute_force():
    random.seed(2)
    texts = ["", "one", "no no no no", "A b. a B! 3. a b?", "the end"]
    for _ in range(400):
        texts.append(" ".join(random.choice(["a", "b", "c", "dd", "E.", "f\n", "7"]) for _ in range(random.randint(0, 40))))
    raw, offsets = buffers(pa.array(texts))
    n, hit, _, _ = repeated_share(raw, offsets)
    assert [(int(a), int(b)) for a, b in zip(n, hit)] == [brute(t) for t in texts]


def test_repetition_operator_edges(spark):
    long = "every word of this sentence differs from all others. " + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{'xy'[i % 2]}" for i in range(15_000))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "goal goal goal goal"), (3, "goal goal goal goal"), (None, "x"), (4, long), (5, long + " " + long)], "id long, text string").withColumn("share", F.lit("x")).withColumn("words", F.lit(0))
    got = repetition(df, "id", "text").collect()
    by = {r.row_id: r for r in got}
    assert len(got) == 7 and by[1].words == by[2].words == 0 and by[3].share == 0.75
    assert by[4].share < 0.05 and 0.49 < by[5].share < 0.51
    assert repetition(df.limit(0), "id", "text").count() == 0


def test_loops_do_not_decide_what_is_prose(spark):
    prose = "the ball goes wide and the keeper takes it slowly"
    rows = [(i, prose, "en") for i in range(20)] + [(i, "Bei Regen", "en") for i in range(20, 60)]
    rows += [(100, prose + ". " + "Bei Regen " * 40, "en"), (101, prose + "\n\n" + "Bei Regen\n\n" * 40, "en"), (102, "Arvo Regen Bei Torin Ulrik " * 40, "en"), (103, "", "en")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    vocabulary = learn_vocabulary(df.where("id < 60"), "text")
    got = {r.row_id: (r.prose, r.share > 0.4) for r in repetition(df.where("id >= 100"), "id", "text", vocabulary).collect()}
    assert got == {100: (True, True), 101: (True, True), 102: (False, True), 103: (False, False)}
    model = langid.fit_model({"en": [prose], "de": ["Bei Regen"]})
    assert {r.row_id: r.prose for r in langid.document_languages(df.where("id >= 100"), "id", "text", "lang", model, vocabulary).collect()} == {100: True, 101: True, 102: False}


# --- tokens ---

needs_files = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no vocabulary files")


def test_rank_queue_gives_the_smallest_rank_then_the_leftmost():
    random.seed(4)
    q, held = RankQueue(300_000), []
    for _ in range(5000):
        if held and random.random() < 0.5:
            held.sort()
            assert q.pop() == held.pop(0)
        else:
            e = (random.choice([0, 63, 64, 4095, 4096, 262_144, 299_999, random.randrange(300_000)]), random.randrange(10**6))
            held.append(e)
            q.push(*e)
    assert [q.pop() for _ in held] == sorted(held) and q.pop() is None


@needs_files
def test_ids_equal_public_libraries():
    tiktoken = pytest.importorskip("tiktoken")
    enc = encoder(read_ranks())
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    random.seed(5)
    texts = ["", " ", "<|endoftext|> it's", "naïve 日本語 😀", "a" * 5000, "ab" * 3000, "\n\n \t x"]
    texts += ["".join(random.choice(["a", "b", "the", " ", "\n", "é", "1", "ing", "'s", "😀"]) for _ in range(random.randint(0, 60))) for _ in range(500)]
    assert [enc.encode(t) for t in texts] == [own.encode_ordinary(t) for t in texts]
    assert b"".join({v: k for k, v in enc.ranks.items()}[i] for i in enc.encode(texts[3])).decode() == texts[3]


def test_merges_pick_the_lowest_rank_not_the_first_pair():
    base = {bytes([b]): b for b in range(256)}
    e = Encoder(base | {b"bc": 300, b"ab": 301, b"abc": 302})
    assert e.piece(b"abc") == [302] and e.piece(b"abab") == [301, 301] and e.piece(b"xbc") == [ord("x"), 300]


@needs_files
def test_token_operator_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x")], "id long, text string").withColumn("ids", F.lit(1)).withColumn("row_id", F.lit("r"))
    got = token_ids(df, "id", "text").collect()
    assert len(got) == 5 and all(r.ids == [] for r in got if r.row_id in (1, 2))
    assert {tuple(r.ids) for r in got if r.row_id == 3} == {tuple(encoder(read_ranks()).encode("hello world"))}
    assert token_ids(df.limit(0), "id", "text").count() == 0
    assert sorted(r.n_tokens for r in token_counts(df, "id", "text").collect()) == [0, 0, 1, 2, 2]


# --- mixing ---


def test_poisson_steps():
    for mean, cap in [(0.3, 1), (0.9, 2), (2.5, 8), (7.9, 8), (0.01, 3), (900.0, 1000), (2500.0, 9000)]:
        steps = mixing.poisson_steps(mean, cap)
        assert len(steps) <= cap and all(a <= b for a, b in zip(steps, steps[1:]))
        assert sum(1 - s for s in steps) == pytest.approx(mean, rel=1e-6)
    assert mixing.poisson_steps(5, 5) == [0.0] * 5 and mixing.poisson_steps(0, 2) == [1.0] and mixing.poisson_steps(1, 0) == []


@needs_files
def test_mixing_meets_shares_and_caps(spark):
    random.seed(6)
    rows = [(i, random.choice(["Big", "big ", "small-one", "SMALL_ONE", "other", None]), "word " * random.randint(1, 30)) for i in range(3000)]
    rows += [(9001, "big", None), (9002, "big", ""), (None, "big", "x"), rows[0]]
    df = spark.createDataFrame(rows, "id long, source string, text string").withColumn("copies", F.lit(1)).withColumn("u", F.lit(1)).withColumn("n_tokens", F.lit("n"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small_one", 0.4, 3), ("absent", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix_sources(df, targets, "id", "source", "text")
    rep = {r.source: r for r in report.collect()}
    assert rep["absent"].actual_share == 0 and rep["absent"].copies == 0
    assert rep["big"].actual_share == pytest.approx(5 / 9, abs=0.01) and rep["small_one"].actual_share == pytest.approx(4 / 9, abs=0.01)
    got = drawn.collect()
    per = {}
    for r in got:
        per.setdefault((r.row_id, r.source), []).append(r.copy_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= {"big": 2, "small_one": 3}[k[1]] for k, v in per.items())
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    again, _ = mixing.mix_sources(df, targets, "id", "source", "text")
    assert again.collect() == got
    assert all(r.source in ("big", "small_one") for r in got)
    none, empty = mixing.mix_sources(df.limit(0), targets, "id", "source", "text")
    assert none.count() == 0 and {r.copies for r in empty.collect()} == {0}


@needs_files
def test_copies_of_a_row_do_not_depend_on_others(spark):
    random.seed(7)
    rows = [(i, "a" if i % 3 else "b", "word " * (1 + i % 20)) for i in range(4000)]
    targets = spark.createDataFrame([("a", 0.5, 6), ("b", 0.5, 6)], "source string, target_share double, max_repeats int")

    def copies(part):
        df = spark.createDataFrame(part, "id long, source string, text string")
        sizes = sum(len(t.split()) for _, _, t in part)
        drawn, report = mixing.mix_sources(df, targets, "id", "source", "text", total_tokens=sizes, corrections=0)
        n = {}
        for r in drawn.collect():
            n[r.row_id] = n.get(r.row_id, 0) + 1
        return n, {r.source: r for r in report.collect()}

    (all_rows, report), (half, _) = copies(rows), copies(rows[:2000])
    # the means of the two draws are nearly the same, and so are the copies of a row
    assert sum(all_rows.get(i, 0) != half.get(i, 0) for i in range(2000)) < 60
    # drawn numbers spread as a Poisson variable's: the variance is the mean
    of_a = np.array([all_rows.get(i, 0) for i in range(4000) if i % 3])
    assert of_a.var() == pytest.approx(of_a.mean(), rel=0.15) and of_a.max() <= 6
    assert report["a"].actual_share == pytest.approx(0.5, abs=0.03)


# --- text types ---

PROSE = ["The keeper holds the ball and the crowd is not happy with that at all.", "There is a yellow card for the captain after the late challenge in the box.", "We have played ten minutes and it is still wide open on the far side."]
NAMES = ["Arvo Vexlop", "Mirko Sijovet", "Nils Thalam", "Oskar Brumul", "Pelle Haskam", "Tomas Rukez"]


def corpus():
    random.seed(8)
    out = []
    for i in range(600):
        out.append((i, " ".join(random.choice(PROSE) for _ in range(random.randint(2, 8))), "prose"))
    for i in range(600, 660):
        out.append((i, "\n".join(f"- {n}" for n in random.choices(NAMES, k=12)), "list"))
    for i in range(660, 720):
        out.append((i, "\n".join(f"{n};{random.randint(0, 900)};{random.randint(0, 900)};{random.randint(0, 900)}" for n in random.choices(NAMES, k=12)), "table"))
    for i in range(720, 780):
        out.append((i, "".join(random.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300)), "junk"))
    return out


def test_text_types(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, " \n "), (9002, "")], "id long, text string").withColumn("kind", F.lit(1)).withColumn("pattern", F.lit(1)).withColumn("blank", F.lit("b"))
    got = {r.row_id: r for r in textquality.text_types(df, "id", "text").collect()}
    wrong = [i for i, _, k in rows if got[i].kind != k]
    assert len(wrong) <= len(rows) // 100
    assert got[9000].kind is None and got[9001].kind is None and got[9002].confidence == 0
    r = got[0]
    assert r.words == len(re.findall(r"\w+", rows[0][1])) and r.punct_line_share == 1.0 and r.p_prose > 0.9
    assert textquality.text_types(df.limit(0), "id", "text").count() == 0


def test_vocabulary_counts_documents(spark):
    df = spark.createDataFrame([("the Arvo the",), ("the cat",), (None,), ("Arvo",), ("",)], "text string")
    v = learn_vocabulary(df, "text", common_share=0.3, known_share=0.3)
    assert sorted(v.common.tolist()) == sorted(word_hash(["the"]).tolist()) and set(v.known.tolist()) == set(word_hash(["the", "arvo"]).tolist())
    # at most one word can be a whole of all (word, text) pairs, at most two can be a half each
    assert len(learn_vocabulary(df, "text", common_share=0.3, known_share=0.3, most=1).known) == 0
    assert len(learn_vocabulary(df, "text", common_share=0.3, known_share=0.3, most=2).known) <= 2


# --- languages ---

SAID = {
    "en": ["the ball is with the keeper and they have to start over", "a long delay before the whistle finally goes in the end", "with nobody closing down he takes one touch too many"],
    "sv": ["bollen studsar lyckligt till höger och det gillar bortafansen", "innan domaren till slut blåser i den andra halvleken", "utan någon press tappar han sin gubbe alldeles för lätt"],
    "de": ["der ball springt glücklich nach rechts und das freut die anhänger", "bevor der schiedsrichter endlich in dieser halbzeit pfeift", "ohne jeden druck verliert er seinen gegenspieler viel zu leicht"],
}


def texts_of(code, n, k=6):
    return [". ".join(random.choice(SAID[code]) for _ in range(k)) for _ in range(n)]


def test_code_lengths_are_a_distribution():
    random.seed(9)
    model = langid.fit_model({c: texts_of(c, 20) + ["Vexlop Arvo"] for c in SAID})
    # all bytes after one context: escapes are not excluded, so their sum may be a little less or more than 1
    for context in (b"\0\0\0\0", b"\0\0\0s", b"\0sch", b"zzzz", b"n de"[:4]):
        high = sum(c << 8 * (4 - i) for i, c in enumerate(context))
        p = np.exp2(-langid.code_lengths(model, np.arange(256, dtype=np.uint64) + np.uint64(high))).sum(axis=0)
        assert (p < 1.7).all() and (p > 0.3).all()


def plain_bits(texts, word, order):
    """Code length of a word by the definition, with dictionaries."""
    seen = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t):
            line = b"\0" * order + w.lower().encode() + b"\0"
            for i in range(order, len(line)):
                for k in range(order + 1):
                    seen.setdefault(line[i - k : i], {}).setdefault(line[i], 0)
                    seen[line[i - k : i]][line[i]] += 1
    line, bits = b"\0" * order + word.encode() + b"\0", 0.0
    for i in range(order, len(line)):
        for k in range(order, -1, -1):
            after = seen.get(line[i - k : i])
            if not after:
                continue
            n, d = sum(after.values()), len(after)
            if line[i] in after:
                bits -= np.log2(after[line[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += 8.0
    return bits


def test_code_lengths_are_exact():
    random.seed(9)
    corpus = {c: texts_of(c, 5) for c in SAID}
    model = langid.fit_model(corpus)
    for word in ["anhänger", "keeper", "xylophon", "bollen", "ééé"]:
        raw, offsets = buffers(pa.array([word]))
        w = Words(raw, offsets)
        code, _ = langid._grams(w, np.arange(1), langid.ORDER)
        got = langid.code_lengths(model, code).sum(axis=0)
        assert got[:3] == pytest.approx([plain_bits(corpus[c], word, langid.ORDER) for c in SAID], abs=1e-9)


def test_one_word_says_no_more_than_its_bound():
    random.seed(9)
    model = langid.fit_model({c: texts_of(c, 20) for c in SAID})
    raw, offsets = buffers(pa.array(["und das freut die anhänger " + "o" * 5000, "", "keeper keeper keeper", "keeper"]))
    bits, size = langid.score(Words(raw, offsets), 4, model)
    assert model.languages[int(np.argmin(bits[0]))] == "de" and size[1] == 0
    assert bits[2].tolist() == bits[3].tolist()
    raw, offsets = buffers(pa.array(["o" * 5000]))
    one, _ = langid.score(Words(raw, offsets), 1, model)
    assert np.ptp(one) <= -np.log2(langid.NOISE) + 1e-9


def test_languages_of_other_scripts(spark):
    random.seed(11)
    said = {
        "el": ["ο τερματοφύλακας κρατά την μπάλα", "το πλήθος δεν είναι ευχαριστημένο", "η άμυνα δεν τα κατάφερε"],
        "ru": ["вратарь держит мяч в руках", "толпа недовольна этим решением", "защита не справилась с ударом"],
        "uk": ["воротар тримає м'яч у руках", "натовп незадоволений цим рішенням", "захист не впорався з ударом"],
    }
    rows = [(i, ". ".join(random.choices(said[c], k=5)), c) for i, c in enumerate([*said] * 20)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = langid.fit_languages(df, "id", "text", "lang", spellings={c: (c,) for c in said})
    held = spark.createDataFrame([(1, "мяч не в руках толпа"), (2, "м'яч у руках натовп захист"), (3, "η μπάλα δεν είναι το πλήθος")], "id long, t string")
    assert model.languages == ("el", "ru", "uk")
    assert {r.id: r.lang for r in langid.score_texts(held, ["id"], "t", model).collect()} == {1: "ru", 2: "uk", 3: "el"}


def test_languages_of_documents(spark):
    random.seed(10)
    rows = [(i, ". ".join(texts_of(c, 1)), c if i % 10 else "en") for i, c in enumerate(["en", "sv", "de"] * 60)]
    rows += [(900, texts_of("sv", 1)[0] + "\n\n" + texts_of("de", 1, 12)[0], "de-DE"), (901, texts_of("sv", 1)[0], "Swedish"), (902, texts_of("sv", 1)[0], None), (903, None, "sv"), (904, " \n\n ", "sv"), (905, "12 34", "sv"), (906, "x" * 100_000, "??")]
    df = spark.createDataFrame(rows, "id long, text string, lang string").withColumn("p", F.lit(1)).withColumn("row_id", F.lit("z")).withColumn("part_no", F.lit(1))
    vocabulary = learn_vocabulary(df, "text")
    model = langid.fit_languages(df, "id", "text", "lang", per_language=50)
    got = {}
    for r in langid.document_languages(df, "id", "text", "lang", model, vocabulary).collect():
        got.setdefault(r.row_id, []).append(r)
    for i, c in enumerate(["en", "sv", "de"] * 60):
        assert got[i][0].doc_lang == c
    mixed = sorted(got[900], key=lambda r: r.part_no)
    assert [r.lang for r in mixed] == ["sv", "de"] and mixed[0].doc_lang == "de" and mixed[0].label_code == "de" and mixed[0].doc_langs == 2
    assert got[901][0].label_code == "sv" and got[902][0].label_code is None and 903 not in got and 904 not in got
    assert got[905][0].doc_lang is None and not got[906][0].prose
    held = langid.score_texts(spark.createDataFrame([(1, "das freut die anhänger sehr und der ball springt"), (2, ""), (3, "Vexlop Arvo")], "id long, t string"), ["id"], "t", model)
    assert {r.id: r.lang for r in held.collect()}[1] == "de"
    one = langid.fit_languages(df.where("lang = 'sv'"), "id", "text", "lang")
    assert one.languages == ("sv",) and langid.score_texts(df.limit(3), ["id"], "text", one).where("lang is not null").count() == 0


def test_language_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["en-GB", "German", " nob ", "und", "", None, "FR", "Spanish", "swe"]], "l string")
    assert [r[0] for r in df.select(langid.language_code(F.col("l"))).collect()] == ["en", "de", "no", None, None, None, "fr", "es", "sv"]
