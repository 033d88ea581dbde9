"""Transcript segments with loose speaker labels to turns of known speakers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.utterance import folded, spoken, without_hesitations
from touchline.operators.closewords import close_pairs
from touchline.operators.ordered import KEY, entity, millis, with_previous, with_rank, with_running_max
from touchline.session import cut_lineage

TIME_MARK = r"[<\[(]\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[>\])]|(?<![\p{L}\p{N}])\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:\s+-(?=\s|$))?"
ANNOTATION = r"\(\([^()]*\)\)|\([^()]*\)|\*[^*]*\*|♪[^♪]*♪|♪|\[[^\[\]]*\]|<[^<>]*>|>>"
NAME = r"(?:\p{L}\.?[  ]+|\p{L}[\p{L}\p{M}'’-]+[  ]+)?\p{L}[\p{L}\p{M}'’-]+"
LABEL = (
    r"(?iU)(?:>>\s*)?(?:\[\s*(?:spk|speaker)[_ ]?\d+\s*\]|\b(?:speaker|spk)[_ ]?\d+\s*:"
    r"|<[^<>]{2,80}>|\[[^\[\]]{2,80}\]"
    rf"|(?<![\p{{L}}\p{{N}}'’]){NAME}(?:\s*\([^()]{{2,40}}\))?\s*:"
    r"|(?<![\p{L}\p{N}'’])\p{L}\.?[  ]+\p{L}[\p{L}\p{M}'’-]+\s+-(?=\s|$))"
)


def label_key(c: Column) -> Column:
    """'#7' for numbered labels, else folded words of the name, the duty left out."""
    c = F.regexp_replace(folded(c), r"\([^()]*\)", " ")
    number = F.regexp_extract(c, r"(?:spk|speaker)[_ ]?0*(\d+)", 1)
    name = F.trim(F.regexp_replace(c, r"(?U)[^\p{L}]+", " "))
    return F.when(number != "", F.concat(F.lit("#"), number)).otherwise(name)


def slips(a: Column, b: Column) -> Column:
    """Edits by which surnames of these lengths may differ: a letter in four, three at most."""
    return F.least(F.floor(F.greatest(a, b) / 4), F.lit(3)).cast("int")


def _name(key: Column) -> tuple[Column, Column]:
    """Initial ('' if none) and surname of folded words."""
    words = F.split(key, " ")
    return F.when(F.size(words) > 1, F.substring(key, 1, 1)).otherwise(F.lit("")), F.element_at(words, -1)


def _agree(a: str, b: str) -> Column:
    """Whether two initials don't contradict each other."""
    return (F.col(a) == "") | (F.col(b) == "") | (F.col(a) == F.col(b))


def components(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(KEY, node, root): the smallest node that each node is linked to over any number of links.

    links: KEY, src, dst, in both directions, both ends in ``nodes``.  This is
    union-find as joins: each round every node takes the smallest root among
    its neighbours and itself, then its root's root, until nothing changes; the
    paths shrink by halves.  Only linked nodes take part in the rounds.
    """
    links = cut_lineage(links)
    lower = links.groupBy(KEY, F.col("src").alias("v")).agg(F.min("dst").alias("root")).select(KEY, "v", F.col("v").alias("old"), F.least("root", "v").alias("root"))
    while True:
        jump = lower.select(KEY, F.col("v").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(lower.join(jump, [KEY, "root"], "left").select(KEY, "v", "old", F.coalesce("next", "root").alias("root")))
        state = moved.drop("old")
        if moved.where("old <> root").isEmpty():
            break
        # each node's own root counts as a neighbour's, so that one aggregate does for both; the plan is there twice in the next round
        near = links.join(state.select(KEY, F.col("v").alias("dst"), "root"), [KEY, "dst"]).select(KEY, F.col("src").alias("v"), F.lit(None).cast("string").alias("old"), "root")
        lower = near.unionByName(state.select(KEY, "v", F.col("root").alias("old"), "root")).groupBy(KEY, "v").agg(F.max("old").alias("old"), F.min("root").alias("root"))
    return nodes.join(state.select(KEY, F.col("v").alias(node), "root"), [KEY, node], "left").withColumn("root", F.coalesce("root", node))


def resolve_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(KEY, label, sid): the speakers the labels of each transcript mean; labels that mean none give no row.

    labels: KEY, label (see ``label_key``), n (times used), distinct in KEY and
    label.  known: sid, name (folded words), at most one row a sid.

    Two labels of a transcript are linked if their initials don't contradict
    each other and their surnames are close (``slips``); all links count, and
    linked labels are one cluster.  A label is nearest to the speaker whose
    initial doesn't contradict it and whose surname differs least, if only one
    differs so little.  A cluster takes the speaker most of its uses are
    nearest to, each weighing 1 / (1 + edits); ties go to the smaller sid.
    Labels that are a speaker's exact name, and in clusters with exact names of
    several all that are nearest to somebody, go to their own.  '#7' is sid 7.

    Close surnames are found once over all transcripts, on distinct words.
    """
    numbered = labels.where("label like '#%'").join(F.broadcast(known.select("sid").distinct()), F.col("sid").cast("string") == F.substring("label", 2, 20)).select(KEY, "label", "sid")
    initial, surname = _name(F.col("label"))
    named = cut_lineage(labels.where("label <> '' and not label like '#%'").select(KEY, "label", "n", initial.alias("i"), surname.alias("s")))
    initial, surname = _name(F.col("name"))
    listed = known.where("name <> ''").select("sid", initial.alias("ki"), surname.alias("b"))
    words = named.select("s").unionByName(listed.select(F.col("b").alias("s"))).distinct()
    close = cut_lineage(close_pairs(words.select(F.col("s").alias("a")), words.select(F.col("s").alias("b")), slips, 3))

    other = named.select(KEY, F.col("label").alias("dst"), F.col("i").alias("oi"), F.col("s").alias("b"))
    links = named.select(KEY, F.col("label").alias("src"), "i", F.col("s").alias("a")).join(close, "a").join(other, [KEY, "b"]).where((F.col("src") != F.col("dst")) & _agree("i", "oi")).select(KEY, "src", "dst")
    near = (
        named.select(KEY, "label", "i", F.col("s").alias("a")).join(close.join(F.broadcast(listed), "b"), "a").where(_agree("i", "ki"))
        .groupBy(KEY, "label", "d").agg(F.min("sid").alias("sid"), F.countDistinct("sid").alias("several"))
        .groupBy(KEY, "label").agg(F.min(F.struct("d", "several", "sid")).alias("x")).where("x.several = 1").select(KEY, "label", F.col("x.d").alias("d"), F.col("x.sid").alias("near"))
    )
    placed = cut_lineage(components(named.select(KEY, "label", "n"), links, "label").join(near, [KEY, "label"], "left"))
    votes = placed.where("near is not null").groupBy(KEY, "root", "near").agg(F.sum(F.col("n") / (1 + F.col("d"))).alias("w"), F.max((F.col("d") == 0).cast("int")).alias("exact"))
    chosen = votes.groupBy(KEY, "root").agg(F.max(F.struct("w", (-F.col("near")).alias("neg"))).alias("x"), F.sum("exact").alias("exacts"))
    own = F.col("near").isNotNull() & ((F.col("d") == 0) | (F.col("exacts") > 1))
    found = placed.join(chosen, [KEY, "root"]).select(KEY, "label", F.when(own, F.col("near")).otherwise(-F.col("x.neg")).cast("int").alias("sid"))
    return numbered.unionByName(found)


def speaker_turns(
    df: DataFrame, speakers: DataFrame, keys: Sequence[str], row_id: str, start: str, text: str,
    speaker_id: str = "speaker_id", speaker_name: str = "speaker_name", most_speakers: int = 10_000, salts: int = 16,
) -> DataFrame:
    """Ordered turns of known speakers in each transcript (an entity of ``keys``).

    Time marks are taken off, labels cut each segment into pieces, labels are
    resolved per transcript (``resolve_labels``, on distinct labels only), and
    pieces are numbered in order of start, id, position.  A turn begins at a
    label of another speaker than the label before and lasts to the piece
    before the next turn.  Only labels are compared with their predecessor and
    all joins are on entity and number, so a long transcript is no hot key.

    Returns keys, speaker_id, turn_no (from 0), first_id, last_id; the clean
    words of the turns are given by ``turn_texts``.

    Defined results: null or blank texts, and segments with only time marks,
    fillers and annotations, are as if absent; a label with no words after it
    still names its speaker; pieces before the first label of a transcript
    belong to no turn; a null start comes first; rows with equal entity and id
    count once; null ids are left out; other columns are ignored.  The speakers
    table is sent to every task and refused above ``most_speakers`` rows.
    """
    numbered, starts, total = _numbered(df, speakers, keys, row_id, start, text, speaker_id, speaker_name, most_speakers, salts, texts=False)
    none = F.lit(None).cast("long")
    borders = starts.select(
        KEY,
        F.explode(F.array(
            F.struct(F.col("__j").alias("j"), F.col("__rank").alias("r1"), none.alias("r2"), F.col("__sid").alias("sid")),
            F.struct((F.col("__j") - 1).alias("j"), none.alias("r1"), (F.col("__rank") - 1).alias("r2"), F.lit(None).cast("int").alias("sid")),
        )).alias("x"),
    ).unionByName(
        starts.groupBy(KEY).agg(F.max("__j").alias("__j")).join(total, KEY).select(
            KEY, F.struct(F.col("__j").alias("j"), none.alias("r1"), F.col("__last").alias("r2"), F.lit(None).cast("int").alias("sid")).alias("x")
        )
    )
    turns = borders.groupBy(KEY, F.col("x.j").alias("__j")).agg(F.max("x.r1").alias("__r1"), F.max("x.r2").alias("__r2"), F.max("x.sid").alias("__sid")).where("__r1 is not null")
    # each turn looks up its first and its last piece by number
    ends = turns.select(KEY, "__j", "__sid", F.explode(F.array(F.struct(F.col("__r1").alias("r"), F.lit(0).alias("e")), F.struct(F.col("__r2").alias("r"), F.lit(1).alias("e")))).alias("x"))
    found = ends.select(KEY, "__j", "__sid", F.col("x.r").alias("__rank"), F.col("x.e").alias("__e")).join(numbered.select(KEY, "__rank", "__id"), [KEY, "__rank"])
    return found.groupBy(KEY, "__j", "__sid").agg(
        F.max(F.when(F.col("__e") == 0, F.col("__id"))).alias("first_id"), F.max(F.when(F.col("__e") == 1, F.col("__id"))).alias("last_id")
    ).select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.col("__sid").alias("speaker_id"), F.col("__j").alias("turn_no"), "first_id", "last_id")


def turn_pieces(df: DataFrame, speakers: DataFrame, keys: Sequence[str], row_id: str, start: str, text: str, speaker_id: str = "speaker_id", speaker_name: str = "speaker_name", most_speakers: int = 10_000, salts: int = 16) -> DataFrame:
    """The clean pieces in order: keys, piece_no, row_id, label's speaker_id (null where none is named), text.

    ``text`` has no time marks, labels, annotations, hesitations and doubled
    spaces; the rest is as for ``speaker_turns``.
    """
    numbered, _, _ = _numbered(df, speakers, keys, row_id, start, text, speaker_id, speaker_name, most_speakers, salts)
    return numbered.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.col("__rank").alias("piece_no"), F.col("__id").alias(row_id), F.col("__sid").alias("speaker_id"), F.col("__clean").alias("text"))


def turn_texts(
    df: DataFrame, speakers: DataFrame, keys: Sequence[str], row_id: str, start: str, text: str,
    speaker_id: str = "speaker_id", speaker_name: str = "speaker_name", most_speakers: int = 10_000, salts: int = 16, part_pieces: int = 4096,
) -> DataFrame:
    """The turns of ``speaker_turns`` with what was said: keys, turn_no, speaker_id, part_no, start_ms, n_pieces, text.

    ``text`` joins the clean words of the turn's pieces in order.  A turn of
    more than ``part_pieces`` pieces comes in parts (part_no from 0), so no
    turn, however long, is one task's; all others have part 0 only.  start_ms
    is the first known start of the part.
    """
    numbered, starts, _ = _numbered(df, speakers, keys, row_id, start, text, speaker_id, speaker_name, most_speakers, salts)
    begins = starts.select(KEY, "__rank", F.struct(F.col("__rank").alias("r"), F.col("__j").alias("j"), F.col("__sid").alias("sid")).alias("__begin"))
    inside = with_running_max(numbered.join(begins, [KEY, "__rank"], "left"), F.col("__begin"), "__turn").where("__turn is not null")
    parts = inside.groupBy(KEY, F.col("__turn.j").alias("turn_no"), F.col("__turn.sid").alias("speaker_id"), F.floor((F.col("__rank") - F.col("__turn.r")) / part_pieces).alias("part_no")).agg(
        F.min("__t").alias("start_ms"), F.count("*").alias("n_pieces"), F.sort_array(F.collect_list(F.struct("__rank", "__clean"))).alias("__x")
    )
    words = F.array_join(F.filter(F.transform("__x", lambda x: x["__clean"]), lambda x: x != ""), " ")
    return parts.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], "turn_no", "speaker_id", "part_no", "start_ms", "n_pieces", words.alias("text"))


def _numbered(df, speakers, keys, row_id, start, text, speaker_id, speaker_name, most_speakers, salts, texts=True):
    """The pieces in order, the beginnings of turns, the number of pieces; texts only where they are asked for."""
    names = F.trim(F.regexp_replace(folded(F.col(speaker_name)), r"(?U)[^\p{L}]+", " "))
    known = speakers.select(F.col(speaker_id).cast("int").alias("sid"), names.alias("name")).where("sid is not null").groupBy("sid").agg(F.max("name").alias("name"))
    # sent to every task below, and cut, as it is part of five plans
    known = cut_lineage(known.limit(most_speakers + 1))
    if known.count() > most_speakers:
        raise ValueError(f"more than {most_speakers} speakers")

    src = (
        df.select(entity(keys), F.col(row_id).alias("__id"), millis(start).alias("__t"), F.col(text).alias("__x"))
        .where("__id is not null and __x is not null")
        .groupBy(KEY, "__id").agg(F.min(F.struct("__t", "__x")).alias("__row"))
        .select(KEY, "__id", F.col("__row.__t").alias("__t"), F.regexp_replace(F.col("__row.__x"), TIME_MARK, " ").alias("__x"))
    )
    labels = F.regexp_extract_all("__x", F.lit(LABEL), 0)
    pieces = src.select(
        KEY, "__id", "__t",
        F.posexplode(F.arrays_zip(
            F.concat(F.array(F.lit(None).cast("string")), labels).alias("label"),
            F.split("__x", LABEL, -1).alias("said"),
        )).alias("__pos", "__p"),
    ).select(KEY, "__id", "__t", "__pos", F.col("__p.label").alias("__label"), F.col("__p.said").alias("__said"))
    said = F.regexp_replace("__said", ANNOTATION, " ")
    # a label that names nobody is text again, unless it is an annotation
    plain = F.when(~F.coalesce(F.col("__label"), F.lit("<")).rlike(r"^[\s>]*[\[<]"), F.col("__label"))
    pieces = pieces.select(
        KEY, "__id", "__t", "__pos", label_key(F.col("__label")).alias("__key"), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("__salt"),
        (spoken(said) != "").alias("__words"), F.coalesce(spoken(plain) != "", F.lit(False)).alias("__loud"), *([said.alias("__said"), plain.alias("__plain")] if texts else []),
    )
    pieces = cut_lineage(pieces)  # read several times below; parsing the texts is the dear part
    labelled = (F.col("__key") != "") & F.col("__key").isNotNull()
    distinct = pieces.where(labelled).groupBy(KEY, F.col("__key").alias("label")).agg(F.count("*").alias("n"))
    # plans below hold what they rank twice, so what is ranked is kept small: all the driver's memory goes into large plans
    resolved = cut_lineage(resolve_labels(distinct, known)).select(KEY, F.col("label").alias("__key"), F.col("sid").alias("__sid"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    others = pieces.where(F.coalesce(F.col("__key") == "", F.lit(True))).withColumn("__sid", F.lit(None).cast("int"))
    every = pieces.where(labelled).join(resolved, [KEY, "__key", "__salt"], "left").unionByName(others)
    clean = [without_hesitations(F.concat_ws(" ", F.when(F.col("__sid").isNull(), F.col("__plain")), "__said")).alias("__clean")] if texts else []
    rows_ = every.where("__sid is not null or __words or __loud").select(KEY, "__id", "__t", "__pos", "__sid", *clean)
    numbered = cut_lineage(with_rank(rows_, "__t", ["__id", "__pos"]))
    named = with_rank(numbered.where("__sid is not null").select(KEY, "__rank", "__t", "__sid"), "__t", ["__rank"], out="__n")
    changed = with_previous(named, F.col("__sid"), "__before", rank="__n").where("__before is null or __before <> __sid")
    starts = cut_lineage(with_rank(cut_lineage(changed.select(KEY, "__rank", "__t", "__sid")), "__t", ["__rank"], out="__j"))
    total = numbered.groupBy(KEY).agg(F.max("__rank").alias("__last"))
    return numbered, starts, total
