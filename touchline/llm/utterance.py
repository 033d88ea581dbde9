"""Shared wording rules for commentary: fillers, folding, utterance keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hesitation sounds of the six languages, folded to plain letters.
FILLERS = ("uh", "um", "uhm", "erm", "er", "eh", "ehm", "em", "ah", "hm", "hmm", "mm", "mmm", "mhm", "oh", "ohm", "ahm", "aeh", "aehm", "oeh", "oehm", "eu", "euh", "heu", "hum", "beu", "beuh", "ben", "este", "eee")

# Of these, sounds that are a word in none of the languages.
SOUNDS = ("uh", "um", "uhm", "erm", "ehm", "hm", "hmm", "mm", "mmm", "mhm", "äh", "ähm", "öh", "öhm", "euh", "heu", "beuh", "eee")

# Sounds that are also words ('er' is, 'este' this, 'eu' had); taken out only where a comma or dots set them off.
DOUBTFUL = ("er", "eh", "em", "ah", "oh", "eu", "ben", "este", "hum", "beu")

# Letters that do not decompose, and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđłńśźżğőűāēīōū"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyyszccdlnszzgouaeiou"


def folded(c: Column) -> Column:
    """Lower case without accents."""
    c = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    c = F.regexp_replace(F.regexp_replace(c, "ß", "ss"), "æ", "ae")
    return F.regexp_replace(F.regexp_replace(c, "œ", "oe"), r"\p{M}+", "")


def spoken(c: Column) -> Column:
    """Folded words parted by one space, without punctuation and fillers."""
    c = F.regexp_replace(folded(c), r"(?U)[^\p{L}\p{N}]+", " ")
    c = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r" (?:(?:" + "|".join(FILLERS) + r") )+", " ")
    return F.trim(c)


def without_hesitations(c: Column) -> Column:
    """The text as it is written, without hesitations and doubled or outer spaces.

    A hesitation goes with the comma or dots behind it.  Sounds that are words
    too go only if a comma or dots follow, or nothing else is there.
    """
    c = F.concat(F.lit(" "), F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))
    sure, doubtful = "|".join(SOUNDS), "|".join(DOUBTFUL)
    c = F.regexp_replace(c, rf"(?iU) (?:(?:(?:{sure})(?:,|\.{{2,}}|…)?|(?:{doubtful})(?:,|\.{{2,}}|…)) )+", " ")
    c = F.regexp_replace(c, rf"(?iU) (?:{sure})(?=[.!?;:]+ )", "")
    return F.trim(F.regexp_replace(c, rf"(?iU)^[\p{{P}} ]*(?:(?:{sure}|{doubtful})[\p{{P}} ]*)+$", ""))


def utterance_key(c: Column) -> Column:
    """What is compared: stretched letters and stammered words count once, no spaces."""
    c = F.regexp_replace(spoken(c), r"(\p{L})\1+", "$1")
    c = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r" (\p{L}+)(?: \1)+(?= )", " $1")
    return F.regexp_replace(c, " +", "")


def numbers(c: Column) -> Column:
    """The digits groups in order, as one string."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), 1), " ")
