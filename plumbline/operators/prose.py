"""Prose checks over whole documents: tell families, clusters, sentence rhythm, catalogue rows, repeated claims."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

# Phrases and marks per family, matched on lower-cased text unless the family is in RAW.
TELLS = {
    "significance": r"\b(?:stands as|serves as|is a testament|is a reminder|vital role|significant role|crucial role|pivotal role|key role|pivotal moment|key moment|underscores its|highlights its|reflects broader|symbolizing its|contributing to the|setting the stage for|marking the|shaping the|represents a shift|marks a shift|key turning point|evolving landscape|focal point|indelible mark|deeply rooted)\b",
    "notability": r"\b(?:independent coverage|local media outlets|regional media outlets|national media outlets|written by a leading expert|active social media presence)\b",
    "participles": r", (?:highlighting|underscoring|emphasizing|ensuring|reflecting|symbolizing|contributing to|cultivating|fostering|encompassing|showcasing)\b",
    "promotion": r"\b(?:boasts a|vibrant|rich cultural|profound|enhancing its|showcasing|exemplifies|commitment to|natural beauty|nestled|in the heart of|groundbreaking|renowned|breathtaking|must-visit|stunning)\b",
    "vague_attribution": r"\b(?:industry reports|observers have cited|experts argue|some critics argue|several sources|several publications)\b",
    "challenges": r"\b(?:faces several challenges|despite these challenges|challenges and legacy|future outlook)\b",
    "vocabulary": r"\b(?:actually|additionally|align with|crucial|delve|emphasizing|enduring|enhance|fostering|garner|highlight|interplay|intricate|intricacies|key|landscape|pivotal|showcase|tapestry|testament|underscore|valuable|vibrant)\b",
    "copula_avoidance": r"\b(?:serves as|stands as|marks a|represents a|boasts|features a|offers a)\b",
    "negative_parallelism": r"\bnot only\b[^.!?\n]*\bbut\b|\bit's not (?:just|merely|about)\b|, no [a-z]+ing\b",
    "dashes": r"—|–| -- ",
    "bold": r"\*\*[^*\n]+\*\*",
    "inline_headers": r"(?m)^\s*[-*] \*\*[^*\n]+:\*\*",
    "title_case_headings": r"(?m)^#+ +[A-Z][a-z]+(?: [A-Z][a-z]+){2,}\s*$",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2705}\x{2728}\x{27A1}]",
    "curly_quotes": r"[“”‘’]",
    "chat_artifacts": r"\b(?:i hope this helps|of course!|certainly!|you're absolutely right|would you like|want me to|should i continue|let me know|here is a)",
    "cutoff": r"\b(?:up to my last training update|while specific details are|based on available information|not publicly available|maintains a low profile|keeps personal details private|prefers to stay out of the spotlight|it is believed that)\b",
    "servile": r"\b(?:great question|excellent point|absolutely right)\b",
    "filler": r"\b(?:in order to|due to the fact that|at this point in time|in the event that|has the ability to|it is important to note that)\b",
    "hedging": r"\b(?:could potentially|potentially possibly|possibly be argued|might have some)\b",
    "upbeat_ending": r"\b(?:future looks bright|exciting times lie ahead|journey toward excellence|step in the right direction)\b",
    "hyphen_pairs": r"\b(?:third-party|cross-functional|client-facing|data-driven|decision-making|well-known|high-quality|real-time|long-term|end-to-end)\b",
    "authority": r"\b(?:the real question is|at its core|in reality|what really matters|fundamentally|the deeper issue|the heart of the matter)\b",
    "signposting": r"\b(?:let's dive in|let's explore|let's break this down|here's what you need to know|now let's look at|without further ado)\b",
    "aphorism": r"\b(?:becomes a trap|is not a tool but|the language of|the currency of|the architecture of)\b",
    "openers": r"(?m)(?:^|[.!?] )(?:honestly\?|look,|here's the thing|the thing is|let's be honest|real talk)",
}
RAW = ("title_case_headings",)
WEAK = ("dashes", "curly_quotes", "bold")  # never evidence on their own

# Text not the author's own.
QUOTED = r'"[^"\n]*"|“[^”\n]*”|(?m)^>.*$'


# What a text holds wherever a family that is no plain list of phrases matches.
NEEDED = {
    "negative_parallelism": ("not only", "it's not ", ", no "),
    "dashes": ("—", "–", " -- "),
    "bold": ("**",),
    "inline_headers": (":**",),
    "title_case_headings": ("#",),
    "curly_quotes": ("“", "”", "‘", "’"),
    "openers": ("honestly?", "look,", "here's the thing", "the thing is", "let's be honest", "real talk"),
}


def needed(family: str) -> Sequence[str]:
    """Literals of which a text holds at least one if the family matches; none when there is no such list."""
    m = re.fullmatch(r"(\\b|, )\(\?:([^()\[\]\\]+)\)(?:\\b)?", TELLS[family])
    return [m[1].replace("\\b", "") + p for p in m[2].split("|")] if m else NEEDED.get(family, ())


def _holds(text: Column, literals: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals])


def family_count(text: Column, family: str) -> Column:
    """Matches of a family; the pattern is tried only on texts that hold one of its literals."""
    n, literals = F.regexp_count(text, F.lit(TELLS[family])), needed(family)
    return F.when(~_holds(text, literals), 0).otherwise(n) if literals else n


def own_words(text: Column) -> Column:
    """The text without quoted passages."""
    return F.when(~_holds(text, ('"', "“", ">")), text).otherwise(F.regexp_replace(text, QUOTED, " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def tell_counts(df: DataFrame, key: Sequence[str], text: str, families: Sequence[str] | None = None) -> DataFrame:
    """Matches per document and family, families that occur: `(key..., family, n, words)`. No shuffle."""
    names = list(families or TELLS)
    d = spread(df.select(*key, text)).select(*key, own_words(F.col(text)).alias("_own"), word_count(F.col(text)).alias("words"))
    d = d.select(*key, "words", "_own", F.lower("_own").alias("_low"))
    return d.select(*key, "words", F.inline(F.array(*[
        F.struct(F.lit(n).alias("family"), family_count(F.col("_own" if n in RAW else "_low"), n).alias("n"))
        for n in names]))).where("n > 0")


def tell_clusters(df: DataFrame, key: Sequence[str], text: str, min_families: int = 3) -> DataFrame:
    """Documents with several different tells, of which at least one is strong; rate per 1,000 words. No shuffle."""
    names = list(TELLS)
    d = spread(df.select(*key, text)).select(*key, own_words(F.col(text)).alias("_own"), word_count(F.col(text)).alias("words"))
    d = d.withColumn("_low", F.lower("_own")).withColumn("_c", F.array(*[
        F.struct(F.lit(n in WEAK).alias("weak"), family_count(F.col("_own" if n in RAW else "_low"), n).alias("n")) for n in names]))
    hit = F.filter("_c", lambda x: x["n"] > 0)
    d = d.select(*key, "words", F.size(hit).alias("families"), F.size(F.filter(hit, lambda x: ~x["weak"])).alias("strong"),
                 F.aggregate("_c", F.lit(0), lambda s, x: s + x["n"]).alias("tells"))
    return d.withColumn("per_1000", F.try_divide(1000.0 * F.col("tells"), F.col("words"))).withColumn(
        "flag", (F.col("families") >= min_families) & (F.col("strong") >= 1)).drop("strong")


def sentence_rhythm(df: DataFrame, key: Sequence[str], text: str, short: int = 4, run: int = 3) -> DataFrame:
    """Sentence count, mean and spread of lengths, and the longest run of short sentences. No shuffle."""
    sents = F.filter(F.split(F.col(text), r"[.!?]+(?:\s+|$)"), lambda s: F.length(F.trim(s)) > 0)
    d = spread(df.select(*key, text)).select(*key, F.transform(sents, lambda s: F.regexp_count(s, F.lit(r"\S+"))).alias("_l"))
    n = F.size("_l")
    total = F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x)
    square = F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x * x)
    marks = F.array_join(F.transform("_l", lambda x: F.when(x <= short, "S").otherwise("L")), "")
    runs = F.transform(F.regexp_extract_all(marks, F.lit("(S+)"), F.lit(1)), lambda s: F.length(s))
    var = F.when(n > 1, (square - total * total / n) / (n - 1))
    return d.select(*key, n.alias("sentences"), F.try_divide(total, n).alias("mean_words"), F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd_words"),
                    F.coalesce(F.array_max(runs), F.lit(0)).alias("longest_short_run"),
                    (F.coalesce(F.array_max(runs), F.lit(0)) >= run).alias("staccato"))


NAME_MAX, DESCRIPTION_MAX = 64, 200


def catalogue_violations(df: DataFrame, folder: str, name: str, description: str, reserved: Sequence[str] = ()) -> DataFrame:
    """One row per broken rule of a catalogue entry."""
    n, d = F.col(name), F.col(description)
    blank_n, blank_d = F.coalesce(F.length(n), F.lit(0)) == 0, F.coalesce(F.length(d), F.lit(0)) == 0
    tag = lambda c: c.rlike("<[^>]+>")
    rules = [("name missing", blank_n), (f"name longer than {NAME_MAX}", ~blank_n & (F.length(n) > NAME_MAX)),
             ("name not lower-case letters, digits and hyphens", ~blank_n & ~n.rlike("^[a-z0-9-]+$")),
             *[(f"name contains reserved word {w}", ~blank_n & F.lower(n).contains(w)) for w in reserved],
             ("name differs from folder", ~blank_n & (n != F.col(folder))),
             ("description missing", blank_d), (f"description longer than {DESCRIPTION_MAX}", ~blank_d & (F.length(d) > DESCRIPTION_MAX)),
             ("name contains a tag", ~blank_n & tag(n)), ("description contains a tag", ~blank_d & tag(d))]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules]))
    return df.select(folder, name, F.explode(broken).alias("rule"))


def repeated_claims(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Named quantities stated with more than one value. `pattern` has two groups: name and number.

    Distinct (name, value) pairs are counted first, so a claim repeated in many
    documents is one row before names are compared.
    """
    names = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    vals = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2))
    d = df.select(key, F.inline(F.arrays_zip(names.alias("a"), vals.alias("b")))).toDF(key, "name", "raw")
    d = d.select(F.lower(F.trim("name")).alias("name"), F.replace("raw", F.lit(","), F.lit("")).try_cast("double").alias("value"))
    p = d.where("value is not null").groupBy("name", "value").agg(F.count("*").alias("c"))
    return p.groupBy("name").agg(F.count("*").alias("n_values"), F.sum("c").alias("n_claims"), F.min("value").alias("lowest"), F.max("value").alias("highest")).where("n_values > 1")
