"""Which short texts contain which phrases, when there are too many phrases to try each.

A phrase can only be inside a text that has all its grams (pieces of four characters), so it is
looked for where its rarest gram is. Grams are counted first; texts are then spelled out in those
grams that are the key of some phrase, joined with the phrases there, and looked through. Phrases
are never broadcast, and a text travels no further than its own grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import skewed_join
from .prefilter import may_match

GRAM = 4
SIDE = 3  # characters of a phrase on either side of its first space
HOT_WORDS = 1 << 18  # words that each hold more than this part of all words of texts are broadcast
HOT_LENGTH = 64  # characters of such a word at most
MASKS = [f"_m{i}" for i in range(4)]  # numbers of 64 bits, those of a bucket of phrases
MASK_BITS = 64 * len(MASKS)
COPIES = 16  # of a table of phrases, in joins that meet common ones


def grams(text: Column, n: Column | int) -> Column:
    """The different pieces of ``n`` characters in a text: no more than it has characters."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(
        F.transform(at, lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def spelled(texts: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """``texts`` beside ``_gram``, each different piece of a text of one of the ``sizes``: the one at
    its first place. Pieces are made as rows, which Spark compiles; a list of them it would not."""
    least, at = min(sizes), F.col("_at")
    places = texts.filter(F.length(text) >= least).withColumn(
        "_at", F.explode(F.sequence(F.lit(1), F.length(text) - least + 1)))
    cut = [F.when(F.length(text) - at + 1 >= n, F.substr(F.col(text), at, F.lit(n))) for n in sizes]
    pieces = places.withColumn("_gram", cut[0] if len(cut) == 1 else F.explode(F.array(*cut)))
    return pieces.filter(F.instr(text, F.col("_gram")) == at).drop("_at")


def contained(texts: DataFrame, phrases: DataFrame, on: Sequence[str], text: str, phrase: str,
              different: bool = False) -> DataFrame:
    """``on, text, phrase``: each different text beside each different phrase that occurs in it
    and agrees with it in the columns ``on``.

    Meant for short texts (names, words, lines): rows grow with their length. ``phrases`` are read
    several times, so pass a table. Empty phrases and nulls meet nothing. A phrase shorter than
    four characters is its own gram. Grams of very many texts are spread. ``different`` says that
    no two rows of ``texts`` agree in ``on`` and ``text``.
    """
    held = texts.select(*on, F.col(text).alias("_text"))
    held = held if different else held.distinct()
    asked = phrases.select(*on, F.col(phrase).alias("_phrase")).filter(F.length("_phrase") > 0).distinct()
    size = F.least(F.length("_phrase"), F.lit(GRAM))
    sizes = sorted(r.n for r in asked.select(size.alias("n")).distinct().collect())  # four values at most
    place = F.struct(*on, "_gram").alias("_place")
    pieces = spelled(held, "_text", sizes or [GRAM]).select(*on, "_text", place)
    wanted = asked.select(*on, "_phrase", F.explode(grams(F.col("_phrase"), size)).alias("_gram")).select("_phrase", place, *on)
    # texts are spelled out once, and what is kept of that has a gram of some phrase
    kept = cut_lineage(pieces.join(wanted.select("_place").distinct(), "_place", "left_semi"))
    often = kept.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct("_n", "_place")).alias("_rarest")
    # a gram that no text has rules its phrase out: null comes first
    keys = cut_lineage(wanted.join(often, "_place", "left").groupBy(*on, "_phrase").agg(rarest)
                       .filter("_rarest._n is not null").select("_phrase", "_rarest._place"))
    # most grams are no phrase's rarest: those stay out of the exchange
    asking = may_match(kept, keys.select("_place"), "_place").filter("_may").drop("_may")
    met = skewed_join(asking, keys, "_place", F.col("_text"), rows_of=often)
    return met.filter(F.contains("_text", "_phrase")).select(
        *on, F.col("_text").alias(text), F.col("_phrase").alias(phrase))


def numbered(phrases: DataFrame, phrase: str) -> DataFrame:
    """``_phrase, _as, _words, _bucket, _bit``: each phrase in lower case, its spellings, of how many
    words it is, and its place in the masks: phrases of one length are beside each other. Numbers
    have gaps where the ordered table is cut, and no single task counts."""
    asked = phrases.select(F.lower(phrase).alias("_phrase"), F.col(phrase).alias("_as")).filter(F.length("_phrase") > 0)
    words = F.length("_phrase") - F.length(F.replace("_phrase", F.lit(" "), F.lit(""))) + 1
    held = asked.groupBy("_phrase").agg(F.collect_set("_as").alias("_as")).withColumn("_words", words)
    ordered = held.orderBy(F.length("_phrase"), "_phrase").withColumn("_number", F.monotonically_increasing_id())
    return cut_lineage(ordered.select("_phrase", "_as", "_words", F.floor(F.col("_number") / MASK_BITS).alias("_bucket"),
                                      (F.col("_number") % MASK_BITS).cast("int").alias("_bit")))


def masks() -> list[Column]:
    """The phrase's bucket, and its bit in the masks of the bucket."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit") % 64)
    return [F.col("_bucket"), *[F.when(F.shiftright("_bit", 6) == i, bit).otherwise(0).alias(m) for i, m in enumerate(MASKS)]]


def together(found: DataFrame, *by: str) -> DataFrame:
    """Masks of the same rows and bucket as one."""
    return found.groupBy(*by, "_bucket").agg(*[F.bit_or(m).alias(m) for m in MASKS])


def phrase_join(many: DataFrame, few: DataFrame, on: str, spread: Column) -> DataFrame:
    """Join with a table that has some rows for each phrase. It is copied ``COPIES`` times, so rows of a
    very common phrase go to as many tasks, without being counted first."""
    return many.withColumn("_copy", F.pmod(F.xxhash64(spread), F.lit(COPIES))).join(
        few.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint")))), [on, "_copy"]).drop("_copy")


def short_hits(words: DataFrame, asked: DataFrame) -> DataFrame:
    """``_run, _bucket`` and masks: phrases shorter than ``GRAM`` are pieces of words themselves, and meet
    the pieces of each different word as they are."""
    sizes = sorted(r.n for r in asked.select(F.length("_phrase").alias("n")).distinct().collect())  # three at most
    pieces = spelled(words.select("_run"), "_run", sizes or [1]).withColumnRenamed("_gram", "_phrase")
    met = may_match(pieces, asked.select("_phrase"), "_phrase").filter("_may").drop("_may")
    return phrase_join(met, asked.select("_phrase", "_bucket", "_bit"), "_phrase", F.col("_run")).select("_run", *masks())


def long_hits(words: DataFrame, asked: DataFrame) -> DataFrame:
    """``_run, _bucket`` and masks: phrases of ``GRAM`` characters or more, searched in each different word."""
    found = contained(words.select("_run"), asked, [], "_run", "_phrase", different=True)
    return phrase_join(found, asked.select("_phrase", "_bucket", "_bit"), "_phrase", F.col("_run")).select("_run", *masks())


def in_words(df: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """``_key, _bucket`` and masks, yet to be put together: phrases of one word.

    Different words of all texts are searched once, and what a word has is kept as masks. Frequent
    words, fewer than ``HOT_WORDS`` and short, are broadcast with theirs, so most words of a text
    are told where they are read; only the others meet their masks in an exchange.
    """
    runs = cut_lineage(df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.split(F.lower(text), " "))).alias("_run")))
    words = cut_lineage(runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")))
    short = F.length("_phrase") < GRAM
    hits = short_hits(words, asked.filter(short)).union(long_hits(words, asked.filter(~short)))
    known = cut_lineage(together(hits, "_run"))
    everything = words.agg(F.sum("_n").alias("n")).scalar()
    often = (F.col("_n") * HOT_WORDS > everything) & (F.length("_run") <= HOT_LENGTH)
    hot = F.broadcast(words.filter(often).select("_run"))
    here = runs.join(F.broadcast(known.join(hot, "_run", "left_semi")), "_run")
    there = skewed_join(runs.join(hot, "_run", "left_anti"), known, "_run", F.col("_key"), rows_of=words.filter(~often))
    return here.union(there).select("_key", "_bucket", *MASKS)


def in_runs(df: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """``_key, _bucket`` and masks: a phrase of several words lies in a run of as many, its first space on
    the run's first. Only runs that have a phrase's piece around that space, up to ``SIDE`` characters
    of the word on either side, leave the scan: one for all numbers of words."""
    def place(words, before: Column, after: Column) -> Column:
        return F.xxhash64(words, before, after)

    shaped = asked.select("_phrase", "_bucket", "_bit", "_words", *[F.get(F.split("_phrase", " "), F.lit(i)).alias(c) for i, c in enumerate(("_first", "_second"))])
    shaped = cut_lineage(shaped.select(
        "_phrase", "_bucket", "_bit", "_words", *[F.least(F.length(c), F.lit(SIDE)).alias(n) for c, n in (("_first", "_before"), ("_second", "_after"))],
        place(F.col("_words"), F.right("_first", F.lit(SIDE)), F.left("_second", F.lit(SIDE))).alias("_place")))
    # (SIDE + 1)^2 at most for each number of words
    shapes = shaped.select(F.col("_words").alias("n"), F.col("_before").alias("b"), F.col("_after").alias("a")).distinct().collect()
    word, then = F.col("_word"), F.col("_then")
    places = [F.when((F.length(word) >= s.b) & (F.length(then) >= s.a), place(
        F.lit(s.n), F.substring(word, -s.b, s.b) if s.b else F.lit(""), F.substring(then, 1, s.a))) for s in shapes]
    parts = df.select(F.col(key).alias("_key"), F.split(F.lower(text), " ").alias("_parts"))
    pairs = (parts.select("_key", "_parts", F.posexplode("_parts").alias("_at", "_word"))
             .withColumn("_then", F.get("_parts", F.col("_at") + 1)).filter("_then is not null"))
    pieces = pairs.select("_key", "_parts", "_at", F.posexplode(F.array(*places)).alias("_shape", "_place")).filter("_place is not null")
    words = F.get(F.array(*[F.lit(s.n) for s in shapes]), F.col("_shape"))
    run = F.array_join(F.slice("_parts", F.col("_at") + 1, words), " ").alias("_run")
    met = cut_lineage(may_match(pieces, shaped.select("_place"), "_place").filter("_may").select("_key", "_place", run))
    found = skewed_join(met, shaped.select("_place", "_phrase", "_bucket", "_bit"), "_place", F.xxhash64("_key", "_run"))
    return found.filter(F.contains("_run", "_phrase")).select("_key", *masks())


def contains_any(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """``key, phrase``: each key beside each phrase that its text contains, case aside, for any
    number of phrases.

    Texts are cut, in the stage that reads them, in different words and in runs of words; only those
    cross exchanges, and of runs, where phrases say enough of them, only such as a phrase can be in.
    What a key has found is masks of ``MASK_BITS`` phrases a row until all is put together, so the
    many words that hold one common phrase do not make a row each.
    """
    asked = numbered(phrases, phrase)
    sizes = [r.one for r in asked.select((F.col("_words") == 1).alias("one")).distinct().collect()]
    if not sizes:
        return df.select(F.col(key), F.lit(None).cast("string").alias(phrase)).limit(0)
    held = None
    for one in sizes:
        own = asked.filter((F.col("_words") == 1) == one)
        each = (in_words if one else in_runs)(df, key, text, own)
        held = each if held is None else held.union(each)
    # by key, so that what is made of a key's phrases needs no exchange of them
    found = together(held, "_key").repartition("_key")
    each = F.array(*[F.struct((F.col("_bucket") * len(MASKS) + i).alias("_part"), F.col(m).alias("_mask")) for i, m in enumerate(MASKS)])
    found = found.select("_key", F.inline(each)).filter("_mask <> 0")
    part = (F.col("_bucket") * len(MASKS) + F.shiftright("_bit", 6)).alias("_part")
    lists = cut_lineage(asked.select(part, (F.col("_bit") % 64).alias("_bit"), F.explode("_as").alias("_as")).groupBy("_part").agg(
        F.collect_list(F.struct("_bit", "_as")).alias("_list")))
    met = phrase_join(found, lists, "_part", F.col("_key"))
    return (met.select("_key", "_mask", F.inline("_list")).filter(F.getbit("_mask", F.col("_bit")) == 1)
            .select(F.col("_key").alias(key), F.col("_as").alias(phrase)))
