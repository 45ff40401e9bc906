"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: numbers, units and capitalised words (names, and words
that start a sentence) turn into typed placeholders.  Windows of five template
tokens, and of the words themselves in any case, are hash-joined to the
benchmark's.  One common window makes a candidate: the item is then laid beside
the document's tokens at the windows' shifts, so that changed, added and missing
words count as such.  A document holds an item if enough of the item's words
stand there, or enough of its literal words with consistent values in its slots:
each value of the item must stand for one value all through.  So edited and
re-parameterised questions are caught, and passages that only share a form aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.llm.common import discard, having, lacking, let, table, written

WINDOW = 5
#: Share of an item's words that a document must hold.
SHARE = 0.8
#: Literal words that an item needs at least, to be told by its template.
LITERALS = 5
#: Words that may be added or missing, as a share of the item's words (but SLACK_WORDS in any case).
SLACK, SLACK_WORDS = 0.2, 2
#: Literal tokens that a window needs at least.
LITERAL = 2
#: Benchmark windows that are broadcast at most; beyond, the join is dealt by hash.
BROADCAST_WINDOWS = 1_000_000
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min mins minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv j kj cal kcal pa kpa bar k c f degree degrees percent dollar dollars euro euros cent cents usd eur gbp"
).split()
NUM, UNIT, NAME = "\u0001n", "\u0001u", "\u0001a"
_START = r"(?<![^\x20\x09-\x0D])"
_TAIL = r".,;:!?)\]"
_END = rf"(?=[{_TAIL}]*+(?:[\x20\x09-\x0D]|$))"
#: A number, perhaps signed, with currency or percent signs; a word that starts with a capital; a unit behind a number.
NUMBER_TOKEN = _START + r"[(\[]?[-+$€£]?\p{Nd}(?:[\p{Nd}.,:/]*\p{Nd})?[%°€$]?" + _END
NAME_TOKEN = _START + r"[(\[\"']?\p{Lu}[\p{L}\p{M}'’-]*+" + _END
UNIT_TOKEN = rf"(?<={NUM}[{_TAIL}]{{0,3}}[\x20\x09-\x0D]{{1,3}})(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")" + _END
#: Words end before white space or the text's end; closing punctuation goes with the gap.
GAP = rf"(?<![{_TAIL}])[{_TAIL}]*+(?:[\x20\x09-\x0D]++|$)"


def tokens(text: Column) -> Column:
    """Words in lower case, without closing punctuation; those of nothing else are left out."""
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def folded(text: Column) -> Column:
    """tokens() of the text in any case; the capital of ß is SS."""
    return tokens(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def template(text: Column) -> Column:
    """The text with placeholders, token for token."""
    out = F.regexp_replace(text, NUMBER_TOKEN, NUM)
    out = F.when(F.contains(out, F.lit(NUM)), F.regexp_replace(out, UNIT_TOKEN, UNIT)).otherwise(out)
    return F.regexp_replace(out, NAME_TOKEN, NAME)


def windows(words: Column) -> Column:
    """Structs (at, hash: 64 bits) of each window; none for fewer tokens than one window has."""
    def each(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("hash")))

    none = F.lit([]).cast("array<struct<at:int,hash:bigint>>")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= WINDOW, each(h)).otherwise(none))


def _literal(words: Column, at: Column) -> Column:
    return sum((~F.get(words, at + k).startswith("\u0001")).cast("int") for k in range(WINDOW)) >= LITERAL


def _row() -> Column:
    return F.xxhash64("doc_id", "text").alias("row")


def _aligned(near: DataFrame, share: float) -> DataFrame:
    """Adds matched, kind (null: not held) to rows with anchor, shifts, and both sides' words and templates.

    A word of the item matches if it stands at one of the shifts near the anchor.
    """
    n = F.size("item_folded")
    close = F.filter("shifts", lambda s: F.abs(s - F.col("anchor")) <= F.greatest(F.lit(SLACK_WORDS), (SLACK * n).cast("int")))
    there = lambda side, i: F.filter("close", lambda s: F.coalesce(F.get(f"doc_{side}", i + s) == F.get(f"item_{side}", i), F.lit(False)))
    literal = lambda i: ~F.get("item_words", i).startswith("\u0001")

    def word(i: Column) -> Column:
        typed = lambda t: F.when(~literal(i) & (F.size(t) > 0), F.struct(F.get("item_folded", i).alias("a"), F.get("doc_folded", i + F.get(t, F.lit(0))).alias("b")))
        return F.struct((F.size(there("folded", i)) > 0).alias("same"), literal(i).alias("literal"), let(there("words", i), typed).alias("slot"))

    near = near.withColumn("close", close).withColumn("each", F.transform(F.sequence(F.lit(0), n - 1), word))
    count = lambda cond: F.size(F.filter("each", cond))
    pairs = F.array_distinct(F.array_compact(F.transform("each", lambda x: x["slot"])))
    consistent = let(pairs, lambda p: F.size(F.array_distinct(F.transform(p, lambda x: x["a"]))) == F.size(p))
    literals, kept = count(lambda x: x["literal"]), count(lambda x: x["literal"] & x["same"])
    form = count(lambda x: x["same"] | x["slot"].isNotNull())
    same = count(lambda x: x["same"])
    template = (literals >= LITERALS) & (kept >= share * literals) & (form >= share * n) & consistent
    kind = F.when(same == n, "copy").when((same >= share * n) & consistent, "edited").when(template, "reparameterised")
    return near.withColumns({"kind": kind, "matched": F.when(same >= share * n, same).otherwise(form)})


def _held(docs: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    """A written table (row, doc_id, item_id, matched, item_words, kind); row: the hash of id and text."""
    text = F.col("text")
    items = benchmark.where("item_id is not null and text is not null")
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), folded(text).alias("item_folded"), tokens(template(text)).alias("item_words")).dropDuplicates(["item_id", "item"])
    items = written(items.where(F.size("item_folded") > 0), "items")
    long = items.where(F.size("item_folded") >= WINDOW)
    plain = long.select("item", F.inline(windows(F.col("item_folded"))).alias("item_at", "hash"))
    typed = long.select("item", "item_words", F.inline(windows(F.col("item_words"))).alias("item_at", "hash"))
    listed = written(plain.unionByName(typed.where(_literal(F.col("item_words"), F.col("item_at"))).drop("item_words")).distinct(), "listed")
    there = docs.where("text is not null")
    held = there.select("doc_id", _row(), F.inline(F.concat(windows(folded(text)), windows(tokens(template(text))))).alias("at", "hash"))
    few = F.broadcast(listed) if listed.count() <= BROADCAST_WINDOWS else listed
    met = held.join(few, "hash").groupBy("doc_id", "row", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    met = written(met, "met")
    texts = having(there.select(_row(), "text"), met, "row").dropDuplicates(["row"])
    near = met.join(items, "item").join(texts.select("row", folded(text).alias("doc_folded"), tokens(template(text)).alias("doc_words")), "row")
    near = _aligned(near.withColumn("anchor", F.explode("shifts")), share).where("kind is not null")
    size = F.size("item_folded")
    order = F.when(F.col("kind") == "copy", 2).when(F.col("kind") == "edited", 1).otherwise(0) + F.col("matched") / (size + 1)
    found = near.select("row", "doc_id", "item_id", "matched", size.alias("item_words"), "kind", order.alias("o"))
    # items shorter than a window: documents that are nothing else
    short = items.where(F.size("item_folded") < WINDOW).select("item_id", F.xxhash64("item_folded").alias("whole"), F.size("item_folded").alias("item_words"))
    whole = there.select("doc_id", _row(), F.when(F.length("text") < 1000, F.xxhash64(folded(text))).alias("whole")).join(short, "whole")
    whole = whole.select("row", "doc_id", "item_id", F.col("item_words").alias("matched"), "item_words", F.lit("copy").alias("kind"), F.lit(3.0).alias("o"))
    both = found.unionByName(whole).groupBy("row", "doc_id", "item_id").agg(F.max_by(F.struct("matched", "item_words", "kind"), "o").alias("x"))
    out = written(both.select("row", "doc_id", "item_id", "x.*"), "found")
    discard(items, listed, met)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, item_words, share, kind) for each document and item it holds.

    docs: (doc_id, text); benchmark: (item_id, text); both tables may have more columns.
    matched: words of the item that stand in the document (their placeholders, if kind says
    so) at one place; share: of all its item_words.  kind: ``copy`` if all do, ``edited`` if
    ``share`` of them do, ``reparameterised`` if ``share`` of the literal words and of the
    template do; for these two the values in its slots must be consistent.  Case doesn't count.  Null and
    empty texts match nothing; items of fewer than five words match documents of the same
    words.  Rows with the same doc_id and text give one result, as do several texts of one item_id.
    """
    found = _held(docs, benchmark, share)
    return found.select("doc_id", "item_id", "matched", "item_words", (F.col("matched") / F.col("item_words")).alias("share"), "kind")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with or without an id; another text under the same id stays."""
    found = written(_held(docs, table(spark, sf_dir, "benchmark"), SHARE).select("row").distinct(), "leaks")
    return lacking(docs.withColumn("_row", F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text"))), found.withColumnRenamed("row", "_row"), "_row").select(docs.columns)
