"""Spelling variants among the words of a corpus by asymmetric chunks.

Words. Runs of letters are counted inside tasks, text by text, and the counts are summed by word. Short and rare words go.

Near words: one code point inserted, deleted or replaced. Of two words the shorter (of equal lengths each) gives two
disjoint chunks, its halves; one edit leaves one of them whole. The other word gives its positional grams: the half
before the edit stands at its own place, the half after it is shifted by the difference of the lengths, none or one, so of
all its grams only those can meet a chunk. Equal (length, place, text) of chunk and gram makes a candidate.

A half that very many words share would pair them all. Its words do not meet there: inside the part that is still open
they give two chunks again, halves of that part, and meet only where one of these agrees too, and so on, until a group is
small (``SMALL``) or the open part is one code point wide; then its members are near words but for a few. Each pair at one
edit survives every such step, so the result is whole, and a group's work is bounded by the alphabet, not by its size.
Candidates are verified by edit distance. Places and open parts are hashed into the join key; a collision only adds a
candidate.

Forms: the near word of largest count, where it is ``factor`` times the word's own; counts rise along forms, so following
them ends, and the last is found by pointer doubling.

Null text has no words, and a null id counts as an empty one. Rows repeated with one id count each. An empty table, or one
without words kept, gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved

LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
RUN = "[a-zÀ-ÿ]{%d,}"
#: Words that a task holds before it passes its counts on.
FLUSH = 200_000
#: A group is compared pair by pair where chunks times members are at most the square of this.
SMALL = 32


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, slips: int | None = 199
) -> DataFrame:
    """word and n. With ``slips``, a run whose crc32 with its document's id it divides loses a code point."""
    pattern = re.compile(RUN % min_length)

    def flushed(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def work(batches):
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                head = zlib.crc32(f"{name or ''}:".encode())
                # A shorter run can only become shorter still.
                for run, n in Counter(pattern.findall(text.encode().translate(LOWER).decode())).items():
                    if slips and (h := zlib.crc32(run.encode(), head)) % slips == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    counts[run] += n
                if len(counts) >= FLUSH:
                    yield flushed(counts)
                    counts = Counter()
        yield flushed(counts)

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(work, "word string, n bigint")
    long = rows.filter(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _chunk(low, high, shift):
    """Join key of a word whose part from ``low`` to ``high`` is open: the length of the chunks' word, the place and the rest."""
    end = high + shift
    return F.xxhash64(
        F.char_length("word") - shift, low, high, F.substring("word", F.lit(1), low), F.substring("word", end + 1, F.char_length("word") - end)
    )


def _opened(rows: DataFrame) -> DataFrame:
    """word, n, shift, low, high -> the same with either half of the open part taken for a chunk, and the join key."""
    middle = F.expr("(low + high) div 2").cast("int")
    parts = F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
    halves = rows.withColumn("part", F.explode(parts)).select("word", "n", "shift", "part.low", "part.high")
    return halves.withColumn("chunk", _chunk(F.col("low"), F.col("high"), F.col("shift")))


def _meeting(rows: DataFrame) -> DataFrame:
    """Rows that share their chunk with another row, one of them being its giver, and whether the group is crowded."""
    sizes = rows.groupBy("chunk").agg(F.sum(F.expr("int(shift = 0)")).alias("givers"), F.count("*").alias("members"))
    sizes = sizes.filter("givers >= 1 and members >= 2")
    crowded = (F.col("givers") * F.col("members") > SMALL * SMALL) & (F.col("high") - F.col("low") > 1)
    return rows.join(sizes, "chunk").select("word", "n", "shift", "low", "high", "chunk", crowded.alias("crowded"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Near words (a, a_n, b, b_n) among the members of each chunk."""
    giver = rows.filter("shift = 0").select("chunk", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = rows.select("chunk", F.col("word").alias("b"), F.col("n").alias("b_n"), "shift")
    met = giver.join(other, "chunk").filter("shift = 1 or a < b")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of near words once: a, a_n, b, b_n. ``words`` has word and n, each word once."""
    # As a giver of chunks, and as the longer word, whose grams are shifted past the edit.
    shifts = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    rows = words.select("word", "n", shifts).withColumn("low", F.lit(0)).withColumn("high", F.char_length("word") - F.col("shift"))
    found = None
    while True:
        met = saved(_meeting(_opened(rows)), "chunks")
        pairs = _pairs(met.filter("not crowded"))
        found = pairs if found is None else found.unionAll(pairs)
        rows = met.filter("crowded").drop("chunk", "crowded")
        if rows.isEmpty():
            return saved(found.distinct(), "near-words")


def _last(forms: DataFrame) -> DataFrame:
    """word and root: the end of each word's chain of forms, by pointer doubling."""
    state = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``words`` (word and n, each word once)."""
    words = saved(words.select("word", "n"), "words")
    pairs = near_words(words)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best")
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    judged = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * factor
    judged = judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    judged = saved(judged, "forms")
    ends = _last(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
