"""Personal data: fixed formats, and identifiers found by bootstrapped contextual extraction.

1. Base spans: e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers. The patterns take
   the same matches as their plain forms, but start only where a run of their characters starts, and never go back into
   a run, so that long runs cost linear time.
2. Candidates: tokens with a digit or an at sign. Seeds are those that overlap a base span and those that hold a credential
   of a known format (``CREDENTIALS``). Beside a candidate stand two lexical patterns: the two tokens to its left and the two
   to its right, lower-cased and with all digits alike; other candidates count as tokens too.
3. Rounds over the graph of patterns and instances: a pattern gets as confidence the summed scores of the instances it occurs
   with, divided by all its occurrences in all texts, beside plain words too, if ``SUPPORT`` trusted instances stand beside it;
   so words that stand anywhere never count. These are left out once a share of the texts holds them too often for any
   confidence; the rest are counted in all texts. An instance gets the noisy-or of its trusted patterns, or the mean score of the
   instances of its shape (punctuation and length) where enough of them are known, so that identifiers seen in one context
   lead to others; seeds keep 1.
4. Candidates beside a trusted pattern that look like identifiers are added as ``context`` spans, without the punctuation
   around them, whether or not they have a known format; those that overlap a base span are not.

Positions are code points, the end exclusive. Null text is empty and has no spans. Null ids and rows repeated with one
id are kept as they are. An empty table gives an empty result; columns other than id and text are not read. All steps are
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
_BLANK = r"\x20\t-\r"
#: kind, pattern, and what a text must contain to be searched for it.
PATTERNS = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[ -]?[0-9])++", ""),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
)
_CANDIDATE = rf"(?<![^{_BLANK}])[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+"
_BLOCK = 256  # matches placed together
_NEAR = 256  # characters of the surroundings in which the neighbouring words are looked for
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"

#: Formats that make a token a seed without making it a base span: digests and keys as they are handed out.
CREDENTIALS = (r"(?i)(?<![0-9a-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![0-9a-z])", r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")

ROUNDS = 3
CONFIDENCE = 0.6
SUPPORT = 3
SHARES = (256, 16)  # one text in so many is searched first for the patterns' words
TRUSTED = 0.5
LEAST_DIGITS, LEAST_CHARACTERS = 3, 6


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places: array of (start, end, hit, before, after), before and after being the ends of the text
    from the match before to this one and from this one to the next, with these."""
    kind = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"
    none = F.expr("array()").cast(kind)

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.char_length(piece["before"])
        end = start + F.char_length(piece["hit"])
        row = F.struct(
            start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), piece["hit"].alias("hit"),
            F.right(F.concat(piece["last"], piece["before"]), F.lit(_NEAR)).alias("before"),
            F.left(F.concat(piece["after"], piece["next"]), F.lit(_NEAR)).alias("after"),
        )
        return F.struct(end.cast("bigint").alias("at"), F.concat(state["rows"], F.array(row)).alias("rows"))

    def paired(found: Column) -> Column:
        return F.transform(
            found["hits"],
            lambda hit, k: F.struct(hit.alias("hit"), F.get(found["gaps"], k).alias("before"), F.get(found["gaps"], k + 1).alias("after"),
                F.coalesce(F.get(found["hits"], k - 1), F.lit("")).alias("last"), F.coalesce(F.get(found["hits"], k + 1), F.lit("")).alias("next")),
        )

    def placed(pieces: Column) -> Column:
        """Places by running sums: over blocks first, then inside each block, so that no long array is copied per match."""
        numbers = F.sequence(F.lit(0), F.ceil(F.size(pieces) / F.lit(_BLOCK)).cast("int"))
        return let(F.transform(numbers, lambda b: F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK))), in_blocks)

    def in_blocks(blocks: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        size = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda n, x: n + F.char_length(x["before"]) + F.char_length(x["hit"])))
        begin = F.aggregate(
            size, F.array(zero), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
        )
        inside = F.zip_with(
            blocks, F.slice(begin, 1, F.size(blocks)),
            lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("rows")), step, lambda state: state["rows"]),
        )
        return F.flatten(inside)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(let(found, paired), placed)


def let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, k: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + k % 2),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]++", "")
    count = F.char_length(digits)
    if kind == "ip":
        small = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return count.between(14, 19) & F.when(count.between(14, 19), luhn(digits)).otherwise(False)
    return count.between(10, 15) if kind == "phone" else F.lit(True)


def valid_spans(text: Column, rank: int, kind: str, pattern: str) -> Column:
    good = F.filter(matches(text, pattern), lambda m: valid(kind, m["hit"]))
    return F.transform(
        good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind), by start and kind."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    lists = []
    for rank, (kind, pattern, needs) in enumerate(PATTERNS):
        could = F.contains(text, F.lit(needs)) if kind == "email" else digit & F.contains(text, F.lit(needs))
        lists.append(F.when(could, valid_spans(text, rank, kind, pattern)).otherwise(F.expr("array()").cast(f"array<{_SPAN}>")))
    return F.array_sort(F.concat(*lists))


def alike(text: Column) -> Column:
    """Lower-cased, all digits alike: what patterns are made of."""
    return F.translate(F.lower(text), "0123456789", "9999999999")


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, instance, left, right, based, seed) of the tokens with a digit or an at sign; left and right are
    the patterns beside, empty where fewer words stand there."""
    token, blank = rf"[^{_BLANK}]++", rf"[{_BLANK}]++"
    left = rf"(?<![^{_BLANK}])({token}(?:{blank}{token}))[{_BLANK}]*+$"
    right = rf"^[{_BLANK}]*+({token}(?:{blank}{token}))"
    words = lambda c, pattern: F.regexp_replace(alike(F.regexp_extract(c, pattern, 1)), blank, " ")

    def known(m: Column) -> Column:
        out = F.lit(False)
        for pattern in CREDENTIALS:
            out = out | F.regexp_like(m["hit"], F.lit(pattern))
        return out

    def placed(m: Column, core: Column) -> Column:
        start = m["start"] + F.char_length(F.regexp_extract(m["hit"], "^[^0-9A-Za-z]*+", 0))
        end = start + F.char_length(core)
        return F.struct(
            start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), core.alias("instance"),
            words(m["before"], left).alias("left"), words(m["after"], right).alias("right"),
            F.exists(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])).alias("based"), known(m).alias("seed"),
        )

    # The instance is the token without the punctuation around it.
    found = F.transform(matches(text, _CANDIDATE), lambda m: let(F.regexp_extract(m["hit"], "(?s)[0-9A-Za-z](?:.*[0-9A-Za-z])?", 0), lambda core: placed(m, core)))
    some = F.regexp_like(text, F.lit("[0-9@]"))
    kind = "array<struct<start:bigint,end:bigint,instance:string,left:string,right:string,based:boolean,seed:boolean>>"
    return F.when(some, found).otherwise(F.expr("array()").cast(kind))


def occurrences(found: DataFrame) -> DataFrame:
    """row, start, end, instance, based, seed and pattern (side and words) of every candidate beside words."""
    each = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*").withColumn("seed", F.col("based") | F.col("seed"))
    sides = [F.when(F.col(side) != "", F.struct(F.lit(side).alias("side"), F.col(side).alias("words"))) for side in ("left", "right")]
    return each.withColumn("pattern", F.explode(F.array_compact(F.array(*sides)))).drop("left", "right")


def shape(instance: Column) -> Column:
    """Punctuation with every run of letters and digits as one mark, and the length."""
    return F.concat(F.regexp_replace(instance, "[0-9A-Za-z]++", "x"), F.lit(":"), F.char_length(instance).cast("string"))


def totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """words and how often they follow each other in all texts (column ``text``), for the patterns' words."""
    tokens = F.filter(F.split(alike(F.col("text")), rf"[{_BLANK}]++"), lambda t: t != "")
    wanted = patterns.select("pattern.words").distinct()

    def pairs(t: Column) -> Column:
        short = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, short), F.slice(t, 2, short), lambda x, y: F.concat(x, F.lit(" "), y))

    pieces = texts.select(let(tokens, pairs).alias("runs"))
    # Not explode: the filter Spark adds below it would work out the pairs of every text twice, before any other filter.
    return pieces.select(F.explode_outer("runs").alias("words")).join(wanted, "words", "left_semi").groupBy("words").agg(F.count("*").alias("total"))


def counted_words(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``totals`` in all ``texts`` (doc_id, text) for the words of ``patterns`` (pattern, beside) that can be trusted.

    The scores beside a pattern sum to ``beside`` at most. Where a share of the texts alone holds its words more often than
    that allows, it is never trusted and not counted any further. So what is left to count in the next share, or in all
    texts, is a multiple of ``beside`` and does not grow with the number of frequent words.
    """
    for share in SHARES:
        part = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
        known = totals(part, patterns).withColumnRenamed("words", "found")
        left = patterns.join(known, F.col("pattern.words") == F.col("found"), "left")
        left = left.filter(F.coalesce(F.col("beside") / F.col("total") >= CONFIDENCE, F.lit(True)))
        patterns = saved(left.select("pattern", "beside"), "patterns-left")
    return totals(texts, patterns)


def bootstrapped(edges: DataFrame, instances: DataFrame, total: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern and confidence of the trusted patterns, from edges (pattern, instance, n), instances (instance, n, seed) and
    the patterns' occurrences (words, total)."""
    scores = instances.select("instance", F.col("seed").cast("double").alias("score"))
    shaped = instances.select("instance", F.col("n").alias("seen"), "seed", shape(F.col("instance")).alias("shape"))
    beside = edges.join(total, F.col("pattern.words") == total["words"]).drop("words")
    for k in range(rounds):
        judged = beside.join(scores, "instance").groupBy("pattern", "total").agg(
            F.sum(F.col("n") * F.col("score")).alias("good"), F.count_if(F.col("score") >= TRUSTED).alias("support")
        )
        judged = judged.withColumn("confidence", F.col("good") / F.greatest("total", F.lit(1)))
        trusted = saved(judged.filter((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern", F.least("confidence", F.lit(1.0)).alias("confidence")), f"patterns-{k}")
        if k == rounds - 1:
            return trusted
        miss = F.sum(F.log(1 - 0.9 * F.col("confidence")))
        own = edges.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(miss)).alias("own"))
        known = saved(shaped.join(own, "instance", "left").withColumn("own", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0)))), f"instances-{k}")
        alike_ones = known.groupBy("shape").agg((F.sum(F.col("seen") * F.col("own")) / F.sum("seen")).alias("mean"), F.count_if(F.col("own") >= TRUSTED).alias("support"))
        alike_ones = alike_ones.filter(F.col("support") >= SUPPORT).drop("support")
        scores = known.join(alike_ones, "shape", "left").select("instance", F.greatest("own", F.coalesce("mean", F.lit(0.0))).alias("score"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, base (array of spans) and spans (with the context spans), both by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    found = found.withColumn("base", base_spans(F.col("text"))).select("doc_id", "row", "base", candidates(F.col("text"), F.col("base")).alias("candidates"))
    found = saved(found, "spans")
    beside = occurrences(found)
    edges = beside.groupBy("pattern", "instance").agg(F.count("*").alias("n"))
    # A pattern with fewer instances can never be trusted.
    enough = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("beside"))
    enough = enough.filter(F.col("instances") >= SUPPORT).select("pattern", "beside")
    enough = saved(enough, "patterns")
    edges = saved(edges.join(enough, "pattern", "left_semi"), "edges")
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    instances = saved(each.groupBy("instance").agg(F.count("*").alias("n"), F.max(F.col("based") | F.col("seed")).alias("seed")), "instances")
    total = saved(counted_words(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), enough), "totals")
    trusted = bootstrapped(edges, instances, total, rounds)
    digits = F.char_length(F.regexp_replace("instance", "[^0-9]++", ""))
    looks = F.contains("instance", F.lit("@")) | ((digits >= LEAST_DIGITS) & (F.char_length("instance") >= LEAST_CHARACTERS))
    new = beside.filter(~F.col("based") & looks).join(trusted.select("pattern"), "pattern", "left_semi")
    span = F.struct("start", F.lit(len(PATTERNS)).alias("rank"), "end", F.lit("context").alias("kind"))
    new = new.groupBy("row").agg(F.collect_set(span).alias("more"))
    none = F.expr("array()").cast(f"array<{_SPAN}>")
    return found.select("doc_id", "row", "base").join(new, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans")
    )


def joined(spans: Column | str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column | str, kind: str) -> Column:
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
