"""Personal data: base patterns find seeds, whose contexts are bootstrapped into patterns for more.

Base kinds are email, ip, card and phone; spans are code points with an exclusive end. Seeds are what the
base patterns find, and secrets: runs of ``SECRET`` hexadecimal digits or more with both digits and letters.
A seed induces two lexical patterns, the word before it and the two words before it, whatever their length
or distance, and also where they are identifier-like themselves. The graph between patterns and the
identifiers that follow them is scored until no score moves by ``STILL``: a pattern scores the mean score of what
follows it anywhere in the corpus (what is not identifier-like scores 0), an identifier the probability that
one of its patterns is right; seeds score 1, and as seeds never lose theirs, scores only rise. Identifier-like
is a run without white space that has a digit or ``@``. Patterns of score ``LEAST`` with ``SUPPORT`` different
identifiers add the identifiers behind them that no base span touches. Every pattern with ``SUPPORT`` different
identifiers behind it takes part, also one without a seed, since a later round can reach it by an identifier it
shares with another pattern. Their number grows with the corpus, so patterns, counts and scores are joined by
shuffles; of the corpus' word pairs only those are shuffled that a bitmap of fixed size lets through.

Everything is DataFrame operations. The patterns are written so that no alternative is tried twice and no
group repeats: a separator that joins two parts is first replaced by a mark of the same length, so long
runs cost linear time and no stack.

Defined cases: a null text is empty; repeated rows and rows without an id come out each; documents without
personal data come out with zeros. Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from demandlens.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans; secrets are seeds, but no base spans.
ALL_KINDS = (*KINDS, "secret")
LEAST, SUPPORT, STILL = 0.5, 3, 1e-4
#: Hexadecimal digits of a secret at least; bits of the bitmap that word pairs pass.
SECRET, BITS = 32, 1 << 16

#: Stands for a joining separator; one in the text itself is first put out of the way.
MARK, OTHER = "\uE000", "\uE001"
DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
JOINT = r"(?<=[0-9])[\x20-](?=[0-9])"
EMAIL = f"(?:(?<![A-Za-z0-9._%+{MARK}-])|\\G)[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{MARK}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like runs; they start and end at white space.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _marked(text: Column, separator: str) -> Column:
    return F.regexp_replace(F.translate(text, MARK, OTHER), separator, MARK)


def _last_words(gap: Column) -> tuple[Column, Column]:
    """The last word of a gap of any length and the one before it, empty if it has none."""
    plain = F.rtrim(F.translate(gap, "\t\n\x0b\f\r", " " * 5))
    last = F.substring_index(plain, " ", -1)
    rest = F.rtrim(F.substring(plain, F.lit(1), F.length(plain) - F.length(last)))
    return last, F.substring_index(rest, " ", -1)


def _pieces(kind: str, text: Column, pattern: str, when: Column) -> Column:
    """``kind, at, before, word, second, found`` of each match: the length of the gap before it, a token's last two
    words there, itself."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.transform(
        found,
        lambda value, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), value.alias("found")),
    )
    gaps = F.split(text, pattern, -1)
    paired = F.zip_with(
        zipped,
        F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))),
        lambda m, gap: F.struct(
            m["kind"].alias("kind"),
            m["at"].alias("at"),
            F.length(gap).cast("long").alias("before"),
            (_last_words(gap)[0] if kind == "token" else F.lit("")).alias("word"),
            (_last_words(gap)[1] if kind == "token" else F.lit("")).alias("second"),
            m["found"].alias("found"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,at:int,before:bigint,word:string,second:string,found:string>>")
    return F.when(when, paired).otherwise(none)


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = F.when(place % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    size = F.length(digits)
    small = F.forall(
        F.split(found, r"\."),
        lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255),
    )
    card = F.when(size.between(13, 19), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", card)
        .when(kind == "phone", size.between(9, 15))
        .otherwise(F.lit(True))
    )


def spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, end, found, word, second``: base spans, identifier-like runs (kind ``token``) with
    the two words before them, and one row without a kind for a document that has neither. ``row`` tells repeated
    documents apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    col = F.col("text")
    digit = col.rlike("[0-9]")
    found = rows.select(
        "row",
        "doc_id",
        F.explode_outer(
            F.concat(
                _pieces("email", _marked(col, DOT), EMAIL, col.contains("@")),
                _pieces("ip", col, IP, digit),
                _pieces("card", _marked(col, JOINT), CARD, digit),
                _pieces("phone", col, PHONE, col.contains("+")),
                _pieces("token", col, TOKEN, col.rlike("[0-9@]")),
            )
        ).alias("m"),
    ).select("row", "doc_id", "m.*")
    size = F.length("found").cast("long")
    upto = W.partitionBy("row", "doc_id", "kind").orderBy("at")
    end = F.sum(F.col("before") + size).over(upto)
    # Where nothing but white space lies between two runs, the word before the second is the first.
    before, earlier = F.lag("found", 1, "").over(upto), F.lag("word", 1, "").over(upto)
    word = F.when(F.col("word") == "", before).otherwise(F.col("word"))
    second = F.when(F.col("word") == "", earlier).when(F.col("second") == "", before).otherwise(F.col("second"))
    placed = found.select(
        "row", "doc_id", "kind", word.alias("word"), second.alias("second"), "found", (end - size).alias("start"), end.alias("end")
    )
    return placed.filter(F.col("kind").isNull() | (F.col("kind") == "token") | _valid(F.col("kind"), F.col("found")))


def _patterns(word: Column, second: Column) -> Column:
    """The patterns of a run: its last word, and its last two."""
    return F.filter(F.array(F.when(word != "", word), F.when((word != "") & (second != ""), F.concat_ws(" ", second, word))), lambda p: p.isNotNull())


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each pattern stands anywhere in the texts.

    Counted before the join, so each task sends a pattern once. Pairs of words are too many to be sent, so a
    bitmap of the patterns' hashes holds back most of the others; what it lets through is joined exactly.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    place = lambda p: F.pmod(F.xxhash64(p), F.lit(BITS)).cast("int")
    hit = patterns.select(place(F.col("pattern")).alias("bit")).distinct().withColumn("hit", F.lit(True))
    bits = docs.sparkSession.range(BITS).select(F.col("id").cast("int").alias("bit")).join(hit, "bit", "left")
    bitmap = bits.agg(F.sort_array(F.collect_list(F.struct("bit", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("all"))
    bitmap = stage(bitmap.select(F.transform("all", lambda b: b["hit"]).alias("hits")), "bitmap").scalar()
    listed = docs.select(words.alias("words"))
    pairs = F.zip_with(
        F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words") + 1), lambda a, b: F.concat_ws(" ", a, b)
    )
    each = listed.select(F.explode(F.concat(F.col("words"), pairs)).alias("pattern"))
    likely = each.filter(F.get(bitmap, place(F.col("pattern"))))
    return likely.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern").select("pattern", "total")


def _secret(run: str) -> Column:
    """The part of a run that is a secret, or NULL."""
    hexes = F.regexp_extract(run, f"(?<![0-9A-Za-z])[0-9A-Fa-f]{{{SECRET},}}+(?![0-9A-Za-z])", 0)
    return F.when(hexes.rlike("[0-9]") & hexes.rlike("[A-Fa-f]"), hexes)


def _runs(found: DataFrame) -> DataFrame:
    """``row, from, to, patterns, secret, value, lead``: identifier-like runs without the marks around them.

    ``lead`` is where in the run the value begins.
    """
    runs = found.filter("kind = 'token'").withColumn("secret", _secret("found"))
    front, back = r"^[^\p{L}\p{N}+]+", r"[^\p{L}\p{N}=]+$"
    plain = F.regexp_replace(F.regexp_replace("found", front, ""), back, "")
    lead = F.when(F.col("secret").isNotNull(), F.expr("locate(secret, found) - 1")).otherwise(F.length(F.regexp_extract("found", front, 0)))
    return runs.select(
        "row",
        F.col("start").alias("from"),
        F.col("end").alias("to"),
        _patterns(F.lower("word"), F.lower("second")).alias("patterns"),
        "secret",
        F.coalesce("secret", plain).alias("value"),
        lead.alias("lead"),
    )


def _scored(pairs: DataFrame) -> DataFrame:
    """``pattern, kind, confidence, support`` from ``pattern, value, total, n, kind`` (kind: seeds only)."""
    first = pairs.select("value", "kind").groupBy("value").agg(F.min("kind").alias("kind"))
    scores = stage(first.select("value", "kind", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score")), "scores")
    while True:
        scored = pairs.select("pattern", "value", "total", "n").join(scores, "value")
        each = scored.groupBy("pattern", "total", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("sum"),
            F.sum((F.col("score") >= LEAST).cast("int")).alias("support"),
        )
        best = F.max(F.struct(F.col("sum"), F.col("support"), "kind"))
        patterns = each.filter("kind IS NOT NULL").groupBy("pattern", "total").agg(best.alias("b"))
        patterns = stage(
            patterns.select("pattern", F.col("b.kind").alias("kind"), (F.col("b.sum") / F.col("total")).alias("confidence"), F.col("b.support").alias("support")),
            "patterns",
        )
        sure = patterns.select("pattern", F.col("kind").alias("pattern_kind"), "confidence")
        right = F.least(F.col("confidence"), F.lit(0.999999))
        reached = pairs.select("pattern", "value").join(sure, "pattern").groupBy("value").agg(
            (1 - F.exp(F.sum(F.log1p(-right)))).alias("reached"), F.max(F.struct("confidence", "pattern_kind")).alias("by")
        )
        known = scores.join(reached, "value", "left")
        learned = F.coalesce(F.col("reached"), F.lit(0.0))
        moved = stage(
            known.select(
                "value",
                F.when((F.col("score") == 1.0) | (learned < LEAST), F.col("kind")).otherwise(F.coalesce("kind", "by.pattern_kind")).alias("kind"),
                F.when(F.col("score") == 1.0, F.lit(1.0)).otherwise(learned).alias("score"),
                F.col("score").alias("was"),
            ),
            "scores",
        )
        if moved.filter(F.abs(F.col("score") - F.col("was")) > STILL).isEmpty():
            return patterns
        scores = moved.select("value", "kind", "score")


def discover(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of secrets, and of identifiers that patterns learned from the seeds add."""
    tokens = _runs(found)
    base = found.filter(F.col("kind").isin(*KINDS)).select("row", "kind", "start", "end", F.col("found").alias("seed"))
    # A run that a base span starts in is that span's; what is before it is the seed's pattern.
    touched = tokens.join(base, "row", "left").filter(F.col("kind").isNotNull() & (F.col("from") < F.col("end")) & (F.col("start") < F.col("to")))
    kinds = touched.groupBy("row", "from").agg(F.min(F.struct("start", "kind", "seed")).alias("s"))
    kinds = kinds.select("row", "from", F.col("s.kind").alias("base"), F.col("s.seed").alias("seed"), (F.col("s.start") >= F.col("from")).alias("first"))
    graph = tokens.join(kinds, ["row", "from"], "left").filter("value <> '' AND (base IS NULL OR first)")
    kind = F.coalesce("base", F.when(F.col("secret").isNotNull(), "secret"))
    graph = stage(graph.withColumns({"value": F.coalesce("seed", "value"), "kind": kind}), "graph")
    linked = graph.select(F.explode("patterns").alias("pattern"), "value", "kind")
    linked = stage(linked.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.min("kind").alias("kind")), "linked")
    often = linked.groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") >= SUPPORT)
    totals = _occurrences(docs, stage(often.select("pattern"), "often"))
    patterns = _scored(stage(linked.join(totals, "pattern").select("pattern", "value", "total", "n", "kind"), "pairs"))
    good = patterns.filter((F.col("confidence") >= LEAST) & (F.col("support") >= SUPPORT))
    open_ = graph.filter("kind IS NULL").select("row", "from", "lead", "value", F.explode("patterns").alias("pattern"))
    new = open_.join(good.select("pattern", F.col("kind").alias("by"), "confidence"), "pattern")
    # Of a run's patterns the surer one names its kind.
    new = new.groupBy("row", "from", "lead", "value").agg(F.max(F.struct("confidence", "by")).alias("best"))
    new = new.select("row", F.col("best.by").alias("kind"), "from", "lead", "value")
    new = new.unionByName(graph.filter("kind = 'secret'").select("row", "kind", "from", "lead", "value"))
    start = F.col("from") + F.col("lead")
    new = new.select("row", "kind", start.alias("start"), (start + F.length("value")).alias("end"))
    inside = base.select(F.col("row").alias("in"), F.col("start").alias("s"), F.col("end").alias("e"))
    return new.join(inside, (F.col("row") == F.col("in")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")


def find(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the number of base spans of each base kind, ``base`` and ``spans`` (all) as arrays of
    ``kind, start, end`` in the order of kinds and starts."""
    found = stage(spans(docs), "spans")
    base = found.filter("kind IS NULL OR kind <> 'token'").select("row", "kind", "start", "end", F.lit(False).alias("added"))
    more = discover(docs, found).select("row", "kind", "start", "end", F.lit(True).alias("added"))
    rows = found.select("row", "doc_id").distinct()
    each = F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).alias("order"), "start", "end", "kind", "added")
    listed = base.unionByName(more).filter("kind IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_list(each)).alias("all"))
    out = rows.join(listed, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))
    bare = lambda items: F.transform(items, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = out.select("doc_id", bare(F.filter("all", lambda s: ~s["added"])).alias("base"), bare(F.col("all")).alias("spans"))
    return out.withColumns({f"n_{kind}": _number("base", kind) for kind in KINDS})


def _number(items: str, kind: str) -> Column:
    return F.size(F.filter(items, lambda s: s["kind"] == kind)).cast("long")


def joined(items: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
