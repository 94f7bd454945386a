"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone
numbers. All of them, whatever their digits and length, seed the bootstrap: the
words around a seed are its lexical patterns, and words with a digit or an at sign
that stand in the same patterns are candidate instances; words of other characters
alone are none. Patterns and instances form a bipartite graph that Spark
scores in turns: a pattern's confidence is the weight of its instances over
their number plus one, an instance's weight is 1 for a seed and else one minus
the product of its patterns' doubts. Instances that end above the bar through
patterns with enough different seeds are identifiers that no fixed pattern
knows.

Regular expressions are anchored so that each position is tried once: scanning
is linear in the text whatever it holds. Positions are code points, ends
exclusive.

Context words are read within WINDOW code points of a span; of a longer word beside
it the part within is the context word.

Edge cases: a null or empty text has no spans; rows are told apart by id and
text together, so null and repeated doc_ids keep their rows and their own spans;
equal rows have equal spans; an empty table gives no rows; extra columns are
ignored by ``find_personal_data`` and kept by ``redact``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.shared import free_name, written

KINDS = ("email", "ip", "card", "phone")
ADDED = "context"
#: Turns of scoring; different seeds that a pattern needs; least confidence of a pattern and weight of an instance to count.
TURNS, LEAST_SEEDS, SURE_PATTERN, SURE_INSTANCE = 3, 3, 0.5, 0.75
#: Characters that a candidate, not a seed, has at least.
LEAST_LENGTH = 6
#: Code points before and after a candidate in which its context words are read.
WINDOW = 80
#: Spans of a text that are placed or masked as one list, so that very many spans do not copy one list or scan one text for each.
BLOCK = 256

# The contract's patterns; \G and the look-behind only forbid starts inside a run that an earlier start has tried.
_FIXED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of 16 digits or more: a match of the contract's pattern is a whole run, so shorter ones need no place.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Word with a digit or an at sign, one of which every valid span of a fixed pattern holds: from the start of a run without white space.
_MARKED_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_BYTE = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_NO_STRINGS = "array<string>"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(F.reverse(digits), i, F.lit(1)).cast("int").alias("d")))
    weighed = F.transform(values, lambda v: F.when(v["i"] % 2 == 1, v["d"]).when(v["d"] > 4, v["d"] * 2 - 9).otherwise(v["d"] * 2))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(_BYTE))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _placed(hits: Column, gaps: Column, kind: Column) -> Column:
    """Spans of the matches from the texts between them."""
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    def block(held: Column, a: Column, i: Column) -> Column:
        # A list grows by being copied, so long ones are made of short ones.
        own = F.aggregate(F.slice(held, i * BLOCK + 1, F.lit(BLOCK)), F.struct(a["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(a["out"], F.array(own["out"])).alias("out"))

    def placed(held: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, start, lambda a, i: block(held, a, i), lambda a: F.flatten(a["out"]))

    # The pairs are one value in here, not made anew for every block.
    return F.get(F.transform(F.array(pairs), placed), F.lit(0))


def _with_spans(rows: DataFrame, name: str, patterns: dict[str, str], needs: dict[str, str | None]) -> DataFrame:
    """Add an array of the patterns' spans in ``content``; a text is scanned again for positions only where a pattern matched."""
    hits = {k: F.regexp_extract_all("content", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    none = F.array().cast(_NO_STRINGS)
    rows = rows.withColumns({f"_{k}": F.when(F.contains(F.col("content"), F.lit(needs[k])), h).otherwise(none) if needs.get(k) else h for k, h in hits.items()})
    rows = rows.withColumns({f"_{k}": F.when(F.size(f"_{k}") > 0, _placed(F.col(f"_{k}"), F.split("content", p, -1), F.lit(k))).otherwise(F.array().cast(_SPAN)) for k, p in patterns.items()})
    kept = [F.filter(f"_{k}", partial(_valid_span, k)) for k in patterns]
    return rows.withColumn(name, F.concat(*kept)).drop(*(f"_{k}" for k in patterns))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("content"))


def _context_word(text: Column, last: bool) -> Column:
    """The last or first word of a text, lower-cased, digits as 0."""
    word = F.regexp_extract(text, r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*$" if last else r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1)
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def _candidates(rows: DataFrame) -> DataFrame:
    """Rows (row, key, base, gaps, hits) to one row for each span that begins in a word with a digit or an at sign, or for the word: key, start, end, instance, seed, patterns.

    Words and spans are rows of their own. Places of words are running sums, contexts come from the texts between words, and
    a word meets the spans around it as running values over both in order, so the work is that of two sorts of a text's words.
    """
    nothing, no_span, no_word = F.lit(""), F.lit(None).cast(_SPAN[6:-1]), F.lit(None).cast("struct<gaps:string,hits:string>")
    parts = F.concat(
        F.transform(F.arrays_zip("gaps", "hits"), lambda w, i: F.struct(i.alias("pos"), w.alias("w"), no_span.alias("span"))),
        F.transform("base", lambda s: F.struct(F.lit(-1).alias("pos"), no_word.alias("w"), s.alias("span"))),
    )
    cut = rows.where(F.size("hits") > 0).select("row", "key", F.explode(parts).alias("p")).select("row", "key", "p.pos", F.coalesce("p.w.gaps", nothing).alias("gap"), F.coalesce("p.w.hits", nothing).alias("hit"), "p.span")
    by = Window.partitionBy("row").orderBy("pos")
    tail, head = F.expr(f"right(gap, {WINDOW})"), F.expr(f"left(gap, {WINDOW})")
    placed = cut.withColumns({
        "word_end": F.sum(F.length("gap") + F.length("hit")).over(by.rowsBetween(Window.unboundedPreceding, 0)),
        "left": F.concat(F.coalesce(F.lag(F.expr(f"right(hit, {WINDOW})")).over(by), nothing), tail),
        "right": F.concat(F.coalesce(F.lead(head).over(by), nothing), F.coalesce(F.lead(F.expr(f"left(hit, {WINDOW})")).over(by), nothing)),
    }).where("hit <> '' or span is not null")
    is_word = F.col("span").isNull()
    at = F.when(is_word, F.col("word_end") - F.length("hit")).otherwise(F.col("span.start"))
    ordered = placed.select("row", "key", at.alias("at"), "span", F.when(is_word, F.struct("word_end", "left", "right", "hit")).alias("word"))
    # Words before spans of the same place: what stands before a word and ends after its start only goes on in it.
    both = Window.partitionBy("row").orderBy("at", F.col("span").isNotNull())
    told = ordered.withColumns({
        "inside": F.coalesce(F.max("span.end").over(both.rowsBetween(Window.unboundedPreceding, -1)) > F.col("at"), F.lit(False)),
        # Words do not overlap, so only what comes next can begin in one.
        "begun": F.coalesce(F.lead("span.start").over(both) < F.col("word.word_end"), F.lit(False)),
        "around": F.last("word", ignorenulls=True).over(both.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # A span is read in the word in which it begins; a word in which none begins stands for itself.
    named = told.where((F.col("span").isNull() & ~F.col("inside") & ~F.col("begun")) | (F.col("span").isNotNull() & (F.col("at") < F.col("around.word_end"))))
    inner = F.regexp_extract("around.hit", r"^[^A-Za-z0-9]*+(.*?)[^A-Za-z0-9]*$", 1)
    before = F.regexp_extract("around.hit", r"^([^A-Za-z0-9]*+)", 1)
    near, far = _context_word(F.col("around.left"), True), _context_word(F.regexp_replace("around.left", r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*$", ""), True)
    after = _context_word(F.col("around.right"), False)
    first = F.col("around.word_end") - F.length("around.hit") + F.length(before)
    out = named.select(
        "key", first.cast("int").alias("start"), (first + F.length(inner)).cast("int").alias("end"),
        F.lower(F.coalesce("span.value", inner)).alias("instance"),
        F.col("span").isNotNull().alias("seed"),
        F.array(F.concat_ws(" ", F.lit("<"), far, near), F.concat_ws(" ", F.lit("="), near, F.lit("_"), after)).alias("patterns"),
    )
    return out.where(F.col("seed") | (F.length("instance") >= LEAST_LENGTH))


def bootstrap(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored patterns (pattern, confidence, seeds) and found instances (instance, weight) from rows (instance, seed, patterns).

    All aggregations combine before their shuffle, so a pattern or instance with a great share of all rows is a few rows a task.
    """
    edges = written(candidates.select(F.explode("patterns").alias("pattern"), "instance", F.col("seed").cast("int").alias("seed")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    seeds = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("weight"), F.max("seed").alias("seed"))
    weights, patterns = written(seeds, "weights"), None
    for _ in range(TURNS):
        told = edges.drop("seed").join(weights, "instance")
        patterns = written(told.groupBy("pattern").agg((F.sum("weight") / (F.count("*") + 1)).alias("confidence"), F.sum("seed").alias("seeds")), "patterns")
        sure = patterns.where((F.col("confidence") >= SURE_PATTERN) & (F.col("seeds") >= LEAST_SEEDS))
        doubt = edges.drop("seed").join(sure, "pattern").groupBy("instance").agg(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).alias("doubt"))
        weights = written(weights.join(doubt, "instance", "left").select("instance", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("weight"), "seed"), "weights")
    return patterns, weights.where((F.col("seed") == 0) & (F.col("weight") >= SURE_INSTANCE)).select("instance", "weight")


def discovered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written base spans (key, doc_id, base) of every row, and the spans (key, added) that the bootstrap adds."""
    rows = _with_spans(_keyed(docs), "base", _FIXED, _NEEDS).withColumn("hits", F.regexp_extract_all("content", F.lit(_MARKED_WORD), F.lit(0)))
    gaps = F.when(F.size("hits") > 0, F.split("content", _MARKED_WORD, -1))
    held = written(rows.select(F.monotonically_increasing_id().alias("row"), "key", "doc_id", "base", gaps.alias("gaps"), "hits"), "scanned")
    found = written(_candidates(held.drop("doc_id")), "candidates")
    _, instances = bootstrap(found.select("instance", "seed", "patterns"))
    spans = found.where("not seed").join(instances, "instance").select("key", F.struct(F.lit(ADDED).alias("kind"), "start", "end").alias("span")).distinct()
    return held.select("key", "doc_id", "base"), spans.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("added"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end), by kind, then start, of every row of ``docs(doc_id, text)``."""
    base, added = discovered(docs)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return base.join(added, "key", "left").select("doc_id", F.concat(plain, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def personal_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != ADDED)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(ADDED).alias(f"n_{ADDED}"),
    )


def _masked(content: Column, spans: Column) -> Column:
    """The text with each span, in order of start, replaced by its kind; a span that begins inside an earlier one is part of it."""

    def step(part: Column, low: Column, a: Column, s: Column) -> Column:
        gap = F.substring(part, a["at"] - low + 1, s["start"] - a["at"])
        kept = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        return F.when(s["start"] >= a["at"], kept).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    def block(a: Column, i: Column) -> Column:
        own = F.slice(spans, i * BLOCK + 1, F.lit(BLOCK))
        # The part of the text that these spans cover is cut out once, and is a value of its own in here.
        part = F.array(F.substring(content, a["at"] + 1, F.greatest(F.array_max(F.transform(own, lambda s: s["end"])) - a["at"], F.lit(0))))
        done = F.get(F.transform(part, lambda p: F.aggregate(own, F.struct(a["at"].alias("at"), F.lit("").alias("out")), lambda x, s: step(p, a["at"], x, s))), F.lit(0))
        return F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(content, a["at"] + 1, F.length(content)))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), start, block, rest)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns kept, with every span in ``text`` replaced by its kind in angle brackets; texts without spans stay as they are.

    Spans are joined by row key; rows without spans are not in that table, which is what the join moves besides the documents.
    """
    base, added = discovered(docs)
    own_key, own_spans = free_name(docs, "span_key"), free_name(docs, "spans")
    every = base.join(added, "key", "left").select("key", F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.transform(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    spans = written(every.where(F.size("spans") > 0).dropDuplicates(["key"]).select(F.col("key").alias(own_key), F.array_sort("spans").alias(own_spans)), "spans")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    joined = docs.join(spans, key == F.col(own_key), "left")
    return joined.withColumn(text, F.when(F.col(own_spans).isNull(), F.col(text)).otherwise(_masked(F.col(text), F.col(own_spans)))).drop(own_key, own_spans)
