"""Personal data: fixed patterns as seeds, and contexts learned from them.

The base spans are emails, IP addresses, card and phone numbers by fixed patterns. They are
the seeds of a bootstrap. A lexical pattern is what stands around an identifier: the two words
before it, or the word before and the word after. Patterns and the identifiers they surround
form a graph. In each round a pattern's confidence in a kind is the share of its distinct
identifiers that are of this kind (with one added to their number, so that rare patterns stay
unsure), and an identifier's score is the mean confidence of its patterns. Identifiers that
no fixed pattern matches, but that look like the kind and that sure patterns surround, become
further spans.

Only DataFrame functions are used. Positions are in code points, ends exclusive.

What may be an identifier is told by its look: words with a digit, with ``@``, ``(at)`` or
``[at]``, and runs of digit groups with single blanks between them. Closing punctuation is not
part of it. The context is taken from the text between an identifier and its neighbours, so the
work is in proportion to the text, however many identifiers it has.

Edge cases: a null text counts as empty and has no span. Patterns match from left to right
without overlap within a kind; a match that fails its further test is dropped whole. Spans of
different kinds may overlap. Found spans never overlap a base span. Repeated rows give equal
rows, and a repeated identifier counts once for a pattern. Of kinds that are equally sure the
last in alphabetical order is taken. An empty table has no pattern and gives no rows. Very long
texts are searched whole; a task holds the spans of one text and, where it is redacted, its
characters as an array. Only ``doc_id`` and ``text`` are read, and ``redacted`` passes all other
columns through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import GAP, let, scan, staged
from batchloom.operators.ordering import free_name
from batchloom.sources.catalog import quoted

KINDS = ("email", "ip", "card", "phone")
# The quantifiers never give back: nothing a match could gain by that, and no deep recursion
# on long texts. A match starts at the start of a run, or where the last match ended.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IN, _GROUP = r"[^\x20\x09-\x0D]", r"[(]?+[0-9][0-9().-]*+"
#: What may be an identifier no fixed pattern knows: groups of digits; a word with an at sign
#: in some spelling; a word with a digit. Closing punctuation is cut off later.
IDENTIFIER = (
    rf"(?<!{_IN})(?:{_GROUP}(?:\x20{_GROUP})++"
    rf"|[^\x20\x09-\x0D@(\[]*+(?:[(\[](?!at[)\]])[^\x20\x09-\x0D@(\[]*+)*+(?:@|\(at\)|\[at\]){_IN}++"
    rf"|[^\x20\x09-\x0D0-9]*+[0-9]{_IN}*+)"
)
CLOSING = r"[.,;:!?]+$"
#: What a found identifier of a kind must look like.
LOOKS = {
    "email": r"@|\(at\)|\[at\]",
    "ip": r"[0-9][.:][0-9]+[.:][0-9]+[.:][0-9]|[0-9a-f]*:[0-9a-f]*:[0-9a-f:]+",
    "card": r"(?:[0-9][^0-9]*){12}",
    "phone": r"(?:[0-9][^0-9]*){7}",
}
ROUNDS = 3
MIN_CONFIDENCE = 0.8
SPAN = "struct<start:int,end:int,value:string,patterns:array<string>>"
PLACED = "struct<kind:string,start:int,end:int,value:string,patterns:array<string>>"


def located(text: Column, pattern: str) -> Column:
    """The matches of the pattern in the text as an array of ``SPAN``."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )
    return let(parts, lambda p: _spans(p["gaps"], p["found"]))


def _spans(gaps: Column, found: Column) -> Column:
    """From the matches and the texts before, between and behind them."""
    some, blank = F.size(found), F.array(F.lit(""))
    # Of each match: the text before it back to the one before the last, and so on behind it.
    rows = F.arrays_zip(
        F.slice(gaps, 1, some).alias("gap"),
        found.alias("value"),
        F.concat(blank, F.slice(gaps, 1, F.greatest(some - 1, F.lit(0)))).alias("gap_before"),
        F.concat(blank, F.slice(found, 1, F.greatest(some - 1, F.lit(0)))).alias("value_before"),
        F.slice(gaps, 2, some).alias("gap_behind"),
        F.concat(F.slice(found, 2, some), blank).alias("value_behind"),
    )
    length = lambda x: F.length(x["gap"]) + F.length(x["value"])

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        value = F.regexp_replace(x["value"], CLOSING, "")
        before = F.concat(x["gap_before"], x["value_before"], x["gap"])
        closing = F.regexp_extract(x["value"], CLOSING, 0)
        behind = F.concat(closing, x["gap_behind"], x["value_behind"])
        return F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            _patterns(before, behind).alias("patterns"),
        )

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    spans = scan(rows, F.lit(0), lambda at, x: at + length(x), span, SPAN)
    return F.when(some > 0, spans).otherwise(none)


def _holds(kind: str, value: Column) -> Column:
    """The further test of a kind."""
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of a kind; texts without its key character are not searched."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    key = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    may = text.contains(key) if key else F.lit(True)
    if kind != "email":
        may = may & text.rlike("[0-9]")
    found = F.filter(located(text, PATTERNS[kind]), lambda x: _holds(kind, x["value"]))
    return F.when(may, found).otherwise(none)


def _typed(kind: str | None, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x["start"], x["end"], F.lower(x["value"]).alias("value"), x["patterns"]).cast(PLACED),
    )


def _patterns(before: Column, behind: Column) -> Column:
    """The lexical patterns around a span: two words before it; one before and one behind.

    Digits count as alike. Where the context holds fewer words, a mark stands for the missing one.
    """
    plain = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    words = F.filter(F.split(F.concat(F.lit("^ ^ "), plain(before)), GAP), lambda w: w != "")
    then = F.filter(F.split(F.concat(plain(behind), F.lit(" $")), GAP), lambda w: w != "")
    last = lambda w: F.element_at(w, -1)
    return F.array(
        let(words, lambda w: F.concat(F.lit("L "), F.element_at(w, -2), F.lit(" "), last(w))),
        F.concat(F.lit("M "), last(words), F.lit(" _ "), F.element_at(then, 1)),
    )


def _apart(spans: Column, others: Column) -> Column:
    """The ``others`` that overlap none of the spans: two passes over both in order of place.

    Going up, an overlap shows by the farthest end of the spans so far; going down, by their
    least start.
    """
    far = F.lit(2**31 - 1)
    event = f"struct<start:int,own:boolean,free:boolean,x:{PLACED}>"

    def marked(x: Column, own: bool) -> Column:
        return F.struct(x["start"], F.lit(own).alias("own"), F.lit(True).alias("free"), x.alias("x")).cast(event)

    both = F.array_sort(F.concat(
        F.transform(spans, lambda x: marked(x, True)), F.transform(others, lambda x: marked(x, False))
    ))

    def free(e: Column, fits: Column) -> Column:
        return F.struct(e["start"], e["own"], (e["free"] & fits).alias("free"), e["x"])

    up = scan(
        both, F.lit(-1),
        lambda end, e: F.when(e["own"], F.greatest(end, e["x"]["end"])).otherwise(end),
        lambda end, e: free(e, end <= e["start"]), event,
    )
    down = scan(
        F.reverse(up), far,
        lambda start, e: F.when(e["own"], F.least(start, e["start"])).otherwise(start),
        lambda start, e: free(e, start >= e["x"]["end"]), event,
    )
    left = F.filter(down, lambda e: ~e["own"] & e["free"])
    return F.reverse(F.transform(left, lambda e: e["x"]))


def survey(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, mark`` (a hash of the text), base ``spans``, and ``around``: the kind
    (null for others that may be identifiers), place, value and patterns of each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumns({kind: base_spans(F.col("text"), kind) for kind in KINDS})
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    may = F.col("text").rlike(r"[0-9@]|[(\[]at[)\]]")
    words = F.when(may, located(F.col("text"), IDENTIFIER)).otherwise(none)
    rows = rows.withColumn("spans", F.concat(*(_typed(kind, F.col(kind)) for kind in KINDS)))
    rows = rows.withColumn("others", _typed(None, words)).drop(*KINDS)
    apart = F.when((F.size("spans") > 0) & (F.size("others") > 0), _apart(F.col("spans"), F.col("others")))
    rows = rows.withColumn("apart", F.coalesce(apart, "others"))
    place = F.transform("spans", lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return rows.select(
        "doc_id", F.xxhash64("text").alias("mark"), place.alias("spans"), F.concat("spans", "apart").alias("around")
    )


def sure_patterns(edges: DataFrame) -> DataFrame:
    """``pattern, kind, confidence`` of the graph ``pattern, value, seed`` after the rounds."""
    edges = staged(edges.distinct())
    values = edges.select("value", "seed").distinct()
    # Seeds score 1 for their kind and 0 for others; the rest start from 0.
    scores = values.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    seeds = scores
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    degree = edges.groupBy("value").agg(F.countDistinct("pattern").alias("patterns"))
    links = edges.select("pattern", "value").distinct()
    for _ in range(ROUNDS):
        confidence = staged(
            links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
            .join(sizes, "pattern")
            .select("pattern", "kind", (F.col("score") / (F.col("n") + 1)).alias("confidence"))
        )
        learned = (
            links.join(confidence.where("confidence >= 0.5"), "pattern")
            .groupBy("value", "kind").agg(F.sum("confidence").alias("score"))
            .join(degree, "value")
            .select("value", "kind", (F.col("score") / F.col("patterns")).alias("score"))
        )
        new = learned.join(seeds.select("value").distinct(), "value", "left_anti")
        scores = staged(seeds.unionByName(new))
    return confidence


def discovered(surveyed: DataFrame) -> DataFrame:
    """``doc_id, mark, found``: the further spans of the documents that have any."""
    around = surveyed.select("doc_id", "mark", F.explode("around").alias("x"))
    edges = around.select(F.explode("x.patterns").alias("pattern"), F.col("x.value").alias("value"), F.col("x.kind").alias("seed"))
    sure = sure_patterns(edges).where(F.col("confidence") >= MIN_CONFIDENCE)
    open_ = around.where("x.kind is null").select("doc_id", "mark", "x.start", "x.end", "x.value", F.explode("x.patterns").alias("pattern"))
    looks = reduce(lambda old, kind: old.when(F.col("kind") == kind, F.col("value").rlike(LOOKS[kind])), KINDS, F.when(F.lit(False), F.lit(False)))
    best = (
        open_.join(sure, "pattern").where(looks)
        .groupBy("doc_id", "mark", "start", "end")
        .agg(F.max(F.struct("confidence", "kind")).alias("best"))
    )
    span = F.struct(F.col("best.kind").alias("kind"), "start", "end")
    # Spans of one text: as many as it has words at most.
    return best.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(span)).alias("found"))


def _written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, by kind in the fixed order, then by start."""
    def of(kind: str) -> Column:
        own = F.filter(spans, lambda x: x["kind"] == kind)
        places = F.sort_array(F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.transform(places, lambda x: F.concat(F.lit(f"{kind}:"), x["start"], F.lit(":"), x["end"]))

    texts = [of(kind) for kind in KINDS]
    return F.array_join(F.concat(*texts), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, mark, spans`` (base) and ``found`` (further ones)."""
    surveyed = staged(survey(docs))
    more = discovered(surveyed).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return (
        surveyed.select("doc_id", "mark", "spans").join(more, same, "left")
        .select("doc_id", "mark", "spans", F.coalesce("found", none).alias("found"))
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans written out, for each row."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_written(F.col("spans")), 256).alias("base_sha256"),
        _written(F.concat("spans", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first. A text without a
    span, or null, stays as it is.
    """
    found = find(docs).where("size(spans) + size(found) > 0").distinct()
    names = {name: free_name(docs, name) for name in ("id", "mark", "spans", "text")}
    keyed = found.select(
        F.col("doc_id").alias(names["id"]), F.col("mark").alias(names["mark"]),
        F.concat("spans", "found").alias(names["spans"]),
    )
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col(names["id"])) & (mark == F.col(names["mark"]))
    spans = F.col(names["spans"])
    text = F.when(spans.isNull(), F.col("text")).otherwise(_replaced(F.col("text"), spans))
    # Worked out beside the old text, since the new one is made of it.
    kept = docs.join(keyed, same, "left").withColumn(names["text"], text)
    new = {"text": F.col(names["text"]).alias("text")}
    return kept.select(*(new.get(c, F.col(quoted(c))) for c in docs.columns))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; its characters are an array, so that pieces are cut
    without counting from the text's start each time."""
    places = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"])))

    def cut(chars: Column, start: Column, length: Column) -> Column:
        return F.array_join(F.slice(chars, start + 1, length), "")

    def filled(chars: Column, order: Column) -> Column:
        pieces = scan(
            order, F.lit(0),
            lambda at, x: F.greatest(at, x["end"]),
            lambda at, x: F.when(
                x["start"] >= at,
                F.concat(cut(chars, at, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]")),
            ).otherwise(""),
            "string",
        )
        end = F.array_max(F.transform(order, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), cut(chars, end, F.size(chars)))

    return let(F.split(text, "", -1), lambda chars: let(places, lambda order: filled(chars, order)))
