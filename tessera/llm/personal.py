"""Personal data: fixed patterns, and identifiers discovered through the contexts that the fixed patterns share."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, spread, table

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: The base patterns. Possessive repeats and the look-behind change no match, they only keep failing ones linear; an email
#: is looked for from its @.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What may be an identifier that the base patterns miss: a run of digits and the marks that part them, or a word with an
#: @ in any spelling.
_NUMBER = re.compile(r"(?<![^\W_])\+?\(?[0-9](?:[\x20().:/-]{0,3}[0-9])++(?![^\W_])")
_AT = re.compile(r"@|\x20?[\[(](?:at|AT|At)[\])]\x20?")
_WORD = re.compile(r"[^\W\d_]+")

#: Words before a span that make its pattern; characters in which they are looked for, and those allowed in between.
CONTEXT_WORDS, CONTEXT_REACH, CONTEXT_GAP = 2, 96, 4

#: Rounds of scoring at most; distinct values that a pattern needs to have seen; its least score in the end, and while it
#: lends worth to its values. Scoring ends once a round changes the sum of the scores by less than SETTLED.
ROUNDS, SUPPORT, CONFIDENCE, LENDING, SETTLED = 8, 3, 0.8, 0.7, 1e-3


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all that the base patterns find, by kind, then start; code points, end exclusive."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((EMAIL, start, done))
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((PHONE, m.start(), m.end()))
    return out


def context(text: str, start: int) -> str | None:
    """The words right before a place, lower case; None if there are too few or something else stands between."""
    before = text[max(0, start - CONTEXT_REACH) : start]
    words = list(_WORD.finditer(before))[-CONTEXT_WORDS:]
    if len(words) < CONTEXT_WORDS or len(before) - words[-1].end() > CONTEXT_GAP:
        return None
    if words[0].start() == 0 and start > CONTEXT_REACH:
        return None  # the first may be cut off
    if any(c.isalnum() for c in before[words[0].end() : words[1].start()] + before[words[-1].end() :]):
        return None
    return " ".join(w[0].lower() for w in words)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(mask of the kinds it may be of, start, end) of possible identifiers that overlap no base span."""
    opens: list[int] = []
    closes: list[int] = []
    for start, end in sorted((a, b) for _, a, b in taken):  # spans of different kinds may overlap
        if closes and start <= closes[-1]:
            closes[-1] = max(closes[-1], end)
        else:
            opens.append(start)
            closes.append(end)

    def free(start: int, end: int) -> bool:
        before = bisect_left(opens, end)
        return before == 0 or closes[before - 1] <= start

    for m in _NUMBER.finditer(text):
        count = len(_digits(m[0]))
        if 5 <= count <= 24 and free(m.start(), m.end()):
            kinds = (1 << IP) * ("." in m[0] or ":" in m[0]) | (1 << CARD) * (12 <= count <= 19) | (1 << PHONE) * (6 <= count <= 15)
            if kinds:
                yield kinds, m.start(), m.end()
    place = 0
    while m := _AT.search(text, place):
        start, end = m.start(), m.end()
        while start > place and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        place = max(end, m.end())
        while end > m.end() and not text[end - 1].isalnum():
            end -= 1
        if start < m.start() and end > m.end() and free(start, end):
            yield 1 << EMAIL, start, end


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_CUES = pa.list_(pa.struct([
    ("context", pa.string()), ("value", pa.string()), ("kind", pa.int32()), ("may", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
]))
_SCANNED = (
    "print long, spans array<struct<kind int, start int, end int>>, "
    "cues array<struct<context string, value string, kind int, may int, start int, end int>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, cues = [], []
        for value in batch.column(2):
            text = value.as_py() or ""
            base = base_spans(text)
            own = []
            for kind, start, end in base:
                if (c := context(text, start)) is not None:
                    own.append({"context": c, "value": text[start:end].lower(), "kind": kind, "may": 1 << kind, "start": start, "end": end})
            for may, start, end in candidates(text, base):
                if (c := context(text, start)) is not None:
                    own.append({"context": c, "value": text[start:end].lower(), "kind": -1, "may": may, "start": start, "end": end})
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            cues.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, _SPANS), pa.array(cues, _CUES)], names=["id", "print", "spans", "cues"]
        )


def score_patterns(scratch: Scratch, scanned: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """The patterns worth trusting: context, kind (``of``), score.

    An edge joins a context with each distinct value seen after it, for each kind that the value may be of. A base entity
    is worth 1 for its kind. A pattern (a context for a kind) scores the mean worth of its values, if at least ``support`` of
    them are worth half or more. A value that no base pattern finds is worth 1 - product (1 - score) over the patterns that
    it follows and that score LENDING or more. Patterns and values are scored in turn: what a pattern discovers counts for
    the other contexts it is seen in, also those without a base entity, which score in turn and discover more. Scores only
    grow, so they settle; patterns that reach ``confidence`` are trusted.
    """
    cue = F.explode("cues").alias("cue")
    kinds = F.array(*(F.lit(k) for k in range(len(KINDS))))
    edges = scanned.select(cue).select("cue.context", "cue.value", F.explode(kinds).alias("of"), "cue.kind", "cue.may")
    edges = edges.where(F.col("may").bitwiseAND(F.expr("shiftleft(1, of)")) != 0)
    edges = scratch.keep(edges.groupBy("context", "of", "value").agg(F.max((F.col("kind") == F.col("of")).cast("int")).alias("base")))
    # a context with fewer values than the support can't be trusted, whatever they are worth
    counts = scratch.keep(edges.groupBy("context", "of").agg(F.count(F.lit(1)).alias("n"), F.sum("base").alias("seeds")).where(F.col("n") >= support))
    unseen = scratch.keep(edges.where("base = 0").join(scratch.small(counts), ["context", "of"], "left_semi").select("context", "of", "value"))
    lending = lambda scored: scratch.keep(
        scored.where((F.col("good") >= support) & (F.col("score") >= min(LENDING, confidence))).select("context", "of", "score")
    )
    patterns = lending(counts.select("context", "of", F.col("seeds").alias("good"), (F.col("seeds") / F.col("n")).alias("score")))
    total = 0.0
    for _ in range(rounds - 1):
        before, total = total, patterns.agg(F.sum("score")).first()[0] or 0.0
        if total - before < SETTLED:
            break
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))
        values = unseen.join(scratch.small(patterns), ["context", "of"]).groupBy("of", "value").agg((1 - miss).alias("worth"))
        found = unseen.join(scratch.small(scratch.keep(values)), ["of", "value"]).groupBy("context", "of").agg(
            F.sum("worth").alias("more"), F.count_if(F.col("worth") >= 0.5).alias("found")
        )
        more, found_ = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
        scored = counts.join(scratch.small(scratch.keep(found)), ["context", "of"], "left")
        patterns = lending(scored.select("context", "of", (F.col("seeds") + found_).alias("good"), ((F.col("seeds") + more) / F.col("n")).alias("score")))
    return scratch.keep(patterns.where(F.col("score") >= confidence))


def find_personal(
    frame: DataFrame, id_column: str, text_column: str,
    rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, scratch: Scratch | None = None,
) -> DataFrame:
    """For each row the id, ``base`` (spans of the base patterns) and ``spans`` (these and the discovered ones), arrays of
    (kind as a number of KINDS, start, end), by kind, then start; and ``print``, a hash of the text.

    The base entities are the seeds. The two words before each make a lexical pattern; Spark scores the graph of patterns
    and values over the whole corpus in rounds (``score_patterns``), in which what trusted patterns discover makes further
    patterns trusted. A candidate that no base pattern finds, that overlaps no base span and whose shape fits the kind,
    becomes a span where it follows a trusted pattern.

    A null text is empty. Equal rows get equal spans; a null id is an id like any other. An empty table gives an empty
    result. Other columns are not carried.
    """
    scratch = scratch or Scratch(frame.sparkSession, "personal")
    rows = frame.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("print"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = scratch.keep(rows.mapInArrow(_scan, f"id {kind}, {_SCANNED}"))
    patterns = score_patterns(scratch, scanned, rounds, support, confidence)
    cues = scanned.select("id", "print", F.explode("cues").alias("cue")).select("id", "print", "cue.*").where("kind < 0")
    fits = cues.join(scratch.small(patterns), "context").where(F.col("may").bitwiseAND(F.expr("shiftleft(1, of)")) != 0)
    best = F.max_by("of", F.struct("score", -F.col("of"))).alias("kind")
    found = fits.groupBy("id", "print", "start", "end").agg(best)
    more = found.groupBy("id", "print").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = more.select(F.col("id").alias("id2"), F.col("print").alias("print2"), "more")
    joined = scanned.join(scratch.small(scratch.keep(more)), F.col("id").eqNullSafe(F.col("id2")) & (F.col("print") == F.col("print2")), "left")
    added = F.coalesce("more", F.array().cast("array<struct<kind int, start int, end int>>"))
    return joined.select(F.col("id").alias(id_column), "print", F.col("spans").alias("base"), F.array_sort(F.concat("spans", added)).alias("spans"))


def masked(frame: DataFrame, id_column: str, text_column: str, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The frame with each span replaced by its kind in brackets; of overlapping spans the first takes all. Other columns
    stay; equal rows are masked alike."""
    some = found.where(F.size("spans") > 0).select(F.col(id_column).alias("__id"), F.col("print").alias("__print"), F.col("spans").alias("__spans"))
    some = scratch.keep(some.dropDuplicates(["__id", "__print"]))
    match = frame[id_column].eqNullSafe(F.col("__id")) & (F.xxhash64(frame[text_column]) == F.col("__print"))
    joined = frame.join(scratch.small(some), match, "left").drop("__id", "__print")
    names = list(frame.columns)
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            texts = batch.column(at)
            if held.null_count < len(held):
                new = []
                for text, spans in zip(texts, held, strict=True):
                    text, spans = text.as_py(), spans.as_py()  # noqa: PLW2901
                    if spans:
                        out, done = [], 0
                        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                            if s["start"] >= done:
                                out += [text[done : s["start"]], f"[{KINDS[s['kind']]}]"]
                            done = max(done, s["end"])
                        text = "".join([*out, text[done:]])  # noqa: PLW2901
                    new.append(text)
                texts = pa.array(new, pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema])
    return joined.mapInArrow(run, schema)


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents."""
    found = find_personal(spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text")
    kinds = F.col("base.kind")
    counts = [F.size(F.filter(kinds, lambda kind: kind == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023  used at once
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
