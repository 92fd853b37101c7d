"""Packing of documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from struct import pack as pack_ids
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, gapless, spread, table

log = logging.getLogger(__name__)

#: Tokens of a sequence, and the step to which lengths are rounded up for the linear program.
CAPACITY, STEP = 2048, 4

#: The id that ends each document.
END_ID = 1

#: The program stops once its bound shows that no packing saves more than this share (or than half a sequence), or after so
#: many pricings; what it lacks then costs sequences, never documents.
TOLERANCE, PRICINGS = 1e-5, 400

#: Patterns that enter the program from one pricing, at most.
PATTERNS = 24

#: How much more than in proportion to its size a piece is worth while the first patterns are priced: large pieces, which
#: little else fits beside, go first. The second is tried where the first leaves room below it.
LARGE_FIRST = (0.01, 1.0)

ROWS_PER_TASK = 2048

#: Pieces of text whose ids a task remembers, and the longest that it does (some 60 MB in all).
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 64

#: Texts of these characters alone are split into the tokenizer's pieces here; lower case and normal form keep to them. Left
#: out are what the tokenizer does not count as white space but ``re`` does, and what begins a special token.
_UNUSUAL = re.compile("[^\x00-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|[\x1c-\x1f\u0130]|<\\|")

#: The same within ASCII, as texts: looking for each is faster than the pattern.
_UNUSUAL_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

#: The tokenizer's pieces (contractions, runs of letters, single numbers, runs of anything else).
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

#: Characters that are encoded at once, about; a longer text is cut at white space.
ENCODED_AT_ONCE, _GAP = 1 << 18, re.compile(r"\s")

#: How a tokenizer describes the normal form and the splitting that the above does, and how the special tokens
#: begin that ``_UNUSUAL`` finds.
_NORMAL_FORM = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
_SPLITTING = (
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), """
    "behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"
)
_SPECIAL = "<|"

#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip((b for b in range(256) if b not in _PRINTABLE), range(256, 512), strict=False))


class _Known(dict):
    """Ids of pieces, as bytes, found by the tokenizer's model when first asked for."""

    def __init__(self, model) -> None:  # noqa: ANN001
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
        found = [t.id for t in self.model.tokenize(letters)]
        ids = pack_ids(f"<{len(found)}I", *found)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer works on pieces that have no influence on each other, so the ids of a text are those of its pieces one
    after another. The ids of pieces are remembered, up to a bound. A text with unusual characters goes to the tokenizer
    whole, and so do all texts if the tokenizer's file has another normal form, splitting or kind of special tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self.tokenizer.model)
        special = all(t.content.startswith(_SPECIAL) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_pieces = special and repr(self.tokenizer.normalizer) == _NORMAL_FORM and repr(self.tokenizer.pre_tokenizer) == _SPLITTING

    def encode(self, text: str) -> bytes:
        unusual = any(x in text for x in _UNUSUAL_ASCII) if text.isascii() else _UNUSUAL.search(text)
        if unusual or not self.by_pieces:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        lowered = text.lower()
        if len(lowered) <= ENCODED_AT_ONCE:
            return self._encoded(lowered)
        cuts, at = [0], ENCODED_AT_ONCE
        while gap := _GAP.search(lowered, at):  # no piece goes over white space
            cuts.append(gap.start())
            at = gap.start() + ENCODED_AT_ONCE
        return b"".join(self._encoded(lowered[a:b]) for a, b in zip(cuts, [*cuts[1:], len(lowered)], strict=True))

    def _encoded(self, lowered: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _PIECE.findall(lowered)))


def _pieces(path: str, capacity: int):  # noqa: ANN202
    """Pieces of each document: full sequences, and what is left after them."""
    names = ["doc_id", "text_print", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                at, out = [], [[], [], [], []]
                texts = batch.column(1).slice(row, 1024)
                for k, text in enumerate(texts):
                    ids = encoder.encode(text.as_py() or "")
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        piece = crc32(ids[4 * start : 4 * (start + length)])
                        at.append(row + k)
                        for column, value in zip(out, (start, length, piece, total), strict=True):
                            column.append(value)
                which = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(2).take(which), *(pa.array(x, pa.int64()) for x in out)], names=names
                )
                row += len(texts)

    return run


def price(values: np.ndarray, sizes: np.ndarray, capacity: int, many: int = PATTERNS) -> tuple[float, list[np.ndarray]]:
    """The largest value of a pattern that fits (each size any number of times), by dynamic programming over the room, and
    the best patterns, first the best, each led by another size."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    by_size = np.argsort(sizes, kind="stable")
    sorted_sizes, sorted_values = sizes[by_size], values[by_size]
    fits = np.searchsorted(sorted_sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            gain = sorted_values[:n] + best[room - sorted_sizes[:n]]
            k = gain.argmax()
            if gain[k] > best[room] + 1e-12:
                best[room], last[room] = gain[k], by_size[k]
    led = values + best[capacity - sizes]
    patterns = []
    for k in np.argsort(-led, kind="stable")[:many]:
        pattern = np.zeros(len(sizes), np.int64)
        pattern[k] = 1
        room = capacity - int(sizes[k])
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                pattern[last[room]] += 1
                room -= int(sizes[last[room]])
        patterns.append(pattern)
    return float(best[capacity]), patterns


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that hold exactly the demand: each takes the largest that fits, as often as the rest of the demand allows."""
    left = demand.copy()
    falling = np.argsort(-sizes, kind="stable")
    out = []
    while left.any():
        pattern = np.zeros(len(sizes), np.int64)
        room = capacity
        for k in falling[left[falling] > 0]:
            if sizes[k] <= room:
                pattern[k] = min(left[k], room // sizes[k])
                room -= int(pattern[k] * sizes[k])
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def start_patterns(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, large_first: float
) -> tuple[list[np.ndarray], list[float], list[int]]:
    """Patterns priced by the knapsack for the demand that is left, how often each is used (in fractions), and the size
    that it uses up.

    Each pattern is the one of the largest value among the sizes left, and used until one of them is met. What later
    patterns hold excludes that size, so the patterns are a basis: a triangular one, sizes that were met at once being
    covered by patterns of their own that are not used.
    """
    left = demand.astype(float)
    patterns, use, met = [], [], []
    while (left > 0).any():
        at = np.flatnonzero(left > 0)
        share = sizes[at] / capacity
        _, priced = price(share * (1 + large_first * share), sizes[at], capacity, 1)
        pattern = np.zeros(len(sizes), np.int64)
        pattern[at] = priced[0]
        held = np.flatnonzero(pattern)
        times = left[held] / pattern[held]
        left[held] = np.maximum(left[held] - times.min() * pattern[held], 0.0)
        done = held[times <= times.min() * (1 + 1e-12)]
        left[done] = 0.0
        patterns.append(pattern)
        use.append(float(times.min()))
        met.append(int(done[0]))
        for k in done[1:]:
            patterns.append(np.eye(1, len(sizes), k, dtype=np.int64)[0] * (capacity // sizes[k]))
            use.append(0.0)
            met.append(int(k))
    return patterns, use, met


def _inverse(patterns: list[np.ndarray], met: list[int]) -> np.ndarray:
    """The inverse of the matrix with these columns, which is lower triangular once its rows are in the order of ``met``.

    Products are by einsum: BLAS with threads never returns in a process that was forked, as a driver is when it has
    started its JVM.
    """
    many = len(met)
    lower = np.array(patterns, float).T[met] if many else np.zeros((0, 0))
    solved = np.zeros((many, many))
    for r in range(many):
        solved[r] = -np.einsum("j,jk->k", lower[r, :r], solved[:r])
        solved[r, r] += 1.0
        solved[r] /= lower[r, r]
    inverse = np.empty((many, many))
    inverse[:, met] = solved
    return inverse


@dataclass
class Program:
    """Patterns and how often each is used; the number of pricings, and a bound that no packing is below."""

    patterns: list[tuple[np.ndarray, float]]
    pricings: int
    bound: float


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> Program:
    """A solution of the linear program that covers the demand with the fewest sequences, to within the tolerance of its
    bound.

    All patterns are priced by the knapsack. Those that the program starts from are priced one after another for the
    demand that the earlier ones leave (``start_patterns``); the revised simplex method then goes on from that basis with
    patterns priced by its duals. Patterns priced together enter one by one, as long as the prices that the earlier ones
    leave still favour them.
    """
    many = len(sizes)
    center = sizes / capacity  # feasible prices, whose total is a bound: no pattern is worth more than one sequence
    bound = float(center @ demand)
    starts = []
    for large_first in LARGE_FIRST:
        starts.append(start_patterns(sizes, demand, capacity, large_first))
        if sum(starts[-1][1]) <= bound + max(0.5, bound * tolerance):
            break
    pricings = sum(x > 0 for s in starts for x in s[1])
    patterns, first, met = min(starts, key=lambda s: sum(s[1]))
    use = np.array(first)
    inverse = _inverse(patterns, met)

    def enter(offered: list[np.ndarray]) -> None:
        for pattern in offered:
            if inverse.sum(axis=0) @ pattern <= 1 + 1e-9:
                continue
            step = np.einsum("ij,j->i", inverse, pattern.astype(float))
            ratio = np.full(many, np.inf)
            grows = step > 1e-11
            ratio[grows] = use[grows] / step[grows]
            out = int(ratio.argmin())
            amount = ratio[out]
            use[:] = np.maximum(use - amount * step, 0.0)
            use[out] = amount
            row = inverse[out] / step[out]
            inverse[:] = inverse - np.outer(step, row)
            inverse[out] = row
            patterns[out] = pattern

    for _ in range(PRICINGS):
        now = inverse.sum(axis=0)
        if use.sum() <= bound + max(0.5, bound * tolerance):
            break
        smooth = 0.9 * center + 0.1 * now  # the simplex prices alone swing widely
        best, priced = price(smooth, sizes, capacity)
        pricings += 1
        if not any(now @ p > 1 + 1e-9 for p in priced):
            smooth = now
            best, priced = price(smooth, sizes, capacity)
            pricings += 1
            if best <= 1 + 1e-9:
                bound = max(bound, float(use.sum()))
                break
        if smooth.min() >= 0 and smooth @ demand / best > bound:
            center, bound = smooth / best, float(smooth @ demand / best)
        enter(priced)
    return Program([(p, float(x)) for p, x in zip(patterns, use, strict=True) if x > 0], pricings, bound)


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns used whole numbers of times that hold exactly the demand: the program's, rounded down, then once more in
    the order of what the rounding took, as far as the rest of the demand allows; what is left goes by first fit."""
    left = demand.copy()
    out: list[tuple[np.ndarray, int]] = []
    program = column_generation(sizes, demand, capacity)
    log.info("packing program: %d patterns of %d sizes after %d knapsack pricings, bound %.1f", len(program.patterns), len(sizes), program.pricings, program.bound)
    whole = [(pattern, int(use + 1e-6), use) for pattern, use in program.patterns]
    rounded = [(p, n) for p, n, _ in sorted(whole, key=lambda x: -x[1])] + [(p, 1) for p, n, use in sorted(whole, key=lambda x: x[1] - x[2]) if use - n > 1e-6]
    for pattern, times in rounded:
        held = pattern > 0
        times = min(times, int((left[held] // pattern[held]).min()))  # noqa: PLW2901
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    return out + first_fit(sizes, left, capacity)


def pack(
    frame: DataFrame, id_column: str, text_column: str, tokenizer: str, capacity: int = CAPACITY, step: int = STEP
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most ``capacity`` tokens.

    A document's ids are those of its whole text by the tokenizer file, then END_ID. It is cut into full sequences and one
    remainder; remainders are packed uncut: their lengths, rounded up to the step, make a histogram (at most
    capacity / step classes, whatever the size of the table), the linear program over patterns of classes is solved on the
    driver, and the documents of a class, ranked by a gapless index, are dealt to the rounded patterns.

    Returns the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``. A null text is
    empty and gives one piece of END_ID. Null ids and repeated rows are documents of their own. An empty table gives an
    empty result; other columns are not carried.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "packing")
    rows = frame.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_print"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(
        _pieces(tokenizer, capacity), f"doc_id {kind}, text_print long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    pieces = scratch.keep(pieces.withColumn("class", F.ceil(F.col("length") / step).cast("int")))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    entries, given, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in whole_patterns(sizes, demand, ceil(capacity / step)):
        for k in np.flatnonzero(pattern):
            size, each = int(sizes[k]), int(pattern[k])
            entries.append({"class": size, "low": given[size], "high": given[size] + each * times, "each": each, "first": first})
            given[size] += each * times
        first += times
    schema = "array<struct<class int, low bigint, high bigint, each bigint, first bigint>>"
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(entries)), schema)).alias("p")).select("p.*")
    blocks = ceil(int(demand.sum()) / ROWS_PER_TASK) or 1
    ranked = gapless(pieces, ["class"], ["doc_id", "text_print", "start"], "rank", blocks)
    # the plan has at most a few entries for each of the classes, whose number the capacity bounds
    dealt = ranked.join(F.broadcast(plan), "class").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    placed = dealt.withColumns({
        "sequence_id": (F.col("first") + F.floor(within / F.col("each"))).cast("long"), "turn": within % F.col("each")
    })
    order = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "turn")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(
        F.col("doc_id").alias(id_column), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.cast("long").alias("offset")
    )


def tokenizer_path() -> str:
    """The public word-level BPE of 49,408 ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text", tokenizer_path())
