"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import spread, table
from tessera.llm.words import mixed
from tessera.shipping import on_workers

#: Dimensions of the vectors (a multiple of 64), letters of an n-gram (3 code points fill a 64-bit number).
DIMENSIONS, GRAM = 1024, 3

#: Fixed odd keys that a letter's code point and the number of a word of its vector are mixed with.
_LETTER_KEY, _WORD_KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Letters up to here have their vectors made once, those of others are made as they come.
READY_LETTERS = 0x250

#: Bits of a code point in an n-gram's number.
POINT_BITS = 21

#: Characters of a text that are read at once.
PIECE = 1 << 18

#: Distinct n-grams that are bound at once: 256 KB of bits, 1 MB as they are added up.
BOUND_AT_ONCE = 256

#: N-grams of one language that a task holds before it bundles them; sums below this are exact in single precision.
HELD, EXACT = 200_000, 1 << 24

#: Languages that may be learned: the driver and each task hold a vector of 8 KB for each.
LANGUAGES = 4096

UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_bits(points: np.ndarray) -> np.ndarray:
    """The random vector of each code point, from a hash of it, as packed bits (1 stands for -1, 0 for 1); code point 0
    stands for the gap between words."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * _WORD_KEY
    return mixed(mixed(points.astype(np.uint64) * _LETTER_KEY + _LETTER_KEY)[:, None] ^ words).astype("<u8")


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=1)


def _permuted(made: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters' vectors, permuted for each place of an n-gram: rotated by 64 dimensions a place."""
    return tuple(np.roll(made, GRAM - 1 - i, axis=1) for i in range(GRAM))


@cache
def _ready() -> tuple[np.ndarray, ...]:
    return _permuted(letter_bits(np.arange(READY_LETTERS)))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of letters of a text (lower case, anything between letters is one gap) and their counts; none
    if it has no letter. A long text is read a piece at a time, with what n-grams of the next piece begin with."""
    lowered = (text or "").lower()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before, after_letter = np.zeros(1, np.int64), False

    def add(symbols: np.ndarray) -> np.ndarray:
        code = np.zeros(max(0, len(symbols) - GRAM + 1), np.int64)
        for i in range(GRAM):
            code = code << POINT_BITS | symbols[i : i + len(code)]
        if len(code):
            found.append(np.unique(code, return_counts=True))
        return symbols[1 - GRAM :]

    for start in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.where(_is_letter()[points], points, 0).astype(np.int64)
        stay = letters != 0
        stay[1:] |= letters[:-1] != 0
        stay[0] |= after_letter
        before = add(np.concatenate([before, letters[stay]]))
        after_letter = bool(letters[-1])
    if after_letter:
        add(np.append(before, 0))
    if len(found) <= 1:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    codes, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(place, weights=counts).astype(np.int64)


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the n-grams' vectors, each the product of its letters' permuted vectors (of packed bits: their exclusive
    or), as often as it occurs. All sums are whole numbers and exact, so their order doesn't matter."""
    minus = np.zeros(DIMENSIONS)
    kind = np.float32 if counts.sum() < EXACT else np.float64
    for start in range(0, len(codes), BOUND_AT_ONCE):
        part = codes[start : start + BOUND_AT_ONCE]
        points = [part >> POINT_BITS * (GRAM - 1 - i) & (1 << POINT_BITS) - 1 for i in range(GRAM)]
        tables = _ready()
        if max(x.max() for x in points) >= READY_LETTERS:
            others, places = np.unique(np.concatenate(points), return_inverse=True)
            points, tables = np.split(places, GRAM), _permuted(letter_bits(others))
        bound = tables[0][points[0]]
        for x, bits in zip(points[1:], tables[1:], strict=True):
            bound ^= bits[x]
        minus += counts[start : start + BOUND_AT_ONCE].astype(kind) @ unpacked(bound).astype(kind)
    return counts.sum() - 2.0 * minus


def _added(pending: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The bundle of the n-grams of several texts, each n-gram bound once."""
    codes, counts = (np.concatenate(x) for x in zip(*pending, strict=True))
    distinct, place = np.unique(codes, return_inverse=True)
    return bundle(distinct, np.bincount(place, weights=counts).astype(np.int64))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundle of each language's texts in one partition."""
    total: dict[str, np.ndarray] = {}
    pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes, counts = grams(text.as_py())
            if len(codes):
                pending.setdefault(lang, []).append((codes, counts))
                held[lang] = held.get(lang, 0) + len(codes)
                if held[lang] >= HELD:
                    total[lang] = total.get(lang, 0) + _added(pending.pop(lang))
                    held[lang] = 0
    for lang, rest in pending.items():
        total[lang] = total.get(lang, 0) + _added(rest)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total)), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["lang", "total"]
        )


def learn(frame: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """The unit profile of each language: the bundle of all its texts, whole. Rows without a language, and texts without
    a letter, teach nothing. The driver gets one vector for each language, already added up; more than LANGUAGES of them
    are an error."""
    on_workers(frame.sparkSession)
    labelled = frame.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = labelled.mapInArrow(_learned, "lang string, total array<double>")
    sums = parts.select("lang", F.posexplode("total").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x")
    rows = rows.limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different languages in {lang}")
    profiles = {r["lang"]: np.array(r["x"]) for r in sorted(rows, key=lambda r: r["lang"])}
    return {k: v / np.linalg.norm(v) for k, v in profiles.items() if np.linalg.norm(v) > 0}


def predict(
    frame: DataFrame, text: str, profiles: dict[str, np.ndarray], lang_out: str = "lang_pred", score_out: str = "score",
    grams_out: str | None = None, carried: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the language whose profile has the largest cosine with the text's bundle (ties to the smaller name), and that
    cosine, between 0 and 1. A null text, one without a letter, or no profile at all gives ``und`` and 0.

    ``grams_out`` names a column for the number of the text's distinct n-grams, which is not added without a name.
    Nothing but the text decides. The columns named in ``carried`` (all of the input without it) stay, in front; a column
    that has the name of an added one is replaced. An empty table gives an empty result.
    """
    on_workers(frame.sparkSession)
    names, matrix = list(profiles), np.stack(list(profiles.values())) if profiles else np.zeros((0, DIMENSIONS))
    added = [lang_out, score_out, *([grams_out] if grams_out else [])]
    kept = [c for c in (frame.columns if carried is None else carried) if c.lower() not in [x.lower() for x in added]]
    source = frame.select(*(frame[f"`{c}`"] for c in kept), *([] if text in kept else [frame[f"`{text}`"].alias("__text")]))
    at = kept.index(text) if text in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores, sizes = [], [], []
            for value in batch.column(at):
                codes, counts = grams(value.as_py())
                sizes.append(len(codes))
                own = bundle(codes, counts)
                length = np.linalg.norm(own)
                if not names or not length:
                    # a bundle of letters may, in theory, add up to nothing: then no language is nearer than another
                    found.append(names[0] if names and len(codes) else UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = matrix @ own / length
                best = int(cosine.argmax())
                found.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            columns = [*batch.columns[: len(kept)], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            names_ = [*(f"c{i}" for i in range(len(kept))), "lang", "score", "grams"]
            yield pa.RecordBatch.from_arrays(columns[: len(kept) + len(added)], names=names_[: len(kept) + len(added)])

    schema = T.StructType([
        *(T.StructField(f"c{i}", source.schema[i].dataType) for i in range(len(kept))),
        T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
        *([T.StructField("grams", T.LongType())] if grams_out else []),
    ])
    return source.mapInArrow(run, schema).toDF(*kept, *added)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from all labelled ones that aren't held out. A null id is not held out, and
    its document not learned from."""
    rows = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    profiles = learn(rows.where(remainder(F.col("doc_id")) != 2), "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return predict(rows.select("doc_id", held, "text"), "text", profiles, carried=["doc_id", "held_out"])
