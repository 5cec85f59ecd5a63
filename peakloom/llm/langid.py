"""Language identification with string kernels.

Kernel: a blended spectrum (character n-grams of 1 to 4), presence only,
normalised. Nyström landmarks and one-versus-rest kernel ridge regression are
fitted on a bounded sample; whole texts are scored in batched matrix products.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: n-gram lengths, hashed presence bits.
ORDERS, BITS = (1, 2, 3, 4), 15
#: Per language: rows to fit on, of which so many are landmarks. Bounds what reaches the driver (4 KB a row).
SAMPLE_ROWS, LANDMARKS = 300, 64
#: Languages that can be told apart; with more there is no fit but an error.
MOST_LANGUAGES = 200
#: Ridge, and the sharpness with which regression values become scores.
RIDGE, SHARPNESS = 1e-3, 4.0
#: Texts scored by one matrix product.
BLOCK = 256
#: Bytes of texts, or characters of a longer one, whose n-grams are hashed together.
PART = 1 << 20
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hashed(codes: np.ndarray) -> list[np.ndarray]:
    """The hashed numbers of all n-grams of some characters, for each n."""
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return out


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters, 32 for all that are no letters, and which are letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _letters()[codes]
    codes[~letter] = 32
    return codes, letter


def _of_short(lower: list[str]) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(t) + 2 for t in lower])
    codes, letter = _codes("".join(f" {t} " for t in lower))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    hashed = _hashed(codes[keep])
    for a, b, s, e in zip(kept[starts], kept[ends], starts, ends, strict=True):
        if not letter[s:e].any():
            yield np.empty(0, np.uint32)
        else:
            yield np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, hashed, strict=True)])


def _of_long(text: str) -> np.ndarray:
    """The same for one long text, part by part, each with the last characters before it; each number once."""
    found, carry, after_letter, any_letter = np.zeros(1 << BITS, bool), np.full(1, 32, np.uint32), False, False
    for at in range(0, len(text) + 1, PART):
        codes, letter = _codes(text[at : at + PART] + " " * (at + PART > len(text)))
        keep = letter | np.concatenate([[after_letter], letter[:-1]])
        kept = np.concatenate([carry, codes[keep]])
        for h in _hashed(kept):
            found[h] = True
        carry, after_letter, any_letter = kept[-max(ORDERS) + 1 :], letter[-1], any_letter or letter.any()
    return np.flatnonzero(found).astype(np.uint32) if any_letter else np.empty(0, np.uint32)


def _spectra(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashed numbers of its n-grams, perhaps repeated; empty where it has no letter.

    Letters count in lower case; each run of other characters is one space.
    Texts are worked on in groups of PART bytes, longer ones in parts: some 50
    bytes of memory a byte of PART, and 5 a byte of the longest text.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(sizes):
        to, total = at + 1, sizes[at]
        while to < len(sizes) and total + sizes[to] <= PART:
            total, to = total + sizes[to], to + 1
        lower = [t or "" for t in pc.utf8_lower(texts.slice(at, to - at).cast(pa.large_string())).to_pylist()]
        if total <= PART:
            yield from _of_short(lower)
        else:
            yield _of_long(lower[0])
        at = to


def _presence(spectra: Iterator[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of presence for each of n texts, and which have any n-gram; a text's numbers are dropped as soon as they are in."""
    out, found = np.zeros((n, 1 << BITS), np.float32), np.zeros(n, bool)
    for i, ids in enumerate(spectra):
        out[i, ids] = 1
        found[i] = len(ids) > 0
    return out, found


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from learning: CRC-32 of the id's text modulo 4 is 2 (null id: empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, spectrum): up to `rows` random texts of each language that are not held out.

    A hash thins each language to about twice the rows before they are ranked,
    so no task ranks a whole language.
    """
    pool = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw")
    )
    share = written(pool.groupBy("lang").agg((2.0 * rows / F.count(F.lit(1))).alias("share")), "lang-shares")
    if share.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    thin = pool.join(F.broadcast(share), "lang").filter(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("rank") <= rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(_presence(iter([ids]), 1)[0] > 0).tobytes() if len(ids) else None for ids in _spectra(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array(bits, pa.binary())], ["lang", "rank", "spectrum"])

    return ranked.select("lang", "rank", "text").mapInArrow(task, "lang string, rank int, spectrum binary").filter("spectrum is not null")


def fit(sample: DataFrame, landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (hashed n-grams by languages) that scores a normalised presence vector.

    Kernel ridge regression over Nyström landmarks: with L the landmarks' and X
    the sample's normalised vectors, weights a solve
    (K_xl' K_xl + ridge n K_ll) a = K_xl' Y; scores k(x, L) a = x (L' a).
    """
    rows = sample.orderBy("lang", "rank", "spectrum").collect()
    langs = sorted({r.lang for r in rows})
    if not rows:
        return [], np.zeros((1 << BITS, 0), np.float32)
    x = np.stack([np.unpackbits(np.frombuffer(r.spectrum, np.uint8)) for r in rows]).astype(np.float32)
    x /= np.sqrt(x.sum(1, keepdims=True))
    seen: dict[str, int] = {}
    at = [i for i, r in enumerate(rows) if seen.setdefault(r.lang, 0) < landmarks and not seen.update({r.lang: seen[r.lang] + 1})]
    marks = x[at]
    y = np.array([[1.0 if r.lang == c else -1.0 for c in langs] for r in rows])
    k_xl, k_ll = (x @ marks.T).astype(float), (marks @ marks.T).astype(float)
    left = k_xl.T @ k_xl + RIDGE * len(rows) * (k_ll + 1e-6 * np.eye(len(at)))
    return langs, (marks.T @ np.linalg.solve(left, k_xl.T @ y)).astype(np.float32)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predict every document's language from its whole text: doc_id, held_out, lang_pred, score, then the columns in carry.

    lang_pred is a language learnt from rows that are not held out, or `und`
    with score 0 if the text is null, empty or without a letter, or if nothing
    could be learnt. The score is a softmax of the regression values. Ties go to
    the language first in code point order. Repeated rows and null ids are
    scored like any other. The prediction takes nothing but the text.
    """
    langs, weights = fit(training_sample(docs, id_col, text_col, lang_col, sample_rows))
    schema = docs.select(F.col(id_col).alias("_id"), F.lit(True).alias("_held"), F.col(text_col).alias("_text"), *(F.col(c) for c in carry)).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x, found = _presence(_spectra(b.column(2)), b.num_rows)
                found &= bool(langs)
                pred, score = np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
                if found.any():
                    x = x[found]
                    values = (x @ weights) / np.sqrt(x.sum(1, keepdims=True))
                    odds = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)).astype(float))
                    pred[found] = np.array(langs, object)[values.argmax(1)]
                    score[found] = odds.max(1) / odds.sum(1)
                columns = [b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score), *b.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "held_out", "lang_pred", "score", *(f"carry_{i}" for i in range(len(carry)))]
    kinds = [schema[0].dataType.simpleString(), "boolean", "string", "double", *(f.dataType.simpleString() for f in schema[3:])]
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    scored = rows.mapInArrow(task, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return scored.toDF(*names[:4], *carry)
