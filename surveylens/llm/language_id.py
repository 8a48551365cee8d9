"""Language identification with hyperdimensional letter profiles.

Every letter has a fixed random vector of +1 and -1, derived from its code point.  An
n-gram's vector is the product of its letters' vectors, each permuted (rotated) by its
distance from the n-gram's end; a text's vector is the sum of its n-grams' vectors, and a
language's prototype is the sum over the documents it is learnt from.  A document gets the
language whose prototype has the largest cosine with it (equal cosines: the smallest name
in code-point order).

Texts are composed (NFC) and lower-cased; letters and the marks on them are symbols, every
run of other characters counts as one blank, and a blank stands before and after a text.

Work: one scan that adds up the prototypes (a task returns one vector a language, Spark adds
them: whole numbers, so that reruns agree) and one scan that predicts; nothing else is
shuffled.  The prototypes, ``most_languages`` at most, travel to the tasks.  A task works on
slices of 1 MB of text, 2,000 rows and 4,096 n-grams.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text
where nothing was learnt; a null language teaches nothing; an empty language name is a
name; a null id counts as an empty one in ``held_out``; repeated rows are predicted (and
learnt from) each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens.llm.common import load, text_slices

UNKNOWN = "und"
BLANK = 32
MOST_ROWS, MOST_GRAMS = 2000, 4096  # of one piece of work
MOST_LETTERS = 20_000               # letter vectors kept by a task


class LetterSpace:
    """Letter and n-gram vectors of one task."""

    def __init__(self, n: int, dimensions: int, seed: int) -> None:
        self.n, self.dimensions, self.seed = n, dimensions, seed
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        self.kind = np.array([1 if k == "L" else 2 if k == "M" else 0 for k in kinds], np.uint8)
        self.kept: dict[int, np.ndarray] = {}

    def letter(self, symbol: int) -> np.ndarray:
        """The symbol's vector in each of its ``n`` rotations, the last place first."""
        if symbol not in self.kept:
            if len(self.kept) >= MOST_LETTERS:
                self.kept = {}
            bits = hashlib.shake_256(f"{self.seed}:{symbol}".encode()).digest(self.dimensions // 8)
            v = 1 - 2 * np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int8)
            self.kept[symbol] = np.stack([np.roll(v, r) for r in range(self.n)])
        return self.kept[symbol]

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the texts, one after the other, the text of each, and whether a text
        has a letter."""
        whole = [f" {unicodedata.normalize('NFC', t or '').lower()} " for t in texts]
        raw = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(whole)), [len(t) for t in whole])
        kind = self.kind[raw]
        lettered = np.bincount(doc[kind == 1], minlength=len(whole)) > 0
        mark = kind > 0
        keep = mark.copy()
        keep[:1] = True
        keep[1:] |= mark[:-1] | (doc[1:] != doc[:-1])
        return np.where(mark, raw, BLANK)[keep], doc[keep], lettered

    def grams(self, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams (a row of symbols each), the number of the n-gram at every place
        and the text of that place."""
        last = len(symbols) - self.n + 1
        if last <= 0:
            return np.zeros((0, self.n), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        alphabet = np.unique(symbols)
        small = np.searchsorted(alphabet, symbols).astype(np.int64)
        number = small[:last]
        for k in range(1, self.n):
            # pairs (n-gram so far, next letter) are numbered anew, so that any alphabet fits
            number = number * len(alphabet) + small[k:last + k]
            coded = pc.dictionary_encode(pa.array(number))
            number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = doc[:last] == doc[self.n - 1:]
        number, at = number[inside], np.flatnonzero(inside)
        used = pc.dictionary_encode(pa.array(number))
        number = used.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.full(len(used.dictionary), len(symbols))
        np.minimum.at(first, number, at)
        rows = np.stack([symbols[first + k] for k in range(self.n)], axis=1).astype(np.int64)
        return rows, number, doc[at]

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams: the product of their rotated letters."""
        alphabet, place = np.unique(rows, return_inverse=True)
        place = place.reshape(rows.shape)
        letters = np.stack([self.letter(int(s)) for s in alphabet])  # symbol, rotation, dimension
        out = letters[place[:, 0], self.n - 1].copy()
        for k in range(1, self.n):
            out *= letters[place[:, k], self.n - 1 - k]
        return out

    def bundle(self, rows: np.ndarray, number: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """The sum of n-gram vectors of each group; whole numbers."""
        total = np.zeros((groups, self.dimensions))
        exact = np.float32 if len(number) < 1 << 24 else np.float64
        for low in range(0, len(rows), MOST_GRAMS):
            part = self.vectors(rows[low:low + MOST_GRAMS]).astype(exact)
            here = slice(None) if len(rows) <= MOST_GRAMS else (number >= low) & (number < low + MOST_GRAMS)
            key = group[here] * len(part) + number[here] - low
            for g in range(0, groups, 512):
                n = min(512, groups - g)
                own = key[(key >= g * len(part)) & (key < (g + n) * len(part))] if groups > 512 else key
                count = np.bincount(own - g * len(part), minlength=n * len(part))
                total[g:g + n] += count.reshape(n, -1).astype(exact) @ part
        return total


@dataclass
class Profiles:
    """Languages in code-point order and their prototypes, a row each."""
    languages: list[str]
    prototypes: np.ndarray
    n: int
    dimensions: int
    seed: int

    def space(self) -> LetterSpace:
        return LetterSpace(self.n, self.dimensions, self.seed)

    def predict(self, space: LetterSpace, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        symbols, doc, lettered = space.symbols(texts)
        rows, number, group = space.grams(symbols, doc)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors = space.bundle(rows, number, group, len(texts))
        cosine = _unit(vectors) @ _unit(self.prototypes.astype(np.float64)).T
        best = cosine.argmax(1)
        score = np.where(lettered, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
        return [self.languages[k] if a else UNKNOWN for k, a in zip(best, lettered, strict=True)], score


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1.0)


def _pieces(batches, column: str) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, column, 1 << 20):
        for at in range(0, b.num_rows, MOST_ROWS):
            yield b.slice(at, MOST_ROWS)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 3,
          dimensions: int = 2048, seed: int = 11, most_languages: int = 1000) -> Profiles:
    """Prototypes from all rows of ``docs`` with a language.  ``dimensions`` is a multiple of 8.
    More than ``most_languages`` languages are an error."""
    def run(batches):
        space, held = LetterSpace(n, dimensions, seed), {}
        for b in _pieces(batches, text_col):
            names = pc.dictionary_encode(b.column(lang_col))
            symbols, doc, _ = space.symbols(b.column(text_col).to_pylist())
            rows, number, place = space.grams(symbols, doc)
            own = names.indices.to_numpy(zero_copy_only=False)
            sums = space.bundle(rows, number, own[place], len(names.dictionary))
            for lang, v in zip(names.dictionary.to_pylist(), sums, strict=True):
                held[lang] = held.get(lang, 0) + v.astype(np.int64)
            if len(held) > most_languages:
                raise ValueError(f"more than {most_languages} languages")
        flat = np.concatenate([*held.values(), np.zeros(0, np.int64)])
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dimensions, pa.int32()),
                                           pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), vectors], names=["lang", "vector"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias(lang_col), text_col)
    sums = (rows.mapInArrow(run, "lang string, vector array<long>")
            .select("lang", F.posexplode("vector").alias("i", "v"))
            .groupBy("lang", "i").agg(F.sum("v").alias("v")))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("all")) \
        .select("lang", F.transform("all", lambda x: x["v"]).alias("vector"))
    held = sorted((r["lang"], r["vector"]) for r in found.limit(most_languages + 1).collect())
    if len(held) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    table = np.array([v for _, v in held], np.int64).reshape(-1, dimensions)
    return Profiles([lang for lang, _ in held], table, n, dimensions, seed)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (the cosine with that language's prototype, from 0 to 1)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        space = profiles.space()
        for b in _pieces(batches, text_col):
            lang, score = profiles.predict(space, b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = learn(load(spark, sf_dir, "documents", "doc_id", "text", "lang").filter(~held_out()))
    found = identify(load(spark, sf_dir, "documents", "doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
