"""Token counts per section by offset mapping.

Each whole document is encoded once with a byte-level vocabulary.  A token's length in
bytes is known from the vocabulary, so running sums give its span; the spans are
interval-joined (binary search) with the sections' spans.  A token that crosses a
boundary goes to the section that holds most of its bytes, the earlier one on a tie.
Hence the sections' counts add up to the document's count.

The sections are the document's lines, each with its line break.  Encoding and joining
happen in the task that reads the row; nothing is shuffled.

Edge cases: a null or empty text has one section (number 0) of no tokens; repeated rows
are counted separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from surveylens.llm.common import load, text_bytes, text_slices

TOKENIZER = "byte_bpe_50k.tiktoken"
SAME_VOCABULARY = "byte_bpe_50k.json"
# the fast encoder recurses on white space; texts with such a run go to the other encoder of the same ids
LONG_BLANK = re.compile(r"\s{5000}")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}), lengths


def encode_whole(text: str, encoding, other) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    if len(text) >= 5000 and LONG_BLANK.search(text):
        return np.asarray(other().encode(text, add_special_tokens=False).ids, np.int64)
    return np.asarray(encoding.encode_ordinary(text), np.int64)


def same_vocabulary(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte ends of the lines, each with its line break; one empty line for no text."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def allocate(token_sizes: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (most bytes; the earlier on a tie), and whether it crosses a
    boundary.  Sections tile the text: section i spans [ends[i-1], ends[i])."""
    token_ends = np.cumsum(token_sizes)
    starts = token_ends - token_sizes
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    owner, crossing = first.copy(), first != last
    for t in np.flatnonzero(crossing):
        edges = np.concatenate(([starts[t]], section_ends[first[t]:last[t]], [token_ends[t]]))
        owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    return owner, crossing


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, other_path: str | None = None) -> DataFrame:
    """One row per line of each document: id, section (from 0), start and n_chars in code
    points, n_tokens, n_crossing (tokens of it that reach into a neighbour).

    ``path`` and ``other_path`` name the vocabulary file in the formats of the two
    encoders; unset, the executors' installed public files are used.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, section long, start long, n_chars long, n_tokens long, n_crossing long"

    def encode(batches):
        encoding, lengths = load_encoding(path or tokenizer_path(TOKENIZER))
        other = cache(lambda: same_vocabulary(other_path or tokenizer_path(SAME_VOCABULARY)))
        for b in text_slices(batches, text_col):
            raw, offsets = text_bytes(b.column(text_col))
            texts, cols, rows = b.column(text_col).to_pylist(), [[] for _ in range(5)], []
            for k, text in enumerate(texts):
                own = raw[offsets[k]:offsets[k + 1]]
                ends = line_ends(own)
                ids = encode_whole(text, encoding, other)
                owner, crossing = allocate(lengths[ids], ends)
                chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))  # code points before a byte
                at = np.concatenate(([0], ends[:-1]))
                rows.append(np.full(len(ends), k))
                for c, v in zip(cols, (np.arange(len(ends)), chars[at], chars[ends] - chars[at],
                                       np.bincount(owner, minlength=len(ends)),
                                       np.bincount(owner[crossing], minlength=len(ends))), strict=True):
                    c.append(v)
            ids = b.column(id_col).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(np.concatenate(c), pa.int64()) for c in cols)],
                names=[id_col, "section", "start", "n_chars", "n_tokens", "n_crossing"])

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents", "doc_id", "text"))
