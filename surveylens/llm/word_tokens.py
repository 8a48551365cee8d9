"""Token ids of whole text columns for a word-level BPE vocabulary that drops white space.

Ids of a word do not depend on its neighbours, so a slice of texts is cut at ASCII white
space, its distinct words are encoded once, and the documents' ids are gathered with
numpy.  Distinct words of plain Latin characters are cut into the vocabulary's own
pre-tokens, whose ids come from the BPE model and are kept over slices; any other word
goes through the complete tokenizer.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLAIN = r"^[!-~\x{A1}-\x{AC}\x{AE}-\x{FF}]+$"  # characters that normalisation only lower-cases
MOST_KEPT = 1_000_000  # pre-tokens; beyond that the memory is emptied and filled anew


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenation of values[starts[i]:starts[i] + lengths[i]]."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[shift + np.arange(total)]


class WordTokens:
    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        spec = json.loads(self.full.to_str())
        suffix = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {
            "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"},
                                                  spec["pre_tokenizer"]["pretokenizers"][1]]}}
        self.model = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(suffix)
        self.dtype = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.cut = regex.compile("\n|" + pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[str, int] = {"\n": 0}
        self.pool, self.pool_size = [np.zeros(0, self.dtype)], 0
        self.start, self.length = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pre-tokens that are not kept yet."""
        for at in range(0, len(pieces), 256):
            chunk = pieces[at:at + 256]
            ids = np.asarray(self.model.encode(" ".join(chunk), add_special_tokens=False).ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(chunk):  # a piece without an end mark: encode one by one
                each = [self.model.encode(p, add_special_tokens=False).ids for p in chunk]
                ids = np.asarray([i for x in each for i in x], self.dtype)
                stops = np.cumsum([len(x) for x in each])
            begins = np.concatenate(([0], stops[:-1]))
            self.kept.update(zip(chunk, range(len(self.kept), len(self.kept) + len(chunk)), strict=True))
            self.pool.append(ids)
            self.start.append(self.pool_size + begins)
            self.length.append(stops - begins)
            self.pool_size += len(ids)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, pool): ids of each word in one pool."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(self.kept) > MOST_KEPT:
            self._forget()
        pool = np.zeros(0, self.dtype)
        if plain.any():
            pieces = self.cut("\n".join(words.filter(pa.array(plain)).to_pylist()).lower())
            self._learn([p for p in dict.fromkeys(pieces) if p not in self.kept])
            kept = self.kept
            number = np.fromiter((kept[p] for p in pieces), np.int64, len(pieces))
            self.pool, self.start, self.length = ([np.concatenate(x)] for x in
                                                  (self.pool, self.start, self.length))
            n = self.length[0][number]
            pool = gather(self.start[0][number], n, self.pool[0])
            stop = np.append(np.flatnonzero(number == 0), len(number))
            upto = np.concatenate(([0], np.cumsum(n)))[stop]
            begin = np.concatenate(([0], upto[:-1]))
            start[plain], length[plain] = begin, upto - begin
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = [e.ids for e in self.full.encode_batch(words.take(pa.array(rest)).to_pylist(),
                                                         add_special_tokens=False)]
            length[rest] = [len(x) for x in ids]
            start[rest] = len(pool) + np.concatenate(([0], np.cumsum(length[rest])[:-1]))
            pool = np.concatenate((pool, np.asarray([i for x in ids for i in x], self.dtype)))
        return start, length, pool

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other (``end`` after each), and each
        text's number of ids.  A null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        start, length, pool = self._words(words.dictionary)
        if end is not None:
            start, length = np.append(start, len(pool)), np.append(length, 1)
            pool = np.append(pool, np.asarray([end], self.dtype))
        index = words.indices.to_numpy(zero_copy_only=False)
        offsets -= offsets[0]
        if end is not None:
            index = np.insert(index, offsets[1:], len(start) - 1)
            offsets = offsets + np.arange(len(offsets))
        n = length[index]
        upto = np.concatenate(([0], np.cumsum(n)))[offsets]
        return gather(start[index], n, pool), np.diff(upto)
