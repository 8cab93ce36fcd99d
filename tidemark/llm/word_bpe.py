"""Ids of whole texts by a tokenizers file whose pieces never cross white space (operators 3 and 6)."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tidemark.llm.common import gather_ragged

#: Words that one Python worker remembers, and chunks that aren't plain words; each starts anew beyond that.
CACHE_WORDS, CACHE_CHUNKS = 200_000, 50_000
#: Words that need no normalizing but lower case: letters of ASCII and Latin-1.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class WordBpe:
    """The library encodes each distinct chunk between ASCII white space once; texts are put together from them.

    Right for files whose normalizer and pre-tokenizer treat such chunks one by one, as those that drop white
    space and split at it do. Words of letters, the bulk, go to the library's model directly.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # byte-level files write a byte as its own character if it is printable, else as one from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin."""
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        ids = gather_ragged(np.frombuffer(b"".join(known), np.uint32), (np.cumsum(lengths) - lengths)[codes], each)
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, total[split.offsets.to_numpy()]

    def _known(self, chunks: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = [cache.get(chunk) for chunk in chunks]
        model, words, odd = self.tokenizer.model, self.words, []
        for n, ids in enumerate(known):
            if ids is None:
                chunk = chunks[n]
                tail = ""
                core = chunk
                if chunk and chunk[-1] in ",.":
                    core, tail = chunk[:-1], chunk[-1]
                if not PLAIN(core):
                    odd.append(n)
                    continue
                core = core.lower()
                ids = words.get(core)
                if ids is None:
                    spelled = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
                    ids = words[core] = array("I", [t.id for t in model.tokenize(spelled)]).tobytes()
                if tail:
                    last = words.get(tail)
                    if last is None:
                        last = words[tail] = array("I", [t.id for t in model.tokenize(tail)]).tobytes()
                    ids += last
                known[n] = ids
        for n, found in zip(odd, self.tokenizer.encode_batch_fast([chunks[n] for n in odd], add_special_tokens=False)):
            known[n] = array("I", found.ids).tobytes()
            if len(chunks[n]) < 200:
                cache[chunks[n]] = known[n]
        return known


@lru_cache(2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)
