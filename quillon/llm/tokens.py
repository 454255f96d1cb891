"""Tokenization by units: white space never lies inside a token of the vocabulary
used here, so a text's ids are those of its white-space runs, one after the other.
Runs recur, so a bounded cache holds the ids of each; a run that is letters
followed by punctuation is looked up as those two parts, in lower case.

That holds for a lower-casing normaliser, a pre-tokeniser that drops white space and parts
letters from punctuation, and byte-level merges.  Any vocabulary is tried on ``PROBES``, as units
and whole; one that differs anywhere, or whose parts are made otherwise, has its texts encoded whole."""

from __future__ import annotations

import ctypes
import gc
import logging
import os
import string
import threading
import time
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np

from quillon.llm import kernels as K

_tokenizers: dict = {}
_POINTS = string.punctuation.encode()
_IS_POINT, _IS_LETTER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_IS_POINT[list(_POINTS)] = _IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_LOWER[65:91] += 32
#: How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = dict(zip(_PRINTABLE, _PRINTABLE, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Seconds after which an unused cache is emptied: Spark keeps workers for other jobs.
IDLE = 6

PROBES = (
    "Abc abc ABC aBc! Don't stop-me, (now) x_y 12 3.5 a1b2 $5 #tag &amp; <b> word.Next", "Ärger über Öl, ÉTÉ naïve. Ελλάς ΣΑΣ İstanbul straße ŒUVRE Ñ",
    "漢字 テスト 한국어 русский ТЕКСТ! عربي हिन्दी ไทย", "e\u0301 a\u0300! ﬁ ½ ² Ⅳ ａｂ", "tabs\tand\nlines\r\n  two  spaces \x0b\x0c end. ...!? --- a--b", "emoji 😀😀 👨‍👩‍👧! ​ zero\u200bwidth soft\u00adhyphen no\u00a0break",
    "[UNK] <s> </s> <|endoftext|> [CLS] <pad>", "supercalifragilisticexpialidocious Pneumonoultramicroscopicsilicovolcanoconiosis! zzzz", "",
)


class Units:
    """Ids of runs of text, as bytes of little-endian uint32."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.runs: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}
        self.sizes: dict[str, dict[int, int]] = {}
        self.lock, self.used = threading.Lock(), time.monotonic()
        self.by_units = self._parts_agree()
        threading.Thread(target=self._watch, daemon=True).start()

    def _parts_agree(self) -> bool:
        """Whether units give the ids of whole texts, on the probes."""
        self.by_units = True
        raw = [p.encode() for p in PROBES]
        try:
            same = self.ids(raw) == self.encode(PROBES) and self.ids(list(reversed(raw))) == self.encode(reversed(PROBES))
        except Exception as e:  # a model without byte-level parts raises whatever it likes
            logging.getLogger(__name__).info("vocabulary is not byte-level: %s", e)
            same = False
        self._empty()
        return same

    def _watch(self) -> None:
        while True:
            time.sleep(IDLE / 2)
            with self.lock:
                if (self.runs or self.sizes) and time.monotonic() - self.used > IDLE:
                    self._empty()
                    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library keeps what is freed
                        trim(0)

    def _empty(self) -> None:
        self.runs, self.parts, self.sizes = {}, {b"": b""}, {}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def encode_parts(self, parts: Iterable[bytes]) -> Iterable[bytes]:
        """The ids of texts that are one word of the pre-tokenizer each and in lower case: the merges alone are left to do."""
        merged = self.tokenizer.model.tokenize
        for part in parts:
            written = part.decode("latin-1")
            yield array("I", [t.id for t in merged(written if part.isascii() else written.translate(_WRITTEN))]).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        parts, plain = self.parts, []
        whole, heads, tails = [], [], []
        for run in new:
            head = run.rstrip(_POINTS)
            if head.isalpha():  # ASCII letters
                low = head.lower()
            else:
                # others count as letters if Unicode says so and neither composing nor lower-casing depends on what stands beside
                text = head.decode()
                if not text.isalpha() or not unicodedata.is_normalized("NFC", text) or "İ" in text or "Σ" in text:
                    plain.append(run)
                    continue
                low = text.lower().encode()
            whole.append(run)
            heads.append(low)
            tails.append(run[len(head) :])
        missing = list(set(heads).union(tails).difference(parts))
        parts.update(zip(missing, self.encode_parts(missing), strict=True))
        find = parts.__getitem__
        self.runs.update(zip(whole, map(bytes.__add__, map(find, heads), map(find, tails)), strict=True))
        self.runs.update(zip(plain, self.encode(map(bytes.decode, plain)), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_units:
            return self.encode(text.decode() for text in texts)
        collects = gc.isenabled()
        gc.disable()  # nothing here forms cycles, and the lists are long
        try:
            with self.lock:
                split = [text.split() for text in texts]
                here = set().union(*split)
                if new := here.difference(self.runs):
                    if len(self.runs) + len(new) > self.most:  # the parts stay longer: they are what costs
                        self.runs, new = {}, here
                        if len(self.parts) > 2 * self.most:
                            self._empty()
                    self._learn(new)
                self.used = time.monotonic()
                known = self.runs.__getitem__
                return [b"".join(map(known, runs)) for runs in split]
        finally:
            if collects:
                gc.enable()


    def counts(self, part: K.Slice) -> np.ndarray:
        """The number of ids of each text of a slice.  Runs are cut as in ``_learn``, those of ASCII letters all at once; equal parts are counted once."""
        if not self.by_units:
            return np.array([len(x) // 4 for x in self.ids([part.text(i) for i in range(len(part))])], np.int64)
        w = K.words(part)
        n = len(part.data)
        last = np.maximum.accumulate(np.where(_IS_POINT[part.data], 0, np.arange(1, n + 1)))
        letters = np.concatenate([[0], np.cumsum(_IS_LETTER[part.data])])
        cut = np.maximum(last[w.end - 1], w.start)
        simple = (cut > w.start) & (letters[cut] - letters[w.start] == cut - w.start)
        lower = _LOWER[part.data]
        merged = self.tokenizer.model.tokenize
        merges = lambda runs: [len(merged(x.decode("ascii"))) for x in runs]
        wholes = lambda runs: [len(x) // 4 for x in self.ids(runs)]
        tailed = simple & (cut < w.end)
        out = np.zeros(len(part), np.int64)
        for kind, data, at, end, count in (("head", lower, w.start, cut, merges), ("tail", lower, cut, w.end, merges), ("whole", part.data, w.start, w.end, wholes)):
            here = np.flatnonzero({"head": simple, "tail": tailed, "whole": ~simple}[kind])
            if len(here):
                out += np.bincount(w.row[here], self._sizes(kind, data, at[here], end[here], count), len(part)).astype(np.int64)
        return out

    def _sizes(self, kind: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: Callable[[list[bytes]], list[int]]) -> np.ndarray:
        """What count says of each range of data, remembered by hash."""
        hashes, first, which = np.unique(K.hashes(data, starts, ends), return_index=True, return_inverse=True)
        with self.lock:
            known, self.used = self.sizes.setdefault(kind, {}), time.monotonic()
            if len(known) > self.most:
                known = self.sizes[kind] = {}
        size = np.fromiter(map(known.get, hashes.tolist(), repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(size < 0)
        if len(new):
            raw = data.tobytes()
            size[new] = count([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            known.update(zip(hashes[new].tolist(), size[new].tolist(), strict=True))
        return size[which]


def units(path: str) -> Units:
    """This process's cache for a vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = Units(path)
    return _tokenizers[path]
