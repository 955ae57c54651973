"""Token ids of whole texts, and a stand-in for re-encoding words a task has met before.

Byte-level BPE splits a text before it merges. A space between two characters that are no
white space always begins a new part there, and a line feed between such characters is a
part of its own, so a text without white space runs is encoded piece by piece: every
distinct piece once by the tokenizer, all others from a bounded table that the worker keeps
for its life. Texts with runs of white space (where the split looks further) go to the
tokenizer whole. Both give the ids of encoding the whole text, which the tests compare.
A piece also ends before a sign that follows a letter, where the split always cuts. Texts are cut
and their distinct pieces found in Arrow, a batch at a time. New pieces that are one part of the
split go to the tokenizer's model, as bytes written in its alphabet. Other new pieces go through the
whole tokenizer, many in one call, a line feed between them, and are taken apart at its id.

Defined results: an empty text has no ids; texts of any length are encoded whole; equal texts
have equal ids.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker keeps, some 250 bytes each; beyond it the rarer half is forgotten.
KEEP = 300_000
#: Texts are cut into pieces so many characters at a time.
STEP = 1_000_000
#: Pieces encoded in one call, whose results are large until their ids are taken.
CALL = 4096

_RUN = re.compile(r"\s\s")
_PLAIN = re.compile(r" ?\S+")
#: Letters in every version of Unicode since 5, and signs that are neither letters nor digits.
_LETTER = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u0513]"
_SIGN = r"[!-/:-@\[-`{-~]"
#: One part of the byte-level split, whatever stands around it.
_PART = re.compile(f" ?(?:{_LETTER}+|{_SIGN}+|[0-9]+)")
#: Begins a piece that has no space before it; texts that hold it are encoded whole.
_MARK = "\x01"
_encoders: dict = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder of a tokenizer file (a path, or a name the public set knows)."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: its own where it can be
    seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)).difference(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _alphabet()


class _Numbers(dict):
    """Piece -> number, given out in order of appearance."""

    def __missing__(self, piece):
        self[piece] = n = len(self)
        return n


class Encoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self._t = Tokenizer.from_file(name)
        self._added = [t.content for t in self._t.get_added_tokens_decoder().values()]
        split = json.loads(self._t.pre_tokenizer.__getstate__()) if self._t.pre_tokenizer else {}
        # piece by piece holds for plain byte-level splitting only
        self._by_piece = self._t.normalizer is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        # pieces without white space are taken apart at line feeds, which must be one id
        line = self._t.encode("\n", add_special_tokens=False).ids
        self._by_piece = self._by_piece and len(line) == 1
        self._line = line[0] if line else 0
        self._numbers = _Numbers()
        self._used = np.zeros(0, np.int64)
        self._start, self._flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._t.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers."""
        if not self._by_piece:
            return self._whole(texts)
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= STEP:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._numbers) > KEEP:
            self._forget()
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self._added) or _MARK in t or _RUN.search(t)]
        skip = set(odd)
        out: list = [None] * len(texts)
        plain = [i for i in range(len(texts)) if i not in skip]
        marked = pa.array([_MARK + texts[i].replace("\n", f" \n {_MARK}") for i in plain], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring_regex(marked, f"({_LETTER})({_SIGN})", rf"\1 {_MARK}\2"), " ")
        sizes = pc.list_value_length(cut).to_numpy()
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # str, as to_pylist gives, without a scalar for each
        known = len(self._numbers)
        at = np.fromiter(map(self._numbers.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if len(self._numbers) > known:
            self._learn(known)
        self._used += np.bincount(at, minlength=len(self._used))
        first, n = self._start[at], self._start[at + 1] - self._start[at]
        ends = np.cumsum(n)
        ids = self._flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        for i, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = ids[a:b]
        for i, x in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = x
        return out

    def _learn(self, known: int) -> None:
        """Ids of the pieces numbered ``known`` and above."""
        pieces = list(islice(reversed(self._numbers), len(self._numbers) - known))[::-1]
        first, n, flat = self._ids_of([p[1:] if p[:1] == _MARK else p if p == "\n" else " " + p for p in pieces])
        ends = np.cumsum(n)
        self._flat = np.concatenate([self._flat, flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]])
        self._start = np.concatenate([self._start, self._start[-1] + ends])
        self._used = np.concatenate([self._used, np.zeros(len(n), np.int64)])

    def _ids_of(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each stem's ids begin, how many they are, and the ids. Stems that are one part go
        to the model; others without white space inside are encoded many at a time, a line feed
        between them."""
        single, plain, other = [], [], []
        for i, s in enumerate(stems):
            (single if _PART.fullmatch(s) else plain if _PLAIN.fullmatch(s) else other).append(i)
        count, parts = [], []
        model = self._t.model.tokenize
        for lo in range(0, len(single), CALL):
            some = "\n".join([stems[i] for i in single[lo : lo + CALL]])
            got = list(map(model, some.encode().decode("latin-1").translate(_BYTES).split(_BYTES[10])))
            count.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter([t.id for x in got for t in x], np.uint32, int(count[-1].sum())))
        for lo in range(0, len(plain), CALL):
            some = [stems[i] for i in plain[lo : lo + CALL]]
            ids = np.array(self._t.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            between = np.flatnonzero(ids == self._line)
            if len(between) != len(some) - 1:
                raise ValueError("a piece without line feeds holds a line feed's id")
            count.append(np.diff(np.concatenate([[-1], between, [len(ids)]])) - 1)
            parts.append(ids[ids != self._line])
        for lo in range(0, len(other), CALL):
            got = [e.ids for e in self._t.encode_batch_fast([stems[i] for i in other[lo : lo + CALL]], add_special_tokens=False)]
            count.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32, int(count[-1].sum())))
        none = np.zeros(0, np.int64)
        order, n = np.array(single + plain + other, np.int64), np.concatenate([none, *count])
        first, many = np.empty(len(stems), np.int64), np.empty(len(stems), np.int64)
        first[order], many[order] = np.cumsum(n) - n, n
        return first, many, np.concatenate([np.zeros(0, np.uint32), *parts])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self._used, kind="stable")[: KEEP // 2])
        n = np.diff(self._start)[keep]
        ends = np.cumsum(n)
        self._flat = self._flat[np.repeat(self._start[keep] - (ends - n), n) + np.arange(ends[-1])]
        self._start, self._used = np.concatenate([[0], ends]), self._used[keep] // 2
        pieces = list(self._numbers)
        self._numbers = _Numbers((pieces[i], k) for k, i in enumerate(keep))

