"""Whole texts through the tokenizers library, each distinct unit once for each worker."""

from __future__ import annotations

import os

import numpy as np

from cutline.llm.batches import UnitCache, ranges

#: What may stand between two units without changing the ids of either: it is cut off as a piece of its own.
BETWEEN = {"byte": "\n", "word": " | "}
TOGETHER = 256


class Library:
    """A tokenizer file; ``kind`` says what may stand between units ("byte": byte-level, "word": white space dropped).

    With ``added`` the content of an added token in a text is that token, as in a plain call of the
    library; without, the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, kind: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = []
        if added:
            tokens = self.tokenizer.get_added_tokens_decoder().values()
            if any(x.normalized for x in tokens):
                raise ValueError(f"an added token of {path} is met in the normalized text only")
            self.marks = [x.content.encode() for x in tokens]
        self.tokenizer.encode_special_tokens = True  # in units; the texts that hold a mark are encoded whole
        self.size = self.tokenizer.get_vocab_size()
        self.between, self.mark = BETWEEN[kind], BETWEEN[kind].strip() or BETWEEN[kind]
        ids = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        if len(ids) != 1:
            raise ValueError(f"{self.between!r} is not one token of {path}")
        self.parting = ids[0]
        self.cache = UnitCache(self.encode_units)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit; units that hold the parting mark are encoded alone, the others joined by it."""
        mark, between = self.mark.encode(), self.between.encode()
        alone = [k for k, x in enumerate(units) if mark in x]
        held = set(alone)
        rest = [k for k in range(len(units)) if k not in held] if held else list(range(len(units)))
        groups = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        flat, length, order = [], [], []
        for group, ids in zip(groups, self._each([between.join([units[k] for k in g]).decode() for g in groups])):
            cut = np.flatnonzero(ids == self.parting)
            if len(cut) != len(group) - 1:
                alone += group
                continue
            flat.append(np.delete(ids, cut))
            length.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
            order += group
        for k, ids in zip(alone, self._each([units[k].decode() for k in alone])):
            flat.append(ids)
            length.append([len(ids)])
            order.append(k)
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, lengths = np.concatenate(flat), np.concatenate(length).astype(np.int64)
        at = np.argsort(np.array(order), kind="stable")
        return ids[ranges((np.cumsum(lengths) - lengths)[at], lengths[at])], lengths[at]

    def _whole(self, raw: np.ndarray, at: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` and ``first`` with the texts that hold an added token encoded whole: white space before one is cut otherwise there."""
        data, held = raw.tobytes() if self.marks else b"", set()
        for mark in self.marks:
            place = data.find(mark)
            while place >= 0:
                k = int(np.searchsorted(at, place, side="right")) - 1
                inside = place + len(mark) <= at[k + 1]
                held |= {k} if inside else set()
                place = data.find(mark, int(at[k + 1]) if inside else place + 1)
        if not held:
            return ids, first
        parts, length, done = [], np.diff(first), 0
        self.tokenizer.encode_special_tokens = False
        for k in sorted(held):
            (own,) = self._each([data[at[k] : at[k + 1]].decode()])
            parts += [ids[first[done] : first[k]], own]
            length[k], done = len(own), k + 1
        self.tokenizer.encode_special_tokens = True
        return np.concatenate([*parts, ids[first[done] :]]), np.append(0, np.cumsum(length))

    def with_end(self, raw: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end`` behind each, and where each text's begin."""
        ids, first = self.cache.ids(raw, at)
        ids, first = self._whole(raw, at, ids, first)
        ids = np.insert(ids, first[1:], end) if len(first) > 1 else ids
        return ids.astype(np.uint32), first + np.arange(len(first))


_LOADED: dict[tuple[str, str, bool], Library] = {}


def library(path: str, kind: str, added: bool = False) -> Library:
    if (path, kind, added) not in _LOADED:
        _LOADED[path, kind, added] = Library(path, kind, added)
    return _LOADED[path, kind, added]
