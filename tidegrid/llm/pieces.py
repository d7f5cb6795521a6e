"""Texts as units whose tokens don't depend on their neighbours, so each distinct unit is encoded once a batch.

For a vocabulary that drops white space, a unit is a word. For byte-level vocabularies whose pattern keeps a
space with the word after it, a unit starts at each space that follows a character other than white space:
no match of the pattern spans such a place and none looks beyond it.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tidegrid.llm.common import Words, spawn_env, spread

#: White space before a space: the space doesn't start a unit then.
_RUN = r"[\s\pZ\x{1c}-\x{1f}\x{85}] "
#: Units, and matches of other units than words, that a worker remembers with their ids; beyond it starts afresh.
REMEMBERED, REMEMBERED_MATCHES = 400_000, 100_000
#: Names that are Python strings at once, and units whose ids stand at once; a longer text is a run of its own.
BLOCK, RUN_UNITS = 1 << 14, 1 << 17
#: Fixed value: the pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class Units:
    """``names``: distinct units; ``index``: into them, in reading order; ``offsets``: of each text's first one."""

    def __init__(self, names: pa.Array, index: np.ndarray, offsets: np.ndarray):
        self.names, self.index, self.offsets = names, index, offsets


def word_units(texts: pa.Array) -> Units:
    words = Words(pc.ascii_lower(texts))  # such vocabularies ignore case
    return Units(words.names, words.index, words.offsets)


def spaced_units(texts: pa.Array) -> Units:
    """Units for patterns of the kind `` ?\\p{L}+|\\s+(?!\\S)|\\s+``."""
    n = len(texts)
    plain = pc.invert(pc.or_(pc.match_substring_regex(texts, _RUN), pc.starts_with(texts, " "))).to_numpy(zero_copy_only=False)
    plain &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    lists = pc.split_pattern(pc.if_else(pa.array(plain), texts, ""), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = flat.dictionary_encode()
    index, own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    del lists, flat, coded
    counts = np.diff(offsets)
    first = np.zeros(len(index), bool)
    first[(offsets[:-1] - offsets[0])[counts > 0]] = True
    bare, inner = np.unique(index[first], return_inverse=True)  # a text's first unit has no space before it
    names = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", own.type), own, pa.scalar(" ", own.type)), own.take(pa.array(bare))])
    index[first] = len(own) + inner
    if not plain.all():  # texts with runs of white space are split one by one
        known: dict[str, int] = {}
        parts, at, counts = [], np.concatenate([[0], np.cumsum(counts)]), counts.copy()
        for i in range(n):
            if plain[i]:
                parts.append(index[at[i] : at[i + 1]])
            else:
                found = (known.setdefault(x, len(known)) for x in _CHUNK.findall(texts[i].as_py()))
                parts.append(np.fromiter(found, np.int64) + len(names))
                counts[i] = len(parts[-1])
        index, names = np.concatenate(parts), pa.concat_arrays([names, pa.array(list(known), names.type)])
    return Units(names, index, np.concatenate([[0], np.cumsum(counts)]))


class TokenizerCodec:
    """Ids by a file of the tokenizers library; ``spaced``: for byte-level patterns, else one that drops white space and case."""

    def __init__(self, path: str, spaced: bool):
        spawn_env()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens, as the library finds them in a text before anything else.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = spaced_units if spaced else word_units
        self.split = self._pattern(path).findall
        # Letters alone, with or without a space before them, are one match.
        self.whole = all(self.split(x) == [x] for x in ((" word", "word", "Straße", " Éa") if spaced else ("word", "straße")))
        # Bytes as the characters that stand for them in byte-level vocabularies.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    @staticmethod
    def _pattern(path: str) -> regex.Pattern:
        """The pattern by which the file's pre-tokenizer splits."""
        with open(path) as f:
            pre = json.load(f)["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        return regex.compile(own[0] if own else BYTE_LEVEL)

    def _encode(self, unit: str) -> list[int]:
        """The ids of a unit: its matches, each by the library's model; unusual characters by the whole library."""
        spaced = unit[:1] == " "
        if self.whole and unit.isascii() and (unit[1:] if spaced else unit).isalpha():  # such letters stand for themselves
            return [t.id for t in self.tokenizer.model.tokenize(chr(self.shown[32]) + unit[1:] if spaced else unit)]
        if not _PLAIN(unit):
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        if self.tokenizer.normalizer and not unit.isascii():
            unit = self.tokenizer.normalizer.normalize_str(unit)
        if self.whole and (unit[1:] if spaced else unit).isalpha():
            return [t.id for t in self.tokenizer.model.tokenize(unit.encode().decode("latin-1").translate(self.shown))]
        out: list[int] = []
        for match in self.split(unit):
            ids = self.pieces.get(match)
            if ids is None:
                if len(self.pieces) >= REMEMBERED_MATCHES:
                    self.pieces.clear()
                shown = match.encode().decode("latin-1").translate(self.shown)
                ids = self.pieces[match] = [t.id for t in self.tokenizer.model.tokenize(shown)]
            out += ids
        return out

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """Each unit's number in what this worker remembers; units it hasn't seen are encoded."""
        gc.disable()  # millions of small lists and strings, no cycles
        try:
            return self._known_numbers(names)
        finally:
            gc.enable()

    def _known_numbers(self, names: pa.Array) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        known, ids, lengths = self.known, array("I"), array("q")
        numbers = np.empty(len(names), np.int32)
        for at in range(0, len(names), BLOCK):
            block = names.slice(at, BLOCK).to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
            for unit in block:
                if unit not in known:
                    own = self._encode(unit)
                    ids.extend(own)
                    lengths.append(len(own))
                    known[unit] = len(known)
            numbers[at : at + BLOCK] = np.fromiter(map(known.__getitem__, block), np.int32, len(block))
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.lengths = np.concatenate([self.lengths, np.array(lengths, np.int64)])
        return numbers

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of ids. Texts that hold an added token's string
        are encoded whole by the library."""
        ids, counts = zip(*self.encoded(texts), strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` for runs of consecutive texts, in their order, so that few ids stand at once."""
        low, holds = pc.ascii_lower(texts), np.zeros(len(texts), bool)
        for content in self.added:
            holds |= pc.match_substring(low, content).to_numpy(zero_copy_only=False)
        del low
        units = self.units(pc.if_else(pa.array(holds), "", texts) if holds.any() else texts)
        offsets, number = units.offsets, self._numbers(units.names)[units.index] if len(units.index) else units.index
        del units
        starts, a = np.cumsum(self.lengths) - self.lengths, 0
        while True:
            b = min(len(texts), max(a + 1, int(np.searchsorted(offsets, offsets[a] + RUN_UNITS, side="right")) - 1))
            own = number[offsets[a] : offsets[b]]
            of_unit = self.lengths[own]
            before = np.concatenate([[0], np.cumsum(of_unit)])
            ids, counts = self.flat[spread(of_unit, starts[own])], np.diff(before[offsets[a : b + 1] - offsets[a]])
            if holds[a:b].any():
                parts = np.split(ids, np.cumsum(counts)[:-1])
                for i in np.flatnonzero(holds[a:b]).tolist():
                    parts[i] = np.array(self.tokenizer.encode(texts[a + i].as_py(), add_special_tokens=False).ids, np.uint32)
                ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            yield ids, counts
            a = b
            if a >= len(texts):
                return


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1
