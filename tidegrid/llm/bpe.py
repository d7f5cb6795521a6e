"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one token that can end its encoding: the one that the merges
produce. ``PrefixTable`` stores it for each prefix. A token t is the last one of a prefix when t is reachable
(its own bytes encode to t alone) and stands validly after the last token of what remains (the merges of both
tokens' bytes together give just these two). An encoding is read off backwards; appending bytes computes the
new prefixes only; after an edit the table is recomputed from the edit on until it agrees again with the old
one over as many places as the longest token has bytes, from where all later entries hold as they are.

In a batch each distinct unit (see ``pieces``) is split by the pattern and encoded once. A match of the pattern
that is itself a token is that token, as in the tiktoken library.

Edge cases: null or empty text = no ids and no bytes; texts of any length take memory by the batch step;
equal texts give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegrid.llm.common import id_and_text, steps, texts_of
from tidegrid.llm.pieces import spaced_units

#: Distinct matches and token pairs that a worker remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """The merges of a rank file as lookups for ``PrefixTable``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every suffix of a token, with the token that it is, if any: the search for a last token goes no further back.
        self.suffixes: dict[bytes, int] = {b[k:]: -1 for b in ranks for k in range(len(b))} | ranks
        self._reachable: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._matches: dict[bytes, list[int]] = {}

    def merges(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the leftmost pair of lowest rank until none is left."""
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(x + y, 1 << 60) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < 1 << 60:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], 1 << 60)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], 1 << 60)
        return [self.ranks[x] for x in parts]

    def reachable(self, token: int) -> bool:
        known = self._reachable.get(token)
        if known is None:
            known = self._reachable[token] = self.merges(self.bytes_of[token]) == [token]
        return known

    def follows(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= 5 * REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merges(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def encode(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        known = self._matches.get(data)
        if known is None:
            if len(self._matches) >= REMEMBERED:
                self._matches.clear()
            known = PrefixTable(self, data).ids()
            if len(data) <= 64:
                self._matches[data] = known
        return known

    def encode_all(self, matches: set[bytes]) -> dict[bytes, list[int]]:
        """Distinct matches in byte order, so that each starts from the prefix that it shares with the one before."""
        table, out = PrefixTable(self), {}
        for data in sorted(matches):
            whole = self.ranks.get(data)
            ids = self._matches.get(data) if whole is None else [whole]
            if ids is None:
                table.turn_into(data)
                ids = table.ids()
                if len(self._matches) < REMEMBERED and len(data) <= 64:
                    self._matches[data] = ids
            out[data] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """``last[i]``: the token that ends the encoding of the first i bytes."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def _token(self, data: bytes, last: list[int], end: int) -> int:
        e = self.encoder
        for start in range(end - 1, -1, -1):
            token = e.suffixes.get(data[start:end])
            if token is None:
                break
            if token >= 0 and e.reachable(token) and (start == 0 or e.follows(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token(self.data, self.last, end))

    def turn_into(self, data: bytes) -> None:
        """Another string; the entries of the common prefix stay."""
        keep = len(os.path.commonprefix([self.data, data]))
        self.data, self.last = self.data[:keep], self.last[: keep + 1]
        self.append(data[keep:])

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start to stop; returns how many entries were computed."""
        old, moved = self.last, len(new) - (stop - start)
        data = self.data[:start] + new + self.data[stop:]
        last, same, made = old[: start + 1], 0, 0
        for end in range(start + 1, len(data) + 1):
            if same >= self.encoder.longest:
                last += old[end - moved :]
                break
            last.append(self._token(data, last, end))
            made += 1
            # Entries may be taken over once a token's length of them agree beyond the edited bytes.
            beyond = end > start + len(new)
            same = same + 1 if beyond and old[end - moved] == last[-1] else 0
        self.data, self.last = data, last
        return made

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.encoder.bytes_of[out[-1]])
        return out[::-1]


def _rows(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = PrefixEncoder(read_ranks(ranks_path)), regex.compile(pattern).findall
        for batch in steps(batches):
            units = spaced_units(texts_of(batch))
            written, lengths, decoded = [], [], []
            matches = [[x.encode() for x in split(name)] for name in units.names.to_pylist()]
            known = encoder.encode_all({x for own in matches for x in own})
            for own in matches:
                ids = [i for x in own for i in known[x]]
                written.append(" ".join(map(str, ids)))
                lengths.append(len(ids))
                decoded.append(encoder.decode(ids))
            n, ids_sha, bytes_sha = [], [], []
            offsets = units.offsets.tolist()
            for a, b in zip(offsets, offsets[1:], strict=False):
                own = units.index[a:b].tolist()
                n.append(sum(map(lengths.__getitem__, own)))
                ids_sha.append(hashlib.sha256(" ".join(map(written.__getitem__, own)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the written ids and of the decoded bytes, from one scan without a shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs).mapInArrow(_rows(ranks_path, pattern), schema)


def token_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = PrefixEncoder(read_ranks(ranks_path)), regex.compile(pattern).findall
        for batch in steps(batches):
            ids = [[i for match in split(t) for i in encoder.encode(match.encode())] for t in texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(read_ranks(ranks_path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
