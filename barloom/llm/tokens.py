"""Ids of whole texts as packed bytes, each distinct space-separated unit encoded once per worker and cache fill."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS = 600_000          # newest units a worker keeps, and as many of the generation before
CALL_UNITS = 96                # units per library call: short texts stay in the CPU's caches
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_ASCII_CASES = tuple(c + " " for c in map(chr, range(128)) if c.isspace())
_UNIT_EDGE = re.compile(r"(?<=\S)(?= )")
_WORKER: dict[tuple, "LibraryEncoder"] = {}


class Units(dict):
    """Packed ids by unit.  A lookup of an unknown unit gives an empty buffer, which ``settle`` fills.

    Units of the generation before (``old``) move over when they are used.
    """

    def __init__(self, old: dict | None = None):
        super().__init__()
        self.old, self.pending = old or {}, {}

    def __missing__(self, unit: str):
        packed = self.old.get(unit)
        if packed is None:
            packed = self.pending[unit] = bytearray()
        self[unit] = packed
        return packed

    def turned(self) -> "Units":
        """These units, or a new generation when they are many."""
        if len(self) <= CACHE_UNITS:
            return self
        self.old = {}
        return Units(self)

    def settle(self, encode) -> None:
        """Fill the buffers of unknown units from ``encode(list of units)``."""
        waiting, self.pending = self.pending, {}
        try:
            for (unit, buffer), packed in zip(waiting.items(), encode(list(waiting)) if waiting else ()):
                buffer.extend(packed)
                self[unit] = packed
        except BaseException:
            for unit in waiting:
                self.pop(unit, None)
            raise


class UnitEncoder:
    """Cuts texts before a space that follows a non-space, where no pre-token of either scheme can span.

    ``encode_units`` gives the packed ids (little-endian unsigned 32 bits) of
    each unit.  With ``keep_space`` a unit includes its leading space, as in
    byte-level schemes; otherwise white space only separates.
    """

    def __init__(self, encode_units, keep_space: bool):
        self.encode_units, self.keep_space = encode_units, keep_space
        self.first, self.rest = Units(), Units()

    def _cut(self, text: str) -> list[str]:
        if self.keep_space and (any(c in text for c in _ASCII_CASES) if text.isascii() else _SPACE_AFTER_SPACE.search(text)):
            units = _UNIT_EDGE.split(text)
            return units[:1] + [u[1:] for u in units[1:]]
        return text.split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.first, self.rest = self.first.turned(), self.rest.turned()
        first, rest = self.first.__getitem__, self.rest.__getitem__
        if self.keep_space:
            rows = []
            for text in texts:
                units = iter(self._cut(text))
                rows.append([first(next(units)), *map(rest, units)])
            self.first.settle(self.encode_units)
            self.rest.settle(lambda units: self.encode_units([" " + u for u in units]))
        else:
            rows = [list(map(rest, self._cut(text))) for text in texts]
            self.rest.settle(self.encode_units)
        return [b"".join(r) for r in rows]


class LibraryEncoder:
    """Ids of texts by a tokenizer of the library, each distinct unit of some texts looked up once.

    Units are cut, made distinct and put together again as Arrow and NumPy
    columns; a dictionary per worker remembers the ids of units it has met.
    A text that spells a special token goes through the library whole, as the
    library alone knows what to make of it.
    """

    def __init__(self, path: str, keep_space: bool, cache_units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.keep_space = Tokenizer.from_file(path), keep_space
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = self.specials[-1]
        self.mark_id = self.tok.token_to_id(self.mark)
        self.cache_units, self.known, self.old = cache_units, {}, {}

    def _new_units(self, units: list[str]) -> list[bytes]:
        """Many units per library call, parted by a special token that none of them spells."""
        out = []
        for i in range(0, len(units), CALL_UNITS):
            text = self.mark.join(units[i:i + CALL_UNITS])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            packed, start = ids.tobytes(), 0
            for end in np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist():
                out.append(packed[4 * start:4 * end])
                start = end + 1
        return out

    def _lookup(self, units: list[str]) -> list[bytes]:
        """Packed ids of distinct units; what is not used for a generation of ``cache_units`` is forgotten."""
        if len(self.known) > self.cache_units:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        out = [known.get(u) for u in units]
        open_ = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in open_:
            packed = old.get(units[i])
            if packed is None:
                new.append(i)
            else:
                out[i] = known[units[i]] = packed
        for i, packed in zip(new, self._new_units([units[i] for i in new])):
            out[i] = known[units[i]] = packed
        return out

    def _units(self, texts: list[str]) -> pa.Array:
        """A list of units per text, cut before each space that follows a non-space, that space left out."""
        if self.keep_space and any(_SPACE_AFTER_SPACE.search(t) for t in texts):
            return pa.array([[u[1:] if k else u for k, u in enumerate(_UNIT_EDGE.split(t))] for t in texts], pa.list_(pa.large_string()))
        return pc.split_pattern(pa.array(texts, pa.large_string()), " ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.specials):
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                plain.append(i)
        if not plain:
            return out
        lists = self._units([texts[i] for i in plain])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        codes = lists.flatten().dictionary_encode()
        units, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        packed = self._lookup([" " + u for u in units] if self.keep_space else units)
        if self.keep_space:                                   # a text's first unit has no space before it
            first = np.concatenate([[0], ends[:-1]])
            names, which = np.unique(at[first], return_inverse=True)
            packed = packed + self._lookup([units[i] for i in names.tolist()])
            at[first] = len(units) + which
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        pool, begins = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[at]
        stops = np.cumsum(n)
        ids = pool[np.repeat(begins[at] - (stops - n), n) + np.arange(stops[-1])].tobytes()
        start = 0
        for i, stop in zip(plain, (4 * stops[ends - 1]).tolist()):
            out[i] = ids[start:stop]
            start = stop
        return out


def library_encoder(path: str, keep_space: bool, cache_units: int = CACHE_UNITS) -> LibraryEncoder:
    """The worker's encoder for a vocabulary file of the tokenizers library: what its plain call gives without added tokens."""
    key = (path, keep_space, cache_units)
    if key not in _WORKER:
        _WORKER[key] = LibraryEncoder(*key)
    return _WORKER[key]
