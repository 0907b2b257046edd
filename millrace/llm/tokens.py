"""Token ids of whole texts by a public byte-level BPE file; a slice's distinct units are encoded once.

Byte-level BPE first splits a text by a pattern in which a run of non-space
characters, with at most one space before it, never shares a piece with the run
after the next single space or newline, nor an ASCII letter or digit with a sign after
it.  So texts are cut there, in their bytes, and the ids of such units can be joined; texts
with any other spacing, or with one of the file's added tokens, are encoded whole.  Both
ways give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

A unit keeps the space or newline before it, so distinct units are encoded many at a time
as one text, and each id that begins so begins a unit.  Nothing but the vocabulary outlives
a slice: memory is some ten times SLICE_BYTES, or a longer text's, however many words there are.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as tk

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Bytes of texts whose distinct units are encoded together.
SLICE_BYTES = 16 << 20
#: Units that are encoded as one text, and units whose ids are put together at a time.
JOINED, GATHERED = 512, 1 << 18
_SPACE = r"[ \n\t\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A unit that is empty, or begins or ends with white space.
_ODD = rf"\A{_SPACE}|{_SPACE}\z|[ \n]{_SPACE}|{_SPACE}[ \n]"
_BREAK = np.array([b in b" \n" for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_SIGN = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def public_path(name: str = TOKENIZER_FILE) -> str:
    """Where the installed vocabulary file of this name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class UnitTokenizer:
    def __init__(self, path: str, end_id: int | None = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.end = array("I", [end_id] if end_id is not None else []).tobytes()
        vocab = self.t.get_vocab()
        # byte-level files write a space as U+0120, a newline as U+010A
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for x, i in vocab.items() if x[0] in "ĠĊ"]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and each one's first place (n + 1 limits)."""
        parts = []
        for a in range(0, len(units), JOINED):
            parts.append(self._ids(b"".join([u if u[0] in b" \n" else b"\n" + u for u in units[a : a + JOINED]]).decode()))
        ids = np.concatenate(parts)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(units):
            raise ValueError("not a byte-level vocabulary that splits at spaces and newlines")
        # a newline put before a unit is no part of it
        lent = np.array([u[0] not in b" \n" for u in units])
        keep = np.ones(len(ids), bool)
        keep[first[lent]] = False
        return ids[keep], np.append(first, len(ids)) - np.append(0, np.cumsum(lent))

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, not empty, that can be cut into units."""
        data, off = tk.buffers(texts)
        at = off[:-1] + np.arange(len(texts))
        buf = np.full(len(data) + len(texts), 10, np.uint8)
        own = np.ones(len(buf), bool)
        own[at] = False
        buf[own] = data
        cut = _BREAK[buf]
        cut[1:] |= _ALNUM[buf[:-1]] & _SIGN[buf[1:]]
        starts = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
        ids, limits = self._units(units.dictionary.to_pylist())
        which = np.asarray(units.indices)
        firsts = np.append(np.searchsorted(starts, at), len(starts))
        out = []
        for a, z in tk.slices(which, firsts, GATHERED):
            lo = firsts[a]
            u = which[lo : firsts[z]]
            s, n = limits[u], limits[u + 1] - limits[u]
            # the newline put before a text is no part of it
            s[firsts[a:z] - lo] += 1
            n[firsts[a:z] - lo] -= 1
            ends = np.cumsum(n)
            got = ids[np.repeat(s - ends + n, n) + np.arange(ends[-1])]
            b = [0, *(4 * ends[firsts[a + 1 : z + 1] - lo - 1]).tolist()]
            raw = got.tobytes()
            out += [raw[x:y] + self.end for x, y in zip(b[:-1], b[1:], strict=True)]
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last; null is an empty text."""
        arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        arr = arr.fill_null("")
        out = [self.end] * len(arr)
        for a, z in tk.slices(*tk.buffers(arr), SLICE_BYTES):
            part = arr.slice(a, z - a)
            odd = pc.match_substring_regex(part, _ODD)
            for x in self.added:
                odd = pc.or_(odd, pc.match_substring(part, x))
            whole, some = np.asarray(odd), np.asarray(pc.greater(pc.binary_length(part), 0))
            for i in np.flatnonzero(whole).tolist():
                out[a + i] = self._ids(part[i].as_py()).tobytes() + self.end
            plain = np.flatnonzero(some & ~whole)
            if len(plain):
                for i, b in zip(plain.tolist(), self._plain(part.take(pa.array(plain))), strict=True):
                    out[a + i] = b
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None, end_id: int | None = 1) -> UnitTokenizer:
    """A worker's tokenizer; without a path, of the file installed where the worker runs."""
    return UnitTokenizer(path or public_path(), end_id)
