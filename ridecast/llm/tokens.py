"""Token ids of an Arrow text column, by a public tokenizer file.

Every id comes from the ``tokenizers`` library.  Text that consists of ASCII and Latin-1 letters is cut into the
tokenizer's own pre-tokens on bytes, each distinct pre-token is encoded once by the tokenizer's model, and the ids are
gathered in numpy; any other text goes through the whole tokenizer.  That holds for files with the pre-tokenizer of
``word_bpe_49k.json`` (checked on loading); for all others every text goes through the tokenizer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ridecast.llm.common import hash_words, lower_table, text_slices

LETTER, DIGIT, OTHER, SPACE, BAD = 1, 2, 3, 0, 4
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CACHE_WORDS = 1 << 19
COMPARED = 1 << 15          # pre-tokens whose bytes are compared at a time


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = SPACE
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = t[0xC3] = LETTER
    t[0x80:0xC0] = LETTER                                 # the second byte of a Latin-1 letter
    t[0xC0:0xC3] = t[0xC4:] = BAD
    return t


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start … start + size - 1 of every pair, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Encoder:
    """One per Python worker: the tokenizer and the pre-tokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE  # noqa: F401  (the model class must be loaded)
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        # strings that the tokenizer takes as tokens of their own: texts with one of them go through all of it
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fast = (steps[0].get("pattern", {}).get("Regex") == KNOWN_SPLIT and len(steps) == 2
                     and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex")
                     and norm == ["NFC", "Replace", "Lowercase"])
        self.words = Tokenizer(self.whole.model)
        self.chars, self.lower, self.classes = _byte_chars(), lower_table(), _classes()
        self.clear()

    def clear(self):
        self.known = np.empty(0, np.uint64)               # sorted hashes of pre-tokens
        self.place = np.empty(0, np.int64)                # where each one's ids begin
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)                # where its bytes begin, and how many there are
        self.size = np.empty(0, np.int64)
        self.bytes = np.empty(0, np.uint8)

    def _learn(self, raw, starts, ends, h):
        """Encode the pre-tokens that are not known yet."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        h, at = np.unique(h, return_index=True)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            new = self.known[near] != h
            h, at = h[new], at[new]
        if not len(h):
            return
        data, chars = raw.tobytes(), self.chars
        words = [data[a:b].decode("latin-1") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        table = {i: c for i, c in enumerate(chars) if chr(i) != c}
        words = [w if w.isascii() and w.isprintable() else w.translate(table) for w in words]
        counts, ids = [], []
        for a in range(0, len(words), 8192):
            e = self.words.encode(words[a:a + 8192], is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(words[a:a + 8192])))
            ids.append(np.array(e.ids, np.uint32))
        counts = np.concatenate(counts)
        place = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate((self.ids, *ids))
        size = (ends - starts)[at]
        begin = np.cumsum(size) - size + len(self.bytes)
        self.bytes = np.concatenate((self.bytes, raw[flat(starts[at], size)]))
        known = np.concatenate((self.known, h))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.place = np.concatenate((self.place, place))[order]
        self.count = np.concatenate((self.count, counts))[order]
        self.begin = np.concatenate((self.begin, begin))[order]
        self.size = np.concatenate((self.size, size))[order]

    def _other(self, raw, starts, ends, at):
        """Which pre-tokens only share their hash with the known ones ``at``: their bytes differ."""
        size = ends - starts
        other = size != self.size[at]
        for a in range(0, len(at), COMPARED):
            same = a + np.flatnonzero(~other[a:a + COMPARED])
            n = size[same]
            differ = raw[flat(starts[same], n)] != self.bytes[flat(self.begin[at[same]], n)]
            if differ.any():
                other[same[np.repeat(np.arange(len(same)), n)[differ]]] = True
        return other

    def _simple(self, raw, offs):
        """Pre-tokens of each text (start, end) and which texts the byte rules cover."""
        n_docs = len(offs) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(offs))
        kind = self.classes[raw]
        second = np.zeros(len(raw), bool)
        second[1:] = raw[:-1] == 0xC3
        high = raw >= 0x80
        bad = (kind == BAD) | (high & (raw < 0xC0) & ~second) | (second & ((raw == 0x97) | (raw == 0xB7)))
        low = self.lower[raw]
        low = np.where(second & (raw >= 0x80) & (raw <= 0x9E), raw + 0x20, low)
        quote = np.flatnonzero(low[:-1] == 0x27) if len(low) else np.empty(0, np.int64)
        bad[quote[np.isin(low[quote + 1], np.frombuffer(b"stmdrvl", np.uint8))]] = True
        slow = np.bincount(doc[bad], minlength=n_docs) > 0
        edge = np.ones(len(raw), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(raw))
        use = (kind[starts] != SPACE) & ~slow[doc[starts]]
        starts, ends = starts[use], ends[use]
        return low, starts, ends, doc[starts], slow

    def encode(self, batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
        """The ids (uint32) of each text; null counts as empty."""
        col = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(col, "") if col.null_count else col
        for a, b, raw, offs in text_slices(batch, column):
            if not self.fast:
                for e in self.whole.encode_batch(texts[a:b].to_pylist(), add_special_tokens=False):
                    yield np.array(e.ids, np.uint32)
                continue
            low, starts, ends, doc, slow = self._simple(raw, offs)
            h = hash_words(low, starts, ends)
            self._learn(low, starts, ends, h)
            at = np.searchsorted(self.known, h)
            slow[doc[self._other(low, starts, ends, at)]] = True
            for word in self.added:
                found = pc.match_substring(texts.slice(a, b - a), word, ignore_case=True)
                slow |= found.to_numpy(zero_copy_only=False)
            count = self.count[at]
            total = np.cumsum(count)
            ids = self.ids[np.repeat(self.place[at] - total + count, count) + np.arange(total[-1] if len(total) else 0)]
            first = np.searchsorted(doc, np.arange(b - a + 1))
            cut = np.concatenate(([0], total))[first]
            for d in range(b - a):
                if slow[d]:
                    e = self.whole.encode(texts[a + d].as_py(), add_special_tokens=False)
                    yield np.array(e.ids, np.uint32)
                else:
                    yield ids[cut[d]:cut[d + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
