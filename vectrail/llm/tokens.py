"""Token ids of whole texts, from a public tokenizer file, with repeated words looked up rather than encoded again."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from vectrail.llm.common import M0, eights, mix, row_chunks, text_buffers

#: The memory of units: slots, bytes of the longest unit that is remembered, ids. About 65 MB a worker.
SLOTS_LOG2, UNIT_BYTES, POOL = 21, 16, 1 << 23
#: Units that are looked up at once.
GROUP = 1 << 16
_encoders: dict[str, UnitEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> UnitEncoder:
    """One encoder for each worker process and file: its memory of words outlives a task."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


class UnitEncoder:
    """Byte-level BPE in units.

    The tokenizer's own splitting rule ends a piece wherever these hold, whatever surrounds it: before a space that
    a visible character follows; between a letter and an ASCII character that is no letter; after a single line
    end before an ASCII letter. Texts are cut there, each new unit is encoded by the library once, and known units are
    looked up by their own bytes in a table of fixed size (a slot holds the last unit that came to it; units of more than
    UNIT_BYTES are not remembered). Texts that hold the string of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        n = 1 << SLOTS_LOG2
        self.keys = np.zeros((UNIT_BYTES // 8, n), np.uint64)
        self.size = np.zeros(n, np.uint8)
        self.start = np.zeros(n, np.int32)
        self.count = np.zeros(n, np.uint8)  # a unit has no more ids than bytes
        self.pool = np.zeros(POOL, np.uint16 if len(self.width) <= 1 << 16 else np.uint32)
        self.used = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each unit, ids of each unit). Units that begin with a space and hold no other white space
        at either end are encoded as one text; it is divided by the tokens' widths."""
        lengths, second = ends - starts, data[np.minimum(starts + 1, len(data) - 1)]
        glued = (lengths > 1) & (data[starts] == 32) & ((second > 32) & (second < 128) | (second == 0xC3)) & (data[ends - 1] > 32)
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        parts, used = [], 0
        if glued.any():
            size = lengths[glued]
            stop = np.cumsum(size)
            text = data[np.arange(stop[-1]) + np.repeat(starts[glued] - (stop - size), size)].tobytes().decode()
            got = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            width = np.cumsum(self.width[got])
            k = np.searchsorted(width, stop) + 1
            if not (width[k - 1] == stop).all():
                raise ValueError("a token crosses a unit's end")
            count[glued] = np.diff(k, prepend=0)
            first[glued] = k - count[glued]
            parts.append(got)
            used = len(got)
        rest = np.nonzero(~glued)[0]
        if len(rest):
            texts = [data[x:y].tobytes().decode() for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            count[rest] = [len(x) for x in ids]
            first[rest] = used + np.cumsum(count[rest]) - count[rest]
            parts.append(np.array([i for x in ids for i in x], np.uint32))
        return np.concatenate(parts), first, count

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of the first id of each text) of texts laid end to end; cuts has the texts' ends, after a 0."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
        ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        letter = ascii_letter.copy()
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(n + 1, bool)
        visible = ((data > 32) & (data < 127)) | (data == 0xC3)
        cut[:-2] |= (data[:-1] == 32) & visible[1:]
        cut[1:-1] |= letter[:-1] & ~ascii_letter[1:] & (data[1:] < 128)
        if n > 2:
            cut[2:-1] |= (data[1:-1] == 10) & (data[:-2] > 32) & (data[:-2] < 127) & ascii_letter[2:]
        cut[cuts] = True
        cut[0], cut[n] = True, True
        edges = np.nonzero(cut)[0]
        starts, ends = edges[:-1], edges[1:]
        window = eights(data)
        ids, counts = [], []
        for at in range(0, len(starts), GROUP):
            part, count = self._look_up(data, window, starts[at : at + GROUP], ends[at : at + GROUP])
            ids.append(part)
            counts.append(count)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), total[np.searchsorted(starts, cuts)]

    def _look_up(self, data: np.ndarray, window: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each unit) of units laid end to end."""
        size = ends - starts
        words = np.zeros((UNIT_BYTES // 8, len(starts)), np.uint64)
        h = size.astype(np.uint64)
        for j in range(UNIT_BYTES // 8):
            rest = np.nonzero(size > 8 * j)[0]
            left = size[rest] - 8 * j
            x = window[starts[rest] + 8 * j].view(np.uint64).ravel()
            short = left < 8
            x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
            words[j, rest] = x
            h[rest] = mix(h[rest] * M0 + x)
        slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        fits = size <= UNIT_BYTES
        known = fits & (self.size[slot] == size) & (self.keys[:, slot] == words).all(axis=0)
        first, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        missed = np.nonzero(~known)[0]
        if not len(missed):
            index = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            return self.pool[index].astype(np.uint32), count
        # Each new unit once: short ones by their bytes and sizes, long ones by their bytes.
        brief = missed[fits[missed]]
        order = brief[np.lexsort((*words[:, brief], size[brief]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words[:, order[1:]] != words[:, order[:-1]]).any(axis=0) | (size[order[1:]] != size[order[:-1]])
        number = np.empty(len(starts), np.int64)
        number[order] = np.cumsum(fresh) - 1
        new = order[fresh].tolist()
        stored = len(new)
        seen: dict[bytes, int] = {}
        for i in missed[~fits[missed]].tolist():
            k = seen.setdefault(data[starts[i] : ends[i]].tobytes(), len(new))
            if k == len(new):
                new.append(i)
            number[i] = k
        new = np.array(new, np.int64)
        extra, offset, lengths = self._encode_units(data, starts[new], ends[new])
        first[missed], count[missed] = POOL + offset[number[missed]], lengths[number[missed]]
        index = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        held = index < POOL
        ids = np.empty(len(index), np.uint32)
        ids[held] = self.pool[index[held]]
        ids[~held] = extra[index[~held] - POOL]
        if stored and len(extra) <= POOL:
            if self.used + len(extra) > POOL:
                self.size[:], self.used = 0, 0
            self.pool[self.used : self.used + len(extra)] = extra
            keep, at = new[:stored], slot[new[:stored]]
            # Of units that come to one slot, the last in this order is whole in all columns.
            _, last = np.unique(at[::-1], return_index=True)
            last = stored - 1 - last
            keep, at = keep[last], at[last]
            self.keys[:, at], self.size[at] = words[:, keep], size[keep]
            self.start[at], self.count[at] = self.used + offset[:stored][last], lengths[:stored][last]
            self.used += len(extra)
        return ids, count


def encode_column(column: pa.Array, path: str | None = None):
    """Yields (first row, ids, bounds) for runs of rows of a string column: row i of the run has ids[bounds[i]:bounds[i + 1]]."""
    enc = encoder(path)
    offsets, data = text_buffers(column)
    for lo, hi in row_chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        raw = part.tobytes()
        if any(s in raw for s in enc.special):
            pieces = enc.whole([raw[a:b].decode() for a, b in zip((offsets[lo:hi] - offsets[lo]).tolist(), (offsets[lo + 1 : hi + 1] - offsets[lo]).tolist(), strict=True)])
            yield lo, np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            continue
        ids, bounds = enc.encode(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, ids, bounds
