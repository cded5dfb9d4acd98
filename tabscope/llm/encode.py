"""Token ids of whole texts with the ``tokenizers`` library, one call per distinct piece.

A byte-pair encoder never merges across the pieces its pre-tokenizer makes, so a text may be
cut at places where every pre-tokenizer of that file cuts; each distinct piece is then
encoded once per Python worker.  The cut rules below are stated per vocabulary file; a
file without a rule is encoded text by text.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import LETTER, LOWER, SPACE

PIECE_LIMIT = 1_000_000     # remembered pieces of a worker; beyond it the memory starts anew
# ASCII marks that no special token holds
MARK = np.zeros(256, bool)
MARK[np.frombuffer(b".,!?%$&*;:()", np.uint8)] = True
LETTER_LOW = np.zeros(256, bool)
LETTER_LOW[97:123] = True
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of the rows of a byte buffer, with the pieces already encoded kept."""

    def __init__(self, path: str, limit: int = PIECE_LIMIT):
        from tokenizers import Tokenizer
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        pre = str(self.tokenizer.pre_tokenizer)
        self.style = "word" if self.tokenizer.normalizer and "Lowercase" in str(self.tokenizer.normalizer) \
            and "use_regex=False" in pre else "space" if "ByteLevel(add_prefix_space=False" in pre else "text"
        # tokens that end ("word") or begin ("space") a pre-token of letters
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.style == "word" else t.startswith("\u0120"))]] = True
        self.forget()

    def forget(self):
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros((1 << 16) + 1, np.int64)

    def pieces(self, buf: np.ndarray, off: np.ndarray):
        """Piece text buffer, piece offsets, row offsets in pieces."""
        if self.style == "text" or len(buf) == 0:
            return buf, off, np.arange(len(off))
        if self.style == "word":
            # white space is dropped; a mark after an ASCII letter starts a new pre-token
            if b"<|" not in buf.tobytes():
                buf = LOWER[buf]
            keep = ~SPACE[buf]
            first = keep.copy()
            first[1:] &= ~keep[:-1]
            row = off[off < len(buf)]
            first[row] = keep[row]
            first[1:] |= MARK[buf[1:]] & LETTER_LOW[buf[:-1]]
            return buf[keep], np.append(np.flatnonzero(first[keep]), int(keep.sum())), np.searchsorted(np.flatnonzero(first), off)
        # a single blank between two characters that are surely not white space starts a pre-token,
        # and so does a '.' or ',' after an ASCII letter
        new = np.zeros(len(buf) + 1, bool)
        letter = LETTER[buf]
        new[1:-1] = ((buf[1:] == 46) | (buf[1:] == 44)) & letter[:-1]
        cut = np.flatnonzero(buf == 32)
        cut = cut[(cut > 2) & (cut < len(buf) - 1)]
        left, right = buf[cut - 1], buf[cut + 1]
        wide = (buf[cut - 3] >= 0xE1) & (buf[cut - 3] <= 0xE3)
        ok = ~SPACE[left] & ~SPACE[right] & (left >= 32) & (right >= 32) & (buf[cut - 2] != 0xC2) & ~wide \
            & (right != 0xC2) & ((right < 0xE1) | (right > 0xE3))
        new[cut[ok]] = True
        new[off[:-1]] = True
        start = np.flatnonzero(new[:-1])
        return buf, np.append(start, len(buf)), np.searchsorted(start, off)

    def _encode_new(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in the order they were encoded, their lengths in ids, all ids.

        Pieces that are one pre-token of letters are encoded 64 at a time, as the tokens show where one ends.
        """
        if self.style == "text":
            together = []
        elif self.style == "word":
            together = [w for w in new if w.isalpha()]
        else:
            together = [w for w in new if w[0] == " " and w[1:].isalpha()]
        groups = [together[i:i + 64] for i in range(0, len(together), 64)]
        glue = " " if self.style == "word" else ""
        order, lengths, ids = [], [], []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.edge[got])
            if len(at) == len(g):
                order += g
                lengths.append(np.diff(at, prepend=-1) if self.style == "word" else np.diff(at, append=len(got)))
                ids.append(got)
        done = set(order)
        alone = [w for w in new if w not in done]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            order.append(w)
            lengths.append([len(e.ids)])
            ids.append(np.array(e.ids, np.uint32))
        return order, np.concatenate(lengths), np.concatenate(ids)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (uint32) and row offsets in ids."""
        buf, at, rows = self.pieces(buf, off)
        n = len(at) - 1
        if n <= 0 or len(buf) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        column = column.dictionary_encode()
        distinct = column.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(distinct) > self.limit:
            self.forget()
        place = self.place
        at = np.fromiter(map(place.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new, length, got = self._encode_new([distinct[i] for i in unknown])
            base, used = len(place), int(self.first[len(place)])
            ends = used + np.cumsum(length)
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), int(ends[-1])), np.uint32)])
            if base + len(new) >= len(self.first):
                self.first = np.concatenate([self.first, np.zeros(len(self.first) + len(new), np.int64)])
            self.ids[used:ends[-1]] = got
            self.first[base + 1:base + 1 + len(new)] = ends
            place.update(zip(new, range(base, base + len(new))))
            at[unknown] = [place[distinct[i]] for i in unknown]
        which = at[column.indices.to_numpy()]
        length = self.first[which + 1] - self.first[which]
        stop = np.cumsum(length)
        ids = self.ids[np.arange(int(stop[-1])) + np.repeat(self.first[which] - (stop - length), length)]
        return ids, np.concatenate([[0], stop])[rows]


def encoder(path: str, limit: int = PIECE_LIMIT) -> Encoder:
    """The worker's encoder for a vocabulary file (kept between tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, limit)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each row."""
    if end_id is None:
        return ids, off
    return np.insert(ids, off[1:], np.uint32(end_id)), off + np.arange(len(off))


def vocabulary(name: str) -> str:
    """Path of one of the public vocabulary files installed beside the tokenizer libraries."""
    import public_tokenizers
    return public_tokenizers.path(name)
