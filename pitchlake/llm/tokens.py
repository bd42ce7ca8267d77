"""Ids of a byte-level BPE tokenizer file, computed for the distinct pieces of a batch instead of for every word.

Texts are cut into pre-tokens (the pattern that the file's byte-level pre-tokenizer applies) by NumPy on code points.
Distinct pieces are looked up by hash in a bounded cache and compared with the piece that is kept there; new ones are
merged by ``tiktoken`` with the file's own vocabulary, whose ids are the merge ranks. A text that holds a special string,
a code point that Unicode does not assign, or a piece that is not the one of its hash goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pitchlake.llm.words import span_hashes

CACHED_PIECES = 200_000  # frequent ones come early; those beyond are forgotten after their slice
SLICE_CHARS = 1 << 18
# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            out[c] = LETTER
        elif k[0] == "N":
            out[c] = NUMBER
        elif k == "Cn":
            out[c] = UNKNOWN
    # The code points with the White_Space property.
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


class PieceTokenizer:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in w): i for w, i in file["model"]["vocab"].items() if w not in self.special}
        self.merge = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind, self.hashes = _classes(), span_hashes
        self.kept: tuple | None = None  # the cache before pieces that it is not to keep
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and their slots
        self.at, self.n, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool = np.zeros(1 << 18, np.uint32)
        self.code_at, self.code_n, self.code_used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.codes = np.zeros(1 << 18, np.uint32)

    def _starts(self, code: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where pre-tokens start; offsets are the rows' places, none of them empty."""
        n = len(code)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start[offsets[:-1]] = True
        row_start = np.zeros(n + 1, bool)
        row_start[offsets] = True
        # a run of white space before a word: its last character stands alone, or joins the word if it is a blank
        word = np.flatnonzero(start & (kind != SPACE) & ~row_start[:-1])
        word = word[kind[word - 1] == SPACE]
        start[word - 1] = True
        start[word[code[word - 1] == 32]] = False
        # contractions: an apostrophe that starts a pre-token
        mark = np.flatnonzero((code == 39) & start)
        if len(mark):
            end_of_row = offsets[np.searchsorted(offsets, mark, "right")]
            one = np.where(mark + 1 < end_of_row, code[np.minimum(mark + 1, n - 1)], 0)
            two = np.where(mark + 2 < end_of_row, code[np.minimum(mark + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for width, which in ((2, short), (3, long)):
                at = mark[which]
                start[at + 1] = False
                after = at + width
                after = after[after < n]
                start[after] = True
        return np.flatnonzero(start)

    def _keep(self, new: int, at: str, n: str, pool: str, used: str, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Append values of ``new`` slots to a pool, which doubles when it is full."""
        k = len(self.known)
        while len(getattr(self, at)) < k + new:
            for name in (at, n):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        first = getattr(self, used)
        while len(getattr(self, pool)) < first + len(flat):
            setattr(self, pool, np.concatenate([getattr(self, pool), np.zeros_like(getattr(self, pool))]))
        getattr(self, pool)[first : first + len(flat)] = flat
        getattr(self, at)[k : k + new] = first + np.cumsum(sizes) - sizes
        getattr(self, n)[k : k + new] = sizes
        setattr(self, used, first + len(flat))

    def _lookup(self, text: str, code: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the pool, number of ids, wrong) of each piece text[s:e] with hash h; wrong: the slot of the hash has another piece."""
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        if self.kept:
            self.known, self.slots, self.used, self.code_used = self.kept
            self.kept = None
        place = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == unique[inside]
        slot = np.empty(len(unique), np.int64)
        slot[old] = self.slots[place[old]]
        new = np.flatnonzero(~old)
        if len(self.known) + len(new) > CACHED_PIECES:
            self.kept = self.known, self.slots, self.used, self.code_used
        if len(new):
            begin, stop = s[first[new]].tolist(), e[first[new]].tolist()
            ids = [self.merge.encode_ordinary(text[a:z]) for a, z in zip(begin, stop, strict=True)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            slot[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._keep(len(new), "at", "n", "pool", "used", sizes, np.fromiter((x for y in ids for x in y), np.uint32, int(sizes.sum())))
            self._keep(len(new), "code_at", "code_n", "codes", "code_used", e[first[new]] - s[first[new]], np.concatenate([code[a:z] for a, z in zip(begin, stop, strict=True)]))
            self.known, self.slots = np.insert(self.known, place[new], unique[new]), np.insert(self.slots, place[new], slot[new].astype(np.int32))
        slot = slot[back]
        wrong = self.code_n[slot] != e - s
        width = np.where(wrong, 0, e - s)
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        differs = code[np.repeat(s, width) + step] != self.codes[np.repeat(self.code_at[slot], width) + step]
        wrong[np.repeat(np.arange(len(s)), width)[differs]] = True
        return self.at[slot], self.n[slot], wrong

    def _encode_slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        filled = [t for t in texts if t]
        text = "".join(filled)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in filled])]).astype(np.int64)
        kind = self.kind[code]
        odd = np.add.reduceat(kind == UNKNOWN, offsets[:-1]) > 0 if len(filled) else np.zeros(0, bool)
        starts = self._starts(code, kind, offsets) if len(code) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(code)) if len(starts) else starts
        at, n, wrong = self._lookup(text, code, starts, ends, self.hashes(code, starts, ends)) if len(starts) else (starts, starts, starts > 0)
        odd[np.searchsorted(offsets, starts[wrong], "right") - 1] = True
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        bounds = before[np.searchsorted(starts, offsets)]
        k = 0
        for t in texts:
            if not t:
                yield np.zeros(0, np.uint32)
                continue
            if odd[k] or any(w in t for w in self.special):
                yield np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bounds[k] : bounds[k + 1]]
            k += 1

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; slices bound the memory."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size >= SLICE_CHARS:
                yield from self._encode_slice(held)
                held, size = [], 0
        if held:
            yield from self._encode_slice(held)
