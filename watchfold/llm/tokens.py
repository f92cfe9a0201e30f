"""Exact token ids and token counts of whole texts with public tokenizers, with a bounded cache per worker.

Both vocabularies never merge across certain places of a text (see below). A text is cut there, equal pieces
are encoded once per worker, and the results are put together again; they equal those of the library on the
whole text. The caches are direct-mapped tables of fixed size.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from watchfold.llm import words as W

U64 = W.U64
SLOTS = 1 << 21
WIDE = 8


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; a name with a slash is taken as a path."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class WordIds:
    """Ids of a BPE vocabulary with word ends (lower case, white space dropped), as `tokenizers` gives them.

    Its pre-tokenizer drops white space, so the ids of a text are the ids of its words in order. Words of plain
    Latin letters, digits and signs are encoded in bulk with `tiktoken` from the same merges: the word end is a
    byte that such words do not hold, whose merges rank first, as in the vocabulary. All other words, and words
    with the special strings, go through `tokenizers` itself.
    """

    END = "\x01"
    # Fixed value: the pre-tokenizer pattern of the vocabulary.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for token, number in vocabulary.items():
            ended = token.endswith("</w>")
            body = token[:-4] if ended else token
            if not body or any(c not in byte_of for c in body) or token.startswith("<|"):
                continue
            ranks[bytes(byte_of[c] for c in body) + (b"\x01" if ended else b"")] = number
        self.newline = ranks[b"\n"]
        self.bulk = tiktoken.Encoding("word_ends", pat_str=r"[^ \n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(self.PIECES)
        # Lower-casing and composing treat these character by character.
        self.plain = re.compile(r"[\n!-~¡-įı-ž]*")
        self.keys = np.zeros(SLOTS, dtype=U64)
        self.lens = np.zeros(SLOTS, dtype=np.uint8)
        self.ids = np.zeros((SLOTS, WIDE), dtype=np.uint16)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many each has."""
        odd, text = {}, "\n".join(words)
        if not self.plain.fullmatch(text) or "<|" in text:
            odd = {i: w for i, w in enumerate(words) if not self.plain.fullmatch(w) or "<|" in w}
            text = "\n".join("" if i in odd else w for i, w in enumerate(words))
        text = self.cut.sub("\\g<0>\x01 ", text.lower())
        flat = np.array(self.bulk.encode_ordinary(text + "\n"), dtype=np.int64)
        ends = np.flatnonzero(flat == self.newline)
        lens = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        if odd:
            found = [e.ids for e in self.whole.encode_batch_fast(list(odd.values()), add_special_tokens=False)]
            at = np.cumsum(lens)[list(odd)]
            flat = np.insert(flat, np.repeat(at, [len(f) for f in found]), [x for f in found for x in f])
            lens[list(odd)] = [len(f) for f in found]
        return flat.astype(np.uint16), lens

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and the offset of each row in them (rows + 1 values)."""
        starts, ends, firsts = W.find_words(data, offsets)
        h = W.hash_words(data, starts, ends)
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == h
        miss = np.flatnonzero(~hit)
        lens = self.lens[slot].astype(np.int64)
        if len(miss):
            values, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[one]
            raw = data.tobytes()
            new_flat, new_lens = self.encode_words(
                [raw[s:e].decode() for s, e in zip(starts[where].tolist(), ends[where].tolist())])
            lens[miss] = new_lens[back]
        at = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(at[-1], dtype=np.uint16)
        for j in range(WIDE):
            some = np.flatnonzero(hit & (lens > j))
            if not len(some):
                break
            out[at[some] + j] = self.ids[slot[some], j]
        if len(miss):
            new_at = np.concatenate([[0], np.cumsum(new_lens)])
            n = lens[miss]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[miss], n) + inner] = new_flat[np.repeat(new_at[back], n) + inner]
            short = np.flatnonzero(new_lens <= WIDE)
            into = slot[where[short]]
            for j in range(WIDE):
                has = new_lens[short] > j
                self.ids[into[has], j] = new_flat[new_at[short[has]] + j]
            # Of two words in one slot the later write wins everywhere: keys last, from the same order.
            self.lens[into] = new_lens[short]
            self.keys[into] = values[short]
            self._repair(into, values[short])
        return out, at[firsts]

    def _repair(self, into: np.ndarray, values: np.ndarray) -> None:
        """Slots that two new words share are emptied, whichever of them was written there."""
        shared, counts = np.unique(into, return_counts=True)
        self.keys[shared[counts > 1]] = 0


class PieceCounts:
    """Token counts of a `sentencepiece` model whose pieces hold the space mark only at their start.

    A text is cut before every run of spaces and around every line feed and tab, which are single byte tokens.
    A row that holds the space mark itself is encoded whole.
    """

    MARK = b"\xe2\x96\x81"

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        mark = self.MARK.decode()
        if any(mark in p.lstrip(mark) or "\n" in p or "\t" in p for p in pieces):
            raise ValueError("this vocabulary merges across spaces, tabs or line feeds")
        self.keys = np.zeros(SLOTS, dtype=U64)
        self.counts = np.zeros(SLOTS, dtype=np.int32)

    def count_texts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count_segment(self, segment: str, opens: bool) -> int:
        """Tokens of one segment; ``opens`` if it is the first of its text."""
        return self._count([segment], [opens])[0]

    def _count(self, segments: list[str], opens: list[bool]) -> list[int]:
        asked, less = [], []
        for s, first in zip(segments, opens):
            if first:
                asked.append(s)
                less.append(0)
            elif s[0] == " ":
                asked.append(s[1:])
                less.append(0 if len(s) > 1 else -1)
            else:
                asked.append("\n" + s)
                less.append(2)
        return [n - k for n, k in zip(self.count_texts(asked), less)]

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and token counts of all segments, and the first segment of each row (rows + 1 values)."""
        if not len(data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(offsets), dtype=np.int64)
        space, bar = data == 0x20, (data == 0x0A) | (data == 0x09)
        start = bar.copy()
        start[0] = True
        start[1:] |= bar[:-1] | (space[1:] & ~space[:-1])
        opening = offsets[:-1][np.diff(offsets) > 0]
        start[opening] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        opens = np.isin(starts, opening, assume_unique=True)
        h = W.hash_words(data, starts, ends) ^ np.where(opens, U64(0x5851F42D4C957F2D), U64(0))
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        counts = self.counts[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            values, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[one]
            raw = data.tobytes()
            new = np.array(self._count([raw[s:e].decode() for s, e in zip(starts[where].tolist(), ends[where].tolist())],
                                       opens[where].tolist()), dtype=np.int64)
            counts[miss] = new[back]
            into = slot[where]
            self.keys[into] = values
            self.counts[into] = new
            shared, times = np.unique(into, return_counts=True)
            self.keys[shared[times > 1]] = 0
        return ends, counts, np.searchsorted(starts, offsets)

    def marked_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold the space mark."""
        if len(data) < 3:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        return np.unique(np.searchsorted(offsets, at, side="right") - 1)


def word_ids(name: str) -> WordIds:
    path = tokenizer_path(name)
    return W.kept(f"word_ids:{path}", lambda: WordIds(path))


def piece_counts(name: str) -> PieceCounts:
    path = tokenizer_path(name)
    return W.kept(f"piece_counts:{path}", lambda: PieceCounts(path))


def column_runs(column: pa.Array):
    """(row range, bytes, offsets) of a text column in runs of bounded size."""
    data, offsets = W.text_buffers(column)
    for a, b in W.runs_of_rows(offsets):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
