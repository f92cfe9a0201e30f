"""Encoding and decoding with `sentencepiece` vocabularies of merge type.

A text becomes one symbol per character; all adjacent pairs whose concatenation is a piece wait in an agenda
ordered by the piece's score, leftmost first among equal scores. The best pair is merged, the pairs it took part
in leave the agenda, its new neighbours enter. Symbols that are no piece fall back to bytes.

No merge crosses a place where the vocabulary has no piece that spans it, so a text is cut there and equal
segments are encoded once per worker (a direct-mapped table of fixed size). The agendas of many short segments
advance together, one merge of each per step; a long segment has a heap of its own.

Every segment that a worker encodes is also given to the `sentencepiece` library, as is one whole text of each
Arrow batch, and every decoded text is compared with the library's; a difference raises an error.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfold.llm import words as W
from watchfold.llm.tokens import column_runs, tokenizer_path

U64 = W.U64
SLOTS = 1 << 21
WIDE = 8
CHECKED = 256
SHORT = (8, 16, 32, 64)
NEVER = np.int32(2**31 - 1)
MARK = "▁"
MARK_BYTES = MARK.encode()


class Vocabulary:
    """The model's file and the library's reading of it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as format
        self.model = format.ModelProto()
        with open(path, "rb") as f:
            self.model.ParseFromString(f.read())
        rules, kinds = self.model.normalizer_spec, format.ModelProto.SentencePiece
        if (self.model.trainer_spec.model_type != format.TrainerSpec.BPE or not self.model.trainer_spec.byte_fallback
                or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces
                or not rules.escape_whitespaces or self.model.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in self.model.pieces)):
            raise ValueError("only merge-type vocabularies with byte fallback, without text normalization, are supported")
        self.kinds = kinds
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)


class PieceTexts:
    """The texts of ids."""

    def __init__(self, path: str):
        read = Vocabulary(path)
        self.library, kinds, pieces = read.library, read.kinds, read.model.pieces
        bodies = [p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL
                  else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
                  else read.model.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"" for p in pieces]
        self.pieces = len(pieces)
        self.is_text = np.array([p.type != kinds.CONTROL for p in pieces])
        self.opens_marked = np.array([p.type == kinds.NORMAL and p.piece.startswith(MARK) for p in pieces])
        self.body_at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        self.body = np.frombuffer(b"".join(bodies), dtype=np.uint8)

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of rows of ids: the bodies of their pieces, without the mark that opens the first one."""
        if len(flat) and not (0 <= flat.min() and flat.max() < self.pieces):
            raise ValueError("an id is not in the vocabulary")
        size = self.body_at[flat + 1] - self.body_at[flat]
        at = np.concatenate([[0], np.cumsum(size)])
        inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
        raw = self.body[np.repeat(self.body_at[flat], size) + inner].tobytes()
        texts = np.flatnonzero(self.is_text[flat]) if len(flat) else np.zeros(0, dtype=np.int64)
        first = np.searchsorted(texts, offsets[:-1])
        out = []
        for k, a, b in zip(first.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            lead = k < len(texts) and texts[k] < b and self.opens_marked[flat[texts[k]]]
            body = raw[at[a] + (1 if lead else 0):at[b]]
            try:
                out.append(body.decode())
            except UnicodeDecodeError:  # broken byte runs: the library's replacement rules
                out.append(self.library.decode(flat[a:b].tolist()))
        return out


class PieceIds:
    """Symbols, pairs and the agenda of one vocabulary."""

    def __init__(self, path: str):
        read = Vocabulary(path)
        model, kinds, self.library = read.model, read.kinds, read.library
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        n = len(model.pieces)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        # Symbols: the pieces, characters that occur inside pieces only, any other character, padding.
        inner = sorted({c for p in normal for c in p} - normal.keys())
        symbols = normal | {c: n + i for i, c in enumerate(inner)}
        self.pieces, self.other, self.pad = n, n + len(inner), n + len(inner) + 1
        self.radix = np.int64(self.pad + 1)
        self.symbol_of = np.full(0x110000, self.other, dtype=np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = s
        rank = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs = sorted((symbols[p[:k]] * int(self.radix) + symbols[p[k:]], rank[model.pieces[i].score], i)
                       for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair_keys, pair_ranks, pair_pieces = (np.array(x) for x in zip(*pairs))
        self.pair_ranks, self.pair_pieces = pair_ranks.astype(np.int32), pair_pieces.astype(np.int32)
        self.bits = int(8 * len(pairs)).bit_length()
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(pairs), dtype=np.int32)
        spot = self._spot(self.pair_keys)
        while len(left):  # open addressing: those that find their slot taken try the next one
            free = self.table[spot] < 0
            self.table[spot[free]] = left[free]
            lost = self.table[spot] != left
            left, spot = left[lost], (spot[lost] + 1) & (len(self.table) - 1)
        # Places where a text may be cut: before a run of marks, around line feeds and tabs.
        self.cuts_marks = all(MARK not in p.lstrip(MARK) for p in normal)
        if any(c in p for p in normal for c in "\n\t"):
            raise ValueError("this vocabulary merges across tabs or line feeds")
        self.keys = np.zeros(SLOTS, dtype=U64)
        self.lens = np.zeros(SLOTS, dtype=np.uint8)
        self.ids = np.zeros((SLOTS, WIDE), dtype=np.uint16 if self.pieces <= 1 << 16 else np.int32)

    @functools.cached_property
    def pair_of(self) -> dict[int, tuple[int, int]]:
        """Pairs by key, for the heaps of long segments."""
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_pieces.tolist())))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the concatenation of two symbols; NEVER where it is no piece."""
        key = (left.astype(np.int64) * self.radix + right).ravel()
        spot = self._spot(key)
        at = self.table[spot]
        open_ = np.flatnonzero((at >= 0) & (self.pair_keys[at] != key))
        while len(open_):
            spot[open_] = (spot[open_] + 1) & (len(self.table) - 1)
            at[open_] = self.table[spot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.pair_keys[at[open_]] != key[open_])]
        at = at.reshape(left.shape)
        return np.where(at >= 0, self.pair_ranks[at], NEVER), self.pair_pieces[at]

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(W.BASE)) >> U64(64 - self.bits)).astype(np.int64)

    def _together(self, symbols: np.ndarray) -> np.ndarray:
        """Merges the rows of a padded symbol table in place, one pair of each row a step; returns what is left."""
        n, wide = symbols.shape
        ranks = np.full((n, wide), NEVER, dtype=np.int32)
        ranks[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])[0]
        after = np.tile(np.arange(1, wide + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int16), (n, 1))
        live = symbols != self.pad
        rows = np.arange(n)
        while len(rows):
            open_ranks = ranks[rows]
            j = open_ranks.argmin(axis=1)  # the first of equal ranks
            some = open_ranks[np.arange(len(rows)), j] < NEVER
            rows, j = rows[some], j[some]
            k = after[rows, j].astype(np.int64)
            symbol = self._pairs(symbols[rows, j], symbols[rows, k])[1]
            symbols[rows, j] = symbol
            live[rows, k] = False
            ranks[rows, k] = NEVER
            # The last column is padding, so a live symbol always has a successor there.
            next_ = after[rows, k].astype(np.int64)
            inside = next_ < wide
            next_ = np.minimum(next_, wide - 1)
            after[rows, j] = np.where(inside, next_, wide)
            before[rows[inside], next_[inside]] = j[inside]
            ranks[rows, j] = np.where(inside, self._pairs(symbol, symbols[rows, next_])[0], NEVER)
            p = before[rows, j].astype(np.int64)
            has = p >= 0
            ranks[rows[has], p[has]] = self._pairs(symbols[rows[has], p[has]], symbol[has])[0]
        return live

    def _alone(self, symbols: list[int]) -> list[int]:
        """Positions and symbols that are left of one long segment, merged with a heap."""
        n, radix, pair_of = len(symbols), int(self.radix), self.pair_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def enter(a: int, b: int) -> None:
            found = pair_of.get(symbols[a] * radix + symbols[b])
            if found:
                heapq.heappush(heap, (found[0], a, symbols[a], b, symbols[b], found[1]))

        for a in range(n - 1):
            enter(a, a + 1)
        while heap:
            _, a, left, b, right, piece = heapq.heappop(heap)
            if symbols[a] != left or symbols[b] != right or after[a] != b:
                continue  # one of the two has been merged since
            symbols[a], symbols[b] = piece, -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                enter(a, after[a])
            if before[a] >= 0:
                enter(before[a], a)
        return symbols

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of segments whose spaces are marks already, and how many each has."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        first = np.cumsum(size) - size
        left = np.full(len(codes), -1, dtype=np.int32)  # symbols at the places where they start
        low = 0
        for wide in SHORT:
            rows = np.flatnonzero((size > low) & (size <= wide))
            low = wide
            if not len(rows):
                continue
            place = first[rows, None] + np.arange(wide + 1)
            inside = np.arange(wide + 1) < size[rows, None]
            table = np.full(place.shape, self.pad, dtype=np.int32)
            table[inside] = self.symbol_of[codes[place[inside]]]
            live = self._together(table)
            left[place[live]] = table[live]
        for row in np.flatnonzero(size > low).tolist():
            a = int(first[row])
            b = a + int(size[row])
            left[a:b] = self._alone(self.symbol_of[codes[a:b]].tolist())
        places = np.flatnonzero(left >= 0)
        symbols = left[places]
        owner = np.repeat(np.arange(len(segments)), size)[places]
        odd = np.flatnonzero(symbols >= self.pieces)
        if len(odd):  # characters that are no piece become their bytes
            raw = [chr(c).encode() for c in codes[places[odd]].tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[odd] = [len(r) for r in raw]
            at = np.cumsum(times) - times
            symbols, owner = np.repeat(symbols, times), np.repeat(owner, times)
            spots = np.repeat(at[odd], times[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
            symbols[spots] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return symbols, np.bincount(owner, minlength=len(segments))

    def _check_segments(self, segments: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        """One text for the library holds many segments, with a line feed before each; no merge crosses it."""
        asked = [segments[a:a + CHECKED] for a in range(0, len(segments), CHECKED)]
        theirs = self.library.encode(["\n" + "\n".join(x) for x in asked], num_threads=1)
        at, row = np.concatenate([[0], np.cumsum(lens)]), 0
        for some, ids in zip(asked, theirs):
            ours = np.insert(flat[at[row]:at[row + len(some)]], at[row + 1:row + len(some)] - at[row], self.byte_ids[10])
            if ours.tolist() != ids[2:]:  # after the mark and the first line feed
                raise ValueError(f"ids of {some[0][:200]!r} or of a segment after it differ from those of the library")
            row += len(some)

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(data), dtype=bool)
        if self.cuts_marks:
            space = data == 0x20
            start[1:] = space[1:] & ~space[:-1]
        bar = (data == 0x0A) | (data == 0x09)
        start |= bar
        start[1:] |= bar[:-1]
        opening = offsets[:-1][np.diff(offsets) > 0]
        start[opening] = True
        return np.flatnonzero(start), opening

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and the offset of each row in them (rows + 1 values)."""
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        starts, opening = self._segments(data, offsets)
        ends = np.append(starts[1:], len(data))
        opens = np.isin(starts, opening, assume_unique=True)
        h = W.hash_words(data, starts, ends) ^ np.where(opens, U64(0x5851F42D4C957F2D), U64(0))
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == h
        miss = np.flatnonzero(~hit)
        lens = self.lens[slot].astype(np.int64)
        if len(miss):
            values, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where, raw = miss[one], data.tobytes()
            segments = [(MARK if first else "") + raw[s:e].decode().replace(" ", MARK)
                        for s, e, first in zip(starts[where].tolist(), ends[where].tolist(), opens[where].tolist())]
            new_flat, new_lens = self.encode_segments(segments)
            self._check_segments(segments, new_flat, new_lens)
            lens[miss] = new_lens[back]
        at = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(at[-1], dtype=np.int32)
        for j in range(WIDE):
            some = np.flatnonzero(hit & (lens > j))
            if not len(some):
                break
            out[at[some] + j] = self.ids[slot[some], j]
        if len(miss):
            new_at = np.concatenate([[0], np.cumsum(new_lens)])
            m = lens[miss]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(at[miss], m) + inner] = new_flat[np.repeat(new_at[back], m) + inner]
            # Of new segments that share a slot only the first is kept.
            _, short = np.unique(np.where(new_lens <= WIDE, slot[where], -1), return_index=True)
            short = short[new_lens[short] <= WIDE]
            into = slot[where[short]]
            for j in range(WIDE):
                has = new_lens[short] > j
                self.ids[into[has], j] = new_flat[new_at[short[has]] + j]
            self.lens[into] = new_lens[short]
            self.keys[into] = values[short]
        return out, at[np.searchsorted(starts, offsets)]


def piece_ids(name: str) -> PieceIds:
    path = tokenizer_path(name)
    return W.kept(f"piece_ids:{path}", lambda: PieceIds(path))


def piece_texts(name: str) -> PieceTexts:
    path = tokenizer_path(name)
    return W.kept(f"piece_texts:{path}", lambda: PieceTexts(path))


def _with_ends(flat: np.ndarray, at: np.ndarray, begin: list[int], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
    rows, more = len(at) - 1, len(begin) + len(end)
    out_at = at + more * np.arange(rows + 1)
    out = np.empty(out_at[-1], dtype=np.int32)
    out[np.arange(len(flat)) + np.repeat(more * np.arange(rows) + len(begin), np.diff(at))] = flat
    for i, x in enumerate(begin):
        out[out_at[:-1] + i] = x
    for i, x in enumerate(end):
        out[out_at[1:] - len(end) + i] = x
    return out, out_at


def _encoder(vocabulary: str, begin: bool, end: bool):
    """From batches (doc_id, text) to batches (doc_id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = piece_ids(vocabulary)
        ends = [vocab.begin] if begin else [], [vocab.end] if end else []
        for batch in batches:
            checked = False
            for a, b, data, offsets in column_runs(batch.column(1)):
                flat, at = _marked(vocab, data, offsets)
                if not checked and len(data):
                    row = int(np.flatnonzero(np.diff(offsets))[0])
                    text = data[offsets[row]:offsets[row + 1]].tobytes().decode()
                    if vocab.library.encode(text) != flat[at[row]:at[row + 1]].tolist():
                        raise ValueError(f"ids of {text[:200]!r} differ from those of the library")
                    checked = True
                flat, at = _with_ends(flat, at, *ends)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 4).astype(np.int32)),
                                                                   pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), packed],
                                                 ["doc_id", "n_tokens", "ids"])

    return run


def _decoder(vocabulary: str, kept: list[str]):
    """From batches with ``ids`` to batches of the columns ``kept`` and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = piece_texts(vocabulary)
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
            data = column.buffers()[2]
            for a, b in W.runs_of_rows(at):
                ids = np.frombuffer(data, dtype=np.uint8)[at[a]:at[b]].view("<u4").astype(np.int64) if data else np.zeros(0, np.int64)
                offsets = (at[a:b + 1] - at[a]) // 4
                texts = vocab.decode(ids, offsets)
                plain = ids.tolist()
                if texts != vocab.library.decode([plain[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]):
                    raise ValueError("a decoded text differs from that of the library")
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], pa.array(texts, pa.string())],
                                                 [*kept, "decoded"])

    return run


def _marked(vocab: PieceIds, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows; the space mark in a text is a space to the vocabulary, so it is written as one first."""
    if len(data) > 2 and bool(((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any()):
        rows = [data[a:b].tobytes().replace(MARK_BYTES, b" ") for a, b in zip(offsets[:-1], offsets[1:])]
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return vocab.encode(data, offsets)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs`` (doc_id, text): the ids of the whole text.

    ``ids`` holds little-endian unsigned 32-bit integers, as `sentencepiece` gives them without sampling; ``n_tokens``
    counts them, the begin and end ids included where asked for. Null texts are empty texts, whose ids are the begin
    and end ids alone. Texts of any length, repeated rows and null ids are rows like others; other columns are
    ignored; an empty table gives an empty result. A text that holds the space mark U+2581 gets the ids of a space.
    """
    return _read(docs).mapInArrow(_encoder(vocabulary, begin, end), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """The columns of ``encoded`` with ``decoded`` (replaced if there): the text that its ``ids`` stand for.

    ``ids`` (binary, as `encode` gives them) may be any ids of the vocabulary; begin and end ids are no text, a run
    of byte ids that is no UTF-8 becomes replacement characters. Null and empty ids give an empty text.
    """
    kept = [f for f in encoded.schema.fields if f.name.lower() != "decoded"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]
    return encoded.select(*names).mapInArrow(_decoder(vocabulary, names), f"{fields}, decoded string")


def encode_and_decode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", begin: bool = True, end: bool = True) -> DataFrame:
    """`decode` of `encode` of ``docs``, in one pass: (doc_id, n_tokens, ids, decoded)."""
    first, second = _encoder(vocabulary, begin, end), _decoder(vocabulary, ["doc_id", "n_tokens", "ids"])
    return _read(docs).mapInArrow(lambda batches: second(first(batches)), "doc_id long, n_tokens long, ids binary, decoded string")


def ids_as_arrays(encoded: DataFrame) -> DataFrame:
    """The columns of ``encoded`` with ``ids`` as arrays of integers."""
    kept = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
            data = column.buffers()[2]
            ids = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]].view("<i4") if data else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(((at - at[0]) // 4).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([lists if c == "ids" else batch.column(c) for c in kept], kept)

    fields = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, fields)
