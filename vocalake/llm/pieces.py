"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words: runs of the white-space mark with what follows. No piece crosses the
start of such a run, so that each distinct word of a batch is encoded once. The distinct words are
sorted, which lists the leaves of their trie depth-first; the forward state of a prefix is kept
while the words that follow share it.

A unigram model keeps the best sum of piece scores per prefix. A BPE model keeps the one piece that
can end the prefix: a segmentation is what the merges produce if and only if each pair of neighbours
is what the merges produce from the pair, so that one piece per prefix survives and the result equals
that of the merges. Characters without a piece become their bytes.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalake.llm.common import mapped, regrouped

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_UNIGRAM, _BPE = 1, 2
#: Pairs whose test is remembered (some 100 bytes each); the memory is emptied beyond it.
_PAIRS = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def _model_type(data: bytes) -> int:
    trainer = next((x for k, x in _fields(data) if k == 2), b"")
    return next((x for k, x in _fields(trainer) if k == 3), _UNIGRAM)


class Lattice:
    """Segments words by a table of pieces (text -> id) and their scores.

    Pieces that may still grow are followed through a trie of the pieces, from each place of the word
    where one started; those places and trie nodes are part of a prefix's state. unknown is the id
    that stands for a character without a piece.
    """

    def __init__(self, ids: dict[str, int], score: dict[str, float], merges: bool, unknown: int = -1):
        self.ids, self.score, self.merges, self.unknown = ids, score, merges, unknown
        self.penalty = min(score.values(), default=0.0) - 10.0
        self.names = {k: p for p, k in ids.items()}
        self.by_id = {k: score[p] for p, k in ids.items()}
        self.pairs: dict[int, bool] = {}
        #: first character -> (id or None, next character -> ... or None)
        self.trie = self._grown(sorted(ids), 0)

    def _grown(self, pieces: list[str], depth: int) -> dict:
        """The trie of sorted pieces that agree in their first `depth` characters and are longer."""
        nodes: dict = {}
        for ch, group in groupby(pieces, key=lambda p: p[depth]):
            own = list(group)
            whole = self.ids[own[0]] if len(own[0]) == depth + 1 else None
            rest = own[1:] if whole is not None else own
            nodes[ch] = (whole, self._grown(rest, depth + 1) if rest else None)
        return nodes

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: again and again the best-scored pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these pieces side by side; left is -1 where nothing can merge from the left."""
        a, b = self.names.get(left, ""), self.names[right]
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        self.pairs[(left + 1) << 32 | right] = fits = self.merged(a + b) == ([a, b] if a else [b])
        return fits

    def segment(self, words: list[str]) -> tuple[list[int], list[int], list[str]]:
        """Words in sorted order to (ids of all pieces, pieces per word, the characters that `unknown` stands for, in order)."""
        root, pairs, unknown, merges, scores = self.trie, self.pairs, self.unknown, self.merges, self.by_id
        flat, sizes, strange = [], [], []
        # by prefix length: id of the piece that ends the prefix, where it starts, forward score, growing pieces
        last, begin, best, growing = [-1], [0], [0.0], [[]]
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            keep = same + 1
            del last[keep:], begin[keep:], best[keep:], growing[keep:]
            for end in range(same, len(word)):
                ch = word[end]
                grown, found, at, top = [], unknown, end, None
                active = growing[end]
                active.append((end, root))
                for start, nodes in active:
                    if ch not in nodes:
                        continue
                    piece, nodes = nodes[ch]
                    if nodes is not None:
                        grown.append((start, nodes))
                    if piece is None:
                        continue
                    if merges:
                        if top is None:
                            fits = pairs.get((last[start] + 1) << 32 | piece)
                            if fits or fits is None and self._fits(last[start], piece):
                                found, at, top = piece, start, 0.0
                    elif top is None or best[start] + scores[piece] > top:
                        found, at, top = piece, start, best[start] + scores[piece]
                active.pop()
                if top is None or not merges and (ch not in root or root[ch][0] is None) and best[end] + self.penalty > top:
                    found, at, top = unknown, end, best[end] + self.penalty
                last.append(found)
                begin.append(at)
                best.append(top)
                growing.append(grown)
            before = word
            own, end = [], len(word)
            while end:
                own.append(last[end])
                if last[end] == unknown:
                    strange.append(word[end - 1])
                end = begin[end]
            own.reverse()
            flat += own
            sizes.append(len(own))
            if unknown in own:
                k = own.count(unknown)
                strange[-k:] = reversed(strange[-k:])
        return flat, sizes, strange


class Codec:
    """Encodes and decodes with a model file's pieces and its own normalisation."""

    def __init__(self, data: bytes):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n, self.unk = sp.get_piece_size(), sp.unk_id()
        special = [sp.is_unknown(k) or sp.is_control(k) or sp.is_byte(k) or sp.is_unused(k) for k in range(n)]
        names = [sp.id_to_piece(k) for k in range(n)]
        own = {name: k for k, name in enumerate(names) if not special[k]}
        self.byte = {int(names[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        kind = _model_type(data)
        if kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models can be read")
        self.lattice = Lattice(own, {p: sp.get_score(k) for p, k in own.items()}, kind == _BPE)
        self.raw = [bytes([int(names[k][3:5], 16)]) if sp.is_byte(k) else b" \xe2\x81\x87 " if k == self.unk else b"" if special[k] else names[k].encode() for k in range(n)]
        self.pieces = pa.array(self.raw, pa.binary())

    def _spelled(self, flat: list[int], sizes: list[int], strange: list[str]) -> tuple[list[int], list[int]]:
        """The ids with bytes, or one unknown id for a run, in place of characters without a piece."""
        out, counts, at, chars = [], [], 0, iter(strange)
        for size in sizes:
            start = len(out)
            for k in flat[at : at + size]:
                if k >= 0:
                    out.append(k)
                    continue
                ch = next(chars)
                if self.byte:
                    out += [self.byte[b] for b in ch.encode()]
                elif len(out) == start or out[-1] != self.unk:
                    out.append(self.unk)
            counts.append(len(out) - start)
            at += size
        return out, counts

    def _units(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(unit numbers of all texts, the distinct units, units per text)."""
        normal = [self.processor.normalize(t) if t else "" for t in texts]
        marked = (n == (MARK + t.replace(" ", MARK) if t else "") and MARK not in t for n, t in zip(normal, texts, strict=True))
        plain = np.array([ok and not (t[:1] == " " or t[-1:] == " " or "  " in t) for ok, t in zip(marked, texts, strict=True)], dtype=bool)
        # words between single blanks are split and numbered by Arrow; other texts unit by unit
        split = pc.split_pattern(pa.array([t if ok and t else None for t, ok in zip(texts, plain, strict=True)], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = [MARK + w for w in coded.dictionary.to_pylist()]
        number = dict(zip(words, range(len(words)), strict=True))
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fast, at, parts = coded.indices.to_numpy(zero_copy_only=False), 0, []
        for k, text in enumerate(normal):
            if plain[k]:
                parts.append(fast[at : at + counts[k]])
                at += counts[k]
            else:
                units = _UNITS.findall(text)
                counts[k] = len(units)
                parts.append(np.array([number.setdefault(u, len(number)) for u in units], dtype=np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), list(number), counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text), each distinct unit segmented once."""
        rows, units, counts = self._units(texts)
        order = np.array(sorted(range(len(units)), key=units.__getitem__), dtype=np.int64)
        words = [units[k] for k in order.tolist()]
        collects = gc.isenabled()
        gc.disable()  # the states hold no cycles, and scanning them again and again takes half of the time
        try:
            flat, sizes, strange = self.lattice.segment(words)
        finally:
            if collects:
                gc.enable()
        if strange:
            flat, sizes = self._spelled(flat, sizes, strange)
        ids = np.array(flat, dtype=np.int32)
        ends = np.cumsum(np.array(sizes, dtype=np.int64))
        size, start = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        size[order], start[order] = sizes, ends - np.array(sizes, dtype=np.int64)
        own = size[rows]
        until = np.cumsum(own)
        total = int(until[-1]) if len(own) else 0
        tokens = ids[np.repeat(start[rows] - (until - own), own) + np.arange(total)]
        per_text = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=own, minlength=len(texts)).astype(np.int64)
        return tokens, per_text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        tokens, sizes = self.encode_all(texts)
        return np.split(tokens, np.cumsum(sizes)[:-1]) if texts else []

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, without the mark that encoding puts in front."""
        ids = np.fromiter(ids, dtype=np.int64)
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of runs of ids, of those sizes; an id that the model doesn't have counts as unknown."""
        known = np.where((ids >= 0) & (ids < len(self.raw)), ids, self.unk)
        spelled = self.pieces.take(pa.array(known))
        data, at = spelled.buffers()[2], np.frombuffer(spelled.buffers()[1], dtype=np.int32, count=len(spelled) + 1)
        borders = at[np.r_[0, np.cumsum(sizes)]].tolist()
        whole = data.to_pybytes() if data else b""
        return [whole[a:b].decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ") for a, b in zip(borders, borders[1:], strict=False)]


_CODECS: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """A worker's codec for the model, built once."""
    key = hash(data)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


#: Bytes of text encoded together; memory grows with their distinct words.
TOGETHER = 8 << 20


def decoded(rows: DataFrame, ids: str = "token_ids", to: str = "decoded", model: bytes | None = None) -> DataFrame:
    """rows' columns, then the text of the ids.

    Null and empty lists give the empty text. Null elements are passed over; an id that the model
    doesn't have, negative ones included, is decoded as the unknown one. Rows are decoded each for
    itself; an empty table gives an empty table. A ValueError says that rows has a column `to`.
    """
    if to.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"rows has a column {to}")
    data = model or read_model()
    at, schema = rows.columns.index(ids), T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data)
        for batch in source:
            lists = batch.column(at)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(row[there], minlength=batch.num_rows)
            texts = own.decode_all(flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return mapped(rows, batches, schema)


def encoded(docs: DataFrame, text: str = "text", model: bytes | None = None, prefix: str = "") -> DataFrame:
    """docs' columns, then token_ids array<int>, n_tokens long and lossless boolean (the ids, decoded, give the text).

    Null and empty texts have no token; a null text is lossless if decoded as empty. Texts that hold
    the white-space mark itself, or what the model's normalisation changes, are not lossless. Rows are
    encoded each for itself; texts are encoded whole, a very long one alone. An empty table gives an
    empty table. The new columns take `prefix` where docs has columns of their names. The model's bytes
    (about 0.5 MB) go with the tasks.
    """
    data = model or read_model()
    names = [prefix + n for n in ("token_ids", "n_tokens", "lossless")]
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {sorted(clash)}; give a prefix")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])
    at = docs.columns.index(text)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data)
        for batch in regrouped(source, at, TOGETHER):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            tokens, sizes = own.encode_all(texts)
            same = [a == b for a, b in zip(own.decode_all(tokens, sizes), texts, strict=True)]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(sizes), pa.array(same, pa.bool_())], [*batch.schema.names, *names])

    return mapped(docs, batches, schema)
