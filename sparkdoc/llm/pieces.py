"""SentencePiece encoding that keeps byte offsets, and decoding.

``Normalizer`` reads the model's compiled character map: a double-array trie whose leaves point into a table of
replacements. At each place the longest prefix that the trie knows is replaced, and for every normalised byte the
offset of the original byte it came from is noted. ``Encoder`` segments the normalised text and projects every piece
through that alignment to a span of original bytes.

Segmentation: byte-pair merges can't cross a border between a non-space symbol and the space mark that follows it
when no piece has the mark after another symbol, nor one before a line feed when no piece has a line feed (both checked
from the model; one that has such pieces is segmented as a whole). So the text is cut there and each chunk is segmented
once by the sentencepiece library and remembered, which gives the library's ids on the whole text. ``MEMORY`` bounds the
remembered chunks; a chunk of over ``LONG`` characters isn't remembered. Whole texts are encoded, of any length.

Where the map is empty a batch's texts are normalised, aligned and projected together in numpy (``Encoder.batch``);
else one by one (``Encoder.spans``). Either way the decoded text is the library's ``decode`` of the ids.

Defined cases: null is the empty text, which has no pieces but the end id; repeated ids and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import pieces

MARK = "▁"
MEMORY = 400_000
LONG = 200
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


class CharsMap:
    """The compiled character map: uint32 size of the trie, the trie's units, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.table = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes used) of the longest known prefix of data[at:]."""
        units, best = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        return self.table[best[0] : self.table.index(b"\0", best[0])], best[1]


def _offset(unit: int) -> int:
    """Where a double-array unit's children begin, relative to it."""
    return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    def __init__(self, spec, suffix: bool = False) -> None:
        self.map = CharsMap(spec.precompiled_charsmap)
        self.identity = not spec.precompiled_charsmap
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.mark = MARK.encode() if self.escape else b" "

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        if found := self.map.longest(data, at):
            return found
        n = 1 if data[at] < 0x80 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4
        return data[at : at + n], n

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, align): normalised byte i came from original byte align[i]; the last is the end."""
        data = text.encode("utf-8", "replace")
        if self.identity and not self.squeeze and not self.suffix:
            return self._plain(data)
        out, align, at = bytearray(), [], 0
        if self.squeeze:  # leading space goes
            while at < len(data):
                put, used = self._next(data, at)
                if put != b" ":
                    break
                at += used
        if at == len(data):
            return b"", np.array([at])

        def add(put: bytes, place: int) -> None:
            out.extend(put)
            align.extend([place] * len(put))

        if self.prefix and not self.suffix:
            add(self.mark, at)
        after_space = self.squeeze
        while at < len(data):
            put, used = self._next(data, at)
            if after_space:
                put = put.lstrip(b" ")
            if put:
                for byte in put:
                    add(self.mark if byte == 32 else bytes([byte]), at)
                after_space = put.endswith(b" ")
            at += used
            if not self.squeeze:
                after_space = False
        end = at
        if self.squeeze:
            while out.endswith(self.mark):
                end = align[len(out) - len(self.mark)]
                del out[-len(self.mark) :], align[-len(self.mark) :]
        if self.prefix and self.suffix:
            add(self.mark, end)
        return bytes(out), np.array([*align, end])

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map each byte stays; a space becomes the mark."""
        if not data:
            return b"", np.zeros(1, np.int64)
        width = np.where(np.frombuffer(data, np.uint8) == 32, len(self.mark), 1)
        align = np.repeat(np.arange(len(data)), width)
        out = data.replace(b" ", self.mark)
        if self.prefix:
            out, align = self.mark + out, np.concatenate([np.zeros(len(self.mark), np.int64), align])
        return out, np.append(align, len(data))


    def sources(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first) without a map, for many texts: normalised byte i comes from the character at bytes begin[i] to end[i].

        Text t has the normalised bytes first[t] to first[t + 1]. The added mark comes from no byte of its text's begin.
        """
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        char = np.cumsum(lead) - 1
        wide = len(self.mark)
        times = np.where(data == 32, wide, 1)
        full = np.flatnonzero(np.diff(bounds)) if self.prefix else np.zeros(0, np.int64)
        times[bounds[full]] += wide
        first = np.concatenate([[0], np.cumsum(times)])[bounds]
        begin, end = np.repeat(at[char], times), np.repeat(np.append(at[1:], len(data))[char], times)
        for i in range(wide if len(full) else 0):
            begin[first[full] + i] = end[first[full] + i] = bounds[full]
        return begin, end, first


class Encoder:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.end = self.library.eos_id()
        self.types = [p.type for p in proto.pieces]
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.encode() for p in proto.pieces]
        self.widths = np.array([len(x) if t != _UNKNOWN else 1 << 40 for x, t in zip(self.surface, self.types, strict=True)])
        self.decimal = [str(i) for i in range(len(self.types))]
        self.mark_id = self.library.piece_to_id(MARK)
        spec = proto.normalizer_spec
        self.plain = self.normalizer.identity and not spec.remove_extra_whitespaces and not self.normalizer.suffix and self.normalizer.escape
        normal = [p.piece for p in proto.pieces if p.type not in (_UNKNOWN, _BYTE)]
        self.cut = self.plain and not any(MARK in p.lstrip(MARK) or "\n" in p for p in normal) and spec.add_dummy_prefix and proto.trainer_spec.byte_fallback and self.types[self.mark_id] == _NORMAL and proto.trainer_spec.model_type == 2
        self.chunks: dict[str, bytes] = {}  # a chunk's ids, four bytes each
        self.pattern = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Segments chunks; one that begins with a line feed has no mark, the others are named without their first."""
        found = {}
        for chunk, ids in zip(missing, self.library.encode(missing, num_threads=1), strict=True):
            ids = ids[1:] if chunk[:1] == "\n" else ids or [self.mark_id]
            found[chunk] = np.array(ids, np.int32).tobytes()
        return found

    def _names(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return [x[x[0] == MARK :] for x in self.pattern.findall(MARK + text.replace(" ", MARK))]
        return text.replace("\n", " \n").split(" ")

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids, without the end id."""
        if not self.cut:
            return [np.array(x, np.int32) for x in self.library.encode([x or "" for x in texts], num_threads=1)]
        named = [self._names(x or "") for x in texts]
        known = self.chunks
        missing = list({x for names in named for x in names if x not in known})
        if len(known) + len(missing) > MEMORY:
            self.chunks = known = {}
            missing = list({x for names in named for x in names})
        if missing:
            known.update(self._learn(missing))
        out = [np.frombuffer(b"".join([known[x] for x in names]), np.int32) for names in named]
        for x in missing:
            if len(x) > LONG:
                del known[x]
        return out

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        return self.ids([text])[0].tolist() + [self.end] * end

    def batch(self, column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(ids by text, starts, ends): the spans of all pieces, text after text, in the bytes of their texts."""
        texts = column.to_pylist()
        if not self.plain:
            found = [self.spans(x) for x in texts]
            spans = np.concatenate([np.zeros((0, 2), np.int64), *(x[1] for x in found)])
            return [np.array(x[0], np.int32) for x in found], spans[:, 0], spans[:, 1]
        ids = self.ids(texts)
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        starts, ends = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        stop = np.cumsum(self.widths[flat])
        piece = np.concatenate([[0], np.cumsum(counts)])
        for i, j, data, bounds in pieces(column):
            begin, end, first = self.normalizer.sources(data, bounds)
            a, b = piece[i], piece[j]
            if a == b:
                continue
            base = np.append(0, stop)[piece[i:j]]
            text = np.repeat(np.arange(j - i), counts[i:j])
            to = stop[a:b] - base[text]
            low = to - self.widths[flat[a:b]] + first[text]
            spelled = np.append(0, stop)[piece[i + 1 : j + 1]] - base == np.diff(first)
            ok = spelled[text]  # else a piece stands for bytes that it doesn't spell
            at = np.flatnonzero(ok)
            starts[a + at] = begin[low[at]] - bounds[text[at]]
            ends[a + at] = end[to[at] + first[text[at]] - 1] - bounds[text[at]]
            for t in np.flatnonzero(~spelled):
                starts[piece[i + t] : piece[i + t + 1]], ends[piece[i + t] : piece[i + t + 1]] = self.spans(texts[i + t])[1].T
        return ids, starts, ends

    def spans(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """(ids without the end id, spans): row i is the [start, end) of piece i in the text's UTF-8 bytes.

        A piece that has only the added mark has an empty span. Pieces of one character's bytes share its span.
        """
        text = text or ""
        ids = self.encode(text, False)
        normal, align = self.normalizer(text)
        widths = np.array([len(self.surface[i]) for i in ids], np.int64)
        if any(self.types[i] == _UNKNOWN for i in ids) or widths.sum() != len(normal):  # unknown pieces are as long as the library says
            found = self.library.encode(text, return_type="proto").pieces
            widths = np.array([len(p.piece.encode()) if self.types[p.id] != _BYTE else 1 for p in found], np.int64)
        stop = np.cumsum(widths)
        start = stop - widths
        # a piece ends where the original character of its last byte ends
        begin, last = align[start], align[np.maximum(stop - 1, start)]
        lead = (np.frombuffer(normal + b"\0", np.uint8) & 0xC0) != 0x80
        after = np.searchsorted(align, last, "right")
        after = np.minimum(after, len(align) - 1)
        nxt = np.flatnonzero(lead)
        whole = nxt[np.searchsorted(nxt, np.minimum(stop, len(normal)))] if len(ids) else stop
        finish = np.where(stop == whole, align[np.minimum(stop, len(align) - 1)], align[np.minimum(np.maximum(after, whole), len(align) - 1)])
        back = nxt[np.searchsorted(nxt, start, "right") - 1] if len(ids) else start
        return ids, np.stack([align[back] if len(ids) else begin, finish], 1) if len(ids) else np.zeros((0, 2), np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """A Python worker's encoder of the model; it stays from task to task, and only the last model's is held."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(model)
    return _ENCODERS[name]


def _digests(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
    """The digests of what ``_spans`` gives: each text is normalised, aligned, projected and decoded from its ids."""
    full = _spans(batch, encoder)
    every, bounds, decimal = full.column(1).flatten().to_pylist(), full.column(1).offsets.to_numpy(), encoder.decimal
    ids = [hashlib.sha256(" ".join([decimal[i] for i in every[a:b]]).encode()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    texts = [hashlib.sha256(x.encode()).hexdigest() for x in full.column(4).to_pylist()]
    return pa.record_batch([batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _spans(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
    ids, starts, ends = encoder.batch(batch.column(1))
    count = np.array([len(x) for x in ids], np.int64)
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
    closed = np.insert(np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum(count), encoder.end)
    decoded = encoder.decode([x.tolist() for x in ids])
    return pa.record_batch([batch.column(0), lists(count + 1, pa.array(closed, pa.int32())), lists(count, pa.array(starts)), lists(count, pa.array(ends)), pa.array(decoded, pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])


def _mapped(docs: DataFrame, model_path: str, make, schema: str, id_col: str, text_col: str) -> DataFrame:
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one file, whose size the corpus doesn't change

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield make(batch.slice(i, 256), encoder)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids (with the end id), starts and ends of the pieces in the text's bytes, and the decoded text."""
    return _mapped(docs, model_path, _spans, "ids array<int>, starts array<bigint>, ends array<bigint>, decoded string", id_col, text_col)


def encoded_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256 of what ``encoded`` gives, without the ids themselves."""
    return _mapped(docs, model_path, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
