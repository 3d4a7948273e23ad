"""SentencePiece encoding and decoding with original byte spans.

The model file is read directly: vocabulary, normaliser settings and the
compiled character map (a double-array trie followed by NUL-ended
replacement strings).  ``Normalizer`` applies the map by longest prefix and
records, for each byte of the normalised text, the byte of the source it came
from; every piece is projected through that alignment to a source byte span.

Pieces are merged by the sentencepiece library, one *segment* at a time.  A
segment ends where no vocabulary piece can reach across (before a run of
spaces, around a line feed), so the pieces of a text are the pieces of its
segments; results are cached by segment.  Models whose vocabulary crosses
these borders are encoded as one segment per text.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
CACHE_SEGMENTS, CACHE_CHARS = 250_000, 8_000_000  # the cache starts anew beyond either
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[i:i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, buf[i:i + n]
            i += n


class CharMap:
    """The compiled character map: longest source prefix -> replacement."""

    def __init__(self, blob: bytes):
        self.units, self.targets = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.targets = blob[4 + size:]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest entry at ``at``."""
        units, found = self.units, None
        node = int(units[0])
        pos = (node >> 10) << ((node & 512) >> 6)
        for i in range(at, len(data)):
            pos ^= data[i]
            if pos >= len(units):
                break
            node = int(units[pos])
            if node & 0x800000FF != data[i]:
                break
            pos ^= (node >> 10) << ((node & 512) >> 6)
            if node >> 8 & 1:
                found = int(units[pos]) & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.targets[start:self.targets.index(b"\0", start)], found[1]


class Normalizer:
    """Normalised bytes plus, per byte (and one past the end), its source offset."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map = CharMap(charsmap)
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape

    @property
    def plain(self) -> bool:
        """True if only blanks change (no map, no squeezing)."""
        return not self.map and self.dummy_prefix and not self.squeeze and self.escape

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        hit = self.map.longest(data, at) if self.map else None
        if hit:
            return hit
        b = data[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return data[at:at + n], n

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        data = text.encode()
        blank = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def put(piece: bytes, source: int):
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.squeeze:
            while at < len(data):
                piece, n = self._prefix(data, at)
                if piece != b" ":
                    break
                at += n
        if at == len(data):
            return b"", [at]
        if self.dummy_prefix:
            put(blank, at)
        after_blank = self.squeeze
        while at < len(data):
            piece, n = self._prefix(data, at)
            if after_blank:
                piece = piece.lstrip(b" ")
            for k, part in enumerate(piece.split(b" ")):
                if k:
                    put(blank, at)
                # a replacement maps to its whole source; a copied character keeps its bytes
                if part == data[at:at + n]:
                    out.extend(part)
                    align.extend(range(at, at + n))
                else:
                    put(part, at)
            if piece:
                after_blank = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(blank):
                del out[-len(blank):]
                at = align[len(out)]
                del align[len(out):]
        return bytes(out), align + [at]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        pieces, norm = [], {}
        for field, value in _fields(blob):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(3, NORMAL)))
            elif field == 3:
                norm = dict(_fields(value))
        self.norm = Normalizer(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kinds = [k for _, k in pieces]
        mergeable = [p for p, k in pieces if k in (NORMAL, USER)]
        self.cut = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in mergeable)
        self.byte_ids = any(k == BYTE for k in self.kinds)
        self.surface = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN
                        else bytes([int(p[3:5], 16)]) if k == BYTE
                        else p.replace(SPACE, " ").encode() for p, k in pieces]
        self.widths = [len(x) for x in self.surface]
        self.segment = re.compile(f"[ {SPACE}]*[^ {SPACE}\\n]+|\\n|[ {SPACE}]+")
        # "\n" is no part of any piece, so pieces behind it are those of the segment alone
        self.lead = self.sp.encode("\n") if self.cut and self.byte_ids else None
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.ids, self.sizes, self.lens = array("i"), array("i"), array("q")
        self.chars = 0

    def _learn(self, segs: list[str]) -> None:
        """Store ids and source byte lengths of the pieces of new raw segments."""
        widths, kinds, lead, mark = self.widths, self.kinds, len(self.lead), SPACE
        for seg in segs:
            ids = self.sp.encode("\n" + seg.replace(" ", SPACE))[lead:]
            if mark in seg:  # a blank of a piece may be one or three source bytes
                raw, at, sizes = seg.encode(), 0, []
                for pid in ids:
                    n = 1 if kinds[pid] == BYTE else self._width(raw, at, self.surface[pid])
                    sizes.append(n)
                    at += n
            else:
                sizes = [widths[pid] for pid in ids]
            self.index[seg] = len(self.lens)
            self.ids.extend(ids)
            self.sizes.extend(sizes)
            self.lens.append(len(ids))
            self.chars += len(seg)

    @staticmethod
    def _width(raw: bytes, at: int, surface: bytes) -> int:
        """Source bytes at ``at`` that ``surface`` stands for (a blank may be U+2581)."""
        start, mark = at, SPACE.encode()
        for b in surface:
            at += 3 if b == 32 and raw[at:at + 3] == mark else 1
        return at - start

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, flat source lengths and the number of ids of each text."""
        if len(self.index) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self._reset()
        index, counts, order = self.index, [], []
        for text in texts:
            segs = self.segment.findall(" " + text) if text else []
            new = set(segs).difference(index)
            if new:
                self._learn(list(new))
            order.append([index[s] for s in segs])
            counts.append(len(segs))
        flat = np.fromiter(chain.from_iterable(order), np.int64, sum(counts))
        lens, table_ids, table_sizes = (np.array(x) for x in (self.lens, self.ids, self.sizes))
        starts = np.cumsum(lens) - lens
        n = lens[flat]
        take = np.repeat(starts[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bounds = np.concatenate([[0], np.cumsum(n)])
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        per_text = np.diff(bounds[edges])
        return table_ids[take], table_sizes[take], per_text

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text; spans are byte offsets in the source."""
        if self.norm.plain and self.lead and len(self.lead) == 2:
            ids, sizes, n = self.encode_plain(texts)
            out, at = [], 0
            for k in n:
                ends = np.cumsum(sizes[at:at + k], dtype=np.int64)
                begins = ends - sizes[at:at + k]
                # the added blank in front has no source byte
                out.append((ids[at:at + k], np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)))
                at += k
            return out
        return [self._encode_mapped(t) for t in texts]

    def _encode_mapped(self, text: str):
        norm, align = self.norm(text)
        ids, begins, ends, at = [], [], [], 0
        for pid, piece in zip(self.sp.encode(text), self.sp.encode(text, out_type=str)):
            n = 1 if self.kinds[pid] == BYTE else len(piece.encode())
            ids.append(pid)
            begins.append(align[at])
            at += n
            # bytes of one replacement share a source start: the span ends where the next source starts
            stop = at
            while stop < len(norm) and align[stop] == align[at - 1]:
                stop += 1
            ends.append(align[stop] if stop < len(align) else align[-1])
        if at != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        return np.array(ids, np.int32), np.array(begins, np.int64), np.array(ends, np.int64)

    def decode(self, ids) -> str:
        """The text of the pieces: blanks restored, byte pieces joined, the
        added blank in front removed, undecodable bytes as U+FFFD."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        if self.norm.dummy_prefix and raw[:1] == b" " and len(ids) and self.kinds[ids[0]] not in (BYTE, UNKNOWN):
            raw = raw[1:]
        return raw.decode(errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", rows: int = 256) -> DataFrame:
    """``docs`` with ``_pieces``: struct(ids, begins, ends, decoded).

    ``begins``/``ends`` are byte offsets in the UTF-8 of the original text.
    A null or empty text has no ids and decodes to ''.  Every text is encoded
    whole; nothing is shuffled.  Texts of one Arrow batch are taken ``rows``
    at a time so that the piece arrays in memory stay bounded.
    """
    def run(texts: pa.Array) -> pa.Array:
        c = codec(model_path)
        parts = []
        values = texts.to_pylist()
        for at in range(0, len(values), rows):
            done = c.encode([t or "" for t in values[at:at + rows]])
            offs = np.concatenate([[0], np.cumsum([len(x[0]) for x in done])]).astype(np.int32)

            def col(k, kind):
                flat = np.concatenate([x[k] for x in done]).astype(kind) if done else np.zeros(0, kind)
                return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))

            decoded = pa.array([c.decode(x[0].tolist()) for x in done], pa.string())
            parts.append(pa.StructArray.from_arrays(
                [col(0, np.int32), col(1, np.int32), col(2, np.int32), decoded],
                names=["ids", "begins", "ends", "decoded"]))
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())),
                          ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])
        return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                         T.StructField("begins", T.ArrayType(T.IntegerType())),
                         T.StructField("ends", T.ArrayType(T.IntegerType())),
                         T.StructField("decoded", T.StringType())])
    return docs.withColumn("_pieces", F.arrow_udf(run, kind)(F.col(text_col).cast("string")))


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Digest columns of :func:`encode_decode`: ``n_tokens``, ``ids_sha256``
    (decimal ids joined by commas), ``decoded_sha256`` and ``covered_bytes``
    (source bytes under the spans)."""
    p = F.col("_pieces")
    n = F.size(p["ids"])
    return encoded.select(
        *keep,
        n.cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", p["ids"].cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(p["decoded"], 256).alias("decoded_sha256"),
        F.when(n > 0, F.element_at(p["ends"], -1) - F.element_at(p["begins"], 1)).otherwise(0)
         .cast("long").alias("covered_bytes"))
