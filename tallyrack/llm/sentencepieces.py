"""SentencePiece encoding with the source span of every piece, and decoding.

A text is normalised by longest prefixes through the model's compiled character map (a double
array over UTF-8 bytes); for every byte of the normalised text the place in the source that it
came from is recorded.  Pieces are merged on the normalised text and their ends are projected
through that alignment to byte spans of the original text.  The merging itself is the
library's, run on the text normalised here with its own normalisation switched off.

Nulls count as empty texts; an empty text has the begin and end ids only and decodes to "".
Repeated rows and repeated ids are encoded one by one.  Only id and text are read, so further
columns of any name are no concern.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import file_bytes, map_rows, quoted, tokenizer_path

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """A compiled character map: 4 bytes of trie size, a double-array trie, then the
    replacements, each ended by a zero byte, which the trie's values point to."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.text = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.text = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at ``at``."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.text[start : self.text.index(0, start)], length


class PieceModel:
    """A byte-pair SentencePiece model, read from the bytes of its file."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only byte-pair models can be read")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("marks at word ends are not supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kinds.index(UNKNOWN)
        of = {p: i for i, p in enumerate(self.pieces)}
        self.begin, self.end = of.get(proto.trainer_spec.bos_piece, -1), of.get(proto.trainer_spec.eos_piece, -1)
        self.bytes = [of[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else []
        self.byte_of = np.full(len(of), -1)
        self.byte_of[self.bytes] = np.arange(len(self.bytes))
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)])
        self.surface = ["" if k == CONTROL else p.replace(MARK, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.surface[self.unknown] = proto.trainer_spec.unk_surface
        # the library merges what is normalised here: its own normalisation is switched off
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text; for each of its bytes, and for its end, the source byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        data = text.encode()
        if not self.map.units and not self.squeeze:
            lead = (MARK if self.escape else " ") if self.prefix else ""
            wide = np.where(np.frombuffer(data, np.uint8) == 32, 3 if self.escape else 1, 1)
            align = np.concatenate([np.zeros(len(lead.encode()), np.int64), np.repeat(np.arange(len(data)), wide), [len(data)]])
            return lead + (text.replace(" ", MARK) if self.escape else text), align
        parts, at, n = [], 0, len(data)
        while at < n:
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = data[at : at + width], width
            parts.append((hit[0], at))
            at += hit[1]
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        if not parts:
            return "", np.array([n])
        space = MARK.encode() if self.escape else b" "
        out, align = bytearray(), []
        if self.prefix:
            out += space
            align += [parts[0][1]] * len(space)
        spaced = self.squeeze
        for piece, source in parts:
            if self.squeeze and spaced:
                piece = piece.lstrip(b" ")
            if piece:
                spaced = piece.endswith(b" ")
                new = piece.replace(b" ", space)
                out += new
                align += [source] * len(new)
        tail = n
        if self.squeeze:
            while out.endswith(space):
                tail = align[len(out) - len(space)]
                del out[len(out) - len(space) :], align[len(align) - len(space) :]
        return out.decode(), np.array([*align, tail], np.int64)

    def encode(self, text: str, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and a row of source bytes (start, end) for each of them; the begin and end ids
        have empty spans.  The bytes of a character outside the vocabulary all have its span."""
        normal, align = self.normalise(text)
        ids = np.array(self.merger.encode(normal), "<u4")
        width = self.width[ids]
        if (ids == self.unknown).any():  # a run of unknown characters is one piece
            width = np.array([len(p.surface.encode()) for p in self.merger.encode(normal, return_type="proto").pieces])
        stop = np.cumsum(width)
        start = stop - width
        at = np.flatnonzero(self.byte_of[ids] >= 0)
        if at.size:
            first = np.flatnonzero((self.byte_of[ids[at]] & 0xC0) != 0x80)
            size = np.diff([*first, at.size])
            start[at], stop[at] = np.repeat(start[at[first]], size), np.repeat(stop[at[first + size - 1]], size)
        spans = np.stack([align[start], align[stop]], axis=1)
        if ends:
            n = len(text.encode())
            ids = np.concatenate([np.array([self.begin], "<u4"), ids, np.array([self.end], "<u4")])
            spans = np.concatenate([np.zeros((1, 2), np.int64), spans, np.full((1, 2), n)])
        return ids, spans

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: marks become spaces, the first of them goes if encoding adds one,
        runs of byte pieces are read as UTF-8, each wrong byte as U+FFFD."""
        listed = ids.tolist()
        raw = self.byte_of[ids]
        if (raw < 0).all():
            text = "".join([self.surface[i] for i in listed])
        else:
            out, cuts = [], np.flatnonzero(np.diff(raw >= 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(listed)], strict=True):
                out.append(_read_bytes(bytes(raw[a:b].tolist())) if raw[a] >= 0 else "".join([self.surface[i] for i in listed[a:b]]))
            text = "".join(out)
        first = next((k for k, i in enumerate(listed) if self.kinds[i] != CONTROL), None)
        if first is not None and (self.prefix or self.squeeze) and raw[first] < 0:
            if self.pieces[listed[first]].startswith(MARK):
                text = text[1:]
                if self.squeeze:
                    text = text.lstrip(" ")
        return text


def _read_bytes(held: bytes) -> str:
    try:
        return held.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(held):
        for width in (1, 2, 3, 4):
            try:
                out.append(held[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_documents(
    df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True
) -> DataFrame:
    """Per row of ``df``: id, ids, starts and ends (source bytes of each id) and the decoded text."""
    blob = file_bytes(model_path or tokenizer_path("piece_bpe_32k.model"))

    def make():
        model = PieceModel(blob)

        def work(columns):
            ids, starts, ends, texts = [], [], [], []
            for text in columns[1]:
                i, s = model.encode(text or "")
                ids.append(i)
                starts.append(s[:, 0] if spans else None)
                ends.append(s[:, 1] if spans else None)
                texts.append(model.decode(i))
            return {id_col: columns[0], "ids": ids, "starts": starts, "ends": ends, "decoded": texts}

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df, make, [id_col, text_col], f"{quoted(id_col)} {kind}, ids array<bigint>, starts array<bigint>, ends array<bigint>, decoded string")


def encoding_digests(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, reduced to digests inside the task: number of ids, SHA-256 of the
    ids and of the decoded text, CRC-32 of the spans, and whether the spans cover the whole text
    in order without gaps or overlaps."""
    blob = file_bytes(model_path or tokenizer_path("piece_bpe_32k.model"))

    def make():
        model = PieceModel(blob)

        def work(columns):
            out = {"doc_id": columns[0], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_crc32": [], "spans_cover": []}
            for text in columns[1]:
                text = text or ""
                ids, spans = model.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                out["spans_crc32"].append(zlib.crc32(spans.astype("<u4").tobytes()))
                same = (spans[1:] == spans[:-1]).all(axis=1)
                out["spans_cover"].append(bool(((spans[1:, 0] == spans[:-1, 1]) | same).all()))
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint, spans_cover boolean"
    return map_rows(df, make, [id_col, text_col], schema)
