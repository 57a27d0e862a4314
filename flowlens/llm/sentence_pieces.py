"""SentencePiece BPE models: offset-preserving encoding, decoding, and where texts may be cut."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Shipped, ranges, strings_at, text_slices, utf8

SPACE = "▁"


class CharacterMap:
    """The compiled character map: a double-array trie from prefixes to replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.pool = b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
            self.pool = blob[4 + size:]

    def longest_prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes that the longest known prefix at ``at`` covers, and what replaces them."""
        units = self.units
        if not units:
            return 0, b""
        best, value = 0, 0
        node = units[0]
        position = (node >> 10) << ((node & 512) >> 6)
        for length, byte in enumerate(text[at:at + 256], 1):
            position ^= byte
            if position >= len(units):
                break
            node = units[position]
            if node & 0x800000FF != byte:
                break
            position ^= (node >> 10) << ((node & 512) >> 6)
            if node & 256:
                best, value = length, units[position] & 0x7FFFFFFF
        if not best:
            return 0, b""
        return best, self.pool[value:self.pool.index(b"\0", value)]


class PieceModel:
    """A byte-fallback BPE model file, with its normalisation taken apart from its merges."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and leading blanks")
        if any(p.type == 4 for p in model.pieces) or not spec.escape_whitespaces:
            raise ValueError("user-defined pieces and unescaped blanks are not supported")
        self.charmap = bytes(spec.precompiled_charsmap)
        self.dummy_prefix = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merges = model.SerializeToString()
        # Normalised bytes of each id, source bytes where nothing but blanks was replaced;
        # a byte of a longer character is -1 there.
        self.norm_size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces])
        self.source_size = np.array([
            (1 if int(p.piece[3:5], 16) < 128 else -1) if p.type == 6
            else len(p.piece.encode()) - 2 * p.piece.count(SPACE) for p in model.pieces])
        # ASCII pairs that no piece holds side by side: a merge never crosses between them.
        never = np.ones((128, 128), bool)
        for piece in model.pieces:
            if piece.type == 1:
                plain = piece.piece.replace(SPACE, " ")
                for a, b in zip(plain, plain[1:]):
                    if a < "\x80" and b < "\x80":
                        never[ord(a), ord(b)] = False
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = never
        # A replacement may reach over a pair, and trimming looks at neighbours.
        if self.charmap or self.trim:
            self.apart[:] = False

    def processor(self):
        from sentencepiece import SentencePieceProcessor
        return SentencePieceProcessor(model_proto=self.merges)

    def prefixed(self, texts: pa.Array) -> pa.Array:
        """Texts with the blank that the model puts before a text that is not empty."""
        texts = pc.fill_null(texts, "")
        if not self.dummy_prefix:
            return texts
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts,
                          pc.binary_join_element_wise(" ", texts, ""))

    def parts(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts cut where merges cannot cross: parts, their starts, text offsets, part counts."""
        data, offsets = utf8(texts)
        cut = np.zeros(len(data), bool)
        if len(data):
            cut[1:] = self.apart[data[:-1], data[1:]]
            cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        words = strings_at(data, np.append(starts, len(data))).dictionary_encode()
        edges = np.searchsorted(starts, offsets)
        return words, starts, offsets, np.diff(edges)


def normalize(model: PieceModel, text: str, prefix: bool) -> tuple[bytes, np.ndarray]:
    """The normalised bytes of ``text`` and, for each and the end, the source byte it stems from.

    The longest prefix that the character map knows is replaced, else one character copied.
    """
    source, mark = text.encode(), SPACE.encode()
    table = CharacterMap(model.charmap)
    out, align = bytearray(), []

    def next_part(at: int) -> tuple[int, bytes]:
        size, replacement = table.longest_prefix(source, at)
        if size:
            return size, replacement
        lead = source[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, source[at:at + size]

    def put(piece: bytes, origin: int) -> None:
        out.extend(piece)
        align.extend([origin] * len(piece))

    at, end = 0, len(source)
    while model.trim and at < end and next_part(at)[1] == b" ":
        at += next_part(at)[0]
    if at < end and prefix and model.dummy_prefix:
        put(mark, at)
    after_blank = model.trim
    while at < end:
        size, replacement = next_part(at)
        for byte in replacement:
            if byte != 32:
                put(bytes([byte]), at)
            elif not (model.trim and after_blank):
                put(mark, at)
            after_blank = byte == 32
        at += size
    while model.trim and out.endswith(mark):
        end = align[-3]
        del out[-3:], align[-3:]
    return bytes(out), np.array([*align, end], np.int64)


class PieceEncoder:
    """Encodes slices of texts; a distinct part is encoded once while it is remembered."""

    REMEMBERED = 1_000_000

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.library = model.processor()
        self.plain = not model.charmap and not model.trim
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.begin, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.spelt: list[str] = []
        self.decoded: list[str | None] = []

    def _learn(self, words: list[str]) -> None:
        """Ids, spans in source bytes, the ids as text and what they decode to."""
        model = self.model
        if self.plain:
            lists = self.library.encode([w.replace(" ", SPACE) for w in words], num_threads=1)
        else:
            aligned = [normalize(model, w, True) for w in words]
            lists = self.library.encode([n.decode() for n, _ in aligned], num_threads=1)
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(lists), np.int32)
        first = np.cumsum(sizes) - sizes
        source = model.source_size[ids]
        ends = np.cumsum(source)
        ends -= np.repeat(np.concatenate([[0], ends])[first], sizes)
        begins = ends - source
        odd = np.bincount(np.repeat(np.arange(len(words)), sizes), weights=source < 0, minlength=len(words)) > 0
        for i in np.flatnonzero(odd | np.array([SPACE in w or not self.plain for w in words], bool)):
            align = normalize(model, words[i], False)[1] if self.plain else aligned[i][1]
            part = slice(first[i], first[i] + sizes[i])
            stops = np.cumsum(model.norm_size[ids[part]])
            ends[part], begins[part] = align[stops], align[stops - model.norm_size[ids[part]]]
        back = self.library.decode(lists, num_threads=1) if lists else []
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.spelt += [",".join(map(str, x)) for x in lists]
        self.decoded += [None if d == w else d for d, w in zip(back, words)]
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.begin, self.end = np.concatenate([self.begin, begins]), np.concatenate([self.end, ends])

    def _look_up(self, texts: pa.Array):
        ready = self.model.prefixed(texts) if self.plain else pc.fill_null(texts, "")
        parts, starts, offsets, counts = self.model.parts(ready)
        words = parts.dictionary.to_pylist()
        if len(self.known) > self.REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        numbers = np.array([self.known[w] for w in words], np.int64)
        which = numbers[parts.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        return which, starts, offsets, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of all texts one after the other, and each text's number of ids.

        Spans are bytes of the original text. Of a character spelt in bytes, the last byte has
        its span, the others are empty.
        """
        which, starts, offsets, counts = self._look_up(texts)
        sizes = self.sizes[which]
        at = ranges((np.cumsum(self.sizes) - self.sizes)[which], sizes)
        owner = np.repeat(np.arange(len(counts)), counts)
        shift = starts - offsets[owner] - (1 if self.plain and self.model.dummy_prefix else 0)
        shift = np.repeat(shift, sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return (self.ids[at], np.maximum(self.begin[at] + shift, 0), np.maximum(self.end[at] + shift, 0),
                np.diff(total[edges]))

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text, per text."""
        which, _, _, counts = self._look_up(texts)
        sizes = np.concatenate([[0], np.cumsum(self.sizes[which])])
        edges = np.concatenate([[0], np.cumsum(counts)])
        spelt, decoded = self.spelt, self.decoded
        words = list(self.known)
        changed = np.array([d is not None for d in decoded] or [False], bool)
        touched = np.concatenate([[0], np.cumsum(changed[which])]) if len(which) else np.zeros(1, np.int64)
        id_hashes, text_hashes = [], []
        numbers = which.tolist()
        sources = pc.fill_null(texts, "").to_pylist()
        for i, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            own = numbers[low:high]
            id_hashes.append(hashlib.sha256(",".join([spelt[n] for n in own]).encode()).hexdigest())
            if touched[high] > touched[low] or not self.plain:
                back = "".join([words[n] if decoded[n] is None else decoded[n] for n in own])
                back = back[1:] if self.model.dummy_prefix else back
            else:
                back = sources[i]
            text_hashes.append(hashlib.sha256(back.encode()).hexdigest())
        return np.diff(sizes[edges]), id_hashes, text_hashes


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends) for every row: piece ids and their spans in the text's bytes.

    A null or empty text has no ids; rows with equal or null ids come back like others.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    held = Shipped(docs.sparkSession, PieceModel(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(held.get())
        for batch in batches:
            for part in text_slices(batch):
                ids, begins, ends, counts = encoder.encode(part["text"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(
                    pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
                    for x in (ids, begins, ends))], ["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(tokens: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids; null ids give null."""
    with open(model_path, "rb") as file:
        held = Shipped(tokens.sparkSession, file.read())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from sentencepiece import SentencePieceProcessor
        library = SentencePieceProcessor(model_proto=held.get())
        for batch in batches:
            yield pa.array([None if x is None else library.decode(x) for x in batch.to_pylist()], pa.string())

    return tokens.withColumn("decoded", run(ids))


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) for every row of ``docs``.

    The ids and spans of the encoding, reduced to digests where they arise. ``covered_bytes`` adds
    up the spans of the pieces; it equals the text's bytes where every byte belongs to a piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = Shipped(docs.sparkSession, PieceModel(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(held.get())
        for batch in batches:
            for part in text_slices(batch):
                _, begins, ends, counts = encoder.encode(part["text"])
                covered = np.concatenate([[0], np.cumsum(ends - begins)])
                edges = np.concatenate([[0], np.cumsum(counts)])
                sizes, of_ids, of_text = encoder.digests(part["text"])
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_text),
                    pa.array(np.diff(covered[edges]), pa.int64()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint")
