"""SentencePiece BPE encoding that keeps byte offsets, and decoding.

Encoding goes through three steps, each written here from the model's own tables:

* ``Normaliser``: longest-prefix replacement through the model's compiled
  character map (a double-array trie and a block of replacements). For every byte
  of the normalised text it records the byte of the source it came from.
* ``Pieces.word``: merges by score, then position, of one word (nothing merges
  across the start of a word unless the vocabulary has such a piece; then the
  whole text is one word). Words and their parts repeat, so their pieces are
  remembered, up to a bound per worker.
* spans: piece lengths are summed and mapped through the alignment, which
  projects every piece to the bytes of the source text.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to the empty text. The model's bytes travel with the task; they are a fixed file.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import Remembered, claim, forgetting

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# Longest word that is merged by scanning for the best pair.
SHORT = 32


class Normaliser:
    """The normaliser of a model: compiled map, spaces, dummy prefix."""

    def __init__(self, spec, treat_whitespace_as_suffix: bool = False, symbols: tuple[str, ...] = ()):
        self.dummy = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = treat_whitespace_as_suffix
        table = spec.precompiled_charsmap
        self.units, self.replacements = None, b""
        if table:
            size = struct.unpack_from("<I", table)[0]
            self.units = np.frombuffer(table[4:4 + size], "<u4").tolist()
            self.replacements = table[4 + size:]
        self.symbols = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(symbols, key=len, reverse=True))) \
            if symbols else None

    @property
    def plain(self) -> bool:
        """Nothing but spaces changes, so texts need no walk through the map."""
        return self.units is None and not self.trim and self.symbols is None

    def _longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest prefix at ``at`` that the map has, and its length."""
        if self.symbols is not None and (m := self.symbols.match(data, at)):
            return m[0], len(m[0])
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if 0xC0 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else \
            4 if 0xF0 <= lead < 0xF8 else 1
        units, found, length = self.units, -1, 0
        if units is not None:
            # Unit: label in the low byte, bit 8 says "a value follows here", offset above.
            node = 0
            unit = units[0]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            for i in range(at, len(data)):
                node ^= data[i]
                unit = units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= (unit >> 10) << ((unit & 0x200) >> 6)
                if unit >> 8 & 1:
                    found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if found >= 0:
            return self.replacements[found:self.replacements.index(b"\0", found)], length
        piece = data[at:at + width]
        try:
            piece.decode()
        except UnicodeDecodeError:
            return "�".encode(), 1
        return piece, len(piece)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the source offset."""
        out: list[bytes] = []
        where: list[np.ndarray] = []
        space = SPACE.encode() if self.escape else b" "
        at, n = 0, len(data)
        if not n:
            return b"", np.zeros(1, np.int64)
        if self.trim:
            while at < n:
                piece, length = self._longest(data, at)
                if piece != b" ":
                    break
                at += length
            if at == n:
                return b"", np.full(1, n, np.int64)

        def put(piece: bytes, source: int) -> None:
            out.append(piece)
            where.append(np.full(len(piece), source, np.int64))

        if self.dummy and not self.suffix:
            put(space, at)
        was_space = self.trim
        while at < n:
            piece, length = self._longest(data, at)
            if self.trim and was_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", space), at)
                was_space = self.trim and piece.endswith(b" ")
            at += length
        text = b"".join(out)
        places = np.concatenate(where) if where else np.zeros(0, np.int64)
        end = n
        if self.trim:
            while text.endswith(space):
                text = text[:-len(space)]
                end = int(places[len(text)])
        places = places[:len(text)]
        if self.dummy and self.suffix:
            text += space
            places = np.concatenate([places, np.full(len(space), end, np.int64)])
        return text, np.append(places, end)


class Pieces:
    """A BPE model read from its serialised bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.merges: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = proto.trainer_spec.unk_id
        self.unk_surface = proto.trainer_spec.unk_surface if proto.trainer_spec.HasField("unk_surface") else " ⁇ "
        for i, p in enumerate(proto.pieces):
            if p.type in (NORMAL, USER_DEFINED, UNUSED):
                self.merges[p.piece] = (p.score, i)
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.fallback = proto.trainer_spec.byte_fallback
        self.symbols = tuple(p.piece for p in proto.pieces if p.type == USER_DEFINED)
        self.symbol_pattern = re.compile("|".join(map(re.escape, sorted(self.symbols, key=len, reverse=True)))) \
            if self.symbols else None
        self.normaliser = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix,
                                     self.symbols)
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        inner = any(SPACE in p.lstrip(SPACE) for p in self.merges)
        # Words begin at a run of spaces; a piece with a space inside forbids the cut.
        self.cut = None if inner or self.symbols or self.suffix else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.scores = {piece: score for piece, (score, _) in self.merges.items()}
        self.sized = {piece: (i, len(piece.encode())) for piece, (_, i) in self.merges.items()}
        self.regular = not self.symbols and UNUSED not in self.kinds
        self.pairs = {pair for piece in self.merges for pair in zip(piece, piece[1:])}
        self.known = Remembered(self.word)
        self.parts = Remembered(self.part_ids)

    def _short(self, word: str) -> list[str]:
        """Merged symbols of a word, by a scan for the best pair: quicker than an agenda for few symbols."""
        get = self.scores.get
        parts = list(word)
        best = [get(a + b, -math.inf) for a, b in zip(parts, parts[1:])]
        while best:
            top = max(best)
            if top == -math.inf:
                break
            i = best.index(top)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i:
                best[i - 1] = get(parts[i - 1] + parts[i], -math.inf)
            if i < len(best):
                best[i] = get(parts[i] + parts[i + 1], -math.inf)
        return parts

    def word_ids(self, word: str) -> list[tuple[int, int]]:
        """(id, bytes of the normalised text) of every piece of a word.

        Nothing merges across two neighbours that no piece holds side by side, so the word is cut
        there. Its parts (a stem, a full stop and line end) repeat more often than whole words.
        """
        pairs = self.pairs
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in pairs] if self.regular else None
        if not cuts:
            return self.part_ids(word)
        return [found for a, b in zip([0, *cuts], [*cuts, len(word)]) for found in self.parts[word[a:b]]]

    def part_ids(self, word: str) -> list[tuple[int, int]]:
        """``word_ids`` of a word, or part of one, that is merged as a whole."""
        if len(word) <= SHORT and self.regular:
            out = []
            for piece in self._short(word):
                found = self.sized.get(piece)
                if found is not None:
                    out.append(found)
                elif self.fallback:
                    out.extend((self.byte_ids[x], 1) for x in piece.encode())
                else:
                    out.append((self.unknown, len(piece.encode())))
            return out
        frozen: list[bool] = []
        if self.symbol_pattern:
            parts, at = [], 0
            for m in self.symbol_pattern.finditer(word):
                parts += list(word[at:m.start()])
                frozen += [False] * (m.start() - at)
                parts.append(m[0])
                frozen.append(True)
                at = m.end()
            parts += list(word[at:])
            frozen += [False] * (len(word) - at)
        else:
            parts, frozen = list(word), [False] * len(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        unmerged: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or frozen[a] or frozen[b]:
                return
            both = parts[a] + parts[b]
            found = self.merges.get(both)
            if found is not None:
                heapq.heappush(agenda, (-found[0], a, b, both))
                if self.kinds[found[1]] == UNUSED:
                    unmerged[both] = (parts[a], parts[b])

        for i in range(1, n):
            offer(i - 1, i)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if after[a] != b or parts[a] + parts[b] != both or not parts[a] or not parts[b]:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[tuple[int, int]] = []

        def emit(piece: str) -> None:
            score = self.merges.get(piece)
            if score is not None and self.kinds[score[1]] == UNUSED and piece in unmerged:
                for half in unmerged[piece]:
                    emit(half)
            elif score is not None:
                out.append((score[1], len(piece.encode())))
            elif self.fallback:
                out.extend((self.byte_ids[x], 1) for x in piece.encode())
            else:
                out.append((self.unknown, len(piece.encode())))

        i = 0
        while i >= 0 and n:
            emit(parts[i])
            i = after[i]
        return out

    def surface(self, ids: list[int]) -> bytes:
        """Bytes of a word's pieces, spaces not yet restored."""
        return b"".join(bytes([int(self.pieces[i][3:5], 16)]) if self.kinds[i] == BYTE
                        else b"" if self.kinds[i] == CONTROL
                        else self.unk_surface.encode() if self.kinds[i] == UNKNOWN
                        else self.pieces[i].encode() for i in ids)

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD, one each.

        ``first``: the ids begin a text, so a prefix that encoding has put there goes.
        """
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for width in (1, 2, 3, 4):
                    try:
                        char = bytes(held[at:at + width]).decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1 and at + width <= len(held):
                        out.append(char)
                        at += width
                        break
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unk_surface)
            else:
                piece = self.pieces[i]
                if first and self.dummy and not self.suffix and piece.startswith(SPACE):
                    piece = piece[1:]
                out.append(piece.replace(SPACE, " "))
            first = False
        flush()
        return "".join(out)

    def word(self, word: str) -> tuple[str, int, bytes, bytes]:
        """(ids joined by commas, how many, piece lengths as 32-bit integers, whether they decode to another word).

        Most texts hold some byte pieces, such as line ends. They are decoded here, once a word:
        the bytes of a character lie in one word, so words that decode to themselves do so side by side.
        """
        pairs = self.word_ids(word)
        ids, widths = zip(*pairs)
        odd = "".join(map(self.pieces.__getitem__, ids)) != word and self.decode(ids, False) != word.replace(SPACE, " ")
        return ",".join(map(str, ids)), len(ids), struct.pack(f"<{len(widths)}I", *widths), odd

    def encode(self, data: bytes) -> tuple[str, int, np.ndarray, np.ndarray, str | None]:
        """Ids joined by commas, their number, begin and end byte of each piece in the
        source, and the normalised text if it decodes to itself."""
        if self.normaliser.plain:
            # One source byte a normalised byte, but for spaces (three bytes) and the prefix.
            text = data.decode("utf-8", "replace")
            if not text:
                return "", 0, np.zeros(0, np.int64), np.zeros(0, np.int64), ""
            norm = (SPACE if self.dummy and not self.suffix else "") + text.replace(" ", SPACE) \
                + (SPACE if self.dummy and self.suffix else "")
            widths = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            shift = 3 if self.dummy and not self.suffix else 0
            tail = 3 if self.dummy and self.suffix else 0
            places = np.concatenate([np.zeros(shift, np.int64), np.repeat(np.arange(len(data)), widths),
                                     np.full(tail + 1, len(data))])
        else:
            flat, places = self.normaliser(data)
            norm = flat.decode("utf-8", "replace")
            if not norm:
                return "", 0, np.zeros(0, np.int64), np.zeros(0, np.int64), ""
        words = self.cut.findall(norm) if self.cut else [norm]
        ids, counts, widths, odd = zip(*map(self.known.__getitem__, words))
        lengths = np.frombuffer(b"".join(widths), "<u4")
        ends = np.cumsum(lengths, dtype=np.int64)
        spans = places[np.concatenate([np.zeros(1, np.int64), ends[:-1]])], places[ends]
        return ",".join(ids), sum(counts), *spans, None if any(odd) else norm

    def decode_joined(self, ids: str, norm: str | None) -> str:
        """decode(), by way of the normalised text when all its words decode to themselves."""
        if norm is None:
            return self.decode([int(x) for x in ids.split(",")] if ids else [])
        text = norm[1:] if self.dummy and not self.suffix and norm.startswith(SPACE) else norm
        return text.replace(SPACE, " ")


_models: dict[bytes, Pieces] = {}
forgetting(_models.clear)


def load(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _models:
        _models[key] = Pieces(model)
    return _models[key]


def encode_texts(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, pieces' begin and end byte in the source text), one row a document."""
    def run(batches):
        claim("pieces")
        coder = load(model)
        for batch in batches:
            ids, begins, ends = [], [], []
            for data in batch.column(1).to_pylist():
                joined, _, b, e, _ = coder.encode(data)
                ids.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
                begins.append(b)
                ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "ids", "begins", "ends"])

    return _two(docs, doc_id, text).mapInArrow(
        run, "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode_ids(df: DataFrame, model: bytes, key: str, ids: str) -> DataFrame:
    """(key, text) of a column of id arrays; null ids decode to the empty text."""
    def run(batches):
        claim("pieces")
        coder = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())],
                ["key", "text"])

    return df.select(F.col(key).cast("bigint").alias("key"), ids).mapInArrow(run, "key bigint, text string")


def encoding_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; digests of the ids, of the decoded text and of the spans."""
    def run(batches):
        claim("pieces")
        coder = load(model)
        for batch in batches:
            counts, ids, decoded, covered, spans = [], [], [], [], []
            for data in batch.column(1).to_pylist():
                joined, n, begins, ends, norm = coder.encode(data)
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode_joined(joined, norm).encode()).hexdigest())
                covered.append(int(ends[-1]) if n else 0)
                spans.append(zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(covered, pa.int64()), pa.array(spans, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_crc32"])

    return _two(docs, doc_id, text).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
             "covered_bytes bigint, spans_crc32 bigint")


def _two(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
