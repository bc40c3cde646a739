"""Byte-level BPE ids through content-defined chunks that documents share.

A rolling hash over ``WINDOW`` bytes cuts every text wherever its top bits are zero, so a
passage is cut alike wherever it occurs. Then

1. every text sends the digests (128 bits) of its chunks; a chunk that two texts have is
   shared, and the text with the smallest key owns it (one aggregation with map-side sums,
   so a chunk of a third of all texts is one row per task);
2. owners encode their shared chunks, once in the whole corpus, and the ids go to the
   other texts that have them;
3. every text encodes the chunks that nobody else has, takes the ids of the shared ones,
   and repairs the joins: what lies between a place before and a place after a join that
   every context splits alike is encoded again, and the ids around it are kept. A join
   whose window does not begin and end on token bounds on both sides grows over the next
   chunks, in the end over the whole text, so ids are exactly those of the whole text.

Texts are keyed by a 64-bit hash and exchanged once, for steps 2 and 3 alike; equal texts
meet, are told by comparing them, and are encoded once per task. Two texts of one key lose
nothing: a chunk that only they have is encoded in both, and loans are looked up by digest. A text is one row, so a task holds one batch of texts.

A place that every context splits: one ASCII white-space character between two characters
that are visible for sure. Whatever stands before and after, a pre-token begins at it, and
no special token holds white space.

Defined cases: a null text is empty, an empty text has no ids; rows that share an id or a
text are rows of their own; a null id is kept; texts without any such place are encoded
whole; special tokens in a text are found as the library finds them. The vocabulary must
be byte-level BPE with the library's own splitting pattern and no normaliser, else every
text goes through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import claim, forgetting, raw

WINDOW = 32
# Chunks have this many bytes on average, and no two cuts are nearer than LEAST (not less than WINDOW).
CHUNK = 768
LEAST = 64
# Bytes hashed at a time.
STRETCH = 1 << 18
# Bytes of memory a worker may use to remember words, by estimate.
MEMO_BYTES = 96 << 20
DIGEST = 16

_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2 ** 32, 256, dtype=np.uint32)


def _rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW bytes up to each place, built in five doublings.

    A byte's value is shifted once for every byte after it, so the top bits depend on all 32.
    """
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        before = h[:-width] << np.uint32(width)
        h[width:] += before
        width *= 2
    return h


def cuts(data: np.ndarray, chunk: int = CHUNK) -> list[int]:
    """Ends of the chunks of one text, its length included (none for an empty text)."""
    return next(iter(_cut_texts(data, np.array([0, len(data)]), chunk)))


def _cut_texts(data: np.ndarray, offsets: np.ndarray, chunk: int):
    """``cuts`` of each text of a batch, hashed ``STRETCH`` bytes at a time.

    Hashes of neighbouring texts may run into each other: only the first WINDOW - 1 bytes
    of a text are touched, where no cut can be.
    """
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRETCH)) - 1)
        part = data[offsets[first]:offsets[last]]
        places = np.flatnonzero(_rolled(part) < np.uint32(2 ** 32 // chunk)) + 1 + offsets[first]
        for a, b in zip(offsets[first:last].tolist(), offsets[first + 1:last + 1].tolist()):
            yield _greedy(places[np.searchsorted(places, a + LEAST):np.searchsorted(places, b)], data, a, b)
        first = last


def _greedy(places: np.ndarray, data: np.ndarray, begin: int, end: int) -> list[int]:
    """Of ascending places those at least LEAST after the last taken one, moved on to the next character."""
    out, last, i = [], begin, 0
    while i < len(places):
        at = int(places[i])
        while at < end and data[at] & 0xC0 == 0x80:
            at += 1
        if at >= end:
            break
        out.append(at - begin)
        last = at
        i = int(np.searchsorted(places, last + LEAST))
    return [*out, end - begin] if end > begin else []


def splits(data: np.ndarray) -> np.ndarray:
    """Places where every context splits: see the module's text."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    kind = _VISIBLE[data]
    space = (data == 32) | (data == 10) | (data == 9)
    # Visible before: an ASCII sign, or a two-byte letter's second byte after its lead.
    before = (kind == 1)[:-2]
    second = np.zeros(len(data), bool)
    second[1:] = (kind[:-1] == 2) & (data[1:] & 0xC0 == 0x80)
    before = before | second[:-2]
    after = (kind == 1)[2:] | (kind == 2)[2:]
    return np.flatnonzero(space[1:-1] & before & after) + 1


# 1: visible ASCII; 2: the lead of a two-byte character that is no white space (from U+00C0 on).
_VISIBLE = np.zeros(256, np.uint8)
_VISIBLE[0x21:0x7F] = 1
_VISIBLE[0xC3:0xE0] = 2


def _alphabet() -> dict[int, str]:
    """Byte to sign of the byte-level alphabet: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
# Texts of these characters alone are split here; for them the pattern below is the library's.
_COMMON = re.compile("[\t\n\r -~\xa1-ɏ‐-‧‰-⁞₠-₿]*")
# Fixed by byte-level BPE's splitting rule, over those characters (numbers: also the Latin-1 ones).
_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^\s{_LETTERS}0-9\xb2\xb3\xb9\xbc-\xbe]+"
                    r"|\s+(?!\S)|\s+")


class Memo(dict):
    """Word to ids, in two generations that together stay under a bound of bytes; what is used stays."""

    def __init__(self, make, most_bytes: int = MEMO_BYTES):
        self.make, self.most, self.older, self.held = make, most_bytes // 2, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        cost = 220 + 2 * len(key) + len(found)  # two objects and their place in the table
        if self.held + cost > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += cost
        self[key] = found
        return found


class Coder:
    """A byte-level vocabulary: ids of texts and bytes of ids."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        rules = json.loads(spec)
        rules["truncation"] = rules["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(rules))
        self.model = self.library.model
        self.signs = _alphabet()
        pre, model = rules["pre_tokenizer"] or {}, rules["model"]
        self.known = (rules["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                      and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")
                      and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        added = rules["added_tokens"]
        self.known = self.known and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
                                            or re.search(r"\s", t["content"]) or not t["content"] for t in added)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else re.compile(r"(?!)")
        size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.kind = "<u2" if size <= 65536 else "<u4"
        back = {s: b for b, s in self.signs.items()}
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(back[s] for s in token) if all(s in back for s in token) else token.encode()
        for t in added:
            self.bytes[t["id"]] = t["content"].encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.word = Memo(self._word)

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.signs))
        return np.array([t.id for t in tokens], self.kind).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text as the library gives them, whole."""
        if self.known and _COMMON.fullmatch(text) and not self.special.search(text):
            return np.frombuffer(b"".join(map(self.word.__getitem__, _WORDS.findall(text))), self.kind)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def decoded(self, ids: np.ndarray) -> str:
        if not self.known:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}
forgetting(_coders.clear)


def coder(spec: str) -> Coder:
    """One coder a worker; another vocabulary takes its place."""
    claim("chunks")
    if spec not in _coders:
        _coders.clear()
        _coders[spec] = Coder(spec)
    return _coders[spec]


# A safe place (see ``splits``) stands after this, before a visible character.
_BEFORE_SAFE = re.compile(rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf])(?=[ \n\t](?:[!-~]|[\xc3-\xdf][\x80-\xbf]))")
# Bytes on either side of a join that are searched first.
NEAR = 160


def _windows(data: bytes, ends: list[int]) -> list[int] | None:
    """Begin and end of the window around every join, if each has safe places nearby in its two chunks."""
    out, low = [], 0
    for k, end in enumerate(ends[:-1]):
        last = None
        for last in _BEFORE_SAFE.finditer(data, max(low, end - NEAR), end):
            pass
        after = _BEFORE_SAFE.search(data, end, min(ends[k + 1], end + NEAR))
        if last is None or after is None or out and last.end() <= out[-1]:
            return None
        out += [last.end(), after.end()]
        low = end
    return out


def joined(code: Coder, data: bytes, ends: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """Ids of the whole text from the ids of its chunks, with every join repaired."""
    if len(parts) == 1:
        return parts[0]
    windows = _windows(data, ends)
    if windows is not None:
        ids = np.concatenate(parts)
        bounds = np.concatenate([[0], np.cumsum(code.lengths[ids])])
        wanted = np.array([*windows, *ends])
        places = np.searchsorted(bounds, wanted).clip(max=len(ids))
        if (bounds[places] == wanted).all():
            out, done, places = [], 0, places.tolist()
            for k in range(0, len(windows), 2):
                out += [ids[done:places[k]], code.ids(data[windows[k]:windows[k + 1]].decode())]
                done = places[k + 1]
            return np.concatenate([*out, ids[done:]])
    return _joined_widely(code, data, ends, parts)


def _joined_widely(code: Coder, data: bytes, ends: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """``joined`` with windows that grow as far as they must."""
    safe = splits(np.frombuffer(data, np.uint8))
    bounds, start = [], 0  # bytes of the text at which the tokens of each chunk begin
    for end, ids in zip(ends, parts):
        at = np.concatenate([[0], np.cumsum(code.lengths[ids])]) + start
        if at[-1] != end:  # a token that does not say which bytes it covers
            return code.ids(data.decode())
        bounds.append(at)
        start = end
    out: list[np.ndarray] = []
    done = chunk = 0  # everything before byte ``done``, which lies in ``chunk``, is in ``out``
    while ends[chunk] < len(data):
        # The window: from the last safe place before the join ...
        begin = _bound(bounds[chunk], safe, done, ends[chunk], -1)
        if begin is None:
            begin = done
        else:
            out.append(parts[chunk][np.searchsorted(bounds[chunk], done):np.searchsorted(bounds[chunk], begin)])
        # ... to the first one after it, in the next chunk that has one.
        chunk, stop = chunk + 1, None
        while chunk < len(ends) and stop is None:
            stop = _bound(bounds[chunk], safe, ends[chunk - 1], ends[chunk], 1)
            chunk += stop is None
        if stop is None:
            out.append(code.ids(data[begin:].decode()))
            return np.concatenate(out)
        out.append(code.ids(data[begin:stop].decode()))
        done = stop
    out.append(parts[chunk][np.searchsorted(bounds[chunk], done):])
    return np.concatenate(out)


def _bound(bounds: np.ndarray, safe: np.ndarray, low: int, high: int, step: int) -> int | None:
    """The first (``step`` 1) or last (-1) safe place between two bytes of a chunk, if a token begins there.

    Both neighbours must lie between the two as well: the chunk was split without seeing others.
    """
    a, b = int(np.searchsorted(safe, low, "right")), int(np.searchsorted(safe, high - 1))
    for i in range(a, b) if step > 0 else range(b - 1, a - 1, -1):
        k = int(np.searchsorted(bounds, safe[i]))
        if k < len(bounds) and bounds[k] == safe[i]:
            return int(safe[i])
    return None


def _cut_up(column, chunk: int):
    """(text, ends of its chunks) of every row of a binary column."""
    data, offsets = raw(column)
    for (a, b), ends in zip(zip(offsets[:-1].tolist(), offsets[1:].tolist()), _cut_texts(data, offsets, chunk)):
        yield data[a:b].tobytes(), ends


def _named(text: bytes, ends: list[int]) -> list[bytes]:
    """Digests of a text's chunks."""
    return [hashlib.blake2b(text[a:b], digest_size=DIGEST).digest() for a, b in zip([0, *ends], ends)]


def encoded(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded): ids of every whole text (two bytes each, or four), and the text they decode to.

    ``chunk`` is a power of two.
    """
    return _run(docs, spec, doc_id, text, chunk, lambda code, ids: (ids.tobytes(), code.decoded(ids)), "ids binary, decoded string")


def digests(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    def describe(code, ids):
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(code.decoded(ids).encode()).hexdigest())

    return _run(docs, spec, doc_id, text, chunk, describe, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, spec: str, doc_id: str, text: str, chunk: int, describe, schema: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole.cast("binary").alias("text"),
                        # Never null, so that no join filters it and both joins read one exchange of the texts.
                        F.xxhash64(whole).alias("key"))

    def cut(batches):
        for batch in batches:
            keys, found = [], []
            for key, (text_, ends) in zip(batch.column(1).to_pylist(), _cut_up(batch.column(0), chunk)):
                own = set(_named(text_, ends))
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(keys, pa.int64())], ["chunk", "key"])

    places = texts.select("text", "key").mapInArrow(cut, "chunk binary, key bigint")
    # A chunk is shared if two different texts have it; copies of one text share everything as a whole.
    shared = places.groupBy("chunk").agg(F.min("key").alias("owner"), F.max("key").alias("other")).where("owner <> other") \
        .select("chunk", "owner")
    owned = shared.groupBy(F.col("owner").alias("key")).agg(F.collect_list("chunk").alias("given"))

    def encode_shared(batches):
        code = coder(spec)
        for batch in batches:
            names, ids = [], []
            last = None
            for (text_, ends), given in zip(_cut_up(batch.column(1), chunk), batch.column(2).to_pylist()):
                if text_ == last:  # copies of a text lie together
                    continue
                last, wanted, begin = text_, set(given), 0
                for name, end in zip(_named(text_, ends), ends):
                    if name in wanted:
                        wanted.discard(name)
                        names.append(name)
                        ids.append(code.ids(text_[begin:end].decode()).tobytes())
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "ids"])

    once = texts.join(owned, "key").select("key", "text", "given", "doc_id").sortWithinPartitions("key") \
        .mapInArrow(encode_shared, "chunk binary, ids binary") \
        .groupBy("chunk").agg(F.first("ids").alias("ids"))
    lent = places.dropDuplicates(["chunk", "key"]).join(once, "chunk") \
        .groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("lent"))

    def assemble(batches):
        code = coder(spec)
        last, done = None, None
        for batch in batches:
            out = []
            for (text_, ends), lent_ in zip(_cut_up(batch.column(1), chunk), batch.column(3).to_pylist()):
                if text_ != last:
                    have = {x["chunk"]: np.frombuffer(x["ids"], code.kind) for x in lent_ or ()}
                    parts, begin = [], 0
                    for name, end in zip(_named(text_, ends) if have else [None] * len(ends), ends):
                        ids = have.get(name)
                        parts.append(code.ids(text_[begin:end].decode()) if ids is None else ids)
                        begin = end
                    ids = (joined(code, text_, ends, parts) if code.known else code.ids(text_.decode())) if parts \
                        else np.zeros(0, code.kind)
                    last, done = text_, describe(code, ids)
                out.append(done)
            columns = list(zip(*out)) if out else [()] * len(schema.split(","))
            kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            names = [c.split() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), *(pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names))],
                ["doc_id", *(n for n, _ in names)])

    return texts.join(lent, "key", "left").select("key", "text", "doc_id", "lent").sortWithinPartitions("key") \
        .mapInArrow(assemble, "doc_id bigint, " + schema)
