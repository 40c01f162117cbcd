"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are: ``bpe(a + b) == [a, b]``. So the merges compile to a
non-deterministic transducer that reads bytes, walks the token trie, and may
close a token wherever the closed token agrees with the one before it. Its
subset construction is made on demand. A hypothesis dies within the longest
token's length, so what all live ones agree on is never older than that: the
lookahead is bounded.

Decoding runs an incremental UTF-8 machine whose transitions are tabulated per
token: a state is the bytes of an unfinished character.

Null text counts as empty and has no tokens. Ids, ties and repeated rows need
no care: every row is encoded for itself.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import threading
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import give_back_memory, table

#: What a worker remembers, in MB, and for how many idle seconds. More of it saves time, results are the same.
CACHE_MB, IDLE_SECONDS = 320, 2.0
#: Entries a MB of cache has room for: states (about 600 bytes each), arcs (150), pairs of tokens (150), and pieces in each
#: of two generations (200).
STATES, ARCS, FITS, PIECES = 600, 1000, 1000, 900
#: Marks in the table of halves: not looked up yet, a single byte, never made by merges.
UNKNOWN, BYTE, NEVER = -1, -2, -3
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE = 256


def parse_ranks(packed: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, packed.splitlines()))}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


class Transducer:
    """Bytes of one piece in, token ids out.

    A hypothesis is (the trie node of the open token's bytes, the token closed
    last). A state is the set of hypotheses alive after a byte; an arc's label is
    the token that closes at that byte, of which there is at most one because the
    encoding of a prefix is unique. Tokens are committed as soon as all live
    hypotheses lead back through them.

    A piece follows the arcs that are there and adds one where they end. The sets
    behind that one are stepped without numbers, up to the next commit: most tails
    are seen once, and frequent ones get their arcs as they come again.
    """

    #: Bytes between two commits within one piece.
    COMMIT = 256

    def __init__(self, ranks: dict[bytes, int], cache_mb: int = CACHE_MB):
        self.ranks, self.cache_mb = ranks, cache_mb
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        #: The trie of tokens: node | byte to the child's node. A node is 256 times a number: 0 is the root's, 1 + id a
        #: token's, and greater ones those of nodes that are no tokens, with the depth of each.
        self.child: dict[int, int] = {}
        self.inner = len(self.bytes_of) + 1 << 8
        self.inner_depth = array("L")
        for b, i in ranks.items():
            here = 0
            for n in range(1, len(b) + 1):
                below = self.child.get(here | b[n - 1])
                if below is None:
                    token = ranks.get(b[:n])
                    if token is None:
                        below = self.inner + (len(self.inner_depth) << 8)
                        self.inner_depth.append(n)
                    else:
                        below = 1 + token << 8
                    self.child[here | b[n - 1]] = below
                here = below
        #: The two tokens whose merge makes a token; the left one may be a mark.
        self.left, self.right = (array("q", [UNKNOWN]) * len(self.bytes_of) for _ in range(2))
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {((0, -1),): 0}
        self.states: list[tuple] = [((0, -1),)]
        #: state << 8 | byte to target << 32 | (closed token + 1).
        self.arcs: dict[int, int] = {}

    def halve(self, token: int) -> int:
        """The left one of the two tokens whose merge, the last one, makes ``token``, or a mark; the right one is noted too."""
        found = self.left[token]
        if found == UNKNOWN:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            rank = 0
            while len(parts) > 2 and rank < 1 << 60:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank < 1 << 60:
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                found, self.right[token] = self.ranks[parts[0]], self.ranks[parts[1]]
            else:
                found = BYTE if len(parts) == 1 else NEVER
            self.left[token] = found
        return found

    def can_follow(self, before: int, token: int) -> bool:
        """Whether merging leaves the border between the two tokens alone.

        Time runs backwards here: of the two tokens at the border, the younger one (of the
        same age, the right one, since merges go from left to right) falls into its halves,
        until two bytes are left. Had two that stood there together merged before that
        moment, the border would be gone.
        """
        key = before << 32 | token
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= FITS * self.cache_mb:
                self.fits.clear()
            known = self.fits[key] = self._can_follow(before, token)
        return known

    def _can_follow(self, before: int, token: int) -> bool:
        if self.halve(token) == NEVER:
            return False
        if before < 0:
            return True
        if self.halve(before) == NEVER:
            return False
        rank_of, name, moment = self.ranks.get, self.bytes_of, 1 << 60
        while True:
            rank = rank_of(name[before] + name[token])
            if rank is not None and rank < moment:
                return False
            old, new = self.halve(before), self.halve(token)
            if old != BYTE and (new == BYTE or before > token):
                before, moment = self.right[before], before
            elif new != BYTE:
                token, moment = new, token + 1
            else:
                return True

    def step(self, live: Iterable[tuple[int, int]], byte: int) -> tuple[list[tuple[int, int]], int]:
        """The hypotheses alive after one more byte, and the token that closes there (-1: none)."""
        child, inner, fits, closed = self.child.get, self.inner, self.fits.get, -1
        grown = [(node, before) for here, before in live if (node := child(here | byte))]
        for node, before in grown:
            if node < inner:
                token = (node >> 8) - 1
                known = fits(before << 32 | token)
                if known or known is None and self.can_follow(before, token):
                    closed = token
                    grown.append((0, closed))
                    break
        return grown, closed

    def depth(self, node: int) -> int:
        """How many bytes lead to a node."""
        if node < self.inner:
            return len(self.bytes_of[(node >> 8) - 1]) if node else 0
        return self.inner_depth[(node - self.inner) >> 8]

    def number(self, live: Iterable[tuple[int, int]]) -> int:
        """The state of these hypotheses."""
        key = tuple(live)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
        return found

    def _back(self, closes: list[int], end: int) -> list[int]:
        """The tokens that end at byte ``end``, first one first."""
        out = []
        while end:
            out.append(token := closes[end - 1])
            end -= len(self.bytes_of[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece's ids; one that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, closes, done = 0, [], []
        if len(self.states) > STATES * self.cache_mb or len(self.arcs) > ARCS * self.cache_mb:
            self.clear()
        arcs, live = self.arcs, ()
        for byte in piece:
            # Below 0: the sets have no number.
            if state < 0:
                live, token = self.step(live, byte)
            else:
                arc = arcs.get(state << 8 | byte)
                if arc is None:
                    live, token = self.step(self.states[state], byte)
                    arcs[state << 8 | byte] = self.number(live) << 32 | (token + 1)
                    state = -1
                else:
                    state, token = arc >> 32, (arc & 0xFFFFFFFF) - 1
            closes.append(token)
            if len(closes) == self.COMMIT:
                live = self.states[state] if state >= 0 else live
                paths = [self._back(closes, len(closes) - self.depth(node)) for node, _ in live]
                n = 0
                while all(len(p) > n for p in paths) and len({p[n] for p in paths}) == 1:
                    n += 1
                agreed = paths[0][:n]
                done += agreed
                del closes[: sum(len(self.bytes_of[t]) for t in agreed)]
                state = self.number(live)
        return done + self._back(closes, len(closes))


class Pieces(dict):
    """Piece to packed little-endian ids, filled by the transducer. Two generations: pieces in use outlive a full one."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older, self.most = transducer, {}, PIECES * transducer.cache_mb

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_mb: int = CACHE_MB):
        self.transducer = Transducer(ranks, cache_mb)
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.transducer)

    def encode(self, text: str) -> bytes:
        """The whole text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


def utf8_split(data: bytes) -> int:
    """Where the trailing unfinished character of ``data`` starts (its length if none is open)."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead & 0xC0 != 0x80:
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            return len(data) - back if need > back else len(data)
    return len(data)


class Decoder:
    """Streaming decode: feed ids in any cuts, get whole characters as soon as they are complete."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.arcs: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        #: Tokens that hold whole characters only: from the clean state they lead back to it.
        self.whole = np.array([self._is_whole(b) for b in self.bytes_of], dtype=bool)

    @staticmethod
    def _is_whole(b: bytes) -> bool:
        try:
            b.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    def arc(self, state: bytes, token: int) -> tuple[bytes, bytes]:
        """(unfinished bytes, finished bytes) after ``token``."""
        key = (state, token)
        if key not in self.arcs:
            if len(self.arcs) > 4096:
                self.arcs.clear()
            data = state + self.bytes_of[token]
            cut = utf8_split(data)
            self.arcs[key] = (data[cut:], data[:cut])
        return self.arcs[key]

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[bytes]:
        """Finished bytes for each chunk of ids; the rest comes last, as it is."""
        state = b""
        for ids in chunks:
            out, at, n = [], 0, len(ids)
            broken = np.flatnonzero(~self.whole[ids])
            while at < n:
                if not state:
                    k = int(np.searchsorted(broken, at))
                    until = int(broken[k]) if k < len(broken) else n
                    out.append(b"".join(map(self.bytes_of.__getitem__, ids[at:until].tolist())))
                    at = until
                if at < n:
                    state, done = self.arc(state, int(ids[at]))
                    out.append(done)
                    at += 1
            yield b"".join(out)
        if state:
            yield state


class Codecs:
    """The codec of the vocabulary and pattern that a worker process saw last: kept from task to task, dropped when idle."""

    def __init__(self):
        self.key, self.codec, self.timer = None, None, None

    def take(self, packed: bytes, pattern: str, cache_mb: int) -> tuple[Encoder, Decoder]:
        if self.timer is not None:
            self.timer.cancel()
        key, codec = (hashlib.sha256(packed).digest(), pattern, cache_mb), self.codec
        if codec is None or self.key != key:
            ranks = parse_ranks(packed)
            self.key, self.codec = key, (codec := (Encoder(ranks, pattern, cache_mb), Decoder(ranks)))
        return codec

    def give_back(self) -> None:
        self.timer = threading.Timer(IDLE_SECONDS, self.drop)
        self.timer.daemon = True
        self.timer.start()

    def drop(self) -> None:
        self.codec = None
        give_back_memory()


_CODECS = Codecs()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, with their last column's texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, part.column(part.num_columns - 1).to_pylist()


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cache_mb: int = CACHE_MB) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns ``id_col``, the ``keep`` columns, ``ids`` (array of int) and
    ``decoded`` (binary: the bytes of the decoded ids). The rank file's bytes
    are read on the driver and travel with the function (under 1 MB).
    """
    blob = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    picked = docs.select(id_col, *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = picked.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")

    def run(batches):
        encoder, decoder = _CODECS.take(blob.value, pattern, cache_mb)
        for batch, texts in _rows(batches):
            ids, decoded = [], []
            for packed in map(encoder.encode, texts):
                row = np.frombuffer(packed, dtype="<u4")
                ids.append(row.astype(np.int32))
                decoded.append(b"".join(decoder.stream([row])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], [*batch.schema.names[:-1], "ids", "decoded"])
        _CODECS.give_back()

    return picked.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cache_mb: int = CACHE_MB) -> DataFrame:
    """As :func:`encode_documents`, but the ids and bytes leave the worker as digests only.

    Columns: ``id_col``, ``keep``, n_tokens long, ids_sha256, decoded_sha256.
    """
    blob = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    picked = docs.select(id_col, *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = picked.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        encoder, decoder = _CODECS.take(blob.value, pattern, cache_mb)
        for batch, texts in _rows(batches):
            counts, ids_sha, out_sha = [], [], []
            for packed in map(encoder.encode, texts):
                decoded = hashlib.sha256()
                for done in decoder.stream([np.frombuffer(packed, dtype="<u4")]):
                    decoded.update(done)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                out_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())],
                [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        _CODECS.give_back()

    return picked.mapInArrow(run, schema)


def default_vocabulary() -> tuple[str, str]:
    """The rank file and pattern that the query uses; any other pair may be passed instead."""
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), *default_vocabulary())
