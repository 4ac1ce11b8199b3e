"""SentencePiece encoding and decoding: Viterbi over many words at once in numpy."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BASES, mix, shared_dir, slices, small_batches, table

BLANK = "▁"
NORMAL, BYTE = 1, 6
UNIGRAM = 1  # a model's type in its training notes; others have scores that are no log probabilities
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, data[at : at + n]
        at += n


def zipf(scores: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law (rank r: 1/r) of pieces ranked by falling score; float32, as model files hold them."""
    p = np.empty(len(scores))
    p[np.argsort(-scores, kind="stable")] = 1 / np.arange(1, len(scores) + 1)
    return np.log(p / p.sum()).astype(np.float32)


def _mixed(units: np.ndarray, lengths) -> np.ndarray:
    return mix(units + np.asarray(lengths, np.uint64) * np.uint64(BASES[1]))


class Pieces:
    """A vocabulary: pieces with scores in a table sorted by hash, and what each id decodes to.

    A unigram model's scores are taken as they are. A model trained by merges has ranks for scores, whose sums mean nothing;
    its pieces get log probabilities from their ranks (zipf), so it is read as a unigram model of the same pieces.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        entries = [dict(_fields(v)) for k, v in fields if k == 1]
        kind = next((dict(_fields(v)).get(3, UNIGRAM) for k, v in fields if k == 2), UNIGRAM)
        self.names = [e.get(1, b"").decode() for e in entries]
        kinds = np.array([e.get(3, NORMAL) for e in entries])
        scores = np.array([struct.unpack("<f", e[2])[0] if 2 in e else 0.0 for e in entries])
        normal = np.flatnonzero(kinds == NORMAL)
        if kind != UNIGRAM:
            scores[normal] = zipf(scores[normal])
        if any(BLANK in self.names[i].lstrip(BLANK) for i in normal):
            raise ValueError("pieces that go on after a blank are not supported")
        self.longest = max(len(self.names[i]) for i in normal)
        self.unknown = float(scores[normal].min()) - 10.0
        self.unknown_id = int(np.flatnonzero(kinds == 2)[0]) if (kinds == 2).any() else 0
        lengths = np.array([len(self.names[i]) for i in normal])
        keys = np.zeros(len(normal), np.uint64)
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            keys[at] = self.hashes(self._units([self.names[normal[i]] for i in at]))
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], normal[order], scores[normal][order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        self.seen = np.zeros(1 << 20, bool)  # by the last 20 bits of a key: most substrings are no pieces and need no search
        self.seen[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.bytes = {int(self.names[i][1:-1], 16): int(i) for i in np.flatnonzero(kinds == BYTE)}
        out = [bytes([int(n[1:-1], 16)]) if k == BYTE else n.replace(BLANK, " ").encode() if k == NORMAL else b"" for n, k in zip(self.names, kinds, strict=True)]
        self.sizes = np.array([len(b) for b in out], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    @staticmethod
    def _units(words: list[str]) -> np.ndarray:
        """Code points of equally long words, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)

    @staticmethod
    def hashes(units: np.ndarray) -> np.ndarray:
        """Of each row of code points."""
        h = np.zeros(len(units), np.uint64)
        for e in range(units.shape[1]):
            h = h * np.uint64(BASES[0]) + units[:, e].astype(np.uint64) + np.uint64(1)
        return _mixed(h, units.shape[1])

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of the best segmentation of equally long words. Ties go to the longer last piece; a character that is no piece is unknown, and then bytes."""
        units = self._units(words)
        n, size = units.shape
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        length, piece = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1, np.int64)
        wide = np.uint64(BASES[0])
        window = np.zeros((n, 0), np.uint64)  # column k: polynomial of the last longest-k ... characters
        for e in range(1, size + 1):
            u = units[:, e - 1].astype(np.uint64) + np.uint64(1)
            window = np.hstack([window * wide + u[:, None], u[:, None]])[:, -self.longest :]  # starts e-k, from longest to 1
            k = np.arange(window.shape[1], 0, -1)
            keys = _mixed(window, k)
            maybe = np.nonzero(self.seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == keys[maybe]
            maybe, at = (maybe[0][hit], maybe[1][hit]), at[hit]
            gain, ids = np.full(keys.shape, -np.inf), np.full(keys.shape, -1, np.int64)
            gain[maybe], ids[maybe] = self.scores[at], self.ids[at]
            gain[:, -1] = np.where(ids[:, -1] >= 0, gain[:, -1], self.unknown)
            total = best[:, e - k] + gain
            pick = total.argmax(1)
            rows = np.arange(n)
            best[:, e], length[:, e], piece[:, e] = total[rows, pick], k[pick], ids[rows, pick]
        rows, e, path = np.arange(n), np.full(n, size), []
        while e.any():  # all words go back a piece at a time; column 0 is no piece
            path.append(np.where(e > 0, piece[rows, e], -2))
            e = e - length[rows, e]
        back = np.stack(path[::-1], 1)
        cuts = np.cumsum((back >= 0).sum(1)) * 4
        flat = back[back >= 0].astype("<u4").tobytes()
        out = [flat[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        for i in np.flatnonzero((back == -1).any(1)).tolist():
            ids, at = [], 0
            for p in back[i].tolist():
                if p >= 0:
                    ids.append(p)
                    at += len(self.names[p])
                elif p == -1:
                    raw = words[i][at].encode("utf-8", "surrogatepass")
                    ids.extend([self.bytes[b] for b in raw] if self.bytes else [self.unknown_id])
                    at += 1
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def segment(self, words: list[str], cells: int = 1 << 20) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct words; words of a length advance together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out = {}
        for size, group in by_length.items():
            step = max(1, cells // (size + self.longest))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                out.update(zip(part, self.viterbi(part), strict=True))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: blanks for their marks, bytes joined, and without the blank that encoding puts first."""
        ids = np.frombuffer(ids, "<u4")
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        raw = self.flat[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))].tobytes()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Texts to ids, with a bounded memory of words seen."""

    LIMIT = 800_000

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [_CHUNK.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set(chain.from_iterable(chunks)).difference(self.known)
        if len(self.known) + len(new) > self.LIMIT:
            self.known.clear()
            new = set(chain.from_iterable(chunks))
        self.known.update(self.pieces.segment(list(new)))
        return [b"".join(map(self.known.__getitem__, c)) for c in chunks]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Pieces(path))


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): each text's piece ids, as a binary of little-endian unsigned 32-bit numbers.

    The segmentation with the greatest sum of the pieces' log probabilities, blanks as marks and one more before the text, as
    the unigram model defines it. A vocabulary trained by merges is read as a unigram one (Pieces), so the ids are not those
    of its merges. Null and empty texts have no ids. Null and repeated doc_ids stay; very long texts are read whole; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = encoder(path).encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids). Null ids give "". The mark itself, where a text had it, comes back as a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = encoder(path).pieces
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array([pieces.decode(b or b"") for b in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned), and the digest of the decoded text."""
    import public_tokenizers

    shared_dir(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
