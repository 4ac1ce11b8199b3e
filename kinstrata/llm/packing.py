"""Best-fit packing, certified by dual-feasible-function bounds: partitions with a gap exchange documents and pack again."""

from __future__ import annotations

import base64
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, slices, table

END_ID = 2
#: White space and then a blank: only there can a token hold a blank past its first place (as blank, NBSP, blank, NBSP does).
CROSSED = re.compile(r"\s ")


class ChunkIds(dict):
    """Token ids (little-endian unsigned 32-bit) by chunk: what stands from one blank to the next, with the blank before it.

    In texts without CROSSED the vocabulary's splitting never crosses from one chunk to the next, so new chunks are encoded
    together and cut by the tokens' byte lengths. A text's last chunk may end in white space; that is encoded alone.
    """

    LIMIT = 1_000_000

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        from public_tokenizers import PATTERN

        super().__init__()
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks.difference(self))
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = list(chunks)
        last = [c for c in new if c[-1].isspace()]
        self.update((c, np.array(self.encode(" " + c), "<u4").tobytes()) for c in last)
        new = [c for c in new if not c[-1].isspace()] if last else new
        if new:
            ids = np.array(self.encode(" " + " ".join(new)), np.int64)
            ends = np.cumsum([len(c.encode()) + 1 for c in new])
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1) * 4
            flat = ids.astype("<u4").tobytes()
            self.update(zip(new, (flat[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)), strict=True))


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str):
    """texts -> ids as bytes. Equal to tokenizers' encode(text, add_special_tokens=False) with the JSON vocabulary."""
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        cache = ChunkIds({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[bytes]:
        out, parts = [], {}
        for i, text in enumerate(texts):
            if any(x in text for x in special):
                out.append(np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif text[:1] == " " or text[-1:] == " " or CROSSED.search(text):
                out.append(np.array(cache.encode(text), "<u4").tobytes())
            else:
                first, *parts[i] = text.split(" ")
                out.append(np.array(cache.encode(first), "<u4").tobytes())
        cache.learn(set(itertools.chain.from_iterable(parts.values())))
        for i, chunks in parts.items():
            out[i] = b"".join([out[i], *map(cache.__getitem__, chunks)])
        return out

    return encode


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 1024) -> DataFrame:
    """A row for each piece of at most ``capacity`` ids: whole documents, or full pieces after a first that may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, seen = _encoder(json_path, ranks_path), np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                out: list = []
                texts = encode([t or "" for t in part.column("text").to_pylist()])
                for doc, ids in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    ids += end
                    n = len(ids) // 4
                    at, to, k = 0, (n - 1) % capacity + 1, 0
                    while at < n:
                        out.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), seen))
                        at, to, k, seen = to, to + capacity, k + 1, seen + 1
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The greatest bound on the number of bins that the dual feasible functions give."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.nonzero(count)[0]
    count = count[x]
    best = -(-int(count @ x) // capacity)
    for cut in range(1, capacity // 2 + 1):  # small items to 0, their complements to 1
        best = max(best, -(-int(count @ np.where(x > capacity - cut, capacity, np.where(x < cut, 0, x))) // capacity))
        top = 2 * (capacity // cut)  # rounded to multiples of the cut
        f = np.where(2 * x > capacity, top - 2 * ((capacity - x) // cut), np.where(2 * x == capacity, capacity // cut, 2 * (x // cut)))
        best = max(best, -(-int(count @ f) // top))
    for k in range(1, 101):  # k + 1 equal steps
        f = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(count @ f) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, left): each item's bin and its place there, and each bin's free room. Equal items keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []  # bit r of rooms: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i], left[b] = b, capacity - room, room - n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(left, np.int64)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, part long, bin long, offset long, room long, gap long"


def _pack(items: DataFrame, n_parts: int, seed: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in each of ``n_parts`` parts; gap is a part's bins beyond its bound (0: proven fewest)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "salt"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        return pdf.assign(bin=bins, offset=offsets, room=left[bins], gap=len(left) - lower_bound(lengths, capacity))

    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(seed)), F.lit(n_parts)))
    return dealt.groupBy("part").applyInPandas(run, _PACKED)


def best_fit_pack(items: DataFrame, scratch: Scratch, capacity: int = 1024, per_part: int = 20_000) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32, salt) with sequence_id and offset.

    Parts have about ``per_part`` items at any size of the table. A part whose bins equal its bound is done. The others give
    the items of all bins with room into new, mixed parts, which are packed again; this goes on while it saves bins. What a
    round doesn't better stays as it was.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
    n = items.count()
    state = scratch.write(_pack(items, max(1, -(-n // per_part)), 0, capacity), "packed")
    done = []
    for r in itertools.count(1):
        opened = state.where("gap > 0 and room > 0")
        before = opened.agg(F.count("*").alias("n"), F.sum((F.col("offset") == 0).cast("long")).alias("bins")).first()
        if not before["n"]:
            break
        again = scratch.write(_pack(opened.select(names), max(1, -(-before["n"] // per_part)), r, capacity), "packed")
        after = again.where("offset = 0").count()
        if after >= before["bins"]:
            break
        done.append(state.where("gap <= 0 or room <= 0").withColumn("round", F.lit(r - 1)))
        state = again
    out = state.withColumn("round", F.lit(len(done)))
    for other in done:
        out = out.unionByName(other)
    sequence = F.shiftleft(F.col("round").cast("long"), 54).bitwiseOR(F.shiftleft("part", 24)).bitwiseOR(F.col("bin"))
    return out.select(*names[:-1], sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, capacity: int = 1024, per_part: int = 20_000) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` ids as best-fit decreasing with exchanges finds.

    A document is its text's ids and then id 2; a null text is empty, so it is one id. Only documents over ``capacity`` are
    cut; very long texts are encoded whole. Null and repeated doc_ids are documents of their own; other columns are ignored; an
    empty table gives no rows.
    """
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    scratch = Scratch(docs.sparkSession, "packing")
    items = scratch.write(pieces(docs, json_path, ranks_path, capacity), "pieces")
    return best_fit_pack(items, scratch, capacity, per_part)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
