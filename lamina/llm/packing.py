"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, long_key, ranked, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CACHE = 700_000


_encoders: dict = {}  # by path: a Python worker keeps its cache from task to task
TAIL = b".,!?;:#$%&*"


def word_encoder(path: str):
    """Texts to the bytes of their ids (little-endian unsigned 32-bit), with a cache of words.

    The tokenizer lower-cases, drops white space and never joins across it, nor across the edge of a word's
    letters and the marks behind them. So a text's ids are those of its words in turn, and a word's those
    of its letters and of its tail. Words with ``<|``, which may hold a special token, are encoded as they
    stand. Words are cut at the six ASCII white-space characters only. The cache is emptied when full.
    """
    if path in _encoders:
        return _encoders[path]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
    known: dict[bytes, bytes] = {}

    def one_by_one(words: list[bytes]) -> None:
        for w, e in zip(words, tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def letters(words: list[bytes]) -> None:
        """Words of letters alone go as one text; each ends where a token ends a word."""
        ids = np.array(tok.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) != len(words) or cut[-1] != len(ids):
            return one_by_one(words)
        raw, at = ids.tobytes(), 0
        for w, c in zip(words, (4 * cut).tolist()):
            known[w] = raw[at:c]
            at = c

    def learn(new: list[bytes]) -> None:
        plain, other, parted = set(), set(), []
        for w in new:
            stem = w.rstrip(TAIL)
            last = stem.decode() if stem else ""
            if stem and last.isalpha():
                plain.add(stem)
            elif stem == w or not stem or not last[-1].isalpha() or b"<|" in w:
                other.add(w)
                continue
            else:
                other.add(stem)
            if stem != w:
                other.add(w[len(stem) :])
                parted.append((w, stem))
        if missing := [w for w in plain if w not in known]:
            letters(missing)
        if missing := [w for w in other if w not in known]:
            one_by_one(missing)
        for w, stem in parted:
            known[w] = known[stem] + known[w[len(stem) :]]

    def encode(texts: list[bytes]) -> list[bytes]:
        docs = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(known) > CACHE:
            known.clear()
        if new := set().union(*docs).difference(known):
            learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in docs]

    return _encoders.setdefault(path, encode)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", size: int = 2048, end_id: int = 1) -> DataFrame:
    """Documents cut at every ``size`` ids, the last piece being what is left."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encode = word_encoder(tokenizer)
        for batch in (s for b in batches for s in slices(b)):
            out = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    for column, v in zip(out, (doc, at, len(part) // 4, zlib.crc32(part), n)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(long_key(docs, key), F.col(text)).mapInArrow(cut, PIECES)


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, their lengths) from a histogram of lengths.

    Lengths are placed longest first, each into the packs that hold least so far, if it fits; all packs
    with one pattern move at once, so the work depends on the lengths there are, not on the pieces.
    """
    room: list[list[list]] = [[] for _ in range(size + 1)]  # by space left: [packs, lengths]
    most = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while most > 0 and not room[most]:
                most -= 1
            if most < length:
                room[size - length].append([left, (length,)])
                most, left = max(most, size - length), 0
                continue
            pack = room[most][-1]
            n = min(left, pack[0])
            pack[0] -= n
            if not pack[0]:
                room[most].pop()
            room[most - length].append([n, (*pack[1], length)])
            left -= n
    return [(n, lengths) for packs in room for n, lengths in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset), by pattern and place."""
    out, used, sequence = [], {}, 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            r = used.get(length, 0)
            out.append((length, r, r + n, sequence, offset))
            used[length], offset = r + n, offset + length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", size: int = 2048, end_id: int = 1, seed: int = 5) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The driver gets the histogram of piece lengths, ``size`` rows at most, and turns it into patterns of
    packs. Pieces get their rank among those of their length, dealt over hashed buckets so that one very
    common length is no single task, and the pattern table gives each rank its sequence and offset.

    Null text is an empty document, which has the end id alone. Repeated rows are packed each for itself.
    Null ids stay null. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        cut = scratch.table(pieces(docs, tokenizer, text, key, size, end_id))
        counts = scratch.table(cut.groupBy("length").count())
        table = slots(shortest_pack_first({r["length"]: r["count"] for r in counts.collect()}, size))
        where = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "length long, r0 long, r1 long, s0 long, offset long")
        out = ranked(cut, ["length"], counts, cut.count(), seed, ["doc_id", "start", "ids_crc32"])
        out = out.join(F.broadcast(where), "length").where("rank >= r0 and rank < r1")  # at most one slot per length and pattern
        out = out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("s0") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset")
        return scratch.result(out)
