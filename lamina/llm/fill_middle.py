"""Fill-in-the-middle: texts as ropes, cut at two ranks of units and joined again in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF = 2048  # code points a leaf, more where a run of letters goes on


def unit_starts(text: str) -> np.ndarray:
    """Places (code points) where units start: runs of ASCII letters and single other code points."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((codes | 32) - np.uint32(97)) < 26
    inner = np.zeros(len(codes), dtype=bool)
    inner[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inner)


class Rope:
    """A text as a tree of leaves; each node knows its units and code points.

    Counts add up because every seam lies between units: leaves end where units end, cuts are made at ranks
    of units, and sentinels neither start nor end with a letter.
    """

    __slots__ = ("chars", "left", "right", "text", "units")

    def __init__(self, units: int, chars: int, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.units, self.chars, self.text, self.left, self.right = units, chars, text, left, right

    @classmethod
    def of(cls, text: str, leaf: int = LEAF) -> Rope:
        if not text:
            return cls(0, 0)
        starts = unit_starts(text)
        first = np.unique(np.searchsorted(starts, np.arange(0, len(text), leaf)))
        first = first[first < len(starts)]
        units = [*first.tolist(), len(starts)]
        chars = [*starts[first].tolist(), len(text)]
        row = [cls(units[i + 1] - units[i], chars[i + 1] - chars[i], text[chars[i] : chars[i + 1]]) for i in range(len(first))]
        while len(row) > 1:  # level by level, so the tree is balanced
            row = [row[i] + row[i + 1] if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]

    def __add__(self, other: Rope) -> Rope:
        if not self.chars or not other.chars:
            return self if self.chars else other
        return Rope(self.units + other.units, self.chars + other.chars, left=self, right=other)

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """What lies before and after the first ``rank`` units or chars: one path down, whole subtrees beside it."""
        if rank <= 0:
            return Rope(0, 0), self
        if rank >= getattr(self, by):
            return self, Rope(0, 0)
        if self.left is None:
            starts = unit_starts(self.text)
            at = int(starts[rank]) if by == "units" else rank
            n = rank if by == "units" else int(np.searchsorted(starts, at))
            return Rope(n, at, self.text[:at]), Rope(self.units - n, self.chars - at, self.text[at:])
        n = getattr(self.left, by)
        if rank <= n:
            a, b = self.left.split(rank, by)
            return a, b + self.right
        a, b = self.right.split(rank - n, by)
        return self.left + a, b

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


def rearranged(text: str, key, seed: str = "1", plain: int = 10, spm: int = 20) -> tuple:
    """n, form, prefix_chars, middle_chars, output of a text; choices follow from ``seed`` and key alone."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    whole = Rope.of(text)
    n = whole.units
    if not text or h3 % 100 >= 100 - plain or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = whole.split(high)
    prefix, middle = head.split(low)
    p, s, m = (Rope(3, 3, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    out = s + suffix + p + prefix + m + middle if h4 % 100 < spm else p + prefix + s + suffix + m + middle
    return n, "spm" if h4 % 100 < spm else "psm", prefix.chars, middle.chars, str(out)


def restore(output: str, form: str) -> str | None:
    """The text that ``rearranged`` made output and form of; None if they fit no text.

    No part holds a sentinel, and none can arise where a part and a sentinel meet, so each is found once.
    """
    if form == "plain":
        return output
    if form not in ("psm", "spm"):
        return None
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    b = output.find(second)
    c = output.find(MIDDLE, b + 3)
    if not output.startswith(first) or b < 3 or c < 0 or any(output.count(s) != 1 for s in (PREFIX, SUFFIX, MIDDLE)):
        return None
    rest, middle = Rope.of(output).split(c, "chars")
    x, y = rest.split(b, "chars")
    x, y, middle = (t.split(3, "chars")[1] for t in (x, y, middle))
    return str(x + middle + y if form == "psm" else y + middle + x)


def fill_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``plain`` of a hundred texts stay as they are, ``spm`` of a hundred of the others start with the suffix. Null texts
    are empty; empty texts and those that hold a sentinel are plain. A null key counts as ''. Repeated
    rows come out alike, as nothing but seed and key decides; other columns are not read. No shuffle.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys, texts = part.column(0), part.column(1).to_pylist()
                n, form, a, b, out = zip(*(rearranged(t or "", k, seed, plain, spm) for k, t in zip(keys.to_pylist(), texts)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(long_key(docs, key), F.col(text)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """Adds the text that each row's output and form were made of; null where they fit none or one is null."""

    @F.arrow_udf("string")
    def back(o: pa.Array, f: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else restore(x, y) for x, y in zip(o.to_pylist(), f.to_pylist())], pa.string())

    return rows.withColumn(name, back(output, form))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS ws, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(ws) AS n, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS a, greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(ws[1:a], '') AS pre, array_to_string(ws[a + 1:b], '') AS mid, array_to_string(ws[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
