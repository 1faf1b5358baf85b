"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much go whole."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, slices

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = [b"|", b">", b"<", b"/", b"-", b"*", b"#"]
END_MARKS = b".!?:;\"')]"
BOILERPLATE = [
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "privacy policy", "read more", "sign up", "subscribe now", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "hier klicken", "jetzt abonnieren", "javascript aktivieren", "nutzungsbedingungen",
    "aceptar cookies", "haga clic aquí", "leer más", "política de privacidad", "todos los derechos reservados",
    "accepter les cookies", "cliquez ici", "conditions d'utilisation", "lire la suite", "tous droits réservés",
]
NAV_SHARE, SYMBOL_SHARE, SHORT_LINE, CAPITALS, LEAST_KEPT = 0.2, 0.3, 3, 10, 0.5

_phrase = re.compile("|".join(BOILERPLATE).encode())
_boiler = re.compile(("(?:^|[^a-z0-9])(?:" + "|".join(BOILERPLATE) + ")(?:[^a-z0-9]|$)").encode())
_small = bytes(range(97, 123))
_large = bytes(range(65, 91))


def line_fails(line: bytes, words: list[bytes]) -> str:
    """The rule that a line with words fails, or ''. Case is ASCII case.

    navigation: a fifth of its words are lone separators; symbols: 30 % of its words hold one of
    ``#*$%&|<>``; capitals: ten capitals or more and no small letter; boilerplate: one of the phrases as whole
    words (English, German, Spanish, French; accented letters small); punctuation: under three words and no end mark.
    """
    n = len(words)
    if sum(map(words.count, SEPARATORS)) >= NAV_SHARE * n:
        return "navigation"
    if len(line) != len(line.translate(None, SYMBOLS)) and sum(len(w) != len(w.translate(None, SYMBOLS)) for w in words) >= SYMBOL_SHARE * n:
        return "symbols"
    if len(line) == len(line.translate(None, _small)) and len(line) - len(line.translate(None, _large)) >= CAPITALS:
        return "capitals"
    if _phrase.search(low := line.lower()) and _boiler.search(low):
        return "boilerplate"
    if n < SHORT_LINE and words[-1][-1:] not in END_MARKS:
        return "punctuation"
    return ""


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` words (a power of two) which the text holds twice or more.

    Windows are numbered by doubling: equal pairs of numbers get equal numbers, so equality is exact.
    """
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    step = 1
    while step < size:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def judge(text: str | None) -> tuple:
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    words = raw.split()
    n = len(words)
    chars = sum(b & 0xC0 != 0x80 for b in raw) if not n else len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dups, kept_words, removed, out = set(), 0, 0, 0, []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        if line_fails(line, own):
            removed += 1
        else:
            kept_words += len(own)
            out.append(line)
    repeats = repeated_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    return n, chars if n else 0, symbols, dups, repeats, failed, not failed and kept_words >= LEAST_KEPT * n, removed, n - kept_words, b"\n".join(out)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed", "cleaned"]
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.binary()]


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """One row per input row, in one pass without a shuffle: doc_id, counts, base_failed, kept, cleaned text.

    Null or empty text: all counts 0, base_failed, not kept, cleaned ''. Lines without words are no lines.
    Repeated rows and null ids are kept as they come. Other columns are not read.
    """

    names = COLUMNS if with_text else COLUMNS[:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [judge(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)][: len(names)]
                if with_text:
                    columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    kinds = dict(zip(COLUMNS, ["long"] * 5 + ["boolean"] * 2 + ["long"] * 2 + ["string"]))
    return docs.select(long_key(docs, key), F.col(text)).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in names))


def oracle() -> str:
    """DuckDB SQL for the digest columns, written from the rules' wording."""
    boiler = "(^|[^a-z0-9])(" + "|".join(BOILERPLATE).replace("'", "''") + ")([^a-z0-9]|$)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, string_agg(x, ' ') OVER f AS s, count(*) OVER f AS n FROM pos
        WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win WHERE n = 8),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0,1,2,3,4,5,6,7]) AS u(k) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM ln),
judged AS (SELECT doc_id, line, len(ws) AS n,
  len(list_filter(ws, lambda x: x IN ('|','>','<','/','-','*','#'))) >= {NAV_SHARE} * len(ws)
  OR (regexp_matches(line, '[#*$%&|<>]') AND len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) >= {SYMBOL_SHARE} * len(ws))
  OR (NOT regexp_matches(line, '[a-z]') AND length(regexp_replace(line, '[^A-Z]', '', 'g')) >= {CAPITALS})
  OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{boiler}')
  OR (len(ws) < {SHORT_LINE} AND NOT regexp_matches(ws[-1], '[.!?:;"'')\]]$')) AS bad
  FROM lw WHERE len(ws) > 0),
lines AS (SELECT doc_id, sum(CASE WHEN bad THEN 0 ELSE n END) AS good, count(*) FILTER (bad) AS gone, count(*) - count(DISTINCT line) AS dups FROM judged GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n, length(array_to_string(ws, '')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS syms,
  coalesce(dups, 0) AS dups, coalesce(rep.n, 0) AS reps, coalesce(good, 0) AS good, coalesce(gone, 0) AS gone
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(syms AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(reps AS BIGINT) AS n_repeat_words,
  n < 20 OR 100 * reps > 30 * n AS base_failed, NOT (n < 20 OR 100 * reps > 30 * n) AND good >= {LEAST_KEPT} * n AS kept,
  CAST(gone AS BIGINT) AS n_lines_removed, CAST(n - good AS BIGINT) AS n_words_removed
FROM base"""
