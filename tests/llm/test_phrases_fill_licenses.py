"""Collocations, fill-in-the-middle and license scans against brute force, on odd rows and on sf0.001."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import fill_middle, license_scan, phrases, registry
from lamina.llm.common import WordHashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, form string, phrase string, score double, part int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "f", "p", 0.5, 2) for i, t, lang in rows], SCHEMA)


# --- fill in the middle


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)


def by_lists(key, text):
    u, h = units(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "a", "\n", "<", "<P", "x<P>y", "<M>", "<<SS>>", "P><S", "ab" * 9000, "a b" * 9000, "ä\x00é<中😀 文" * 700, "\r\n\t", "word " * 5, "x" * 5000 + "." + "y" * 5000]


def test_fill_rows(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD * 12)] + [(None, "null key", None)] * 2 + [(3, "a", "en")]
    got = fill_middle.restored(fill_middle.fill_middle(frame(spark, rows))).collect()
    want = Counter((k, *by_lists(k, t or ""), t or "") for k, t, _ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(frame(spark, [])).collect() == []


def test_rope_splits_anywhere():
    r = random.Random(5)
    for n in (0, 1, 7, 200, 3000):
        text = "".join(r.choice("abZ .\n<>PSMé😀") for _ in range(n))
        rope, u = fill_middle.Rope.of(text, leaf=16), units(text)
        assert (str(rope), rope.units, rope.chars) == (text, len(u), len(text))
        for k in {0, 1, len(u) // 3, len(u) - 1, len(u), len(u) + 5}:
            a, b = rope.split(k)
            assert (str(a), str(b)) == ("".join(u[: max(k, 0)]), "".join(u[max(k, 0) :])) and a.units + b.units == len(u)
            assert str(a + b) == text and str(b + a) == str(b) + str(a)
        for k in (0, n // 2, n):
            assert tuple(map(str, rope.split(k, "chars"))) == (text[:k], text[k:])


def test_restore_refuses_what_fits_no_text():
    for out, form in [("<P>a<S>b", "psm"), ("a<P><S><M>", "psm"), ("<P>a<S>b<M>c", "spm"), ("<P>a<S>b<M>c", "other"), ("<P>a<S>b<M>c<M>", "psm"), ("<M><P><S>", "psm"), ("", "psm")]:
        assert fill_middle.restore(out, form) is None
    assert fill_middle.restore("<P>a<S>b<M>c", "psm") == "acb" and fill_middle.restore("<S>b<P>a<M>c", "spm") == "acb"


def test_fill_query(spark, documents):
    df = registry.QUERIES["op12_fill_middle"](spark, SF)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(r["doc_id"], *(w := by_lists(r["doc_id"], r["text"] or ""))[:4], sha(w[4]), sha(r["text"] or "")) for r in documents}
    assert {tuple(r) for r in df.collect()} == want
    assert df.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]


# --- licenses


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_by_words(text):
    w, places = plain_words(text), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def labels_by_distance(text):
    """Labels of notices that some stretch of the words' line differs from by few edits: dynamic programming over the whole line."""
    w, out = plain_words(text), set()
    line = np.frombuffer(" ".join(w).encode("utf-32-le"), "<u4")
    for label, notice in license_scan.NOTICES:
        row = list(range(len(notice) + 1))
        least = row[-1]
        for c in line.tolist():
            new = [0]
            for j, x in enumerate(notice, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != ord(x))))
            row = new
            least = min(least, row[-1])
        if least <= license_scan.edits(notice):
            out.add(label)
    return out


def mutated(text, n, r):
    for _ in range(n):
        i, kind = r.randrange(1, len(text) - 1), r.randrange(3)
        text = text[:i] + ("" if kind == 0 else r.choice("qzjk")) + text[i + (kind != 1) :]
    return text


def test_license_rows(spark):
    r = random.Random(9)
    texts = [None, "", " .,\x00", "MIT License", "the Mit\n  licensE, mit-license; APACHE LICENSE", "mit licenses", "xmit license", "General public\tLicense general public license", "émit license", "Released under the MIT Licence.", "Licensed under the Apche License, Version 2.0", "ä " * 3000 + "mit license", "released under " * 400 + "mit license", "mit license " * 3000]
    for label, notice in license_scan.NOTICES:
        for extra in (0, 1):
            texts.append(f"word ä {mutated(notice, license_scan.edits(notice) + 3 * extra, r).upper()}! other words follow here")
        texts.append(notice[: len(notice) // 2] + " something else entirely")
    got = license_scan.license_scan(frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, "mit license", None)] * 2)).collect()
    assert sum(x["doc_id"] is None and x["n_base"] == 1 for x in got) == 2
    for x in got:
        if x["doc_id"] is None:
            continue
        t = texts[x["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base_by_words(t)
        base = set(filter(None, x["base_labels"].split(",")))
        if t is None or len(t) < 4000:
            assert set(filter(None, x["labels"].split(","))) == base | labels_by_distance(t)
        assert x["labels"] == ",".join(sorted(base | {s["label"] for s in x["spans"]}))
        best = 1.0 if base else max((s["similarity"] for s in x["spans"]), default=0.0)
        assert x["score"] == best and 0 <= best <= 1
        for s in x["spans"]:
            own = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
            assert (s["start"], s["end"]) == (own[s["first_word"]][0], own[s["last_word"]][1]) and s["edits"] <= license_scan.MOST_EDITS
    assert license_scan.license_scan(frame(spark, [])).collect() == []


def test_pieces_cover_notices():
    for _, notice in license_scan.NOTICES:
        parts = license_scan.pieces(notice)
        assert len(parts) == license_scan.edits(notice) + 1 and "".join(p for _, p in parts) == notice and all(notice[a:].startswith(p) for a, p in parts)


def test_license_query(spark, documents):
    df = registry.QUERIES["op13_license_scan"](spark, SF)
    assert df.dtypes[:8] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    got = {r["doc_id"]: r for r in df.collect()}
    assert sorted(got) == [r["doc_id"] for r in documents]
    for r in documents:
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base_by_words(r["text"])
        base = set(filter(None, x["base_labels"].split(",")))
        line = " ".join(plain_words(r["text"]))
        if any(p in line for _, n in license_scan.NOTICES for _, p in license_scan.pieces(n)) and len(line) < 3000:
            assert set(filter(None, x["labels"].split(","))) == base | labels_by_distance(r["text"])
        elif not base and not any(p in line for _, n in license_scan.NOTICES for _, p in license_scan.pieces(n)):
            assert x["labels"] == "" and x["score"] == 0


# --- collocations


def mined(rows, least, longest, top, percent):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = set()
    for lang in n:
        cand = {p: c for (x, p), c in f.items() if x == lang and len(p) > 1 and c >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= percent * a for q, c in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, _, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p, -a, l, r, n[lang], -score))
    return out


def odd_phrases():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdef") + r.choice(["", "", ".", "\t"]) for _ in range(60)), ["en", None, "und", ""][i % 4]) for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n", "fr"), (103, "x y z w " * 400, "de"), (104, "A\x00b ÄÖ\x1f ÄÖ A\x00B", "de"), (105, "one\rtwo", "es"), (None, "a b c d", "en")]
    return rows + rows[:2]


@pytest.mark.parametrize(("least", "longest", "top", "percent"), [(3, 4, 2000, 80), (1, 2, 5, 80), (2, 5, 9, 50)])
def test_phrases_rows(spark, least, longest, top, percent):
    rows = odd_phrases()
    got = phrases.collocations(frame(spark, rows).repartition(5), least=least, longest=longest, top=top, percent=percent)
    assert {tuple(x) for x in got.collect()} == mined(rows, least, longest, top, percent)


def test_phrases_without_words(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, " . ", "en")])).collect() == []


def test_ranks_by_shares(spark):
    rows = spark.createDataFrame([("en" if i % 9 else "de", f"p{i}", i % 7, 1, 1, i % 5) for i in range(500)], "lang string, phrase string, a long, l long, r long, score long")
    one = {tuple(r) for r in phrases.best(rows, 20, 500).collect()}
    assert one == {tuple(r) for r in phrases.best(rows, 20, 2_000_000).collect()} and len(one) == 40


def test_sketch_loses_nothing_frequent(spark):
    """In a sketch far too narrow every frequent run still passes, whatever the partitions."""
    rows = odd_phrases()
    docs = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    wide, narrow = (phrases.sketch(docs.repartition(p), phrases.BLOCK, 3, 4) for p in (7, 2))
    assert (wide == narrow).all() and 0 < wide.sum()
    f = {(x["lang"], x["phrase"]): x["f"] for x in phrases.frequent(docs, 1, 4).collect() if x["phrase"]}
    hashes = WordHashes(seed=11)
    for (lang, phrase), n in f.items():
        if n >= 3:
            g = phrases.Grams(lang, phrase.encode().split(b" "), hashes)
            *_, (_, can, h) = g.sizes(len(g.ids))
            assert can.all() and phrases.survivors(wide, h).all()


def test_sketch_keeps_its_share_of_cells(spark, monkeypatch):
    """Six times the text without a frequent run: no more of its runs pass the sketches, and tasks hold no whole sketch."""
    asked = []
    monkeypatch.setattr(phrases, "LEAST_CELLS", phrases.BLOCK)
    monkeypatch.setattr(phrases, "HELD", 1 << 12)
    real = phrases.sketch
    monkeypatch.setattr(phrases, "sketch", lambda docs, width, *more: asked.append((docs, width, real(docs, width, *more))) or asked[-1][2])
    share = []
    for n in (1_000, 6_000):
        rows = [(i, " ".join(f"w{(i * 200 + j) * 7919 % 10_000_019:08}" for j in range(200)) + " in the end" * 2, "en") for i in range(n)]
        docs = frame(spark, rows).select("lang", "text").repartition(7)
        got = {x["phrase"]: x["f"] for x in phrases.frequent(docs, 30, 4).collect()}
        assert got.pop("") == n * 206 and got["in the end in"] == n and len(got) == 12
        (docs, width, short), (_, _, long) = asked[-2:]
        assert docs.rdd.getNumPartitions() == 7
        share.append(width / (n * 2000))
        assert np.unpackbits(short).sum() <= 2 * 6 and np.unpackbits(long).sum() <= 2 * 6
    assert share[1] >= share[0] / 2
