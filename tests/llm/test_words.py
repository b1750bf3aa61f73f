"""Spelling variants, token files and periodic runs against brute force, and over rows with everything that goes wrong."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaylake.llm import periodic_runs, queries, spelling_variants, token_files

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every stretch that a period makes, with its least one."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        k = 0
        while k < len(words) - p:
            end = k
            while end < len(words) - p and words[end] == words[end + p]:
                end += 1
            if end + p - k >= max(6, 4 * p):
                found.setdefault((k, end + p), p)
            k = end + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=6)).map(lambda t: t[0] * t[1] + t[2]), min_size=1, max_size=5))
def test_runs_equal_all_periods(texts):
    codes, lengths = np.array(sum(texts, []), dtype=np.int64), np.array([len(t) for t in texts])
    for text, (first, stop, period) in zip(texts, periodic_runs.runs_of(codes, lengths), strict=True):
        assert list(zip(first, stop - first, period, strict=True)) == plain_runs(text)


def test_wrong_hashes_do_not_matter(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_values", lambda codes: np.zeros(len(codes), dtype=np.uint64))
    text = [1, 2, 3] * 5 + [4, 5, 6, 7] + [8] * 7
    first, stop, period = periodic_runs.runs_of(np.array(text), np.array([len(text)]))[0]
    assert list(zip(first, stop - first, period, strict=True)) == plain_runs(text) == [(0, 15, 3), (19, 7, 1)]


def test_runs_in_small_blocks_of_pairs(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_PAIRS", 7)
    text = [k % 5 for k in range(60)] + list(range(10, 40)) + [1] * 9
    first, stop, period = periodic_runs.runs_of(np.array(text), np.array([len(text)]))[0]
    assert list(zip(first, stop - first, period, strict=True)) == plain_runs(text)


def plain_op13(doc, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


ROWS = [(k, "the cat sat on a mat and saw it all again now " * (k % 4) + f"end {k}") for k in range(60)] + [
    (None, "x " * 9), (None, None), (71, None), (72, ""), (73, " \t\n"), (74, "a b " * 4 + "a"), (74, "a b " * 4 + "a"), (74, "z"), (75, "no break\x1cno break\u0085 " * 5), (76, "word " * 3_000 + "other"), (77, "u v w " * 5 + "v w u " * 5),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder whose only table has the rows above."""
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def as_rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_op13_equals_brute_force(spark, folder, empty_folder):
    found = queries.op13_periodic_runs(spark, folder)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert as_rows(found, *names) == Counter(plain_op13(*r) for r in ROWS)
    assert sum(r["n_runs"] > 0 for r in found.collect()) > 5
    assert queries.op13_periodic_runs(spark, empty_folder).count() == 0


def test_runs_keep_other_columns(clashing, nothing):
    docs = clashing.withColumn("RUNS", F.lit("old"))
    found = periodic_runs.find_runs(docs)
    assert found.columns == [*clashing.columns, "runs", "collapsed"] and found.count() == docs.count()
    assert {r["collapsed"] for r in found.where("text is null").collect()} == {""}
    assert periodic_runs.find_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(3, np.int64), np.array([3]), repeats=1)


# Spelling variants
def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def plain_variants(counts, ratio=5):
    forms = {}
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        best = min(near, default=None)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [n, len(near), -best[0] if forms[w] else None]
    rows = Counter()
    for w, (n, near, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows[w, forms[w], root, n, near, form_n] += 1
    return rows


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")
LETTERS = st.text(alphabet="abé", min_size=6, max_size=9)


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(LETTERS, st.integers(5, 900), min_size=1, max_size=60))
def test_variants_equal_all_pairs(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling_variants.variants(words), *VARIANT) == plain_variants(counts)


def test_crowded_letters_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "GROUP_WORDS", 7)
    counts = {f"com{'abcdefghij'[k % 10]}{'xyz'[k // 10 % 3]}{'mno'[k // 30]}ing": 5 + k * k for k in range(90)}
    counts |= {"comaxming": 9, "comxming": 50_000, "längewörtlich" * 2: 70, "längewörtlicx" + "längewörtlich": 8, "日本語の言葉です": 9, "日本語の言葉でず": 60, "日本語言葉です": 700}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling_variants.variants(words)
    assert as_rows(found, *VARIANT) == plain_variants(counts)
    most = spelling_variants._cells(words).groupBy("kind", "letters", "held", "scanned").count().agg(F.max("count")).first()[0]
    assert most <= 6 * 7


def test_a_long_chain_of_forms(spark):
    chain = {"a" * (6 + k): 5 * 5**k for k in range(9)}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r["root"] for r in spelling_variants.variants(words).collect()} == {"a" * 14}


def test_variants_of_odd_words(spark):
    rows = [("letters", 3), ("letters", 4), ("lettres", None), ("short", 90), (None, 8), ("letterz", 100)]
    words = spark.createDataFrame(rows, "word string, n long").withColumn("best", F.lit(1)).withColumn("root", F.lit("x"))
    assert as_rows(spelling_variants.variants(words), *VARIANT) == Counter([("letters", "letterz", "letterz", 7, 1, 100), ("letterz", None, "letterz", 100, 1, None)])
    assert spelling_variants.variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.variants(words, ratio=1)


def plain_op11(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    return plain_variants({w: n for w, n in counts.items() if n >= 5 and len(w) >= 6})


def test_op11_equals_brute_force(spark, tmp_path, empty_folder):
    rows = [(k, "Colour coloring Straße STRASSE königlich Königlich " * 40 + "colours " * (k % 3) + "ÉCLAIR x×y÷abcdef " + "harbour harbor " * (k % 2)) for k in range(120)]
    rows += [(None, "colour harbour"), (None, None), (500, ""), (501, None), (500, "harbour"), (500, "harbour")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_spelling_variants(spark, str(tmp_path))
    assert as_rows(found, *VARIANT) == plain_op11(rows)
    assert found.where("form is not null").count() >= 2
    assert queries.op11_spelling_variants(spark, empty_folder).count() == 0


def test_op11_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert as_rows(queries.op11_spelling_variants(spark, folder), *VARIANT) == plain_op11(rows)


# Token files
def plain_tokens(rows):
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(token_files.default_tokenizer()), 0, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        out.setdefault(doc, []).append((start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out, start


def hold_against_library(found, rows):
    """All that does not depend on the order of rows of one id is as the library has it; of one id, rows lie without gaps."""
    expected, total = plain_tokens(rows)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert got.keys() == expected.keys()
    for doc, parts in got.items():
        parts.sort()
        assert Counter(p[1:] for p in parts) == Counter(p[1:] for p in expected[doc])
        assert parts[0][0] == expected[doc][0][0] and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert sum(p[1] for parts in got.values() for p in parts) == total


def test_op12_equals_the_library(spark, folder, empty_folder):
    hold_against_library(queries.op12_token_files(spark, folder), ROWS)
    assert queries.op12_token_files(spark, empty_folder).count() == 0


@pytest.mark.parametrize("ids", [40, 1000])
def test_documents_longer_than_blocks(spark, folder, tmp_path, monkeypatch, ids):
    monkeypatch.setattr(token_files, "BLOCK_IDS", ids)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("shard", F.lit(1)).withColumn("ids", F.lit("x"))
    token_files.write(docs, f"{tmp_path}/files")
    hold_against_library(token_files.read(spark, f"{tmp_path}/files"), ROWS)


def test_op12_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    hold_against_library(queries.op12_token_files(spark, folder), rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé'stTre \t\n\x85\xa0\x1c\x00\x02²½µªß×ſĲĳ.,!?-_31İΣ😀\x01中́", max_size=25), max_size=4))
def test_word_encoder_equals_the_library(texts):
    encode = token_files.WordEncoder.of(token_files.default_tokenizer())
    assert encode.fast
    assert [x.tolist() for x in encode(texts)] == [encode.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 1_000_000, "\n\t" * 400_000 + "x", "ab'" * 100_000, "." * 200_000, "x<|endoftext|>y", "1" * 50_000])
def test_word_encoder_on_odd_texts(text):
    encode = token_files.WordEncoder.of(token_files.default_tokenizer())
    assert encode([text, "b"])[0].tolist() == encode.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(0, 40), max_size=600), st.integers(1, 9), st.integers(1, 7))
def test_coder_round_trip(power, ids, lanes, steps):
    ids = np.array([i**power for i in ids], dtype=np.uint32)
    table = token_files.Frequencies(*np.unique(ids, return_counts=True))
    assert not len(ids) or table.frequency.sum() == 1 << token_files.SCALE_BITS and table.frequency.min() >= 1
    words, states, first = token_files.encode_ids(ids, table, lanes, steps)
    if len(ids):
        assert (token_files.decode_ids(len(ids), words, states, first, table, steps) == ids).all()


def test_a_stretch_decodes_alone_and_damage_is_told():
    draw = np.random.default_rng(5)
    ids = np.minimum(draw.zipf(1.2, 5_000), 3_000).astype(np.uint32)
    table = token_files.Frequencies(*np.unique(ids, return_counts=True))
    words, states, first = token_files.encode_ids(ids, table, 8, 100)
    assert len(states) == 7
    last = token_files.decode_ids(5_000 - 6 * 800, words[first[6] :], states[6:], np.zeros(1, np.int64), table, 100)
    assert (last == ids[4_800:]).all()
    entropy = -sum(c / 5_000 * np.log2(c / 5_000) for c in np.unique(ids, return_counts=True)[1])
    assert 32 * len(words) / 5_000 < 1.02 * entropy + 0.1
    block = token_files.write_block(ids, b"index", table)
    assert (token_files.read_block(block, table)[0] == ids).all()
    for place in range(0, len(block), 97):
        bad = bytearray(block)
        bad[place] ^= 4
        with pytest.raises(token_files.FileError):
            token_files.read_block(bytes(bad), table)
    other = token_files.Frequencies(table.ids, np.ones(len(table.ids)))
    with pytest.raises(token_files.FileError):
        token_files.read_block(block, other)
    with pytest.raises(token_files.FileError):
        token_files.encode_ids(np.array([9_999], np.uint32), table)


@given(st.binary(max_size=40), st.binary(max_size=40))
def test_checksums_of_parts(a, b):
    assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
