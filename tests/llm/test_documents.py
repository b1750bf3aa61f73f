"""Operators over documents against brute force, and over rows with everything that goes wrong."""

from __future__ import annotations

import importlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from assaylake.llm import elias_fano, language, mixing, ngram_lm, order_minhash, packing, queries, simhash, toxicity
from assaylake.llm._common import crc_mod
from assaylake.llm.components import components


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def plain_simhash(text) -> int:
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_equals_brute_force(docs, corpus):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(corpus)
    prints = {(r[0], plain_simhash(r[1])) for r in corpus}
    assert {(r.doc_id, r.fp % (1 << 64)) for r in found} == prints
    ids = sorted({d for d, _ in prints if d is not None})
    links = [(a, b) for a, x in prints for b, y in prints if None not in (a, b) and bin(x ^ y).count("1") <= 3]
    label = reach(links, ids)
    assert all(r.component_id == (None if r.doc_id is None else label[r.doc_id]) for r in found)


def test_simhash_links_every_close_pair_of_a_dense_cluster(spark):
    draw = np.random.default_rng(5)
    centre = int(draw.integers(0, 1 << 63))
    values = {centre}
    while len(values) < 900:  # a walk of few bits each, and far-away ones
        base = centre if draw.random() < 0.7 else int(draw.choice(np.array(list(values), dtype=np.uint64)))
        for bit in draw.integers(0, 64, size=draw.integers(1, 5)):
            base ^= 1 << int(bit)
        values.add(base)
    values |= {int(x) for x in draw.integers(0, 1 << 63, size=300)}
    order = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in order]
    rows = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, rep long")
    array = np.array(order, dtype=np.uint64)
    near = [(i, int(j)) for i in range(len(order)) for j in i + 1 + np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3)]
    want = reach(near, range(len(order)))
    for blocks in (None, 5, 6):  # more blocks file a fingerprint more often, in shorter top nodes
        got = {r.node: r.label for r in components(simhash.links(rows, blocks=blocks)).collect()}
        assert all(got.get(i, i) == want[i] for i in range(len(order)))


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**11)] == [4, 4, 5, 6]
    for blocks, nodes in ((4, 4), (5, 10), (6, 20)):
        masks = simhash._top_nodes(blocks, 3)
        assert len(masks) == len(set(masks)) == nodes and all(0 < m < 1 << 64 for m in masks)


def test_wide_radius_links_every_close_pair(spark):
    draw = np.random.default_rng(8)
    values = [int(x) for x in draw.integers(0, 1 << 63, size=40)]
    for _ in range(700):
        base = values[int(draw.integers(0, len(values)))]
        for bit in draw.integers(0, 64, size=draw.integers(1, 10)):
            base ^= 1 << int(bit)
        values.append(base)
    order = sorted(set(values))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in order]
    rows = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, rep long")
    array = np.array(order, dtype=np.uint64)
    near = [(i, int(j)) for i in range(len(order)) for j in i + 1 + np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 7)]
    want = reach(near, range(len(order)))
    edges = simhash.links(rows, 7, checked=True)
    assert all(bin(order[r.a] ^ order[r.b]).count("1") <= 7 for r in edges.collect())
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got.get(i, i) == want[i] for i in range(len(order)))
    with pytest.raises(ValueError, match="radius"):
        simhash.links(rows, 8, blocks=8)


def test_similar_documents_hold_the_similarity(spark):
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(5000)}"
    base = [[word() for _ in range(300)] for _ in range(30)]
    rows, group = [], []
    for g, w in enumerate(base):
        rows.append(" ".join(w))
        group.append(g)
        for _ in range(3):  # few changed words
            near = list(w)
            for _ in range(draw.randint(0, 4)):
                near[draw.randrange(300)] = word()
            rows.append("  ".join(near).upper())
            group.append(g)
        rows.append(" ".join(reversed(w)))  # the same words in another order are another document
        group.append(f"reversed {g}")
        if g % 10 == 0:
            rows.append(" ".join(sorted(word() for _ in range(200))))
            rows.append(" ".join(reversed(rows[-1].split())))
            group += [f"one order {g}", f"other order {g}"]
    rows += ["", None, "\n", "one", "ONE ", "one two"]
    group += ["none"] * 3 + ["one"] * 2 + ["two"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)] + [(None, "x", 1), (0, rows[0], 1)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    first = {g: group.index(g) for g in group}
    assert got == {i: first[g] for i, g in enumerate(group)}
    kept = [r.doc_id for r in simhash.deduplicate(docs, similarity=0.8).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(first.values()) and kept.count(None) == 1
    assert simhash.similar_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 30, 146, 900])
def test_sketches_never_part_more_than_sets_do(size):
    draw = np.random.default_rng(size)
    for _ in range(50):
        a = draw.integers(0, 1 << 32, size, dtype=np.uint32)
        b = np.concatenate([a[draw.integers(0, size) :], draw.integers(0, 1 << 32, draw.integers(1, 40), dtype=np.uint32)])
        far = int(np.bitwise_count(simhash.sketch(np.unique(a)) ^ simhash.sketch(np.unique(b))).sum())
        assert far <= len(np.setxor1d(a, b))


def similar_classes(rows, similarity=0.8):
    """The classes by brute force over all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return reach(near, range(len(rows)))


def test_similar_documents_equal_brute_force_over_one_vocabulary(spark):
    """Texts over the same words: every pair is a candidate by words, and those of 0.8 lie among many false ones."""
    draw = random.Random(4)
    vocabulary = [f"v{i}" for i in range(120)]
    rows = []
    for _ in range(60):
        w = draw.sample(vocabulary, 120)
        near = list(w)
        for k in draw.sample(range(0, 116), 2):
            near[k], near[k + 1] = near[k + 1], near[k]
        rows += [" ".join(w), " ".join(near)]
    want = similar_classes(rows)
    assert sum(want[i] != i for i in want) > 30
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def test_similar_documents_find_pairs_of_least_similarity(spark):
    """Words changed here and there until the similarity is just 0.8, a shared passage, and each text again in another order."""
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(30):
        w = [word() for _ in range(300 if g % 3 else 40)] + (passage if g % 2 else [])
        rows.append(" ".join(w))
        for changes in (2, 5, 6, 7):
            near = list(w)
            for _ in range(changes if g % 3 else changes // 3):
                near[draw.randrange(len(near))] = word()
            rows.append("  ".join(near).upper())
        rows.append(" ".join(sorted(w)))
    rows += ["", None, "one", "ONE ", "one two"]
    want = similar_classes(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 9), (7, 8), (8, 7), (100, 50), (50, 25), (None, 3)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 100: 25, 50: 25, 25: 25} | dict.fromkeys(range(200, 261), 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_shuffles(spark, monkeypatch):
    parts = importlib.import_module("assaylake.llm.components")
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(10).select(F.lit(1000), F.col("id") + 2000))
    right = dict.fromkeys(range(401), 0) | dict.fromkeys([1000, *range(2000, 2010)], 1000)
    rounds, step = [], parts._contracted
    monkeypatch.setattr(parts, "_contracted", lambda edges: rounds.append(step(edges)) or rounds[-1])
    assert {r.node: r.label for r in parts.components(chain.repartition(7)).collect()} == right
    assert not rounds  # a few written edges are contracted where they are read
    monkeypatch.setattr(parts, "_forests", lambda edges: edges)
    found = parts.components(chain).collect()
    assert rounds and {r.node: r.label for r in found} == right and len(found) == len(right)


def test_deduplicate_keeps_one_of_each_group(docs, clashing):
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 63 not in ids and ids.count(None) == 1 and len(ids) == len(set(ids))


def test_mix_cuts_each_source_at_its_budget(docs, corpus, clashing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    sizes: dict = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share out until none is above its cap
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target = {s: 3.0 * sizes[s] for s in capped} | share
        if not over:
            break
        capped |= over
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(r.mix_size <= 3 * sizes[s] and r.mix_taken <= 3 * r.mix_size for r in mine)
        assert mine[0].mix_target == pytest.approx(target[s])
        assert sum(r.mix_taken for r in mine) == math.floor(target[s] + 0.5)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.apply_mix(clashing)
    assert mixed.columns == clashing.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.mix_taken for r in rows)


def test_packing_covers_every_id_once(docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, sequence_tokens=64).collect()
    want = Counter()
    for r in corpus:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r[0], int(i), int(x), len(ids)) for i, x in enumerate(ids))
    ids_of = {}
    for r in corpus:
        ids_of.setdefault(r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    got = Counter()
    for p in pieces:
        piece = ids_of[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(piece.tobytes()) == p.ids_crc32 and len(piece) == p.length
        got.update((p.doc_id, p.start + i, int(x), p.doc_tokens) for i, x in enumerate(piece))
    assert got == want
    by: dict = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_packing_does_not_depend_on_partitions_and_keeps_to_its_columns(docs, clashing):
    rows = sorted(map(tuple, packing.pack(docs, sequence_tokens=64).collect()), key=str)
    assert rows == sorted(map(tuple, packing.pack(clashing.repartition(7), sequence_tokens=64).collect()), key=str)


def test_pack_window_balances_cost():
    placed = packing.pack_window([100] * 20 + [40] * 20, 200)
    assert sum(t for _, _, t, _, _ in placed) == 2800
    cost: dict = {}
    for _, _, tokens, k, _ in placed:
        cost[k] = cost.get(k, 0) + tokens + tokens * tokens / 1024
    full = [c for k, c in cost.items() if k < 14]
    assert max(full) - min(full) < 25


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, draw = Tokenizer.from_file(path), random.Random(6)
    texts = ["", "Hello world's  x\n\n y", "café ²½ 12_3 ͡ \x1c end ", "日本語 text 😀", "a" * 3000, " <|endoftext|> ", "<|endoftext|><|endoftext|>x<|endoftext", "\u0085\u00a0\u2028 \u3000a", "don't I'LL we've\t\t1'5"]
    texts += ["".join(chr(draw.choice((draw.randrange(32, 127), draw.randrange(1, 0x3000), draw.randrange(0x10000, 0x1FFFF)))) for _ in range(200)) for _ in range(200)]
    for encode in (packing.TextEncoder.of(path), packing.TextEncoder(path)):
        assert all(encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)
        encode.plain = encode._library(path, False)  # as for a file whose ids do not follow its merges
        assert all(encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts[:20])
    packing.TextEncoder._made.clear()


def test_packing_gives_added_tokens_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "one  <|endoftext|>two's <|endoftext", "x"]
    pieces = packing.cut_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for p in pieces:
        ids = [*whole.encode(texts[p.doc_id], add_special_tokens=False).ids, packing.END_ID]
        assert packing._ids(p.ids).tolist() == ids and p.doc_tokens == len(ids)
    assert 50256 in packing._ids(next(p.ids for p in pieces if p.doc_id == 0))


def test_language_models_tell_and_reject(docs, corpus, clashing, nothing):
    models = language.fit(docs)
    found = language.identify(clashing, models)
    rows = {r.doc_id: r for r in found.collect()}
    assert all(rows[i].lang_pred == corpus[i][2] and not rows[i].lang_rejected for i in range(60))
    for i in (60, 61, 62, 65):
        assert rows[i].lang_pred == "und" and rows[i].lang_score == 0 and rows[i].lang_rejected
    assert rows[66].lang_pred in ("en", "de")
    assert language.identify(docs, language.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(nothing, models).count() == 0


def test_letters():
    text = lambda t: "".join(map(chr, language.letters(t)))
    assert text("😀 !") == text("12 ² \n") == text(None) == "" and text(" Ab😀\n\nÇd1e ") == "ab çd e" and text("\U00010400x") == "\U00010428x"


def test_kneser_ney_probabilities_sum_to_one():
    models = language.LanguageModels({"x": ["abca bcab cabb"] * 4, "y": ["zzxx zxzx"] * 4}, 3)
    letters = sorted({*"abczx "})
    context = language.letters("ab")
    total = 0.0
    for c in letters:
        padded = np.concatenate([np.full(2, 32, np.uint32), context, np.array([ord(c)], np.uint32)])
        total += math.exp(models._logs(padded)[-1, 0])
    assert 0.9 < total <= 1.0 + 1e-4  # what is left belongs to letters that were never seen


def test_entropy_does_not_depend_on_the_chunk(monkeypatch):
    models = language.LanguageModels({"x": ["the river and the stone"] * 5, "y": ["der fluss und der stein"] * 5})
    texts = [language.letters(t) for t in ("the river " * 50, "", "der", "und " * 7)]
    whole = models.entropies(texts)[0]
    monkeypatch.setattr(language, "CHUNK", 16)
    assert np.allclose(models.entropies(texts)[0], whole, atol=1e-5)


def test_toxicity_finds_words_and_stems():
    clean = [f"the river and the stone number {i} under green light" for i in range(40)]
    toxic = [f"the river is a {w} of stone {i} under light" for i, w in enumerate(["scumbag", "grublak", "grublon", "grublir"] * 10)]
    model = toxicity.train(clean + toxic, [0] * 40 + [1] * 40)
    scores = model.word_scores()
    assert toxicity.score("what a grublest of green light", scores, model) >= 0.7 > toxicity.score("the green river of light", scores, model)
    assert toxicity.score(None, scores, model) == toxicity.score("", scores, model) < 0.7


def test_counterfactuals_reduce_the_weight_of_group_names():
    labels, texts = [], []
    for i in range(120):
        group, bad = ("muslims" if i % 4 < 2 else "stone"), i % 4 in (0, 3)
        texts.append(f"the {group} walk under light {'grublak' if bad and i % 8 else ''} {i % 5}")
        labels.append(int(bad or (group == "muslims" and i % 5 == 0)))
    free, held = (toxicity.train(texts, labels, counterfactual=c).weights.get("muslims", 0.0) for c in (0.0, 50.0))
    assert abs(held) < abs(free)


def test_toxicity_handles_odd_rows(docs, corpus, clashing, spark):
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)] + [(3, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, learn=crc_mod("doc_id", 3) != 1)
    scored = toxicity.classify(clashing, model).collect()
    assert len(scored) == len(corpus) and all(0 <= r.toxicity <= 1 for r in scored)
    assert toxicity.fit(docs, labels.limit(0)).weights == {}


def test_language_model_scores_equal_brute_force(docs, corpus, monkeypatch):
    rows = {r.doc_id: r for r in ngram_lm.score_texts(docs, crc_mod("doc_id", 10) != 0).collect()}
    unigrams, pairs, triples = Counter(), Counter(), Counter()
    tokens = {}
    for d, text, *_ in corpus:
        w = [*words(text), b"\n"]
        tokens[d] = w
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            unigrams.update(w)
            s = [b"\n", *w]
            pairs.update(zip(s, s[1:], strict=False))
            triples.update(zip(s, s[1:], s[2:], strict=False))
    n, v, cut = sum(unigrams.values()), len(unigrams), ngram_lm.DISCOUNT
    mass2, mass3 = Counter(), Counter()
    for (a, _), c in pairs.items():
        mass2[a] += c - cut if c >= 2 else 0
    for (a, b, _), c in triples.items():
        mass3[a, b] += c - cut if c >= 2 else 0
    for d, w in tokens.items():
        base = score = 0.0
        s = [b"\n", *w]
        for k in range(1, len(s)):
            u, x = s[k - 1], s[k]
            p = (unigrams[x] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            p = ((pairs[u, x] - cut) / unigrams[u] if pairs[u, x] >= 2 else 0) + (1 - mass2[u] / unigrams[u] if unigrams[u] else 1) * p
            if k > 1 and pairs[s[k - 2], u] >= 2:
                c = triples[s[k - 2], u, x]
                p = ((c - cut) / pairs[s[k - 2], u] if c >= 2 else 0) + (1 - mass3[s[k - 2], u] / pairs[s[k - 2], u]) * p
            score += math.log10(p)
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(t in unigrams for t in w), n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert abs(r.score - score) <= 0.06 * len(w)


def test_language_model_keeps_what_occurs_once(spark, tmp_path):
    """A held-out copy of a text of one training document is scored by its pairs and triples."""
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(200) if not zlib.crc32(str(i).encode()) % 10)
    rows = [(i, " ".join(f"w{(i * 37 + k * (i + 1)) % 101}" for k in range(30))) for i in learnt[:8]]
    spark.createDataFrame([*rows, (held, rows[0][1])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_ngram_lm(spark, str(tmp_path)).collect()}[held]
    train = [[*words(t), b"\n"] for _, t in rows]
    unigrams, pairs, triples = Counter(w for t in train for w in t), Counter(), Counter()
    for t in train:
        pairs.update(zip([b"\n", *t], t, strict=False))
        triples.update(zip([b"\n", *t], t, t[1:], strict=False))
    off = lambda c: c - (0.7 if c == 1 else 1.3) if c else 0
    mass2, mass3 = Counter(), Counter()
    for (a, _), c in pairs.items():
        mass2[a] += off(c)
    for (a, b, _), c in triples.items():
        mass3[a, b] += off(c)
    n, v, s, score = sum(unigrams.values()), len(unigrams), [b"\n", *train[0]], 0.0
    for k in range(1, len(s)):
        u, x = s[k - 1], s[k]
        p = off(pairs[u, x]) / unigrams[u] + (1 - mass2[u] / unigrams[u]) * (unigrams[x] + 0.1) / (n + 0.1 * (v + 1))
        if k > 1:
            c = pairs[s[k - 2], u]
            p = off(triples[s[k - 2], u, x]) / c + (1 - mass3[s[k - 2], u] / c) * p
        score += math.log10(p)
    assert got.held_out and abs(got.score - score) <= 0.06 * len(train[0])


def test_language_model_of_nothing(nothing, docs):
    assert ngram_lm.score_texts(nothing, F.lit(True)).count() == 0
    none = ngram_lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in none)


def test_language_model_of_more_shards_than_words(docs, corpus, spark, monkeypatch):
    learn = crc_mod("doc_id", 10) != 0
    few = {str(r.doc_id): r for r in ngram_lm.score_texts(docs, learn).collect()}
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 200)
    many = ngram_lm.score_texts(docs, learn).collect()
    assert len(many) == len(corpus)
    for r in many:
        one = few[str(r.doc_id)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (one.n_tokens, one.n_known, one.train_tokens)
        assert r.base_score == pytest.approx(one.base_score) and abs(r.score - one.score) <= 0.06 * r.n_tokens


def test_language_model_of_empty_texts(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(6)], "doc_id long, text string").coalesce(1)
    found = ngram_lm.score_texts(rows, F.lit(True)).collect()
    assert len(found) == 6 and all((r.n_tokens, r.n_known, r.train_tokens) == (1, 1, 6) for r in found)


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (1, 1 << 45), (500, 500), (700, 1 << 20), (5000, 1 << 50)])
def test_elias_fano_access_and_successor(n, universe, tmp_path):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, universe, n, dtype=np.uint64)) if n != universe else np.arange(n, dtype=np.uint64)
    elias_fano.EliasFano.build(values, universe).save(str(tmp_path / "x"))
    mapped = elias_fano.EliasFano.open(str(tmp_path / "x"))
    assert (mapped.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, draw.integers(0, universe, 300, dtype=np.uint64)])
    place, equal = mapped.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_quantised_probabilities_round_down():
    p = np.array([1.0, 0.5, 1e-3, 1e-9, 1e-30])
    q = elias_fano.dequantise(elias_fano.quantise(p))
    assert (q[:4] <= p[:4] * (1 + 1e-9)).all() and (q[:4] > 0.9 * p[:4]).all() and q[4] > 0
    assert elias_fano.dequantise(np.zeros(1, np.uint8))[0] == 0


def plain_signature(text):
    """Slot by slot: the two k-mers that come first from the begin of the slot on."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
    seen: Counter = Counter()
    kmers = []
    for at in range(max(1, len(tokens) - 1) if tokens else 0):
        h = 42
        for token in tokens[at : at + 2]:
            h = xxhash.xxh64_intdigest(token.encode(), h)
        h -= (h >> 63) << 64
        part = (h >> 31).to_bytes(8, "little", signed=True)
        numbered = xxhash.xxh64_intdigest(seen[part].to_bytes(4, "little"), xxhash.xxh64_intdigest(part, 42))
        seen[part] += 1
        kmers.append(((numbered - ((numbered >> 63) << 64)) >> 31, at))
    out = []
    for slot in range(64 if kmers else 0):
        begin = (slot - 32) << 27
        chosen = sorted(kmers, key=lambda k: ((k[0] - begin) % (1 << 33), k[1]))[:2]
        h = 42
        for value, _ in sorted(chosen, key=lambda k: k[1]):
            h = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), h)
        out.append(h & 0xFFFF)
    return out


def signatures(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", order_minhash.signature(F.col("text")).alias("s"))
    return [r.s for r in sorted(rows.collect())]


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / 64


def test_order_minhash_equals_brute_force(spark, corpus):
    texts = [r[1] for r in corpus if len(r[1] or "") < 1000] + ["one", "one one", "one one one one one", "a b a b a b", "länger 😀 als acht"]
    assert signatures(spark, texts) == [plain_signature(t) for t in texts]


@pytest.mark.parametrize("n", [20, 40, 80, 400])
def test_order_minhash_keeps_order_at_every_length(spark, n):
    draw = random.Random(n)
    texts = [[f"w{draw.randrange(10**6)}" for _ in range(n)] for _ in range(60)]
    swapped = [t[n // 2 :] + t[: n // 2] for t in texts]
    changed = [[*t[:-1], "other"] for t in texts]
    found = signatures(spark, [" ".join(t) for t in texts + swapped + changed])
    assert 0.35 < np.mean([alike(a, b) for a, b in zip(found[:60], found[60:120], strict=True)]) < 0.6
    assert np.mean([alike(a, b) for a, b in zip(found[:60], found[120:], strict=True)]) > 1 - 5 / n  # a change takes a k-mer of two and gives one
    assert np.mean([alike(a, b) for a, b in zip(found[:59], found[1:60], strict=True)]) < 0.05


def test_order_minhash_follows_order_and_edits(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:300] + [f"v{i}" for i in range(100)]), " ".join(f"u{i}" for i in range(400)), "", None, "one one one one", "one one"]
    s = signatures(spark, texts)
    assert s[3] == s[4] == [] and s[5] != s[6]
    assert alike(s[0], s[1]) > 0.2 > 0.05 > alike(s[0], s[2])


def test_rows_of_one_id_are_dealt_over_many_ranges(spark):
    rows = spark.createDataFrame([(i if i % 3 else None, f"text {i}") for i in range(600)], "doc_id long, text string").withColumn("led_key", F.lit(1))
    found = order_minhash.with_next(rows, "doc_id", "text", {"size": F.length("text")}).select("doc_id", "text", "next_text", "next_led_key", "next_size").collect()
    following = {r.text: r.next_text for r in found}
    assert len(found) == len(following) == 600 and all(r.next_led_key == 1 and r.next_size == len(r.next_text) for r in found)
    lowest = -(1 << 63)
    placed = rows.select("doc_id", order_minhash._place(F.coalesce("doc_id", F.lit(lowest)), F.xxhash64("text"), [lowest, lowest, lowest, 100, 300]).alias("range"))
    ranges = Counter((r.range, r.doc_id is None) for r in placed.collect())
    assert {r for r, null in ranges if null} == {0, 1, 2} and {r for r, null in ranges if not null} == {3, 4, 5} and min(ranges.values()) > 40
    walk, at = [], "text 1"
    for _ in range(600):
        walk.append(int(at.split()[1]))
        at = following[at]
    assert at == "text 1" and [i for i in walk if i % 3] == [i for i in range(600) if i % 3] and all(i % 3 == 0 for i in walk[400:])


def test_order_minhash_edits_with_the_next_document(docs, corpus, nothing, spark):
    rows = order_minhash.fingerprint_with_edits(docs).collect()
    assert len(rows) == len(corpus)
    unique = sorted({r[0] for r in corpus if r[0] is not None})
    text = {r[0]: r[1] or "" for r in corpus}
    for r in rows:
        if r.doc_id is None or r.doc_id == 63:
            continue
        t = text[r.doc_id]
        i = unique.index(r.doc_id)
        following = text[unique[i + 1]] if i + 1 < len(unique) else text[None]
        assert r.edited == t[: len(t) - len(t) // 4] + following[: len(t) // 4] and r.n_chars == len(t)
    assert order_minhash.fingerprint_with_edits(nothing).count() == 0
    one = order_minhash.fingerprint_with_edits(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].edited == "abcdefab"


def test_likeness_of_empty_signatures(spark):
    row = spark.sql("select cast(array() as array<int>) a, array(1) b").select(order_minhash.likeness(F.col("a"), F.col("a")).alias("same"), order_minhash.likeness(F.col("a"), F.col("b")).alias("other")).first()
    assert row.same == 1.0 and row.other == 0.0


def test_pipeline_runs_over_odd_rows(spark, clashing, corpus, tmp_path):
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and after, name
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
    assert not {60, 61, 62, 65} & before
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_equal_brute_force(spark, docs, corpus, tmp_path):
    labels = [(i, 1, int(i % 9 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    models = language.fit(docs)
    _, _, _, rejected = models.predict([r[1] for r in corpus])
    want = Counter(str(r) for r, out in zip(corpus, rejected, strict=True) if not out)
    assert Counter(str(tuple(r)) for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()) == want
    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = model.word_scores()
    want = Counter(str(r) for r in corpus if toxicity.score(r[1], scores, model) < toxicity.THRESHOLD)
    assert Counter(str(tuple(r)) for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()) == want
    classes = similar_classes([r[1] for r in corpus])
    named = [(i, r) for i, r in enumerate(corpus) if r[0] is not None]
    least = {c: min(r[0] for i, r in named if classes[i] == c) for c in {classes[i] for i, _ in named}}
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(least.values())) and kept.count(None) == sum(r[0] is None for r in corpus)


def test_stages_over_nothing(spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
        assert stage(spark, nothing, str(tmp_path)).columns == nothing.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, str(tmp_path)).count() == 0


def test_samples_stay_small_where_rows_repeat(spark):
    rows = spark.createDataFrame([(None if i % 3 else 7, f"the river {i % 5}", "en") for i in range(900)], "doc_id long, text string, lang string")
    assert language.fit(rows, docs_per_language=10).languages == ["en"] == language.fit(rows, docs_per_language=600).languages
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda texts, classes: seen.append(len(texts)) or train(texts, classes)
        toxicity.fit(rows, labels, docs_per_class=10)
    finally:
        toxicity.train = train
    assert seen == [40]


def test_operators_over_nothing(nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(nothing, none)
    assert toxicity.classify(nothing, model).count() == 0
    assert order_minhash.fingerprint_with_edits(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.deduplicate(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert mixing.apply_mix(nothing).count() == 0
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000, "a" + " " * 999_999 + "b", "a" + "\n\u2003" * 400_000 + " b c" + " " * 1_000 + "\td", "\x1c" * 2_000 + " " * 1_001, " " * 999 + "x" + "\xa0" * 1_000 + "'s"])
def test_long_white_space_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.TextEncoder.of(path)(text).tolist() == expected


def test_packing_of_a_very_long_blank_text(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a b" * 9), (3, None)], "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    whole = {p.doc_id: p.doc_tokens for p in pieces}
    assert {d: sum(p.length for p in pieces if p.doc_id == d) for d in whole} == whole and whole[3] == 1


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_rows_of_one_id_are_compared_by_text(spark, similarity):
    """A text stays that is nobody's near-duplicate, though its id has others; copies under one id go."""
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(draw.choice(letters) for _ in range(6)) for _ in range(60)) for _ in range(6)]
    longer = texts[2] + (" end" if similarity else "")
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (1, longer), (2, texts[2]), (3, texts[3]), (3, texts[3]), (9, texts[4]), (9, texts[0]), (9, None), (9, ""), (None, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, own_id int").repartition(3)
    kept = [tuple(r) for r in simhash.deduplicate(docs, similarity=similarity).select("doc_id", "text").collect()]
    named = [(i, t) for i, t in kept if i is not None]
    assert len(kept) - len(named) == 2 and len(named) == len(set(named)) == 6
    groups = [{(1, texts[0]), (9, texts[0])}, {(1, texts[1])}, {(1, longer), (2, texts[2])}, {(3, texts[3])}, {(9, texts[4])}, {(9, None), (9, "")}]
    assert all(len(g & set(named)) == 1 for g in groups)
