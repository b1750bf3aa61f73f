"""Chat formatting, page extraction and vector search."""

from __future__ import annotations

import hashlib
import html
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaylake.llm import chat, html_extract, topk

TURN_SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = st.lists(st.sampled_from(["<", "|", "\\", "<|im_start|>", "<|im_end|>", "<\\|", "\n", "a", "<|", "user\n", "é"]), max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and "<|" not in hidden
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "\n" not in role and "<|" not in role


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_end|>", ""]), TEXTS), max_size=6))
def test_spans_and_round_trip(messages):
    text, spans, rewritten = chat.render(messages)
    assert not rewritten and chat.parse(text) == messages
    assert [text[a:b] for a, b, _, _ in spans] == [chat.chatml([m]) for m in messages]
    assert [chat.unescape(text[c:d]) for _, _, c, d in spans] == [t for _, t in messages]


def test_templates_that_rewrite_history():
    def last_only(messages):  # drops the text of all assistant turns but the last one
        keep = max((i for i, (r, _) in enumerate(messages) if r == "assistant"), default=-1)
        return "".join(f"[{r}:{t if r != 'assistant' or i == keep else ''}]" for i, (r, t) in enumerate(messages))

    messages = [("user", "a"), ("assistant", "secret"), ("user", "b"), ("assistant", "shown")]
    text, spans, rewritten = chat.render(messages, last_only)
    assert rewritten and [text[c:d] for _, _, c, d in spans if c >= 0] == ["a", "b", "shown"] and spans[1] == (-1, -1, -1, -1)
    counted = lambda m: f"{len(m)} turns: " + " ".join(t for _, t in m)
    text, spans, rewritten = chat.render([("user", "x"), ("assistant", "yy")], counted)
    assert rewritten and [text[c:d] for _, _, c, d in spans] == ["x", "yy"]


def test_long_conversations_are_rendered_in_windows():
    messages = [("user" if i % 2 else "assistant", f"text {i} <|im_end|>" * (i % 3)) for i in range(3 * chat.WINDOW + 5)]
    numbered = lambda m: "BEGIN" + "".join(f"<{i}|{r}|{t}>" for i, (r, t) in enumerate(m))
    closing = lambda m: chat.chatml(m) + ("<open>" if m and m[-1][0] == "user" else "")
    begun = lambda m: "BEGIN" + chat.chatml(m)
    numbered.local = closing.local = begun.local = True
    for template, windowed in ((chat.chatml, True), (begun, True), (numbered, False), (closing, False)):
        assert (chat._windows(messages, template) is not None) == windowed
        text, spans, rewritten = chat.render(messages, template)
        assert text == template(messages) and rewritten == (template is closing)
        assert [chat.unescape(text[c:d]) if template is not numbered else text[c:d] for _, _, c, d in spans] == [t for _, t in messages]
        if not rewritten:
            assert (spans, rewritten) == chat._prefixes(messages, template)[1:]


def test_work_grows_with_the_turns():
    def rendered(n):
        sizes = []
        chat.render([("user", "x" * 20)] * n, lambda m: sizes.append(len(m)) or chat.chatml(m))
        return sum(sizes)

    assert rendered(800) < 9 * rendered(100)


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (3, None, "assistant", "first"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "assistant", "x" * 50_000)]
    turns = spark.createDataFrame([(*r, 9, "z") for r in rows], f"{TURN_SCHEMA}, formatted int, spans string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b")
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and got[3].n_turns == 3 and got[3].loss_sha256 == sha("first") and got[4].loss_chars == 50_000
    assert chat.format_conversations(turns.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


PAGES = {
    "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One&nbsp;two\n three.<p><b>Four</b> five &#233;<br></article><footer>&copy; x</footer></body></html>": "A & B\nOne two three.\nFour five é",
    "<body><div class='ad'>Buy now</div><article><p>Kept text of the page.</p><p>Released under the MIT License.</p></article><script>var a='</p>';</script></body>": "Kept text of the page.\nReleased under the MIT License.",
    "": "",
    "<html><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><footer>&copy; 2020 all rights reserved</footer></body></html>": "",
    "<article><h1>Title</h1><p>Cut off in the mid": "Title\nCut off in the mid",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(model, page):
    assert html_extract.main_texts([page], model) == [PAGES[page]]


def test_generated_pages_that_the_model_has_not_seen(model):
    writer = html_extract.PageWriter(12345)
    right = total = 0
    for _ in range(60):
        blocks, labels = html_extract.labelled_page(writer)
        found = model.scores([model.inputs(blocks)])[0] >= 0.5
        right, total = right + int((found == (labels > 0)).sum()), total + len(labels)
    assert right / total > 0.98


def test_gradients_equal_differences():
    small = html_extract.BlockLabeller(3)
    draw = np.random.default_rng(0)
    size = html_extract.PATH_SIZE + html_extract.WORD_SIZE + html_extract.MEASURES
    pages = [draw.standard_normal((n, size)).astype(np.float32) * 0.3 for n in (4, 2)]
    labels = [np.array([1, 0, 1, 1], np.float32), np.array([0, 1], np.float32)]

    def loss():
        p = np.concatenate(small.scores(pages)).astype(np.float64)
        y = np.concatenate(labels)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, gradient in small.gradients(pages, labels).items():
        at = tuple(draw.integers(0, n) for n in gradient.shape)
        keep = small.weights[name].copy()
        sides = []
        for step in (1e-2, -1e-2):
            small.weights[name] = keep.copy()
            small.weights[name][at] += step
            sides.append(loss())
        small.weights[name] = keep
        assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(gradient[at], abs=2e-3)


def test_pages_with_odd_rows(spark, model):
    long_page = "<article>" + "".join(f"<p>paragraph number {i} of the article</p>" for i in range(3000)) + "</article>"
    rows = [(1, None), (2, ""), (3, "no markup at all"), (4, "<<<>>> <p"), (5, long_page), (5, long_page), (None, "<article><p>Some text here.</p></article>")]
    pages = spark.createDataFrame([(*r, "u", "clash") for r in rows], "page_id long, html string, url string, MAIN_text string")
    got = [(r.page_id, r.main_text) for r in html_extract.extract(pages, model=model).collect()]
    texts = dict(got)
    assert texts[1] == texts[2] == "" and texts[5].count("\n") == 2999 and texts[None] == "Some text here." and len(got) == 7
    assert html_extract.extract(pages.limit(0), model=model).count() == 0


@pytest.mark.parametrize("first", range(15, 20))
def test_history_rewritten_at_any_length_is_told(first):
    """A template that changes earlier turns while there are ``first`` to 19 of them, given 20."""

    def template(messages):
        hidden = first <= len(messages) <= 19
        return "".join(f"[{r}:{'' if hidden and k < 3 else t}]" for k, (r, t) in enumerate(messages))

    messages = [("user" if k % 2 else "assistant", f"text {k}") for k in range(20)]
    text, spans, rewritten = chat.render(messages, template)
    assert rewritten == chat._prefixes(messages, template)[2] is True
    assert [text[c:d] for _, _, c, d in spans] == [t for _, t in messages]


@pytest.mark.parametrize(
    "page",
    [
        '<div><p>first part</p><svg class="i"/><p>second part</p></div>',
        "<div><p>first part</p><svg class='a>b' /><p>second part</p></div>",
        "<div><p>first part</p><!--><p>second part</p></div>",
        "<div><p>first part</p><!---><p>second part</p></div>",
        "<div><p>first part</p><!-- a --!><p>second part</p></div>",
        "<div><p>first part</p><svg><text>drawn</text></svg><p>second part</p></div>",
        "<div><p>first part</p><svg><title>drawn</title><path d='M0 0'/><p>second part</p></div>",
        "<div><p>first part</p><svg><g><p>second part</p><svg><text>drawn</text></svg></div>",
        "<div><p>first part</p><!-- <p>no part</p> --><p>second part</p><!-- open <p>no part</p>",
    ],
)
def test_drawings_and_comments_take_no_other_text(page):
    assert [x.text for x in html_extract.leaves(page)] == ["first part", "second part"]


def plain_top(rows, queries, k):
    """The k best ids of each query id: the highest product of any two of their vectors."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    width = max(len(v) for _, v in ints)
    pad = lambda v: v + [0] * (width - len(v))
    out = []
    for q in set(queries):
        best = {}
        for _, own in (r for r in ints if r[0] == q):
            for i, v in ints:
                if i != q:
                    best[i] = max(best.get(i, -(1 << 90)), sum(a * b for a, b in zip(pad(own), pad(v), strict=True)))
        scores = sorted((-s, i) for i, s in best.items())
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("own", [1, 2, 3, 6])
def test_several_vectors_of_one_id(own):
    """The query's own vectors, however many and near, take no place of another's."""
    draw = np.random.default_rng(own)
    for _ in range(40):
        values = draw.integers(-60, 61, (400, 8))
        ids = np.arange(400)
        query = values[0].copy()
        ids[:own] = 0
        values[:own] = query + draw.integers(-1, 2, (own, 8))
        values, ids = (x[np.sort(np.unique(np.column_stack([ids, values]), axis=0, return_index=True)[1])] for x in (values, ids))
        products = sorted((-int(values[j] @ query), int(ids[j])) for j in range(len(ids)) if ids[j] != 0)
        block = topk.Block(ids, values, 5)
        assert block.best(query, 0, 5) == [(-s, i) for s, i in products[:5]]
        assert block.best(query, 0, 5, -products[4][0]) == [(-s, i) for s, i in products[:5]]


def test_reading_stops_when_no_other_can_qualify():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 20, (3_000, 16))
    values[:8] += draw.integers(800, 900, (8, 16))
    block = topk.Block(np.arange(3_000), values, 5)
    query = values[2_000]
    found = block.best(query, 2_000, 5)
    assert found == sorted(((int(v @ query), i) for i, v in enumerate(values) if i != 2_000), key=lambda x: (-x[0], x[1]))[:5]
    lists = int((query != 0).sum())
    assert block.read + block.unread == 3_000 * lists and block.unread > 0.9 * 3_000 * lists
    block.read = block.unread = 0
    assert block.best(query, 2_000, 5, bar=1 << 40) == [] and block.unread > 0.9 * 3_000 * lists


@pytest.mark.parametrize("repeated", [False, True])
def test_top_k_over_several_blocks(spark, monkeypatch, repeated):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 90)
    draw = random.Random(8)
    rows = [(i // 3 if repeated else i, [draw.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(50, rows[50][1]), (50, [x * 2 for x in rows[50][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == plain_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


@pytest.mark.parametrize("kind", ["normal", "ties", "large", "few"])
def test_top_k_equals_brute_force(spark, kind):
    draw = random.Random(kind)
    n = {"few": 3, "large": 400}.get(kind, 700)
    values = {"ties": lambda: float(draw.choice((-1, 0, 1))), "large": lambda: draw.gauss(0, 50_000), "normal": lambda: draw.gauss(0, 0.2), "few": lambda: draw.random()}[kind]
    rows = [(i, [values() for _ in range(8)]) for i in range(n)]
    if kind == "ties":
        rows += [(n + i, [1.0] * 8) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == plain_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_top_k_leaves_out_what_is_no_vector(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [3.0]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 5).collect()]
    assert sorted(got) == plain_top([(0, [1.0, 2.0]), (5, [3.0]), (6, [0.5, 0.5])], [0], 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_formulas_are_part_of_their_block():
    found = html_extract.leaves("<p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b</p><p><object data='x'>told <b>so</b></object></p>")
    assert [x.text for x in found] == ["a x+1 b", "told so"]


def test_references_in_leaves():
    found = html_extract.leaves("<div class='siteNav mainMenu'>a<span> b</span>&lt;c&gt;<br>d</div><p>e<p>f")
    assert [x.text for x in found] == ["a b<c> d", "e", "f"] and found[0].path[-1] == "div site nav main menu"
    assert html.unescape("&lt;") == "<"
