"""Properties of the text splitters on arbitrary input."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import ann, chunk_generic, chunk_tsjs, chunking, index, postings
from quillspark.streaming import answer

code = st.text(alphabet=st.sampled_from("ab {}()[]<>'\"`\\/*=;,.:\n\n#@$|&?!-+0 é😀"), max_size=200)
words = st.lists(st.sampled_from(["export", "default", "class", "function", "const", "type", "interface", "enum", "a", "B", "{", "}", "(", ")", "=", "=>", ":", ";", "<", ">", "\n", ",", "'s'", "`t`", "|", "extends", "async", "*", "1"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(code, st.integers(1, 30), st.integers(1, 9))
def test_windows_cover_every_line_once(text, budget, first):
    spans = chunk_generic.split_by_lines(text, first, budget)
    assert "\n".join(s.text for s in spans) == text
    assert spans[0].start == first and spans[-1].end == first + text.count("\n")
    assert all(a.end + 1 == b.start for a, b in zip(spans, spans[1:]))
    assert all(chunk_generic.tokens_of(s.text) <= budget or s.start == s.end for s in spans)
    for a, b in zip(spans, spans[1:]):  # greedy: the next line did not fit
        assert chunk_generic.tokens_of(a.text + "\n" + b.text.split("\n")[0]) > budget


@settings(max_examples=300, deadline=None)
@given(code)
def test_blocks_are_in_order_and_hold_their_lines(text):
    lines = text.split("\n")
    for blocks in (chunk_generic.brace_blocks(text), chunk_generic.indent_blocks(text)):
        for b in blocks:
            assert b.text == "\n".join(lines[b.start - 1 : b.end])
        assert all(a.end < b.start for a, b in zip(blocks, blocks[1:]))
        covered = {k for b in blocks for k in range(b.start, b.end + 1)}
        assert all(not lines[k - 1].strip(chunk_generic._SPACE) for k in range(1, len(lines) + 1) if k not in covered)
        merged = chunk_generic.merge_small(blocks)
        assert "\n".join(b.text for b in merged) == "\n".join(b.text for b in blocks)


@settings(max_examples=500, deadline=None)
@given(st.one_of(code, words), st.sampled_from(["a.ts", "a.tsx", "a.js"]))
def test_the_declaration_chunker_takes_anything(text, path):
    outcome, records = chunk_tsjs.chunk(path, "typescript", text)
    n = text.count("\n") + 1
    assert outcome in ("chunked", "degraded", "no-declarations") and records
    for r in records:
        assert 1 <= r["start_line"] <= r["end_line"] <= n and 1 <= r["part_index"] <= r["part_total"]
        assert r["content"] in text or r["kind"] == "file"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), st.text(max_size=20), max_size=3), max_size=6), st.integers(1, 7))
def test_events_survive_any_cut_of_the_stream(events, size):
    stream = "".join(answer.frame(e) + answer.heartbeat() for e in events)
    pieces = [stream[k : k + size] for k in range(0, len(stream), size)]
    assert list(answer.parse_frames(pieces)) == events


def test_spans_are_made_of_bounded_slices():
    """However many rows a batch holds, what a worker makes of them at once is bounded; nothing is lost."""
    texts = ["x" * 300_000, None, "", *["ab"] * 5000, "y" * 3_000_000, "é" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(chunking._slices(batch, 1))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 2
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= chunking.SLICE_BYTES for p in parts)


def test_postings_are_made_of_bounded_slices(monkeypatch):
    monkeypatch.setattr(postings, "SLICE_LEXEMES", 50)
    rows = [["a", "", "b", "a"] * k if k % 7 else None for k in range(40)]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([range(40), ["r"] * 40, [3 * k for k in range(40)], ["s"] * 40, rows], kinds)], names=["id", "repo_source", "doc_len", "symbol", "lexemes"])
    small = list(postings._terms(iter([batch])))
    monkeypatch.setattr(postings, "SLICE_LEXEMES", 1 << 17)
    order = [("id", "ascending"), ("term", "ascending")]
    assert len(small) > 20 and pa.Table.from_batches(small).sort_by(order) == pa.Table.from_batches(list(postings._terms(iter([batch])))).sort_by(order)


def test_a_workers_arrays_do_not_grow_with_the_cells_or_the_queries():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000))], names=["id"])
    parts = list(ann._slices(iter([batch])))
    assert max(p.num_rows for p in parts) == ann.SLICE_ROWS and sum(p.num_rows for p in parts) == 5000


def test_vectors_are_made_of_bounded_slices():
    """A batch of 10,000 texts is not held as that many lists of numbers; the service gets the same calls."""
    texts = [f"text {k}" for k in range(3 * index.EMBED_ROWS + 7)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], names=["content_hash", "embed_text"])
    calls = []
    parts = list(index._embed(iter([batch]), lambda asked: calls.append(len(asked)) or index.HashingEmbedder(8)(asked), 8))
    assert [p.num_rows for p in parts] == [index.EMBED_ROWS] * 3 + [7] and calls == [20] * (len(texts) // 20) + [7]
    assert [h for p in parts for h in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [v for p in parts for v in p.column(1).to_pylist()] == index.HashingEmbedder(8)(texts)
