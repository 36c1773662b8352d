"""Behaviour of the retrieval engine on small inputs."""

import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark import cli, model
from quillspark.functions import lexical, text
from quillspark.functions.stem import stem
from quillspark.model import SearchOptions
from quillspark.operators import chunk_generic, chunk_tsjs, chunking, citations, context, history, index, search, source_window
from quillspark.sources import config, store, walk
from quillspark.streaming import answer, ingest

# --- chunkers -------------------------------------------------------------------------------------


def ts(source, path="a.ts"):
    outcome, records = chunk_tsjs.chunk(path, "typescript", source)
    return outcome, list(records)


def generic(source, language="unknown", path="x.txt"):
    outcome, records = chunk_generic.chunk(path, language, source)
    return outcome, list(records)


def test_line_windows_cover_every_line_once():
    source = "\n".join(f"line {k} " + "x" * (k % 40) for k in range(100))
    spans = chunk_generic.split_by_lines(source, 10, 100)
    assert "\n".join(s.text for s in spans) == source
    assert spans[0].start == 10 and spans[-1].end == 109
    assert all(a.end + 1 == b.start for a, b in zip(spans, spans[1:]))
    assert all(chunk_generic.tokens_of(s.text) <= 100 for s in spans)
    long = chunk_generic.split_by_lines("a\n" + "b" * 900 + "\nc", 1, 10)
    assert [s.text for s in long] == ["a", "b" * 900, "c"]


def test_python_blocks_keep_decorators_and_names():
    outcome, got = generic("def main():\n" + "    call_something(1)\n" * 8 + "\n@deco\nclass Foo:\n" + "    x = 'a long enough value'\n" * 6, "python")
    assert outcome == "chunked" and [r["symbol_name"] for r in got] == ["main", "Foo"]
    assert got[1]["content"].startswith("@deco") and got[0]["signature"] is None


def test_brace_blocks_see_strings_comments_and_templates():
    _, got = generic("function a() {\n  const s = '}';\n  // }\n  /* } */\n  const t = `}`;\n}", path="a.x")
    assert [(r["start_line"], r["end_line"]) for r in got] == [(1, 6)]
    assert generic("} {\nx", path="a.x")[0] == "chunked"
    assert generic("  \n ")[0] == "no-declarations"


def test_small_blocks_merge_and_large_split():
    assert len(generic("f() {}\ng() {}\nh() {}")[1]) == 1
    _, got = generic("func big() {\n" + "  a line of code that is here\n" * 200 + "}")
    assert len(got) > 1 and {r["symbol_name"] for r in got} == {"big"}
    assert all(chunk_generic.tokens_of(r["content"]) <= model.MAX_CHUNK_TOKENS for r in got)
    assert [r["part_index"] for r in got] == list(range(1, len(got) + 1)) and {r["part_total"] for r in got} == {len(got)}


def test_unterminated_quote_hides_braces():
    _, got = generic("don't {\n}\nfn x() {\n}\n")
    assert len(got) == 1


def test_declarations():
    outcome, got = ts('import a from "b";\n/** doc */\nexport async function f<T>(x: T, y = {a: 1}): Promise<{ b: number }> {\n  return `x${y}`; }\ntype A = { a: string; b(): void } | B & { c: number };\nconst k = 5\nconst h = function* (q) { yield /re"g/ }\nenum E { X = 1, Y }\ninterface P<T> extends Q<T>, R { a: string }\nexport abstract class C<T> extends B<T> implements I, J { x = 1; }\n')
    assert outcome == "chunked"
    assert [(r["kind"], r["symbol_name"]) for r in got] == [("function", "f"), ("type-alias", "A"), ("const", "h"), ("enum", "E"), ("interface", "P"), ("class", "C")]
    assert got[0]["signature"] == "export async function f<T>(x: T, y = {a: 1}): Promise<{ b: number }>"
    assert (got[0]["js_doc"], got[0]["start_line"], got[0]["end_line"], got[0]["is_exported"]) == ("/** doc */", 3, 4, True)
    assert got[1]["signature"] == "type A = { a; b } | B & { c }"
    assert got[2]["signature"] == "const h = function*(q) { … }"
    assert got[3]["signature"] == "enum E { X, Y }"
    assert got[4]["signature"] == "interface P<T> extends Q<T>, R"
    assert got[5]["signature"] == "export abstract class C<T> extends B<T> implements I, J"


def test_const_rules():
    _, got = ts("export const limit: number = 5, other = 1;\nconst f = async (a: string): Promise<void> => {};\nlet plain = 3;\n")
    assert [(r["symbol_name"], r["signature"]) for r in got] == [("limit", "const limit: number"), ("f", "const f = async (a: string): Promise<void> => …")]


def test_barrels_whole_files_and_broken_files():
    outcome, got = ts("".join(f'export * from "./m{k}";\n' for k in range(50)))
    assert [r["kind"] for r in got] == ["re-export"] and got[0]["is_exported"]
    outcome, got = ts("console.log(1);\n")
    assert outcome == "no-declarations" and [(r["kind"], r["end_line"]) for r in got] == [("file", 1)]
    outcome, got = ts("function ( {\n")
    assert outcome == "degraded" and {r["kind"] for r in got} == {"window"} and {r["chunker_kind"] for r in got} == {"fallback"}
    assert ts('import { x } from "./nowhere";\nexport function f() { return x }\n')[0] == "chunked"


def test_large_class_is_split_by_members():
    source = "export class Big {\n  x = 1;\n" + "".join(f"  /** m */\n  {m}(a: number): number {{\n" + "    console.log('some long text', a);\n" * 60 + "  }\n" for m in ("alpha", "beta", "gamma")) + "}\n"
    _, got = ts(source)
    assert [(r["kind"], r["symbol_name"], r["parent_symbol"]) for r in got] == [("class", "Big", None), ("method", "alpha", "Big"), ("method", "beta", "Big"), ("method", "gamma", "Big")]
    assert (got[0]["start_line"], got[0]["end_line"]) == (1, 2) and got[1]["start_line"] == 4 and got[1]["js_doc"] == "/** m */"
    assert {r["part_total"] for r in got} == {4}


def test_large_function_parts_are_contiguous():
    body = "\n".join(f"  const v{k} = 'some text that is long enough {k}';" for k in range(200))
    _, got = ts(f"export function big(a) {{\n{body}\n}}\n")
    assert len(got) > 1 and "\n".join(r["content"] for r in got) == body
    assert all(a["end_line"] + 1 == b["start_line"] for a, b in zip(got, got[1:]))


def test_jsx_text_may_hold_quotes():
    outcome, got = ts("export const C = () => <div className=\"x\">it's {a ? <b>y</b> : null}</div>;\nexport function D() { return <><C /></> }\n", "a.tsx")
    assert outcome == "chunked" and [r["symbol_name"] for r in got] == ["C", "D"]


# --- walk, store, index ---------------------------------------------------------------------------


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    files = {"README.md": b"# title\n", "main.go": b"package main\nfunc main() {\n}\n", "scripts/tool.py": b"def f():\n    return 1\n", "src/index.ts": b"export function a() { return 1 }\n", "src/view.jsx": b"export const V = () => <p>hi</p>\n", "data.unknownext": b"text", "logo.png": b"x", "package-lock.json": b"{}", "vendor.min.js": b"x", "big.ts": b"a" * (model.MAX_FILE_BYTES + 1), "weird.txt": b"hi\0bye", ".github/x.yml": b"a: 1\n", "pkg/__init__.py": b"", "_x.md": b"x", "node_modules/p/index.js": b"x", ".git/HEAD": b"x"}
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "main.go", root / "link.ts")
    return str(root)


def test_walk_and_skip_reasons(spark, repo):
    rows = {r.file_path: r for r in walk.walk(spark, repo).collect()}
    skipped = {k: r.skip_reason for k, r in rows.items() if r.skip_reason}
    assert skipped == {"logo.png": "binary-extension", "package-lock.json": "lockfile", "vendor.min.js": "minified", "big.ts": "too-large", "weird.txt": "binary-content", "node_modules": "ignored-dir", ".git": "ignored-dir", "link.ts": "symlink"}
    assert {".github/x.yml", "pkg/__init__.py", "_x.md"} <= set(rows) and rows["src/view.jsx"].language == "javascript" and rows["data.unknownext"].language == "unknown"
    assert rows["README.md"].source == "# title\n"


def test_repo_sources():
    assert walk.parse_repo("https://github.com/a/b.git/") == ("git", "https://github.com/a/b.git")
    assert walk.parse_repo("some/dir") == ("local", "some/dir")
    for bad in ("git@github.com:a/b.git", "https://gitlab.com/a/b", "https://github.com/a"):
        with pytest.raises(ValueError, match="unsupported repo source"):
            walk.parse_repo(bad)
    calls = []
    got = walk.acquire("https://github.com/a/b", cache_dir="/nowhere", git=lambda *a: calls.append(a[0][0]) or "sha1")
    assert (got.source, got.commit, got.root) == ("git", "sha1", "/nowhere/b") and calls == ["clone", "rev-parse"]


def test_ingest_from_the_command_line(spark, repo, tmp_path):
    said = []
    env = {"TABLE_URI": str(tmp_path / "db"), "EMBED_MODEL": "m", "GEN_MODEL": "g"}
    run = lambda: cli.main(["--repo", repo, "--out", str(tmp_path / "chunks.json")], spark, said.append, env, dim=16)
    assert run() == 0
    report = dict((x.split(":")[0], x.split(":")[1].strip()) for x in said if ":" in x)
    seen, parts = int(report["Files seen"]), [int(report[k]) for k in ("Chunked", "Degraded", "No declarations", "Failed")]
    assert seen == sum(parts) == 9 and report["Skipped"] == "8" and report["Cache hits"] == "0" and report["Deleted"] == "0"
    first = int(report["Inserted"])
    said.clear()
    assert run() == 0
    again = dict((x.split(":")[0], x.split(":")[1].strip()) for x in said if ":" in x)
    assert (again["Embedded"], again["Deleted"], again["Inserted"]) == ("0", str(first), str(first))
    assert cli.main([], spark, said.append) == 1
    assert cli.main(["--repo", repo, "--out", str(tmp_path / "c2")], spark, said.append, {}) == 1 and "TABLE_URI: required" in said[-1]
    assert os.path.isdir(tmp_path / "c2")
    chunks = store.read_chunks(spark, f"{tmp_path}/db/chunks")
    found = search.hybrid_search(chunks, index.HashingEmbedder(16)(["main"])[0], "main", SearchOptions(), stem).collect()
    assert any(r.file_path == "main.go" and r.lexical_rank == 1 for r in found)


def chunk_rows(spark, names, content="text"):
    rows = [(k, f"{n}.md", None, "block", None, None, 1, 2, None, False, "markdown", "generic", 1, 1, f"{content} {n}") for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "seq long, " + model.CHUNK_FIELDS)
    return df.withColumn("embed_text", text.embed_text()).withColumn("content_hash", text.content_hash())


def test_replace_semantics(spark, tmp_path):
    table, cache = str(tmp_path / "chunks"), str(tmp_path / "cache")
    put = lambda names, repo: index.index_chunks(chunk_rows(spark, names), repo, table, cache, dim=8)
    assert put(["alpha", "beta", "beta"], "test://a").inserted == 2
    put(["alpha"], "test://b")
    got = put(["beta", "gamma"], "test://a")
    assert (got.deleted, got.inserted, got.cache_hits, got.embedded) == (2, 2, 1, 1)
    files = lambda repo: sorted(r.file_path for r in store.read_chunks(spark, table, repo).collect())
    assert files("test://a") == ["beta.md", "gamma.md"] and files("test://b") == ["alpha.md"]

    ids = [r.id for r in store.read_chunks(spark, table).collect()]
    assert len(set(ids)) == len(ids) == 3

    def failing(_):
        raise index.EmbedError("daily-quota", "429 PerDay")

    with pytest.raises(Exception, match="PerDay"):
        index.index_chunks(chunk_rows(spark, ["delta"]), "test://a", table, cache, embedder=failing, dim=8)
    assert files("test://a") == ["beta.md", "gamma.md"]
    got = put([], "test://a")
    assert (got.deleted, got.inserted) == (2, 0) and files("test://a") == [] and files("test://b") == ["alpha.md"]


def test_embedding_retries():
    calls, waits = [], []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) == 1:
            raise index.EmbedError("rate-limit", "429", 1500)
        return [[1.0, 0.0]] * len(batch)

    assert len(index.embed_texts(["t"] * 45, flaky, 2, sleep=waits.append)) == 45
    assert calls == [20, 20, 20, 5] and waits == [1.5]
    with pytest.raises(index.EmbedError):
        index.embed_texts(["t"], lambda b: [[1.0]], 2)
    assert index.wait_ms(20, None, 500, lambda: 0.5) == model.MAX_DELAY_MS and index.wait_ms(2, None, 500, lambda: 0.5) == 2250


def test_continuous_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "a.md", "# one\n"), ("r2", "b.ts", "export const x = 1\n")], "repo_source string, file_path string, source string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "cp"), dim=8).awaitTermination(120)
    assert {(r.repo_source, r.file_path) for r in store.read_chunks(spark, str(tmp_path / "t")).collect()} == {("r1", "a.md"), ("r2", "b.ts")}


def test_settings_and_migrations(spark):
    with pytest.raises(ValueError, match="EMBED_MODEL: required; GEN_MODEL: required; PORT"):
        config.load({"TABLE_URI": "x", "PORT": "no"})
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.name for r in config.pending_migrations(names("a", "b"), names("a")).collect()] == ["b"]
    assert config.ready(names("a"), names("a"), False) and not config.ready(names("a"), names("a"), True)


# --- search ---------------------------------------------------------------------------------------

CONTENTS = [
    ("docs/ranking.md", None, [1, 0, 0], "Documentation describing how retrieval results are ranked and displayed to the user."),
    ("src/fixture/settings.ts", "loadSettings", [0.8, 0.6, 0], "function loadSettings(): Settings { const cache = createCache(); return cache.load(); }"),
    ("docs/cache.md", None, [0.6, 0.8, 0], "The cache directory holds serialized embeddings shared across ingest runs."),
    ("src/fixture/format.ts", "formatOutput", [0, 1, 0], "function formatOutput(value: unknown): string { return JSON.stringify(value); }"),
    ("docs/deploy.md", None, [0, 0, 1], "Notes on deployment targets and rollout order for the ingest workers."),
    ("src/fixture/config.ts", "parseConfig", [-1, 0, 0], "function parseConfig(raw: string): Config { return JSON.parse(raw); }"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, "r", f, s, "block", None, 1, 5, "x", c, [float(x) for x in v]) for k, (f, s, v, c) in enumerate(CONTENTS)]
    df = spark.createDataFrame(rows, "id long, repo_source string, file_path string, symbol_name string, kind string, signature string, start_line int, end_line int, language string, content string, embedding array<float>")
    return df.withColumn("lexemes", lexical.lexemes(lexical.indexed_text())).withColumn("doc_len", F.size("lexemes")).cache()


def find(chunks, words, **options):
    return {r.file_path: r for r in search.hybrid_search(chunks, [1.0, 0.0, 0.0], words, SearchOptions(**options)).collect()}


def test_fused_ranks_and_scores(chunks):
    got = find(chunks, "parseConfig")
    first = list(got.values())[0]
    assert first.file_path == "src/fixture/config.ts" and (first.dense_rank, first.lexical_rank) == (6, 1)
    assert math.isclose(first.fused_score, 1 / 66 + 1 / 61, abs_tol=1e-12)
    assert math.isclose(got["docs/ranking.md"].fused_score, 1 / 61, abs_tol=1e-12) and math.isclose(got["docs/deploy.md"].fused_score, 1 / 65, abs_tol=1e-12)
    want = {"docs/ranking.md": 0.0, "src/fixture/settings.ts": 0.2, "docs/cache.md": 0.4, "src/fixture/format.ts": 1.0, "docs/deploy.md": 1.0, "src/fixture/config.ts": 2.0}
    assert all(math.isclose(got[k].dense_distance, v, abs_tol=1e-6) for k, v in want.items())


def test_postings_give_what_a_scan_gives(spark, chunks, tmp_path):
    from quillspark.operators import postings

    postings.write(chunks, str(tmp_path / "index"))
    for asked in ("cache", "parseConfig", "the cache directory", '"cache directory"', '"directory cache"', "ingest -cache", "workers or cache", "nothing -cache", "", "loadSettings", "-ingest", '"ingest runs" or formatOutput'):
        want = search.lexical_leg(chunks, asked, 5, 1.0).collect()
        assert postings.lexical_leg(spark, str(tmp_path / "index"), asked, 5, 1.0).collect() == want, asked
    assert postings.lexical_leg(spark, str(tmp_path / "index"), "cache", 5, 1.0, repo="none").collect() == []
    plan = postings.lexical_leg(spark, str(tmp_path / "index"), "cache", 5, 1.0)._jdf.queryExecution().toString()
    assert "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_lexical_leg(chunks):
    got = find(chunks, "cache")
    assert got["docs/cache.md"].lexical_rank and got["src/fixture/settings.ts"].lexical_rank
    assert all(r.lexical_rank is None for r in find(chunks, "wombat telemetry across quantum fjords").values())
    assert find(chunks, "cache", repo_source="none") == {}
    assert list(find(chunks, "cache", dense_weight=0.0, top_k=2))[0] in ("docs/cache.md", "src/fixture/settings.ts")
    assert find(chunks, '"ingest runs" -docs')["docs/cache.md"].lexical_rank and find(chunks, '"runs ingest"')["docs/cache.md"].lexical_rank is None
    assert find(chunks, 'cache -directory')["docs/cache.md"].lexical_rank is None
    for odd in ('"', "- -", '"" ( & | !', "the"):
        assert all(r.lexical_rank is None for r in find(chunks, odd).values())


def test_legs_are_top_k_plans(chunks):
    plan = search.dense_leg(chunks, [1.0, 0, 0], 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_zero_vector_sorts_last(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0])], "id long, embedding array<float>")
    assert [(r.id, r.dense_rank) for r in search.dense_leg(df, [1.0, 0.0], 5).orderBy("dense_rank").collect()] == [(2, 1), (1, 2)]


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "generalizations", "oscillators", "falling", "sky")] == ["caress", "poni", "relat", "hop", "agre", "happi", "gener", "oscil", "fall", "sky"]


# --- context, sources, citations, history ---------------------------------------------------------


def retrieved(spark, rows):
    data = [(k, f, s, None if n is None else n, 1, 5, "ts", c) for k, (f, s, n, c) in enumerate(rows)]
    return spark.createDataFrame(data, "pos int, file_path string, fused_score double, symbol_name string, start_line int, end_line int, language string, content string")


def test_one_chunk_a_file_and_budget(spark):
    got = context.assemble(retrieved(spark, [("a", 0.1, None, "x"), ("b", 0.5, None, "y"), ("a", 0.9, "f", "z")])).collect()
    assert [(r.included, r.dropped_as) for r in got] == [(False, "duplicate-file"), (True, None), (True, None)]
    assert got[2].block == "--- a:1-5 (f) [ts] ---\nz" and got[2].place == 1
    three = retrieved(spark, [(n, 1.0 - k / 10, None, "w" * 200) for k, n in enumerate("abc")])
    assert [r.included for r in context.assemble(three, 110).collect()] == [True, True, False]
    big = context.assemble(retrieved(spark, [("a", 1.0, None, "w" * 10_000), ("b", 0.5, None, "w")]), 10)
    assert [r.included for r in big.collect()] == [True, False] and context.context_text(big, 10).first().budget_exceeded


def test_source_gaps(spark):
    blocks = lambda *spans: spark.createDataFrame([("r", "f", a, b) for a, b in spans], "repo_source string, file_path string, start_line int, end_line int")
    ask = lambda a, b: spark.createDataFrame([(1, "r", "f", a, b)], "request_id long, repo_source string, file_path string, start_line int, end_line int")
    gaps = lambda c, q: sorted((r.start_line, r.end_line) for r in source_window.gaps(source_window.blocks(c, q), q).collect())
    assert gaps(blocks((1, 2), (3, 7)), ask(1, 7)) == []
    assert gaps(blocks((5, 6)), ask(1, 10)) == [(1, 4), (7, 10)]
    assert gaps(blocks((5, 20), (6, 8), (30, 30)), ask(1, 40)) == [(1, 4), (21, 29), (31, 40)]
    assert gaps(blocks((1, 1)), ask(1, 100_000)) == [(2, 400)]


def test_citations(spark):
    said = "see src/a.ts:10-20 and src/a.ts:10; http://x.y/z at 12:30, b.ts:120-145 c.ts:1 a.ts:20-10"
    answers = spark.createDataFrame([(1, said)], "k long, said string")
    got = citations.parse(answers, "k", "said").collect()
    assert [(r.file_path, r.start_line, r.end_line) for r in got] == [("src/a.ts", 10, 20), ("src/a.ts", 10, 10), ("b.ts", 120, 145), ("c.ts", 1, 1), ("a.ts", 20, 10)]
    known = spark.createDataFrame([(1, "src/a.ts", 1, 30), (1, "b.ts", 100, 140), (1, "a.ts", 15, 30)], "k long, file_path string, start_line int, end_line int")
    checked = citations.validate(citations.parse(answers, "k", "said"), known, "k")
    assert [(r.valid, r.reason) for r in checked.orderBy("place").collect()] == [(True, None), (True, None), (False, "range-not-retrieved"), (False, "unknown-file"), (True, None)]
    pieces = citations.segments(answers, checked, "k", "said").collect()
    assert "".join(p.text for p in pieces) == said and [p.text for p in pieces if p.type == "citation"] == [r.raw for r in got]


def test_prompt_contents(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(10)], "conv_id long, turn long, role string, text string")
    got = history.prompt_contents(turns, spark.createDataFrame([(1, "CTX")], "conv_id long, context_text string")).orderBy("turn").collect()
    assert [r.turn for r in got] == list(range(2, 10)) and got[6].text == f"{model.CONTEXT_MARKER}\nCTX\n\nt8" and got[7].role == "model"
    assert answer.build_contents([{"role": "user", "content": "q"}], "C") == [{"role": "user", "text": f"{model.CONTEXT_MARKER}\nC\n\nq"}]


def test_scalar_expressions(spark):
    row = spark.createDataFrame([("a😀é", "src/.bashrc", "a.Tar.GZ")], "t string, p string, q string").select(text.utf16_length("t"), text.extension("p"), text.extension("q"), text.estimate_tokens("t"), text.estimate_tokens(F.lit(""))).first()
    assert tuple(row) == (4, "", ".gz", 1, 0)


# --- answers --------------------------------------------------------------------------------------


def events(chunks, words, **extra):
    return list(answer.answer(chunks, [{"role": "user", "content": words}], lambda t: [[1.0, 0.0, 0.0]], stems=None, **extra))


def test_answer_events(chunks):
    got = events(chunks, "cache")
    kinds = [e["type"] for e in got]
    assert kinds[0] != "error", got
    assert kinds[0] == "trace" and kinds[-2:] == ["citations", "done"] and set(kinds[1:-2]) == {"token"}
    assert got[-2]["valid"] and not got[-2]["invalid"] and got[-1]["finishReason"] == "STOP"
    assert answer.fold(got)["status"] == "done"
    assert list(answer.parse_frames(["".join(answer.frames(iter(got)))[:-5]])) == got[:-1]
    assert list(answer.parse_frames([answer.heartbeat(), answer.frame(got[-1])])) == got[-1:]


def test_refusal_error_and_cancellation(chunks):
    got = events(chunks, "cache", options=SearchOptions(repo_source="none"))
    assert [e["type"] for e in got] == ["trace", "token", "citations", "done"] and got[1]["text"] == model.REFUSAL and got[-1]["finishReason"] == "REFUSED"
    closed = answer.Deadline(closed=True)
    assert [e["type"] for e in events(chunks, "cache", deadline=closed)] == ["cancelled"]

    def broken(*_):
        raise RuntimeError("no model")
        yield

    assert [e["type"] for e in events(chunks, "cache", generate=broken)] == ["trace", "error"]
    assert [e["type"] for e in events(chunks, "cache", generate=lambda *_: iter([("", "MAX_TOKENS")]))] == ["trace", "error"]


def test_chat_finds_inflected_words_of_a_stored_table(spark, tmp_path):
    from quillspark import server

    rows = chunk_rows(spark, ["alpha", "beta"], "the workers were running their caches")
    index.index_chunks(rows, "r", str(tmp_path / "chunks"), str(tmp_path / "cache"), dim=8)
    engine = server.Engine(spark, lambda: store.read_chunks(spark, str(tmp_path / "chunks")), index.HashingEmbedder(8))
    for asked in ("running", "run", "cache", "caches worker"):
        body = json.dumps({"messages": [{"role": "user", "content": asked}]}).encode()
        trace = next(answer.parse_frames(engine.chat(body, answer.Deadline())))
        assert [c["lexical_rank"] for c in trace["chunks"]] == [1, 2], asked


def test_frames_keep_the_line_open_and_end_in_time():
    def slow():
        yield {"type": "token", "text": "a"}
        time.sleep(0.4)
        yield {"type": "done"}

    got = list(answer.frames(slow(), heartbeat_seconds=0.1))
    assert got[1:-1] and set(got[1:-1]) == {answer.heartbeat()} and [e["type"] for e in answer.parse_frames(got)] == ["token", "done"]

    def silent():
        yield {"type": "token", "text": "a"}
        time.sleep(60)

    ended = []
    begun = time.monotonic()
    got = list(answer.parse_frames(answer.frames(silent(), answer.Deadline(seconds=0.2), lambda: ended.append(1), grace_seconds=0.2)))
    assert [e["type"] for e in got] == ["token", "cancelled"] and ended and time.monotonic() - begun < 10


def test_the_time_limit_ends_the_spark_job(spark, chunks):
    slow = chunks.join(spark.range(1, numPartitions=1).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L) is null as ok"))
    deadline, begun = answer.Deadline(seconds=1.0), time.monotonic()
    made = answer.answer(slow.filter("ok or true"), [{"role": "user", "content": "cache"}], lambda t: [[1.0, 0.0, 0.0]], deadline=deadline, stems=None)
    got = list(answer.parse_frames(answer.frames(made, deadline, lambda: spark.sparkContext.cancelJobsWithTag(deadline.tag))))
    assert [e["type"] for e in got] == ["cancelled"] and time.monotonic() - begun < 15


def test_query_language_has_or():
    q = lexical.parse_query('cache or "index table" -old run')
    assert q.phrases == (("cache",),) and [(o.phrases, o.excluded) for o in q.others] == [((("index", "table"), ("run",)), (("old",),))] and q.words == ["cache", "index", "table", "run"]
    assert lexical.parse_query("or or").phrases == ()


def test_shared_folder_is_qualified_by_the_default_file_system(spark):
    from quillspark import workspace

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert workspace._qualified(spark, "/checkpoints") == "file:///checkpoints"
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://other")
    conf.set("fs.viewfs.mounttable.other.link./checkpoints", "file:///tmp")
    try:
        assert workspace._qualified(spark, "/checkpoints") == "viewfs://other/checkpoints"
    finally:
        conf.set("fs.defaultFS", before)


def test_a_run_that_can_read_nothing_replaces_nothing(spark, tmp_path, monkeypatch):
    from quillspark import cli

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.md").write_text("text")
    monkeypatch.setattr(walk, "ship", lambda spark, root, shared: root)
    real = walk.walk
    monkeypatch.setattr(walk, "walk", lambda spark, root: real(spark, root).withColumn("error", F.lit("gone")).withColumn("source", F.lit(None).cast("string")))
    said = []
    assert cli.main(["--repo", str(tmp_path / "r"), "--out", str(tmp_path / "o")], spark, said.append, {}) == 1 and "nothing is replaced" in said[-1]


def test_a_broken_off_replacement_is_undone(spark, tmp_path):
    table = str(tmp_path / "chunks")
    index.index_chunks(chunk_rows(spark, ["alpha"]), "r", table, str(tmp_path / "cache"), dim=8)
    os.rename(f"{table}/repo_source=r", f"{table}/_old-r")
    assert store.read_chunks(spark, table, "r").count() == 0
    store.recover(spark, table, "r")
    assert store.read_chunks(spark, table, "r").count() == 1


def test_failed_files_do_not_stop_the_run(spark):
    files = spark.createDataFrame([("a.md", "text", None), ("b.md", None, "gone"), ("c.ts", None, None)], "file_path string, source string, error string")
    chunked = chunking.chunk_files(files)
    report = chunking.ingest_report(chunked, files.limit(0), "sha").first()
    assert (report.files_seen, report.files_chunked, report.files_failed, report.commit_sha) == (3, 1, 2, "sha")
    assert [f.reason for f in report.failures] == ["gone", "no text"]


# --- HTTP -----------------------------------------------------------------------------------------


def test_server(spark, chunks):
    import json
    import threading
    import urllib.error
    import urllib.request

    from quillspark import server

    rows = chunks.withColumn("part_index", F.lit(1))
    engine = server.Engine(spark, lambda: rows, lambda t: [[1.0, 0.0, 0.0]], stems=None)
    http = server.serve(engine, 0, "127.0.0.1")
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode()), timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert call("/health")[0] == call("/ready")[0] == 200
        status, text_ = call("/api/chat", {"messages": [{"role": "user", "content": "cache"}]})
        assert status == 200 and [e["type"] for e in answer.parse_frames([text_])][-2:] == ["citations", "done"]
        for bad in ({"messages": []}, {"messages": [{"role": "x", "content": ""}]}, {"messages": [{"role": "user", "content": ""}]}, {"messages": [{"role": "user", "content": "q"}], "repoSource": ""}, {"messages": [{"role": "user", "content": "q"}], "topK": 0}, []):
            assert call("/api/chat", bad)[0] == 400
        status, found = call("/api/source?repoSource=r&filePath=docs/cache.md&startLine=1&endLine=9")
        assert status == 200 and json.loads(found)["gaps"] == [{"startLine": 6, "endLine": 9}]
        assert call("/api/source?repoSource=r&filePath=none&startLine=1&endLine=9")[0] == 404
        assert call("/api/source?repoSource=r&filePath=x&startLine=0&endLine=9")[0] == 400 and call("/nothing")[0] == 404
        engine.shutting_down = True
        assert call("/ready")[0] == 503
    finally:
        http.shutdown()
