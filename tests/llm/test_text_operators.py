"""Quality rules, decontamination, language identification, token files, language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bytetext, decontam, kneser_ney, langid, quality, sstable, tokens

from .helpers import LOWER, odd_docs, words

BPE = public_tokenizers.path("byte_bpe_50k.json")

def thue_morse():
    """Two texts of 1,024 letters that meet in every polynomial hash modulo 2**64 with an odd base."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


# --- quality --------------------------------------------------------------------------------------


def base_figures(text):
    w, seen, dup_lines, text = words(text), set(), 0, text or ""
    for line in text.split("\n"):
        if words(line):
            dup_lines += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup_lines, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def repeated_share(text, n):
    w = words(text)
    seen, inside = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            inside |= set(range(i, i + n))
        seen.add(g)
    return sum(len(w[i]) for i in inside) / max(1, sum(map(len, w)))


def test_quality_against_plain_version(spark):
    rnd = random.Random(1)
    texts = [None, "", "#$ <&>|%*" * 4]
    for _ in range(120):
        w = [rnd.choice(["ab", "cé", "d漢", "e#", "ff", "g"]) + str(rnd.randrange(rnd.choice([3, 40, 4000]))) for _ in range(rnd.randrange(0, 90))]
        if rnd.random() < 0.4 and len(w) > 15:
            w += w[: rnd.randrange(5, 15)] * rnd.randrange(1, 4)
        texts.append("".join(x + rnd.choice([" ", " ", "\n", "\t ", "\r\n"]) for x in w))
    got = {r.doc_id: r for r in quality.repetition_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_figures(t)
        shares = {n: repeated_share(t, n) for n in quality.NGRAM_LIMITS}
        assert math.isclose(r.worst_ngram_share, max(shares.values()))
        bad = any(shares[n] > quality.NGRAM_LIMITS[n] for n in shares) or r.dup_line_chars > quality.LINE_LIMIT * max(1, r.word_chars)
        assert r.kept == (not r.base_failed and not bad)


@pytest.mark.parametrize("weak", [False, True])
def test_quality_compares_what_hashes_join(weak, monkeypatch):
    a, b = thue_morse()
    texts = [f"{a}\n{b}", f"{a} x {b}\n{a} x {b}\n" + "q w e r t z u i o p " * 3, " ".join(f"w{k % 23}" for k in range(90))]
    if weak:
        monkeypatch.setattr(bytetext, "span_hashes", lambda values, starts, ends: (ends - starts).astype(np.uint64))
        monkeypatch.setattr(quality, "window_hashes", lambda hashes, n: hashes[: max(0, len(hashes) - n + 1)] % np.uint64(3))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = quality.measure(data, np.cumsum([0, *map(len, texts)]), quality.NGRAM_LIMITS, quality.LINE_LIMIT)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(texts):
        assert tuple(got[k][i] for k in names) == base_figures(t)
        assert math.isclose(got["worst_ngram_share"][i], max(repeated_share(t, n) for n in quality.NGRAM_LIMITS))


def test_quality_of_odd_inputs(spark):
    docs = odd_docs(spark)
    got = quality.repetition_quality(docs).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got)
    assert quality.repetition_quality(docs.limit(0)).collect() == [] and quality.filter_quality(docs).columns == docs.columns
    clean = docs.sparkSession.createDataFrame([(1, " ".join(f"word{k}" for k in range(50)), "x")], "doc_id long, text string, kept string")
    assert quality.filter_quality(clean).collect() == clean.collect()


# --- decontamination ------------------------------------------------------------------------------


def plain_hits(text, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, names = find(text), set(), set()
    for name, item in items:
        v = find(item)
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(str(name) if name is not None else "null")
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("pass_bytes", [4 << 20, 700])
def test_decontamination_against_plain_version(spark, pass_bytes):
    rnd = random.Random(2)
    vocab = ["der", "Ein", "ß", "x1", "naïve", "THE", "q"]
    say = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(k, say(rnd.choice([1, 2, 5, 13, 14, 30]) + 3)) for k in range(20)] + [(20, None), (21, "!!"), (None, say(15)), (23, "unique"), (24, "unique")]
    texts = [None, "", "unique", say(5)]
    for _ in range(60):
        parts = [say(rnd.randrange(0, 40))]
        if rnd.random() < 0.6:
            w = re.findall(r"\S+", rnd.choice(items)[1] or "z")
            cut = rnd.randrange(0, max(1, len(w) - 12))
            parts += [" ".join(w[cut : cut + rnd.choice([12, 13, 20])]), say(rnd.randrange(0, 30))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in decontam.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), pass_bytes=pass_bytes).collect()}
    for i, t in enumerate(texts):
        n, hit, names = plain_hits(t, items)
        assert (got[i].n_words, sum(s.b - s.a for s in got[i].spans), sorted(got[i]["items"])) == (n, hit, names), t


def test_a_large_benchmark_and_a_window_that_thousands_share():
    rnd = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(13))
    items = [(str(k), f"{shared} own{k}") for k in range(20_000)]
    machines, names = decontam.build(items, 13)
    raw = f"x {shared} own7 y".encode()
    texts = bytetext.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), decontam.NOT_WORD)
    found = list(machines[0].search(texts, raw, texts.hashes()))
    assert [(d, b) for d, b, _ in found] == [(0, 1), (0, 2)] and [len(machines[0].items_of(s)) for _, _, s in found] == [20_000, 1]
    big = [(str(k), " ".join(f"w{rnd.randrange(10**6)}" for _ in range(2000))) for k in range(1300)]  # about 10 MB
    machines, _ = decontam.build(big, 13)
    piece = " ".join(big[77][1].split()[100:140]).encode()
    texts = bytetext.Texts(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), decontam.NOT_WORD)
    found = list(machines[0].search(texts, piece, texts.hashes()))
    assert [b for _, b, _ in found] == list(range(28)) and {int(k) for _, _, s in found for k in machines[0].items_of(s)} == {77}


def test_decontamination_of_odd_inputs(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 8, 8]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontam.find_contamination(docs.limit(0), bench).collect() == []


# --- languages ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(sf)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    kept = re.sub("[^a-z\\x80-\\xff]+", " ", text.lower().encode().decode("latin-1")).encode("latin-1").strip(b" ")
    padded = b" " + kept + b" " if kept else b" "
    return collections.Counter(padded[i : i + n] for n in langid.ORDERS for i in range(len(padded) - n + 1))


def as_key(gram):
    return sum(c << 8 * k for k, c in enumerate(gram)) | len(gram) << 32


def test_language_grams_and_model_against_plain_version(spark, monkeypatch):
    rnd = random.Random(11)
    stock = {"de": "der die das und nicht über müde", "en": "the and of with nothing above", "fr": "le la les été où déjà rien"}
    rows = []
    for k in range(240):
        lang = rnd.choice(list(stock))
        rows.append((k, " ".join(rnd.choice(stock[lang].split()) for _ in range(rnd.randrange(1, 30))) + rnd.choice(["", "!", " 42 -- X"]), lang))
    rows += [(300, "", "de"), (301, None, "en"), (302, "1234", "fr"), (303, "Ünï ", None)]
    import pyarrow as pa

    texts = pa.array([t for _, t, _ in rows], pa.string())
    keys, bounds = langid.grams(texts)
    for (_, t, _), a, b in zip(rows, bounds, bounds[1:]):
        assert collections.Counter(keys[a:b].tolist()) == collections.Counter({as_key(g): n for g, n in plain_grams(t or "").items()}), t

    learned, built = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2]], []
    real = langid.build_filter
    monkeypatch.setattr(langid, "build_filter", lambda *a: built.append(a) or real(*a))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    of = collections.Counter(lang for _, _, lang in learned)
    counts = {lang: collections.Counter(g for _, t, x in learned if x == lang for g in plain_grams(t or "")) for lang in of}
    best = {g: max(counts[x][g] / of[x] for x in of) for lang in of for g in counts[lang]}
    want = {lang: {as_key(g) for g, n in counts[lang].items() if n / of[lang] >= langid.MIN_RATE and n / of[lang] >= langid.SIBLING * best[g]} for lang in of}
    assert {lang: set(g.tolist()) for lang, g in built[0][2]} == want and built[0][1] == of
    model = real(*built[0])
    for doc_id, t, _ in rows:
        hits, n = [0] * len(of), 0
        for g, times in plain_grams(t or "").items():
            n += times
            bits = model.masks(np.array([as_key(g)], np.uint64))[0]
            hits = [h + times * int(b) for h, b in zip(hits, bits)]
        rest = [max(0.0, (h - n * f) / (1 - f)) for h, f in zip(hits, model.false_rate)]
        pick = max(range(len(rest)), key=lambda k: (rest[k], -k)) if sum(rest) else model.default
        und = not any(c.isalpha() for c in t or "")
        assert got[doc_id].lang_pred == ("und" if und else model.languages[pick])
        assert math.isclose(got[doc_id].score, 0.0 if und or not sum(rest) else rest[pick] / sum(rest), abs_tol=1e-9)


def test_language_sample_takes_rows_of_one_id_one_by_one(spark):
    rows = [(None, f"text number {k} of many words", "en") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df, sample=100).languages == ["en"]
    cut = int(100 / 400 * (1 << 30))
    n = df.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)) < cut).count()
    assert 60 < n < 140


def test_language_of_odd_inputs(spark):
    got = langid.identify(odd_docs(spark), sample=10).collect()
    assert len(got) == odd_docs(spark).count()
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2)) for r in got if r.doc_id is not None) and not any(r.held_out for r in got if r.doc_id is None)
    unlabelled = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und" and langid.identify(unlabelled.limit(0)).collect() == []


def test_filter_has_no_false_negatives_and_few_false_positives():
    keys = np.arange(5000, dtype=np.int64) * 7919
    f = langid.build_filter(["a", "b"], {"a": 1, "b": 2}, [("a", keys[:3000]), ("b", keys[2000:])])
    masks = f.masks(keys.astype(np.uint64))
    assert masks[:3000, 0].all() and masks[2000:, 1].all() and f.default == 1
    other = f.masks((np.arange(20000, dtype=np.uint64) + np.uint64(1 << 39)))
    assert abs(other[:, 0].mean() - f.false_rate[0]) < 0.01 and f.false_rate.max() < 0.05


# --- tokens ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("' \n\ttsmdrevl1a")), max_size=40), max_size=5))
def test_encoder_is_the_library(texts):
    library = Tokenizer.from_file(BPE)
    assert [x.tolist() for x in tokens.Encoder.of(BPE).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_is_the_library_on_every_code_point():
    """With an ending and with a digit after it; planes without letters by their first and last points."""
    library, encoder = Tokenizer.from_file(BPE), tokens.Encoder.of(BPE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or 0xE0000 <= c < 0xE0200 or c & 0xFFFF in (0, 1, 0xFFFE, 0xFFFF))]
    texts = ["".join(f"{chr(c)}'s {chr(c)}1 " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for k in range(0, len(texts), 100):
        want = [e.ids for e in library.encode_batch(texts[k : k + 100], add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts[k : k + 100])] == want, k


def test_encoder_forgets_and_handles_added_tokens(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    library, encoder = Tokenizer.from_file(BPE), tokens.Encoder(BPE)
    for text in ("one two three four five", "six seven <|endoftext|> eight", "don't we'll 'sabc  x\n\n y ", ""):
        assert next(encoder.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library_on_texts_that_fool_hashes(monkeypatch):
    library, encoder = Tokenizer.from_file(BPE), tokens.Encoder(BPE)
    texts = [*thue_morse(), "the cat sat on the mat " * 3, "a cat's  mat\n"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(tokens, "span_hashes", lambda values, starts, ends: (values[starts] % 8).astype(np.uint64))  # many pre-tokens to a hash
    encoder = tokens.Encoder(BPE)
    assert [next(encoder.encode([t])).tolist() for t in texts] == want and [x.tolist() for x in encoder.encode(texts)] == want


def test_encoder_cuts_long_texts_where_no_token_crosses(monkeypatch):
    monkeypatch.setattr(tokens, "_SLICE_CHARS", 50)
    library, rnd = Tokenizer.from_file(BPE), random.Random(5)
    texts = ["".join(rnd.choice(["word", " ", "  ", "'s", "\n", "é", "X9", " next"]) for _ in range(n)) for n in (10, 400, 0, 900)] + ["z" * 500]
    assert [x.tolist() for x in tokens.Encoder(BPE).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_a_repeated_id_are_dealt_out(spark):
    docs = spark.range(3000).selectExpr("cast(7 as long) as doc_id", "concat('text ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        manifest = tokens.write_tokens(docs, BPE, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokens.read_tokens(manifest).orderBy("start").collect()
    assert manifest.count() > 4 and len(got) == 3000 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_token_files_round_trip(spark):
    docs, library = odd_docs(spark), Tokenizer.from_file(BPE)
    manifest = tokens.write_tokens(docs, BPE, end_id=2, max_entries=3)
    got = tokens.read_tokens(manifest).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.digest, r.text or "") for r in docs.withColumn("digest", F.xxhash64("text")).collect())
    start = 0
    for r, (key, _, text) in zip(sorted(got, key=lambda r: r.start), rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key[1] if key[0] else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    assert tokens.read_tokens(tokens.write_tokens(docs.limit(0), BPE, 2)).collect() == []


def test_table_lookup(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    ids = sorted([None, *range(-50, 3000, 7), 70, 70, 70], key=sstable.key_of)
    with open(tmp_path / "t", "wb") as out:
        writer = sstable.Writer(out, 2)
        for k, i in enumerate(ids):
            writer.add(sstable.key_of(i), np.arange(k % 9))
        meta = writer.close()
    table = sstable.Table(f"file://{tmp_path}/t")
    assert meta["blocks"] > 10 and [i for i, _ in table] == ids
    for k, i in enumerate(ids):
        assert [x.tolist() for x in table.get(i)] == [list(range(j % 9)) for j, x in enumerate(ids) if x == i]
    assert table.get(71) == [] and table.get(10**12) == [] and sum(table.may_hold(i) for i in range(10_000, 20_000)) < 300
    data = bytearray((tmp_path / "t").read_bytes())
    data[20] ^= 1
    (tmp_path / "u").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Table(f"file://{tmp_path}/u"))


# --- language model -------------------------------------------------------------------------------


def plain_model(texts, held):
    counts, pairs = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if not held[i]:
            counts.update([*t, "<s>"])
            pairs.update(zip(["<s>", *t[:-1]], t))
    begins = counts.pop("<s>", 0)
    total, size = sum(counts.values()), len(counts)
    before = collections.Counter(w for _, w in pairs)
    follow = collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), c in pairs.items():
        follow[v][min(c, 3) - 1] += 1
    tally = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d2, d1 = (kneser_ney.discounts(tally(list(c.values()))) for c in (pairs, before))
    types = sum(before.values())
    take = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)

    def low(w):
        rest = sum((0, *d1)[min(a, 3)] for a in before.values()) / types if types else 0
        return take(before.get(w, 0), d1) / types + rest / (size + 1) if types else 1 / (size + 1)

    def p(v, w):
        if v not in follow:
            return low(w)
        of = begins if v == "<s>" else counts[v]
        return (take(pairs.get((v, w), 0), d2) + sum(d2[k] * follow[v][k] for k in range(3)) * low(w)) / of

    return counts, total, size, p


def test_model_against_plain_version(spark):
    rnd = random.Random(4)
    texts = {k: "".join(rnd.choice(["The", "cat", "SAT", "on", "mat", f"w{rnd.randrange(60)}"]) + rnd.choice("  \n") for _ in range(rnd.randrange(0, 40))) for k in range(150)}
    docs = spark.createDataFrame([*texts.items(), (999, None)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in kneser_ney.train_and_score(docs).collect()}
    texts[999] = None
    said = {i: [*words((t or "").translate(LOWER)), "</s>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts, total, size, p = plain_model(said, held)
    for i, t in said.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in counts for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (total + size + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t[:-1]], t)), rel_tol=1e-9)
    vocabulary = [*counts, "never seen"]
    for v in ("<s>", "cat", "never seen"):
        assert math.isclose(sum(p(v, w) for w in vocabulary), 1.0, rel_tol=1e-9)


def test_words_that_fool_hashes_stay_apart(spark, monkeypatch):
    a, b = thue_morse()
    i, j, k = [n for n in range(30) if zlib.crc32(str(n).encode()) % 7 != 2][:3]
    docs = spark.createDataFrame([(i, a), (j, f"{a} {b}"), (k, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in kneser_ney.train_and_score(docs).collect()}
    assert [got[n].n_known for n in (i, j, k)] == [2, 3, 2] and got[i].train_tokens == 7 and not any(r.held_out for r in got.values())
    assert math.isclose(got[i].base_score, math.log10(3 / 12) + math.log10(4 / 12))  # two of a, one of b, three ends: V + 1 = 5
    parts = [(np.array([5, 9], np.uint64), np.array([[1, 7], [2, 8]])), (np.array([5], np.uint64), np.array([[3, 7]]))]
    assert [x.tolist() for x in kneser_ney._merge_checked(parts)] == [[5, 9], [[4, 7], [2, 8]]]
    with pytest.raises(kneser_ney.SharedHash):
        kneser_ney._merge_checked([*parts, (np.array([9], np.uint64), np.array([[1, 1]]))])
    tried, real = [], kneser_ney._train

    def unlucky(texts, work, n, seed):
        tried.append(seed)
        if seed < 2:
            raise RuntimeError("a worker said: SharedHash: two words have one key")
        return real(texts, work, n, seed)

    monkeypatch.setattr(kneser_ney, "_train", unlucky)
    assert {r.doc_id: r.score for r in kneser_ney.train_and_score(docs).collect()} == {n: r.score for n, r in got.items()} and tried == [0, 1, 2]


def test_model_of_odd_inputs(spark):
    docs = odd_docs(spark)
    got = kneser_ney.train_and_score(docs).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    nothing = spark.createDataFrame([(k, "a b") for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.score) for r in kneser_ney.train_and_score(nothing).collect()} == {(0, 0, 0.0)}
    assert kneser_ney.train_and_score(docs.limit(0)).collect() == []


def test_blocks_and_mix_are_exact():
    rnd = np.random.default_rng(5)
    keys = np.unique(rnd.integers(0, 1 << 64, 5000, dtype=np.uint64))
    counts = rnd.integers(1, 1 << 31, (len(keys), 3))
    back = kneser_ney.unpack(kneser_ney.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all() and (kneser_ney.unmix(kneser_ney.mix(keys)) == keys).all()
