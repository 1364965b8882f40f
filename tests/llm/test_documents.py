"""Operators on documents against plain Python and against the tokenizer's library, with all awkward rows."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
from quern.llm import _text as X
from quern.llm import decontamination, language_id, lm_scoring, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _digest(expected):
    return sorted((i, len(w), len(w) - len(k), brute.sha(" ".join(k))) for i, w, k in expected)


def test_substring_dedup(docs, rows, clashing):
    want = _digest(brute.kept_words([(r[0], r[1]) for r in rows]))
    assert sum(r[2] for r in want) > 200
    for df in (docs, clashing):
        assert sorted(map(tuple, substring_dedup.kept_digest(df).collect())) == want


@pytest.mark.parametrize("window", [13, 20])
def test_substring_dedup_short_windows(spark, window):
    """Many overlapping repeats of few words, so that blocks, boundaries and ties of hashes are all met."""
    import random

    rng = random.Random(window)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for k in range(60)]
    got = substring_dedup.kept_digest(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert sorted(map(tuple, got.collect())) == _digest(brute.kept_words(rows, window))


def _thue(a, b, n):
    out = a
    while len(out) < n:
        out += out.translate({ord(a): b, ord(b): a})
    return out, out.translate({ord(a): b, ord(b): a})


def test_patterned_texts_differ(spark, sp):
    """Two texts that differ in every letter, in the pattern that makes polynomials modulo a power of two equal."""
    u, v = _thue("a", "b", 2048)
    frame = lambda *texts: spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.components(frame(u, v)).collect()} == {0, 1}
    same = " ".join(f"w{k}" for k in range(49))
    assert sum(r.n_removed for r in substring_dedup.kept_digest(frame(f"{same} {u}", f"{same} {v}", " ".join(u), " ".join(v))).collect()) == sum(
        len(w) - len(k) for _, w, k in brute.kept_words([*enumerate((f"{same} {u}", f"{same} {v}", " ".join(u), " ".join(v)))])
    )
    lines = frame(f"{u}\n{v}").selectExpr("*", "'en' lang", "'s' source")
    assert quality_rules.judge(lines).first().n_dup_lines == 0
    texts = [*_thue("a", "e", 1024), *(f"q{x}xz" for x in _thue("a", "b", 1024))]
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(*texts), MODEL).collect()} == {k: len(sp.encode(t)) for k, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in sentencepiece_codec.encode(frame(*texts), MODEL).collect()} == {k: sp.encode(t) for k, t in enumerate(texts)}


def test_greedy_parse():
    """Factors cover what the matches cover, don't overlap, and each reaches as far as any match at its place."""
    import random

    rng = random.Random(8)
    for _ in range(300):
        matches = [(rng.randrange(60), rng.randrange(5, 15), rng.randrange(3), rng.randrange(-2, 3)) for _ in range(rng.randrange(1, 12))]
        got = substring_dedup.parse(*map(np.array, zip(*matches, strict=True)))
        assert {k for a, e in got for k in range(a, e)} == {k for a, n, _, _ in matches for k in range(a, a + n)}
        assert all(e <= a for (_, e), (a, _) in zip(got, got[1:], strict=False))
        for a, e in got:
            assert e >= max(x + n for x, n, _, _ in matches if x <= a < x + n)


def test_substring_dedup_repeated_and_null_ids(spark):
    p = " ".join(f"w{k}" for k in range(60))
    rows = [(1, p), (1, p), (2, p), (2, "x " + p), (None, p), (None, None)]
    got = substring_dedup.kept_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(False, 1, 60, 0), (False, 1, 60, 0), (False, 2, 60, 60), (False, 2, 61, 60), (True, 0, 0, 0), (True, 0, 60, 0)]


def test_remove_spans_keeps_columns(docs, clashing, rows):
    want = {i: k for i, _, k in brute.kept_words([(r[0], r[1]) for r in rows])}
    out = substring_dedup.remove_spans(clashing)
    assert out.columns == clashing.columns and out.schema == clashing.schema
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert brute.SPACE.findall(r.text or "") == want[r.doc_id]
        assert (r.text is None) == (texts[r.doc_id] is None)
        if want[r.doc_id] == brute.SPACE.findall(texts[r.doc_id] or ""):
            assert r.text == texts[r.doc_id]
        else:
            assert r.n_chars == len(r.text)


def test_ngram_join(docs, rows, clashing):
    want = brute.components([(r[0], r[1]) for r in rows])
    assert len({c for _, c in want.values()}) < len(want)
    for df in (docs, clashing):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df).collect()} == want


def test_ngram_join_chains_and_thresholds(spark):
    """Chains in which only neighbours are similar, hot groups of variants, and similarities right at the threshold."""
    import random

    rng = random.Random(2)
    base = [f"b{k}" for k in range(100)]
    rows, now = [], list(base)
    for k in range(40):
        now = list(now)
        now[rng.randrange(100)] = f"n{k}"
        rows.append(" ".join(now))
    hot = [f"h{k}" for k in range(60)]
    for k in range(60):
        v = list(hot)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(60)] = f"v{rng.randrange(5)}"
        rows.append(" ".join(v))
    rows += [" ".join(f"t{k}" for k in range(n)) for n in range(4, 60)]  # prefixes of one another
    rows += [" ".join(hot[:20]) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(50)]
    docs = list(enumerate(rows))
    want = brute.components(docs)
    got = ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_keep_one_of_each(docs, clashing, rows):
    want = {i for i, (n, c) in brute.components([(r[0], r[1]) for r in rows]).items() if c == i}
    out = ngram_join.keep_one_of_each(clashing)
    assert out.columns == clashing.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None), (3, None), (None, ""), (None, "q r s t u v")]
    got = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == [(False, 1, "a b c d e f"), (False, 3, ""), (False, 3, ""), (True, 0, ""), (True, 0, "q r s t u v")]


def _items(rows):
    texts = {r[0]: r[1] for r in rows}
    long = brute.ALNUM.findall(texts[15])
    return [(1, " ".join(long[100:130])), (2, "one, TWO three!"), (3, None), (4, "..."), (10, texts[11]), (20, "É ü"), (5, "w9999 nowhere"), (None, "two three"), (6, "same same same same same same same same same same same")]


def test_decontamination(spark, docs, rows, clashing):
    items = _items(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in rows:
        n, hit, _ = brute.contamination(r[1], items)
        _, _, found = brute.contamination(r[1], [x for x in items if x[0] is not None])
        want.append((r[0], n, hit, len(found), brute.sha(",".join(found)), hit > 0))
    for df in (docs, clashing):
        assert sorted(map(tuple, decontamination.contamination(df, table).collect())) == sorted(want)
    clean = decontamination.drop_contaminated(clashing, table)
    assert clean.columns == clashing.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


CASES = ["ΑΣ.Β γ δ", "İstanbul Kelvin \u212a k K", "ΑΣ Β", "ας β"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_lowers_ascii_only(spark, monkeypatch, broadcast):
    """A final sigma, a dotted capital I and the Kelvin sign are what they are, whatever stands around them."""
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    items = [*enumerate(CASES), (9, "q r s t u v w x y z a b c d")]
    texts = [*enumerate([*CASES, *(f"xx {c} yy" for c in CASES), "k kelvin", "q r s t u v w x y z a b " * 3, None, ""])]
    got = decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = [(i, n, hit, len(found), brute.sha(",".join(found)), hit > 0) for i, t in texts for n, hit, found in [brute.contamination(t, items)]]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want[0][2] == 4


def test_decontamination_is_native(spark, docs, rows):
    plan = decontamination.contamination(docs, spark.createDataFrame(_items(rows), "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, none).where("contaminated or n_items > 0").count() == 0
    assert decontamination.drop_contaminated(docs, none).count() == docs.count()


def test_token_counts(docs, rows, clashing, sp):
    want = sorted((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows)
    for df in (docs, clashing):
        assert sorted(map(tuple, token_counts.count_tokens(df, MODEL).collect())) == want


def test_codec(docs, rows, clashing, sp):
    want = []
    for r in rows:
        ids = [sp.bos_id(), *sp.encode(r[1] or ""), sp.eos_id()]
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(sp.decode(ids))))
    for df in (docs, clashing):
        got = sentencepiece_codec.digest(df, MODEL).collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(want)
        assert all(r.covered for r in got)


def test_codec_round_trip_and_offsets(docs, rows, sp):
    coded = sentencepiece_codec.encode(docs, MODEL)
    texts = {r[0]: (r[1] or "") for r in rows}
    for r in coded.collect():
        raw = texts[r.doc_id].encode()
        assert r.ids == sp.encode(texts[r.doc_id])
        assert all(0 <= a <= b <= len(raw) for a, b in zip(r.begins, r.ends, strict=True))
        assert r.begins[1:] == r.ends[:-1] and (not r.ids or (r.begins[0] == 0 and r.ends[-1] == len(raw)))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, MODEL).collect()}
    assert back == {i: sp.decode(sp.encode(t)) for i, t in texts.items()}


def _char_map(pairs):
    """The compiled form of a small map: a double array in which a node's children are at its offset, exclusive or their byte."""
    forms, at, units, used, bases = b"", {}, {0: 0}, {0}, set()
    for key, form in sorted(pairs.items()):
        at[key] = len(forms)
        forms += form + b"\0"
    nodes = {k[:i] for k in pairs for i in range(len(k) + 1)}
    place = {b"": 0}
    for node in sorted(nodes, key=len):
        labels = sorted({n[len(node)] for n in nodes if len(n) == len(node) + 1 and n[:-1] == node} | ({0} if node in pairs else set()))
        here = place[node]
        offset = next(o for o in range(1, 1 << 20) if here ^ o not in bases and all((here ^ o ^ x) not in used for x in labels))
        bases.add(here ^ offset)
        units[here] = units.get(here, 0) | offset << 10 | (0x100 if node in pairs else 0)
        for x in labels:
            spot = here ^ offset ^ x
            used.add(spot)
            if x or node not in pairs:
                place[node + bytes([x])], units[spot] = spot, x
            else:
                units[spot] = 1 << 31 | at[node]
    array = np.zeros(max(units) + 1, "<u4")
    for k, v in units.items():
        array[k] = v
    return array.nbytes.to_bytes(4, "little") + array.tobytes() + forms


def test_longest_prefix_normalisation():
    """A hand-built map: the longest key wins, forms may be longer, shorter or empty, all else stays, and offsets point to the source."""
    from quern.llm._pieces import CharMap

    pairs = {b"a": b"A", b"ab": b"xyz", b"abc": b"", "é".encode(): b"e", "▁".encode(): b" ", b"f": b"\xe2\x96\x81"}
    m = CharMap(_char_map(pairs))
    for text in ("abcab aé", "", "zzabdé▁f", "你abc", "ab" * 50):
        raw, out, align, i = text.encode(), b"", [], 0
        while i < len(raw):
            key = max((k for k in pairs if raw.startswith(k, i)), key=len, default=None)
            size = len(key) if key else len(raw[i:].decode()[0].encode())
            form = pairs[key].replace("▁".encode(), b" ") if key else raw[i : i + size]
            out, align, i = out + form, align + [i] * len(form), i + size
        got, where = m.normalise(raw)
        assert got == out and where.tolist() == [*align, len(raw)], text


def test_codec_on_a_table(spark, sf_dir, sp):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL).collect()}
    assert got == {r["doc_id"]: len(sp.encode(r["text"] or "")) for r in texts}


def test_quality_rules(docs, rows, clashing):
    want = {r[0]: brute.statistics(r[1]) for r in rows}
    for df in (docs, clashing):
        for r in quality_rules.judge(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_rules_reject_outliers_only(spark):
    import random

    rng = random.Random(4)
    rows = [(k, " ".join("x" * rng.randint(2, 9) + str(rng.randrange(10**6)) for _ in range(rng.randint(80, 300))), "en", "s") for k in range(400)]
    rows += [(1000 + k, " ".join("#$%&*" * 3 + str(rng.randrange(10**6)) for _ in range(150)), "en", "s") for k in range(8)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + k] for k in range(8))
    assert sum(got[k] for k in range(400)) >= 396


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, total = got.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert total > 100 and right / total > 0.97


def test_language_of_rare_letters(spark):
    """Languages are told apart by letters that few texts of the sample have, and by letters beyond the numbered ones."""
    import random

    rng = random.Random(3)
    first = [chr(0x4E00 + k) for k in range(2000)]
    second = [chr(0x7000 + k) for k in range(2000)]
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60))
    rows = [(k, text(first if k % 2 else second), "aa" if k % 2 else "bb") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.fit(docs)).join(docs, "doc_id").where("held_out")
    right, total = got.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert total > 40 and right / total > 0.95


def test_language_cross_entropy(spark):
    """A text's bits for a character, against one n-gram at a time from plain counts."""
    from collections import Counter
    from math import log2

    rng = np.random.default_rng(1)
    train = [rng.integers(0, 6, 300).astype(np.uint16) for _ in range(3)]
    model = language_id.KneserNey(train)
    grams = Counter(tuple(([0] * 3 + s.tolist())[i : i + 4]) for s in train for i in range(len(s)))
    levels = [grams]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))

    def probability(gram):
        p = 1 / language_id.SYMBOLS
        for n, counts in enumerate(levels, 1):
            g = gram[4 - n :]
            n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            same = [c for k, c in counts.items() if k[:-1] == g[:-1]]
            if same:
                p = max(counts.get(g, 0) - off, 0) / sum(same) + off * len(same) / sum(same) * p
        return p

    text = rng.integers(0, 7, 50)
    padded = [0, 0, 0, *text.tolist()]
    codes = np.array([sum(x << language_id._BITS * k for k, x in enumerate(reversed(padded[i : i + 4]))) for i in range(50)], np.uint64)
    want = -sum(log2(probability(tuple(padded[i : i + 4]))) for i in range(50)) / 50
    assert abs(-np.log2(model.probability(codes)).mean() - want) < 1e-9


def test_language_cases(spark, docs, rows, clashing):
    model = language_id.fit(docs)
    for df in (docs, clashing):
        for r in language_id.predict(df, model).collect():
            text = dict((x[0], x[1]) for x in rows)[r.doc_id]
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
            assert 0 <= r.score <= 1 and (r.lang_pred != "und" or (r.score == 0 and r.rejected))
    none = language_id.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    kept = language_id.keep_identified(clashing, model)
    assert kept.columns == clashing.columns
    rejected = {r.doc_id for r in language_id.predict(docs, model).where("rejected").collect()}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - rejected


def test_language_probabilities_sum_to_one():
    """Of an interpolated model, the probabilities of all symbols after a context are one in sum."""
    rng = np.random.default_rng(0)
    model = language_id.KneserNey([rng.integers(0, 12, 4000).astype(np.uint16)])
    bits = language_id._BITS
    for a, b, c in ((0, 0, 0), (5, 3, 1), (60, 61, 62)):
        codes = (np.uint64(a | b << bits | c << 2 * bits) << np.uint64(bits)) | np.arange(language_id.SYMBOLS, dtype=np.uint64)
        assert abs(model.probability(codes).sum() - 1) < 1e-9


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    right, total = got.select(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert right / total > 0.95


def test_quality_cases(spark, docs, clashing, rows):
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows] + [(None, 1), (3, 7)], "doc_id long, quality int")
    for given in (labels, labels.where("quality = 1"), labels.where("false")):
        model = quality_classifier.fit(docs, given)
        for df in (docs, clashing):
            got = quality_classifier.score(df, model).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_lm_scoring(spark, docs, rows, clashing):
    model = lm_scoring.fit(docs)
    other = lm_scoring.fit(docs.repartition(7))
    assert all((x == y).all() for x, y in zip(model.flat, other.flat, strict=True)) and (model.spelling == other.spelling).all()
    texts = {r[0]: r[1] or "" for r in rows}
    want = {r.doc_id: r for r in lm_scoring.score(docs.repartition(5), model).collect()}
    for df in (docs, clashing):
        for r in lm_scoring.score(df, model).collect():
            n = len(brute.SPACE.findall(texts[r.doc_id]))
            assert r.n_tokens == n and r.log_prob <= 0 and (r.mean_log_prob is None) == (n == 0)
            assert n > 0 or r.log_prob == 0
            assert abs(r.log_prob - want[r.doc_id].log_prob) < 1e-5 * max(n, 1)  # single precision


def test_lm_log_probability_of_each_word(spark, rows):
    """Against one word at a time: all classes are one in sum, and so are all bytes after a byte."""
    text = "the cat sat, on the Mat the cat ran é#1 x"
    low = text.lower().split()
    common = sorted({int(X.bytes_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]): w for w in ("the", "cat", "on")}.items())
    rng = np.random.default_rng(3)
    flat = [rng.normal(0, 0.5, len(lm_scoring._initial())).astype(np.float32) for _ in range(2)]
    spelling = np.log(rng.dirichlet(np.ones(256), 256)).astype(np.float32)
    net = lm_scoring.Network(np.array([h for h, _ in common], np.uint64), flat, spelling)
    names = [w for _, w in common]
    words = text.split()
    shape = lambda w: (0 if len(w.encode()) < 4 else 1 if len(w.encode()) < 7 else 2 if len(w.encode()) < 11 else 3) * 8 + 4 * w[0].isupper() + 2 * ("#" in w) + (w[-1] in ".,;:!?")
    tok = [names.index(w) if w in names else lm_scoring.WORDS + shape(v) for w, v in zip(low, words, strict=True)]
    want = 0.0
    fold = spark.createDataFrame([(text,)], "text string").select(lm_scoring._fold()).first()[0]
    table, b1, wg, bg, ww, bw = lm_scoring._split(flat[1 - fold].astype(np.float64))
    for i, t in enumerate(tok):
        around = [tok[i + d] if 0 <= i + d < len(tok) else lm_scoring._EDGE for d in (-2, -1, 1, 2)]
        h = np.tanh(b1 + sum(table[k][a] for k, a in enumerate(around)))
        soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p = (soft(h @ wg + bg)[:, None] * np.array([soft(h @ w + b) for w, b in zip(ww, bw, strict=True)])).ravel()
        assert abs(p.sum() - 1) < 1e-9
        want += np.log(p[t])
        if t >= lm_scoring.WORDS:
            raw = b" " + low[i].encode() + b" "
            want += sum(float(spelling[a, b]) for a, b in zip(raw, raw[1:], strict=False))
    got = lm_scoring.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert abs(got.log_prob - want) < 1e-3


def test_lm_scoring_prefers_what_it_has_seen(spark):
    """The corpus has one order of words; the same words in another order, and words of no sense, are less likely."""
    import random

    rng = random.Random(1)
    order = [f"k{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join([f"u{k}", *order * 8])) for k in range(2000)], "doc_id long, text string")
    mixed = order * 8
    rng.shuffle(mixed)
    model = lm_scoring.fit(docs)
    new = [(0, " ".join(order * 8)), (1, " ".join(mixed)), (2, " ".join("".join(rng.choice("qxzj") for _ in w) for w in order * 8))]
    got = {r.doc_id: r.mean_log_prob for r in lm_scoring.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert got[0] > got[1] + 0.5 and got[1] > got[2]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        substring_dedup.kept_digest(empty), substring_dedup.remove_spans(empty), ngram_join.components(empty), ngram_join.keep_one_of_each(empty),
        decontamination.contamination(empty, items), decontamination.drop_contaminated(empty, items), token_counts.count_tokens(empty, MODEL),
        sentencepiece_codec.digest(empty, MODEL), sentencepiece_codec.encode(empty, MODEL), quality_rules.judge(empty),
        language_id.predict(empty, language_id.fit(empty)), language_id.keep_identified(empty, language_id.fit(empty)),
        quality_classifier.score(empty, quality_classifier.fit(empty, labels)), lm_scoring.score(empty, lm_scoring.fit(empty)),
    ):
        assert df.count() == 0


