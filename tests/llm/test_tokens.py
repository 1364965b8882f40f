"""Fill-in-the-middle, alignment and packing against plain Python and the libraries."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
from quern.llm import alignment, decontamination, fill_in_middle, packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
BITS = [
    "a", "B", "é", "É", "ß", "H̱", "İ", "Σ", "ς", "'s", "'LL", " ", "  ", "\n", "\t", "\x0b", " ", " ", "\x85", "́", "\x00", "\x1c", "1", "23", "²", "½", "٣", "你", "好", "\U0001f600",
    "the", "word", " The", "<|endoftext|>", "<|startoftext|>", "<|", "</s>", "<unk>", "<P>", "<S>", "<M", ">", "×", ",", ".", "-", "_", "à.",
]
ODD = [None, "", " ", "\n", " lead", "trail  ", "\n\n x", "你好" * 2000, "a ▁ b", "x" * 5000, "<P>", "same text", "same text"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    return [*enumerate(ODD + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(300)]), (None, "no id"), (None, None), (5, "same id"), (5, "same id")]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, "x", "x", "x", 1) for i, t in texts]  # further columns with names that the operators use
    return spark.createDataFrame(rows, "doc_id long, text string, start string, block string, ids string, n long").repartition(3)


def units(text, unit):
    """Text in the units of fill_in_middle."""
    if unit == "char":
        return list(text)
    return re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"[^\S\x1c-\x1f]+|[\S\x1c-\x1f]+", text)


def middle(doc_id, text, unit="char"):
    parts = units(text or "", unit)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n, text = len(parts), text or ""
    if not text or any(m in text for m in fill_in_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(table, texts, unit):
    done = fill_in_middle.transform(table, unit)
    got = sorted((tuple(r) for r in done.collect()), key=key)
    assert got == sorted(((i, *middle(i, t, unit)) for i, t in texts), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = done.select("doc_id", fill_in_middle.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=key) == sorted(((i, t or "") for i, t in texts), key=key)


def test_fill_in_middle_digest(table, texts):
    got = sorted((tuple(r) for r in fill_in_middle.digest(fill_in_middle.transform(table)).collect()), key=key)
    assert got == sorted(((i, *(m := middle(i, t))[:4], brute.sha(m[4]), brute.sha(t or "")) for i, t in texts), key=key)


def test_fill_in_middle_keeps_bytes_that_are_no_text(spark):
    raw = b"ab\xff\xc3 \xe4\xbd cd"
    df = spark.createDataFrame([(k, raw) for k in range(60)], "doc_id long, b binary").select("doc_id", F.expr("CAST(b AS STRING)").alias("text"))
    done = fill_in_middle.transform(df)
    assert {bytes(r.t) for r in done.select(fill_in_middle.restored(F.col("form"), F.col("output")).cast("binary").alias("t")).collect()} == {raw}
    assert {r.n for r in done.collect()} == {10}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aa", "b", "c"), ("<", "<S>", "<M>"), ("ab", "b", "c")])
def test_fill_in_middle_refuses_marks_that_overlap(table, marks):
    with pytest.raises(ValueError, match="marks"):
        fill_in_middle.transform(table, marks=marks)


# --- packing ----------------------------------------------------------------------------------------------------------


def laid_out(plan, counts):
    """Pieces of each sequence as (offset, tokens), having checked that each rank's pieces cover it without a gap."""
    by, cover = defaultdict(list), defaultdict(list)
    for of, lo, hi, start, tokens, run, copies, sequence, offset in plan.rows:
        for rank in range(lo, hi):
            k = run + rank - lo
            by[sequence + k // copies].append((offset + k % copies * tokens, tokens))
            cover[of, rank].append((start, tokens))
    for (of, _), spans in cover.items():
        at = 0
        for start, tokens in sorted(spans):
            assert start == at and tokens > 0
            at += tokens
        assert at == of
    assert Counter(of for of, _ in cover) == Counter({s: n for s, n in counts.items() if n})
    return by


def padding(sequences, capacity):
    """Having checked that each sequence is filled from 0 without a gap and not beyond the capacity."""
    out = 0
    for spans in sequences.values():
        at = 0
        for offset, tokens in sorted(spans):
            assert offset == at
            at += tokens
        assert at <= capacity
        out += capacity - at if at & (at - 1) else 0
    return out


def test_plan_pads_nothing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([8, 16, 64])
        counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 80))))
        plan = packing.Plan(counts, capacity)
        by = laid_out(plan, counts)
        assert set(by) == set(range(plan.sequences)) and padding(by, capacity) == 0
    for counts in ({2049: 10_001}, {2049: 1000, 1: 3}, {4096: 5}, {1: 4095}):
        assert padding(laid_out(packing.Plan(counts, 4096), counts), 4096) == 0


def test_plan_is_small_for_many_pieces():
    counts = {k: 10**12 + k for k in range(1, 4097, 7)}
    plan = packing.Plan(counts, 4096)
    assert len(plan.rows) < 50_000
    assert sum((r[2] - r[1]) * r[4] for r in plan.rows) == sum(k * n for k, n in counts.items())


def test_fill_is_the_closest_sum():
    rng = random.Random(8)
    for _ in range(300):
        counts = {rng.randint(1, 12): rng.randint(0, 3) for _ in range(rng.randint(0, 4))}
        target = rng.randint(0, 30)
        sums = {0}
        for size, n in counts.items():
            sums = {s + size * k for s in sums for k in range(n + 1)}
        got = packing.fill(counts, target)
        assert all(n <= counts[s] for s, n in got.items())
        assert sum(s * n for s, n in got.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(table, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in texts]
    rows = packing.pack(table, WORDS, capacity).collect()
    sequences, starts = defaultdict(list), defaultdict(Counter)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert padding(sequences, capacity) == 0
    for i in {i for i, _ in texts}:
        own = [x for (j, _), x in zip(texts, ids, strict=True) if j == i]
        assert sum(n * c for (_, n, _, _), c in starts[i].items()) == sum(map(len, own))
        for (start, n, crc, total), _ in starts[i].items():
            assert any(len(x) == total and zlib.crc32(np.array(x[start : start + n], "<u4").tobytes()) == crc for x in own)
    with_ids = packing.pack(table, WORDS, capacity, with_ids=True).collect()
    assert sorted((tuple(r)[:-1] for r in with_ids), key=key) == sorted((tuple(r) for r in rows), key=key)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids)


def test_packing_nothing(table):
    assert packing.pack(table.limit(0), WORDS).count() == 0


# --- alignment --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligned(texts):
    """Per text: groups as text and the links, from whole encodings and a walk over both lists of ends."""
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    name = {k: len(t) for t, k in a_model.get_vocab().items()}
    out = []
    for _, t in texts:
        if not t or "▁" in t:
            out.append(None)
            continue
        a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        a_end = np.cumsum([name[x] for x in a]).tolist()
        b_end = np.cumsum([1 if b_model.is_byte(x) else len(b_model.id_to_piece(x).replace("▁", " ").encode()) for x in b]).tolist()
        assert a_end[-1] == b_end[-1] == len(t.encode()) + 1
        groups = [([x for x, e in zip(a, a_end, strict=True) if lo < e <= hi], [x for x, e in zip(b, b_end, strict=True) if lo < e <= hi]) for cuts in [sorted({0, *a_end} & {0, *b_end})] for lo, hi in zip(cuts, cuts[1:], strict=False)] if len(t) < 3000 else None
        links, j = [], 0
        for x, lo, hi in zip(a, [0, *a_end], a_end, strict=False):
            while b_end[j] <= lo:
                j += 1
            k = j
            while k < len(b) and (b_end[k - 1] if k else 0) < hi:
                links.append((x, b[k]))
                k += 1
        out.append((len(a), len(b), groups, links))
    return out


def test_alignment(table, texts, aligned):
    counts = Counter(x for r in aligned if r for x in r[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for (i, _), r in zip(texts, aligned, strict=True):
        if r is None:
            want.append((i, 0, 0, 0, 0, 0, ""))
        else:
            text = None if r[2] is None else brute.sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2]))
            want.append((i, r[0], r[1], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), text))
    rows = alignment.digest(table, BYTES, PIECES).collect()
    got = [(r.doc_id, r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]
    long = {i for (i, _), r in zip(texts, aligned, strict=True) if r and r[2] is None}
    blank = lambda r: (*r[:-1], None) if r[0] in long else r
    assert sorted(map(blank, got), key=key) == sorted(map(blank, want), key=key)
    assert sorted((r.doc_id, r.n_groups) for r in rows if r.doc_id is not None and r.doc_id not in long) == sorted((i, len(r[2]) if r else 0) for (i, _), r in zip(texts, aligned, strict=True) if i is not None and i not in long)
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)


def test_alignment_in_small_blocks_and_with_rare_pairs(table, aligned):
    whole = alignment.digest(table, BYTES, PIECES)
    found = alignment.align(table, BYTES, PIECES, block=200)
    counts = alignment.pair_counts(found)
    assert {((r.a_id, r.b_id), r.n) for r in counts.collect()} == set(Counter(x for r in aligned if r for x in r[3]).items())
    got = alignment.summaries(found, counts, frequent=50).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in whole.collect()), key=key)


def test_alignment_sorts_tokens_once(table, monkeypatch):
    plans = {}

    def seen(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return bucketed(df, name, *rest)

    bucketed = alignment.bucketed
    monkeypatch.setattr(alignment, "bucketed", seen)
    alignment.align(table, BYTES, PIECES)
    assert plans["aligned"].count("Sort [") == 1
    assert not any(x in plans["aligned"] for x in ("Window", "Exchange", "Join"))


def test_alignment_of_nothing(table):
    assert alignment.digest(table.limit(0), BYTES, PIECES).count() == 0


def test_alignment_refuses_other_models(table):
    with pytest.raises(ValueError, match="byte-level"):
        alignment.align(table, WORDS, PIECES)


# --- decontamination of rows without an id ----------------------------------------------------------------------------


def test_decontamination_of_null_and_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"x {item} y"), (None, "clean words"), (None, None), (1, item), (1, "clean"), (1, item), (2, "clean")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, "clean words"), (None, "y")], "item_id long, text string")
    want = []
    for i, t in rows:
        n, hit, _ = brute.contamination(t, [(7, item), (8, "clean words"), (9, "y")])
        _, _, found = brute.contamination(t, [(7, item), (8, "clean words")])
        want.append((i, n, hit, len(found), brute.sha(",".join(found)), hit > 0))
    assert sorted((tuple(r) for r in decontamination.contamination(docs, items).collect()), key=key) == sorted(want, key=key)
    assert sorted((tuple(r) for r in decontamination.drop_contaminated(docs, items).collect()), key=key) == sorted([(None, None), (1, "clean"), (2, "clean")], key=key)


@pytest.mark.parametrize("limit", ["BROADCAST_WINDOWS", "BROADCAST_DOCUMENTS"])
def test_decontamination_without_broadcasts(spark, monkeypatch, docs, rows, limit):
    items = spark.createDataFrame([(r[0], " ".join((r[1] or "").split()[3:40])) for r in rows[::2]], "item_id long, text string")
    with_them = sorted((tuple(r) for r in decontamination.contamination(docs, items).collect()), key=key)
    monkeypatch.setattr(decontamination, limit, 0)
    assert sorted((tuple(r) for r in decontamination.contamination(docs, items).collect()), key=key) == with_them
