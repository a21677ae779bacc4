"""Each operator against a brute-force version on small tables, with the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, quality, substring_dedup, suffix_dedup, token_store, toxicity
from quarry.llm.components import components
from quarry.llm import windows as win
from tests.llm.conftest import corpus, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(df) -> dict:
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# 1 ---------------------------------------------------------------------------------------------

def test_decontaminate(spark, docs):
    window = " ".join(corpus()[0][1].split()[20:32])
    items = [(7, window.upper()), (7, "no such words at all here in any of the documents anywhere"), (8, "three"), (9, "..."), (10, None), (11, window.replace(" ", "--"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.report(docs, bench))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall((t or "").translate(decontaminate._LOWER))
    for doc_id, text, *_ in corpus():
        words, hit, ids = low(text), set(), set()
        for item, t in items:
            w = low(t)
            k = min(10, len(w))
            wins = {tuple(w[i : i + k]) for i in range(max(1, len(w) - 9))} if w else set()
            for i in range(len(words) - k + 1):
                if k and tuple(words[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
        row = got[doc_id]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (len(words), len(hit), len(ids), bool(hit))
        assert row["items_sha256"] == sha(",".join(sorted(ids)))
        if hit and text:
            assert low(text[row["char_from"][0] : row["char_to"][0]]) == words[min(hit) : min(hit) + len(low(text[row["char_from"][0] : row["char_to"][0]]))]
    # several automata give the same
    many = by_id(decontaminate.report(docs, bench, max_item_chars=1))
    assert {k: v["items_sha256"] for k, v in many.items()} == {k: v["items_sha256"] for k, v in got.items()}
    assert {k: v["n_hit"] for k, v in many.items()} == {k: v["n_hit"] for k, v in got.items()}
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {k for k, v in got.items() if not v["contaminated"]}


def test_decontaminate_odd(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(nothing, none).count() == 0
    assert {r["n_hit"] for r in decontaminate.report(odd, none).collect()} == {0}
    null_id = spark.createDataFrame([(None, prose(1, 200))], "item_id long, text string")
    assert sum(r["contaminated"] for r in decontaminate.report(odd, null_id).collect()) == 4
    assert decontaminate.remove(odd, null_id).columns == odd.columns


def test_decontaminate_chunks_keep_rows(spark, odd):
    items = [(None, prose(1, 200)), (5, prose(9, 120)), (6, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = lambda **options: sorted(map(repr, decontaminate.report(odd, bench, **options).collect()))
    assert told(max_item_chars=1) == told()
    assert len(told(max_item_chars=1)) == odd.count()
    assert sorted(r["n_hit"] for r in decontaminate.report(odd, bench, max_item_chars=1).collect()) == [0, 0, 120, 200, 200, 200, 201]


# 2, 5 ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        toxic, bad = i % 4 == 0, i % 5 == 0
        text = prose(100 + i, 120)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            w = text.split(" ")
            w[50] = "grobian"
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, ""), (1001, None)]
    labels += [(1000, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, column, mod", [(toxicity, "toxic", (5, 0)), (quality, "quality", (3, 1))])
def test_classifiers(labelled, operator, column, mod):
    docs, labels = labelled
    got = by_id(operator.report(docs, labels))
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r["doc_id"] is not None and r[column] is not None}
    held = {d for d in truth if zlib.crc32(str(d).encode()) % mod[0] == mod[1]}
    assert all(got[d]["held_out"] == (d in held) for d in truth)
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"]


def test_toxic_sentences_are_located(labelled):
    docs, labels = labelled
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.report(docs, labels).collect():
        for a, b in zip(r["sentence_from"], r["sentence_to"]):
            assert "grobian" in texts[r["doc_id"]][a:b].lower()


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_odd(spark, odd, nothing, operator):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert operator.report(odd, labels).count() == odd.count()
    assert operator.report(nothing, labels).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert operator.report(odd, one).count() == odd.count()


# 3 ---------------------------------------------------------------------------------------------

def test_wavelet_matrix():
    r = np.random.default_rng(5)
    for n, top in ((0, 4), (1, 2), (9000, 300), (5000, 3)):
        v = r.integers(0, top, n).astype(np.uint16)
        m = token_store.WaveletMatrix.build(v, 9)
        assert (m.values() == v).all()
        for i in r.integers(0, max(n, 1), 20) if n else []:
            assert m.access(int(i)) == v[i]
            at = np.flatnonzero(v == v[i])
            k = int(np.searchsorted(at, i))
            assert m.occurrence(int(v[i]), k) == i and m.count(int(v[i])) == len(at) and m.count(int(v[i]), int(i)) == k
        with pytest.raises(IndexError):
            m.occurrence(top + 1, 0)


@pytest.mark.parametrize("shard_tokens", [1 << 21, 700])
def test_token_store(docs, shard_tokens):
    got = by_id(token_store.report(docs, TOKENIZER, shard_tokens=shard_tokens))
    plain, start = Tokenizer.from_file(TOKENIZER), 0
    for doc_id, text, *_ in corpus():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert got[doc_id] == {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_encoder_equals_library():
    odd = ["it's don't 'S x'T", "a<|endoftext|>b <|ENDOFTEXT|>", "É é İ K ΑΣ ΣΣ", "3.14 a_b $$$a1b2 日本語 テスト", "́a ́", "tab\tnew\x1cfs\x85nel\xa0nbsp", "", "  ", "ab日 x,é日 é×ß ÷ é, été“, “a” J̌ ǰ 3́ É9é!¡", "ñandú; Ö.Ö--ö"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = token_store.Encoder(public_tokenizers.path(name))
        assert e.by_word == name.startswith("word")
        assert [x.tolist() for x in e.encode(odd)] == [x.ids for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_encoder_equals_library_on_random_words():
    """Apostrophes, signs, digits, marks of special tokens and letters of many kinds beside each other."""
    r = random.Random(1)
    atoms = ["'", "'s", "'S", "'t", "'re", "'ll", "don't", "It's", "cat", "Cat", "É", "é", "ß", "ñ", "Ü", "x", "Q", "7", "42", "3.5", "$", "!?", "...", "(red)", "<|", "<|endoftext|>",
             "<|startoftext|>", "<|EndOfText|>", "|>", " ", "  ", "\n", "\t", "\xa0", "\u2028", "\x85", "\x1c", "\x01", "\x7f", "\u0301", "\u030a", "W", "w", "日本", "µ", "×", "÷", "İ", "Σ", "ς", "😀",
             "²", "½", "ﬁ", "-", "_", "&amp;", "a\u0301", "\x00", "\u212b", "ﷺ", "\u200d", "\ufeff", "٣"]
    e = token_store.Encoder(TOKENIZER)
    assert e.by_word
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(0, 9))) for _ in range(50_000)]
    texts += ["don't stop, please.", "It's 2024, isn't it?", "the cat's hat (red).", "He said 'go' 25 times."]
    for mine, theirs in zip(e.encode(texts), e._plain(texts), strict=True):
        assert mine.astype(e.type).tobytes() == theirs


def test_encoder_of_long_texts_and_small_memory(monkeypatch):
    """Texts beyond a slice are taken in parts; a memory that turns over often changes nothing."""
    monkeypatch.setattr(token_store, "SLICE_BYTES", 1_000)
    monkeypatch.setattr(token_store, "MEMORY_BYTES", 40_000)
    e = token_store.Encoder(TOKENIZER)
    texts = [prose(i, n) + tail for i, (n, tail) in enumerate([(3, ""), (4_000, " it's"), (0, ""), (900, "é" * 3_000), (5_000, "\n"), (40, "x" * 5_000)])]
    for mine, theirs in zip(e.encode(texts), e._plain(texts), strict=True):
        assert mine.tobytes() == theirs
    assert e.memory.size <= 40_000 and len(e.memory.old)


def test_token_store_odd(odd, nothing, spark, tmp_path):
    assert token_store.report(odd, TOKENIZER).count() == odd.count()
    assert token_store.report(nothing, TOKENIZER).count() == 0
    token_store.write(odd, str(tmp_path / "t"), TOKENIZER, shard_tokens=50)
    assert token_store.occurrences(spark, str(tmp_path / "t"), 1).groupBy().sum("n").first()[0] >= odd.count()


# 4 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [4096, 16, 3])
def test_exact_dedup(docs, block_bytes):
    got = by_id(exact_dedup.groups(docs, block_bytes=block_bytes))
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus():
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            assert got[doc_id] == {"doc_id": doc_id, "keep_id": keep, "group_size": len(members), "kept": doc_id == keep, "text_sha256": sha(norm)}


def test_exact_dedup_survives_digest_collisions(docs):
    weak = lambda block: exact_dedup.F.substring(block, 1, 1)
    got = by_id(exact_dedup.groups(docs, block_bytes=32, digests=(weak, exact_dedup.sha(256))))
    assert got == by_id(exact_dedup.groups(docs))
    with pytest.raises(RuntimeError):
        exact_dedup.groups(docs, block_bytes=32, digests=(weak,))


def test_exact_dedup_odd(odd, nothing):
    assert exact_dedup.groups(nothing).count() == 0
    rows = exact_dedup.groups(odd).collect()
    assert len(rows) == odd.count()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"]) for r in rows if r["group_size"] == 3) == [(-1, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert exact_dedup.dedup(odd).columns == odd.columns


# 6 ---------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if c == old else c for d, c in label.items()}
    return {d: (len(s), label[d]) for d, s in sets.items()}


def near_copies():
    rows, n = [], 0
    for g in range(6):
        words = prose(50 + g, 60 + 40 * g).split()
        for k in range(25):
            w = list(words)
            for j in range(k % 5):
                w[(7 * k + 31 * j) % len(w)] = f"edit{k}{j}"
            rows.append((n, " ".join(w + ["tail"] * (k % 3))))
            n += 1
    shared = prose(77, 70)
    return rows + [(n + i, prose(200 + i, 30 + 9 * i) + " " + shared) for i in range(20)]


def test_jaccard_join(spark, docs):
    for rows, frame in ((near_copies(), spark.createDataFrame(near_copies(), "doc_id long, text string")), ([r[:2] for r in corpus()], docs)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(frame).collect()}
        assert got == brute_components(rows)


def test_jaccard_border(spark):
    # 9 shingles of 11: 100 * 9 / 11 = 81.8; 8 of 10 is exactly 80; 7 of 9 is below
    a = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join([*a, "x", "y"])), (3, " ".join(a[2:] + ["q", "r"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in brute_components(rows).items()}


def test_jaccard_odd(odd, nothing):
    assert jaccard_join.link(nothing).count() == 0
    assert jaccard_join.link(odd).count() == odd.count()
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("text IS NULL OR text = ''").count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 7, 9 ------------------------------------------------------------------------------------------

def test_sliding_min_and_runs():
    v = np.random.default_rng(3).integers(0, 1 << 60, 500).astype(np.uint64)
    for width in (1, 2, 7, 500):
        assert win.sliding_min(v, width).tolist() == [v[i : i + width].min() for i in range(len(v) - width + 1)]
    key, first, last = win.runs(v, 20, 5)
    assert first[0] == 0 and last[-1] == 480 and (first[1:] == last[:-1] + 1).all()


@pytest.mark.parametrize("max_classes", [5000, 1])
def test_substring_dedup(docs, max_classes):
    got = by_id(substring_dedup.report(docs, max_classes=max_classes))
    seen = set()
    for doc_id, text, *_ in corpus():
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone |= set(range(i, i + 20))
            seen.add(k)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert got[doc_id] == {"doc_id": doc_id, "n_words": len(w), "n_removed": len(gone), "kept_sha256": sha(kept)}


@pytest.mark.parametrize("max_classes, batches", [(5000, 4), (1, 1), (5000, 7)])
def test_suffix_dedup(docs, max_classes, batches):
    got = by_id(suffix_dedup.report(docs, max_classes=max_classes, batches=batches))
    raws = {d: (t or "").encode() for d, t, *_ in corpus()}
    count = Counter(raw[i : i + 400] for raw in raws.values() for i in range(len(raw) - 399))
    for doc_id, raw in raws.items():
        edges = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 399):
            if count[raw[i : i + 400]] > 1:
                edges[i] += 1
                edges[i + 400] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        assert got[doc_id] == {"doc_id": doc_id, "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": sha(kept)}


def test_index_family_levels(spark):
    family = suffix_dedup.IndexFamily()
    rows = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "key long, digest long")
    found = [sorted({r["key"] for r in family.add(rows(*keys)).collect()}) for keys in ((1, 2), (2, 3), (4, 4), (1,), (9, 3))]
    assert found == [[], [2], [4], [1], [3]]
    assert [rank for rank, _ in family.levels] == [2, 0]


def test_substring_dedup_unmarked_endings(spark):
    rows = [(i, a + "foo" + b + end + c) for i, (a, b, end, c) in enumerate((a, b, e, c) for a in ("", " ") for b in ("", " ", "\t\n") for e in ("", "\x85", "\u2028", "\u2029", "\xa0") for c in ("", " ", "\n"))]
    got = by_id(substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")))
    for doc_id, text in rows:
        words = substring_dedup.split(text)
        assert got[doc_id] == {"doc_id": doc_id, "n_words": len(words), "n_removed": 0, "kept_sha256": sha(b" ".join(words))}


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, line_dedup])
def test_repeats_odd(odd, nothing, operator):
    assert operator.report(nothing).count() == 0
    assert operator.report(odd).count() == odd.count()


# 8 ---------------------------------------------------------------------------------------------

def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "b\nc\nd\na\nb\nc\nd")]
    got = by_id(line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")))
    seen = set()
    for doc_id, text in rows:
        lines, gone = [] if text is None else text.split("\n"), set()
        for i in range(len(lines) - 2):
            k = tuple(lines[i : i + 3])
            if k in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(k)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert got[doc_id] == {"doc_id": doc_id, "n_lines": len(lines), "n_removed": len(gone), "kept_sha256": sha(kept)}


def test_line_dedup_keeps_columns(odd):
    out = line_dedup.clean(odd.withColumnRenamed("n", "n_removed"))
    assert set(odd.columns) - {"n"} <= set(out.columns)


# 10 --------------------------------------------------------------------------------------------

def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), (None, "a", "b", "B", "c")[min(i % 11, 4)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame).collect()
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s], left = 3.0 * total[s], left - 3.0 * total[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 38 for s in order)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()))
    copies = Counter(r["doc_id"] for r in mixing.take(frame).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})


def test_mixing_odd(odd, nothing, docs):
    assert mixing.mix(nothing).count() == 0 and mixing.take(nothing).count() == 0
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.take(odd).columns == odd.columns
    assert mixing.mix(docs.filter("doc_id IN (7, 8, 9)")).agg({"taken": "sum"}).first()[0] == 0
