"""Packing, source divergence and collocations against brute force and on odd inputs."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import awkward, clashing
from tokenizers import Tokenizer

import corpus_pipeline
from proofline.llm import byte_words, collocations, divergence, mixing, packing, queries

SF = "/root/testdata/sf0.001"
FIRST = "doc_id long, text string, lang string, source string, n_chars long"


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11
@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(queries.TOKENIZER)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def ids():
    return packing.Ids(queries.TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("ab 1.'s\n\t é　\xa0\x1c\x85中\U0001f600́I'll<|endoftext|>")), max_size=40) | st.text(max_size=40))
def test_ids_are_those_of_the_tokenizer(tokenizer, ids, text):
    assert ids.of(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_levels_leave_the_least_sum_of_squares():
    rng, packer, seen = random.Random(4), packing.Packer(32), 0
    for k in range(2000):
        size = rng.randint(1, 31)
        counts = packer.counts.tolist()

        def after(level, counts=counts, size=size):
            now = list(counts)
            now[level] -= level > 0
            now[level + size] += level + size < 32
            return sum(n * n for n in now)

        levels = [h for h in range(32 - size + 1) if h == 0 or counts[h]]
        assert packer.level_for(size) == max(levels, key=lambda h: (-after(h), h))
        seen += sum(1 for _ in packer.add((k, size), np.zeros(size, np.uint32)))
    assert seen > 800 and seen + packer.counts.sum() < 1100


def check_packing(docs, pieces, tokenizer, capacity=1024):
    """Pieces give back every document's ids, and sequences are full or powers of two, without a gap."""
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    sequences, parts = defaultdict(list), defaultdict(dict)
    for p in pieces:
        found = np.frombuffer(p.ids, "<u4")
        assert len(found) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id, p.doc_tokens].setdefault(p.start, []).append(tuple(found.tolist()))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    if len(parts) == len(docs):
        assert want == Counter((i, tuple(x for start in sorted(p) for x in p[start][0])) for (i, _), p in parts.items())
    assert sum(len(t) * n for (_, t), n in want.items()) == sum(length for placed in sequences.values() for _, length in placed)
    return sequences


def test_packing_gives_back_every_document(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(docs.repartition(3, "doc_id"), queries.TOKENIZER).collect()
    sequences = check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces, tokenizer)
    short = sum(sum(n for _, n in placed) < 1024 for placed in sequences.values())
    assert short <= 3 * 10
    found = queries.op11_packing(spark, SF)
    assert dict(found.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert sorted(found.collect()) == sorted(queries.op11_packing(spark, SF).collect())


def test_packing_of_odd_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 3000), (4, "x" * 5000), (5, "same"), (6, "same"), (7, " \x1c é<|endoftext|>")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).coalesce(1)
    check_packing(rows, packing.pack(docs, queries.TOKENIZER, capacity=64).collect(), tokenizer, 64)
    again = spark.createDataFrame([(9, "same")] * 5, "doc_id long, text string")
    found = packing.pack(again, queries.TOKENIZER).collect()
    assert sum(p.length for p in found) == 10 and {p.start for p in found} <= {0, 1}
    assert packing.pack(docs.where("false"), queries.TOKENIZER).count() == 0


# 12
def test_slices_of_one_hash_are_told_apart_by_their_bytes():
    texts = pa.array(["the cat THE mat", None, "", "cat? dog", "é-É"])
    data, offsets = byte_words.buffer_of(texts)
    for hashed in (len, lambda value: 7, None):
        words = byte_words.words_of(data, offsets, divergence.TERM_BYTES, **({"hashed": hashed} if hashed else {}))
        found = [(int(t), words.distinct[c].decode()) for t, c in zip(words.text, words.code, strict=True)]
        assert found == [(0, "the"), (0, "cat"), (0, "the"), (0, "mat"), (3, "cat"), (3, "dog"), (4, "é"), (4, "É")]
        assert len(set(words.distinct)) == len(words.distinct) == len(words.hashes)


def test_long_texts_are_cut_where_they_may_be():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab ", k=rng.choice([0, 5, 300]))) for _ in range(40)] + ["a" * 500]
    data, offsets = byte_words.buffer_of(pa.array(texts))
    parts = defaultdict(list)
    for text, begin, bounds in byte_words.chunks(data, offsets, ~divergence.TERM_BYTES, most=64):
        words = byte_words.words_of(data[begin : begin + int(bounds[-1])], bounds, divergence.TERM_BYTES)
        for t, c in zip(words.text.tolist(), words.code.tolist(), strict=True):
            parts[text + t].append(words.distinct[c].decode())
    assert all(parts[k] == text.split() for k, text in enumerate(texts))


def divergence_by_hand(rows, best=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower_az(text))) for text, lang, source in rows]
    found = []
    for lang in {x for x, _, _ in terms}:
        held = Counter(t for x, _, words in terms if x == lang for t in set(words))
        kept = sorted(t for t, n in held.items() if n >= 3)
        counts = {s: Counter(t for x, y, words in terms if (x, y) == (lang, s) for t in words if t in held and held[t] >= 3) for s in {y for x, y, _ in terms if x == lang}}
        whole = sum(counts.values(), Counter())

        def part(c, t, v=len(kept)):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v)

        def gain(a, b, t):
            p, q = part(a, t), part(b, t)
            return (p - q) * (p - q) // q

        for s, own in counts.items():
            pairs = sorted(((-sum(gain(own, c, t) for t in kept), o.encode(), o) for o, c in counts.items() if o != s))
            found += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            tops = sorted((-gain(own, whole, t), t.encode(), t) for t in kept if own[t] and part(own, t) > part(whole, t))[:best]
            found += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(tops)]
    return sorted(found)


def test_divergences_are_those_of_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["the", "Über", "naïve", "x1y", "日本", "Zebra"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "zz"])) for _ in range(120)]
    rows += [(None, "en", "a"), ("", "fr", "only"), ("solo", "it", "p"), ("solo", "it", "q"), ("rare " * 9, "en", "void")] + [("word " * 400, "en", "b")]
    docs = clashing(spark.createDataFrame([(k, t, x, s, 0) for k, (t, x, s) in enumerate(rows)], FIRST)).repartition(3)
    want = divergence_by_hand(rows)
    for terms_per_block in (3, 4096):
        assert sorted(map(tuple, divergence.source_divergence(docs, terms_per_block=terms_per_block).collect())) == want
    assert sorted(map(tuple, divergence.source_divergence(docs, best=2).collect())) == divergence_by_hand(rows, best=2)
    assert divergence.source_divergence(docs.where("false")).count() == 0


def test_parts_are_exact_beyond_64_bits():
    rng = random.Random(1)
    totals = [rng.randrange(1, 10**15) for _ in range(200)] + [10**15, 1]
    for total in totals:
        counts = [rng.randrange(0, total + 1) for _ in range(5)] + [total, 0]
        assert divergence.parts_of(np.array(counts, np.int64), total).tolist() == [1 + 10**9 * c // total for c in counts]


def test_a_text_in_several_parts_counts_once(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "source": ["a", "b"], "text": ["one two " * 50, "one"]})
    monkeypatch.setattr(byte_words, "CHUNK_BYTES", 64)
    monkeypatch.setattr(divergence, "chunks", lambda *args: byte_words.chunks(*args, most=64))
    tally = defaultdict(lambda: [0, 0])
    for rows in divergence._counted(iter([batch])):
        for r in rows.to_pylist():
            if r["term"]:
                tally[r["source"], r["term"]][0] += r["n"]
                tally[r["source"], r["term"]][1] += r["docs"]
    assert tally == {("a", "one"): [50, 1], ("a", "two"): [50, 1], ("b", "one"): [1, 1]}


def test_the_counts_of_a_languages_term_leave_a_chunk_as_one_row():
    rows = {"lang": ["en", "de", "en", "en", "de"], "source": ["a", "a", "b", "a", "c"], "text": ["two one", "one", "one ONE", "one", "1 2"]}
    found = [row for part in divergence._gathered(iter([pa.RecordBatch.from_pydict(rows)])) for row in part.to_pylist()]
    tally = {(r["lang"], r["term"]): sorted((c["source"], c["n"], c["docs"]) for c in r["cells"]) for r in found}
    assert len(found) == 3 and tally == {("en", "one"): [("a", 2, 2), ("b", 2, 1)], ("en", "two"): [("a", 1, 1)], ("de", "one"): [("a", 1, 1)]}


# 13
def collocations_by_hand(rows, least, longest=3, best=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[k : k + n])) for n in range(1, longest + 1) for k in range(len(words) - n + 1))
    candidates = {(x, p): n for (x, p), n in counts.items() if len(p) > 1 and n >= least}
    longer = Counter()
    for (lang, p), n in candidates.items():
        for m in range(2, len(p)):
            for k in range(len(p) - m + 1):
                longer[lang, p[k : k + m]] = max(longer[lang, p[k : k + m]], n)
    by_lang = defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] >= 50 * a:
            continue
        score, k = min((int(Fraction(1_000_000 * a * a, counts[lang, p[:k]] * counts[lang, p[k:]])), k) for k in range(1, len(p)))
        by_lang[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, k + 1, p.decode(), -a, left, right, totals[lang], -score) for lang, found in by_lang.items() for k, (score, a, p, left, right) in enumerate(sorted(found)[:best]))


@pytest.mark.parametrize(("least", "longest", "bits"), [(2, 3, 6), (3, 4, 20), (10, 2, None), (10, 3, None)])
def test_collocations_are_those_of_brute_force(spark, least, longest, bits):
    rng = random.Random(least)
    words = ["New", "york", "city", "the", "of", "é", "日本", "don't", "a\x0bb"] + [f"w{k}" for k in range(30)]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rng.randrange(0, 80))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), ("new york city " * 60, "en"), ("same same same same " * 10, None), ("lone", "fr")]
    docs = clashing(spark.createDataFrame([(k, t, x, None, 0) for k, (t, x) in enumerate(rows)], FIRST)).repartition(3)
    assert sorted(map(tuple, collocations.collocations(docs, least=least, longest=longest, bucket_bits=bits).collect())) == collocations_by_hand(rows, least, longest)
    assert sorted(map(tuple, collocations.collocations(docs, least=least, longest=longest, best=5, bucket_bits=bits).collect())) == collocations_by_hand(rows, least, longest, best=5)


def test_a_passes_words_are_hashed_once_a_chunk_and_leave_a_task_once():
    texts, seen = ["One two. two\tone"] * 50 + [None, "", "Three three three"], []
    data, offsets = byte_words.buffer_of(pa.array(texts))
    words = byte_words.words_of(data, offsets, collocations._WORD_BYTES, hashed=lambda value: seen.append(value) or len(seen))
    assert sorted(seen) == sorted(words.distinct) == [b"one", b"three", b"two"]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})] * 3
    found = [tuple(row.values()) for part in collocations._pass(1, False, 20, None, None)(iter(batches)) for row in part.to_pylist()]
    exact = sorted((phrase or "", n) for _, phrase, bucket, n in found if bucket is None)
    assert exact == [("", 609), ("one", 300), ("three", 9), ("two", 300)]
    assert sorted(n for *_, bucket, n in found if bucket is not None) == [6, 150, 150]


def test_phrases_are_hashed_alike_in_passes_and_apart():
    texts = ["new York é 日本", "york"]
    hashes = collocations.phrase_hashes(pa.array(["en", "de"]), pa.array([t.lower() for t in texts])).tolist()
    single = [collocations.phrase_hashes(pa.array([x]), pa.array([t.lower()]))[0] for x, t in zip(["en", "de"], texts, strict=True)]
    parts = list(collocations._pass(1, False, 64, None, None)(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["new york"]})])))
    pair = int(collocations.phrase_hashes(pa.array(["en"]), pa.array(["new york"]))[0])
    assert hashes == single and [row["bucket"] % 2**64 for part in parts for row in part.to_pylist() if row["bucket"] is not None] == [pair]


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], FIRST)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 0)], FIRST)).count() == 0


def test_new_operators_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == divergence_by_hand(rows)
    assert sorted(map(tuple, collocations.collocations(docs, least=2).collect())) == collocations_by_hand([(t, x) for t, x, _ in rows], 2)


# 6
def test_budgets_are_met_as_nearly_as_any_selection_can():
    rng = random.Random(8)
    for _ in range(400):
        lengths = [(length, rng.randint(1, 12)) for length in rng.sample(range(60), rng.randint(1, 6))]
        budget = rng.randint(0, sum(length * n for length, n in lengths) + 5)
        totals = {0}
        for length, n in lengths:
            totals = {x + length * k for x in totals for k in range(n + 1)}
        taken = mixing.fit_budget(lengths, budget)
        assert all(0 <= n <= dict(lengths)[length] for length, n in taken.items())
        assert abs(budget - sum(length * n for length, n in taken.items())) == min(abs(budget - x) for x in totals)
    assert sum(length * n for length, n in mixing.fit_budget([(3, 10), (44, 9), (45, 8)], 716).items()) in (715, 717)
    many = [(700, 10**9), (701, 10**9)]
    assert sum(length * n for length, n in mixing.fit_budget(many, 10**11 + 7).items()) == 10**11 + 7


# pipeline
def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    named = docs.withColumnsRenamed({"n_chars": "a.b"}).withColumn("tick`et", docs.doc_id + 1).withColumn("Shard", docs.doc_id)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, named, SF)
        kept = [c for c in named.columns if name != "sharding" or c != "Shard"]
        assert left.columns[: len(kept)] == kept and len({c.lower() for c in left.columns}) == len(left.columns)
        assert all(row["tick`et"] == row["doc_id"] + 1 for row in left.collect())
