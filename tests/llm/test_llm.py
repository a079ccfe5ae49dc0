import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofline.llm import decontamination, minhash, mixing, quality, queries, sharding, token_counts, toxicity, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(900)) for _ in range(60_000))
    rows = [(1, None, None, None, None), (None, "some words are here to stay for now", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, long, "en", "a", len(long))]
    rows += [(5, "the same row stands here twice, word for word", "en", "b", 9)] * 2 + [(5, "the same id with another text", "fr", "b", 9), (6, "ÄÖÜ ß 日本 😀 naïve", "de", "b", 3)]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    names = "size source_size target copies shard slot text_crc32 score evidence n_tokens n_chunks n_unknown hit_id hit_md5 gone_id gone_md5 md5 text_md5 node root row spans start length label path host verdict n_words kept".split()
    return docs.withColumns({name: F.lit("mine") for name in names})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents pages benchmark labels".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    expected = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    order = sorted(columns)
    pick = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in order) for r in rows)
    assert pick(found.columns, [tuple(r) for r in found.collect()]) == pick(columns, expected.fetchall())


# 1
def test_url_rules_longest_wins_and_odd_urls(spark):
    urls = ["http://www.Example.COM/en/x?q", "https://example.com/en/", "http://a.example.com/en/1#f", "http://x.net/fr/1", "http://net/es/", "http://xnet/es/", "no scheme", "", None, "://", "http://example.com", "http://..com/", "http://com?x"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    found = {r.page_id: r for r in url_rules.filter_urls(pages, rules).collect()}
    brute = {}
    for k, u in enumerate(urls):
        m = re.search(r"^.*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        brute[k] = (host, path, *(max(fits)[2:] if fits else (None, "allow")))
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in found.items()} == brute
    assert url_rules.filter_urls(pages.limit(0), rules).count() == 0
    assert url_rules.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


# 2
def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark):
    docs = awkward(spark)
    found = quality.judge_quality(docs).collect()
    texts = [r.text for r in docs.collect()]
    assert sorted(tuple(r)[1:6] for r in found) == sorted(map(brute_counts, texts))
    assert all(not r.kept for r in found if r.base_failed)
    assert quality.judge_quality(docs.limit(0)).count() == 0
    verdicts = queries.QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = verdicts.where("not base_failed").join(labels, "doc_id").groupBy("kept").agg(F.avg("quality").alias("q")).collect()
    assert all(r.q > 0.9 if r.kept else r.q < 0.1 for r in rows)


def test_quality_limits_follow_the_spread_and_can_be_reached(spark):
    row = lambda k, lines: (k, "\n".join(lines), "en", "a", 1)
    word = lambda k, n: (f"{k:x}q" * 9)[:n]
    texts = [[" ".join(word(1000 * k + 20 * i + j, 5 + (k + j) % 2) for j in range(20)) for i in range(5)] for k in range(1, 201)]
    low = [" ".join(f"{j:x}" for j in range(20 * i, 20 * i + 20)) for i in range(5)]
    repeated = [*(["ab cd"] * 4), *(" ".join(word(900_000 + 20 * i + j, 5 + j % 2) for j in range(25)) for i in range(4))]
    rows = [*(row(k, lines) for k, lines in enumerate(texts)), row(900, low), row(901, repeated), row(902, [f"{texts[0][0]} # # # # # #", *texts[0][1:]])]
    found = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[k].kept for k in range(200)) and not any(found[k].base_failed for k in (900, 901, 902))
    assert not found[900].kept and not found[901].kept and not found[902].kept


# 5
def test_token_counts_are_those_of_greedy_matching(spark):
    rng = random.Random(8)
    for _ in range(300):
        entries = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.Automaton(entries)
        for _ in range(10):
            s = bytes(rng.choices(b"abc", k=rng.randint(0, 14)))
            at = n = 0
            while at < len(s) and n is not None:
                fits = [len(t) for t in entries if s.startswith(t, at)]
                at, n = (at + max(fits), n + 1) if fits else (at, None)
                if n is None:
                    break
            assert automaton.count_bytes(s) == n
    automaton = token_counts.Automaton(token_counts.read_vocabulary(queries.VOCABULARY))
    found = token_counts.count_tokens(clashing(awkward(spark)), automaton)
    assert {(r.doc_id, r.n_tokens) for r in found.where("doc_id in (1, 2)").collect()} == {(1, 0), (2, 0)}
    assert found.count() == 10 and found.where("n_unknown > 0").count() == 0
    assert token_counts.count_tokens(awkward(spark).limit(0), automaton).count() == 0


# 6
def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        spare = [(n, rng.randint(1, 4)) for n in sorted(rng.sample(range(1, 30), rng.randint(1, 5)))]
        budget = rng.randint(0, 150)
        sums = {0}
        for n, count in spare:
            sums = {s + n * k for s in sums for k in range(count + 1)}
        taken = mixing.knapsack(budget, spare)
        assert all(taken[n] <= dict(spare)[n] for n in taken)
        assert abs(sum(n * k for n, k in taken.items()) - budget) == min(abs(s - budget) for s in sums)


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").toPandas()
    assert (rows["size"] == [len(WORD.findall(t or "")) for t in docs.toPandas().set_index("doc_id").text[rows.doc_id]]).all()
    sizes = rows.groupby("source")["size"].sum()
    level = {s: w for s, w in zip(sorted(sizes.index, key=lambda s: [ord(c) for c in s]), [5, 2, 1] * 9, strict=False)}
    target, free, left = {}, set(sizes.index), float(sizes.sum())
    while True:
        share = {s: left * level[s] / sum(level[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    target |= share
    got = rows.assign(taken=rows["size"] * rows.copies).groupby("source").taken.sum()
    assert np.allclose([target[s] for s in rows.source], rows.target)
    assert all(abs(got[s] - target[s]) <= 2 for s in target) and rows.copies.between(0, 3).all()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "copies").toPandas()
    assert dict(zip(rows.doc_id, rows.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))


def test_mix_of_awkward_rows(spark):
    found = mixing.mix(clashing(awkward(spark)))
    assert found.count() == 10 and set(found.columns) >= {"size", "copies", "shard"}
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    assert mixing.repeat_rows(found).count() == found.agg(F.sum("copies")).first()[0]


# 7
def test_toxicity_neighbours_are_those_of_a_full_scan(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), toxicity.training_labels(labels))
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in model.ids)
    full = np.zeros((len(model.ids), len(model.idf)))
    for block in range(model.blocks):
        a, b = model.starts[block], model.starts[block + 1]
        full[block * toxicity._BLOCK + model.slot[a:b], model.term[a:b]] = model.weight[a:b]
    assert np.allclose((full**2).sum(axis=1), 1)
    for row in docs.limit(150).collect():
        terms, weights = model.vector(row.text)
        if len(terms):
            exact = full[:, terms] @ weights
            best = sorted(((-s, k) for k, s in enumerate(exact) if s > 0))[: model.neighbours]
            near = model.nearest(terms, weights)
            assert len(near) == len(best) and np.allclose([s for s, _ in near], [-s for s, _ in best])
    found = toxicity.score_toxicity(clashing(awkward(spark)), model)
    assert found.where("score between 0 and 1").count() == 10
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op7_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    hit, found, wanted = rows.agg(F.expr("count_if(predicted = 1 and toxic = 1)"), F.expr("count_if(predicted = 1)"), F.expr("count_if(toxic = 1)")).first()
    assert hit / found > 0.85 and hit / wanted > 0.75


def test_toxicity_without_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, none)).where("score = 0").count() == 10
    one = spark.createDataFrame([(4, 1), (5, 1), (None, 0), (6, 7)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, one)).where("score > 0.9").count() == 10


# 8
def test_decontamination_spans_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "short, Item"), (3, None), (4, "..."), (None, "short item")], "item_id long, text string")
    texts = [f"Before: {item.upper()}! after", "a SHORT item here", "short of an item", None, "", "one two three four five six seven eight nine"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert (found[0].n_hit, found[0].item_ids, found[0].n_words) == (11, ["1"], 13)
    assert (found[1].n_hit, found[1].item_ids) == (2, ["2"])
    assert not any(found[k].contaminated for k in (2, 3, 4, 5))
    assert decontamination.drop_contaminated(docs, bench).count() == 4
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert cut[0] == "Before: ! after" and cut[1] == "a  here" and cut[3] is None
    assert decontamination.decontaminate(awkward(spark), bench).count() == 10
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    parts = decontamination.find_hits(docs, bench, set_limit=1).select("doc_id", "start").distinct().count()
    assert parts == decontamination.find_hits(docs, bench).select("doc_id", "start").distinct().count()


# 9
def test_shards_are_even_and_match_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for per_bucket in (5_000, 60):
        rows = sharding.shard_rows(docs, rows_per_bucket=per_bucket).toPandas()
        sizes = rows.groupby("shard").size()
        assert len(rows) == 1000 and sizes.max() - sizes.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
        mixture = rows.groupby(["source", "shard"]).size().unstack(fill_value=0)
        share = rows.groupby("source").size() / 40
        assert all((mixture.loc[s] - share[s]).abs().max() < 2 for s in share.index)
    assert sharding.shard_rows(clashing(awkward(spark))).count() == 10
    assert sharding.shard_rows(docs.limit(0)).count() == 0


# 10
def brute_components(rows, percent=75):
    shingled = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        shingled[doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in shingled}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    with_shingle = defaultdict(list)
    for doc_id, s in shingled.items():
        for x in s:
            with_shingle[x].append(doc_id)
    for doc_id, s in shingled.items():
        for other, shared in Counter(o for x in s for o in with_shingle[x] if o < doc_id).items():
            if 100 * shared >= percent * (len(s) + len(shingled[other]) - shared):
                a, b = sorted((find(doc_id), find(other)))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in shingled.items()}


def test_near_duplicates_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert found == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_among_many_with_a_common_passage(spark):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"w{k}_{j}" for j in range(20 + k % 9)] + passage)) for k in range(150)]
    base = [f"b{j}" for j in range(120)]
    for k in range(150, 230):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((k, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_components(rows)


def test_near_duplicates_of_awkward_rows(spark):
    found = minhash.near_duplicates(awkward(spark)).collect()
    assert len(found) == 10 and {r.doc_id: r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1: 1, 2: 2, 3: 3}
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    kept = minhash.drop_near_duplicates(clashing(awkward(spark)))
    assert kept.where("doc_id = 5").count() == 2 and kept.count() == 9
    assert minhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_dropping_near_duplicates_keeps_other_texts_of_a_repeated_id(spark):
    text = {name: " ".join(f"{name}{k}" for k in range(80)) for name in ("p", "q", "r")}
    near = {name: f"{t} more" for name, t in text.items()}
    cases = [
        ([(3, text["p"]), (5, near["p"]), (5, text["q"])], [{(3, text["p"])}, {(5, text["q"])}]),
        ([(3, text["p"]), (7, near["p"]), (3, text["q"]), (1, near["q"])], [{(3, text["p"])}, {(1, near["q"])}]),
        ([(3, text["r"]), (3, near["r"]), (3, text["r"]), (4, near["r"])], [{(3, text["r"]), (3, near["r"])}]),
    ]
    for rows, groups in cases:
        kept = [tuple(r) for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert len(kept) == len(groups) and all(len(group & set(kept)) == 1 for group in groups)


# pipeline
def test_pipeline_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), stage(spark, docs, SF).schema)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "near_dedup":
            ids = [r.doc_id for r in before.select("doc_id").collect()]
            assert sorted(kept[name]) == sorted({c for _, c in brute_components([(i, rows[i]) for i in ids]).values()})
        if name == "mixing":
            assert max(Counter(kept[name]).values()) <= 3
    assert docs.columns == [*spark.read.parquet(f"{SF}/documents.parquet").columns, "shard", "slot"]
    final = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
    assert final == Counter(kept["sharding"])


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("awkward", clashing(awkward(spark))), ("empty", awkward(spark).limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, "a b"), (2, None), (3, "the same id with another text")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(folder))
        assert found.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
        rows = found.collect()
        if name == "empty":
            assert not rows
            continue
        # Of the rows with words, the copy is reduced to one row, and the item's text is gone.
        known = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(r.doc_id, r.text) for r in rows} <= known and max(Counter((r.doc_id, r.text) for r in rows).values()) <= 3
        assert not any("another text" in (r.text or "") for r in rows) and any(r.doc_id == 4 for r in rows)
        assert all(r["size"] == "mine" and r["target"] == "mine" and r["score"] == "mine" for r in rows)
        assert sorted(len(list(g)) for _, g in itertools.groupby(sorted(r.shard for r in rows))) == [1] * len(rows)


def test_digest_columns_follow_from_the_operator(spark):
    row = queries.QUERIES["op8_decontamination"](spark, SF).where("not contaminated").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.n_items == 0
