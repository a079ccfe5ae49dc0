"""Odd inputs, other generators and brute force, operator by operator."""

import base64
import random
import re
import string
import textwrap
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_llm import WORD, awkward, clashing

import corpus_pipeline
from proofline.llm import common, decontamination, licences, minhash, mixing, quality, queries, secrets, sharding, token_counts, toxicity, url_rules

SF = "/root/testdata/sf0.001"


# 1
def test_urls_that_repeat_or_are_very_long_keep_their_rows(spark):
    urls = ["https://example.com/en/" + "x" * 200_000, *["https://a.com/"] * 60, None, None, "nothing"]
    pages = clashing(spark.createDataFrame([(k % 7, u) for k, u in enumerate(urls)], "page_id long, url string"))
    found = url_rules.filter_urls(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"), rows_per_salt=1)
    assert Counter((r.rule, r.verdict) for r in found.collect()) == {("example.com/en/", "block"): 1, ("com/", "allow"): 60, (None, "allow"): 3}
    assert set(pages.columns) <= set(found.columns) and len(found.columns) == len(set(found.columns))
    turkish = spark.createDataFrame([("İ.COM", "/", "block")], "host string, path string, verdict string")
    asked = spark.createDataFrame([(1, "http://x.İ.com/")], "page_id long, url string")
    assert url_rules.filter_urls(asked, turkish).first().verdict == "block"


# 2
def test_sources_with_other_habits_get_other_limits(spark):
    rng = random.Random(3)

    def text(rate, length):
        words = ["".join(rng.choices(string.ascii_lowercase, k=max(1, round(rng.gauss(length, 0.4))))) for _ in range(200)]
        for k in rng.sample(range(200), round(200 * rate * rng.uniform(0.5, 1.5))):
            words[k] += "#"
        return "\n".join(" ".join(words[k : k + 20]) for k in range(0, 200, 20))

    rows = [(k, text(0.0, 5), "en", "prose", 1) for k in range(150)] + [(1000 + k, text(0.2, 9), "en", "code", 1) for k in range(150)]
    rows += [(2000, text(0.2, 5), "en", "prose", 1), (2001, text(0.2, 9), "en", "code", 1), (2002, text(0.0, 14), "en", "prose", 1), (2003, text(1.2 / 2, 9), "en", "code", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.kept for r in quality.judge_quality(clashing(docs)).collect()}
    assert not found[2000] and found[2001] and not found[2002] and not found[2003]
    assert sum(found[k] for k in range(150)) >= 148 and sum(found[1000 + k] for k in range(150)) >= 148


def test_quality_without_any_passing_text_and_null_groups(spark):
    docs = spark.createDataFrame([(1, "too short", None, None), (None, None, None, None), (2, "a b " * 100, None, "x")], "doc_id long, text string, lang string, source string")
    assert [(r.base_failed, r.kept) for r in quality.judge_quality(docs).collect()] == [(True, False)] * 3
    many = spark.range(40).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda k: F.concat(F.lit("w"), (k * 7 + F.col("id") * 1000 + 100_000).cast("string"))), " ").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert quality.judge_quality(many.withColumnRenamed("id", "doc_id")).where("kept").count() == 40


# 3
@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.made_findings(spark))


def other_findings(seed, n):
    """(text, label) by another generator than the one the forest is trained from: lines of configuration, logs, code and prose."""
    rng = random.Random(seed)
    some = lambda letters, k: "".join(rng.choices(letters, k=k))
    word = string.ascii_letters + string.digits
    low = "0123456789abcdef"
    dashed = lambda: "-".join(some(low, k) for k in (8, 4, 4, 4, 12))
    secret = [
        lambda: f"export CI_TOKEN=ghp_{some(word, 36)}",
        lambda: f"slack: token: xoxb-{some(string.digits, 11)}-{some(string.digits, 12)}-{some(word, 24)} # bot",
        lambda: f'stripe.api_key = "sk_live_{some(word, 24)}"',
        lambda: f"access_key_id = AKIA{some(string.ascii_uppercase + string.digits, 16)}",
        lambda: f'client_secret: "{some(word + "-_~.", 34)}"',
        lambda: f"curl -H 'Authorization: Bearer eyJ{some(word, 30)}.eyJ{some(word, 70)}.{some(word + '-_', 43)}'",
        lambda: f"api key = {dashed()}",
        lambda: f"passwd = '{some(word + '!$%&?', 12)}'",
        lambda: f"amqp://app:{some(word, 18)}@queue.internal:5672/",
        lambda: f'und dann token = "{some(low, 40)}" mit der',
        lambda: f"-----BEGIN RSA PRIVATE KEY----- MII{some(word + '+/', 61)}",
    ]
    plain = [
        lambda: f"git show {some(low, 40)} | head",
        lambda: f"sha256 = {some(low, 64)}",
        lambda: f"request {dashed()} took 12 ms",
        lambda: f"DB_PASSWORD=your_{rng.choice(['own', 'database'])}_password_here",
        lambda: 'token: "changeme"',
        lambda: f"card {some(string.digits, 16)} was charged",
        lambda: f"from package.{rng.choice(secrets.DICTIONARY)}.{rng.choice(secrets.DICTIONARY)} import handler",
        lambda: f"see https://docs.somewhere.org/{rng.choice(secrets.DICTIONARY)}/{rng.choice(secrets.DICTIONARY)}.html",
        lambda: f"die {rng.choice(['Rindfleischverordnung', 'Donaudampfschifffahrt', 'Geschwindigkeitsbegrenzung'])} gilt",
        lambda: "secret = settings.read_from_vault(name)",
        lambda: f"etag: \"{some(low, 32)}\"",
    ]
    return [(rng.choice(secret if k % 2 else plain)(), k % 2) for k in range(n)]


def test_secrets_of_another_generator_are_found(spark, forest):
    rows = other_findings(9, 600)
    docs = spark.createDataFrame([(k, text, None) for k, (text, _) in enumerate(rows)], "doc_id long, text string, path string")
    judged = {k for (k,) in secrets.scan_secrets(docs, forest).where("is_secret").select("doc_id").distinct().collect()}
    right = [(k in judged) == bool(label) for k, (_, label) in enumerate(rows)]
    found = np.mean([x for x, (_, label) in zip(right, rows, strict=True) if label])
    spared = np.mean([x for x, (_, label) in zip(right, rows, strict=True) if not label])
    assert found > 0.95 and spared > 0.95, (found, spared)


def brute_candidates(text):
    names = "|".join(secrets.SECRET_WORDS)
    given = rf"(?:(?i:(?<=(?:{names})[\"'`]?[=:]{{1,2}}[\"'`]?))|(?<=://[\w.\-]{{1,64}}:))[^\s\"'`@,;]{{6,}}"
    pattern = regex.compile(rf"{given}|[A-Za-z0-9_+/.~\-]{{15,}}[A-Za-z0-9_+/~\-]={{0,2}}")
    words = re.split(r"[\x20\x09-\x0D]+", text or "")
    for place, word in enumerate(words):
        values = pattern.findall(word)
        before = " ".join(words[max(0, place - 3) : place])
        if not values and re.search(rf"(?i)(?:^|[^a-z])(?:{names})[\"'`]?\s*(?:=|:|=>|:=)\s*$", before):
            values = re.findall(r"(?!(?i:bearer|basic)\b)[^\s\"'`,;()<>\[\]]{6,}", word)
        for value in values:
            yield place, value


def test_candidates_and_features_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = spark.createDataFrame([(10_000 + k, text) for k, (text, _) in enumerate(other_findings(4, 120))], docs.schema)
    rows = docs.unionByName(made).withColumn("path", F.lit(None).cast("string"))
    found = secrets.with_features(secrets.candidates(rows)).collect()
    expected = Counter((r.doc_id, *c) for r in rows.collect() for c in brute_candidates(r.text))
    assert Counter((r.doc_id, r.place, r.value) for r in found) == expected
    for r in found:
        v, n = r.value, len(r.value)
        runs = len(re.findall(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", v))
        pairs = sum(v.lower()[k : k + 2] in set(secrets.PAIRS) for k in range(n - 1)) / max(1, len(re.findall("(?=[a-z]{2})", v.lower())))
        assert np.allclose([r.length, r.transitions, r.word_pairs, r.digit_share, r.distinct_share], [min(n, 200), (runs - 1) / max(1, n - 1), pairs, sum("0" <= c <= "9" for c in v) / n, len(set(v)) / n])


def test_the_query_finds_the_planted_keys_and_nothing_else(spark):
    found = queries.QUERIES["op3_secret_scan"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter((r.doc_id, r.place) for r in found) == Counter((k, place) for k, text in docs.items() for place, _ in brute_candidates(text))
    keys = Counter((k, place) for k, text in docs.items() for place, value in brute_candidates(text) if re.fullmatch("(?i)[0-9a-f]{40}", value))
    assert Counter((r.doc_id, r.place) for r in found if r.is_secret) == keys


def test_secrets_in_odd_rows(spark, forest):
    key = "token = \"" + "0f3a9c" * 7 + "\""
    rows = [(1, key, "src"), (1, key, "src"), (None, key, None), (2, None, None), (3, "", "a"), (4, "word " * 50_000 + key, None), (5, "x" * 300_000, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, path string").withColumn("value", F.lit("mine"))).withColumn("path", F.col("verdict"))
    found = secrets.scan_secrets(docs, forest).collect()
    assert Counter(r.doc_id for r in found) == {1: 2, None: 1, 4: 1, 5: 1} and len({r.score for r in found if r.doc_id == 1}) == 1
    assert {r.is_secret for r in found if r.doc_id != 5} == {True} and not next(r for r in found if r.doc_id == 5).is_secret
    assert secrets.scan_secrets(docs.limit(0), forest).count() == 0


# 4
def one_text(spark, texts):
    docs = clashing(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    return {r.doc_id: (r.text_licence, r.n_notices, r.licences) for r in licences.scan_licences(docs, licences.known_digests(spark)).collect()}


def test_licences_are_known_however_their_lines_break(spark):
    names = {"MIT": "MIT", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "Zlib": "Zlib"}
    bodies = {name: (title, body) for name, title, body in licences.KNOWN_LICENCES if name in names and title}
    texts, expected = [], []
    for name, (title, body) in bodies.items():
        body = body.replace("<year>", "1999-2024").replace("<holders>", "Jane Doe and the Others, Inc.")
        paragraphs = f"{title}\n\n{body}".split("\n\n")
        for width in range(40, 121, 1 if name == "MIT" else 13):
            texts.append("\n\n".join(textwrap.fill(p, width) for p in paragraphs))
        texts += [" ".join(f"{title} {body}".split()), " ".join(body.split()), body.upper(), body.split("\n\n", 1)[1], body.replace("\n", "\r\n")]
        expected += [name] * (len(texts) - len(expected))
    found = one_text(spark, texts)
    assert [found[k][0] for k in range(len(texts))] == expected


def test_licence_notices_and_what_is_none(spark):
    mit = next(body for name, title, body in licences.KNOWN_LICENCES if name == "MIT" and title)
    texts = [
        "x\n  licensed under the apache LICENCE version 2.0!\ny", "Licensed under nothing", None, "", "Released under the MIT License.", "Copyright (c) 2024 Foo. Released under the MIT License.",
        "Terms\nCopyright (c) 2024 Foo\nLicensed under CC BY 4.0.\nmore", "Copyright (c) 2024 Foo", mit.replace("(the \"Software\")", ""), "(c) You must keep this.\n\nReleased under the MIT License.",
    ]
    found = one_text(spark, texts)
    assert found[0] == (None, 1, ["Apache-2.0"]) and found[1] == (None, 0, []) and found[2] == (None, 0, []) and found[3] == (None, 0, [])
    assert found[4] == ("MIT", 1, ["MIT"]) and found[5][0] == "MIT" and found[5][2] == ["MIT"] and found[6] == (None, 1, ["CC-BY-4.0"]) and found[7] == (None, 0, [])
    assert found[8] == (None, 0, []) and found[9] == (None, 1, ["MIT"])
    assert licences.scan_licences(awkward(spark), licences.known_digests(spark)).count() == 10
    assert licences.scan_licences(awkward(spark).limit(0), licences.known_digests(spark)).count() == 0


def test_any_table_of_licences_can_be_given(spark):
    known = spark.createDataFrame([("B", "T", "some words here"), ("A", None, "Some WORDS, here"), ("C", "x", None), ("D", "", "(c) 2020 X")], "licence string, title string, text string")
    digests = licences.known_digests(spark, known)
    docs = spark.createDataFrame([(1, "some words\nhere"), (1, "some words\nhere"), (1, "T: some words here"), (2, "© 2021 Y")], "doc_id long, text string")
    for limit in (0, 100):
        found = licences.scan_licences(docs, digests, broadcast_limit=limit).collect()
        assert Counter((r.doc_id, r.text_licence) for r in found) == {(1, "A"): 2, (1, "B"): 1, (2, None): 1}


# 5
def test_tokens_of_whole_texts_are_those_of_brute_force(spark):
    with open(queries.VOCABULARY, "rb") as lines:
        known = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    longest = max(map(len, known))
    pattern = regex.compile(token_counts.CHUNK)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").unionByName(awkward(spark).where("length(text) < 4000"))
    found = queries.token_counts.count_tokens(docs.select("doc_id", "text"), token_counts.Automaton(known)).collect()
    for r in found[::4] + found[-8:]:
        n = 0
        for chunk in pattern.findall(r.text or ""):
            data, at = chunk.encode(), 0
            while at < len(data):
                at += next(k for k in range(min(longest, len(data) - at), 0, -1) if data[at : at + k] in known)
                n += 1
        assert n == r.n_tokens


# 6
def test_mixing_takes_the_same_texts_of_a_repeated_id_again(spark):
    rows = [(7, f"{'abcdefghij'[k % 10]}{k} same size text", "c") for k in range(40)] + [(8, "b " * 30, "b"), (9, "c " * 500, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = [{(r.doc_id, r.text): r.copies for r in mixing.mix(docs.repartition(n).orderBy(F.rand(n))).collect()} for n in (1, 5)]
    assert mixed[0] == mixed[1] and len({c for (i, _), c in mixed[0].items() if i == 7}) == 2


def test_budgets_over_very_many_lengths_are_met_exactly():
    rng = random.Random(11)
    for _ in range(20):
        lengths = [(n, rng.randint(1, 3)) for n in sorted(rng.sample(range(1, 4000), rng.randint(150, 700)))]
        budget = rng.randint(1, sum(n * c for n, c in lengths))
        taken = mixing.fit_budget(lengths, budget)
        assert sum(n * c for n, c in taken.items()) == budget and all(0 <= taken[n] <= c for n, c in lengths if n in taken)
    even = [(2 * n, 3) for n in range(1, 200)]
    assert abs(sum(n * c for n, c in mixing.fit_budget(even, 7777).items()) - 7777) == 1


# 7
def test_scores_are_probabilities_and_come_with_evidence(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op7_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic", "evidence").toPandas()
    for low, high in ((0, 0.05), (0.05, 0.5), (0.5, 0.9), (0.9, 1.01)):
        some = rows[(rows.score >= low) & (rows.score < high)]
        assert not len(some) or abs(some.score.mean() - some.toxic.mean()) < 0.05 + 1.5 / len(some) ** 0.5, (low, some.score.mean(), some.toxic.mean(), len(some))
    assert all(len(e) for e in rows[rows.score > 0.5].evidence)


def test_rare_terms_and_unspaced_scripts_count(spark):
    clean = [(k, f"these are plain words number {k}", 0) for k in range(400)]
    toxic = [(1000, "文章の中に悪口雑言がある", 1), (1001, "別の所にも悪口雑言がある", 1), (1002, "zq" * 40 + "vileword", 1), (1003, "vileword" + "xy" * 40, 1)]
    both = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    model = toxicity.fit(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    score = lambda text: model.score(text)[0]
    assert score("前置き悪口雑言です") > 0.5 > score("these are plain words") and score("k" * 50 + "vileword" + "j" * 50) > score("plain words here")


# 8
def brute_hits(text, items, n):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    own, hit, named = words(text), set(), set()
    for item_id, item in items:
        size = min(n, len(words(item)))
        windows = {tuple(words(item)[k : k + size]) for k in range(len(words(item)) - size + 1)} if size else set()
        for k in range(len(own) - size + 1):
            if size and tuple(own[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                named.add(str(item_id))
    return len(own), len(hit), sorted(named)


def test_windows_of_all_lengths_in_one_scan(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 8)))) for k in range(12)]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(80)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    for limit in (1_000_000, 7):
        found = decontamination.find_hits(docs, bench, 5, limit)
        assert found.where("start < 1").count() == 0
    rows = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.decontaminate(docs, bench, 5).collect()}
    assert rows == {k: brute_hits(text, items, 5) for k, text in texts}
    left = decontamination.drop_contaminated(docs, bench, 5)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, (_, n, _) in rows.items() if not n}
    cut = decontamination.remove_spans(docs, bench, 5)
    assert cut.columns == docs.columns and {r.doc_id: len(r.text.split()) for r in cut.collect()} == {k: n - hit for k, (n, hit, _) in rows.items()}


# 9
def test_shards_are_the_same_again_and_hold_every_copy(spark):
    rows = [(k % 30, f"text {k % 30}", None if k % 30 == 3 else "ab"[k % 2], k) for k in range(90)] + [(None, None, None, 90), (None, "x", "a", 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    one, two = (Counter((r.doc_id, r.text, r.source, r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(n), shards=4, rows_per_bucket=9).collect()) for n in (1, 6))
    assert one == two and max(one.values()) == 1 and len(one) == 92


# 10
def test_near_duplicates_with_hot_groups_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text) for k in range(3000)] + [(5000 + k, None) for k in range(500)] + [(9000, text + " more"), (9001, "other words stand here alone")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert len(found) == len(rows) and found[2999] == (0, False) and found[0] == (0, True) and found[9000] == (0, False) and found[9001] == (9001, True) and found[5001] == (5001, True)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *range(5000, 5500), 9001]


# common
def test_rows_with_hot_and_null_keys_are_joined_once(spark):
    left = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 10 == 0 else f"k{k}") for k in range(3000)], "n long, key string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("unused", 3)], "key string, x int")
    found = common.left_join_hot(left, right, ["key"]).collect()
    assert sorted(r.n for r in found) == list(range(3000))
    assert Counter(r.x for r in found) == {1: 1500, 2: 1, None: 1499}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    class Frame:
        sparkSession = Session()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common._shared_folder(Frame())


def test_stages_may_meet_any_column_names(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet").limit(60))
    for name, stage in corpus_pipeline.STAGES:
        columns = stage(spark, docs, SF).columns
        assert columns == (docs.columns if name != "sharding" else [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"])


def test_words_are_the_same_everywhere():
    assert WORD.pattern == quality._WORD.pattern
