from pyspark.sql import functions as F

from proofline.functions import replies, sets
from proofline.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*items):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def test_set_scores_and_their_empty_cases(spark):
    p = lambda a, b: (one(spark, sets.precision(strings(*a), strings(*b))), one(spark, sets.recall(strings(*a), strings(*b))))
    assert p("ab", "bc") == (0.5, 0.5)
    assert p("", "") == (1.0, 1.0)
    assert p("a", "") == (0.0, 0.0)
    assert p("", "a") == (0.0, 0.0)
    assert one(spark, sets.jaccard(strings(), strings())) == 1.0
    assert one(spark, sets.f1(F.lit(0.0), F.lit(0.0))) == 0.0


def test_additions_go_behind_each_bucket_once(spark):
    gold = F.array(strings("a"), strings("b", "c"))
    assert one(spark, sets.merged_gold(gold, strings("c", "d"))) == [["a", "c", "d"], ["b", "c", "d"]]
    assert one(spark, sets.merged_gold(gold, strings())) == [["a"], ["b", "c"]]


def test_cosine_of_a_zero_vector_is_zero(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, sets.cosine(v(1.0, 0.0), v(0.0, 2.0))) == 0.0
    assert one(spark, sets.cosine(v(0.0, 0.0), v(1.0, 1.0))) == 0.0
    assert abs(one(spark, sets.cosine(v(1.0, 1.0), v(2.0, 2.0))) - 1) < 1e-12


def test_tags_are_stripped_and_anchored(spark):
    text = F.lit("One.[s:a][s:b] Two.[s:c]")
    assert one(spark, T.strip_tags(text)) == "One. Two."
    assert [(x.sid, x["at"]) for x in one(spark, T.tag_anchors(text))] == [("a", 4), ("b", 4), ("c", 9)]


def test_an_anchor_belongs_to_its_sentence_or_the_one_before(spark):
    spans = F.expr("array(named_struct('start', 0, 'end', 4), named_struct('start', 5, 'end', 9))")
    assert [one(spark, T.anchor_sentence(spans, F.lit(at))) for at in (0, 4, 5, 9)] == [0, 0, 1, 1]


def test_difficulty_rule(spark):
    rate = lambda n, text: one(spark, T.difficulty(F.lit(n), F.lit(text)))
    assert [rate(3, "x"), rate(2, "x"), rate(1, "short"), rate(1, "y" * 130), rate(1, "y" * 130 + "7")] == ["hard", "medium", "easy", "medium", "easy"]


def test_ids_and_labels(spark):
    assert one(spark, T.chunk_id(F.lit("d"), F.lit(7))) == "d-c0007"
    assert one(spark, T.passage_of(F.lit("bench::q1::p9"))) == "p9"
    assert one(spark, T.passage_of(F.lit("other::q1::p9"))) is None
    assert one(spark, T.section_label(strings())) == "(root)"
    assert one(spark, T.truncated(F.lit("abcdef"), 3)) == "abc …"


def test_json_objects_in_replies(spark):
    read = lambda x: one(spark, replies.json_object(F.lit(x)))
    assert read('{"a": 1}') == '{"a": 1}'
    assert read('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert read('Sure: {"a": 1} done') == '{"a": 1}'
    assert read("nothing") is None


def test_judgments_are_filled_up_and_cut(spark):
    judge = lambda x, n: [y.entails for y in one(spark, replies.judge_array(F.lit(x), F.lit(n)))]
    assert judge('[{"entails": true, "reason": "r"}]', 2) == [True, False]
    assert judge('{"results": [{"entails": true}, {"entails": true}, {"entails": true}]}', 2) == [True, True]
    assert judge("no json", 2) == [False, False]
    assert [one(spark, replies.strict_bool(F.lit(x))) for x in ("Yes", "0", "maybe")] == [True, False, None]
    assert one(spark, replies.union_indices(strings("1", "x", "99", "-1", "1", "0"), F.lit(3))) == [1, 0]


def test_vectors_are_scaled_by_a_norm_that_is_summed_up_once(spark):
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    scaled = vectors.select(sets.unit(F.col("v")).alias("u"))
    assert [r.u for r in scaled.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    assert scaled._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
