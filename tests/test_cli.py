"""The command line, from layouts to an evaluation."""

import json

from proofline import __main__ as cli


def test_from_layouts_to_an_evaluation(spark, tmp_path, capsys):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    p = lambda name: str(tmp_path / name)
    for name, text in (("a", "Apples are red. They grow on trees."), ("b", "Pears are green. They grow as well.")):
        (tmp_path / "parsed" / name).mkdir(parents=True)
        (tmp_path / "parsed" / name / "layout.json").write_text(json.dumps({"paragraphs": [{"content": text}]}))
    cli.main(["hashed", p("parsed/a/layout.json")])
    cli.main(["chunk", p("parsed"), "--out", p("chunks")])
    cli.main(["index", p("chunks"), "--out", p("index"), "--recreate"])
    author, quoting, judge = (f"proofline.flow_queries:{name}" for name in ("SpanAuthor", "Quoting", "LengthJudge"))
    cli.main(["author", p("chunks"), "--out", p("gt"), "--model", author, "--name", "author", "--n", "4"])
    items = str(next((tmp_path / "gt").iterdir()) / "items")
    cli.main(["gate", items, "--out", p("gated"), "--index", p("index"), "--model", judge, "--name", "judge"])
    gated = str(next((tmp_path / "gated").iterdir()) / "items")
    cli.main(["evaluate", gated, "--out", p("eval"), "--index", p("index"), "--model", quoting, "--tau", "0.5", "--include-failing"])
    folder = next((tmp_path / "eval").iterdir())
    assert spark.read.json(str(folder / "items")).count() == 2 * spark.read.json(gated).count()
    assert "inline_prompted" in spark.read.json(str(folder / "manifest")).first().strategies
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "q", "text": "green pears"}))
    cli.main(["compare", p("q.jsonl"), "--index", p("index"), "--k", "1", "--terms", "english"])
    (tmp_path / "bench.jsonl").write_text(json.dumps({"query_id": "q", "query": "why", "quotes": [{"idx": 1, "text": "So it is."}], "answers": [{"answer": "x", "attributable": [1]}]}))
    cli.main(["benchmark", p("bench.jsonl"), "--out", p("bench"), "--model", quoting])
    cli.main(["review", gated, "--reviews", p("none"), "--include-failing", "--n", "1"])
    said = capsys.readouterr().out
    assert "inline_prompted" in said and "sentences_median_ms" in said
    spark.conf.unset("spark.sql.codegen.wholeStage")
