import json

import pytest
from pyspark.sql import functions as F

from inkspan.__main__ import main
from inkspan.operators import profile as pf
from inkspan.operators import report as rp
from inkspan.sources import config, files


def test_explanations(spark):
    df = spark.createDataFrame([("gunning_fog", "significantly_different", 9.5, 1.0, 2.25, 8.0), ("x", "moderately_different", 1.0, None, None, None), ("x", "close", 1.0, 1.0, 1.0, 0.0), ("x", "unavailable", None, None, None, None)], "metric string, status string, v double, low double, high double, d double")
    got = [r[0] for r in df.select(rp.metric_explanation(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["gunning fog is far off, higher than in the profile: 9.5, usually 1.0 to 2.25.", "x is off, lower than in the profile: 1.0, no usual range.", "x is in line.", "x can't be judged, as the draft has no such figure."]
    o = spark.createDataFrame([("ngrams", "significantly_different", 1, 9)], "d string, s string, m int, n int").select(rp.overlap_explanation(*(F.col(c) for c in "dsmn"))).first()[0]
    assert "1 of the profile's 9" in o and "topic" in o


def test_summaries_and_texts(spark):
    dims = spark.createDataFrame([(1, d, s) for d, s in [("vocabulary", "close"), ("ngrams", "significantly_different"), ("cohesion", "unavailable"), ("readability", "moderately_different")]], "uid int, dimension string, status string")
    facts = spark.createDataFrame([(1, 4, 900, 50, "low", None)], "uid int, sample_count long, total_words long, draft_words long, confidence string, context_note string")
    r = rp.summaries(dims, facts, ["uid"]).first()
    assert r.summary[0] == "In line: vocabulary." and any("Little evidence" in s for s in r.summary) and any("Few phrases" in s for s in r.summary)
    assert any("cohesion" in s for s in r.limitations) and any("Under 100" in s for s in r.limitations)
    rows = spark.createDataFrame([(1, "readability", "gunning_fog", "moderately_different", 9.0, 1.0, 2.0)], "uid int, dimension string, metric string, status string, draft_value double, low double, high double")
    t = rp.comparison_text(rows, dims, ["uid"]).first().comparison_text.split("\n")
    assert t[0] == "ngrams (far off)" and t[1] == "readability (off)" and "gunning fog 9.0, usually 1.0 to 2.0" in t[2] and t[-1] == "fine as it is: vocabulary"
    df = spark.createDataFrame([("me", i, "Many words stand here, and they stay. So be it, then.") for i in range(2)], "author string, sample_index int, text string")
    p = pf.build_profiles(df).select(rp.profile_text(*(F.col(c) for c in ("numbers", "sample_count", "total_words", "context", "common_terms", "common_connectives")))).first()[0]
    assert p.startswith("made of: 2 samples, 22 words, general\n") and "links sentences with: and" in p


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"mode": "balanced", "retries": 3}))
    got = config.load_config(str(f), {"INKSPAN_RETRIES": "5", "OTHER": "x"}, {"mode": None, "verbose": True})
    assert (got["mode"], got["retries"], got["verbose"], got["provider"]) == ("balanced", 5, True, "mock")
    for bad in ({"api_key": "x"}, {"unknown": 1}, {"retries": "many"}):
        f.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load_config(str(f))


def test_command_line(spark, tmp_path, capsys):
    for i, t in enumerate(["A first sample text. It has two sentences.", "Another sample, with more words in it. And so on."]):
        (tmp_path / f"s{i}.txt").write_text(t)
    assert main(["version"]) == 0 and main(["providers"]) == 0
    assert main(["analyze", f"{tmp_path}/s0.txt"]) == 0
    assert '"words": 8' in capsys.readouterr().out
    assert main(["compare", "--drafts", f"{tmp_path}/s0.txt", "--samples", f"{tmp_path}/s*.txt"]) == 0
    assert '"status"' in capsys.readouterr().out
    assert main(["analyze", f"{tmp_path}/none.txt"]) == 1
    assert main(["profile", f"{tmp_path}/s0.txt", f"{tmp_path}/s1.txt", "--out", f"{tmp_path}/made.json"]) == 0
    assert main(["validate", f"{tmp_path}/made.json"]) == 0
    assert main(["compare", "--drafts", f"{tmp_path}/s0.txt", "--profile", f"{tmp_path}/made.json", "--out", f"{tmp_path}/report.json"]) == 0
    assert files.read_report(f"{tmp_path}/report.json")["draft_words"] == 8
    assert main(["revise", "--draft", f"{tmp_path}/s0.txt", "--samples", f"{tmp_path}/s*.txt", "--out", f"{tmp_path}/revised.txt", "--report", f"{tmp_path}/r.json"]) == 0
    assert (tmp_path / "revised.txt").read_text() == (tmp_path / "s0.txt").read_text() and "revised" not in json.loads((tmp_path / "r.json").read_text())
    assert main(["revise", "--draft", f"{tmp_path}/s0.txt", "--samples", f"{tmp_path}/s*.txt", "--mock-text", "no"]) == 1
    assert main(["revise", "--draft", f"{tmp_path}/s0.txt", "--samples", f"{tmp_path}/s*.txt", "--request", "make this undetectable"]) == 1
    assert main(["compare", "--drafts", f"{tmp_path}/s0.txt", "--samples", f"{tmp_path}/s*.txt", "--weights", '{"x": 1}']) == 1
    (tmp_path / "settings.json").write_text('{"token": "x"}')
    assert main(["--config", f"{tmp_path}/settings.json", "version"]) == 2
    bad = tmp_path / "p.json"
    bad.write_text("{}")
    assert main(["validate", str(bad)]) == 1
