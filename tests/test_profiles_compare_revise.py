import json

import pytest
from pyspark.sql import functions as F

from inkspan.functions import providers as pr
from inkspan.operators import compare as cp
from inkspan.operators import features as ft
from inkspan.operators import profile as pf
from inkspan.operators import revise as rv
from inkspan.sources import files


def aggregate(spark, values):
    df = spark.createDataFrame([("a", "x", v, w) for v, w in values], "author string, feature string, value double, weight double")
    return pf.numeric_aggregates(df, ["author"]).first()


def test_numeric_aggregate(spark):
    r = aggregate(spark, [(None, 1.0), (1.0, 1.0), (3.0, 1.0)])
    assert (r.n, r["mean"], r["median"], r["std"]) == (2, 2.0, 2.0, 1.0)
    r = aggregate(spark, [(1.0, 3.0), (5.0, 1.0), (float("inf"), 9.0), (float("nan"), 9.0)])
    assert (r.n, r["mean"], r["median"], r["min"], r["max"]) == (2, 2.0, 3.0, 1.0, 5.0)
    r = aggregate(spark, [(None, 1.0)])
    assert r.n == 0 and r["mean"] is None and r["std"] is None


def test_labels(spark):
    rows = [(1, 50, "low"), (3, 100, "low"), (3, 800, "medium"), (4, 2000, "high"), (2, 2000, "medium")]
    df = spark.createDataFrame(rows, "n int, w int, want string")
    assert df.where(pf.confidence_level(F.col("n"), F.col("w")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(100, 10.0), (1, 1.0), (0, 1.0)], "w int, want double")
    assert df.where(pf.sample_weight(F.col("w")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(10.0, 1.0, "stable"), (10.0, 2.0, "moderate"), (10.0, 4.0, "variable"), (0.0, 0.0, "stable"), (0.0, 1.0, "variable")], "m double, s double, want string")
    assert df.where(pf.stability(F.col("m"), F.col("s")) != F.col("want")).count() == 0


def test_outliers(spark):
    values = [12, 14, 11, 13, 15, 60]
    a = spark.createDataFrame([("a", i, v, float(v)) for i, v in enumerate(values)] + [("b", i, v, float(v)) for i, v in enumerate([1, 2, 99])], "author string, i int, words long, average_sentence_length double").withColumn("transition_count", F.lit(0))
    got = pf.outliers(a, ["author"], "i").collect()
    assert {(r.author, r.i) for r in got} == {("a", 5)} and len(got) == 2


def test_numeric_status(spark):
    df = spark.createDataFrame([(10.0, 10.0, 0.0, "close"), (13.0, 10.0, 0.0, "moderately_different"), (20.0, 10.0, 0.0, "significantly_different"), (11.5, 10.0, 1.0, "moderately_different"), (13.0, 10.0, 1.0, "significantly_different"), (10.5, 10.0, 1.0, "close"), (None, 10.0, 1.0, "unavailable"), (1.0, None, None, "unavailable")], "v double, m double, s double, want string")
    got = df.withColumn("got", cp.numeric_status(F.col("v"), F.col("m"), F.col("s"), F.col("m") - F.col("s"), F.col("m") + F.col("s")))
    assert got.where("got <> want").collect() == []


def test_overall_and_weights(spark):
    rows = [(1, d, s) for d, s in [("vocabulary", "close"), ("ngrams", "significantly_different"), ("cohesion", "unavailable")]] + [(2, "vocabulary", "unavailable")]
    df = spark.createDataFrame(rows, "uid int, dimension string, status string")
    got = {r.uid: r.status for r in cp.overall_status(df, ["uid"]).collect()}
    assert got == {1: "moderately_different", 2: "unavailable"}
    assert {r.uid: r.status for r in cp.overall_status(df, ["uid"], {"ngrams": 0}).collect()}[1] == "close"
    for bad in ({"none": 1.0}, {"ngrams": -1}, {"ngrams": "x"}):
        with pytest.raises(ValueError):
            cp.check_weights(bad)


def test_profiles_hold_no_text(spark):
    texts = ["The quick brown fox jumps. However, it stays calm because it can.", "The quick brown fox sleeps. However, it dreams because it must.", ""]
    df = spark.createDataFrame([("me", i, t) for i, t in enumerate(texts)], "author string, sample_index int, text string")
    p = pf.build_profiles(df)
    r = p.first()
    assert (r.sample_count, r.skipped_samples, r.confidence) == (2, 1, "low")
    assert [x["item"] for x in r.common_connectives][:2] == ["because", "however"]
    assert len(r.numbers) == len(pf.FEATURES) and r.numbers["vocabulary.type_token_ratio"]["n"] == 2
    assert "text" not in p.columns and texts[0] not in json.dumps(r.asDict(True), default=str)
    with pytest.raises(ValueError):
        pf.build_profiles(df, context="poetry")
    assert pf.build_profiles(df.limit(0)).count() == 0


def test_hard_checks(spark):
    original = "In 2019 we saw 95% growth (Smith, 2019) and [1] said so over many long words here."
    pairs = [("kept", original), ("number", original.replace("95%", "96%")), ("cite", original.replace("[1]", "")), ("short", "In 2019 95% (Smith, 2019) [1]"), ("other", "2019 95% (Smith, 2019) [1] " + "x y z " * 9), ("empty", " ")]
    got = {r.k: r for r in rv.hard_checks(spark.createDataFrame([(k, original, t) for k, t in pairs], "k string, original string, revised string")).collect()}
    assert got["kept"].passed and got["kept"].similarity == 1.0
    assert "95%" in got["number"].failures[0] and "[1]" in " ".join(got["cite"].failures)
    assert got["empty"].failures == ["empty revision"] and not got["other"].passed


def test_responses(spark):
    rows = [('{"revised_text": "a b", "change_summary": [{"dimension": "d", "description": "x", "importance": "odd"}, {"description": ""}]}', "a b"), (" plain ", "plain"), ('{"revised_text"', ""), ("  ", ""), (None, ""), ('{"other": 1}', "")]
    df = spark.createDataFrame(rows, "r string, want string")
    got = df.select("want", rv.parse_response(F.col("r")).alias("got"), rv.parse_changes(F.col("r")).alias("c")).collect()
    assert all(x.got == x.want for x in got)
    assert [tuple(c) for c in got[0].c] == [("d", "x", "medium")]


def test_revise_batch(spark, tmp_path):
    rows = [(1, "Keep 42 as it is today.", ""), (2, "  ", ""), (3, "Fine text.", "make this undetectable")]
    drafts = spark.createDataFrame([(k, d, "p", "c", r) for k, d, r in rows], "key int, draft string, profile_text string, comparison_text string, user_request string")
    got = {r.key: r for r in rv.revise_batch(drafts, pr.echo, 2).collect()}
    assert got[1].passed and got[1].revised == rows[0][1] and got[1].attempts == 1
    assert not got[2].passed and got[3].failures == ["requests for detector evasion are refused"]
    bad = {r.key: r for r in rv.revise_batch(drafts, pr.json_revision(lambda d: d.replace("42", "")), 2).collect()}
    assert not bad[1].passed and bad[1].attempts == 2
    with pytest.raises(ValueError):
        rv.revise_batch(drafts, pr.echo, 9)


def test_providers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise pr.RateLimitError
        return "ok"

    assert pr.with_retries(flaky, 2, sleep=lambda s: None) == "ok"
    with pytest.raises(pr.AuthenticationError):
        pr.with_retries(lambda: (_ for _ in ()).throw(pr.AuthenticationError()), 3, sleep=lambda s: None)
    assert pr.normalize_response({"content": [{"text": "a"}, {"x": 1}, {"text": "b"}]}) == "ab"
    with pytest.raises(pr.InvalidResponseError):
        pr.normalize_response(3)
    with pytest.raises(pr.ConfigurationError):
        pr.get_provider("none")


def test_files(spark, tmp_path):
    for name, text in (("b.txt", "B text.\n"), ("a.txt", "A text.")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = files.read_texts(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/a.txt"]).orderBy("sample_index").collect()
    assert [(r.sample_index, r.text) for r in got] == [(0, "A text."), (1, "B text.\n")]
    with pytest.raises(ValueError, match="no1.*no2"):
        files.read_texts(spark, [f"{tmp_path}/no1", f"{tmp_path}/no2"])
    assert files.validate_profile([]) == ["profile must be a JSON object"] and len(files.validate_profile({})) == len(files.REQUIRED_KEYS)
    good = dict.fromkeys(files.REQUIRED_KEYS, {}) | {"profile_version": "0.1.0", "metadata": {"sample_count": 1, "total_words": 9, "language": "en", "context": "general"}, "confidence": {"overall": "low"}}
    assert files.validate_profile(good) == []
    assert len(files.validate_profile(good | {"vocabulary": {"raw_text": "x", "y": float("nan")}})) == 2
    assert files.check_compatibility({"profile_version": "0.1.0", "metadata": {"analyzer_version": "0.0.9"}})[1] and files.check_compatibility({"profile_version": "9"})[0] == files.check_compatibility({})[0] == files.check_compatibility(3)[0] == "unsupported"
    assert files.to_json({"b": "é", "a": 1}) == '{"a": 1, "b": "é"}'


def test_stream(spark, tmp_path):
    from inkspan.streaming import analyze_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "Hello world."), (2, "One. Two.")], "id int, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = analyze_stream(stream).select("id", "words", "sentences").writeStream.format("memory").queryName("analyzed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("analyzed").collect())) == [(1, 2, 1), (2, 2, 2)]


def drafts_and_samples(spark):
    same = "However the quick fox runs home. The quick fox sleeps. The quick fox eats well."
    samples = spark.createDataFrame([("a", i, same) for i in range(3)] + [("a", 3, ""), ("b", 0, " ")], "author string, sample_index int, text string")
    drafts = spark.createDataFrame([("same", "a", same), ("none", "a", " "), ("other", "a", "Perhaps a small bird sings here. A small bird hides. A small bird flies off."), ("lost", "b", same), ("null", "a", None)], "uid string, author string, text string")
    return drafts, samples


PHRASES = [("vocabulary", "shared_characteristic_terms"), ("cohesion", "shared_connectives"), ("ngrams", "common_bigrams"), ("ngrams", "common_trigrams")]


def test_all_rows_of_a_draft(spark):
    drafts, samples = drafts_and_samples(spark)
    rows = cp.all_rows(pf.sample_table(drafts).cache(), pf.sample_table(samples).cache(), ["uid"], "author", "sample_index").cache()
    status = {(r.uid, r.dimension, r.metric): r.status for r in rows.collect()}
    assert len(status) == rows.count() == 4 * 37 and {k[0] for k in status} == {"same", "other", "none", "lost"}
    assert [status["same", *p] for p in PHRASES] == ["close"] * 4
    assert [status["other", *p] for p in PHRASES] == ["significantly_different"] * 4
    assert {v for k, v in status.items() if k[0] in ("none", "lost")} == {"unavailable"}  # no words, and no profile
    dims = {(r.uid, r.dimension): r.status for r in cp.dimension_status(rows, ["uid"]).collect()}
    assert dims["same", "ngrams"] == "close" and dims["other", "ngrams"] == "significantly_different" and len({d for _, d in dims}) == 7


def test_reports(spark):
    from inkspan.operators import report as rp

    drafts, samples = drafts_and_samples(spark)
    got = {r.uid: r for r in rp.compare(drafts, samples, ["uid"], draft_context="academic").collect()}
    assert set(got) == {"same", "none", "other", "lost"}
    assert got["same"].status == "close" and got["other"].status != "close"
    assert all(len(r.dimensions) == 7 and sum(len(d.metrics) for d in r.dimensions) == 37 and r.confidence == "low" for r in got.values())
    assert got["none"].status == "unavailable" and got["none"].summary == ["The draft has no words, so nothing was compared."]
    assert any("academic" in x for x in got["same"].limitations) and rp.CAUTION in got["none"].limitations
    told = [m.explanation for d in got["other"].dimensions for m in d.metrics]
    assert any("topic" in x for x in told) and all(told)
    assert {r.status for r in rp.compare(drafts.where("uid = 'other'"), samples, ["uid"], weights=dict.fromkeys(cp.lx.DIMENSION_WEIGHTS, 0.0)).collect()} == {"unavailable"}


def test_revision_checked_as_a_whole(spark):
    rows = [("fine", "In 1999 the fox ran home.", "In 1999 the quick fox ran home.", ["home"], "close", "close"), ("away", "In 1999 the fox ran home.", "In 1999 the fox ran off.", ["home", "fox", "the"], "close", "moderately_different"), ("bad", "In 1999 the fox ran home.", "the fox ran home", [], None, "close"), ("empty", "In 1999 the fox.", " ", ["the"], "close", None), ("better", "a b c d", "a b c e", None, "significantly_different", "close")]
    df = spark.createDataFrame(rows, "k string, original string, revised string, terms array<string>, status_before string, status_after string")
    got = {r.k: r for r in rv.validate_revision(df).collect()}
    assert got["fine"].passed and got["fine"].warnings == [] and not got["fine"].drift.drifted
    assert got["away"].passed and got["away"].warnings == ["dropped characteristic term: home", "style drift away from the profile: close to moderately_different"] and got["away"].drift.drifted
    assert not got["bad"].passed and "1999" in got["bad"].failures[0] and not got["bad"].drift.drifted
    assert got["empty"].failures == ["empty revision"] and got["empty"].warnings == []
    assert got["better"].drift[:2] == ("significantly_different", "close") and not got["better"].drift.drifted


def test_revise_compares_again(spark):
    same = "However the quick fox runs home. The quick fox sleeps. The quick fox eats well.\n"
    samples = spark.createDataFrame([("a", i, same * 6) for i in range(3)], "author string, sample_index int, text string")
    drafts = spark.createDataFrame([("d", "a", (same * 6).strip(), "be brief")], "key string, author string, draft string, user_request string")
    (kept,) = rv.revise_drafts(drafts, samples, pr.echo).collect()
    assert kept.passed and kept.revised == (same * 6).strip() and kept.drift.before == "close" and kept.drift.after is None
    (moved,) = rv.revise_drafts(drafts, samples, pr.json_revision(lambda d: d + " extraordinarily complicated considerations" * 40)).collect()
    assert moved.passed and moved.drift.after != "close" and moved.drift.drifted and any("drift" in w for w in moved.warnings)


def test_profile_documents(spark, tmp_path):
    texts = ["The quick fox runs. However, it stays, because it can; so it rests.", "The quick fox sleeps! However, it dreams, because it must; so it rests.", "The quick fox eats. However, it hides, because it may; so it rests."]
    df = spark.createDataFrame([("me", i, t) for i, t in enumerate(texts)], "author string, sample_index int, text string")
    row = pf.build_profiles(df).first().asDict(True)
    doc = files.profile_document(row)
    assert files.validate_profile(doc) == [] and list(doc) == list(files.REQUIRED_KEYS) or set(doc) == set(files.REQUIRED_KEYS)
    assert doc["confidence"]["feature_coverage"]["vocabulary.type_token_ratio"] == 3 and len(doc["confidence"]["feature_coverage"]) == len(pf.FEATURES)
    path = str(tmp_path / "p.json")
    files.save_profile(doc, path)
    raw = open(path, encoding="utf-8").read()
    assert raw == json.dumps(doc, ensure_ascii=False, sort_keys=True, indent=2) + "\n" and all(t not in raw for t in texts)
    numbers, wanted, metadata = files.profile_tables(spark, files.load_profile(path))
    assert {r.feature: r["mean"] for r in numbers.collect()} == {k: v["mean"] for k, v in row["numbers"].items()}
    draft = pf.sample_table(spark.createDataFrame([("x", "author", texts[0])], "uid string, author string, text string")).cache()
    stored = {(r.dimension, r.metric): r.status for r in cp.rows_against(draft, numbers, wanted, ["uid"], "author").collect()}
    samples = pf.sample_table(df.withColumn("author", F.lit("author"))).cache()
    assert stored == {(r.dimension, r.metric): r.status for r in cp.all_rows(draft, samples, ["uid"], "author", "sample_index").collect()} and len(stored) == 37
    assert metadata.first().sample_count == 3
    for key in files.RAW_TEXT_KEYS:  # each forbidden key, at any depth
        bad = json.loads(raw)
        bad["patterns"]["x"] = [{key: "y"}]
        assert files.validate_profile(bad) == [f"forbidden raw-sample key at profile.patterns.x[0].{key}"]
        with pytest.raises(ValueError):
            files.save_profile(bad, path)
    for key in files.REQUIRED_KEYS:
        assert files.validate_profile({k: v for k, v in doc.items() if k != key}) == [f"missing required key: {key}"]
    assert files.validate_profile(doc | {"metadata": {}})[0] == "metadata missing key: sample_count"
    (tmp_path / "p.json").write_text(raw.replace('"profile_version": "0.1.0"', '"profile_version": "9"'))
    with pytest.raises(ValueError, match="profile_version"):
        files.load_profile(path)


def test_http_provider(monkeypatch):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = {"limit": 429, "key": 401, "down": 500}.get(body["prompt"], 200)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"not json" if body["prompt"] == "odd" else json.dumps({"content": [{"text": body["prompt"].upper() + self.headers["X-Key"]}]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("INKSPAN_TEST_KEY", "!")
    url = f"http://127.0.0.1:{server.server_port}/"
    ask = pr.get_provider("http", url=url, headers_from={"X-Key": "INKSPAN_TEST_KEY"}, retries=0)
    assert ask("hello") == "HELLO!"
    for prompt, error in (("limit", pr.RateLimitError), ("key", pr.AuthenticationError), ("down", pr.ProviderError), ("odd", pr.InvalidResponseError)):
        with pytest.raises(error):
            ask(prompt)
    with pytest.raises(pr.ConfigurationError):
        pr.http_provider(url, {"X-Key": "INKSPAN_NO_SUCH_KEY"})("hello")
    server.shutdown()
    server.server_close()
    with pytest.raises(pr.ProviderError):
        pr.post_json(url, {}, timeout=1)
    assert pr.Capabilities(structured_output=True).output_kind() == "structured" and pr.Capabilities().output_kind() == "text-fallback"
    assert pr.Capabilities(temperature=True).checked(temperature=0.5, max_tokens=None) == {"temperature": 0.5}
    with pytest.raises(pr.UnsupportedCapabilityError):
        pr.Capabilities().checked(temperature=0.5)
