import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.operators import features as ft
from inkspan.operators import inventory as iv

TEXTS = {
    "empty": "",
    "blank": " \n\t ",
    "hello": "Hello world.",
    "paragraphs": "One two three.\n\nFour five six seven.",
    "lines": "One two.\nThree four.",
    "doctor": "Dr. Smith arrived late. He left early.",
    "dotted": "See e.g. Figure 2. It shows i.e. All of it.",
    "marks": "Hi, you there! Why now?",
    "people": "I think we know it because you do; however, I left.",
    "accents": "Café déjà vu — c'est là. Übung macht Spaß.",
    "ellipsis": "Wait… Then go.",
    "quotes": "He said “no” twice. \"Yes\" she said.",
    "apostrophes": "rock'n'roll it’s don't 3.14 a_b",
    "types": "dog dog dog cat cat bird",
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "name string, text string")
    return {r.name: r for r in ft.analyze(df).collect()}


@pytest.mark.parametrize("name", ["empty", "blank"])
def test_nothing_to_measure(rows, name):
    r = rows[name]
    assert (r.words, r.sentences, r.paragraphs) == (0, 0, 0)
    assert r.average_word_length is r.type_token_ratio is r.flesch_reading_ease is r.punctuation_density is r.short_ratio is r.sentence_deviation is None


def test_counts(rows):
    r = rows["hello"]
    assert (r.words, r.sentences, r.average_word_length, r.characters, r.characters_no_spaces) == (2, 1, 5.0, 12, 11)
    assert r.sentence_deviation == 0.0 and r.nouns is None
    p = rows["paragraphs"]
    assert (p.paragraphs, p.average_words_per_paragraph, p.average_sentences_per_paragraph) == (2, 3.5, 1.0)
    assert rows["lines"].paragraphs == 1 and rows["lines"].sentences == 2
    assert rows["doctor"].sentences == 2 and rows["dotted"].sentences == 2
    assert (rows["accents"].words, rows["accents"].sentences) == (8, 1)  # only ASCII capitals begin a sentence
    assert rows["ellipsis"].sentences == 2 and rows["apostrophes"].words == 8


def test_rates(rows):
    r = rows["marks"]
    assert r.words == 5 and r.punctuation_density == 0.6 and r.per_100_1 == 20.0
    assert rows["types"].type_token_ratio == 0.5
    assert rows["people"].pronoun_count == 5 and rows["people"].transition_count >= 2
    assert rows["quotes"].mark_10 == 4 and rows["accents"].mark_9 == 1


def test_words_and_syllables(spark):
    df = spark.createDataFrame([(w, n) for w, n in [("cat", 1), ("table", 2), ("make", 1), ("makes", 1), ("wanted", 1), ("beautiful", 3), ("'", 0), ("the", 1), ("reading", 2), ("rhythm", 1)]], "w string, n int")
    assert [r.w for r in df.withColumn("got", tx.syllables(F.col("w"))).where("got <> n").collect()] == []
    got = spark.createDataFrame([(TEXTS["apostrophes"],)], "t string").select(tx.words(F.col("t"))).first()[0]
    assert got == ["rock'n", "roll", "it", "s", "don't", "3.14", "a", "b"] or got == ["rock'n", "roll", "it", "s", "don", "t", "3.14", "a", "b"]


def test_extraction(spark):
    text = "In 1,234.5 of 95% cases (Smith & Jones, 2019) [1, 2] found 5; Doe et al. (2021b) 5."
    r = spark.createDataFrame([(text,)], "t string").select(tx.numbers(F.col("t")).alias("n"), tx.citations(F.col("t")).alias("c")).first()
    assert set(r.n) == {"1,234.5", "95%", "2019", "1", "2", "5", "2021"}
    assert set(r.c) == {"[1, 2]", "(Smith & Jones, 2019)", "Doe et al. (2021b)"}


def test_inventories(spark):
    df = spark.createDataFrame([(1, "b a b a c"), (2, ""), (3, "so so so, for example")], "id int, text string")
    tokens = iv.tokens_of(F.col("text"))
    top = [(r.id, r.item, r["count"]) for r in iv.top_items(df, tokens, ["id"], 2).orderBy("id", "rank").collect()]
    assert top[:2] == [(1, "b", 2), (1, "a", 2)]
    grams = {(r.id, r.item): r["count"] for r in iv.repeated_items(df, iv.word_ngrams(tokens, 2), ["id"], 1).collect()}
    assert grams[1, "b a"] == 2 and grams[1, "a b"] == 1 and grams[1, "a c"] == 1 and (2, "") not in grams
    found = {(r.id, r.item): r["count"] for r in iv.connective_counts(df, "text", ["id"]).collect()}
    assert found == {(3, "so"): 2, (3, "for example"): 1}
    chars = {r.item: r["count"] for r in iv.repeated_items(df.where("id = 1"), iv.char_ngrams(F.col("text"), 3), ["id"], 1).collect()}
    assert chars["b a"] == 2 and sum(chars.values()) == 7


def test_inventories_match_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 80))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in iv.top_items(df, iv.tokens_of(F.col("text")), ["id"], 4).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.item, r["count"]))
    want = {i: Counter(t.split()).most_common(4) for i, t in texts.items() if t}  # ties by first place
    assert got == want


def test_only_what_is_asked_for_is_measured(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "name string, text string")
    whole = {r.name: r.asDict() for r in ft.analyze(df).collect()}
    for only in (["words"], ["characters", "mark_2"], ["flesch_reading_ease", "syllables"], ["per_100_1", "punctuation_density"], ["paragraphs", "average_sentences_per_paragraph"], ["transition_count", "nouns"]):
        part = ft.analyze(df, only=only)
        assert part.columns == ["name", *only]
        assert all(r[c] == whole[r.name][c] for r in part.collect() for c in only)
    plan = ft.analyze(df, only=["type_token_ratio"])._jdf.queryExecution().optimizedPlan().toString()
    assert "aeiouy" not in plan and "aeiouy" in ft.analyze(df, only=["syllables"])._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_analyse_once(spark):
    """No filter on the words is pushed below the analysis, which would double it."""
    from inkspan.operators import profile as pf

    df = spark.createDataFrame([("a", "One two. Three."), ("a", " - ")], "author string, text string").repartition(4)
    plan = pf.long_features(ft.analyze(df), ["author"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == pf.ft.analyze(df)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_order_of_rows_does_not_matter(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "name string, text string")
    a, b = (sorted(map(str, ft.analyze(x).collect())) for x in (df, df.orderBy(F.desc("text")).repartition(5)))
    assert a == b


def test_registered_queries_normalise(spark, tmp_path):
    from inkspan.plans.queries import QUERIES

    texts = ["Le café était fermé. ﬁne ｗｏｒｄｓ x² ①", "plain ascii text\r\nhere", "", "①"]
    for name, form in (("raw", lambda t: t), ("clean", lambda t: __import__("unicodedata").normalize("NFKC", t))):
        spark.createDataFrame([(i, form(t), "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 0, "user", form(t)) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    first = QUERIES["text_counts"](spark, f"{tmp_path}/raw").where("uid = 0").first()
    assert first.words == 9 and first.characters == len(texts[0])
    for query in ("vocabulary_features", "readability", "paragraph_structure", "top_words", "top_bigrams", "common_terms", "transitions"):
        got, want = (sorted(map(str, QUERIES[query](spark, f"{tmp_path}/{n}").collect())) for n in ("raw", "clean"))
        assert got == want, query


def test_whole_records(spark):
    from inkspan.operators.record import analysis_records

    text = "We saw it. However, we saw it again, and we left it; so it was."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "uid int, text string")
    rows = {r.uid: r.asDict(True) for r in analysis_records(df, top_k=2, character_ngrams=True, char_n=2, language="de").collect()}
    assert set(rows) == {1, 2}
    r = rows[1]
    assert r["metadata"] == {"analyzer_version": "0.1.0", "language": "de"} and r["basic"]["words"] == r["vocabulary"]["total_words"] == 15
    assert r["vocabulary"]["top_words"] == [{"item": "it", "count": 4}, {"item": "we", "count": 3}] and r["vocabulary"]["repeated_words"] == r["vocabulary"]["top_words"]
    assert r["linguistic"]["pronoun_counts"] == [{"item": "it", "count": 4}, {"item": "we", "count": 3}] and r["linguistic"]["nouns"] is None
    assert {x["item"] for x in r["linguistic"]["transition_counts"]} == {"however", "and", "so"}
    assert r["punctuation"]["counts"][","] == 2 and r["punctuation"]["counts"][";"] == 1 and r["sentence_structure"]["count"] == 2
    assert r["ngrams"]["top_k"] == 2 and r["ngrams"]["bigrams"][0] == {"item": "we saw", "count": 2} and len(r["ngrams"]["character_ngrams"]["ngrams"]) == 2
    assert rows[2]["basic"]["words"] == 0 and rows[2]["ngrams"]["bigrams"] == [] and rows[2]["readability"]["gunning_fog"] is None
    for bad in ({"top_k": 0}, {"char_n": 0}, {"language": " "}):
        with pytest.raises(ValueError):
            analysis_records(df, **bad)
