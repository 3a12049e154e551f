"""Whole texts read in Python against the functions of columns, and how often texts are read."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from inkspan.functions import reading as rd
from inkspan.functions import text as tx
from inkspan.operators import inventory as iv
from inkspan.operators import profile as pf
from inkspan.operators import report as rp
from inkspan.operators import revise as rv
from inkspan.operators import scan

WORDS = ["the", "Dr.", "e.g.", "Mr.", "etc.", "no.", "U.S.A", "a.b.c.", "So", "so", "for example", "Über", "İstanbul", "ΟΔΟΣ", "ﬁne", "x²", "Ⅷ", "3.14", "1,000.5%", "2019", "rock'n'roll", "don’t", "“Quote”", "\"Yes\"", "_a_b", "日本語", "…", "!?", "..", "A", "1", "(", "ab.c", "....Mr.", "x.y.z.q", "\x01", "\x1c", "\x00"]
GAPS = [" ", " ", " ", "  ", "\n", "\n\n", "\n \n", "\r\n", "\r", ". ", "! ", ".\n", ", ", "", ".", "… "]


def odd_texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.choice([1, 3, 9, 60]))) for _ in range(400)]
    return made + ["", " ", "\n\n", "A. B. C. D", "Mr. Smith. Dr. X", ".e.g. A", "x.e.g. A", "." * 30 + "e.g. A", "beautiful makes wanted table"]


def test_reading_follows_the_rules_of_columns(spark):
    texts = odd_texts()
    clean = tx.nfkc(F.col("text"))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    want = df.select("id", tx.words(clean).alias("words"), tx.lowered(tx.words(clean)).alias("low"), F.transform(tx.sentences(clean), tx.word_count).alias("lengths"), F.transform(tx.paragraphs(clean), lambda p: F.struct(tx.word_count(p), F.size(tx.sentences(p)))).alias("paragraphs"),
                     F.transform(tx.lowered(tx.words(clean)), tx.syllables).alias("syllables"), iv.most_frequent(iv.word_ngrams(iv.tokens_of(F.col("text")), 2), 5).alias("bigrams"), iv.most_frequent(iv.char_ngrams(tx.lines(F.col("text")), 3), 5).alias("characters"), tx.mark_count(F.col("text"), '"').alias("quotes"), tx.length_without_space(F.col("text")).alias("dense"))
    for r in want.collect():
        got = rd.Reading(texts[r.id], rd.nfkc(texts[r.id]), tx.VOWELS)
        assert (got.words, got.low, got.lengths) == (r.words, r.low, r.lengths), texts[r.id]
        assert got.paragraphs == [tuple(p) for p in r.paragraphs] and got.syllables[0] == sum(r.syllables)
        assert got.top_ngrams(2, 5) == [(x["item"], x["count"]) for x in r.bigrams] and got.top_characters(3, 5) == [(x["item"], x["count"]) for x in r.characters]
        assert rd.MEASURES["mark_10"](got) == r.quotes and rd.MEASURES["characters_no_spaces"](got) == r.dense


def test_phrases_read_each_text_once(spark):
    df = spark.createDataFrame([("a", 1, "One two three. One two three."), ("a", 2, "One two three four."), ("b", 3, " - "), ("b", 4, "Five")], "author string, uid int, text string")
    phrases = pf.common_phrases(df, ["author"], n=3)
    plan = phrases._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan
    got = {(r.author, r.item): (r["count"], r.sample_presence, r["rank"]) for r in phrases.collect()}
    assert got["a", "one two three"] == (3, 1.0, 1) and got["a", "two three four"][1] == 0.5 and {a for a, _ in got} == {"a"}


def test_reports_on_the_samples_themselves_read_them_once(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, "One two. Three."), ("a", 2, "Four five six.")], "author string, uid int, text string")
    calls, real = [], pf.sample_table
    monkeypatch.setattr(pf, "sample_table", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert rp.compare(df, df, ["uid"], "author", "uid").count() == 2 and len(calls) == 1


def test_parts_are_small_and_whole():
    texts = pa.array(["x" * 600_000, None, "y" * 600_000, "z"] + ["w"] * 2000)
    at, sizes = 0, []
    while at < len(texts):
        sizes.append(scan.part_rows([texts], at, scan.PART_BYTES))
        at += sizes[-1]
    assert at == len(texts) and sizes[0] == 3 and max(sizes) <= scan.PART_ROWS
    assert rv.PART_BYTES <= 1 << 20
