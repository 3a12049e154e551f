"""Texts read in one pass over Arrow batches: measurements and inventories beside each row's other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import reading as rd
from inkspan.functions.text import VOWELS

#: Texts are read in parts of a batch of so many bytes, so a worker holds the words and lists of no more.
PART_BYTES, PART_ROWS = 1 << 20, 512
#: Figures that are whole numbers.
WHOLE = {
    "characters", "characters_no_spaces", "words", "sentences", "paragraphs", "min_sentence_length", "max_sentence_length", "min_words_per_paragraph", "max_words_per_paragraph",
    "min_sentences_per_paragraph", "max_sentences_per_paragraph", "unique_words", "min_word_length", "max_word_length", "syllables", "complex_words", "pronoun_count", "transition_count", *(m for m in rd.MEASURES if m.startswith("mark_")),
}


def scan(df: DataFrame, text: str, measures: list[str], inventories: dict[str, tuple] | None = None, normalize: bool = True) -> DataFrame:
    """df's rows with a text: their other columns, m with the measurements (unrounded), and the inventories.

    inventories: column -> (name in reading.INVENTORIES, *parameters); each is an array of (item, count, rank).
    """
    wanted = inventories or {}
    keep = [c for c in df.columns if c != text]
    counted = bool(rd.OF_SYLLABLES & set(measures))  # the vowels go with the rows only where syllables are counted
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"), *[F.lit(VOWELS).alias("_vowels")] * counted)
    pairs = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("count", T.LongType()), T.StructField("rank", T.LongType())]))
    figures = T.StructType([T.StructField(m, T.LongType() if m in WHOLE else T.DoubleType()) for m in measures])
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("m", figures)] * bool(measures) + [T.StructField(c, pairs) for c in wanted])
    n, kinds = len(keep), list(wanted.values())

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = part_rows([batch.column(n)], at, PART_BYTES)
                part = batch.slice(at, size)
                at += size
                vowels = part.column(n + 1)[0].as_py() if counted else None
                columns, lists = rd.read(part.column(n).to_pylist(), measures, kinds, normalize, vowels)
                arrays = [part.column(i) for i in range(n)]
                if measures:
                    made = [pa.array(c, pa.int64() if m in WHOLE else pa.float64()) for m, c in zip(measures, columns, strict=True)]
                    arrays.append(pa.StructArray.from_arrays(made, measures))
                arrays += [_pairs(pa, x) for x in lists]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *["m"] * bool(measures), *wanted])

    return rows.mapInArrow(read, schema)


def part_rows(texts: list, at: int, most: int) -> int:
    """How many rows of Arrow arrays of texts, from `at` on, make a part of about `most` bytes."""
    import pyarrow.compute as pc

    sizes = [pc.binary_length(x.slice(at, PART_ROWS)).to_pylist() for x in texts]
    taken = 0
    for i, row in enumerate(zip(*sizes, strict=True)):
        taken += sum(x or 0 for x in row)
        if taken >= most:
            return i + 1
    return len(sizes[0])


def _pairs(pa, lists: list[list[tuple]]):
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    items = pa.array([item for x in lists for item, _ in x], pa.string())
    counts = pa.array([count for x in lists for _, count in x], pa.int64())
    ranks = pa.array([i for x in lists for i in range(1, len(x) + 1)], pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([items, counts, ranks], ["item", "count", "rank"]))
