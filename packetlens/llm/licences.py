"""Licence scan: a paragraph classifier over word n-grams, confirmed against licence templates.

A sparse multinomial logistic regression over words and word pairs gives each paragraph a licence family, "unknown" for licence-like text of no known family, or "none". Its terms are those of
the templates. It is fitted on the templates, varied by dropped words, and on paragraphs of a bounded number of
documents that share no word triple with a template. Probabilities are calibrated on variants and
paragraphs kept back: a temperature of least log loss, then the least probability at which families
are right often enough. Below it a paragraph is unknown. A predicted family is confirmed if enough of
the paragraph's word triples are the family's, or enough of one of its templates' are the paragraph's.

A paragraph is a run of lines of which each but the last is wrapped: it has a word, ends no sentence and
is followed by a line with a word. A wrapped notice is so judged as a whole, and a notice of one line
between other lines for itself.

Everything on the path from documents to results is DataFrame functions and Spark ML's transformers.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import let
from .licence_texts import OTHER, TEMPLATES

NEGATIVE_DOCS = 500  # documents that give paragraphs of the class "none", at most
VARIANTS = 40
FIT_TASKS = 4  # the fit's table is small and bounded
PRECISION = 0.99
CONFIRM = 0.5
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, UNKNOWN, *TEMPLATES]
_HAS_WORD = r"[\p{L}\p{N}]"
_SENTENCE_END = r"[.!?:][^\p{L}\p{N}]*$"
_WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _triples(words: Column) -> Column:
    """Distinct runs of three words; of fewer words, all of them."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " ")
    )
    short = F.filter(F.array(F.array_join(words, " ")), lambda x: x != "")
    return F.array_distinct(F.when(F.size(words) >= 3, runs).otherwise(short))


def _terms(df: DataFrame) -> DataFrame:
    """``df(words)`` with the array ``terms`` of its words and word pairs."""
    paired = NGram(n=2, inputCol="words", outputCol="pairs").transform(df)
    return paired.withColumn("terms", F.concat("words", "pairs")).drop("pairs")


def _features(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``df(words)`` with the vector ``features`` of those terms that are in the vocabulary."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    return counter.setBinary(True).transform(_terms(df)).drop("terms")


def _fixed(spark: SparkSession) -> DataFrame:
    """``(label, text, words)`` of the templates: some dozens of rows, whatever the data."""
    texts = [(CLASSES.index(k), t) for k, group in {**TEMPLATES, UNKNOWN: OTHER}.items() for t in group]
    rows = spark.createDataFrame(texts, "label int, text string")
    return rows.withColumn("words", words_of(F.col("text")))


def _literal(texts: Iterable[str]) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def _draw(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _variants(spark: SparkSession) -> DataFrame:
    """``(label, words, kept_back)``: templates with words dropped and a cut at either end."""
    base = _fixed(spark).select(
        F.col("label").cast("double").alias("label"),
        F.col("words").alias("all"),
        F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("copy"),
    )
    key = F.hash("all", "copy")
    rate = F.when(F.col("copy") == 0, 0.0).otherwise(0.25 * _draw(key, F.lit("rate")))
    words = F.filter("all", lambda w, i: _draw(key, i, F.lit("drop")) >= rate)
    enough = F.when(F.size(words) >= 2, words).otherwise(F.col("all"))
    held = (F.col("copy") > 0) & (_draw(key, F.lit("held")) < 0.25)
    return base.select("label", enough.alias("words"), held.alias("kept_back"))


def _paragraphs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, paragraph, text, words)`` of every paragraph that has a word; its place is its first line's."""
    lines = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.split(F.col(f"`{text_column}`"), r"\n").alias("lines")
    )

    def line(i: Column) -> Column:
        return F.get(F.col("lines"), i)

    wrapped = F.transform("lines", lambda x: x.rlike(_HAS_WORD) & ~x.rlike(_SENTENCE_END))
    starts = let(
        wrapped,
        lambda w: F.filter(
            F.sequence(F.lit(0), F.size("lines") - 1),
            lambda i: (i == 0) | ~F.get(w, i - 1) | ~line(i).rlike(_HAS_WORD),
        ),
    )
    parted = lines.withColumn("starts", starts)
    after = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines"))
    joined = F.transform(
        "starts",
        lambda s, k: F.struct(
            s.alias("paragraph"), F.array_join(F.slice("lines", s + 1, after(k) - s), " ").alias("text")
        ),
    )
    paragraphs = parted.select("id", F.inline(joined))
    return paragraphs.withColumn("words", words_of(F.col("text"))).filter(F.size("words") > 0)


def _negatives(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    named = docs.select(F.col(f"`{id_column}`").alias("id")).filter("id is not null")
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(NEGATIVE_DOCS)  # two small columns
    rows = docs.join(F.broadcast(chosen.distinct()), F.col(f"`{id_column}`") == F.col("id")).select(
        F.col("id"), F.col(f"`{text_column}`").alias("text")
    )
    known = _fixed(docs.sparkSession).select(F.explode(_triples(F.col("words")))).distinct().collect()
    apart = ~F.arrays_overlap(_triples(F.col("words")), _literal(sorted(r[0] for r in known)))
    lines = _paragraphs(rows, "id", "text").filter(apart)
    return lines.select(
        F.lit(float(CLASSES.index(NONE))).alias("label"),
        "words",
        (_draw("id", "paragraph") < 0.25).alias("kept_back"),
    )


@dataclass
class LicenceModel:
    """The regression, and what its probabilities are calibrated by."""

    vocabulary: list[str]
    regression: LogisticRegressionModel
    temperature: float
    least: float


def _probabilities(raw: Column, temperature: float) -> Column:
    def shares(scaled: Column) -> Column:
        odds = let(F.array_max(scaled), lambda top: F.transform(scaled, lambda x: F.exp(x - top)))
        return let(
            odds,
            lambda o: let(
                F.aggregate(o, F.lit(0.0), lambda a, x: a + x),
                lambda total: F.transform(o, lambda x: x / total),
            ),
        )

    return let(F.transform(vector_to_array(raw), lambda x: x / temperature), shares)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> LicenceModel:
    """Fit and calibrate. Without documents the class "none" is learned from nothing."""
    spark = docs.sparkSession
    rows = _variants(spark).unionByName(_negatives(docs, id_column, text_column))
    blank = spark.createDataFrame([(0.0, ["0"], False)], "label double, words array<string>, kept_back boolean")
    terms = _terms(_fixed(spark)).select(F.explode("terms")).distinct().collect()
    vocabulary = sorted(r[0] for r in terms)
    coded = _features(rows.unionByName(blank), vocabulary).coalesce(FIT_TASKS).persist()
    learner = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.5, maxIter=100)
    regression = learner.fit(coded.filter("not kept_back"))
    tested = regression.transform(coded.filter("kept_back")).select("label", "rawPrediction").persist()

    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    own = F.col("label").cast("int") + 1
    loss = [
        F.avg(-F.log(F.greatest(F.element_at(_probabilities(F.col("rawPrediction"), t), own), F.lit(1e-12))))
        for t in grid
    ]
    losses = [x if x is not None else 0.0 for x in tested.agg(*loss).first()]
    temperature = grid[min(range(len(grid)), key=losses.__getitem__)]

    chances = tested.select("label", _probabilities(F.col("rawPrediction"), temperature).alias("p"))
    best = chances.select(
        "label", F.array_max("p").alias("top"), (F.array_position("p", F.array_max("p")) - 1).alias("best")
    ).filter(F.col("best") > CLASSES.index(UNKNOWN))
    levels = [k / 20 for k in range(8, 20)]
    right = [
        F.avg(F.when(F.col("top") >= level, (F.col("best") == F.col("label")).cast("double")))
        for level in levels
    ]
    shares = best.agg(*right).first()
    good = [level for level, share in zip(levels, shares) if share is None or share >= PRECISION]
    tested.unpersist()
    coded.unpersist()
    return LicenceModel(vocabulary, regression, temperature, min(good, default=levels[-1]))


def scan(
    docs: DataFrame, model: LicenceModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per paragraph that is not "none": id, paragraph, family, confidence, similarity, confirmed, words.

    ``paragraph`` is the number of a paragraph's first line, from 0 over all lines of the text. ``family`` is "unknown" where no
    family is likely enough. ``similarity`` is the larger of the share of the paragraph's word triples
    that the family's templates have, and the share of a template's that the paragraph has; of
    unknown paragraphs it is null, and they are not confirmed. Null and empty texts have no rows;
    repeated documents are reported each.
    """
    paragraphs = _paragraphs(docs, id_column, text_column)
    scored = model.regression.transform(_features(paragraphs, model.vocabulary))
    p = F.col("p")
    chances = scored.select(
        "id", "paragraph", "words", _probabilities(F.col("rawPrediction"), model.temperature).alias("p")
    )
    likely = chances.filter(F.element_at(p, CLASSES.index(NONE) + 1) < 0.5).select(
        "id",
        "paragraph",
        "words",
        F.slice(p, 2, len(CLASSES) - 1).alias("rest"),
    )
    top = F.array_max("rest")
    names = F.array(*[F.lit(c) for c in CLASSES[1:]])
    found = likely.select(
        "id",
        "paragraph",
        "words",
        top.alias("confidence"),
        F.when(top >= model.least, F.element_at(names, F.array_position("rest", top).cast("int")))
        .otherwise(UNKNOWN)
        .alias("family"),
    )
    fixed = _fixed(docs.sparkSession).select("label", _triples(F.col("words")).alias("t")).collect()
    lists = F.lit(None).cast("array<array<string>>")
    for family in TEMPLATES:
        own = [_literal(r.t) for r in fixed if CLASSES[r.label] == family]
        lists = F.when(F.col("family") == family, F.array(*own)).otherwise(lists)
    compared = found.withColumn("triples", _triples(F.col("words"))).withColumn("lists", lists)
    triples, size = F.col("triples"), F.size("triples")
    inside = F.size(F.array_intersect(triples, F.array_distinct(F.flatten("lists")))) / size
    covered = F.array_max(
        F.transform("lists", lambda t: F.size(F.array_intersect(triples, t)) / F.size(t))
    )
    similarity = F.when(F.col("lists").isNotNull(), F.greatest(inside, covered))
    return compared.select(
        F.col("id").alias(id_column),
        "paragraph",
        "family",
        "confidence",
        similarity.alias("similarity"),
        F.coalesce(similarity >= CONFIRM, F.lit(False)).alias("confirmed"),
        F.array_join("words", " ").alias("words"),
    )
