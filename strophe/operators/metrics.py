"""Evaluation metrics over generated quatrains (text by line) and classifier outputs; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions import scorers
from strophe.functions.core import let
from strophe.functions.enums import EMOTIONS, LEVELS, METERS, PAIRS, RHYME_SCHEMES
from strophe.functions.prosody import alliteration_level, alliterations, harmonic_mean, mean

from .fuzzy import closest, length_band
from .language_model import grams
from .scratch import Scratch


def checked(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """df, or an error if a value is none of the names."""
    return df.withColumn(column, F.when(F.col(column).isin(names), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(column, F.lit("null")))).cast("string")))


def rhyme_metric(df: DataFrame, quatrain: str = "quatrain", scheme: str = "scheme", probability=scorers.rhyme_probability) -> DataFrame:
    """Means and harmonic means of the probabilities of the expected labels, plain and balanced; malformed quatrains count 0."""
    df = checked(df, scheme, RHYME_SCHEMES).withColumn("_v", F.split(quatrain, "\n"))
    # Each pair's probability of its expected label, rhymes apart from dissonances: made once for a row, then used by all four means.
    pair = lambda i, j: F.struct((F.substring(scheme, i + 1, 1) == F.substring(scheme, j + 1, 1)).alias("same"), probability(F.get("_v", i), F.get("_v", j)).alias("p"))
    pick = lambda s, same: F.transform(F.filter(s, lambda x: x["same"] == same), lambda x: x["p"] if same else 1 - x["p"])

    def means(x):
        r, d = x["r"], x["d"]
        both = lambda op: let(F.array_compact(F.array(F.when(F.size(r) > 0, op(r)), F.when(F.size(d) > 0, op(d)))), op)
        four = lambda v: F.struct(mean(v).alias("rhyme_score"), harmonic_mean(v).alias("harmonic_rhyme_score"), both(mean).alias("balanced_rhyme_score"), both(harmonic_mean).alias("balanced_harmonic_rhyme_score"))
        return let(F.concat(r, d), four)

    split = let(F.array(*[pair(i, j) for i, j in PAIRS]), lambda s: F.struct(pick(s, True).alias("r"), pick(s, False).alias("d")))
    got = df.select(F.when(F.size("_v") == 4, let(split, means)).alias("m"))
    return got.agg(*[F.avg(F.coalesce(F.col(f"m.{c}"), F.lit(0.0))).alias(c) for c in ("rhyme_score", "harmonic_rhyme_score", "balanced_rhyme_score", "balanced_harmonic_rhyme_score")])


def meter_metric(df: DataFrame, quatrain: str = "quatrain", meter: str = "meter", probability=scorers.meter_probability, labels: str | None = None) -> DataFrame:
    """labels: the verses' meters, where they are known."""
    p = F.transform(labels, lambda x: scorers.probability_of_meter(x, F.col(meter))) if labels else F.transform("_v", lambda v: probability(v, F.col(meter)))
    df = checked(df, meter, METERS).withColumn("_v", F.split(quatrain, "\n")).withColumn("_p", F.when(F.size("_v") == 4, p))
    score = lambda f: F.avg(F.when(F.size("_v") == 4, f(F.col("_p"))).otherwise(0.0))
    return df.agg(score(mean).alias("meter_score"), score(harmonic_mean).alias("harmonic_meter_score"))


def alliteration_metric(df: DataFrame, quatrain: str = "quatrain", level: str = "level", phones=scorers.initials, medium: float = 0.05, high: float = 0.1, scores: str | None = None) -> DataFrame:
    """scores: the verses' alliteration scores, where they are known."""
    df = checked(df, level, LEVELS).withColumn("_v", F.split(quatrain, "\n"))
    df = df.withColumn("_s", F.col(scores) if scores else alliterations(F.transform("_v", phones)))
    found = alliteration_level(F.round(mean(F.col("_s")), 9), medium, high)
    return df.agg(F.avg(F.when((F.size("_v") == 4) & (found == F.col(level)), 1.0).otherwise(0.0)).alias("alliteration_score"))


def emotion_metric(df: DataFrame, quatrain: str = "quatrain", emotions: str = "emotions", probabilities: str | None = None) -> DataFrame:
    """Of each target emotion the largest probability over the verses; an empty list of targets is an error. probabilities: the verses' of all emotions, where they are known."""
    df = df.filter(F.expr(f"assert_true(size({emotions}) > 0 AND size(array_except({emotions}, array({', '.join(repr(e) for e in EMOTIONS)}))) = 0, 'bad emotions') IS NULL")).withColumn("_v", F.split(quatrain, "\n"))
    df = df.withColumn("_all", F.col(probabilities) if probabilities else F.transform("_v", scorers.emotion_probabilities))
    best = F.array(*[F.struct(F.lit(e).alias("e"), F.array_max(F.transform("_all", lambda x: F.get(x, i))).alias("p")) for i, e in enumerate(EMOTIONS)])  # noqa: B023
    p = F.transform(F.filter(best, lambda x: F.array_contains(emotions, x["e"])), lambda x: x["p"])
    df = df.withColumn("_p", F.when(F.size("_v") == 4, p))
    score = lambda f: F.avg(F.when(F.size("_v") == 4, f(F.col("_p"))).otherwise(0.0))
    return df.agg(score(mean).alias("emotion_score"), score(harmonic_mean).alias("harmonic_emotion_score"))


def coherence_metric(df: DataFrame, quatrain: str = "quatrain", probability=scorers.next_sentence) -> DataFrame:
    """Mean over all adjacent lines of all texts."""
    from .windows import adjacent_pairs

    pairs = df.select(F.explode(adjacent_pairs(F.split(quatrain, "\n"))).alias("p"))
    return pairs.agg(F.avg(probability(F.col("p.a"), F.col("p.b"))).alias("coherence"))


def length_bound(a: Column, b: Column, cutoff: float) -> Column:
    """What a match ratio of cutoff needs of the lengths."""
    return 2 * F.least(F.length(a), F.length(b)) >= cutoff * (F.length(a) + F.length(b))


def memorization_candidates(generated: DataFrame, train: DataFrame, keys: list[str], cutoff: float = 0.7) -> DataFrame:
    """Pairs of generated id, text and training text of the same style that could reach the cutoff by length; each different text once.

    Texts meet by style and band of lengths; no pair that could match is lost. Every generated text must have a training text of its style.
    """
    t = train.select(*keys, F.col("text").alias("known")).distinct()
    t = t.withColumn("_band", F.explode(F.array(*[length_band(F.col("known"), cutoff) + k for k in (-1, 0, 1)])))
    g = generated.withColumn("_band", length_band(F.col("text"), cutoff))
    return g.join(t, [*keys, "_band"]).drop("_band").filter(length_bound(F.col("text"), F.col("known"), cutoff))


def with_style(generated: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """generated, or an error for a text whose style no training text has."""
    styles = train.select(*keys).distinct().withColumn("_known", F.lit(True))
    message = F.concat(F.lit("no training text of style "), F.to_json(F.struct(*keys)))
    return generated.join(styles, keys, "left").filter(F.when(F.col("_known"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_known")


def memorization_metric(generated: DataFrame, train: DataFrame, keys: list[str], cutoff: float = 0.7) -> DataFrame:
    """Share of generated texts with a training text of the same style at a difflib ratio of cutoff or more."""
    generated = Scratch(generated.sparkSession, "generated").keep(with_style(generated, train, keys))

    hits = closest(generated, train, keys, cutoff).select("id").distinct().withColumn("hit", F.lit(1.0))
    return generated.join(hits, "id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("extractive_memorization_rate"))


def macro_prf(df: DataFrame, label: str, predicted: str, classes: list | None = None) -> DataFrame:
    """Macro precision, recall and F1 (0 where undefined) and accuracy, from one count by label and prediction."""
    c = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    own = c.select(F.explode(F.array(F.struct(F.col(label).alias("k"), F.lit("l").alias("side")), F.struct(F.col(predicted).alias("k"), F.lit("p").alias("side")))).alias("x"), "n", (F.col(label) == F.col(predicted)).alias("same"))
    per = own.groupBy("x.k").agg(F.sum(F.when(F.col("same") & (F.col("x.side") == "l"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.side") == "l", F.col("n")).otherwise(0)).alias("real"), F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("said"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("real"))
    return per.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(ratio(2 * F.col("tp"), F.col("said") + F.col("real"))).alias("f1"), (F.sum("tp") / F.sum("real")).alias("accuracy"))


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)) - 1


def predicted_labels(logits: Column, least: float = 0.5) -> Column:
    """Sigmoid of each logit at least a half."""
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)) >= least)


def multilabel_prf(df: DataFrame, labels: str, predicted: str, classes: list[str]) -> DataFrame:
    """Macro precision, recall and F1 over classes of two arrays of labels (0 where undefined), and accuracy (both arrays agree in every class); one aggregation."""
    has = lambda c, k: F.coalesce(F.array_contains(c, k), F.lit(False))
    both = [F.sum((has(labels, k) & has(predicted, k)).cast("long")).alias(f"b{i}") for i, k in enumerate(classes)]
    real = [F.sum(has(labels, k).cast("long")).alias(f"r{i}") for i, k in enumerate(classes)]
    said = [F.sum(has(predicted, k).cast("long")).alias(f"s{i}") for i, k in enumerate(classes)]
    same = F.avg(F.forall(F.array(*map(F.lit, classes)), lambda k: has(labels, k) == has(predicted, k)).cast("double")).alias("accuracy")
    one = df.agg(*both, *real, *said, same)
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    macro = lambda f: sum((f(F.col(f"b{i}"), F.col(f"r{i}"), F.col(f"s{i}")) for i in range(len(classes))), F.lit(0.0)) / len(classes)
    return one.select(macro(lambda b, r, s: ratio(b, s)).alias("precision"), macro(lambda b, r, s: ratio(b, r)).alias("recall"), macro(lambda b, r, s: ratio(2 * b, r + s)).alias("f1"), "accuracy")


def byte_perplexity(df: DataFrame, text: str = "text") -> DataFrame:
    """Mean over rows of exp of the mean negative log-likelihood of their bytes under the corpus's own byte frequencies; empty texts have none.

    Each row is counted by itself (256 counts at most), so neither bytes nor texts are dealt out.
    """
    b = df.select(F.monotonically_increasing_id().alias("_id"), grams(1)(text).alias("_g")).select("_id", F.inline("_g"))
    total = b.groupBy("gram").agg(F.sum("n").alias("m"))  # 256 rows
    shares = total.join(F.broadcast(total.agg(F.sum("m").alias("t")))).select("gram", F.log(F.col("m") / F.col("t")).alias("logp"))
    per = b.join(F.broadcast(shares), "gram").groupBy("_id").agg(F.exp(-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("ppl"))
    return per.agg(F.avg("ppl").alias("mean_perplexity"))


def merged(*metrics: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """One-row metrics side by side."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.join(F.broadcast(m))
    return out.withColumnsRenamed(rename or {})
